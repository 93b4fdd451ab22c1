"""Derived views over the base tables, as SQL that Spark and DuckDB run unchanged.

The base tables hold no contracts, messages or job logs. These views make them out of orders, customers, line
items, conversations and events, with defects planted by key, so that no check runs on nothing.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketmill.ship import ship

AGREEMENTS = """
select o_orderkey as doc_id, concat_ws(chr(10),
 concat('This Agreement is made on 3 March 2026 between ', replace(c_name, '#', ' '), ' Limited (the "Buyer") and Northgate Freight ', case when o_orderkey % 5 = 0 then 'LLP' else 'Limited' end, ' (the "Seller").'),
 '1. Definitions',
 '"Completion Date" means 10 April 2026.',
 '"Confidential Information" means all information that either party discloses.',
 case when o_orderkey % 8 = 0 then '"Completion Date" means 11 April 2026.' when o_orderkey % 8 = 1 then '"Completion Date" means 10 April 2026.' else '"Goods" means the goods in Schedule 1.' end,
 case when o_orderkey % 6 = 0 then '"Escrow Agent" means the bank named in Schedule 4.' else 'Headings do not matter.' end,
 '2. Payment',
 concat('The Buyer shall pay within thirty (', case when o_orderkey % 7 = 0 then '13' else '30' end, ') days after the Completion Date.'),
 concat('The Buyer shall pay USD 1,500.00 for the Goods and ', case when o_orderkey % 10 = 0 then 'US$200.00' else 'USD 200.00' end, ' for freight.'),
 '3. Notices',
 concat('See Section ', cast(1 + o_orderkey % 7 as varchar(10)), ' and Schedule 1. Notice takes effect two (2) days after posting.'),
 case when o_orderkey % 11 = 0 then '4. Price. The fee is [AMOUNT].' when o_orderkey % 11 = 1 then '4. Price. The fee is ______.' else '4. Price. The fee is agreed.' end,
 case when o_orderkey % 12 = 0 then '6. Term' when o_orderkey % 12 = 1 then '4. Term' else '5. Term' end,
 concat('This Agreement ends on ', case when o_orderkey % 13 = 0 then 'June 5, 2026' else '5 June 2026' end, '.'),
 concat('The parties meet on ', case when o_orderkey % 14 = 0 then 'Tuesday' else 'Monday' end, ', 6 April 2026.'),
 case o_orderkey % 15 when 0 then 'The the Seller delivers the Goods.' when 1 then 'The Seller delivers the Goods , carriage paid.' when 2 then 'The Seller delivers  the Goods.' when 3 then 'The Seller delivers the Goods,carriage paid.' else 'The Seller delivers the Goods.' end,
 case when o_orderkey % 18 = 0 then 'The Service Levels apply from the start. The Service Levels are reviewed yearly.' else 'Nothing else applies.' end,
 case when o_orderkey % 19 = 0 then 'The Sellar bears the risk.' else 'The Seller bears the risk.' end,
 case when o_orderkey % 20 = 0 then 'Neither party uses confidential information.' else 'Neither party uses Confidential Information.' end,
 case when o_orderkey % 21 = 0 then 'Northgate Freight Ltd insures the Goods.' else 'The Seller insures the Goods.' end,
 concat('The date of this Agreement is ', case when o_orderkey % 22 = 0 then '4 March 2026' else '3 March 2026' end, '.'),
 concat('Either party may end this Agreement on ', case when o_orderkey % 23 = 0 then '400' else '30' end, ' days notice. The term of this Agreement is 12 months.'),
 'Schedule 1 Goods') as text
 from orders join customer on o_custkey = c_custkey"""

VERSIONS = """
select doc_id, 'v1' as ver, text from agreements union all
 select doc_id, 'v2', case when doc_id % 3 = 0 then replace(text, '(30)', '(60)') when doc_id % 3 = 1 then concat(text, chr(10), '7. Costs. Each party bears its own costs.') else text end from agreements"""

CELLS = """
select l_orderkey as doc_id, cast(l_linenumber as int) as row_no, concat('Line ', cast(l_linenumber as varchar(10))) as label, cast(l_extendedprice as decimal(18,2)) as amount from lineitem
 union all
 select l_orderkey, 999, 'Total', cast(sum(cast(l_extendedprice as decimal(18,2))) + case when l_orderkey % 13 = 0 then 100 else 0 end as decimal(18,2)) from lineitem group by l_orderkey"""

MAIL = """
select conv_id * 100 + turn as msg_id, conv_id as thread_id, turn, concat('u', cast(conv_id % 7 as varchar(10)), '@firm.example') as owner,
 case when role = 'user' then 'received' else 'sent' end as direction,
 case when (conv_id + turn) % 3 = 0 then concat('Legal Team <legal@', case when conv_id % 2 = 0 then 'acme' else 'northgate' end, '.example>')
      when (conv_id + turn) % 3 = 1 then 'someone@gmail.com' else cast(null as varchar(50)) end as external,
 concat(case when turn % 4 = 0 then 'Re: ' when turn % 4 = 1 then 'Fwd: ' else '' end, 'Matter ', cast(1000 + conv_id % 40 as varchar(10)), case when turn % 5 = 2 then ' [Automatic reply]' else '' end) as subject,
 concat('Agreement', case when turn % 3 = 0 then ' (clean)' when turn % 3 = 1 then ' v2' else ' final' end, '.docx') as filename,
 concat(case when turn % 4 = 0 then 'Please find attached version 2. ' when turn % 4 = 1 then 'thanks' when turn % 4 = 2 then 'undo 1 and 3. ' else 'Schedule 2 will follow. ' end, case when turn % 4 = 1 then '' else text end) as body
 from conversations"""

NOTES = """
select conv_id * 100 + turn as msg_id, concat('u', cast(conv_id % 7 as varchar(10)), '@firm.example') as sender, case when turn % 3 = 0 then 'Deed (clean).docx' else 'Deed.docx' end as filename, turn % 2 = 0 as tracked, conv_id % 3 = 0 as comments,
 concat(case (conv_id + turn) % 13 when 9 then 'The exclusivity period has been removed.' when 10 then 'As agreed the non-solicit wording was struck out, and clause 7.2 is now deleted.' when 11 then 'It no longer mentions the long stop date.' when 12 then 'All is kept and nothing was removed.' when 0 then 'I removed the exclusivity  period wording.' when 1 then 'We took out the long stop date, as agreed.' when 2 then 'I deleted the indemnity.' when 3 then 'Please find attached the deed with Bluewater Ports Limited.' when 4 then 'Attached is the Acme Mills Ltd deed. Harbour Bank plc asks for it.'
  when 5 then 'The paper for Bluewater Ports Limited will follow. Find a clean copy enclosed.' when 6 then 'Enclosed for Strand LLP and Firm Holdings Limited.' else 'Struck out the non-solicit clause; see attached.' end, chr(10), 'Regards') as body,
 concat('This deed is made between Acme Mills Limited and another. The exclusivity period', chr(10), 'runs for a year. ', case when conv_id % 2 = 0 then 'The long stop' || chr(10) || 'date is fixed. ' else '' end, case when conv_id % 3 = 0 then 'A non-solicit applies; see clause 7.2. ' else 'See clause 7.21. ' end, 'An indemnity is given.') as doc from conversations"""

OUTCOMES = """
select event_id, ts as observed_at, concat('u', cast(user_id as varchar(10))) as user_address, cast(user_id % 5 as int) as client_id,
 concat('cat', cast(event_id % 6 as varchar(10))) as category,
 case event_type when 'purchase' then 'accepted' when 'error' then 'rejected' when 'view' then 'dismissed' else 'unknown' end as outcome from events"""

DEEDS = """
select o_orderkey as doc_id, concat_ws(chr(10), '1. Definitions',
 case o_orderkey % 13 when 11 then 'In this deed "Fee" means tax. "Rate" means four per cent.' when 12 then 'Papers stamped "Secret" and the house known as the "Lodge" are not let; "Old Lodge", which' when 0 then '"Business Day" shall mean a day on which banks are open.' when 1 then 'In this deed “Fee” includes any tax; "Rate" means four per cent.' when 2 then '"Losses" has the meaning given in clause 9.'
  when 3 then 'North Ltd (the "Buyer" or "Purchaser") and the sellers, together the "Sellers", agree.' when 4 then '(a) "Charges" – the sums in the table' when 5 then 'Papers marked "Confidential" are kept.' when 6 then '"Group" or "Group Companies" means the company and its subsidiaries.'
  when 7 then 'Hereinafter referred to as the “Lender”, the bank may assign.' when 8 then '"Deposit":' when 9 then 'The word (each a "Share", and "Shares" means all of them) is used.' else '"Fee" refers to the sum in (the "Fee" letter).' end,
 case o_orderkey % 12 when 9 then 'Fee of seven (123456789012345678901234) pounds.' when 10 then 'Between nine and ten (10) years, or two hundred hundred (7).' when 11 then 'A sum of nineteen hundred (1,900) pounds.' when 0 then 'The price is one hundred and fifty thousand (150,000) pounds.' when 1 then 'The price is one hundred and fifty thousand (15,000) pounds.' when 2 then 'It pays 2,500,000 (two million five hundred thousand) euros.' when 3 then 'It pays 250 (two hundred and five) euros.'
  when 4 then 'Within twenty-one (12) days.' when 5 then 'A cap of three billion and one (3,000,000,001).' when 6 then 'A cap of thousand (1000) and hundred (10).' when 7 then 'Seven (7) of seventy-seven (77), eleven (12).' else 'In total ninety (90) per cent.' end,
 case o_orderkey % 17 when 13 then 'Within 99999999999 days nothing happens.' when 14 then 'It lasts for 10 days from and including the Start Date.' when 15 then 'Bills are sent; after 5 weeks the seller may rescind, and within 2 days pay.' when 16 then 'He is on 2 years beginning with the Start Date bound not to disclose it.' when 0 then 'The term of this deed continues for 24 months.' when 1 then 'Either party may end it on 3 months notice.' when 2 then 'A breach not remedied within 14 days ends it.' when 3 then 'The invoice is paid within 30 days after the Start Date.'
  when 4 then 'It renews for 12 months at a time.' when 5 then 'A letter is deemed received on 2 days after posting.' when 6 then 'Clause 4 survives for 2 years.' when 7 then 'Nobody shall compete for 18 months.' when 8 then 'Claims are made within 6 months after the Start Date.'
  when 9 then 'The retention is held for 1 year.' when 10 then 'Confidential papers are kept for 5 years.' when 11 then 'Completion is on 1 month after the Start Date.' else 'The hall is open for 3 weeks.' end,
 concat('"Start Date" means ', case o_orderkey % 4 when 0 then '31 January 2027' when 1 then '29 February 2028' when 2 then '30 August 2026' else '1 March 2026' end, '.')) as text from orders"""

TIMES = """
select o_orderkey as doc_id, concat_ws(chr(10), 'This Deed is dated 3 March 2026.',
 concat('"Completion Date" means ', case when o_orderkey % 9 = 0 then '1 March 2026' else '10 April 2026' end, '.'),
 concat('"Long Stop Date" means ', case o_orderkey % 7 when 0 then '1 February 2026' when 1 then '1 April 2026' when 2 then '2 May 2026' else '30 September 2026' end, '.'),
 '"Handover" means 30 days after the Completion Date.',
 concat('"Release" means ', case when o_orderkey % 8 = 0 then '2 months before' else '1 month after' end, ' the Handover.'),
 case when o_orderkey % 19 = 0 then concat('"Opening" means 5 days after the Handover.', chr(10), '"Opening" means 9 days after the Handover.') when o_orderkey % 19 = 1 then concat('"Opening" means 1 month after the Handover.', chr(10), '"Opening" means 30 days after the Handover.') else '"Opening" means 7 days after the Release.' end,
 '1. Claims', concat('A claim is made within ', case o_orderkey % 11 when 0 then '6 months' when 1 then '360 days' else '18 months' end, ' after the Completion Date.'),
 'The retention is paid out 12 months after the Completion Date.',
 '2. Ending', concat('Either party may terminate on ', case when o_orderkey % 6 = 0 then '4 weeks' else '90 days' end, ' notice.'),
 concat('A breach is cured within ', case when o_orderkey % 3 = 0 then '60 days' else '14 days' end, '.'),
 '3. Review', 'The price is reviewed, and faults are cured within 300 days.',
 concat('The Initial Term is ', case when o_orderkey % 5 = 0 then '52 weeks' else '12 months' end, '. The Second Period lasts 2 years.'),
 concat('Notice is given ', case o_orderkey % 13 when 0 then '400 days' when 1 then '350 days' else '60 days' end, ' before the end of the Initial Term.'),
 case o_orderkey % 17 when 0 then 'An Initial Term of 24 months applies.' when 1 then 'An Initial Term of 1 year applies.' else 'Nothing else applies.' end) as text from orders"""

AUDIT_EVENTS = "select event_id, ts, user_id % 40 as job_id, event_type as step, value from events"

VIEWS = {"agreements": AGREEMENTS, "deeds": DEEDS, "times": TIMES, "versions": VERSIONS, "cells": CELLS, "mail": MAIL, "notes": NOTES, "outcomes": OUTCOMES, "audit_events": AUDIT_EVENTS}
ROWS_OF = {"agreements": ("orders", "o_orderkey", ["o_orderkey", "o_custkey"]), "deeds": ("orders", "o_orderkey", ["o_orderkey"]), "times": ("orders", "o_orderkey", ["o_orderkey"])}
NEEDS = {"agreements": ["orders", "customer"], "deeds": ["orders"], "times": ["orders"], "versions": ["orders", "customer"], "cells": ["lineitem"], "mail": ["conversations"], "notes": ["conversations"], "outcomes": ["events"], "audit_events": ["events"]}


def base(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A base table."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str, *, in_order: bool = False) -> DataFrame:
    """A derived view, over the tables of a folder; no name is left in the session's catalogue. `in_order`: rows of one document,
    of those views that are dealt out by document, stand one after the other."""
    frames = {t: base(spark, sf_dir, t) for t in NEEDS[name]}
    text = VIEWS[name]
    if name in ROWS_OF:
        # The short rows are dealt out by the document's key before their texts are made: what follows by document
        # needs no further shuffle, and a table in one small file is worked on by all cores. The number is given, as
        # Spark would take rows this short together again.
        table, key, columns = ROWS_OF[name]
        n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
        frames[table] = frames[table].select(*columns)
        if name == "agreements":
            # Joined while the rows are short: a join by another key would deal the documents out anew.
            frames = {table: frames[table].join(frames["customer"].select("c_custkey", "c_name"), F.expr("o_custkey = c_custkey"))}
            text = text.replace("from orders join customer on o_custkey = c_custkey", "from orders")
        frames[table] = frames[table].repartition(n, key)
        if in_order:
            frames[table] = frames[table].sortWithinPartitions(key)
    if name == "versions":
        frames = {"agreements": view(spark, sf_dir, "agreements")}
    for t in frames:
        text = re.sub(rf"\b(from|join) {t}\b", rf"\1 {{{t}}}", text)
    return spark.sql(text, **frames)


def with_views(sql: str) -> str:
    """DuckDB SQL with the views that it names put in front, and their lines: blocks of agreements, deed_lines of deeds, time_lines
    of times."""
    lines = "select doc_id, cast(i - 1 as int) as idx, parts[i] as text from (select doc_id, string_split(text, chr(10)) as parts from agreements), unnest(range(1, len(parts) + 1)) as t(i)"
    every = VIEWS | {"blocks": lines, "deed_lines": lines.replace("from agreements", "from deeds"), "time_lines": lines.replace("from agreements", "from times")}
    wanted: list[str] = []

    def want(text: str) -> None:
        for name in every:
            if re.search(rf"\b{name}\b", text) and name not in wanted:
                if not re.search(rf"\b{name} as \(", text):
                    want(every[name])
                    wanted.append(name)

    want(sql)
    if not wanted:
        return sql
    front = ", ".join(f"{n} as ({every[n]})" for n in wanted)
    if sql.lower().startswith("with recursive "):
        return f"with recursive {front}, {sql[15:]}"
    return f"with {front}, {sql[5:]}" if sql.lower().startswith("with ") else f"with {front} {sql}"
