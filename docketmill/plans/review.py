"""Queries over signature blocks, reports, memory and access."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketmill.functions import secure
from docketmill.operators import checks, memory, report, signing
from docketmill.operators.structure import blocks
from docketmill.plans.compare import CHANGED, pairs
from docketmill.plans.documents import amounts_sql, BLANKS, FEW, FIRSTS, agreements, finding, lines
from docketmill.plans.registry import query
from docketmill.plans.views import base, view


def signed(spark, sf_dir) -> DataFrame:
    """Agreements with signature lines put after them; who signs and what is filled in goes by the key."""
    docs = agreements(spark, sf_dir)
    first = F.concat(F.lit("SIGNED by Northgate Freight "), F.when(F.col("doc_id") % 5 == 0, "LLP").otherwise("Limited"))
    second = F.when(F.col("doc_id") % 4 == 0, "SIGNED by Somebody Else Inc").otherwise("SIGNED for and on behalf of the Buyer Limited")
    tail = F.concat_ws("\n", first, F.when(F.col("doc_id") % 3 == 0, "Name: A. Person").otherwise("Name: ______"), F.lit("Title: Director"), F.lit(""), second, F.lit("By: ____"), F.lit("Date:"))
    return docs.select("doc_id", F.concat_ws("\n", "text", tail).alias("text"))


SIGNED = """sg as (select doc_id, 0 as b, concat('Northgate Freight ', case when doc_id % 5 = 0 then 'LLP' else 'Limited' end) as entity, 2 as fields, case when doc_id % 3 = 0 then 2 else 1 end as filled, case when doc_id % 3 = 0 then 0 else 1 end as blank from agreements
 union all select doc_id, 1, case when doc_id % 4 = 0 then 'Somebody Else Inc' else 'the Buyer Limited' end, 2, 0, 2 from agreements)"""


@query(f"with {SIGNED} select doc_id, entity, fields, filled, blank from sg")
def signature_blocks(spark, sf_dir):
    return signing.signature_blocks(blocks(signed(spark, sf_dir))).select("doc_id", "entity", "fields", "filled", "blank")


@query(f"""with {SIGNED}, p as (select doc_id, 'Northgate Freight' as name from agreements union all select doc_id, 'the Buyer' from agreements)
 select doc_id, name as who, 'party without block' as kind from p where not exists (select 1 from sg where sg.doc_id = p.doc_id and contains(lower(sg.entity), lower(p.name)))
 union all select doc_id, entity, 'block without party' from sg where not exists (select 1 from p where p.doc_id = sg.doc_id and contains(lower(sg.entity), lower(p.name)))
 union all select doc_id, entity, 'half filled' from sg where filled > 0 and blank > 0""")
def check_signature_blocks(spark, sf_dir):
    docs = signed(spark, sf_dir)
    parties = docs.select("doc_id", F.explode(F.array(F.lit("Northgate Freight"), F.lit("the Buyer"))).alias("name"))
    return signing.signature_findings(blocks(docs), parties)


@query("select doc_id, 23 as idx, 'Northgate Freight' as base, 'Buyer' as said, 'Seller' as opening from agreements where doc_id % 9 = 0")
def check_role_drift(spark, sf_dir):
    more = F.when(F.col("doc_id") % 9 == 0, F.concat("text", F.lit('\nNorthgate Freight Limited (the "Buyer") pays.'))).otherwise(F.col("text"))
    return signing.role_drift(blocks(agreements(spark, sf_dir).select("doc_id", more.alias("text"))))


@query("select doc_id, 'Seller' as role, 'Northgate Freight' as was, 'Southgate Freight' as now from agreements where doc_id % 6 = 0")
def renamed_parties(spark, sf_dir):
    old = agreements(spark, sf_dir)
    roles = lambda d: checks.parties(blocks(d)).select("doc_id", "role", F.col("base").alias("name"))
    new = old.select("doc_id", F.when(F.col("doc_id") % 6 == 0, F.replace("text", F.lit("Northgate Freight"), F.lit("Southgate Freight"))).otherwise(F.col("text")).alias("text"))
    return signing.renamed_since(roles(old), roles(new))


PAGES = "pg as (select l_orderkey as closing_id, concat('s', cast(l_suppkey % 5 as varchar)) as signatory, concat('d', cast(l_linenumber as varchar)) as document, l_returnflag <> 'N' as received from lineitem)"


def pages(spark, sf_dir):
    return base(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("closing_id"), F.concat(F.lit("s"), (F.col("l_suppkey") % 5).cast("string")).alias("signatory"), F.concat(F.lit("d"), F.col("l_linenumber").cast("string")).alias("document"), (F.col("l_returnflag") != "N").alias("received"))


@query(f"with {PAGES} select closing_id, count(case when received then 1 end) as received, count(*) as total, bool_and(received) as done, coalesce(array_to_string(list_sort(list(distinct signatory) filter (not received)), ', '), '') as outstanding from pg group by 1")
def closing_tally(spark, sf_dir):
    return signing.closing(pages(spark, sf_dir))


@query(f"""with {PAGES}, d as (select distinct closing_id, document from pg where document <> 'd7'), s as (select distinct closing_id, signatory from pg where signatory <> 's4'), u as (select distinct closing_id, signatory, document from pg where received and closing_id % 10 = 0 and not exists (select 1 from pg x where x.closing_id = pg.closing_id and x.signatory = pg.signatory and x.document = pg.document and x.received and x.closing_id % 10 <> 0))
 select distinct closing_id, 'unknown document' as problem, document as what from pg where document = 'd7' union select closing_id, 'unknown signatory', signatory from pg where signatory = 's4' union select closing_id, 'no longer received', concat(signatory, ' / ', document) from u""")
def closing_problems(spark, sf_dir):
    p = pages(spark, sf_dir)
    now = p.withColumn("received", F.col("received") & (F.col("closing_id") % 10 != 0))
    return signing.state_problems(now, p.where("document <> 'd7'").select("closing_id", "document").distinct(), p.where("signatory <> 's4'").select("closing_id", "signatory").distinct(), p)


def found(spark, sf_dir):
    b = lines(spark, sf_dir)
    return checks.deduplicated(reduce(DataFrame.union, (c(b) for c in FEW)))


@query(f"{FIRSTS} select doc_id, idx, kind, severity, anchor, note, severity = 3 and length(note) <= greatest(200, 5 * length(anchor)) and anchor <> note and anchor <> '' as automatic from firsts")
def automatic_edits(spark, sf_dir):
    return report.partitioned(found(spark, sf_dir))


@query(finding(f"""select doc_id, count(case when kind = 'x' then 1 end) + count(*) - count(case when kind in ('double space', 'space before mark', 'no space after comma') then 1 end) as shown, count(case when kind in ('double space', 'space before mark', 'no space after comma') then 1 end) as withheld from (select doc_id, kind from ({BLANKS}) union all select doc_id, kind from (PUNCT)) group by 1""").replace("PUNCT", "select doc_id, 'double space' as kind, unnest(regexp_extract_all(text, '\\S+  +\\S+')) as a from blocks union all select doc_id, 'space before mark', unnest(regexp_extract_all(text, '\\S+ [,;:.](?:\\s|$)')) from blocks union all select doc_id, 'no space after comma', unnest(regexp_extract_all(text, '[A-Za-z]+,[A-Za-z]+')) from blocks union all select doc_id, 'repeated word', 'the the' from agreements where doc_id % 15 = 0"))
def withheld_points(spark, sf_dir):
    b = lines(spark, sf_dir)
    return report.without_cosmetics(checks.blanks(b).union(checks.punctuation(b)))


@query(f"""{FIRSTS}, n as (select *, count(*) over (partition by doc_id) as c from firsts) select doc_id, concat(kind, ': ', anchor) as item from n where c <= 2 union all select doc_id, concat(cast(count(*) as varchar), ' x ', kind) from n where c > 2 group by doc_id, kind""")
def applied_items(spark, sf_dir):
    return report.applied_items(found(spark, sf_dir), 2)


@query(f"""{FIRSTS}, s as (select doc_id, severity, string_agg(concat('- ', kind, ': ', anchor, ' (', note, ')'), chr(10) order by idx, kind, anchor) as body from firsts group by 1, 2)
 select doc_id, string_agg(concat(case severity when 1 then 'Before signing' when 2 then 'To decide' else 'Tidied up' end, chr(10), body), chr(10) || chr(10) order by severity) as report from s group by 1""")
def composed_reports(spark, sf_dir):
    return report.composed(found(spark, sf_dir))


@query(f"{FIRSTS} select doc_id, cast(row_number() over (partition by doc_id order by severity, idx, kind, anchor) as int) as place, kind, anchor, note from firsts where severity < 3")
def issues_lists(spark, sf_dir):
    return report.issues(found(spark, sf_dir))


@query(f"{FIRSTS}, r as (select doc_id, cast(row_number() over (partition by doc_id order by severity, idx, kind, anchor) as int) as place, anchor from firsts where severity < 3) select * from r where place <= 2")
def example_points(spark, sf_dir):
    return report.examples(found(spark, sf_dir))


@query(f"""with {CHANGED}, k as (select doc_id, kind, coalesce(new_idx, old_idx) // 8 as clause from ch), n as (select doc_id, clause, grouping(clause) as level, count(case when kind = 'inserted' then 1 end) as inserted, count(case when kind = 'deleted' then 1 end) as deleted, count(case when kind = 'replaced' then 1 end) as replaced, count(case when kind = 'moved' then 1 end) as moved from k group by rollup (doc_id, clause) having grouping(doc_id) = 0) select doc_id, cast(clause as int) as clause, cast(level as int) as level, inserted, deleted, replaced, moved from n""")
def change_summaries(spark, sf_dir):
    from docketmill.operators import versions

    c = versions.changes(pairs(spark, sf_dir))
    return report.change_summary(c.withColumn("clause", F.floor(F.coalesce("new_idx", "old_idx") / 8).cast("int")))


@query("with j as (select user_id % 40 as job_id, min(ts) as a, max(ts) as b from events group by 1) select job_id, concat('This is taking longer than usual: ', cast(cast(ceil((floor(epoch(b)) - floor(epoch(a))) / 60) as bigint) as varchar), ' minutes so far.') as notice from j where floor(epoch(b)) - floor(epoch(a)) > 600")
def overdue_notices(spark, sf_dir):
    from docketmill.operators import ledger

    return report.overdue_notice(ledger.jobs(view(spark, sf_dir, "audit_events")), 600)


@query("select cast(user_id as varchar) as user_id, string_agg(distinct event_type, '; ' order by event_type) as kinds from events group by user_id")
def csv_rows(spark, sf_dir):
    kinds = base(spark, sf_dir, "events").groupBy("user_id").agg(F.array_sort(F.collect_set("event_type")).alias("kinds"))
    return report.as_csv_rows(kinds, ["kinds"])


@query("select concat('c', cast(c_custkey as varchar), '@x.example') as address, concat('BEGIN:VCARD', chr(13), chr(10), 'VERSION:3.0', chr(13), chr(10), 'FN:', c_name, '\\, Ltd', chr(13), chr(10), 'EMAIL;TYPE=INTERNET:c', cast(c_custkey as varchar), '@x.example', chr(13), chr(10), 'END:VCARD', chr(13), chr(10)) as card from customer")
def contact_cards(spark, sf_dir):
    people = base(spark, sf_dir, "customer").select(F.concat("c_name", F.lit(", Ltd")).alias("name"), F.concat(F.lit("c"), F.col("c_custkey").cast("string"), F.lit("@x.example")).alias("address"))
    return report.contact_card(people)


ENTRIES = "en as (select event_id as entry_id, user_id % 20 as owner, (['matter', 'client', 'person', 'firm'])[cast(event_id % 4 as int) + 1] as scope, case when event_id % 3 = 0 then 'pending' else 'confirmed' end as status, (event_id % 7) / 7.0 as confidence, event_id % 5 = 0 as about_client, case when event_id % 2 = 0 then cast(event_id % 9 as int) end as matter, ts as noted_at, event_id % 6 <> 0 as announced from events)"


def entries(spark, sf_dir):
    e = F.col("event_id")
    scope = F.element_at(F.array(*map(F.lit, memory.SCOPES)), (e % 4 + 1).cast("int"))
    return base(spark, sf_dir, "events").select(e.alias("entry_id"), (F.col("user_id") % 20).alias("owner"), scope.alias("scope"), F.when(e % 3 == 0, "pending").otherwise("confirmed").alias("status"), ((e % 7) / 7.0).alias("confidence"), (e % 5 == 0).alias("about_client"), F.when(e % 2 == 0, (e % 9).cast("int")).alias("matter"), F.col("ts").alias("noted_at"), (e % 6 != 0).alias("announced"))


@query(f"with {ENTRIES}, k as (select *, row_number() over (partition by owner, scope order by confidence desc, entry_id) as n from en where status = 'confirmed') select owner, entry_id, scope, cast(row_number() over (partition by owner order by list_position(['matter', 'client', 'person', 'firm'], scope), confidence desc, entry_id) as int) as place from k where n <= 5")
def recalled_entries(spark, sf_dir):
    return memory.recalled(entries(spark, sf_dir), 5)


@query(f"with {ENTRIES} select entry_id, case when about_client and scope = 'person' and matter is not null then 'matter' else scope end as scope from en where not (about_client and scope in ('person', 'firm') and not (scope = 'person' and matter is not null))")
def walled_entries(spark, sf_dir):
    return memory.walled(entries(spark, sf_dir)).select("entry_id", "scope")


@query(f"with {ENTRIES} select owner, min(entry_id) as entry_id from en where not announced group by 1")
def next_announcements(spark, sf_dir):
    return memory.next_announcement(entries(spark, sf_dir))


@query(f"with {ENTRIES} select entry_id from en where status <> 'pending' or noted_at >= (select max(ts) - interval 10 day from events)")
def unexpired_entries(spark, sf_dir):
    cutoff = base(spark, sf_dir, "events").agg(F.max("ts") - F.expr("interval 10 days")).scalar()
    return memory.expired(entries(spark, sf_dir), cutoff).select("entry_id")


VERSIONED = "ve as (select o_orderkey as version_id, o_custkey as owner, o_orderkey % 50 as version, case o_orderstatus when 'O' then 'live' when 'F' then 'draft' else 'discarded' end as status from orders)"


def versioned(spark, sf_dir):
    status = F.when(F.col("o_orderstatus") == "O", "live").when(F.col("o_orderstatus") == "F", "draft").otherwise("discarded")
    return base(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("version_id"), F.col("o_custkey").alias("owner"), (F.col("o_orderkey") % 50).alias("version"), status.alias("status"))


@query(f"with {VERSIONED} select owner, arg_max(version_id, (version, version_id)) as version_id from ve where status = 'live' group by 1")
def live_versions(spark, sf_dir):
    return memory.live(versioned(spark, sf_dir))


@query(f"with {VERSIONED}, n as (select *, row_number() over (partition by owner, status order by version desc, version_id desc) as n from ve) select version_id, owner, version, case when status = 'live' and n > 1 then 'superseded' else status end as status from n")
def superseded_versions(spark, sf_dir):
    return memory.superseded(versioned(spark, sf_dir))


RULES = "ru as (select distinct user_address as owner, category as kind, case when client_id = 2 then 'spoken' else 'learned' end as source, false as lifted from outcomes where client_id in (2, 3))"


def rules(spark, sf_dir):
    return view(spark, sf_dir, "outcomes").where("client_id in (2, 3)").select(F.col("user_address").alias("owner"), F.col("category").alias("kind"), F.when(F.col("client_id") == 2, "spoken").otherwise("learned").alias("source"), F.lit(False).alias("lifted")).distinct()


@query(f"with {RULES} select event_id, user_address as owner, category as kind from outcomes o where not exists (select 1 from ru where ru.owner = o.user_address and ru.kind = o.category)")
def unsuppressed_points(spark, sf_dir):
    points = view(spark, sf_dir, "outcomes").select("event_id", F.col("user_address").alias("owner"), F.col("category").alias("kind"))
    return memory.suppressed(points, rules(spark, sf_dir)).select("event_id", "owner", "kind")


@query(f"with {RULES} select owner, kind, source, kind = 'cat1' as lifted from ru where not (kind = 'cat1' and source = 'spoken')")
def lifted_rules(spark, sf_dir):
    r = rules(spark, sf_dir)
    return memory.lifted(r, r.where("kind = 'cat1'")).select("owner", "kind", "source", "lifted")


def addressed(spark, sf_dir):
    domain = F.nullif(F.regexp_extract("external", r"@([a-z.]+)", 1), F.lit(""))
    return view(spark, sf_dir, "mail").select("msg_id", F.regexp_extract("subject", r"(\d{4})", 1).alias("matter"), domain.alias("domain"))


ADDRESSED = "ad as (select msg_id, regexp_extract(subject, '(\\d{4})', 1) as matter, nullif(regexp_extract(external, '@([a-z.]+)', 1), '') as domain from mail)"


@query(f"with {ADDRESSED} select msg_id, case when cast(matter as int) % 2 = 0 then cast(matter as int) % 7 when domain = 'acme.example' then 100 end as client_id from ad")
def clients_of_messages(spark, sf_dir):
    links = spark.range(1000, 1040, 2).select(F.col("id").cast("string").alias("matter"), (F.col("id") % 7).cast("int").alias("client_id"))
    domains = spark.createDataFrame([("acme.example", 100), ("gmail.com", 101), ("gmail.com", 102)], "domain string, client_id int")
    return memory.client_of(addressed(spark, sf_dir), links, domains)


@query(f"with {ADDRESSED} select msg_id, case when matter = '1004' then 1 else 2 end as rule_id from ad where matter = '1004' or domain = 'northgate.example'")
def excluded_messages(spark, sf_dir):
    some = spark.createDataFrame([(1, "matter", "1004"), (2, "domain", "northgate.example")], "rule_id int, kind string, value string")
    return memory.excluded(addressed(spark, sf_dir), some)


@query("select msg_id, array_to_string(list_filter([case when turn % 2 = 0 then 'mode' end, case when turn % 3 = 0 then 'file' end], lambda x: x is not null), ', ') as fields from mail where turn % 2 = 0 or turn % 3 = 0")
def plan_disagreements(spark, sf_dir):
    m = view(spark, sf_dir, "mail")
    a = m.select("msg_id", F.lit("review").alias("mode"), F.col("filename").alias("file"))
    b = m.select("msg_id", F.when(F.col("turn") % 2 == 0, "compare").otherwise("review").alias("mode"), F.when(F.col("turn") % 3 != 0, F.col("filename")).alias("file"))
    return memory.disagreements(a, b, "msg_id", ["mode", "file"])


def _amounts_of(version: str) -> str:
    """SQL of the amounts found in the lines of one version."""
    return amounts_sql(f"(select doc_id, 0 as idx, unnest(string_split(text, chr(10))) as text from versions where ver = '{version}')")


@query(f"select distinct doc_id, kind, anchor from ({_amounts_of('v2')}) n where not exists (select 1 from ({_amounts_of('v1')}) o where o.doc_id = n.doc_id and o.kind = n.kind and o.anchor = n.anchor)")
def introduced_findings(spark, sf_dir):
    p = pairs(spark, sf_dir)
    of = lambda c: checks.amounts(blocks(p.select("doc_id", F.col(c).alias("text"))))
    return memory.introduced(of("old"), of("new"))


@query("select c_custkey, c_name as opened, c_name as with_older_key, cast(null as varchar) as with_wrong_key, concat('run-', left(sha256(concat(cast(c_custkey as varchar), '|a@x.example')), 40)) as id, concat(c_name, ' ? x') as header from customer")
def sealed_names(spark, sf_dir):
    new, old = F.lit("0123456789abcdef0123456789abcdef"), F.lit("fedcba9876543210")
    customer, name = base(spark, sf_dir, "customer"), F.col("c_name").cast("binary")
    opened = lambda seal, *keys: secure.unsealed(secure.sealed(name, seal), *keys).cast("string")
    return customer.select("c_custkey", opened(new, new).alias("opened"), opened(old, new, old).alias("with_older_key"), opened(old, new).alias("with_wrong_key"), secure.instance_id(F.col("c_custkey").cast("string"), F.lit("A@x.example")).alias("id"), secure.ascii_header(F.concat("c_name", F.lit(" é\r\nx"))).alias("header"))
