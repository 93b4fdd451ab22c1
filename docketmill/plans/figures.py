"""Queries over amounts, tables, deadlines and timelines."""

from __future__ import annotations

from pyspark.sql import functions as F

from docketmill.operators import deadlines, money
from docketmill.plans.documents import DATES, deed_lines, lines
from docketmill.plans.registry import query
from docketmill.plans.views import view

MONEY = r"(USD|GBP|EUR|US\$|£|€|\$)\s?([0-9][0-9,]*(?:\.[0-9]+)?)(?: ?(thousand|million|billion|k|m|bn)\b)?"
MONIES = rf"""m0 as (select doc_id, idx, regexp_extract_all(text, '{MONEY}', 1) as c, regexp_extract_all(text, '{MONEY}', 2) as n from blocks),
 m as (select doc_id, idx, cast(i - 1 as int) as at, 'money' as kind, case when c[i] in ('USD', 'US$', '$') then 'USD' when c[i] in ('GBP', '£') then 'GBP' else 'EUR' end as currency, cast(replace(n[i], ',', '') as decimal(18,2)) as value from m0, unnest(range(1, len(c) + 1)) as t(i))"""


@query(f"with {MONIES} select * from m")
def money_amounts(spark, sf_dir):
    return money.amounts(lines(spark, sf_dir))


@query(f"with {MONIES} select doc_id, currency, string_agg(distinct cast(value as varchar), ', ' order by value) as values from m group by 1, 2 having count(distinct value) > 1".replace("string_agg(distinct cast(value as varchar), ', ' order by value)", "array_to_string(list_sort(list(distinct value)), ', ')"))
def restated_amounts(spark, sf_dir):
    return money.restated(lines(spark, sf_dir))


SUMS = "s as (select doc_id, count(case when label <> 'Total' then 1 end) as items, cast(sum(case when label <> 'Total' then amount end) as decimal(18,2)) as summed, max(case when label = 'Total' then amount end) as stated from cells group by doc_id)"


@query(f"with {SUMS} select * from s where stated is not null and items >= 2")
def table_sums(spark, sf_dir):
    return money.column_sums(view(spark, sf_dir, "cells"))


@query(f"with {SUMS} select *, cast(stated - summed as decimal(18,2)) as off from s where stated is not null and items >= 2 and abs(stated - summed) > items * 0.01 + 1e-9")
def check_table_totals(spark, sf_dir):
    return money.wrong_totals(view(spark, sf_dir, "cells"))


@query("select doc_id, max(case when row_no = 1 then amount end) as row_1, max(case when row_no = 2 then amount end) as row_2, max(case when row_no = 999 then amount end) as row_999 from cells group by doc_id")
def table_grid(spark, sf_dir):
    return money.grid(view(spark, sf_dir, "cells"), [1, 2, 999])


@query("""with i as (select doc_id, case when row_no = 999 then 0 else row_no end as idx, case when row_no = 999 then 'lead' else 'item' end as kind, amount as value from cells)
 select doc_id, min(case when kind = 'lead' then idx end) as at, max(case when kind = 'lead' then value end) as expected, count(case when kind = 'item' then 1 end) as items, cast(sum(case when kind = 'item' then value end) as decimal(18,2)) as summed from i group by doc_id having count(case when kind = 'item' then 1 end) >= 2 and max(case when kind = 'lead' then value end) <> sum(case when kind = 'item' then value end)""")
def check_split_sums(spark, sf_dir):
    total = F.col("row_no") == 999
    items = view(spark, sf_dir, "cells").select("doc_id", F.when(total, 0).otherwise(F.col("row_no")).alias("idx"), F.when(total, "lead").otherwise("item").alias("kind"), F.col("amount").alias("value"))
    return money.splits(items)


@query("select doc_id, row_no, amount as value, -amount as negative from cells")
def cell_values(spark, sf_dir):
    shown = F.format_number("amount", 2)
    return view(spark, sf_dir, "cells").select("doc_id", "row_no", money.cell_value(F.concat(F.lit("$"), shown)).alias("value"), money.cell_value(F.concat(F.lit("("), shown, F.lit(")"))).alias("negative"))


@query("select doc_id, row_no, concat('USD ', format('{:,.2f}', cast(amount as double))) as shown from cells")
def amounts_shown(spark, sf_dir):
    return view(spark, sf_dir, "cells").select("doc_id", "row_no", money.shown(F.col("amount"), F.lit("USD")).alias("shown"))


@query(f"""with {MONIES}, {SUMS}, l as (select doc_id, string_agg(concat(currency, ' ', cast(value as varchar)), '; ' order by idx, at) as amounts, count(*) as n from m group by doc_id), t as (select *, cast(stated - summed as decimal(18,2)) as off from s where stated is not null and items >= 2)
 select coalesce(l.doc_id, t.doc_id) as doc_id, coalesce(amounts, '') as amounts, coalesce(n, 0) as n, items, summed, stated, off from l full outer join t on t.doc_id = l.doc_id""".replace("order by idx, at)", "order by idx, m.at)"))
def nested_amounts(spark, sf_dir):
    """Amounts and tables of each document as one row of nested data, shown flat."""
    found = money.nested(money.amounts(lines(spark, sf_dir)), money.column_sums(view(spark, sf_dir, "cells")))
    shown = F.array_join(F.transform("amounts", lambda x: F.concat_ws(" ", x["currency"], x["value"].cast("string"))), "; ")
    return found.select("doc_id", shown.alias("amounts"), F.size("amounts").cast("bigint").alias("n"), "table.items", "table.summed", "table.stated", "table.off")


PERIOD, AFTER = deadlines.PERIOD, deadlines.AFTER
LO, HI = (f"cast(case u when 'day' then n when 'week' then n * 7 when 'month' then n * {m} when 'year' then n * {y} end as double)" for m, y in ((28, 365), (31, 366)))
PERIODS = rf"""p0 as (select doc_id, idx, regexp_extract_all(text, '{PERIOD}', 2) as a, regexp_extract_all(text, '{PERIOD}', 3) as b from blocks),
 p1 as (select doc_id, idx, cast(i - 1 as int) as at, cast(a[i] as int) as n, regexp_replace(b[i], 's$', '') as u from p0, unnest(range(1, len(a) + 1)) as t(i)), p as (select p1.* exclude (u), u as unit, {LO} as lo, {HI} as hi from p1)"""
ANCHORED = rf"""a0 as (select doc_id, idx, regexp_extract_all(text, '{AFTER}', 1) as a, regexp_extract_all(text, '{AFTER}', 2) as b, regexp_extract_all(text, '{AFTER}', 3) as h, regexp_extract_all(text, '{AFTER}', 4) as c from blocks),
 a1 as (select doc_id, idx, cast(a[i] as int) as n, regexp_replace(b[i], 's$', '') as u, h[i] <> 'after' as inclusive, c[i] as anchor from a0, unnest(range(1, len(a) + 1)) as t(i)), a as (select doc_id, idx, n, u as unit, inclusive, anchor, {LO} as lo, {HI} as hi from a1)"""


@query(f"with {PERIODS} select * from p")
def periods_in_days(spark, sf_dir):
    return deadlines.periods(lines(spark, sf_dir))


@query(f"with {ANCHORED} select * from a")
def anchored_periods(spark, sf_dir):
    return deadlines.anchored(lines(spark, sf_dir))


def due_sql(lines: str) -> str:
    """SQL of days due; DuckDB's months end on a month's last day, too."""
    return f"""with {ANCHORED.replace("from blocks", f"from {lines}")}, d as (select doc_id, regexp_extract(text, '"([^"]+)" means', 1) as term, min(cast(strptime(regexp_extract(text, '\\d+ [A-Z][a-z]+ \\d{{4}}'), '%-d %B %Y') as date)) as day from {lines} where regexp_matches(text, '"[^"]+" means \\d') group by 1, 2)
 select a.doc_id, a.idx, a.anchor, cast(case a.unit when 'day' then d.day + to_days(cast(a.n as int)) when 'week' then d.day + to_days(cast(7 * a.n as int)) when 'month' then d.day + to_months(cast(a.n as int)) else d.day + to_months(cast(12 * a.n as int)) end as date) - case when a.inclusive then 1 else 0 end as day from a join d on d.doc_id = a.doc_id and d.term = a.anchor"""


@query(due_sql("blocks"))
def days_due(spark, sf_dir):
    return deadlines.due(lines(spark, sf_dir))


@query(due_sql("deed_lines"))
def months_due(spark, sf_dir):
    """Days due over deeds, whose periods are in months, too, and whose dates lie at the ends of months."""
    return deadlines.due(deed_lines(spark, sf_dir))


def _kind(before: str, after: str) -> str:
    last, first = f"regexp_extract(lower({before}), '{deadlines.LAST_CUE}', 1)", f"regexp_extract(lower({after}), '{deadlines.FIRST_CUE}', 2)"
    behind, ahead = f"length({before}) - length(regexp_extract(lower({before}), '{deadlines.LAST_CUE}'))", f"length(regexp_extract(lower({after}), '{deadlines.FIRST_CUE}', 1))"
    told = " ".join(f"when cue in ({', '.join(repr(w) for w in ws)}) then '{k}'" for k, ws in deadlines.CUES.items())
    return f"(select case {told} end from (select case when {last} <> '' and ({first} = '' or {behind} <= {ahead}) then {last} else {first} end as cue))"


@query(rf"""with m as (select doc_id, idx, string_split(regexp_replace(text, '{PERIOD}', chr(1) || '\2 \3' || chr(1), 'g'), chr(1)) as p from deed_lines where regexp_matches(text, '{PERIOD}')),
 e as (select doc_id, idx, p[2 * k - 1] as b, p[2 * k] as period, p[2 * k + 1] as a from m, unnest(range(1, (len(p) - 1) // 2 + 1)) as t(k)),
 o as (select *, regexp_extract(b, '{deadlines.OWN_SENTENCE[0]}') as ob, regexp_extract(a, '{deadlines.OWN_SENTENCE[1]}') as oa from e)
 select doc_id, idx, coalesce({_kind('ob', 'oa')}, {_kind('b', 'a')}, 'period') as kind, cast(split_part(period, ' ', 1) as int) as n, regexp_replace(split_part(period, ' ', 2), 's$', '') as unit from o""")
def kinds_of_periods(spark, sf_dir):
    return deadlines.classified(deed_lines(spark, sf_dir))


TABLE = f"""{DATES}, {PERIODS}, tab as (select doc_id, idx, 'date' as kind, anchor as what, day, cast(null as double) as lo, cast(null as double) as hi from dates union all select doc_id, idx, 'period', concat(cast(n as varchar), ' ', unit), null, lo, hi from p)"""


@query(f"with {TABLE} select * from tab")
def deadline_table(spark, sf_dir):
    return deadlines.table(lines(spark, sf_dir))


@query(f"""with {TABLE}, r as (select doc_id, what, row_number() over (partition by doc_id order by idx, kind, what) as place, count(*) over (partition by doc_id) as n from tab) select doc_id, cast(place as int) as place, what, greatest(n - 4, 0) as left_out from r where n >= 2 and place <= 4""")
def deadline_section(spark, sf_dir):
    return deadlines.section(deadlines.table(lines(spark, sf_dir)), 4)


@query(f"with {PERIODS} select doc_id, case when count(distinct (lo, hi)) = 1 then min(lo) end as lo from p group by doc_id")
def one_length(spark, sf_dir):
    return deadlines.only_length(deadlines.periods(lines(spark, sf_dir)))


@query(f"with {DATES}, n as (select *, lead(idx) over w as later_idx, lead(day) over w as next_day from dates window w as (partition by doc_id order by idx, anchor)) select doc_id, idx as earlier_idx, later_idx, day - next_day as days from n where next_day < day")
def dates_out_of_order(spark, sf_dir):
    return deadlines.out_of_order(lines(spark, sf_dir))


@query(f"with {DATES} select doc_id, row_number() over (partition by doc_id order by day, idx, anchor) as place, day, anchor as what from dates")
def dated_timeline(spark, sf_dir):
    return deadlines.timeline(lines(spark, sf_dir))


@query(f"""with vlines as (select doc_id, cast(i - 1 as int) as idx, p[i] as text from (select doc_id, string_split(text, chr(10)) as p from versions), unnest(range(1, len(p) + 1)) as t(i)), {ANCHORED.replace("from blocks", "from vlines")}
 select x.doc_id, x.anchor, count(*) as n from a x join a y on x.doc_id = y.doc_id and x.anchor = y.anchor and x.hi < y.lo group by 1, 2""")
def check_period_stated_twice(spark, sf_dir):
    """Two versions of a document side by side: a period that one of them changed is stated twice."""
    v = view(spark, sf_dir, "versions").select("doc_id", "text")
    from docketmill.operators.structure import blocks

    return deadlines.stated_twice(blocks(v))


@query(f"with {DATES} select doc_id, left(sha256(concat_ws('|', cast(doc_id as varchar), cast(idx as varchar), anchor)), 32) as uid, day, concat('Line ', cast(idx as varchar), ': ', anchor) as summary from dates")
def calendar_events(spark, sf_dir):
    return deadlines.calendar(lines(spark, sf_dir))


CRLF = "chr(13) || chr(10)"


@query(f"""with {DATES}, e as (select doc_id, day, left(sha256(concat_ws('|', cast(doc_id as varchar), cast(idx as varchar), anchor)), 32) as uid, replace(concat('Line ', cast(idx as varchar), ': ', anchor), ',', '\\,') as summary from dates),
 v as (select doc_id, day, uid, concat_ws({CRLF}, 'BEGIN:VEVENT', 'UID:' || uid, 'DTSTART;VALUE=DATE:' || strftime(day, '%Y%m%d'), 'SUMMARY:' || summary, 'BEGIN:VALARM', 'TRIGGER:-P7D', 'ACTION:DISPLAY', 'END:VALARM', 'END:VEVENT') as event from e)
 select doc_id, concat_ws({CRLF}, 'BEGIN:VCALENDAR', 'VERSION:2.0', 'PRODID:-//docketmill//deadlines//EN', string_agg(event, {CRLF} order by day, uid, event), 'END:VCALENDAR', '') as ics from v group by doc_id""")
def calendar_files(spark, sf_dir):
    return deadlines.calendar_file(deadlines.calendar(lines(spark, sf_dir)))


@query("select event_id, cast(date_trunc('month', ts) - interval 1 month as date) as first_day, cast(date_trunc('month', ts) - interval 1 day as date) as last_day from events")
def asked_periods(spark, sf_dir):
    from docketmill.plans.views import base

    first, last = deadlines.asked_period(F.lit("everything from last month"), F.to_date("ts"))
    return base(spark, sf_dir, "events").select("event_id", first.alias("first_day"), last.alias("last_day"))
