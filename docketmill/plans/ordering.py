"""Queries over the order of events."""

from __future__ import annotations

from pyspark.sql import functions as F

from docketmill.operators import checks, ordering
from docketmill.operators.structure import blocks
from docketmill.plans.documents import PARTED, forms, sql
from docketmill.plans.figures import _kind
from docketmill.plans.registry import query
from docketmill.plans.views import view

Q = {k: sql(getattr(ordering, k)) for k in ("SIGNED", "MEANT", "DISTANCE", "LENGTH", "BEFORE_END", "STOP")}
LEAST, MOST = (f"cast(case regexp_replace({{u}}, 's$', '') when 'day' then {{n}} when 'week' then 7 * {{n}} when 'month' then {m} * {{n}} else {y} * {{n}} end as int)" for m, y in ((28, 365), (31, 366)))
DAY = lambda x: f"cast(cast(strptime({x}, '%-d %B %Y') as date) - date '1970-01-01' as int)"


def _all(pattern: str, *names: str) -> str:
    return ", ".join(f"unnest(regexp_extract_all(text, '{Q[pattern]}', {i + 1})) as {n}" for i, n in enumerate(names))


BOUNDS = f"""{forms("time_lines")}, far as (select doc_id, term as event, regexp_extract(meaning, '{Q["MEANT"]}', 4) as anchor, regexp_extract(meaning, '{Q["MEANT"]}', 3) as way, cast(regexp_extract(meaning, '{Q["MEANT"]}', 1) as int) as n, regexp_extract(meaning, '{Q["MEANT"]}', 2) as u from defs where regexp_matches(meaning, '{Q["MEANT"]}')),
 known as (select doc_id, 'signing' as event, {DAY("arg_min(d, idx)")} as lo, {DAY("arg_min(d, idx)")} as hi from (select doc_id, idx, {_all("SIGNED", "d")} from time_lines) group by doc_id
  union all select doc_id, term, {DAY(f"regexp_extract(meaning, '^{checks.DAY_FIRST[2:]}')")}, {DAY(f"regexp_extract(meaning, '^{checks.DAY_FIRST[2:]}')")} from defs where regexp_matches(meaning, '^{checks.DAY_FIRST[2:]}')),
 walked(doc_id, event, lo, hi) as (select * from known union all select f.doc_id, f.event, w.lo + case when way = 'after' then {LEAST.format(u="u", n="n")} else -{MOST.format(u="u", n="n")} end, w.hi + case when way = 'after' then {MOST.format(u="u", n="n")} else -{LEAST.format(u="u", n="n")} end from walked w join far f on f.doc_id = w.doc_id and f.anchor = w.event),
 bounds as (select doc_id, event, max(lo) as lo, min(hi) as hi from walked group by doc_id, event)"""


def lines(spark, sf_dir):
    return blocks(view(spark, sf_dir, "times"))


@query(f"with recursive {BOUNDS} select doc_id, event, date '1970-01-01' + lo as first_day, date '1970-01-01' + hi as last_day from bounds")
def days_of_events(spark, sf_dir):
    """The first and the last day that a document's dates and distances allow each of its events."""
    bounds = ordering.tightened(*ordering.stated(lines(spark, sf_dir)))
    return bounds.select("doc_id", "event", F.date_from_unix_date("lo").alias("first_day"), F.date_from_unix_date("hi").alias("last_day"))


P = PARTED.replace("from blocks", "from time_lines").split(", q0 as (")[0]


@query(f"""with recursive {BOUNDS}, {P}, fit as (select *, regexp_matches(event, '{Q["STOP"]}') as stop from bounds where lo <= hi), signed as (select doc_id, lo as signed from fit where event = 'signing'),
 d0 as (select doc_id, regexp_extract(text, '^(.*?){Q["DISTANCE"]}', 1) as b, {_all("DISTANCE", "n", "unit", "way", "anchor")} from time_lines where regexp_matches(text, '{Q["DISTANCE"]}')),
 d as (select doc_id, {_kind("b", "''")} as kind, anchor, concat(n, ' ', unit) as said, {LEAST.format(u="unit", n="cast(n as int)")} as lo, {MOST.format(u="unit", n="cast(n as int)")} as hi from d0 where way = 'after'),
 e0 as (select doc_id, idx, 'remedy' as kind, unnest(regexp_extract_all(text, 'cured within (\\d+ [a-z]+)', 1)) as said from time_lines union all select doc_id, idx, 'ending', unnest(regexp_extract_all(text, 'terminate on (\\d+ [a-z]+) notice', 1)) from time_lines),
 e as (select e0.doc_id, kind, clause, regexp_replace(said, 's$', '') as said, {LEAST.format(u="split_part(said, ' ', 2)", n="cast(split_part(said, ' ', 1) as int)")} as lo, {MOST.format(u="split_part(said, ' ', 2)", n="cast(split_part(said, ' ', 1) as int)")} as hi from e0 join c on c.doc_id = e0.doc_id and c.idx = e0.idx),
 t as (select doc_id, idx, name, concat(n, ' ', unit) as said, {LEAST.format(u="unit", n="cast(n as int)")} as lo, {MOST.format(u="unit", n="cast(n as int)")} as hi from (select doc_id, idx, {_all("LENGTH", "name", "n", "unit")} from time_lines)),
 b as (select doc_id, name, concat(n, ' ', unit) as said, {LEAST.format(u="unit", n="cast(n as int)")} as lo from (select doc_id, {_all("BEFORE_END", "n", "unit", "name")} from time_lines))
 select doc_id, 'no day fits' as kind, 1 as severity, event as what, '' as other from bounds where lo > hi
 union all select x.doc_id, 'stop before event', 1, x.event, arg_min(s.event, (s.hi, s.event)) from fit x join fit s on s.doc_id = x.doc_id and s.stop and s.hi < x.lo where not x.stop and x.event <> 'signing' group by x.doc_id, x.event
 union all select doc_id, case when stop then 'stop before signing' else 'event before signing' end, case when stop then 1 else 2 end, event, 'signing' from fit join signed using (doc_id) where event <> 'signing' and hi < signed
 union all select x.doc_id, 'claims end before release', 2, x.said, arg_max(h.said, (h.lo, h.said)) from (select distinct doc_id, anchor, said, hi from d where kind = 'claim') x join d h on h.doc_id = x.doc_id and h.anchor = x.anchor and h.kind = 'holdback' and x.hi < h.lo group by x.doc_id, x.anchor, x.said
 union all select x.doc_id, 'remedy outlasts notice', 2, x.said, arg_min(y.said, (y.hi, y.said)) from (select distinct doc_id, clause, said, lo from e where kind = 'remedy') x join e y on y.doc_id = x.doc_id and y.clause = x.clause and y.kind = 'ending' and x.lo > y.hi group by x.doc_id, x.clause, x.said
 union all select distinct y.doc_id, 'term stated twice', 2, concat(y.name, ' ', y.said), x.said from t x join t y on y.doc_id = x.doc_id and y.name = x.name and y.idx > x.idx and (x.lo > y.hi or y.lo > x.hi) where x.idx = (select min(idx) from t z where z.doc_id = x.doc_id and z.name = x.name)
 union all select distinct b.doc_id, 'notice longer than term', 1, b.said, concat(b.name, ' ', o.said) from b join (select doc_id, name, max(hi) as hi, min(said) as said from t group by doc_id, name having count(distinct (lo, hi)) = 1) o on o.doc_id = b.doc_id and o.name = b.name where b.lo > o.hi""")
def time_contradictions(spark, sf_dir):
    """What of the times of each document can't be on any reading."""
    return ordering.contradictions(blocks(view(spark, sf_dir, "times", in_order=True)), together=True)
