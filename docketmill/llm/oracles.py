"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

from docketmill.llm import quality

_FLOOR = " ".join(f"when '{r}' then {s}" for r, s in quality.RATES.items())
QUALITY = rf"""with d as (select row_number() over () as rid, doc_id, lang, source, coalesce(text, '') as t from documents),
 w as (select *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as ls from d),
 wi as (select rid, i, array_to_string(ws[i:i + {quality.WINDOW - 1}], ' ') as g from w, unnest(range(1, len(ws) - {quality.WINDOW - 2})) as t(i)),
 tw as (select rid, i from wi qualify count(*) over (partition by rid, g) > 1),
 rp as (select rid, count(distinct i + k) as n from tw, unnest(range(0, {quality.WINDOW})) as t(k) group by rid),
 c as (select w.rid, doc_id, lang, source, len(ws) as n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) as word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) as n_symbols, len(ls) as n_lines, len(ls) - len(list_distinct(ls)) as n_dup_lines, coalesce(rp.n, 0) as n_repeat_words from w left join rp on rp.rid = w.rid),
 x as (select rid, lang, source, 'word_length' as rate, word_chars / greatest(n_words, 1) as v from c union all select rid, lang, source, 'symbol_rate', n_symbols / greatest(n_words, 1) from c union all select rid, lang, source, 'dup_line_rate', n_dup_lines / greatest(n_lines, 1) from c union all select rid, lang, source, 'repeat_rate', n_repeat_words / greatest(n_words, 1) from c),
 sk as (select lang, source, rate, case when v <= 1e-4 then 0 else cast(ceil(ln(v) / ln({quality.GAMMA})) + 1000 as int) end as bin, count(*) as n from x group by all),
 lv as (select 0 as lv, lang, source, rate, bin, n from sk union all select 1, lang, null, rate, bin, sum(n) from sk group by lang, rate, bin union all select 2, null, null, rate, bin, sum(n) from sk group by rate, bin),
 cu as (select *, sum(n) over (partition by lv, lang, source, rate order by bin) as upto, sum(n) over (partition by lv, lang, source, rate) as al, case when bin = 0 then 0.0 else pow({quality.GAMMA}, bin - 1000.5) end as mid from lv),
 q as (select lv, lang, source, rate, max(al) as al, min(case when upto >= al * 0.25 then mid end) as q0, min(case when upto >= al * 0.75 then mid end) as q1 from cu group by all),
 f as (select *, q0 - {quality.FENCE} * greatest(q1 - q0, case rate {_FLOOR} end) as low, q1 + {quality.FENCE} * greatest(q1 - q0, case rate {_FLOOR} end) as high from q),
 k as (select x.rid, bool_and(case when a.al >= {quality.LEAST_GROUP} then v between a.low and a.high when b.al >= {quality.LEAST_GROUP} then v between b.low and b.high else v between e.low and e.high end) as inside from x join f a on a.lv = 0 and a.lang is not distinct from x.lang and a.source is not distinct from x.source and a.rate = x.rate
  join f b on b.lv = 1 and b.lang is not distinct from x.lang and b.rate = x.rate join f e on e.lv = 2 and e.rate = x.rate group by x.rid)
 select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed, not (n_words < 20 or 100 * n_repeat_words > 30 * n_words) and inside as kept, n_lines from c join k on k.rid = c.rid"""

EXACT = r"""with d as (select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as t from documents)
 select doc_id, min(doc_id) over g as keep_id, count(*) over g as group_size, doc_id = min(doc_id) over g as kept, sha256(t) as text_sha256 from d window g as (partition by t)"""

SEARCH = r"""with d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as ts from documents),
 q as (select item_id, t, count(*) as qn from (select item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as t from benchmark) group by all),
 a as (select cast(sum(case when len(ts) > 0 then 1 else 0 end) as bigint) as nn, cast(sum(len(ts)) as bigint) as ll from d),
 p as (select doc_id, t, count(*) as tf, any_value(n) as n from (select doc_id, len(ts) as n, unnest(ts) as t from d) where t in (select t from q) group by doc_id, t),
 f as (select t, cast(floor(1000 * ln(cast(2 * nn + 2 as double) / cast(2 * count(*) + 1 as double))) as bigint) as w from p, a group by t, nn),
 s as (select item_id, doc_id, cast(sum(w * qn * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * nn) // ll)))) as bigint) as score from q join f using (t) join p using (t), a group by item_id, doc_id)
 select item_id, cast(row_number() over (partition by item_id order by score desc, doc_id) as int) as rank, doc_id, score from s where score > 0 qualify rank <= 10"""


def _centroids(rounds: int = 5, centres: int = 40, size: int = 64) -> str:
    """Each round's centres and assignment is a table of its own; SQL has no loop for an aggregate."""
    near = "select v.vec_id, q, (select min_by(c, list_sum(list_transform(list_zip(q, p), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) * 1000 + c) from c{i}) as c from v"
    steps = [
        f"v as materialized (select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as q from embeddings where len(embedding) = {size} and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = {size})",
        f"c0 as materialized (select cast(row_number() over (order by sha256('2:' || vec_id)) - 1 as bigint) as c, q as p from v order by sha256('2:' || vec_id) limit {centres})",
    ]
    for i in range(rounds + 1):
        steps.append(f"a{i} as materialized ({near.format(i=i)})")
        if i < rounds:
            steps.append(f"m{i} as (select c, list(m order by k) as p from (select c, k, (sum(x)::bigint - ((sum(x)::bigint % count(*)) + count(*)) % count(*)) // count(*) as m from (select c, unnest(q) as x, unnest(range({size})) as k from a{i}) group by c, k) group by c)")
            steps.append(f"c{i + 1} as materialized (select c{i}.c, coalesce(m{i}.p, c{i}.p) as p from c{i} left join m{i} on m{i}.c = c{i}.c)")
    steps.append(f"r as (select vec_id, a{rounds}.c, cast(list_sum(list_transform(list_zip(q, p), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) as bigint) as distance, p from a{rounds} join c{rounds} on a{rounds}.c = c{rounds}.c)")
    return "with " + ", ".join(steps) + " select vec_id, cast(c as int) as cluster, distance, cast(sum(distance) over (partition by c) as bigint) as cluster_inertia, cast(sum(distance) over () as bigint) as inertia, sha256(array_to_string(p, ',')) as centroid_sha256 from r"


ORACLES = {"op8_quality": QUALITY, "op11_centroids": _centroids(), "op12_search": SEARCH, "op13_exact": EXACT}
