"""Queries over documents: structure and checks of agreements."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketmill.functions.text import NUMBER, NUMBERS, SCALES
from docketmill.operators import checks, structure
from docketmill.plans.registry import ORACLES, query
from docketmill.plans.views import base, view
from docketmill.tables import written

MONTH = checks.MONTH
#: Shared by the oracles: lines with the number that they begin, their part and the clause in force.
PARTED = r"""parted as (select *, last_value(nullif(regexp_extract(text, '^(Schedule \d+)\b', 1), '') ignore nulls) over (partition by doc_id order by idx) as part, try_cast(nullif(regexp_extract(text, '^(\d+)\.\s', 1), '') as int) as num from blocks),
 c as (select *, last_value(num ignore nulls) over (partition by doc_id, part order by idx) as clause from parted),
"""


def sql(pattern: str) -> str:
    """A pattern within SQL's quotes."""
    return pattern.replace("'", "''")


def forms(lines: str = "blocks") -> str:
    """SQL of the terms that lines define: found has the first place of each term of a line."""
    q = {k: sql(getattr(checks, k)) for k in ("QUOTE", "TERM", "SAYS", "ELSEWHERE", "NAMES", "WRITTEN", "HEAD", "MARK", "JOINED")}
    return rf"""q0 as (select doc_id, idx, regexp_split_to_array(text, '{q['QUOTE']}') as p from {lines} where regexp_matches(text, '{q['QUOTE']}')),
 q1 as (select doc_id, idx, k, p[2 * k] as term, case when regexp_matches(p[2 * k - 1], '{q['JOINED']}') and k > 1 then p[2 * k - 3] else p[2 * k - 1] end as b, case when regexp_matches(p[2 * k + 1], '{q['JOINED']}') and len(p) >= 2 * k + 3 then p[2 * k + 3] else p[2 * k + 1] end as a from q0, unnest(range(1, (len(p) - 1) // 2 + 1)) as t(k)),
 q2 as (select *, case when regexp_matches(a, '{q['ELSEWHERE']}') then 1 when regexp_matches(a, '{q['SAYS']}') then 2 when regexp_matches(b, '{q['NAMES']}') and not regexp_matches(b, '{q['WRITTEN']}') then 3 when regexp_matches(b, '{q['HEAD']}') and regexp_matches(a, '{q['MARK']}') then 4 end as rank from q1 where regexp_matches(term, '{q['TERM']}')),
 found as (select doc_id, idx, term, case when rank = 2 then trim(regexp_extract(a, '{q['SAYS']}\s*([^;]*)', 1)) end as meaning, (['elsewhere', 'stated', 'named', 'headed'])[rank] as how from q2 where rank is not null qualify row_number() over (partition by doc_id, idx, term order by rank, k) = 1),
 defs as (select doc_id, idx, term, meaning from found where how = 'stated'), terms as (select distinct doc_id, term from found)"""


PARTED = f"{PARTED.rstrip().rstrip(',')}, {forms()}"


def agreements(spark: SparkSession, sf_dir: str, *, in_order: bool = False) -> DataFrame:
    return view(spark, sf_dir, "agreements", in_order=in_order)


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.blocks(agreements(spark, sf_dir))


@query("select doc_id, idx, text from blocks")
def document_blocks(spark, sf_dir):
    return lines(spark, sf_dir)


@query(rf"with {PARTED} select doc_id, idx, part, clause from c")
def clause_index(spark, sf_dir):
    return structure.with_clauses(lines(spark, sf_dir)).select("doc_id", "idx", "part", "clause")


@query(rf"""with {PARTED} select doc_id, idx, coalesce(nullif(concat_ws(', ', part, case when clause is not null then concat(case when part is null then 'clause ' else 'paragraph ' end, cast(clause as varchar)) end), ''), 'opening') as label from c""")
def line_labels(spark, sf_dir):
    return structure.labels(lines(spark, sf_dir))


@query(rf"""with {PARTED} select doc_id, idx, case when num = clause then concat('clause ', cast(clause as varchar)) when clause is not null then concat('under clause ', cast(clause as varchar)) end as place from c""")
def line_places(spark, sf_dir):
    return structure.places(lines(spark, sf_dir))


@query(rf"with {PARTED} select distinct doc_id, part, num as number from c where num is not null")
def clause_numbers(spark, sf_dir):
    return structure.numbers(lines(spark, sf_dir))


@query(r"select distinct doc_id, regexp_extract(text, '^(Schedule \d+)\b', 1) as title from blocks where regexp_matches(text, '^Schedule \d+\b')")
def schedule_titles(spark, sf_dir):
    return structure.schedules(lines(spark, sf_dir))


@query(r"""with p as (select doc_id, idx, regexp_extract_all(text, '\b(Section|Clause|Article) (\d+)', 1) as w, regexp_extract_all(text, '\b(Section|Clause|Article) (\d+)', 2) as n from blocks)
 select doc_id, idx, cast(i - 1 as int) as at, w[i] as word, cast(n[i] as int) as number from p, unnest(range(1, len(w) + 1)) as t(i)""")
def clause_pointers(spark, sf_dir):
    return structure.pointers(lines(spark, sf_dir))


@query("select doc_id, 'Section' as word from agreements")
def clause_words(spark, sf_dir):
    return structure.clause_word(lines(spark, sf_dir))


@query("""with r as (select *, sum(length(text) + 1) over (partition by doc_id order by idx) as upto from blocks)
 select doc_id, string_agg(case when upto <= 500 then text end, chr(10) order by idx) as text, min(case when upto > 500 then idx end) as cut_at from r group by doc_id""")
def within_budget(spark, sf_dir):
    return structure.budgeted(lines(spark, sf_dir), 500)


@query(rf"with {PARTED} select doc_id, idx, num as old, cast(row_number() over (partition by doc_id order by idx) as int) as new from c where num is not null and part is null")
def renumbered_clauses(spark, sf_dir):
    return structure.renumbered(lines(spark, sf_dir))


@query(rf"""with {PARTED}, l as (select doc_id, idx, text, coalesce(nullif(concat_ws(', ', part, case when clause is not null then concat(case when part is null then 'clause ' else 'paragraph ' end, cast(clause as varchar)) end), ''), 'opening') as label from c),
 a as (select distinct doc_id, term as anchor from defs) select a.doc_id, a.anchor, arg_min(label, idx) as label from a join l on a.doc_id = l.doc_id and instr(l.text, a.anchor) > 0 group by 1, 2""")
def anchor_labels(spark, sf_dir):
    b = lines(spark, sf_dir)
    return structure.first_place(b, checks.definitions(b).where("how = 'stated'").select("doc_id", F.col("term").alias("anchor")).distinct())


@query(r"""with b as (select *, lag(text) over (partition by doc_id order by idx) as before from blocks),
 r as (select *, sum(case when before is null or trim(before) = '' or regexp_matches(text, '^\d+\.\s') or regexp_matches(text, '^Schedule \d+\b') or regexp_matches(before, '[.:;]\s*$') then 1 else 0 end) over (partition by doc_id order by idx) as run from b)
 select doc_id, min(idx) as idx, string_agg(trim(text), ' ' order by idx) as text from r where trim(text) <> '' group by doc_id, run""")
def rejoined_paragraphs(spark, sf_dir):
    return structure.paragraphs(lines(spark, sf_dir))


def finding(sql: str) -> str:
    return f"with {PARTED} {sql}" if not sql.startswith(",") else f"with {PARTED}{sql}"


BLANKS = r"select doc_id, idx, 'blank' as kind, 1 as severity, unnest(regexp_extract_all(text, '\[[A-Z][A-Z ]*\]|_{3,}|\bTBC\b|\bTBD\b')) as anchor, 'left blank' as note from blocks"


@query(BLANKS)
def check_blanks(spark, sf_dir):
    return checks.blanks(lines(spark, sf_dir))


@query(finding("select doc_id, idx, term, meaning, how from found"))
def defined_terms(spark, sf_dir):
    return checks.definitions(lines(spark, sf_dir))


@query(finding("""select d.doc_id, d.idx, 'unused term' as kind, 3 as severity, d.term as anchor, 'defined but never used' as note from defs d
 where (select count(*) from blocks b where b.doc_id = d.doc_id) >= 12 and not exists (select 1 from blocks b where b.doc_id = d.doc_id and b.idx <> d.idx and instr(b.text, d.term) > 0)"""))
def check_unused_terms(spark, sf_dir):
    return checks.unused_terms(lines(spark, sf_dir))


@query(finding(""", h as (select d.doc_id, d.term, min(coalesce(c.clause, 0)) as home from defs d join c on c.doc_id = d.doc_id and c.idx = d.idx group by 1, 2)
 select h.doc_id, min(c.idx) as idx, 'early term' as kind, 2 as severity, h.term as anchor, concat('defined only in clause ', cast(min(h.home) as varchar)) as note
 from h join c on c.doc_id = h.doc_id and instr(c.text, h.term) > 0 and coalesce(c.clause, 0) + 1 <= h.home group by h.doc_id, h.term"""))
def check_early_terms(spark, sf_dir):
    moved = agreements(spark, sf_dir)
    return checks.early_terms(structure.blocks(moved), gap=1)


@query(finding(""", s as (select *, row_number() over (partition by doc_id, term order by idx) as n, first_value(meaning) over (partition by doc_id, term order by idx) as first from defs)
 select doc_id, idx, 'repeated definition' as kind, case when lower(trim(meaning)) = lower(trim(first)) then 3 else 1 end as severity, term as anchor, case when lower(trim(meaning)) = lower(trim(first)) then 'defined twice alike' else 'defined twice differently' end as note from s where n > 1"""))
def check_repeated_definitions(spark, sf_dir):
    return checks.repeated_definitions(lines(spark, sf_dir))


@query(finding(r""", p as (select doc_id, idx, unnest(regexp_extract_all(text, '\b[Tt]he ([A-Z][a-z]+(?: [A-Z][a-z]+){1,3})', 1)) as phrase from blocks),
 o as (select doc_id, phrase, count(*) as n, min(idx) as idx from p group by 1, 2 having count(*) >= 2),
 k as (select *, row_number() over (partition by doc_id order by idx, phrase) as r from o where not exists (select 1 from terms t where t.doc_id = o.doc_id and t.term = o.phrase))
 select doc_id, idx, 'undefined term' as kind, 2 as severity, phrase as anchor, concat('used ', cast(n as varchar), ' times') as note from k where r <= 5"""))
def check_undefined_terms(spark, sf_dir):
    return checks.undefined_terms(lines(spark, sf_dir))


@query(finding(r""", w as (select doc_id, idx, unnest(regexp_extract_all(text, '\b[A-Z][a-z]{3,}\b')) as word from blocks), r as (select doc_id, word, min(idx) as idx from w group by 1, 2 having count(*) = 1),
 one as (select doc_id, term from terms where not contains(term, ' '))
 select r.doc_id, r.idx, 'misspelt term' as kind, 2 as severity, word as anchor, concat('for ', term) as note from r join one t on t.doc_id = r.doc_id and levenshtein(word, term) = 1 and concat(term, 's') <> word and concat(word, 's') <> term
 where not exists (select 1 from one o where o.doc_id = r.doc_id and o.term = r.word)"""))
def check_misspelt_terms(spark, sf_dir):
    return checks.misspelt_terms(structure.blocks(agreements(spark, sf_dir, in_order=True)), together=True)


SPACED = "concat(' ', regexp_replace({x}, '[^A-Za-z0-9''’-]+', ' ', 'g'), ' ')"


@query(finding(f""", low as (select doc_id, lower(term) as low, min(term) as term, list(idx) as places from found where contains(term, ' ') group by 1, 2)
 select b.doc_id, b.idx, 'lower-case term' as kind, 3 as severity, low as anchor, concat('for ', term) as note from blocks b join low on low.doc_id = b.doc_id where contains(b.text, low) and not list_contains(places, b.idx) and contains({SPACED.format(x='b.text')}, {SPACED.format(x='low')})"""))
def check_lower_case_terms(spark, sf_dir):
    return checks.lower_case_terms(lines(spark, sf_dir))


REFERENCES = finding(r""", p0 as (select doc_id, idx, regexp_extract_all(text, '\b(Section|Clause|Article) (\d+)', 1) as w, regexp_extract_all(text, '\b(Section|Clause|Article) (\d+)', 2) as n from blocks),
 p as (select doc_id, idx, i as pos, w[i] as word, cast(n[i] as int) as number from p0, unnest(range(1, len(w) + 1)) as t(i)),
 there as (select distinct doc_id, num from c where num is not null and part is null),
 near as (select p.doc_id, p.idx, p.pos, p.word, p.number, t.num, row_number() over (partition by p.doc_id, p.idx, p.pos order by abs(t.num - p.number), t.num) as r from p join there t on t.doc_id = p.doc_id where not exists (select 1 from there x where x.doc_id = p.doc_id and x.num = p.number)),
 named as (select distinct doc_id, idx, unnest(regexp_extract_all(text, '\bSchedule \d+\b')) as title from blocks where not regexp_matches(text, '^Schedule \d+\b')),
 titles as (select doc_id, regexp_extract(text, '^(Schedule \d+)\b', 1) as title from blocks)
 select doc_id, idx, 'broken reference' as kind, 1 as severity, concat(word, ' ', cast(number as varchar)) as anchor, concat('there are ', string_agg(cast(num as varchar), ', ' order by r)) as note from near where r <= 3 group by doc_id, idx, pos, word, number
 union all select doc_id, idx, 'broken reference', 1, title, 'no such schedule' from named n where not exists (select 1 from titles t where t.doc_id = n.doc_id and t.title = n.title)""")


@query(REFERENCES)
def check_references(spark, sf_dir):
    return checks.broken_references(lines(spark, sf_dir))


@query(finding(""", n as (select doc_id, part, idx, num, lag(num) over (partition by doc_id, part order by num, idx) as before from c where num is not null)
 select doc_id, idx, 'numbering' as kind, 2 as severity, cast(num as varchar) as anchor, 'number used twice' as note from n where num = before
 union all select doc_id, idx, 'numbering', 3, cast(num as varchar), concat('no ', array_to_string(range(before + 1, num), ', ')) from n where num > before + 1"""))
def check_numbering(spark, sf_dir):
    return checks.numbering(lines(spark, sf_dir))


def value_sql(words: str) -> str:
    """The value of a number in words by SQL: what stands before each scale is a number below a thousand; null for words in
    a row that are no number."""
    table = "map {" + ", ".join(f"'{w}': {n}" for w, n in NUMBERS.items() if "-" not in w) + "}"
    named = f"regexp_replace(regexp_replace(concat(lower(trim({words})), ' '), '[\\s-]+', ' ', 'g'), '\\band ', '', 'g')"
    plain = lambda x: f"coalesce(list_sum(list_transform(list_filter(string_split({x}, ' '), lambda w: w not in ('', 'hundred')), lambda w: {table}[w])), 0)"
    before = lambda x: f"regexp_extract({x}, '^(.*)hundred', 1)"
    below = lambda x: f"(case when contains({x}, 'hundred') then 100 * greatest({plain(before(x))}, 1) + {plain(f'regexp_replace({x}, {chr(39)}^.*hundred{chr(39)}, {chr(39)}{chr(39)})')} else {plain(x)} end)"
    out, rest = [], named
    for scale, size in SCALES.items():
        out.append(f"(case when contains({rest}, '{scale}') then {size} * greatest({below(f'regexp_extract({rest}, {chr(39)}^(.*?){scale}{chr(39)}, 1)')}, 1) else 0 end)")
        rest = f"regexp_replace({rest}, '^.*?{scale}', '')"
    return f"case when regexp_matches({named}, '{NUMBER}') then cast({' + '.join(out)} + {below(rest)} as bigint) end"


def amounts_sql(lines: str = "blocks") -> str:
    each = " union all ".join(f"select doc_id, idx, unnest(regexp_extract_all(text, '{p}')) as shown, unnest(regexp_extract_all(text, '{p}', {w})) as words, unnest(regexp_extract_all(text, '{p}', {f})) as figures from {lines}" for p, w, f in checks.AMOUNT)
    return f"""with a as ({each}), v as (select *, {value_sql('words')} as value from a)
 select doc_id, idx, 'amount' as kind, 1 as severity, shown as anchor, concat('words say ', cast(value as varchar)) as note from v where value is not null and value is distinct from try_cast(replace(figures, ',', '') as bigint)"""


AMOUNTS = amounts_sql()


@query(AMOUNTS)
def check_amounts(spark, sf_dir):
    return checks.amounts(lines(spark, sf_dir))


@query(r"""with n(currency, notation, pattern) as (values ('USD', 'USD', '\bUSD\s?\d'), ('USD', 'US$', 'US\$\s?\d'), ('GBP', 'GBP', '\bGBP\s?\d'), ('GBP', '£', '£\s?\d'), ('EUR', 'EUR', '\bEUR\s?\d'), ('EUR', '€', '€\s?\d')),
 s as (select doc_id, idx, currency, notation from blocks join n on regexp_matches(text, pattern))
 select doc_id, min(idx) as idx, 'currency notation' as kind, 3 as severity, currency as anchor, string_agg(distinct notation, ', ' order by notation) as note from s group by doc_id, currency having count(distinct notation) > 1""")
def check_currency_notation(spark, sf_dir):
    return checks.currency_notation(lines(spark, sf_dir))


DATES = rf"""dates as (select doc_id, idx, anchor, 'day first' as style, cast(strptime(anchor, '%-d %B %Y') as date) as day from (select doc_id, idx, unnest(regexp_extract_all(text, '\b\d{{1,2}} {MONTH} \d{{4}}\b')) as anchor from blocks)
 union all select doc_id, idx, anchor, 'month first', cast(strptime(anchor, '%B %-d, %Y') as date) from (select doc_id, idx, unnest(regexp_extract_all(text, '\b{MONTH} \d{{1,2}}, \d{{4}}\b')) as anchor from blocks))"""


@query(f"with {DATES} select doc_id, idx, anchor, style, day from dates")
def dates_in_words(spark, sf_dir):
    return checks.dates(lines(spark, sf_dir))


@query(f"with {DATES} select doc_id, idx, 'date style' as kind, 3 as severity, anchor, strftime(day, '%-d %B %Y') as note from dates where style = 'month first'")
def check_date_styles(spark, sf_dir):
    return checks.date_styles(lines(spark, sf_dir))


@query(rf"""with w as (select doc_id, idx, regexp_extract(text, '\b(Monday|Tuesday|Wednesday|Thursday|Friday|Saturday|Sunday),? (\d{{1,2}} {MONTH} \d{{4}})\b', 1) as said, regexp_extract(text, '\b(Monday|Tuesday|Wednesday|Thursday|Friday|Saturday|Sunday),? (\d{{1,2}} {MONTH} \d{{4}})\b', 2) as day from blocks)
 select doc_id, idx, 'weekday' as kind, 1 as severity, concat(said, ', ', day) as anchor, concat('was a ', dayname(strptime(day, '%-d %B %Y'))) as note from w where said <> '' and said <> dayname(strptime(day, '%-d %B %Y'))""")
def check_weekdays(spark, sf_dir):
    return checks.wrong_weekdays(lines(spark, sf_dir))


def dates_in(lines: str, name: str) -> str:
    return DATES.replace("from blocks", f"from {lines}").replace("dates as (", f"{name} as (", 1)


@query(f"""with opening as (select * from blocks where contains(text, 'is made on')), tied as (select * from blocks where contains(text, 'date of this Agreement')), {dates_in("opening", "od")}, {dates_in("tied", "td")},
 o as (select doc_id, arg_min(day, idx) as opened from od group by 1)
 select td.doc_id, idx, 'contradictory date' as kind, 1 as severity, anchor, concat('opens with ', strftime(opened, '%-d %B %Y')) as note from td join o on o.doc_id = td.doc_id where day <> opened""")
def check_contradictory_dates(spark, sf_dir):
    return checks.contradictory_dates(lines(spark, sf_dir))


COMPANIES = r"""co as (select doc_id, idx, trim(b[i]) as base, s[i] as suffix, case s[i] when 'Limited' then 'ltd' when 'Ltd' then 'ltd' when 'LLP' then 'llp' else lower(s[i]) end as family
 from (select doc_id, idx, regexp_extract_all(text, '\b((?:[A-Z][A-Za-z0-9]* ){1,3})(Limited|Ltd|LLP|Inc|Incorporated|Corp|Corporation|GmbH|PLC|plc)\b', 1) as b, regexp_extract_all(text, '\b((?:[A-Z][A-Za-z0-9]* ){1,3})(Limited|Ltd|LLP|Inc|Incorporated|Corp|Corporation|GmbH|PLC|plc)\b', 2) as s from blocks), unnest(range(1, len(b) + 1)) as t(i))"""


@query(f"with {COMPANIES} select doc_id, idx, base, suffix, family from co")
def company_names(spark, sf_dir):
    return checks.companies(lines(spark, sf_dir))


@query(f"""with {COMPANIES}, f as (select doc_id, base, suffix, family, count(*) as n, min(idx) as idx from co group by all),
 k as (select *, first_value(suffix) over (partition by doc_id, base order by n desc, idx, suffix desc) as rightly from f), r as (select doc_id, base, count(distinct suffix) as forms, count(distinct family) as families from f group by all)
 select doc_id, idx, 'party name' as kind, case when families > 1 then 1 else 3 end as severity, concat(base, ' ', suffix) as anchor, concat('elsewhere ', base, ' ', rightly) as note from k join r using (doc_id, base) where forms > 1 and suffix <> rightly""")
def check_party_names(spark, sf_dir):
    return checks.party_names(lines(spark, sf_dir))


@query(r"""with p as (select doc_id, regexp_extract_all(text, '\b((?:[A-Z][A-Za-z0-9]* ){1,3})(Limited|LLP) \(the "([^"]+)"\)', 1) as b, regexp_extract_all(text, '\b((?:[A-Z][A-Za-z0-9]* ){1,3})(Limited|LLP) \(the "([^"]+)"\)', 2) as s, regexp_extract_all(text, '\b((?:[A-Z][A-Za-z0-9]* ){1,3})(Limited|LLP) \(the "([^"]+)"\)', 3) as r from blocks where idx = 0)
 select doc_id, trim(b[i]) as base, s[i] as suffix, r[i] as role from p, unnest(range(1, len(b) + 1)) as t(i)""")
def opening_parties(spark, sf_dir):
    return checks.parties(lines(spark, sf_dir))


PUNCTUATION = r"""with w as (select doc_id, idx, list_filter(regexp_split_to_array(lower(text), '[^a-z]+'), lambda x: x <> '') as ws from blocks),
 t as (select doc_id, idx, ws[i] as a, ws[i + 1] as b from w, unnest(range(1, len(ws))) as t(i)), s as (select doc_id, idx, text from blocks)
 select doc_id, idx, 'repeated word' as kind, 3 as severity, concat(a, ' ', b) as anchor, 'written twice' as note from t where a = b and length(a) > 1
 union all select doc_id, idx, 'space before mark', 3, trim(unnest(regexp_extract_all(text, '\S+ [,;:.](?:\s|$)'))), 'spacing' from s
 union all select doc_id, idx, 'double space', 3, trim(unnest(regexp_extract_all(text, '\S+  +\S+'))), 'spacing' from s
 union all select doc_id, idx, 'no space after comma', 3, trim(unnest(regexp_extract_all(text, '[A-Za-z]+,[A-Za-z]+'))), 'spacing' from s"""


@query(PUNCTUATION)
def check_punctuation(spark, sf_dir):
    return checks.punctuation(lines(spark, sf_dir))


@query(PUNCTUATION.replace("from blocks", "from prose").replace("with w as", "with prose as (select doc_id, cast(i - 1 as int) as idx, p[i] as text from (select doc_id, string_split(text, chr(10)) as p from documents), unnest(range(1, len(p) + 1)) as t(i) where not (i = len(p) and p[i] = '')), w as"))
def prose_punctuation(spark, sf_dir):
    """The same check over the lines of all documents."""
    return checks.punctuation(structure.blocks(base(spark, sf_dir, "documents").select("doc_id", "text")))


@query(r"""select n.doc_id, n.idx, 'time limits' as kind, 1 as severity, concat(regexp_extract(n.text, '\b(\d{1,4}) days notice\b', 1), ' days notice') as anchor, 'term is 12 months' as note from blocks n where regexp_matches(n.text, '\b\d{1,4} days notice\b') and cast(regexp_extract(n.text, '\b(\d{1,4}) days notice\b', 1) as int) > 12 * 31""")
def check_time_limits(spark, sf_dir):
    return checks.notice_and_term(lines(spark, sf_dir))


FEW = [checks.blanks, checks.amounts, checks.broken_references]
THREE = f"{REFERENCES} union all {BLANKS}"
FIRSTS = f"""with f0 as ({THREE} union all select * from ({AMOUNTS})), f1 as (select *, row_number() over (partition by doc_id, kind, anchor order by idx, severity, note) as n from f0), firsts as (select doc_id, idx, kind, severity, anchor, note from f1 where n = 1)"""
@query(f"""with e as (select doc_id, 'amount' as kind from agreements where doc_id % 7 = 0 union all select doc_id, 'blank' from agreements where doc_id % 11 in (0, 1)), f as (select * from ({BLANKS}) union all select * from ({AMOUNTS})),
 h as (select count(*) as planted, count(case when exists (select 1 from f where f.doc_id = e.doc_id and f.kind = e.kind) then 1 end) as caught from e), k as (select a.doc_id, (select count(*) from f where f.doc_id = a.doc_id) as n from agreements a where not exists (select 1 from e where e.doc_id = a.doc_id))
 select planted, caught, cast(caught as double) / planted as catch_rate, (select count(*) from k) as clean_docs, cast((select sum(n) from k) as double) as false_per_clean from h""")
def catch_rate(spark, sf_dir):
    docs = agreements(spark, sf_dir)
    planted = docs.where("doc_id % 7 = 0").select("doc_id", F.lit("amount").alias("kind")).union(docs.where("doc_id % 11 in (0, 1)").select("doc_id", F.lit("blank")))
    b = structure.blocks(docs)
    return checks.scored(checks.blanks(b).union(checks.amounts(b)), planted, docs)


#: The oracles of all checks but early terms, which the usual gap of two clauses finds none of here.
CHECKED = [n for n in ORACLES if n.startswith("check_") and n != "check_early_terms"]
EVERY = " union all ".join(f"select doc_id, idx, kind, severity, anchor, note from ({ORACLES[n]})" for n in CHECKED)


FIRST = f"""with f0 as ({EVERY}), f1 as (select *, row_number() over (partition by doc_id, kind, anchor order by idx, severity, note) as n from f0), firsts as (select doc_id, idx, kind, severity, anchor, note from f1 where n = 1),
 ranked as (select *, row_number() over (partition by doc_id, kind order by severity, idx, anchor, note) as n from firsts)"""
UP_TO = lambda most: f"capped as (select doc_id, idx, kind, severity, anchor, note from ranked where n <= {most} union all select doc_id, min(idx), kind, min(severity), '', concat('and ', cast(count(*) as varchar), ' more') from ranked where n > {most} group by doc_id, kind)"
VERDICTS = """v as (select doc_id, count(case when severity = 1 then 1 end) as blockers, count(case when severity = 2 then 1 end) as judgement, count(case when severity = 3 then 1 end) as minor from capped right join (select o_orderkey as doc_id from orders join customer on o_custkey = c_custkey) a using (doc_id) group by doc_id)"""


#: Agreements that are dealt out at a time: some 500 MB of short rows, whatever the table.
DOCS_AT_ONCE = 10_000_000


def every_finding(spark: SparkSession, sf_dir: str, most: int = checks.PER_KIND) -> DataFrame:
    """All checks over all agreements, as a document's findings hang on its own lines alone: each is read once, and no lines are
    kept. Of several shares, each one's findings are written before the next one's rows are dealt out."""
    docs, shares = agreements(spark, sf_dir, in_order=True), -(-base(spark, sf_dir, "orders").count() // DOCS_AT_ONCE) or 1
    of = lambda share: checks.run_all(structure.blocks(share), most=most, whole=True, together=True)
    if shares == 1:
        return of(docs)
    return reduce(DataFrame.union, [written(of(docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(shares)) == i))) for i in range(shares)])


@query(f"{FIRST}, {UP_TO(checks.PER_KIND)} select * from capped")
def all_findings(spark, sf_dir):
    """Every check over every agreement."""
    return every_finding(spark, sf_dir)


@query(f"{FIRST}, {UP_TO(1)} select * from capped")
def capped_findings(spark, sf_dir):
    """The worst finding of each kind, and how many more there are."""
    return every_finding(spark, sf_dir, 1)


@query(f"{FIRST}, {UP_TO(checks.PER_KIND)}, {VERDICTS} select *, case when blockers > 0 then 'do not sign' when judgement > 0 then 'decide first' when minor > 0 then 'tidy up' else 'clean' end as verdict from v")
def document_verdicts(spark, sf_dir):
    """The flagship: what all findings make of each agreement."""
    return checks.verdicts(every_finding(spark, sf_dir), agreements(spark, sf_dir))


@query(f"""{FIRST}, {UP_TO(checks.PER_KIND)} select doc_id, string_agg(concat(kind, ': ', anchor), chr(10) order by severity, idx, kind, anchor) as text from capped group by doc_id""")
def findings_as_text(spark, sf_dir):
    return checks.prompt_block(every_finding(spark, sf_dir))


def deed_lines(spark, sf_dir):
    return structure.blocks(view(spark, sf_dir, "deeds"))


@query(f"with {forms('deed_lines')} select doc_id, idx, term, meaning, how from found")
def definition_forms(spark, sf_dir):
    """Every form of definition, over deeds that hold them all, and quoted words that define nothing."""
    return checks.definitions(deed_lines(spark, sf_dir))


@query(amounts_sql("deed_lines"))
def check_written_amounts(spark, sf_dir):
    """Words against figures, in both orders and up to millions."""
    return checks.amounts(deed_lines(spark, sf_dir))
