"""Checks of documents. Each takes blocks (doc_id, idx, text) and returns findings.

A finding is (doc_id, idx, kind, severity, anchor, note): severity 1 blocks, 2 wants judgement, 3 is minor.
Definitions, structure and parties are joined on the document, so every check is one shuffle of the blocks by
doc_id that Spark can reuse for the next.
"""

from __future__ import annotations

from functools import reduce

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketmill.functions.text import IN_WORDS, MONTHS, all_of, date_of, number_of, written
from docketmill.operators import structure as S

FINDING = ["doc_id", "idx", "kind", "severity", "anchor", "note"]
BLANK = r"\[[A-Z][A-Z ]*\]|_{3,}|\bTBC\b|\bTBD\b"
#: Quotation marks, and what may stand between them as a term.
QUOTE, TERM = '["“”]', "^[A-Z][A-Za-z0-9 &'’-]{0,60}$"
#: What stands after a term whose meaning is stated, and after one whose meaning is said to stand elsewhere.
SAYS = r"^,?\s*(?:(?:shall|will|is to) )?(?:means?|denotes?|signif(?:y|ies)|includes?|comprises?|refers? to|ha(?:s|ve) the (?:same )?meanings?)\b"
ELSEWHERE = r"^,?\s*(?:(?:shall|will) )?ha(?:s|ve) the (?:same )?meanings?\b[^.;]*\b(?:in|by|under)\b"
#: What stands before a term that gives something a name: a bracket just opened, or a word of naming. Words that quote
#: what is written somewhere give no name.
NAMES = r"\((?:[a-z]+,? ){0,5}$|\b(?:called|named|termed|styled|known as|referred to as|together|jointly|collectively)(?: (?:the|an?|each|its))*\s*$"
WRITTEN = r"\b(?:marked|headed|entitled|titled|stamped|words?|letters?) (?:the |an? )?$"
#: A term at the head of a line, after its number at most, with a mark or nothing after it.
HEAD, MARK = r"^\s*(?:\(?[A-Za-z0-9]{1,4}[.)])?\s*$", r"^\s*(?:[:–—-]|$)"
#: What joins two terms that share what stands before the first or after the last.
JOINED = r"^\s*,?\s*(?:or|and)\s+(?:the |an? )?$"
PHRASE = r"\b[Tt]he ([A-Z][a-z]+(?: [A-Z][a-z]+){1,3})"
WORD = r"\b[A-Z][a-z]{3,}\b"
#: Words and figures of one number, in both orders: pattern, group of the words, group of the figures.
AMOUNT = [(rf"\b({IN_WORDS}) \((\d[\d,]*)\)", 1, 2), (rf"\b(\d[\d,]*) \(({IN_WORDS})\)", 2, 1)]
MONTH = "(?:" + "|".join(MONTHS) + ")"
DAY_FIRST, MONTH_FIRST = rf"\b\d{{1,2}} {MONTH} \d{{4}}\b", rf"\b{MONTH} \d{{1,2}}, \d{{4}}\b"
#: What ends a date.
YEAR = r" \d{4}\b"
WEEKDAY = rf"\b(Monday|Tuesday|Wednesday|Thursday|Friday|Saturday|Sunday),? (\d{{1,2}} {MONTH} \d{{4}})\b"
#: Notation of a currency by the pattern that shows it.
NOTATIONS = {("USD", "USD"): r"\bUSD\s?\d", ("USD", "US$"): r"US\$\s?\d", ("GBP", "GBP"): r"\bGBP\s?\d", ("GBP", "£"): r"£\s?\d", ("EUR", "EUR"): r"\bEUR\s?\d", ("EUR", "€"): r"€\s?\d"}
#: Company suffixes and their families: forms of one family are one kind of company.
SUFFIXES = {"Limited": "ltd", "Ltd": "ltd", "LLP": "llp", "Inc": "inc", "Incorporated": "inc", "Corp": "corp", "Corporation": "corp", "GmbH": "gmbh", "PLC": "plc", "plc": "plc"}
COMPANY = r"\b((?:[A-Z][A-Za-z0-9]* ){1,3})(" + "|".join(SUFFIXES) + r")\b"
HOW = ("elsewhere", "stated", "named", "headed")
UNUSED_FROM, PER_KIND = 12, 10
#: The kind of what tells that a check was not made.
NOT_MADE = "not checked"


def finding(frame: DataFrame, kind: str | Column, severity: int | Column, anchor: str | Column, note: Column) -> DataFrame:
    col = lambda x: F.lit(x) if isinstance(x, (str, int)) else x
    anchor = F.col(anchor) if isinstance(anchor, str) else anchor
    return frame.select("doc_id", "idx", col(kind).alias("kind"), col(severity).cast("int").alias("severity"), anchor.alias("anchor"), note.alias("note"))


def blanks(blocks: DataFrame) -> DataFrame:
    """Places left to be filled in."""
    each = blocks.select("doc_id", "idx", F.explode(all_of(F.col("text"), BLANK)).alias("anchor"))
    return finding(each, "blank", 1, "anchor", F.lit("left blank"))


def definitions(blocks: DataFrame) -> DataFrame:
    """(doc_id, idx, term, meaning, how): terms that a line defines, each once, by what stands around it.

    A line is cut at its quotation marks, so every second piece is quoted; an opened quotation that is never closed is
    none. Of a quoted term, the pieces before and after tell how it is defined: its meaning is stated (and runs to the
    next semicolon or quotation), stands elsewhere, is what the term names, or follows the term at the head of a line. Where
    several hold, a place elsewhere comes first, then a stated meaning, a name, a head; of several places the first.
    """
    lines = blocks.where(F.col("text").rlike(QUOTE)).select("doc_id", "idx", F.split("text", QUOTE, -1).alias("p"))
    of = lambda i: F.get("p", i.cast("int"))
    joined = lambda x, far: F.when(far.isNotNull() & x.rlike(JOINED), far).otherwise(x)

    def rank(x: Column) -> Column:
        before, after = x["before"], x["after"]
        return F.when(after.rlike(ELSEWHERE), 1).when(after.rlike(SAYS), 2).when(before.rlike(NAMES) & ~before.rlike(WRITTEN), 3).when(before.rlike(HEAD) & after.rlike(MARK), 4)

    # step by step, so that what stands around a term, and its rank, are worked out once
    pairs = F.floor((F.size("p") - 1) / 2)
    quoted = F.filter(F.transform(F.sequence(F.lit(0).cast("bigint"), pairs - 1), lambda k: F.struct(of(2 * k + 1).alias("term"), k.alias("k"))), lambda x: x["term"].rlike(TERM))
    around = F.transform(quoted, lambda x: F.struct(x["term"].alias("term"), x["k"].alias("k"), joined(of(2 * x["k"]), of(2 * x["k"] - 2)).alias("before"), joined(of(2 * x["k"] + 2), of(2 * x["k"] + 4)).alias("after")))
    ranked = F.filter(F.transform(around, lambda x: F.struct(x["term"].alias("term"), rank(x).alias("rank"), x["k"].alias("k"), x["after"].alias("after"))), lambda x: x["rank"].isNotNull())
    meaning = lambda x: F.when(x["rank"] == 2, F.trim(F.regexp_extract(x["after"], SAYS + r"\s*([^;]*)", 1)))
    found = F.transform(ranked, lambda x: F.struct(x["term"].alias("term"), x["rank"].alias("rank"), x["k"].alias("k"), meaning(x).alias("meaning")))
    sorted_ = lines.where(pairs > 0).select("doc_id", "idx", F.array_sort(found).alias("f"))
    each = sorted_.select("doc_id", "idx", F.inline(F.filter("f", lambda x, i: (i == 0) | (F.get("f", i - 1)["term"] != x["term"]))))
    how = F.element_at(F.array(*map(F.lit, HOW)), F.col("rank"))
    return each.select("doc_id", "idx", "term", "meaning", how.alias("how"))


def _defined(blocks: DataFrame, defined: DataFrame | None) -> DataFrame:
    return definitions(blocks) if defined is None else defined


def unused_terms(blocks: DataFrame, *, defined: DataFrame | None = None) -> DataFrame:
    """Terms that are defined and stand nowhere else, in documents of UNUSED_FROM lines or more."""
    own = _defined(blocks, defined).where("how = 'stated'").select("doc_id", "term", F.col("idx").alias("at"))
    # every line of a document meets its terms once, which tells how many lines there are and where a term stands
    used = (F.col("idx") != F.col("at")) & (F.instr(F.col("text"), F.col("term")) > 0)
    met = blocks.join(own, "doc_id").groupBy("doc_id", "term", "at").agg(F.count(F.lit(1)).alias("n"), F.max(used).alias("used"))
    unused = met.where((F.col("n") >= UNUSED_FROM) & ~F.coalesce("used", F.lit(False))).withColumnRenamed("at", "idx")
    return finding(unused, "unused term", 3, "term", F.lit("defined but never used"))


def early_terms(blocks: DataFrame, gap: int = 2, *, defined: DataFrame | None = None) -> DataFrame:
    """Terms used `gap` or more clauses before the one that defines them."""
    c = S.with_clauses(blocks)
    own = _defined(blocks, defined).where("how = 'stated'").join(c.select("doc_id", "idx", F.coalesce("clause", F.lit(0)).alias("home")), ["doc_id", "idx"]).groupBy("doc_id", "term").agg(F.min("home").alias("home"))
    used = c.join(own, "doc_id").where(F.instr(F.col("text"), F.col("term")) > 0).where(F.coalesce("clause", F.lit(0)) + gap <= F.col("home"))
    first = used.groupBy("doc_id", "term").agg(F.min("idx").alias("idx"), F.min("home").alias("home"))
    return finding(first, "early term", 2, "term", F.concat(F.lit("defined only in clause "), F.col("home").cast("string")))


def repeated_definitions(blocks: DataFrame, *, defined: DataFrame | None = None) -> DataFrame:
    """Second and later definitions of a term: to the same effect, or to another."""
    w = Window.partitionBy("doc_id", "term").orderBy("idx")
    seen = _defined(blocks, defined).where("how = 'stated'").withColumns({"n": F.row_number().over(w), "first": F.first("meaning").over(w)}).where("n > 1")
    same = F.lower(F.trim("meaning")) == F.lower(F.trim("first"))
    return finding(seen, "repeated definition", F.when(same, 3).otherwise(1), "term", F.when(same, "defined twice alike").otherwise("defined twice differently"))


def undefined_terms(blocks: DataFrame, most: int = 5, *, defined: DataFrame | None = None) -> DataFrame:
    """Capitalised phrases that come up twice or more after an article and are not defined."""
    each = blocks.select("doc_id", "idx", F.explode(all_of(F.col("text"), PHRASE, 1)).alias("phrase"))
    often = each.groupBy("doc_id", "phrase").agg(F.count(F.lit(1)).alias("n"), F.min("idx").alias("idx")).where("n >= 2")
    new = often.join(_defined(blocks, defined).select("doc_id", F.col("term").alias("phrase")), ["doc_id", "phrase"], "left_anti")
    ranked = new.withColumn("rank", F.row_number().over(Window.partitionBy("doc_id").orderBy("idx", "phrase"))).where(F.col("rank") <= most)
    return finding(ranked, "undefined term", 2, "phrase", F.concat(F.lit("used "), F.col("n").cast("string"), F.lit(" times")))


def misspelt_terms(blocks: DataFrame, *, together: bool = False) -> DataFrame:
    """Words one edit from a defined single-word term, used once, that are no defined term themselves.

    Words and terms of a document meet on what is left of them without a letter, so the work is in proportion to their
    letters, and never all words of a document by all its terms. That is done document by document, in memory: as rows, what is
    left of all words would be many times the lines. `together`: the lines of each document stand in a row already."""
    from docketmill.operators import reading

    return reading.findings(blocks, ["misspelt_terms"], together=together)


def lower_case_terms(blocks: DataFrame, *, defined: DataFrame | None = None) -> DataFrame:
    """Defined terms of several words that stand in lower case as whole words, other than in a line that defines them."""
    own = _defined(blocks, defined).where(F.col("term").contains(" ")).select("doc_id", "term", "idx")
    terms = own.groupBy("doc_id", F.lower("term").alias("low")).agg(F.min("term").alias("term"), F.collect_set("idx").alias("at"))
    met = blocks.join(terms, "doc_id").where(F.contains("text", "low") & ~F.array_contains("at", F.col("idx")))
    whole = F.contains(F.concat(F.lit(" "), F.regexp_replace("text", "[^A-Za-z0-9'’-]+", " "), F.lit(" ")), F.concat(F.lit(" "), F.regexp_replace("low", "[^a-z0-9'’-]+", " "), F.lit(" ")))
    return finding(met.where(whole), "lower-case term", 3, "low", F.concat(F.lit("for "), F.col("term")))


def broken_references(blocks: DataFrame) -> DataFrame:
    """References to clauses that are not there, with the three nearest that are, and to missing schedules.
    Documents without numbered clauses have no broken references."""
    there = S.numbers(blocks).where("part is null").groupBy("doc_id").agg(F.collect_set("number").alias("all"))
    lost = S.pointers(blocks).join(there, "doc_id").where(~F.array_contains("all", F.col("number")))
    near = F.slice(F.array_sort(F.transform("all", lambda n: F.struct(F.abs(n - F.col("number")).alias("d"), n.alias("n")))), F.lit(1), F.lit(3))
    clauses = finding(lost, "broken reference", 1, F.concat_ws(" ", "word", F.col("number").cast("string")), F.concat(F.lit("there are "), F.array_join(F.transform(near, lambda x: x["n"].cast("string")), ", ")))
    named = blocks.where(S.schedule_title().isNull()).select("doc_id", "idx", F.explode(F.array_distinct(all_of(F.col("text"), r"\bSchedule \d+\b"))).alias("title"))
    missing = named.join(S.schedules(blocks), ["doc_id", "title"], "left_anti")
    return clauses.union(finding(missing, "broken reference", 1, "title", F.lit("no such schedule")))


def numbering(blocks: DataFrame) -> DataFrame:
    """Top-level numbers that repeat, and gaps in them, in the body and in each schedule."""
    c = S.numbered(blocks).select("doc_id", "part", "idx", F.col("number").alias("n"))
    w = Window.partitionBy("doc_id", "part").orderBy("n", "idx")
    each = c.withColumn("before", F.lag("n").over(w))
    twice = each.where("n = before")
    gap = each.where("n > before + 1")
    return finding(twice, "numbering", 2, F.col("n").cast("string"), F.lit("number used twice")).union(finding(gap, "numbering", 3, F.col("n").cast("string"), F.concat(F.lit("no "), F.array_join(F.transform(F.sequence(F.col("before") + 1, F.col("n") - 1), lambda x: x.cast("string")), ", "))))


def amounts(blocks: DataFrame) -> DataFrame:
    """Numbers in words, up to billions, that the figures beside them contradict: words before figures in brackets, or
    figures before words in brackets."""
    lines = blocks.where(F.col("text").rlike(r"\([\da-z]"))
    row = lambda shown, words, figures: F.struct(shown.alias("shown"), words.alias("words"), figures.alias("figures"))
    found = F.concat(*(F.zip_with(all_of(F.col("text"), p), F.arrays_zip(all_of(F.col("text"), p, w).alias("w"), all_of(F.col("text"), p, f).alias("f")), lambda m, x: row(m, x["w"], x["f"])) for p, w, f in AMOUNT))
    each = lines.select("doc_id", "idx", F.inline(found)).withColumn("value", number_of(F.col("words")))
    figures = F.replace("figures", F.lit(","), F.lit("")).try_cast("bigint")  # null: more than any number in words
    wrong = each.where(F.col("value").isNotNull() & ~F.col("value").eqNullSafe(figures))
    return finding(wrong, "amount", 1, "shown", F.concat(F.lit("words say "), F.col("value").cast("string")))


def currency_notation(blocks: DataFrame) -> DataFrame:
    """Currencies that a document writes in several ways."""
    shown = F.array(*(F.when(F.col("text").rlike(p), F.struct(F.lit(c).alias("currency"), F.lit(n).alias("notation"))) for (c, n), p in NOTATIONS.items()))
    each = blocks.select("doc_id", "idx", F.inline(F.array_compact(shown)))
    mixed = each.groupBy("doc_id", "currency").agg(F.min("idx").alias("idx"), F.array_sort(F.collect_set("notation")).alias("all")).where(F.size("all") > 1)
    return finding(mixed, "currency notation", 3, "currency", F.array_join("all", ", "))


def dates(blocks: DataFrame) -> DataFrame:
    """(doc_id, idx, anchor, style, day): dates with the month in words."""
    return _dates(blocks).drop("n")


def _dates(blocks: DataFrame) -> DataFrame:
    """dates() with their number n within the line."""
    of = lambda p, s: F.transform(all_of(F.col("text"), p), lambda x: F.struct(x.alias("anchor"), F.lit(s).alias("style")))
    each = blocks.where(F.col("text").rlike(YEAR)).select("doc_id", "idx", F.posexplode(F.concat(of(DAY_FIRST, "day first"), of(MONTH_FIRST, "month first"))).alias("n", "x"))
    return each.select("doc_id", "idx", "n", "x.*").withColumn("day", date_of(F.col("anchor")))


def date_styles(blocks: DataFrame) -> DataFrame:
    """Dates not in the document's commonest style (of equals the one seen first), written in that style."""
    own, doc = Window.partitionBy("doc_id", "style"), Window.partitionBy("doc_id")
    counted = dates(blocks).withColumns({"n": F.count(F.lit(1)).over(own), "first": F.min("idx").over(own)})
    other = counted.withColumn("main", F.max_by("style", F.struct("n", -F.col("first"))).over(doc)).where("style <> main")
    as_month_first = F.concat(F.element_at(F.array(*map(F.lit, MONTHS)), F.month("day")), F.lit(" "), F.day("day").cast("string"), F.lit(", "), F.year("day").cast("string"))
    return finding(other, "date style", 3, "anchor", F.when(F.col("main") == "day first", written(F.col("day"))).otherwise(as_month_first))


def wrong_weekdays(blocks: DataFrame) -> DataFrame:
    both = F.arrays_zip(all_of(F.col("text"), WEEKDAY, 1).alias("said"), all_of(F.col("text"), WEEKDAY, 2).alias("on"))
    each = blocks.select("doc_id", "idx", F.inline(both)).withColumn("real", F.date_format(date_of(F.col("on")), "EEEE"))
    return finding(each.where("said <> real"), "weekday", 1, F.concat_ws(", ", "said", "on"), F.concat(F.lit("was a "), F.col("real")))


def contradictory_dates(blocks: DataFrame) -> DataFrame:
    """Dates said to be the date of the agreement that are not the first one it opens with."""
    opening = _dates(blocks.where(F.col("text").contains("is made on"))).where("day is not null").groupBy("doc_id").agg(F.min_by("day", F.struct("idx", "n")).alias("opening"))
    tied = dates(blocks.where(F.col("text").contains("date of this Agreement"))).join(opening, "doc_id").where("day <> opening")
    return finding(tied, "contradictory date", 1, "anchor", F.concat(F.lit("opens with "), written(F.col("opening"))))


def companies(blocks: DataFrame) -> DataFrame:
    """(doc_id, idx, base, suffix, family)"""
    both = F.arrays_zip(all_of(F.col("text"), COMPANY, 1).alias("base"), all_of(F.col("text"), COMPANY, 2).alias("suffix"))
    family = F.create_map(*(F.lit(x) for p in SUFFIXES.items() for x in p))
    return blocks.select("doc_id", "idx", F.inline(both)).select("doc_id", "idx", F.trim("base").alias("base"), "suffix", family[F.col("suffix")].alias("family"))


def party_names(blocks: DataFrame) -> DataFrame:
    """Companies under several forms: of one family a slip, of several a contradiction. The commonest form (of
    equals the first) is taken to be right."""
    forms = companies(blocks).groupBy("doc_id", "base", "suffix", "family").agg(F.count(F.lit(1)).alias("n"), F.min("idx").alias("idx"))
    right = forms.groupBy("doc_id", "base").agg(F.max_by("suffix", F.struct("n", -F.col("idx"), "suffix")).alias("right"), F.count_distinct("suffix").alias("forms"), F.count_distinct("family").alias("families")).where("forms > 1")
    other = forms.join(right, ["doc_id", "base"]).where("suffix <> right")
    return finding(other, "party name", F.when(F.col("families") > 1, 1).otherwise(3), F.concat_ws(" ", "base", "suffix"), F.concat_ws(" ", F.lit("elsewhere"), "base", "right"))


def parties(blocks: DataFrame) -> DataFrame:
    """(doc_id, base, suffix, role): companies of the first line with the role in brackets after them."""
    pattern = COMPANY + r' \(the "([^"]+)"\)'
    both = F.arrays_zip(*(all_of(F.col("text"), pattern, i).alias(n) for i, n in ((1, "base"), (2, "suffix"), (3, "role"))))
    return blocks.where("idx = 0").select("doc_id", F.inline(both)).withColumn("base", F.trim("base"))


def punctuation(blocks: DataFrame) -> DataFrame:
    """Words written twice, blanks before punctuation, double blanks, and commas without a blank after them."""
    # what a line must hold is looked for first, in one pass; words are then compared whole, whatever stands between them
    text, low = F.col("text"), F.lower("text")
    repeated = low.rlike(r"(?<![a-z])([a-z]{2,}+)[^a-z]++\1(?![a-z])")
    maybe = {
        "space before mark": (reduce(Column.__or__, (text.contains(f" {m}") for m in ",;:.")), r"\S+ [,;:.](?:\s|$)"),
        "double space": (text.contains("  "), r"\S+  +\S+"),
        "no space after comma": (text.rlike("[A-Za-z],[A-Za-z]"), r"[A-Za-z]+,[A-Za-z]+"),
    }
    told = lambda kind, anchor, note: F.struct(F.lit(kind).alias("kind"), anchor.alias("anchor"), F.lit(note).alias("note"))
    none = F.array().cast("array<struct<kind:string,anchor:string,note:string>>")
    words = F.filter(F.split(low, r"[^a-z]+"), lambda w: w != "")
    pairs = F.filter(F.arrays_zip(words.alias("b"), F.concat(F.array(F.lit("")), words).alias("a")), lambda x: (x["a"] == x["b"]) & (F.length(x["b"]) > 1))
    found = [F.when(repeated, F.transform(pairs, lambda x: told("repeated word", F.concat_ws(" ", x["a"], x["b"]), "written twice"))).otherwise(none)]
    spaced = lambda kind, p: F.transform(all_of(text, p), lambda x: told(kind, F.trim(x), "spacing"))
    found += [F.when(held, spaced(kind, p)).otherwise(none) for kind, (held, p) in maybe.items()]
    some = blocks.where(reduce(Column.__or__, (held for held, _ in maybe.values()), repeated))
    return finding(some.select("doc_id", "idx", F.inline(F.concat(*found))), F.col("kind"), 3, "anchor", F.col("note"))


def notice_and_term(blocks: DataFrame) -> DataFrame:
    """Notice periods that are longer than the term on every reading: days against months of 28 to 31 days."""
    notice = blocks.where(F.col("text").rlike(r"\b\d{1,4} days notice\b")).select("doc_id", "idx", F.regexp_extract("text", r"\b(\d{1,4}) days notice\b", 1).cast("int").alias("notice"))
    term = blocks.where(F.col("text").rlike(r"\bterm of this Agreement is \d{1,4} months\b")).select("doc_id", F.regexp_extract("text", r"term of this Agreement is (\d{1,4}) months", 1).cast("int").alias("months"))
    one = term.groupBy("doc_id").agg(F.count_distinct("months").alias("n"), F.min("months").alias("months")).where("n = 1")
    both = notice.join(one, "doc_id").where(F.col("notice") > F.col("months") * 31)
    return finding(both, "time limits", 1, F.concat(F.col("notice").cast("string"), F.lit(" days notice")), F.concat(F.lit("term is "), F.col("months").cast("string"), F.lit(" months")))


#: All of them are in reading.READ, too.
CHECKS = [blanks, unused_terms, early_terms, repeated_definitions, undefined_terms, misspelt_terms, lower_case_terms, broken_references, numbering, amounts, currency_notation, date_styles, wrong_weekdays, contradictory_dates, party_names, punctuation, notice_and_term]


def deduplicated(findings: DataFrame) -> DataFrame:
    """The first finding of each kind and anchor of a document."""
    w = Window.partitionBy("doc_id", "kind", "anchor").orderBy("idx", "severity", "note")
    return findings.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def capped(findings: DataFrame, most: int = PER_KIND) -> DataFrame:
    """The worst `most` findings of each kind of a document; one line stands for the rest, with their worst severity."""
    group = Window.partitionBy("doc_id", "kind")
    w = group.orderBy("severity", "idx", "anchor", "note")
    ranked = findings.withColumns({"__n": F.row_number().over(w), "__all": F.count(F.lit(1)).over(group), "__idx": F.min("idx").over(w.rowsBetween(0, Window.unboundedFollowing))})
    # the first row beyond the limit has the worst severity of the rest and becomes their line: one pass
    more = F.col("__n") > most
    line = F.concat(F.lit("and "), (F.col("__all") - most).cast("string"), F.lit(" more"))
    kept = ranked.where(F.col("__n") <= most + 1)
    return kept.select("doc_id", F.when(more, F.col("__idx")).otherwise(F.col("idx")).alias("idx"), "kind", "severity", F.when(more, F.lit("")).otherwise(F.col("anchor")).alias("anchor"), F.when(more, line).otherwise(F.col("note")).alias("note"))


def run_all(blocks: DataFrame, checks: list = CHECKS, *, most: int = PER_KIND, whole: bool = False, together: bool = False) -> DataFrame:
    """Every check, first findings only, capped by kind. The checks of this module are made in one pass over the lines of each
    document (reading.py), others each read the blocks anew. `together` says that the lines of a document stand in one row after
    the other already. With `whole`, a check that can't be set up is an error, and never one finding among others."""
    from docketmill.operators import reading

    own = [c.__name__ for c in checks if c in CHECKS]
    if len(own) == len(checks) > 0 and set(blocks.columns) >= {"doc_id", "idx", "text"}:
        return reading.findings(blocks, own, most, together=together)
    run = (lambda check: check(blocks).select(*FINDING)) if whole else (lambda check: tried(check, blocks))
    return capped(deduplicated(reduce(DataFrame.union, map(run, checks))), most)


def tried(check, blocks: DataFrame) -> DataFrame:
    """A check's findings; where it can't be set up over these blocks (a column is missing), one finding of no document that
    says so, and the others go on: for a reader who looks through findings, and not for queries that count them. What may go wrong with a row is no error in the first place: texts that can't be read as numbers or
    dates are null, and give a finding or none."""
    try:
        return check(blocks).select(*FINDING)
    except PySparkException as e:
        schema = "idx int, kind string, severity int, anchor string, note string"
        failed = blocks.sparkSession.createDataFrame([(None, NOT_MADE, 2, check.__name__, type(e).__name__)], schema)
        return failed.select(F.lit(None).cast(dict(blocks.dtypes).get("doc_id", "bigint")).alias("doc_id"), *FINDING[1:])


def verdicts(findings: DataFrame, docs: DataFrame) -> DataFrame:
    """(doc_id, blockers, judgement, minor, verdict), one row for each document, clean ones included. Findings that a check
    is missing from (run_all without `whole`) give no verdicts but an error."""
    n = lambda s: F.count(F.when(F.col("severity") == s, 1))
    # a check that was not made belongs to no document, so it is looked for among all findings, before they are counted
    missing = F.when(F.col("kind") == NOT_MADE, F.raise_error(F.concat(F.lit("no verdicts without the check "), "anchor"))).otherwise(F.col("doc_id"))
    counted = findings.withColumn("doc_id", missing).groupBy("doc_id").agg(n(1).alias("blockers"), n(2).alias("judgement"), n(3).alias("minor"))
    every = docs.select("doc_id").distinct().join(counted, "doc_id", "left").na.fill(0, ["blockers", "judgement", "minor"])
    verdict = F.when(F.col("blockers") > 0, "do not sign").when(F.col("judgement") > 0, "decide first").when(F.col("minor") > 0, "tidy up").otherwise("clean")
    return every.withColumn("verdict", verdict)


def prompt_block(findings: DataFrame) -> DataFrame:
    """(doc_id, text): findings as lines, worst first."""
    line = F.struct("severity", "idx", "kind", "anchor", F.concat_ws(": ", "kind", "anchor").alias("line"))
    return findings.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["line"]), "\n").alias("text"))


def scored(findings: DataFrame, expected: DataFrame, docs: DataFrame) -> DataFrame:
    """(planted, caught, catch_rate, clean_docs, false_per_clean): findings held against planted kinds."""
    found = findings.select("doc_id", "kind").distinct().withColumn("hit", F.lit(1))
    caught = expected.select("doc_id", "kind").distinct().join(found, ["doc_id", "kind"], "left").agg(F.count(F.lit(1)).alias("planted"), F.count("hit").alias("caught"))
    clean = docs.select("doc_id").join(expected.select("doc_id"), "doc_id", "left_anti")
    wrong = clean.join(findings.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")), "doc_id", "left").agg(F.count(F.lit(1)).alias("clean_docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    return caught.withColumn("__k", F.lit(1)).join(wrong.withColumn("__k", F.lit(1)), "__k").select("planted", "caught", F.round(F.col("caught") / F.col("planted"), 6).alias("catch_rate"), "clean_docs", F.round(F.col("n") / F.greatest("clean_docs", F.lit(1)), 6).alias("false_per_clean"))
