"""Time limits of documents: periods with bounds in days, dates, their order, and calendars."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketmill.functions.text import all_of, number_of, once
from docketmill.operators import checks

PERIOD = r"\b([Ww]ithin|[Oo]n|[Aa]fter|for|is) (?:[a-z-]+ \()?(\d{1,4})\)? (days?|weeks?|months?|years?)\b"
AFTER = r"\b(\d{1,4})\)? (days?|weeks?|months?|years?) (after|from and including|beginning (?:on|with)) (?:the )?([A-Z][A-Za-z]+(?: [A-Z][a-z]+)*|[a-z]+)"
#: Fewest and most days of a unit; a month is a range on purpose.
DAYS = {"day": (1.0, 1.0), "week": (7.0, 7.0), "month": (28.0, 31.0), "year": (365.0, 366.0)}


def _unit(text: Column) -> Column:
    return F.regexp_replace(text, "s$", "")


def bounds(n: Column, unit: Column) -> tuple[Column, Column]:
    """Least and most days of a period; null for an unknown unit."""
    pick = lambda i: F.coalesce(*(F.when(unit == u, n * F.lit(d[i])) for u, d in DAYS.items()))
    return pick(0), pick(1)


def _holds(*words: str) -> Column:
    """Whether a line holds one of the words, which is quickly told before a pattern is tried on it."""
    return reduce(Column.__or__, (F.contains("text", F.lit(w)) for w in words))


#: What every line with a period holds, and every line with a period counted from an event.
UNITS, COUNTED = (" day", " week", " month", " year"), (" after ", " from and including ", " beginning ")


def periods(blocks: DataFrame) -> DataFrame:
    """(doc_id, idx, at, n, unit, lo, hi)"""
    both = F.arrays_zip(all_of(F.col("text"), PERIOD, 2).alias("n"), all_of(F.col("text"), PERIOD, 3).alias("unit"))
    each = blocks.where(_holds(*UNITS)).select("doc_id", "idx", F.posexplode(both).alias("at", "x")).select("doc_id", "idx", "at", F.col("x.n").cast("int").alias("n"), _unit(F.col("x.unit")).alias("unit"))
    lo, hi = bounds(F.col("n"), F.col("unit"))
    return each.withColumns({"lo": lo, "hi": hi})


def anchored(blocks: DataFrame) -> DataFrame:
    """(doc_id, idx, n, unit, inclusive, anchor, lo, hi): periods counted from an event, whose own day counts or not. A
    number of more than four digits is no period."""
    four = F.arrays_zip(*(all_of(F.col("text"), AFTER, i).alias(c) for i, c in ((1, "n"), (2, "unit"), (3, "how"), (4, "anchor"))))
    each = blocks.where(_holds(*COUNTED)).select("doc_id", "idx", F.inline(four)).select("doc_id", "idx", F.col("n").cast("int").alias("n"), _unit(F.col("unit")).alias("unit"), (F.col("how") != "after").alias("inclusive"), "anchor")
    lo, hi = bounds(F.col("n"), F.col("unit"))
    return each.withColumns({"lo": lo, "hi": hi})


def shifted(day: Column, n: Column, unit: Column) -> Column:
    """A day so many units later; months and years end on the last day of a month that has no such day. Null
    after the year 9999."""
    end = F.when(unit == "day", F.date_add(day, n)).when(unit == "week", F.date_add(day, n * 7)).when(unit == "month", F.add_months(day, n)).when(unit == "year", F.add_months(day, n * 12))
    return F.when(end <= F.lit("9999-12-31").cast("date"), end)


def due(blocks: DataFrame) -> DataFrame:
    """(doc_id, idx, anchor, day): days due, where the period's anchor is defined as a date. A period that counts its first
    day in ends a day earlier."""
    fixed = checks.definitions(blocks).where("how = 'stated'").where(F.col("meaning").rlike(checks.DAY_FIRST)).select("doc_id", F.col("term").alias("anchor"), checks.date_of(F.regexp_extract("meaning", checks.DAY_FIRST, 0)).alias("from")).where("`from` is not null")
    first = fixed.groupBy("doc_id", "anchor").agg(F.min("from").alias("from"))
    return anchored(blocks).join(first, ["doc_id", "anchor"]).select("doc_id", "idx", "anchor", F.date_sub(shifted(F.col("from"), F.col("n"), F.col("unit")), F.col("inclusive").cast("int")).alias("day"))


#: Kinds of periods, and the beginnings of the words that tell them: what clauses about time are headed, and their verbs.
CUES = {
    "payment": ["pay", "due", "invoic", "instal", "remit"], "ending": ["terminat", "notice", "rescind"], "duration": ["term", "continu", "last", "in force"], "extension": ["renew", "extend", "extension"],
    "remedy": ["remed", "cure", "rectif", "put right"], "service": ["deemed", "served", "deliver", "post"], "survival": ["surviv", "outlast"], "restraint": ["compet", "solicit", "poach", "employ"],
    "claim": ["claim", "warrant", "indemn"], "holdback": ["retention", "retain", "escrow", "withh"], "secrecy": ["confiden", "secre", "disclos"], "closing": ["complet", "clos", "settle"], "review": ["review", "audit", "inspect"],
}
ANY_CUE = r"\b(" + "|".join(w for ws in CUES.values() for w in ws) + ")"
#: The last cue of what stands before a period with all before it, what stands before the first cue after one, as the SQL
#: finds them. No cue begins within another one, so the last of all matches is the last cue.
LAST_CUE, FIRST_CUE, OWN_SENTENCE = (rf"^.*{ANY_CUE}", rf"^(.*?){ANY_CUE}", ("[^.;]*$", "^[^.;]*"))


def kind_of(before: Column, after: Column) -> Column:
    """The kind that the cue nearest to a period tells, of equally near ones the one before it; null without a cue."""
    cue = lambda far, place, word: F.struct(far.alias("far"), F.lit(place).alias("place"), word.alias("cue"))

    def nearest(x: Column) -> Column:
        last, first = F.try_element_at(all_of(x["before"], ANY_CUE, 1), F.lit(-1)), F.regexp_extract(x["after"], ANY_CUE, 1)
        behind, ahead = F.length(F.element_at(F.split(x["before"], ANY_CUE, -1), -1)), F.regexp_instr(x["after"], F.lit(ANY_CUE)) - 1
        return F.array_min(F.filter(F.array(cue(behind, 0, last), cue(ahead, 1, first)), lambda y: y["cue"] != ""))

    near = once(F.struct(F.lower(before).alias("before"), F.lower(after).alias("after")), nearest)
    kinds = F.create_map(*(F.lit(x) for k, ws in CUES.items() for w in ws for x in (w, k)))
    return F.try_element_at(kinds, near["cue"])


def classified(blocks: DataFrame) -> DataFrame:
    """(doc_id, idx, kind, n, unit): periods with their kind, told by the nearest cue of their sentence, and where that
    has none by the nearest of the line. A line is cut at its periods, so what stands between two is before one and
    after the other."""
    marked = F.split(F.regexp_replace("text", PERIOD, "\x01$2 $3\x01"), "\x01", -1)
    lines = blocks.where(_holds(*UNITS)).where(F.col("text").rlike(PERIOD)).select("doc_id", "idx", marked.alias("p"))
    pairs = F.floor((F.size("p") - 1) / 2)
    of = lambda i: F.get("p", i.cast("int"))
    each = lines.select("doc_id", "idx", F.inline(F.transform(F.sequence(F.lit(0).cast("bigint"), pairs - 1), lambda k: F.struct(of(2 * k).alias("before"), of(2 * k + 1).alias("period"), of(2 * k + 2).alias("after")))))
    inner = [F.regexp_extract(c, p, 0) for c, p in zip(("before", "after"), OWN_SENTENCE, strict=True)]
    kind = F.coalesce(kind_of(*inner), kind_of(F.col("before"), F.col("after")), F.lit("period"))
    n, unit = F.substring_index("period", " ", 1).cast("int"), F.substring_index("period", " ", -1)
    return each.select("doc_id", "idx", kind.alias("kind"), n.alias("n"), _unit(unit).alias("unit"))


def kind_in(before: str, after: str) -> str | None:
    """kind_of() of two texts."""
    before, after = before.lower(), after.lower()
    found = [(len(before) - m.end(), 0, m[1]) for m in re.finditer(ANY_CUE, before, re.ASCII)][-1:]
    if m := re.search(ANY_CUE, after, re.ASCII):
        found.append((m.start(), 1, m[1]))
    return next((k for k, words in CUES.items() if min(found)[2] in words), None) if found else None


def classified_in(text: str) -> list[tuple[str, int, str]]:
    """(kind, n, unit): classified() of one line."""
    if not any(u in text for u in UNITS):
        return []
    found = list(re.finditer(PERIOD, text, re.ASCII))
    ends, starts, out = [0, *(m.end() for m in found)], [*(m.start() for m in found), len(text)], []
    for k, m in enumerate(found):
        before, after = text[ends[k] : starts[k]], text[ends[k + 1] : starts[k + 1]]
        inner = [re.search(p, x)[0] for p, x in zip(OWN_SENTENCE, (before, after), strict=True)]
        out.append((kind_in(*inner) or kind_in(before, after) or "period", int(m[2]), m[3].removesuffix("s")))
    return out


def table(blocks: DataFrame) -> DataFrame:
    """(doc_id, idx, kind, what, day, lo, hi): every date and period in the order it stands."""
    # both are looked for in one pass over the lines, which leaves the rows of a document together; a date ends in a
    # figure and a period in a unit, and what is found is read once it has a row of its own
    text, none = F.col("text"), F.array().cast("array<string>")
    dated, spanned = text.rlike(checks.YEAR), _holds(*UNITS)
    found = F.concat(F.when(dated, F.concat(all_of(text, checks.DAY_FIRST), all_of(text, checks.MONTH_FIRST))).otherwise(none), F.when(spanned, all_of(text, PERIOD)).otherwise(none))
    each = blocks.where(dated | spanned).select("doc_id", "idx", F.explode(found).alias("found"))
    date = F.col("found").rlike(r"\d$")
    part = lambda i: F.when(~date, F.regexp_extract("found", PERIOD, i))
    read = each.select("doc_id", "idx", "found", F.when(date, "date").otherwise("period").alias("kind"), part(2).cast("int").alias("n"), _unit(part(3)).alias("unit"))
    lo, hi = bounds(F.col("n"), F.col("unit"))
    is_date = F.col("kind") == "date"
    what = F.when(is_date, F.col("found")).otherwise(F.concat_ws(" ", F.col("n").cast("string"), "unit"))
    return read.select("doc_id", "idx", "kind", what.alias("what"), F.when(is_date, checks.date_of(F.col("found"))).alias("day"), lo.alias("lo"), hi.alias("hi"))


def section(rows: DataFrame, most: int = 8) -> DataFrame:
    """The first rows of each document's table where it has two or more, and how many are left out."""
    w = Window.partitionBy("doc_id")
    ranked = rows.withColumns({"place": F.row_number().over(w.orderBy("idx", "kind", "what")), "all": F.count(F.lit(1)).over(w)})
    return ranked.where((F.col("all") >= 2) & (F.col("place") <= most)).select("doc_id", "place", "what", F.greatest(F.col("all") - most, F.lit(0)).alias("left_out"))


def only_length(rows: DataFrame) -> DataFrame:
    """(doc_id, lo): the one length that a document's periods agree on, else null."""
    return rows.groupBy("doc_id").agg(F.when(F.count_distinct("lo", "hi") == 1, F.min("lo")).alias("lo"))


def out_of_order(blocks: DataFrame) -> DataFrame:
    """(doc_id, earlier_idx, later_idx, days): pairs of dated lines, one after the other, that go back in time."""
    w = Window.partitionBy("doc_id").orderBy("idx", "anchor")
    found = checks.dates(blocks).withColumns({"next_idx": F.lead("idx").over(w), "next_day": F.lead("day").over(w)})
    return found.where("next_day < day").select("doc_id", F.col("idx").alias("earlier_idx"), F.col("next_idx").alias("later_idx"), F.datediff("day", "next_day").alias("days"))


def timeline(blocks: DataFrame) -> DataFrame:
    """(doc_id, place, day, what): dated events in order of time; of one day, in order of the text."""
    w = Window.partitionBy("doc_id").orderBy("day", "idx", "anchor")
    return checks.dates(blocks).select("doc_id", F.row_number().over(w).alias("place"), "day", F.col("anchor").alias("what"))


def stated_twice(blocks: DataFrame) -> DataFrame:
    """(doc_id, anchor, n): events from which two periods count that cannot be the same on any reading."""
    a, b = anchored(blocks).alias("a"), anchored(blocks).alias("b")
    apart = a.join(b, (F.col("a.doc_id") == F.col("b.doc_id")) & (F.col("a.anchor") == F.col("b.anchor")) & (F.col("a.hi") < F.col("b.lo")))
    return apart.groupBy(F.col("a.doc_id").alias("doc_id"), F.col("a.anchor").alias("anchor")).agg(F.count(F.lit(1)).alias("n"))


def calendar(blocks: DataFrame) -> DataFrame:
    """(doc_id, uid, day, summary): calendar events with ids that stay the same from run to run."""
    found = checks.dates(blocks)
    uid = F.substring(F.sha2(F.concat_ws("|", F.col("doc_id").cast("string"), F.col("idx").cast("string"), "anchor").cast("binary"), 256), 1, 32)
    return found.select("doc_id", uid.alias("uid"), "day", F.concat(F.lit("Line "), F.col("idx").cast("string"), F.lit(": "), "anchor").alias("summary"))


def calendar_file(events: DataFrame) -> DataFrame:
    """(doc_id, ics): an iCalendar text for each document, with an alarm a week ahead of each event."""
    date = F.date_format("day", "yyyyMMdd")
    event = F.concat_ws("\r\n", F.lit("BEGIN:VEVENT"), F.concat(F.lit("UID:"), "uid"), F.concat(F.lit("DTSTART;VALUE=DATE:"), date), F.concat(F.lit("SUMMARY:"), F.replace("summary", F.lit(","), F.lit("\\,"))), F.lit("BEGIN:VALARM"), F.lit("TRIGGER:-P7D"), F.lit("ACTION:DISPLAY"), F.lit("END:VALARM"), F.lit("END:VEVENT"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("day", "uid", event.alias("e")))), lambda x: x["e"]), "\r\n")
    return events.groupBy("doc_id").agg(F.concat_ws("\r\n", F.lit("BEGIN:VCALENDAR"), F.lit("VERSION:2.0"), F.lit("PRODID:-//docketmill//deadlines//EN"), body, F.lit("END:VCALENDAR"), F.lit("")).alias("ics"))


def asked_period(text: Column, today: Column) -> tuple[Column, Column]:
    """First and last day of a period asked for in words: last month, this month, or a month and year."""
    month = F.regexp_extract(text, r"\b((?:" + "|".join(checks.MONTHS) + r") \d{4})\b", 1)
    named = F.try_to_date(F.concat(F.lit("1 "), month), "d MMMM yyyy")
    first = F.when(month != "", named).when(F.lower(text).contains("last month"), F.add_months(F.trunc(today, "month"), -1)).when(F.lower(text).contains("this month"), F.trunc(today, "month"))
    return first.cast("date"), F.last_day(first)


def words_to_days(words: Column, unit: Column) -> Column:
    """Least days of a period whose number is in words."""
    return bounds(number_of(words), _unit(unit))[0]
