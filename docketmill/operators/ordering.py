"""The order of a document's events: days that its dates and periods allow each event, and contradictions among them.

An event is a named date. What is said of it is a day, or a distance from another event; a month is a distance of 28 to 31
days, so each event has a first and a last possible day, and a contradiction is one only if it holds on any reading.
"""

from __future__ import annotations

import datetime as dt
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketmill.functions.text import all_of, date_of
from docketmill.operators import checks, deadlines
from docketmill.operators.reading import Document, Line, _day, _p, read_whole
from docketmill.tables import dropped, written

UNITS = r"(days?|weeks?|months?|years?)"
NAME = r"([A-Z][A-Za-z]+(?: [A-Z][a-z]+)*)"
#: The day of signing; a distance at the beginning of a meaning, and anywhere in a line; the length of a named term; notice
#: that has to come before the end of one; names of the day after which nobody has to wait any longer.
SIGNED = rf"\b(?:[Dd]ated|made on|signed on) ({checks.DAY_FIRST[2:-2]})\b"
MEANT = rf"^(?:the day )?(\d{{1,4}}) {UNITS} (after|before) (?:the )?{NAME}"
DISTANCE = rf"\b(\d{{1,4}}) {UNITS} (after|before) (?:the )?{NAME}"
LENGTH = rf"\b(?:The |An? )?((?:[A-Z][a-z]+ )*(?:Term|Period)) (?:is|of|lasts|lasts for) (\d{{1,4}}) {UNITS}\b"
BEFORE_END = rf"\b(\d{{1,4}}) {UNITS} before the end of (?:the )?((?:[A-Z][a-z]+ )*(?:Term|Period))\b"
STOP = r"^(?:Long Stop|Backstop|Outside|Drop Dead)(?: Date)?$"
SIGNING = "signing"
FLAGS = {
    "claims end before release": 2, "remedy outlasts notice": 2, "stop before event": 1, "event before signing": 2, "notice longer than term": 1, "stop before signing": 1, "term stated twice": 2, "no day fits": 1,
}


def _rows(lines: DataFrame, pattern: str, *names: str) -> DataFrame:
    """(doc_id, idx, *names): the groups of each match."""
    groups = F.arrays_zip(*(all_of(F.col("text"), pattern, i + 1).alias(n) for i, n in enumerate(names)))
    return lines.where(F.col("text").rlike(pattern)).select("doc_id", "idx", F.inline(groups))


def _bounded(rows: DataFrame) -> DataFrame:
    """rows (.., n, unit) with the least and most days of the period."""
    lo, hi = deadlines.bounds(F.col("n").cast("int"), F.regexp_replace("unit", "s$", ""))
    return rows.withColumns({"lo": lo.cast("int"), "hi": hi.cast("int")})


def _number(day: Column) -> Column:
    return F.unix_date(day)


def stated(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((doc_id, event, lo, hi) of events with a day, (doc_id, event, anchor, least, most) of events at a distance): the day
    of signing, and terms whose meaning is a day or a distance from another term."""
    signed = _rows(lines, SIGNED, "day").groupBy("doc_id").agg(F.min_by("day", "idx").alias("day")).select("doc_id", F.lit(SIGNING).alias("event"), date_of(F.col("day")).alias("day"))
    meant = written(checks.definitions(lines).where("how = 'stated'").select("doc_id", F.col("term").alias("event"), "meaning"))
    days = meant.where(F.col("meaning").rlike("^" + checks.DAY_FIRST[2:])).select("doc_id", "event", date_of(F.regexp_extract("meaning", "^" + checks.DAY_FIRST[2:], 0)).alias("day"))
    known = signed.union(days).where("day is not null").select("doc_id", "event", _number(F.col("day")).alias("day"))
    known = known.groupBy("doc_id", "event").agg(F.max("day").alias("lo"), F.min("day").alias("hi"))
    part = lambda i: F.regexp_extract("meaning", MEANT, i)
    far = _bounded(meant.where(F.col("meaning").rlike(MEANT)).select("doc_id", "event", part(4).alias("anchor"), part(3).alias("way"), part(1).alias("n"), part(2).alias("unit")))
    after = F.col("way") == "after"
    return known, far.select("doc_id", "event", "anchor", F.when(after, F.col("lo")).otherwise(-F.col("hi")).alias("least"), F.when(after, F.col("hi")).otherwise(-F.col("lo")).alias("most"))


def tightened(known: DataFrame, far: DataFrame) -> DataFrame:
    """(doc_id, event, lo, hi): the first and last day of each event that its day and all distances allow, as day numbers.

    Distances go on from what changed in the last round only; an event said to be on several days has the days common
    to all. One with none (lo above hi) stays as it is, and nothing goes on from it any more; what went on in earlier
    rounds, when a day still fitted, stays. A round can only narrow what it changes, so circles end; each is written
    before the next.
    """
    far, bounds = written(far), written(known)
    front = bounds
    while True:
        new = far.join(front.where("lo <= hi").select("doc_id", F.col("event").alias("anchor"), "lo", "hi"), ["doc_id", "anchor"])
        new = new.groupBy("doc_id", "event").agg(F.max(F.col("lo") + F.col("least")).alias("new_lo"), F.min(F.col("hi") + F.col("most")).alias("new_hi"))
        both = new.join(bounds, ["doc_id", "event"], "left").where("lo is null or lo <= hi")
        lo, hi = F.coalesce(F.greatest("new_lo", "lo"), "new_lo"), F.coalesce(F.least("new_hi", "hi"), "new_hi")
        front = written(both.where(F.col("lo").isNull() | (lo > F.col("lo")) | (hi < F.col("hi"))).select("doc_id", "event", lo.alias("lo"), hi.alias("hi")))
        if front.isEmpty():
            return bounds
        old = bounds
        bounds = written(old.join(front, ["doc_id", "event"], "left_anti").union(front))
        dropped(old)


class TimedLine(Line):
    """What a line says of times."""

    @cached_property
    def signed(self) -> list[str]:
        return _p(SIGNED).findall(self.text)

    @cached_property
    def terms(self) -> tuple[list[tuple[str, int]], list[tuple[str, str, int, int]]]:
        """((event, day) of terms that mean a day, (event, anchor, least, most) of those at a distance)"""
        days, far = [], []
        for term, meaning, how in self.defined:
            if how == "stated" and (m := _p("^" + checks.DAY_FIRST[2:]).search(meaning)) and (day := _day(m[0])):
                days.append((term, _since(day)))
            if how == "stated" and (m := _p(MEANT).search(meaning)):
                lo, hi = _length(m[1], m[2])
                far.append((term, m[4], lo, hi) if m[3] == "after" else (term, m[4], -hi, -lo))
        return days, far

    @cached_property
    def distances(self) -> list[tuple[str | None, str, int, int, str]]:
        """(kind, anchor, lo, hi, as it is said) of distances after an event"""
        if not (before := _p(rf"^(.*?){DISTANCE}").search(self.text)):
            return []
        kind = deadlines.kind_in(before[1], "")
        return [(kind, anchor, *_length(n, unit), f"{n} {unit}") for n, unit, way, anchor in _p(DISTANCE).findall(self.text) if way == "after"]

    @cached_property
    def told(self) -> list[tuple[str, int, int, str]]:
        """(kind, lo, hi, as it is said) of remedies and notices"""
        periods = deadlines.classified_in(self.text)
        return [(kind, *_length(n, unit), f"{n} {unit}") for kind, n, unit in periods if kind in ("remedy", "ending")]

    @cached_property
    def lengths(self) -> list[tuple[str, int, int, str]]:
        return [(name, *_length(n, unit), f"{n} {unit}") for name, n, unit in _p(LENGTH).findall(self.text)]

    @cached_property
    def before_end(self) -> list[tuple[str, int, str]]:
        return [(name, _length(n, unit)[0], f"{n} {unit}") for n, unit, name in _p(BEFORE_END).findall(self.text)]


def _since(day: dt.date) -> int:
    return (day - dt.date(1970, 1, 1)).days


def _length(n: str | int, unit: str) -> tuple[int, int]:
    lo, hi = deadlines.DAYS[unit.removesuffix("s")]
    return int(n) * int(lo), int(n) * int(hi)


def _tightened(bounds: dict[str, tuple[int, int]], far: list[tuple[str, str, int, int]]) -> dict[str, tuple[int, int]]:
    """tightened() of one document, in its rounds."""
    bounds, front = dict(bounds), bounds
    while front:
        new: dict[str, tuple[int, int]] = {}
        for event, anchor, least, most in far:
            lo, hi = front.get(anchor, (1, 0))
            if lo <= hi:
                was = new.get(event, (lo + least, hi + most))
                new[event] = max(was[0], lo + least), min(was[1], hi + most)
        front = {}
        for event, (lo, hi) in new.items():
            old = bounds.get(event)
            if old is None or (old[0] <= old[1] and (lo > old[0] or hi < old[1])):
                front[event] = (lo, hi) if old is None else (max(lo, old[0]), min(hi, old[1]))
        bounds |= front
    return bounds


def _contradictions(doc: Document) -> list[tuple[str, int, str, str]]:
    """The rows (kind, severity, what, other) of contradictions(). Rows without a key belong to no document."""
    known, far = {}, []
    said = next((line.signed[0] for _, line in doc.lines if line.signed), None)
    for event, day in [(SIGNING, _since(day))] if said and (day := _day(said)) else []:
        known[event] = (day, day)
    for _, line in doc.lines:
        for event, day in line.terms[0]:
            lo, hi = known.get(event, (day, day))
            known[event] = max(lo, day), min(hi, day)
        far += line.terms[1]
    bounds = _tightened(known, far if doc.key is not None else [])
    out = [("no day fits", event, "") for event, (lo, hi) in bounds.items() if lo > hi]
    if doc.key is None:
        return [(kind, FLAGS[kind], *row) for kind, *row in out]

    fit = {event: b for event, b in bounds.items() if b[0] <= b[1]}
    stops = {event for event in fit if _p(STOP).search(event)}
    stop = min(((fit[event][1], event) for event in stops), default=None)
    signed = fit[SIGNING][0] if SIGNING in fit else None
    for event, (lo, hi) in fit.items():
        if event in stops:
            if signed is not None and hi < signed:
                out.append(("stop before signing", event, SIGNING))
        elif event != SIGNING:
            if stop and stop[0] < lo:
                out.append(("stop before event", event, stop[1]))
            if signed is not None and hi < signed:
                out.append(("event before signing", event, SIGNING))

    held: dict[str, tuple[int, str]] = {}
    distances = [d for _, line in doc.lines for d in line.distances]
    for kind, anchor, lo, _, shown in distances:
        if kind == "holdback":
            held[anchor] = max(held.get(anchor, (lo, shown)), (lo, shown))
    for anchor, hi, shown in {(anchor, hi, shown) for kind, anchor, _, hi, shown in distances if kind == "claim"}:
        if anchor in held and hi < held[anchor][0]:
            out.append(("claims end before release", shown, held[anchor][1]))

    part, notices, remedies = None, {}, set()
    for (_, line), clause in zip(doc.lines, doc.clauses, strict=True):
        part = line.title or part
        for kind, lo, hi, shown in line.told:
            if kind == "ending":
                notices[part, clause] = min(notices.get((part, clause), (hi, shown)), (hi, shown))
            else:
                remedies.add((part, clause, lo, shown))
    for part, clause, lo, shown in remedies:
        if (part, clause) in notices and lo > notices[part, clause][0]:
            out.append(("remedy outlasts notice", shown, notices[part, clause][1]))

    lengths: dict[str, list[tuple[int, str, int, int]]] = {}
    for idx, line in doc.lines:
        for name, lo, hi, shown in line.lengths:
            lengths.setdefault(name, []).append((idx, shown, lo, hi))
    for name, each in lengths.items():
        _, first, first_lo, first_hi = min(each)
        out += [("term stated twice", f"{name} {shown}", first) for shown in {shown for _, shown, lo, hi in each if first_lo > hi or lo > first_hi}]
    for name, lo, shown in {n for _, line in doc.lines for n in line.before_end}:
        each = lengths.get(name, [])
        if len({x[2:] for x in each}) == 1 and lo > each[0][3]:
            out.append(("notice longer than term", shown, f"{name} {min(x[1] for x in each)}"))
    return [(kind, FLAGS[kind], *row) for kind, *row in out]


def contradictions(lines: DataFrame, *, together: bool = False) -> DataFrame:
    """(doc_id, kind, severity, what, other): what of a document's times can't be on any reading.

    Claims that end before what is held back for them is released; a remedy that takes longer than the notice that ends the
    agreement, in one clause; a long stop date before an event or before signing; an event before signing; notice that is
    longer than the term before whose end it is given; a term of two lengths; an event that no day fits. Each row is
    held against the one that contradicts it most (the earliest stop, the longest release, the shortest notice), so
    there is one finding for a row and never a pair of all. Documents without such rows give none.

    Each document is read once, so nothing is joined, broadcast or written on the way. `together`: the lines of each document
    stand in a row already.
    """
    return read_whole(lines, _contradictions, {"kind": "string", "severity": "int", "what": "string", "other": "string"}, together=together, kind=TimedLine)
