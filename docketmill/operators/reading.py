"""The checks of checks.py over whole documents: each is read once, line after line, and all its findings come out of that.

Where all checks are wanted, this is one pass over the lines in Arrow batches, with no shuffle but the one that brings a
document's lines together; each check by itself is a column expression in checks.py. What a line holds by itself is worked
out once for lines that come up again.
"""

from __future__ import annotations

import datetime as dt
import re
from collections import Counter
from collections.abc import Callable, Iterator
from functools import cached_property, lru_cache
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketmill.functions.text import MONTHS, NUMBER, NUMBERS, SCALES
from docketmill.operators import checks as C
from docketmill.operators import structure as S
from docketmill.ship import ship

#: Lines whose facts are kept, each of at most so many characters.
MOST_KEPT, LONGEST_KEPT = 20_000, 1_000
Finding = tuple[int, str, int, "str | None", "str | None"]
_p = lru_cache(None)(lambda pattern: re.compile(pattern, re.ASCII))
DAYS = "Monday Tuesday Wednesday Thursday Friday Saturday Sunday".split()
VALUES = {w: v for w, v in NUMBERS.items() if "-" not in w} | {"hundred": 100} | SCALES


def _int(digits: str) -> int | None:
    return n if (n := int(digits)) < 1 << 31 else None


def _day(text: str) -> dt.date | None:
    """date_of()"""
    month, other = (re.search(p, text) for p in (C.MONTH, r"^\d{1,2}(?= )|\d{1,2}(?=,)"))
    try:
        return dt.date(int(text[-4:]), MONTHS.index(month[0]) + 1, int(other[0]))
    except ValueError:
        return None


def _written(day: dt.date | None) -> str:
    return "" if day is None else f"{day.day} {MONTHS[day.month - 1]} {day.year}"


def value_of(words: str) -> int | None:
    """number_of()"""
    plain = _p(r"\band ").sub("", _p(r"[\s-]+").sub(" ", words.strip(" ").lower() + " "))
    if len(plain) < 2 or not _p(NUMBER).search(plain):
        return None
    every = now = 0
    for v in (VALUES[w] for w in plain.split(" ") if w):
        if v >= 1000:
            every, now = every + max(now, 1) * v, 0
        else:
            now = now + v if v < 100 else max(now, 1) * v
    return every + now


def _spaced(text: str, letters: str) -> str:
    return f" {_p(f'[^{letters}0-9{chr(39)}’-]+').sub(' ', text)} "


class Line:
    """What a line holds by itself; each fact is worked out when it is first asked for."""

    def __init__(self, text: str):
        self.text = text

    @cached_property
    def number(self) -> int | None:
        return _int(m[1]) if (m := _p(S.NUMBER).search(self.text)) else None

    @cached_property
    def title(self) -> str | None:
        return m[1] if (m := _p(S.SCHEDULE).search(self.text)) else None

    @cached_property
    def defined(self) -> list[tuple[str, str | None, str]]:
        """definitions(): (term, meaning, how)"""
        p = _p(C.QUOTE).split(self.text)
        of = lambda i: p[i] if 0 <= i < len(p) else None
        joined = lambda x, far: far if far is not None and _p(C.JOINED).search(x) else x
        found = []
        for k in range((len(p) - 1) // 2):
            if not _p(C.TERM).search(p[2 * k + 1]):
                continue
            before, after = joined(p[2 * k], of(2 * k - 2)), joined(p[2 * k + 2], of(2 * k + 4))
            if _p(C.ELSEWHERE).search(after):
                found.append((p[2 * k + 1], 1, k, None))
            elif _p(C.SAYS).search(after):
                found.append((p[2 * k + 1], 2, k, _p(C.SAYS + r"\s*([^;]*)").search(after)[1].strip(" ")))
            elif _p(C.NAMES).search(before) and not _p(C.WRITTEN).search(before):
                found.append((p[2 * k + 1], 3, k, None))
            elif _p(C.HEAD).search(before) and _p(C.MARK).search(after):
                found.append((p[2 * k + 1], 4, k, None))
        least = {}
        for term, rank, _, meaning in sorted(found, key=lambda x: x[:3]):
            least.setdefault(term, (term, meaning, C.HOW[rank - 1]))
        return list(least.values())

    @cached_property
    def phrases(self) -> list[str]:
        return _p(C.PHRASE).findall(self.text)

    @cached_property
    def words(self) -> list[str]:
        return _p(C.WORD).findall(self.text)

    @cached_property
    def spaced(self) -> str:
        return _spaced(self.text, "A-Za-z")

    @cached_property
    def pointers(self) -> list[tuple[str, int | None]]:
        return [(w, _int(n)) for w, n in _p(S.POINTER).findall(self.text)]

    @cached_property
    def named(self) -> list[str]:
        return [] if self.title else list(dict.fromkeys(_p(r"\bSchedule \d+\b").findall(self.text)))

    @cached_property
    def blanks(self) -> list[str]:
        return _p(C.BLANK).findall(self.text)

    @cached_property
    def amounts(self) -> list[tuple[str, str]]:
        found = []
        if _p(r"\([\da-z]").search(self.text):
            for pattern, words, figures in C.AMOUNT:
                for m in _p(pattern).finditer(self.text):
                    value, shown = value_of(m[words]), int(m[figures].replace(",", ""))
                    if value is not None and value != shown:
                        found.append((m[0], f"words say {value}"))
        return found

    @cached_property
    def notations(self) -> list[tuple[str, str]]:
        return [known for known, pattern in C.NOTATIONS.items() if _p(pattern).search(self.text)]

    @cached_property
    def dates(self) -> list[tuple[str, str, dt.date | None, int]]:
        """dates(): (anchor, style, day), and where they stand"""
        return [(m[0], style, _day(m[0]), m.start()) for pattern, style in ((C.DAY_FIRST, "day first"), (C.MONTH_FIRST, "month first")) for m in _p(pattern).finditer(self.text)]

    @cached_property
    def weekdays(self) -> list[tuple[str, str]]:
        each = ((said, on, _day(on)) for said, on in _p(C.WEEKDAY).findall(self.text))
        return [(f"{said}, {on}", f"was a {DAYS[day.weekday()]}") for said, on, day in each if day and DAYS[day.weekday()] != said]

    @cached_property
    def companies(self) -> list[tuple[str, str]]:
        return [(base.strip(" "), suffix) for base, suffix in _p(C.COMPANY).findall(self.text)]

    @cached_property
    def punctuation(self) -> list[tuple[str, str, str]]:
        text, words = self.text, _p("[a-z]+").findall(self.text.lower())
        found = [("repeated word", f"{a} {b}", "written twice") for a, b in zip(words, words[1:], strict=False) if a == b and len(a) > 1]
        for kind, pattern, maybe in (("space before mark", r"\S+ [,;:.](?:\s|$)", any(f" {m}" in text for m in ",;:.")), ("double space", r"\S+  +\S+", "  " in text), ("no space after comma", "[A-Za-z]+,[A-Za-z]+", "," in text)):
            if maybe:
                found += [(kind, x.strip(" "), "spacing") for x in _p(pattern).findall(text)]
        return found

    @cached_property
    def notice(self) -> int | None:
        return int(m[1]) if (m := _p(r"\b(\d{1,4}) days notice\b").search(self.text)) else None

    @cached_property
    def months(self) -> int | None:
        said = _p(r"\bterm of this Agreement is \d{1,4} months\b").search(self.text)
        return int(_p(r"term of this Agreement is (\d{1,4}) months").search(self.text)[1]) if said else None


class Document:
    """The lines of a document in order, and what hangs on all of them. Rows without a key belong to no document: what joins
    lines on it finds nothing there."""

    def __init__(self, key, lines: list[tuple[int, Line]]):
        self.key, self.lines = key, lines

    @cached_property
    def clauses(self) -> list[int]:
        """The clause in force at each line, 0 before the first; a part of the same name goes on where it was."""
        part, now, found = None, {}, []
        for _, line in self.lines:
            part = line.title or part
            if line.number is not None:
                now[part] = line.number
            found.append(now.get(part, 0))
        return found

    @cached_property
    def numbered(self) -> list[tuple[str | None, int, int]]:
        """(part, number, idx)"""
        part, found = None, []
        for idx, line in self.lines:
            part = line.title or part
            if line.number is not None:
                found.append((part, line.number, idx))
        return found

    @cached_property
    def defined(self) -> list[tuple[int, int, str, str | None, str]]:
        """(place among the lines, idx, term, meaning, how)"""
        return [(at, idx, *d) for at, (idx, line) in enumerate(self.lines) for d in line.defined]

    @cached_property
    def stated(self) -> list[tuple[int, int, str, str]]:
        return [d[:4] for d in self.defined if d[4] == "stated"]


def blanks(doc: Document) -> Iterator[Finding]:
    for idx, line in doc.lines:
        for anchor in line.blanks:
            yield idx, "blank", 1, anchor, "left blank"


def unused_terms(doc: Document) -> Iterator[Finding]:
    if len(doc.lines) >= C.UNUSED_FROM and doc.key is not None:
        for _, at, term, _ in doc.stated:
            if not any(term in line.text and idx != at for idx, line in doc.lines):
                yield at, "unused term", 3, term, "defined but never used"


def early_terms(doc: Document, gap: int = 2) -> Iterator[Finding]:
    homes: dict[str, int] = {}
    for at, _, term, _ in doc.stated if doc.key is not None else ():
        homes[term] = min(doc.clauses[at], homes.get(term, doc.clauses[at]))
    for term, home in homes.items():
        if home >= gap:
            used = [idx for (idx, line), clause in zip(doc.lines, doc.clauses, strict=True) if clause + gap <= home and term in line.text]
            if used:
                yield min(used), "early term", 2, term, f"defined only in clause {home}"


def repeated_definitions(doc: Document) -> Iterator[Finding]:
    first: dict[str, str] = {}
    for _, idx, term, meaning in doc.stated:
        if term not in first:
            first[term] = meaning
        elif meaning.strip(" ").lower() == first[term].strip(" ").lower():
            yield idx, "repeated definition", 3, term, "defined twice alike"
        else:
            yield idx, "repeated definition", 1, term, "defined twice differently"


def undefined_terms(doc: Document, most: int = 5) -> Iterator[Finding]:
    seen: dict[str, list[int]] = {}
    for idx, line in doc.lines:
        for phrase in line.phrases:
            seen.setdefault(phrase, []).append(idx)
    terms = {d[2] for d in doc.defined} if doc.key is not None else set()
    often = sorted((min(at), phrase, len(at)) for phrase, at in seen.items() if len(at) > 1 and phrase not in terms)
    for idx, phrase, n in often[:most]:
        yield idx, "undefined term", 2, phrase, f"used {n} times"


@lru_cache(50_000)
def variants(word: str) -> frozenset[str]:
    """_variants()"""
    return frozenset((word, *(word[:i] + word[i + 1 :] for i in range(len(word)))))


def one_apart(a: str, b: str) -> bool:
    """Whether one letter put in, taken out or changed makes one of the other."""
    if len(a) > len(b):
        a, b = b, a
    at = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a != b and (a[at:] == b[at + 1 :] if len(a) < len(b) else a[at + 1 :] == b[at + 1 :])


@lru_cache(1_000)
def _meet(terms: frozenset[str]) -> dict[str, list[str]]:
    """Terms by what is left of them without a letter."""
    meet: dict[str, list[str]] = {}
    for term in terms:
        for v in variants(term):
            meet.setdefault(v, []).append(term)
    return meet


@lru_cache(50_000)
def near_terms(word: str, terms: frozenset[str]) -> tuple[str, ...]:
    """The terms that a word, itself none of them, may be meant for."""
    meet = _meet(terms)
    if word in terms or meet.keys().isdisjoint(variants(word)):
        return ()
    return tuple(t for t in {t for v in variants(word) for t in meet.get(v, ())} if one_apart(word, t) and t + "s" != word and word + "s" != t)


def misspelt_terms(doc: Document) -> Iterator[Finding]:
    terms = frozenset(d[2] for d in doc.defined if " " not in d[2]) if doc.key is not None else None
    if not terms:
        return
    close = [(idx, word, near) for idx, line in doc.lines for word in line.words if (near := near_terms(word, terms))]
    words = Counter(w for _, line in doc.lines for w in line.words) if close else {}
    for idx, word, near in close:
        if words[word] == 1:
            for term in near:
                yield idx, "misspelt term", 2, word, f"for {term}"


def lower_case_terms(doc: Document) -> Iterator[Finding]:
    own: dict[str, tuple[str, set[int]]] = {}
    for _, idx, term, _, _ in doc.defined if doc.key is not None else ():
        if " " in term:
            least, at = own.get(term.lower(), (term, set()))
            own[term.lower()] = min(least, term), at | {idx}
    for low, (term, at) in own.items():
        for idx, line in doc.lines:
            if low in line.text and idx not in at and _spaced(low, "a-z") in line.spaced:
                yield idx, "lower-case term", 3, low, f"for {term}"


def broken_references(doc: Document) -> Iterator[Finding]:
    there = {number for part, number, _ in doc.numbered if part is None} if doc.key is not None else ()
    titles = {line.title for _, line in doc.lines} if doc.key is not None else ()
    for idx, line in doc.lines:
        for word, number in line.pointers if there else ():
            if number is not None and number not in there:
                near = sorted(there, key=lambda n: (abs(n - number), n))[:3]
                yield idx, "broken reference", 1, f"{word} {number}", f"there are {', '.join(map(str, near))}"
        for title in line.named:
            if title not in titles:
                yield idx, "broken reference", 1, title, "no such schedule"


def numbering(doc: Document) -> Iterator[Finding]:
    by_part: dict[str | None, list[tuple[int, int]]] = {}
    for part, number, idx in doc.numbered:
        by_part.setdefault(part, []).append((number, idx))
    for each in by_part.values():
        each.sort()
        for (before, _), (n, idx) in zip(each, each[1:], strict=False):
            if n == before:
                yield idx, "numbering", 2, str(n), "number used twice"
            elif n > before + 1:
                yield idx, "numbering", 3, str(n), f"no {', '.join(map(str, range(before + 1, n)))}"


def amounts(doc: Document) -> Iterator[Finding]:
    for idx, line in doc.lines:
        for anchor, note in line.amounts:
            yield idx, "amount", 1, anchor, note


def currency_notation(doc: Document) -> Iterator[Finding]:
    seen: dict[str, dict[str, int]] = {}
    for idx, line in doc.lines:
        for currency, notation in line.notations:
            seen.setdefault(currency, {}).setdefault(notation, idx)
    for currency, all_ in seen.items():
        if len(all_) > 1:
            yield min(all_.values()), "currency notation", 3, currency, ", ".join(sorted(all_))


def date_styles(doc: Document) -> Iterator[Finding]:
    seen = [(idx, *d) for idx, line in doc.lines for d in line.dates]
    counted = Counter(style for _, _, style, _, _ in seen)
    if len(counted) > 1:
        # of equals the one seen first
        main = min(counted, key=lambda s: (-counted[s], min((idx, at) for idx, _, style, _, at in seen if style == s)))
        for idx, anchor, style, day, _ in seen:
            if style != main:
                shown = _written(day) if main == "day first" else None if day is None else f"{MONTHS[day.month - 1]} {day.day}, {day.year}"
                yield idx, "date style", 3, anchor, shown


def wrong_weekdays(doc: Document) -> Iterator[Finding]:
    for idx, line in doc.lines:
        for anchor, note in line.weekdays:
            yield idx, "weekday", 1, anchor, note


def contradictory_dates(doc: Document) -> Iterator[Finding]:
    opening = next((day for _, line in doc.lines if line.dates and "is made on" in line.text for _, _, day, _ in line.dates if day), None)
    for idx, line in doc.lines if opening and doc.key is not None else ():
        if line.dates and "date of this Agreement" in line.text:
            for anchor, _, day, _ in line.dates:
                if day and day != opening:
                    yield idx, "contradictory date", 1, anchor, f"opens with {_written(opening)}"


def party_names(doc: Document) -> Iterator[Finding]:
    forms: dict[str, dict[str, list[int]]] = {}
    for idx, line in doc.lines if doc.key is not None else ():
        for base, suffix in line.companies:
            forms.setdefault(base, {}).setdefault(suffix, []).append(idx)
    for base, of in forms.items():
        if len(of) > 1:
            right = max(of, key=lambda s: (len(of[s]), -of[s][0], s))
            severity = 1 if len({C.SUFFIXES[s] for s in of}) > 1 else 3
            for suffix, at in of.items():
                if suffix != right:
                    yield at[0], "party name", severity, f"{base} {suffix}", f"elsewhere {base} {right}"


def punctuation(doc: Document) -> Iterator[Finding]:
    for idx, line in doc.lines:
        for kind, anchor, note in line.punctuation:
            yield idx, kind, 3, anchor, note


def notice_and_term(doc: Document) -> Iterator[Finding]:
    months = {line.months for _, line in doc.lines if line.months is not None} if doc.key is not None else ()
    if len(months) == 1:
        for idx, line in doc.lines:
            if line.notice is not None and line.notice > 31 * min(months):
                yield idx, "time limits", 1, f"{line.notice} days notice", f"term is {min(months)} months"


#: The checks that are read here, by the name of the one in checks.py.
READ: dict[str, Callable[[Document], Iterator[Finding]]] = {
    f.__name__: f for f in (blanks, unused_terms, early_terms, repeated_definitions, undefined_terms, misspelt_terms, lower_case_terms, broken_references, numbering, amounts, currency_notation, date_styles, wrong_weekdays, contradictory_dates, party_names, punctuation, notice_and_term)
}


def first_and_capped(found: list[Finding], most: int) -> list[Finding]:
    """deduplicated() and capped() for one document."""
    text = lambda t: (t is not None, t or "")
    firsts: dict[tuple, Finding] = {}
    for f in sorted(found, key=lambda f: (f[0], f[2], text(f[4]))):
        firsts.setdefault((f[1], f[3]), f)
    kept = []
    for kind, group in groupby(sorted(firsts.values(), key=lambda f: (f[1], f[2], f[0], text(f[3]), text(f[4]))), key=lambda f: f[1]):
        each = list(group)
        kept += each[:most]
        if len(each) > most:
            kept.append((min(f[0] for f in each[most:]), kind, each[most][2], "", f"and {len(each) - most} more"))
    return kept


def documents(batches: Iterator[pa.RecordBatch], kind: type[Line] = Line) -> Iterator[Document]:
    """The documents of batches (doc_id, idx, text) in which the lines of each stand together."""
    kept: dict[str, Line] = {}
    key, lines = None, []
    for batch in batches:
        columns = [batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()]
        for k, idx, text in zip(*columns, strict=True):
            if k != key and lines:
                yield Document(key, _sorted(lines))
                lines = []
            key, text = k, text or ""
            line = kept.get(text)
            if line is None:
                line = kind(text)
                if len(text) <= LONGEST_KEPT:
                    if len(kept) >= MOST_KEPT:
                        kept.clear()
                    kept[text] = line
            lines.append((idx, line))
    if lines:
        yield Document(key, _sorted(lines))


def _sorted(lines: list[tuple[int, Line]]) -> list[tuple[int, Line]]:
    return lines if all(a[0] <= b[0] for a, b in zip(lines, lines[1:], strict=False)) else sorted(lines, key=lambda x: x[0])


def read_whole(blocks: DataFrame, read: Callable[[Document], list[tuple]], columns: dict[str, str], *, together: bool = False, kind: type[Line] = Line) -> DataFrame:
    """(doc_id, *columns): the rows that `read` makes of each document. `together` says that the lines of a document stand in one
    row after the other already; else they are brought together."""
    ship(blocks.sparkSession)
    rows = blocks.select("doc_id", "idx", "text")
    if not together:
        # a number within the document asks for its lines in order, and for no shuffle where they are dealt out by document
        rows = rows.withColumn("place", F.row_number().over(S.order()))
    types = [{"int": pa.int32(), "string": pa.string()}[t] for t in columns.values()]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, out = [], []

        def seen() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                key[:] = [batch.schema.field(0).type]
                yield batch

        made = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), key + types, strict=True)], names=["doc_id", *columns])
        for doc in documents(seen(), kind):
            out += [(doc.key, *row) for row in read(doc)]
            if len(out) >= 10_000:
                yield made()
                out = []
        if out:
            yield made()

    schema = {"doc_id": dict(rows.dtypes)["doc_id"], **columns}
    return rows.mapInArrow(each, ", ".join(f"{n} {t}" for n, t in schema.items()))


def findings(blocks: DataFrame, names: list[str], most: int | None = None, *, together: bool = False) -> DataFrame:
    """The findings of the named checks: all of them, or the first of each kind and anchor, capped."""

    def read(doc: Document) -> list[Finding]:
        found = [f for n in names for f in READ[n](doc)]
        return found if most is None else first_and_capped(found, most)

    return read_whole(blocks, read, {"idx": "int", "kind": "string", "severity": "int", "anchor": "string", "note": "string"}, together=together)
