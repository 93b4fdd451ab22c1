"""Benchmark decontamination by pigeonhole edit matching.

A test item that occurs in a text with at most e edits, cut into e + 1 pieces, leaves one piece untouched. All
pieces of all items are found at once by an automaton; where one is hit, its item is verified with Myers'
bit-parallel edit distance.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketmill.llm.common import cut

#: Edits allowed to each character of an item, and the size from which an item is searched for with edits: a shorter
#: one has to stand exactly, between ends of words, as a few letters are near anything.
BUDGET, SHORT = 0.08, 20
#: Characters of items that one automaton holds, blocks that a worker takes in one reading of the documents, and
#: characters of texts that it gathers to look for one block after another.
BLOCK_CHARS, BLOCKS, GATHERED = 1_000_000, 64, 16_000_000


def normalise(text: str) -> str:
    """Lower case, one blank for each run of white space; only white space changes the length."""
    low = text.lower()
    if len(low) != len(text):
        low = "".join(x if len(x := c.lower()) == 1 else c for c in text)
    return " ".join(low.split())


def spans_in(text: str, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans of a normalised text as spans of the text itself."""
    starts, shift, at = [], [], 0
    for word in re.finditer(r"\S+", text):
        starts.append(at)
        shift.append(word.start() - at)
        at += word.end() - word.start() + 1
    from bisect import bisect_right

    place = lambda i: i + shift[bisect_right(starts, i) - 1]
    return [(place(a), place(b - 1) + 1) for a, b in spans]


def _apart(text: str, a: int, b: int) -> bool:
    """Whether a stretch of a text neither begins nor ends within a word."""
    inside = lambda i: 0 < i < len(text) and text[i - 1].isalnum() and text[i].isalnum()
    return not inside(a) and not inside(b)


class Item:
    """A normalised test item, ready to be searched for."""

    def __init__(self, text: str, budget: float, short: int = SHORT):
        self.text, self.size, self.exact = text, len(text), len(text) < short
        self.most = 0 if self.exact else int(len(text) * budget)
        self.forward, self.backward = self._masks(text), self._masks(text[::-1])
        self.grams = [text[i : i + 3] for i in range(self.size - 2)]

    @staticmethod
    def _masks(text: str) -> dict[str, int]:
        found: dict[str, int] = defaultdict(int)
        for i, c in enumerate(text):
            found[c] |= 1 << i
        return dict(found)

    def pieces(self) -> Iterator[tuple[int, str]]:
        n = self.most + 1
        cuts = [i * self.size // n for i in range(n + 1)]
        return ((a, self.text[a:b]) for a, b in zip(cuts, cuts[1:], strict=False))

    def may_match(self, window: str) -> bool:
        """Each edit destroys at most three of the item's trigrams; the others must stand in the window."""
        there = {window[i : i + 3] for i in range(len(window) - 2)}
        return sum(g in there for g in self.grams) >= len(self.grams) - 3 * self.most

    def _distances(self, masks: dict[str, int], text: str, anchored: bool) -> Iterator[int]:
        """Myers: the least distance of the item to a part of the text that ends at each position, or to all
        of the text so far if anchored."""
        full, top = (1 << self.size) - 1, 1 << (self.size - 1)
        up, down, score = full, 0, self.size
        for c in text:
            eq = masks.get(c, 0)
            across = (((eq & up) + up) ^ up) | eq
            more, less = down | (~(across | up) & full), up & across
            score += bool(more & top) - bool(less & top)
            more, less = more << 1 | anchored, less << 1
            straight = eq | down
            up, down = (less | ~(straight | more)) & full, more & straight & full
            yield score

    def find(self, text: str) -> tuple[int, int, int] | None:
        """(start, end, distance) of the nearest part of the text within the budget: the first of the nearest,
        and the shortest of those that end there."""
        if not self.may_match(text):
            return None
        best, end = min(((d, i + 1) for i, d in enumerate(self._distances(self.forward, text, False))), default=(self.most + 1, 0))
        if best > self.most:
            return None
        back = text[max(0, end - self.size - best) : end][::-1]
        size = next((i + 1 for i, d in enumerate(self._distances(self.backward, back, True)) if d == best), 0)
        return end - size, end, best


class Matcher:
    """Finds a block of items, [(number, text)], in texts."""

    def __init__(self, items: list[tuple[int, str]], budget: float, short: int):
        ids = defaultdict(list)
        for key, text in items:
            if norm := normalise(text):
                ids[norm].append(key)
        self.ids, self.items = list(ids.values()), [Item(t, budget, short) for t in ids]
        places = defaultdict(list)
        for k, item in enumerate(self.items):
            for at, piece in item.pieces():
                places[piece].append((k, at))
        self.automaton = ahocorasick.Automaton()
        for piece, found in places.items():
            self.automaton.add_word(piece, (len(piece), found))
        if places:
            self.automaton.make_automaton()

    def __call__(self, text: str | None) -> list[tuple[int, int, int, int]]:
        """(item's number, start, end, distance) of each place: code points of the text, end exclusive."""
        if not text or not self.items:
            return []
        norm = normalise(text)
        hits: dict[int, list[int]] = defaultdict(list)
        for last, (size, found) in self.automaton.iter(norm):
            for k, at in found:
                hits[k].append(last + 1 - size - at)
        out = set()
        for k, starts in hits.items():
            item, lo, hi = self.items[k], None, None
            if item.exact:
                out.update((k, s, s + item.size, 0) for s in starts if _apart(norm, s, s + item.size))
                continue
            for s in [*sorted(starts), None]:
                if lo is not None and (s is None or s - lo > item.most):
                    base = max(0, lo - item.most)
                    if got := item.find(norm[base : hi + item.size + item.most]):
                        out.add((k, base + got[0], base + got[1], got[2]))
                    lo = None
                lo, hi = (s if lo is None else lo), s
        out = sorted(out)
        places = spans_in(text, [(a, b) for _, a, b, _ in out]) if out else []
        return [(key, a, b, d) for (k, _, _, d), (a, b) in zip(out, places, strict=True) for key in self.ids[k]]


def blocks(items: DataFrame, *, key: str = "item_id", text: str = "text", most: int = BLOCK_CHARS, together: int = BLOCKS) -> Iterator[list[list[tuple]]]:
    """The items (id, text) in groups of `together` blocks of about `most` characters: the driver holds one group."""
    rows = items.where(F.col(text).isNotNull()).select(F.col(key).alias("k"), F.col(text).alias("t"))
    n = max(1, -(-(rows.agg(F.sum(F.length("t"))).first()[0] or 0) // most))
    for first in range(0, n, together):
        group = defaultdict(list)
        for r in rows.select("k", "t", F.pmod(F.xxhash64("k", "t"), F.lit(n)).alias("b")).where(F.col("b").between(first, first + together - 1)).collect():
            group[r.b].append((r.k, r.t))
        yield list(group.values())


def matches(text: Column, group: list[list[tuple]], kind: str, budget: float = BUDGET, short: int = SHORT) -> Column:
    """The places of a group's items in a text, as an array of (item_id, start, end, distance), item_id of type `kind`.

    One block's automaton stays with the worker. Of several, each is built in turn for GATHERED characters of texts,
    so that a worker never holds more than one.
    """
    whole = f"array<struct<item_id: {kind}, start: bigint, end: bigint, distance: int>>"
    kept: list[Matcher] = []

    def matcher(block: list[tuple]) -> Matcher:
        if len(group) > 1 or not kept:
            kept.clear()
            kept[:] = [Matcher([(i, t) for i, (_, t) in enumerate(block)], budget, short)]
        return kept[0]

    def found(texts: list[str | None]) -> list[list[dict]]:
        out: list[list[dict]] = [[] for _ in texts]
        for block in group:
            find = matcher(block)
            for i, t in enumerate(texts):
                out[i] += [dict(zip(("item_id", "start", "end", "distance"), (block[m[0]][0], *m[1:]), strict=True)) for m in find(t)]
        return out

    @F.pandas_udf(whole)
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            texts, out, at = [None if t is None else t for t in batch], [], 0
            while at < len(texts):
                end, size = at, 0
                while end < len(texts) and size < GATHERED:
                    size += len(texts[end] or "")
                    end += 1
                out += found(texts[at:end])
                at = end
            yield pd.Series(out, dtype=object)

    return of(text)


def contamination(docs: DataFrame, items: DataFrame, *, key: str = "doc_id", text: str = "text", budget: float = BUDGET, short: int = SHORT) -> DataFrame:
    """(key, item_id, start, end, distance): one row for each place of a test item in a row of `docs`.

    Texts are compared in lower case with runs of white space as one blank. An item is found with up to
    budget x length edits, one of under `short` characters only as it is and between ends of words. Items without a
    word and null items stand nowhere. Keys and item ids keep their types. Equal items are all reported. Null and
    empty texts match nothing; a null key is kept; repeated rows are reported each.
    The documents are not shuffled, whatever they hold. They are read once for each BLOCKS million characters of
    items; where that is more than once, what each reading finds is written before the next, and the driver holds
    the items of one reading.
    """
    kind, out, rest = dict(items.dtypes)["item_id"], None, None
    for group in blocks(items):
        if rest is not None:
            out = cut(rest) if out is None else out.union(cut(rest))
        rest = docs.select(F.col(key).alias("k"), F.inline(matches(F.col(text), group, kind, budget, short)))
    return (rest if out is None else out.union(cut(rest))).withColumnRenamed("k", key)


def clean(docs: DataFrame, items: DataFrame, *, text: str = "text", budget: float = BUDGET) -> DataFrame:
    """The rows of `docs`, all columns, in which no test item is found."""
    kind, seen = dict(items.dtypes)["item_id"], 0
    for group in blocks(items):
        docs = (cut(docs) if seen else docs).where(F.size(matches(F.col(text), group, kind, budget)) == 0)
        seen += 1
    return docs
