"""Bounded-space online packing of token sequences."""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache
from itertools import chain
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketmill.llm.common import cut, slices

#: Distinct chunks of text, and parts of chunks, whose ids a worker remembers; and the longest that it does.
CHUNKS_KEPT, PARTS_KEPT, LONGEST_CHUNK = 600_000, 300_000, 48
#: Marks that are neither letters nor digits nor part of an elision: a run of them is one word to the tokenizer.
MARKS = ".,;:!?#$%&*|"
#: The rules of a tokenizer's file that let a text be cut at blanks and lower-cased beforehand. A file
#: with other rules is used on whole texts.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLIT = {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}
#: Open windows of a partition, and partitions whose leftovers one task of a merging round takes.
OPEN, FAN_IN = 32, 64
PIECE = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, sequence_length bigint, ids binary"


class Encoder:
    """Ids of whole texts. A text is cut at blanks and line ends, where a tokenizer with the rules above never joins,
    and each distinct chunk is encoded once while it is remembered; memory stays bounded, results are the tokenizer's.
    Any other tokenizer encodes whole texts."""

    def __init__(self, path: str, end: int):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.end = Tokenizer.from_file(path), end
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        rules = json.loads(self.tokenizer.to_str())
        #: Strings that are one id wherever they stand, in just this case.
        self.added = [t["content"] for t in rules["added_tokens"]]
        plain = all(not any(c.isspace() for c in t["content"]) and not any(t[k] for k in ("single_word", "lstrip", "rstrip", "normalized")) for t in rules["added_tokens"])
        self.cuts = plain and rules["normalizer"] == NORMALIZER and (rules["pre_tokenizer"] or {}).get("pretokenizers", [None])[0] == SPLIT and rules["model"].get("end_of_word_suffix") == "</w>"
        self.known: dict[str, int] = {}
        self.uses, self.start, self.flat = np.zeros(0, np.int64), np.zeros(1, np.int64), np.zeros(0, np.uint32)
        self.parts, self.part_start, self.part_flat = {"": 0}, np.zeros(2, np.int64), np.zeros(0, np.uint32)
        words = self.tokenizer.get_vocab()
        self.ends_word = np.zeros(max(words.values()) + 1, bool)
        self.ends_word[[k for w, k in words.items() if w.endswith("</w>")]] = True

    def _lowered(self, text: str) -> str:
        """A-Z lower-cased where that cannot change the ids: the tokenizer takes out added tokens as they are written,
        composes characters, then lower-cases."""
        low = text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
        if any(t.lower() in low for t in self.added):
            return text
        return low if text.isascii() or is_normalized("NFC", text) and is_normalized("NFC", low) else text

    def _trim(self) -> None:
        """Forgets the chunks that were used least."""
        keep = np.flatnonzero(self.uses > 1)
        if len(keep) > CHUNKS_KEPT // 2:
            keep = np.sort(keep[np.argsort(self.uses[keep], kind="stable")[-CHUNKS_KEPT // 2 :]])
        names, sizes = list(self.known), np.diff(self.start)[keep]
        self.flat = self.flat[_ranges(self.start[keep], sizes)]
        self.known, self.start = {names[k]: i for i, k in enumerate(keep.tolist())}, np.concatenate([[0], np.cumsum(sizes)])
        self.uses = self.uses[keep] // 2

    def _encode_parts(self, parts: list[str]) -> None:
        """Ids of runs of letters or of marks: the tokenizer ends each with an id that ends a word."""
        texts = [" ".join(parts[i : i + 1000]) for i in range(0, len(parts), 1000)]
        ids = [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        flat = np.concatenate([np.zeros(0, np.uint32), *ids])
        ends = np.flatnonzero(self.ends_word[flat]) + 1
        if len(ends) != len(parts):
            raise ValueError("a part is not one word of the tokenizer")
        at = len(self.parts)
        self.parts.update(zip(parts, range(at, at + len(parts)), strict=True))
        self.part_start = np.concatenate([self.part_start, self.part_start[-1] + ends])
        self.part_flat = np.concatenate([self.part_flat, flat])

    def _learn(self, chunks: list[str]) -> None:
        """Letters that marks follow are encoded apart from them, so that few distinct parts are."""
        simple, parts, odd = [], [], []
        for chunk in chunks:
            base = chunk.rstrip(MARKS)
            if not base and chunk:
                simple.append(chunk)
                parts += [chunk, ""]
            elif base.isascii() and base.isalpha() or base.isalpha() and base.lower().isalpha():
                simple.append(chunk)
                parts += [base, chunk[len(base) :]]
            else:
                odd.append(chunk)
        if len(self.parts) > PARTS_KEPT:
            self.parts, self.part_start, self.part_flat = {"": 0}, np.zeros(2, np.int64), np.zeros(0, np.uint32)
        self._encode_parts(list({*parts}.difference(self.parts)))
        k = np.fromiter(map(self.parts.__getitem__, parts), np.int64, len(parts))
        n = self.part_start[k + 1] - self.part_start[k]
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(odd, add_special_tokens=False)]
        sizes = np.concatenate([n.reshape(-1, 2).sum(axis=1), np.fromiter(map(len, ids), np.int64, len(ids))])
        at = len(self.known)
        self.known.update(zip(chain(simple, odd), range(at, at + len(chunks)), strict=True))
        self.start = np.concatenate([self.start, self.start[-1] + np.cumsum(sizes)])
        self.flat = np.concatenate([self.flat, self.part_flat[_ranges(self.part_start[k], n)], np.fromiter(chain.from_iterable(ids), np.uint32)])
        self.uses = np.concatenate([self.uses, np.zeros(len(chunks), np.int64)])

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text as uint32, its end id last; null is the empty text."""
        if not self.cuts:
            return [np.array([*e.ids, self.end], np.uint32) for e in self.tokenizer.encode_batch_fast([t or "" for t in texts], add_special_tokens=False)]
        split = [self._lowered(t or "").replace("\n", " ").split(" ") for t in texts]
        if len(self.known) > CHUNKS_KEPT:
            self._trim()
        fresh = set().union(*split).difference(self.known)
        self._learn(list(fresh))
        out, get = [], self.known.__getitem__
        for chunks in split:
            k = np.fromiter(map(get, chunks), np.int64, len(chunks))
            n = self.start[k + 1] - self.start[k]
            out.append(np.append(self.flat[_ranges(self.start[k], n)], np.uint32(self.end)))
            self.uses[k] += 1
        if any(len(c) > LONGEST_CHUNK for c in fresh):
            self._forget_long()
        return out

    def _forget_long(self) -> None:
        long = [k for c, k in self.known.items() if len(c) > LONGEST_CHUNK]
        self.uses[long] = 0
        if sum(len(c) for c in self.known if len(c) > LONGEST_CHUNK) > CHUNKS_KEPT * LONGEST_CHUNK // 8:
            self._trim()


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... for size[0] numbers, then the same for each further range."""
    total = np.cumsum(size)
    return np.repeat(start - total + size, size) + np.arange(total[-1] if len(total) else 0)


@cache
def encoder(path: str, end: int) -> Encoder:
    """One for each worker process, over all its tasks."""
    return Encoder(path, end)


@dataclass
class Window:
    used: int = 0
    pieces: list[tuple] = field(default_factory=list)


class Packer:
    """At most `most` open windows of `size` tokens. A piece goes to the open window that it fills best; if none
    has room, the fullest is topped up with the piece's head and emitted, and the rest is placed anew."""

    def __init__(self, size: int, most: int = OPEN):
        self.size, self.most, self.open = size, most, []

    def place(self, piece: tuple) -> Iterator[Window]:
        """piece: (doc, start, doc_tokens, ids). Yields the windows that it completes."""
        doc, start, total, ids = piece
        while len(ids):
            fits = [w for w in self.open if self.size - w.used >= len(ids)]
            if len(ids) < self.size and fits:
                window, room = max(fits, key=lambda w: w.used), len(ids)
            elif len(ids) < self.size and len(self.open) < self.most or len(ids) >= self.size:
                window, room = Window(), min(self.size, len(ids))
                self.open.append(window)
            else:
                window = max(self.open, key=lambda w: w.used)
                room = self.size - window.used
            window.pieces.append((doc, start, total, ids[:room].copy(), window.used))
            window.used += room
            start, ids = start + room, ids[room:]
            if window.used == self.size:
                self.open.remove(window)
                yield window

    def close(self) -> tuple[list[Window], Window | None]:
        """The open windows merged: full ones, and what is left."""
        left, self.open, self.most = sorted(self.open, key=lambda w: -w.used), [], 1
        full = [done for w in left for doc, start, total, ids, _ in w.pieces for done in self.place((doc, start, total, ids))]
        return full, self.open[0] if self.open else None


def _rows(windows: list[tuple[int, Window]], keep_ids: bool) -> pa.RecordBatch:
    rows = [(doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), total, number, at, w.used, ids.astype("<u4").tobytes() if keep_ids else None) for number, w in windows for doc, start, total, ids, at in w.pieces]
    types = [pa.int64()] * 8 + [pa.binary()]
    names = [f.split()[0] for f in PIECE.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)


def _first(path: str, end: int, size: int, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, packer, number = encoder(path, end).encode, Packer(size, most), TaskContext.get().partitionId() << 32
        for batch in slices(batches):
            texts, done = batch.column("text").to_pylist(), []
            for doc, ids in zip(batch.column("doc_id").to_pylist(), encode(texts), strict=True):
                done += packer.place((doc, 0, len(ids), ids))
            yield _rows([(number + i, w) for i, w in enumerate(done)], False)
            number += len(done)
        full, rest = packer.close()
        yield _rows([(number + i, w) for i, w in enumerate(full)], False)
        if rest:
            yield _rows([(number + len(full), rest)], True)

    return run


def _merge(size: int, round_: int, last: bool):
    """Leftovers of many partitions into full sequences and one leftover; the last one of all is cut into
    sequences whose lengths are powers of two, which need no padding."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, number = Packer(size, 1), (round_ << 56) + (TaskContext.get().partitionId() << 32)
        for batch in slices(batches):
            done = []
            for doc, start, total, ids in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "start", "doc_tokens", "ids")), strict=True):
                done += packer.place((doc, start, total, np.frombuffer(ids, "<u4")))
            yield _rows([(number + i, w) for i, w in enumerate(done)], False)
            number += len(done)
        _, rest = packer.close()
        if rest and not last:
            yield _rows([(number, rest)], True)
        elif rest:
            binary = []
            for bit in reversed(range(rest.used.bit_length())):
                if rest.used >> bit & 1:
                    binary.append(Packer(1 << bit, 1))
            done, at = [], 0
            for doc, start, total, ids, _ in rest.pieces:
                while len(ids):
                    room = binary[at].size - (binary[at].open[0].used if binary[at].open else 0)
                    full = list(binary[at].place((doc, start, total, ids[:room])))
                    start, ids = start + len(ids[:room]), ids[room:]
                    done += full
                    at += len(full)
            yield _rows([(number + i, w) for i, w in enumerate(done)], False)

    return run


def pack(docs: DataFrame, tokenizer: str, *, key: str = "doc_id", text: str | Column = "text", size: int = 4096, end: int = 2, most: int = OPEN) -> DataFrame:
    """Pieces of documents packed into sequences of `size` tokens; every id lies in one piece.

    Each partition packs what it reads into at most `most` open windows and ends with less than one window of
    leftovers. Those alone are shuffled, with their ids, and merged FAN_IN partitions at a time until one
    leftover remains; it becomes sequences with lengths of powers of two, so nothing is padded. An empty or
    null text is its end id alone; repeated rows are packed each for itself; an empty table gives no rows.
    """
    spark = docs.sparkSession
    text = F.col(text) if isinstance(text, str) else text
    now = cut(docs.select(F.col(key).cast("bigint").alias("doc_id"), text.alias("text")).mapInArrow(_first(tokenizer, end, size, most), PIECE))
    done, round_ = now.where("ids is null"), 1
    while True:
        rest = now.where("ids is not null")
        sequences = rest.select(F.shiftright("sequence_id", 32).alias("p")).agg(F.count_distinct("p")).first()[0]
        last = sequences <= FAN_IN
        tasks = 1 if last else -(-sequences // FAN_IN)
        dealt = rest.repartition(tasks, F.shiftright("sequence_id", 32)) if tasks > 1 else rest.coalesce(1)
        now = cut(dealt.sortWithinPartitions("sequence_id", "offset").select("doc_id", "start", "doc_tokens", "ids").mapInArrow(_merge(size, round_, last), PIECE)) if sequences else now.limit(0)
        done = done.union(now.where("ids is null"))
        if last:
            break
        round_ += 1
    return done.drop("ids")
