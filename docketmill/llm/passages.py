"""Substring deduplication by content-defined chunking with a gear rolling hash."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docketmill.llm.common import cut, slices

#: Bytes of the shortest and longest chunk. A chunk ends where the gear hash's low 16 bits, which the last 16
#: bytes alone decide, are below a limit: one position in RARITY. The shortest chunk is short beside that, so
#: that chunkings which enter a passage at different places soon agree.
SHORTEST, LONGEST, RARITY = 8, 96, 24
#: Words that a run of repeated chunks must hold to be a passage. Chunking blurs each end of a passage by about
#: RARITY bytes, so passages of over 50 words are found but for about two in a thousand, and those under
#: LEAST_WORDS never.
LEAST_WORDS = 16
#: Digests that a worker gathers before it hands on what they come to.
GATHERED = 1_000_000
#: Bytes hashed at a time.
BYTES_AT_ONCE = 1 << 20
GEAR = np.array([xxhash.xxh32_intdigest(bytes([b]), 7) & 0xFFFF for b in range(256)], np.uint16)
SPACE = np.isin(np.arange(256), np.frombuffer(b"\x20\t\n\v\f\r", np.uint8))


def rolled(data: np.ndarray) -> np.ndarray:
    """The gear hash after each byte, by doubling its window: h[i] = 2 h[i-1] + GEAR[b[i]] (mod 2^16)."""
    h = GEAR[data]
    for step in (1, 2, 4, 8):
        older = h[:-step] << np.uint16(step)
        h = h.copy()
        h[step:] += older
    return h


def candidates(data: np.ndarray) -> np.ndarray:
    """Ends of possible chunks, ascending: where the hash is below its limit, never inside a character."""
    found = []
    for at in range(0, len(data), BYTES_AT_ONCE):
        back = min(at, 15)
        ends = np.flatnonzero(rolled(data[at - back : at + BYTES_AT_ONCE]) < 65536 // RARITY)
        found.append(ends[ends >= back] + (at - back + 1))
    ends = np.concatenate(found) if found else np.empty(0, np.int64)
    inner = ends < len(data)
    return ends[inner][data[ends[inner]] & 0xC0 != 0x80]


def chunks(data: bytes) -> list[int]:
    """Ends of the chunks of UTF-8 bytes, the last at their end; nothing for no bytes.

    Where no candidate comes up, as in a word said over and over, the chunk ends at the least hash of the second
    half of what it may hold: that, too, is decided by the content, wherever the chunk began.
    """
    array = np.frombuffer(data, np.uint8)
    ends, at, n = [], 0, len(data)
    for c in [*candidates(array).tolist(), n]:
        if c - at < SHORTEST and c < n:
            continue
        while c - at > LONGEST:
            low = at + LONGEST // 2
            at = low + 1 + int(rolled(array[low - 15 : at + LONGEST - 1])[15:].argmin())
            while data[at] & 0xC0 == 0x80:
                at -= 1
            ends.append(at)
        if c - at >= SHORTEST or c == n and c > at:
            ends.append(c)
            at = c
    return ends


def pairs(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The digests of each two neighbouring chunks of a text, XXH3 of 64 bits, and where they stand, as one number:
    start << 22 | length << 14 | words of the first << 7 | words of the second, in code points. A text of one chunk
    has that alone. Words count where they begin."""
    data = (text or "").encode("utf-8", "replace")
    if not data:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    ends = np.array(chunks(data))
    array, edges = np.frombuffer(data, np.uint8), np.concatenate([[0], ends])
    space = SPACE[array]
    begins = ~space & np.concatenate([[True], space[:-1]])
    words = np.diff(np.concatenate([[0], np.cumsum(begins)])[edges])
    places = edges if len(data) == len(text) else np.concatenate([[0], np.cumsum(array & 0xC0 != 0x80)])[edges]
    if len(ends) == 1:
        bounds, first, last, words = [(0, len(data))], places[:1], places[1:], np.append(words, 0)
    else:
        bounds, first, last = zip(edges[:-2].tolist(), edges[2:].tolist(), strict=True), places[:-2], places[2:]
    digests = np.fromiter((xxhash.xxh3_64_intdigest(data[a:b]) for a, b in bounds), np.uint64, len(first)).view(np.int64)
    return digests, first << 22 | (last - first) << 14 | words[:-1] << 7 | words[1:]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(d, first, several) for what each worker gathers: a digest, the least key, whether several documents have it."""

    def rows() -> pa.RecordBatch:
        order = sorted(range(len(keys)), key=lambda i: (keys[i] is None, keys[i]))
        rank = np.empty(len(keys), np.int64)
        rank[order] = np.arange(len(keys))
        d, r = np.concatenate(digests), np.repeat(rank, [len(x) for x in digests])
        by = np.lexsort((r, d))
        d, r = d[by], r[by]
        heads = np.flatnonzero(np.concatenate([[True], d[1:] != d[:-1]]))
        several = np.diff(np.append(heads, len(d))) > 1
        return pa.RecordBatch.from_arrays([pa.array(d[heads]), pa.array([keys[i] for i in order], kind).take(pa.array(r[heads])), pa.array(several)], names=["d", "first", "several"])

    keys, digests, held, kind = [], [], 0, None
    for batch in slices(batches):
        kind = batch.column("k").type
        for key, text in zip(batch.column("k").to_pylist(), batch.column("text").to_pylist(), strict=True):
            found = np.unique(pairs(text)[0])
            if len(found):
                keys.append(key)
                digests.append(found)
                held += len(found)
        if held >= GATHERED:
            yield rows()
            keys, digests, held = [], [], 0
    if held:
        yield rows()


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        ids, found = batch.column("id").to_numpy(), [pairs(t) for t in batch.column("text").to_pylist()]
        columns = [np.repeat(ids, [len(d) for d, _ in found]), *(np.concatenate(x) if len(x) else np.zeros(0, np.int64) for x in zip(*found, strict=True))]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["id", "d", "place"])


def repeated_passages(docs: DataFrame, *, key: str = "doc_id", text: str = "text", least_words: int = LEAST_WORDS) -> DataFrame:
    """(key, start, end, n_words, first_doc_id, is_first): maximal runs of chunks that stand in several documents.

    Chunks are looked up with their neighbour, by the digest of both, so that a few common words in a row are no
    repeat by themselves; a run goes on while each chunk and its neighbour are repeated. Positions are code points,
    end exclusive. first_doc_id is the least key that holds one of the run's chunks, is_first tells whether that is
    this document: a deduplicated corpus keeps those and cuts the others. Keys may be of any type that sorts. A null
    key comes after all others: where only such documents share a run, first_doc_id is null and is_first true for
    all of them, and nothing is cut. Rows that share a key but not their text are documents of their own; rows that
    share both are the same passages twice. Null, empty and shorter texts have no passages; an empty table gives no
    rows.

    A digest in a third of all documents is one row of each worker's count. The count is written before it is joined,
    so the join's rows of a hot digest can be split. Texts are chunked twice, as that is cheaper than keeping all
    chunks. A digest has 64 bits, but a passage has several in a row: chance alone makes none.
    """
    kind = dict(docs.dtypes)[key]
    whole = docs.select(F.col(key).alias("k"), F.xxhash64(F.col(key), F.col(text)).alias("id"), F.col(text).alias("text"))
    counted = whole.select("k", "text").mapInArrow(_counted, f"d bigint, first {kind}, several boolean")
    several = cut(counted.groupBy("d").agg(F.min("first").alias("first"), ((F.count(F.lit(1)) > 1) | F.max("several")).alias("several")).where("several").select("d", "first"))
    placed = whole.select("id", "text").mapInArrow(_placed, "id bigint, d bigint, place bigint")
    start = F.shiftright("place", 22)
    stop = start + F.shiftright("place", 14).bitwiseAND(255)
    found = placed.join(several, "d").select("id", start.alias("start"), stop.alias("stop"), F.shiftright("place", 7).bitwiseAND(127).alias("words"), F.col("place").bitwiseAND(127).alias("last_words"), "first")
    order = Window.partitionBy("id").orderBy("start")
    once = found.withColumn("before", F.lag("start").over(order)).where("before is null or before <> start")
    fresh = F.when(F.col("start") >= F.coalesce(F.lag("stop").over(order), F.lit(0)), 1).otherwise(0)
    runs = once.withColumn("fresh", fresh).withColumn("run", F.sum("fresh").over(order))
    spans = runs.groupBy("id", "run").agg(F.min("start").alias("start"), F.max("stop").alias("end"), (F.sum("words") + F.max_by("last_words", "start")).alias("n_words"), F.min("first").alias("first_doc_id"))
    long = spans.where(F.col("n_words") >= least_words).select("id", "start", "end", "n_words", "first_doc_id")
    named = whole.select("k", "id").join(long, "id")
    return named.select(F.col("k").alias(key), "start", "end", "n_words", "first_doc_id", F.col("k").eqNullSafe(F.col("first_doc_id")).alias("is_first"))
