"""Ranked lexical search by variable-block-max WAND: an index in shards, whose posting lists are cut into blocks by
dynamic programming, and a search that skips blocks which can't hold one of the best documents."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from docketmill.llm.common import cut, slices
from docketmill.llm.decontaminate import blocks

#: What ends a shard: so many documents, or so many postings.
SHARD_DOCS, SHARD_POSTINGS = 8192, 500_000
#: Postings in a block at most, and what a block costs: as much error as so many times the list's largest impact.
LONGEST, BLOCK_COST = 64, 2
#: Lists whose blocks are chosen at a time.
LISTS_AT_ONCE = 4096
#: Characters of texts that are cut into terms at a time, and of items that are searched for in one reading of the index.
CHARS_AT_ONCE, ITEM_CHARS = 1 << 20, 1_000_000
#: Up to so many terms of the items, the index holds those alone; above, all terms of the documents. Results are the same.
VOCABULARY = 200_000
#: Documents that are scored at a time at first; twice as many each time after.
FIRST_DOCS = 64
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def terms(text: str | None) -> Iterator[list[bytes]]:
    """The terms of a text in order, a stretch at a time: runs of ASCII letters, digits and whatever is not ASCII, with
    only A-Z in lower case."""
    data = (text or "").encode("utf-8", "replace").translate(_TABLE)
    at = 0
    while at < len(data):
        end = data.find(b" ", at + CHARS_AT_ONCE)
        end = len(data) if end < 0 else end
        yield data[at:end].split()
        at = end


def impacts(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What a term of weight 1 adds to a document's score."""
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


def weight(documents: int, frequency: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * frequency + 1)))


def cut_lists(values: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sizes of the blocks of all lists in order, how many blocks each list has) of the impacts of all lists, one list
    after the other.

    A list's blocks have the least sum, over all ways to cut it into blocks of up to LONGEST postings, of the bound's
    error (largest impact minus impact, over the postings) and of a fixed cost for each block. As the impacts' own sum
    is the same for all ways, the largest impact times the size is what counts. All lists are worked on in step.
    """
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]) if len(sizes) else np.zeros(0, int)
    back = np.ones(len(values), np.int32)
    order = np.argsort(-sizes, kind="stable")
    order = order[sizes[order] > 1]
    width = min(LONGEST, int(sizes.max(initial=1)))
    wide = np.arange(1, width + 1)
    for first in range(0, len(order), LISTS_AT_ONCE):
        lists = order[first : first + LISTS_AT_ONCE]
        begin, length = starts[lists], sizes[lists]
        cost = np.array([values[a : a + n].max() for a, n in zip(begin, length, strict=True)]) * BLOCK_COST
        best = np.full((len(lists), width), np.iinfo(np.int64).max // 4)  # of the part before 0, 1, ... of the last postings
        best[:, 0] = 0
        top = np.zeros((len(lists), width), np.int64)
        active = len(lists)
        for j in range(int(length[0])):
            while length[active - 1] <= j:
                active -= 1
            now = values[begin[:active] + j]
            w = min(j + 1, width)
            np.maximum(top[:active, : w - 1], now[:, None], out=top[:active, 1:w]) if w > 1 else None
            top[:active, 0] = now
            ways = best[:active, :w] + top[:active, :w] * wide[:w]
            chosen = ways.argmin(axis=1)
            back[begin[:active] + j] = chosen + 1
            best[:active, 1:] = best[:active, :-1].copy()
            best[:active, 0] = ways[np.arange(active), chosen] + cost[:active]
    found, counts = [], np.zeros(len(sizes), np.int32)
    for i, (a, n) in enumerate(zip(starts.tolist(), sizes.tolist(), strict=True)):
        own, j = [], a + n - 1
        while j >= a:
            own.append(int(back[j]))
            j -= own[-1]
        counts[i] = len(own)
        found += own[::-1]
    return np.array(found, np.int32), counts


_GATHERED = "docs binary, tfs binary"
_BLOCKED = "docs binary, impacts binary, block_counts array<int>, block_sizes binary, block_most binary"


def _shards(vocabulary: frozenset[bytes] | None, docs_most: int, postings_most: int):
    """Texts as shards: documents with their lengths, terms in order with how many documents hold them, and for each
    term the documents' numbers in the shard and the occurrences."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, lengths, lists, held = [], [], {}, 0

        def shard() -> pa.RecordBatch:
            names = sorted(lists)
            docs = np.concatenate([np.array(lists[t][0], "<i4") for t in names] or [np.zeros(0, "<i4")])
            tfs = np.concatenate([np.array(lists[t][1], "<i4") for t in names] or [np.zeros(0, "<i4")])
            own = pa.concat_arrays(keys)
            columns = [
                pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), own),
                pa.array([lengths], pa.list_(pa.int64())),
                pa.array([[t.decode("utf-8", "replace") for t in names]], pa.list_(pa.string())),
                pa.array([[len(lists[t][0]) for t in names]], pa.list_(pa.int32())),
                pa.array([sum(n > 0 for n in lengths)], pa.int64()),
                pa.array([sum(lengths)], pa.int64()),
                pa.array([docs.tobytes()], pa.binary()),
                pa.array([tfs.tobytes()], pa.binary()),
            ]
            return pa.RecordBatch.from_arrays(columns, names=["keys", "lengths", "terms", "sizes", "n_docs", "n_terms", "docs", "tfs"])

        for batch in slices(batches):
            for i, text in enumerate(batch.column("t").to_pylist()):
                tf: Counter[bytes] = Counter()
                n = 0
                for part in terms(text):
                    n += len(part)
                    tf.update(part)
                for t in tf if vocabulary is None else tf.keys() & vocabulary:
                    both = lists.get(t)
                    if both is None:
                        both = lists[t] = ([], [])
                    both[0].append(len(lengths))
                    both[1].append(tf[t])
                    held += 1
                lengths.append(n)
                keys.append(batch.column("k").slice(i, 1))
                if len(lengths) >= docs_most or held >= postings_most:
                    yield shard()
                    keys, lengths, lists, held = [], [], {}, 0
        if lengths:
            yield shard()

    return gather


def vocabulary(items: DataFrame, most: int = VOCABULARY) -> frozenset[bytes] | None:
    """The terms of all items, or None if there are more than `most`."""
    found: set[bytes] = set()
    for group in blocks(items, most=ITEM_CHARS, together=1):
        found.update(t for block in group for _, text in block for part in terms(text) for t in part)
        if len(found) > most:
            return None
    return frozenset(found)


class Index:
    """An index of documents: shards in the shared folder, and what is counted over all documents."""

    def __init__(self, shards: DataFrame, frequencies: DataFrame, documents: int, terms: int, key: str, kind: str):
        self.shards, self.frequencies, self.documents, self.terms, self.key, self.kind = shards, frequencies, documents, terms, key, kind


def index(docs: DataFrame, *, key: str = "doc_id", text: str = "text", of: frozenset[bytes] | None = None, shard_docs: int = SHARD_DOCS, shard_postings: int = SHARD_POSTINGS) -> Index:
    """The index of all rows of `docs`, for the terms `of` alone where they are given.

    A shard is a stretch of a partition's documents, closed at so many documents or postings, so no text is shuffled
    and no frequent term gathers anywhere. Counts are over all documents: a first writing holds occurrences, a second
    one impacts and blocks, which need the counts.
    """
    kind = dict(docs.dtypes)[key]
    plain = docs.select(F.col(key).alias("k"), F.col(text).alias("t"))
    common = f"keys array<{kind}>, lengths array<bigint>, terms array<string>, sizes array<int>, "
    gathered = cut(plain.mapInArrow(_shards(of, shard_docs, shard_postings), common + "n_docs bigint, n_terms bigint, " + _GATHERED))
    n_docs, n_terms = (int(x or 0) for x in gathered.agg(F.sum("n_docs"), F.sum("n_terms")).first())
    counted = gathered.select(F.explode(F.arrays_zip("terms", "sizes")).alias("x")).groupBy(F.col("x.terms").alias("term")).agg(F.sum("x.sizes").alias("df"))

    def blocked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                length = np.array(batch.column("lengths")[i].as_py(), np.int64)
                docs, tfs = (np.frombuffer(batch.column(c)[i].as_buffer(), "<i4") for c in ("docs", "tfs"))
                m = 25 + 75 * length * n_docs // max(n_terms, 1)
                values = impacts(tfs.astype(np.int64), m[docs])
                sizes, counts = cut_lists(values, batch.column("sizes")[i].values.to_numpy())
                most = np.maximum.reduceat(values, np.cumsum(sizes) - sizes) if len(sizes) else values
                own = [pa.array([x.astype("<i4").tobytes()], pa.binary()) for x in (docs, values, sizes, most)]
                columns = [*(batch.column(c).slice(i, 1) for c in ("keys", "terms", "sizes")), own[0], own[1], pa.array([counts.tolist()], pa.list_(pa.int32())), own[2], own[3]]
                yield pa.RecordBatch.from_arrays(columns, names=["keys", "terms", "sizes", "docs", "impacts", "block_counts", "block_sizes", "block_most"])

    shards = cut(gathered.select("keys", "lengths", "terms", "sizes", "docs", "tfs").mapInArrow(blocked, f"keys array<{kind}>, terms array<string>, sizes array<int>, " + _BLOCKED))
    return Index(shards, cut(counted), n_docs, n_terms, key, kind)


class Shard:
    """One shard, ready to be searched."""

    def __init__(self, keys: list, names: list[str], sizes: np.ndarray, docs: np.ndarray, values: np.ndarray, counts: np.ndarray, block_sizes: np.ndarray, most: np.ndarray):
        self.keys, self.number, self.docs, self.values, self.most = keys, {t: i for i, t in enumerate(names)}, docs, values, most
        ends = np.cumsum(block_sizes, dtype=np.int64)
        self.begin, self.size = ends - block_sizes, block_sizes
        self.low, self.high = docs[self.begin], docs[ends - 1]  # the first and last document of each block
        self.first_block = np.concatenate([[0], np.cumsum(counts)]).astype(int)

    def best(self, weights: list[tuple[int, int]], k: int, top: list[tuple]) -> list[tuple]:
        """The k best of `top` and this shard's documents, as (-score, key is null, key), for (term's number, weight).

        Over each stretch of documents between two ends of blocks, the blocks' largest impacts bound the score.
        Stretches below the k-th score so far are skipped with all blocks that no other stretch needs; those left
        are scored exactly, the highest bound first, until the next bound is too low. Equal scores are looked at, as the
        key decides between them.
        """
        blocks = np.concatenate([np.arange(self.first_block[t], self.first_block[t + 1]) for t, _ in weights])
        times = np.repeat([w for _, w in weights], [self.first_block[t + 1] - self.first_block[t] for t, _ in weights])
        low, high, bound = self.low[blocks], self.high[blocks], self.most[blocks] * times
        change = np.zeros(len(self.keys) + 1, np.int64)
        np.add.at(change, low, bound)
        np.subtract.at(change, high + 1, bound)
        bounds = np.cumsum(change)[:-1]
        least = lambda: max(1, -top[k - 1][0]) if len(top) >= k else 1
        places = np.flatnonzero(bounds >= least())
        places, many = places[np.argsort(-bounds[places], kind="stable")], FIRST_DOCS
        while len(places):
            wanted = np.zeros(len(self.keys) + 1, np.int64)
            wanted[1:][places[:many]] = 1
            chosen = wanted[1:].astype(bool)
            before = np.cumsum(wanted)
            here = before[high + 1] > before[low]
            begin, size = self.begin[blocks[here]], self.size[blocks[here]]
            at = np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(size.sum())
            held = chosen[self.docs[at]]
            at, by = at[held], np.repeat(times[here], size)[held]
            score = np.zeros(len(self.keys), np.int64)
            np.add.at(score, self.docs[at], self.values[at] * by)
            good = np.flatnonzero(score >= least())
            if len(good) > k:  # of many, those below the k-th score of their own
                good = good[score[good] >= np.partition(score[good], -k)[-k]]
            top = sorted([*top, *((-int(score[d]), self.keys[d] is None, self.keys[d]) for d in good)], key=_order)[:k]
            places, many = places[many:], 2 * many
            places = places[bounds[places] >= least()]
        return top


def _order(row: tuple) -> tuple:
    return (row[0], row[1], 0 if row[1] else row[2])


def search(found: Index, items: DataFrame, *, item: str = "item_id", text: str = "text", k: int = 10) -> DataFrame:
    """(item, rank, key, score): for each row of `items`, its k best documents with a score above 0, by score and
    then by key, null last.

    A term's weight is floor(1000 ln((2 N + 2) / (2 df + 1))), N the documents with a term, df those with this one; a
    document's score sums, over the item's terms with repeats, the weight times the term's impact. Null items and
    items without a term of any document have no rows; repeated items are searched for each; documents whose rows
    repeat are documents of their own; an empty table gives no rows. Items are read in blocks of a million characters;
    the index is read once for each. A task keeps its best documents from shard to shard, so that later shards are
    skipped the more, and gives at most k rows for each item.
    """
    kind, spark, out = dict(items.dtypes)[item], items.sparkSession, None
    schema, n_docs = f"q bigint, item {kind}, k {found.kind}, score bigint", found.documents
    plain = items.select(F.col(item).alias("item_id"), F.col(text).alias("text"))
    done = 0
    for group in blocks(plain, most=ITEM_CHARS, together=1):
        asked = [(key, Counter(t.decode("utf-8", "replace") for part in terms(body) for t in part)) for block in group for key, body in block]
        words = sorted({t for _, c in asked for t in c})
        named = spark.createDataFrame([(t,) for t in words], "term string")
        weights = {r.term: w for r in found.frequencies.join(F.broadcast(named), "term").collect() if (w := weight(n_docs, r.df)) > 0}
        queries = [(key, [(t, weights[t] * n) for t, n in sorted(c.items()) if t in weights]) for key, c in asked]
        first, done = done, done + len(queries)

        def run(batches: Iterator[pa.RecordBatch], queries=queries, first=first) -> Iterator[pa.RecordBatch]:
            tops: list[list[tuple]] = [[] for _ in queries]
            for batch in batches:
                for i in range(batch.num_rows):
                    whole = lambda c: np.frombuffer(batch.column(c)[i].as_buffer(), "<i4").astype(np.int64)  # noqa: B023, E731
                    names = batch.column("terms")[i].as_py()
                    if not names:
                        continue
                    shard = Shard(batch.column("keys")[i].as_py(), names, batch.column("sizes")[i].values.to_numpy(), whole("docs"), whole("impacts"), batch.column("block_counts")[i].values.to_numpy(), whole("block_sizes"), whole("block_most"))
                    for q, (_, own) in enumerate(queries):
                        if there := [(shard.number[t], w) for t, w in own if t in shard.number]:
                            tops[q] = shard.best(there, k, tops[q])
            rows = [(first + q, queries[q][0], key, -score) for q, top in enumerate(tops) for score, _, key in top]
            columns = list(zip(*rows, strict=True)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["q", "item", "k", "score"])

        types = [pa.int64(), to_arrow_type(items.schema[item].dataType), to_arrow_type(found.shards.schema["keys"].dataType.elementType), pa.int64()]
        part = found.shards.mapInArrow(run, schema)
        out = part if out is None else out.union(part)
    out = spark.createDataFrame([], schema) if out is None else out
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), F.col("k").asc_nulls_last()))
    return out.withColumn("rank", rank).where(F.col("rank") <= k).select(F.col("item").alias(item), "rank", F.col("k").alias(found.key), "score")


def ranked(docs: DataFrame, items: DataFrame, *, key: str = "doc_id", text: str = "text", k: int = 10) -> DataFrame:
    """search() of all items in an index of all documents, which holds the items' terms alone while they are few."""
    return search(index(docs, key=key, text=text, of=vocabulary(items)), items, k=k)
