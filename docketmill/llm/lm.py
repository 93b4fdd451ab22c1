"""Scoring by a gated recurrent language model with a class-factored softmax, beside a corpus-wide unigram model."""

from __future__ import annotations

import heapq
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketmill.llm import gru
from docketmill.llm.common import cut, drop, remainder, slices

#: The end of a text in the count table; no word is empty.
END = b""
#: Symbols of the recurrent model: the END, the most frequent words, and a symbol for each ending of other words.
WORDS, ENDINGS, CLASS = 1007, 16, 32
#: Words whose counts every worker holds: a fixed bound. Others are joined by shuffle. Longer words than LONGEST bytes
#: go by their 128-bit digest, so that no count is left out and no row of the count table is large.
HELD_WORDS, LONGEST = 150_000, 64
#: States, lanes and steps between truncations of training; pieces that the driver trains on first and characters
#: of the longest piece; passes over them.
STATES, LANES, STEPS, SAMPLE, LONGEST_SAMPLE, PASSES, RATE = 24, 64, 24, 1500, 20_000, 1, 0.01
#: Share of all pieces that the workers train on after the driver (all of them), their rate, and the pieces that one gathers first.
SHARE, LATER_RATE, PIECES = 1.0, 0.003, 1500
#: Lanes of scoring, steps whose outputs are scored at once, and tokens that a worker gathers first.
SCORING_LANES, BULK, GATHERED = 256, 64, 2_000_000
HELD_OUT = 7, 2


def tokens(text: str | None) -> list[bytes]:
    """Words of a text with A-Z lower-cased, without the end. A long word is a blank, which none holds, its digest and
    its ending."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if words and len(max(words, key=len)) > LONGEST:
        return [w if len(w) <= LONGEST else b" " + xxhash.xxh3_128_digest(w) + w[-2:] for w in words]
    return words


def ending(word: bytes) -> int:
    return zlib.crc32(word[-2:]) % ENDINGS


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> pa.RecordBatch:
        words = list(counted)
        arrays = [pa.array(words, pa.binary()), pa.array([ending(w) for w in words], pa.int32()), pa.array([counted[w] for w in words], pa.int64())]
        return pa.RecordBatch.from_arrays(arrays, names=["word", "ending", "n"])

    counted: Counter = Counter()
    for batch in slices(batches):
        for text in batch.column("text").to_pylist():
            counted.update(tokens(text))
            counted[END] += 1
        if len(counted) > 300_000:
            yield rows()
            counted.clear()
    yield rows()


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, ending, n) of a column `text`, one end for each row; combined in each partition before the shuffle."""
    each = texts.select("text").mapInArrow(_count, "word binary, ending int, n bigint")
    return each.groupBy("word", "ending").agg(F.sum("n").alias("n"))


@dataclass
class Table:
    """What a worker knows of the corpus: frequent words by falling count, and totals."""

    words: list[bytes]
    counts: np.ndarray
    total: int
    distinct: int
    end: int
    endings: np.ndarray  # sum of n + 1 over the words that are no symbols, and 1 for unknown words


def table(counts: DataFrame) -> Table:
    """Reads totals and the frequent words off the count table; the number that is collected has a fixed bound."""
    total, distinct, end = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1)), F.coalesce(F.max(F.when(F.length("word") == 0, F.col("n"))), F.lit(0))).first()
    words = counts.where(F.length("word") > 0)
    level = F.floor(F.log2("n") * 8).cast("int")
    kept, least = 0, 0
    for r in sorted(words.groupBy(level.alias("level")).count().collect(), reverse=True):
        if kept + r["count"] > HELD_WORDS:
            least = r.level + 1
            break
        kept += r["count"]
    rows = sorted(((-r.n, bytes(r.word)) for r in words.where(level >= least).select("word", "n").collect()))
    sums = np.ones(ENDINGS)
    for r in counts.where(F.length("word") > 0).groupBy("ending").agg(F.sum(F.col("n") + 1).alias("s")).collect():
        sums[r.ending] += r.s
    for n, w in rows[:WORDS]:
        sums[ending(w)] -= 1 - n
    return Table([w for _, w in rows], np.array([-n for n, _ in rows], np.int64), total, distinct, end, sums)


class Model:
    """P(symbol | symbols before) = P(class | state) P(symbol | class, state). Symbols are numbered END, words by
    falling frequency, endings; classes are runs of CLASS symbols, so symbols of a class are about as frequent."""

    def __init__(self, counts: np.ndarray, seed: int = 1):
        """counts: of each symbol in the training corpus; the output biases begin as its unigram model."""
        rng = np.random.default_rng(seed)
        self.symbols = len(counts)
        self.classes = -(-self.symbols // CLASS)
        share = np.full(self.classes * CLASS, 1e-9)
        share[: self.symbols] = (counts + 1) / (counts + 1).sum()
        share = share.reshape(self.classes, CLASS)
        f = np.float32
        self.w = {
            "x": 0.3 * gru.weights(rng, self.symbols, 3 * STATES) * np.sqrt(self.symbols).astype(f), "u": gru.weights(rng, STATES, 3 * STATES), "b": np.zeros(STATES, f),
            "c": np.zeros((STATES, self.classes), f), "cb": np.log(share.sum(axis=1)).astype(f),
            "o": np.zeros((self.classes, STATES, CLASS), f), "ob": np.log(share / share.sum(axis=1, keepdims=True)).astype(f),
        }

    def outputs(self, h: np.ndarray, targets: np.ndarray, grads: dict | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """ln P of each target after a state, and the gradient of the mean loss for the states if grads is given."""
        w, n = self.w, len(targets)
        of, within = targets // CLASS, targets % CLASS
        logits = h @ w["c"] + w["cb"]
        logits -= logits.max(axis=1, keepdims=True)
        p = np.exp(logits)
        p /= p.sum(axis=1, keepdims=True)
        out = np.log(p[np.arange(n), of])
        d_h = None
        if grads is not None:
            p[np.arange(n), of] -= 1
            p /= n
            grads["c"], grads["cb"], d_h = h.T @ p, p.sum(axis=0), p @ w["c"].T
            grads["o"], grads["ob"] = np.zeros_like(w["o"]), np.zeros_like(w["ob"])
        order = np.argsort(of, kind="stable")
        edges = np.searchsorted(of[order], np.arange(self.classes + 1))
        for k in np.flatnonzero(np.diff(edges)):
            rows = order[edges[k] : edges[k + 1]]
            hk = h[rows]
            logits = hk @ w["o"][k] + w["ob"][k]
            logits -= logits.max(axis=1, keepdims=True)
            q = np.exp(logits)
            q /= q.sum(axis=1, keepdims=True)
            at = np.arange(len(rows)), within[rows]
            out[rows] += np.log(q[at])
            if grads is not None:
                q[at] -= 1
                q /= n
                grads["o"][k], grads["ob"][k] = hk.T @ q, q.sum(axis=0)
                d_h[rows] += q @ w["o"][k].T
        return out, d_h

    def train(self, sequences: list[np.ndarray], passes: int = PASSES, rate: float = RATE) -> None:
        """Truncated backpropagation: lanes of joined sequences, each beginning after an END, state carried on."""
        if not sequences:
            return
        adam, rng = gru.Adam(self.w, rate), np.random.default_rng(2)
        todo = passes * (sum(map(len, sequences)) // (LANES * STEPS))
        done = 0
        for _ in range(passes):
            flat = np.concatenate([sequences[i] for i in rng.permutation(len(sequences))])
            size = len(flat) // LANES
            if size < 2:
                return
            lanes = flat[: size * LANES].reshape(LANES, size).T
            before = np.vstack([np.zeros((1, LANES), lanes.dtype), lanes[:-1]])
            h = np.zeros((LANES, STATES), np.float32)
            for at in range(0, size - STEPS + 1, STEPS):
                x, y = before[at : at + STEPS], lanes[at : at + STEPS]
                keep = (x != 0).astype(np.float32)
                states, record = gru.forward(self.w["x"][x], h, self.w["u"], self.w["b"], keep)
                grads: dict = {}
                _, d = self.outputs(states.reshape(-1, STATES), y.reshape(-1), grads)
                d_x, _, grads["u"], grads["b"] = gru.backward(d.reshape(states.shape), record, self.w["u"], keep)
                grads["x"] = np.zeros_like(self.w["x"])
                np.add.at(grads["x"], x.reshape(-1), d_x.reshape(-1, 3 * STATES))
                h = states[-1]
                done += 1
                adam(grads, rate * max(0.1, 1 - done / max(1, todo)))

    def score(self, sequences: list[np.ndarray]) -> np.ndarray:
        """ln P of each sequence, whole: each starts from the zero state after an END, and its state is carried
        to its end. Lanes take one sequence after another, so that many advance in each step."""
        count = min(SCORING_LANES, max(1, len(sequences)))
        lanes: list[list[int]] = [[] for _ in range(count)]
        load = [(0, i) for i in range(count)]
        for i in sorted(range(len(sequences)), key=lambda i: -len(sequences[i])):
            n, lane = heapq.heappop(load)
            lanes[lane].append(i)
            heapq.heappush(load, (n + len(sequences[i]), lane))
        sizes = [sum(len(sequences[i]) for i in lane) for lane in lanes]
        lanes = [lanes[k] for k in sorted(range(count), key=lambda k: -sizes[k])]
        order = [i for lane in lanes for i in lane]
        flat = np.concatenate([sequences[i] for i in order]) if order else np.zeros(0, np.int64)
        owner = np.repeat(order, [len(sequences[i]) for i in order]) if order else flat
        before = np.concatenate([[0], flat[:-1]]) if len(flat) else flat
        starts = np.cumsum([0, *(len(sequences[i]) for i in order)])[:-1]
        fresh = np.zeros(len(flat) + 1, bool)
        fresh[starts] = True
        before[starts[starts < len(flat)]] = 0
        sizes = np.array(sorted(sizes, reverse=True))
        base = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        total, h = np.zeros(len(sequences)), np.zeros((count, STATES), np.float32)
        for at in range(0, int(sizes[0]) if count else 0, BULK):
            states, places = [], []
            for t in range(at, min(at + BULK, int(sizes[0]))):
                place = base[: np.searchsorted(-sizes, -t, side="left")] + t
                h = h[: len(place)]
                h[fresh[place]] = 0
                h = gru.step(self.w["x"][before[place]], h, self.w["u"], self.w["b"])
                states.append(h)
                places.append(place)
                h = h.copy()
            place = np.concatenate(places)
            out, _ = self.outputs(np.concatenate(states), flat[place])
            total += np.bincount(owner[place], out, len(sequences))
        return total


class Scorer:
    """Turns texts into symbols and scores them: what depends on the words that a worker holds, and the rest."""

    def __init__(self, known: Table, model: Model | None = None):
        self.known, self.model = known, model
        self.at = {w: i for i, w in enumerate(known.words)}
        self.symbols = min(WORDS, len(known.words))
        ends = np.array([ending(w) for w in known.words], np.int64)
        self.symbol = np.where(np.arange(len(ends)) < self.symbols, np.arange(len(ends)) + 1, 1 + self.symbols + ends) if len(ends) else ends
        self.log_count = np.log10(known.counts + 1.0)
        self.log_ending = np.log10(known.endings)

    def symbol_counts(self) -> np.ndarray:
        return np.concatenate([[self.known.end], self.known.counts[: self.symbols], self.known.endings])

    def read(self, text: str | None) -> tuple[np.ndarray, np.ndarray, Counter]:
        """Symbols with the END last, the held words' numbers, and the other words with their frequencies."""
        words, get = tokens(text), self.at.get
        k = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
        symbols = np.zeros(len(words) + 1, np.int64)
        symbols[:-1] = self.symbol[k] if len(self.symbol) else 0
        missing = np.flatnonzero(k < 0)
        others = Counter(words[i] for i in missing)
        for i in missing:
            symbols[i] = 1 + self.symbols + ending(words[i])
        return symbols, k[k >= 0], others

    def __call__(self, texts: list[str | None]) -> list[tuple[int, int, float, float, Counter]]:
        """(tokens, known, sum of log10(n + 1), log10 P without the other words' counts, other words) of each."""
        read = [self.read(t) for t in texts]
        ln = self.model.score([s for s, _, _ in read])
        out = []
        for (symbols, held, others), score in zip(read, ln, strict=True):
            sums = float(self.log_count[held].sum())
            rare = symbols[symbols > self.symbols] - self.symbols - 1
            inside = float(self.log_count[held[held >= self.symbols]].sum() - self.log_ending[rare].sum())
            end = self.known.end
            out.append((len(symbols), len(held) + (end > 0), sums + np.log10(end + 1.0), score / np.log(10) + inside, others))
        return out


def _score(scorer):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score, number, texts, rows, gathered = Scorer(*scorer.value), TaskContext.get().partitionId() << 40, [], [], 0

        def out() -> pa.RecordBatch:
            found = score(texts)
            columns = [pa.array([number + i for i in range(len(rows))], pa.int64()), pa.array([k for k, _ in rows], pa.int64()), pa.array([h for _, h in rows], pa.bool_())]
            columns += [pa.array([f[i] for f in found], t) for i, t in enumerate([pa.int64(), pa.int64(), pa.float64(), pa.float64()])]
            columns += [pa.array([list(f[4]) for f in found], pa.list_(pa.binary())), pa.array([list(f[4].values()) for f in found], pa.list_(pa.int64()))]
            return pa.RecordBatch.from_arrays(columns, names=["row", "k", "held_out", "n_tokens", "n_known", "sums", "lm", "words", "tf"])

        for batch in slices(batches):
            got = batch.column("text").to_pylist()
            texts += got
            rows += zip(batch.column("k").to_pylist(), batch.column("held_out").to_pylist(), strict=True)
            gathered += sum(len(t or "") for t in got) // 6 + len(got)
            if gathered >= GATHERED:
                yield out()
                number, texts, rows, gathered = number + len(rows), [], [], 0
        if rows:
            yield out()

    return run


def drawn(texts: DataFrame, low: float, high: float) -> DataFrame:
    """(text, at): the texts and the places of those pieces of at most LONGEST_SAMPLE characters of the texts (k, text) whose number lies from low up to
    high. A piece's number, from 0 to 1, is a hash of its row's key and text and of its place, so it is the same however
    the rows lie in partitions. Which pieces are wanted is known before any is cut, and all cuts of a text take time in
    proportion to its length."""
    last = F.floor(F.greatest(F.length("text") - 1, F.lit(0)) / LONGEST_SAMPLE).cast("int")
    number = lambda i: F.shiftrightunsigned(F.xxhash64("k", F.xxhash64("text"), i), 11) / F.lit(float(1 << 53))
    wanted = texts.select("text", F.filter(F.sequence(F.lit(0), last), lambda i: (number(i) >= low) & (number(i) < high)).alias("at"))

    return wanted.where(F.size("at") > 0)


def _cuts(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        for text, places in zip(batch.column("text"), batch.column("at"), strict=True):
            whole = text.as_py()
            yield pa.RecordBatch.from_arrays([pa.array([whole[i * size : (i + 1) * size] for i in places.as_py()], pa.string())], names=["text"])


def pieces(texts: DataFrame, low: float, high: float) -> DataFrame:
    """(text): the drawn() pieces."""
    size = LONGEST_SAMPLE
    return drawn(texts, low, high).mapInArrow(lambda batches: _cuts(batches, size), "text string")


def _train(shared):
    size = LONGEST_SAMPLE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, model = shared.value
        reader, start, gathered, n = Scorer(known), {k: v.copy() for k, v in model.w.items()}, [], 0

        def learn() -> int:
            own.train(gathered, rate=LATER_RATE)
            return sum(map(len, gathered))

        own = Model(reader.symbol_counts())
        own.w = start
        for batch in slices(_cuts(batches, size)):  # in the same worker, so that a task has one
            gathered += [reader.read(t)[0] for t in batch.column("text").to_pylist()]
            if len(gathered) >= PIECES:
                n, gathered = n + learn(), []
        n += learn()
        if n:
            flat = np.concatenate([own.w[k].ravel() for k in sorted(own.w)]).astype("<f8") * n
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([flat.tobytes()], pa.binary())], names=["n", "w"])

    return run


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n, total = 0, None
    for batch in batches:
        for m, w in zip(batch.column("n").to_pylist(), batch.column("w"), strict=True):
            n, total = n + m, np.frombuffer(w.as_py(), "<f8") + (0 if total is None else total)
    if n:
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([total.tobytes()], pa.binary())], names=["n", "w"])


def fit(docs: DataFrame, counts: DataFrame, sample: int = SAMPLE) -> tuple[Table, Model]:
    """Counts cover all training documents. The recurrent weights are fitted on about `sample` pieces of them by
    the driver, each different one once, and go on from there on a SHARE of all pieces, each partition for itself; the
    mean of what they reach, weighted by tokens, is the model. With a SHARE of 1 no piece is left out."""
    known = table(counts)
    reader = Scorer(known)
    training = docs.where(~F.col("held_out")).select("k", "text")
    number = training.agg(F.sum(F.greatest(F.lit(1), F.ceil(F.length("text") / LONGEST_SAMPLE)))).first()[0]
    share = min(1.0, sample / max(1, number or 0))
    rows = pieces(training, 0.0, share if share < 1 else 1.1).distinct().collect()
    model = Model(reader.symbol_counts())
    model.train([reader.read(t)[0] for t in sorted((r.text for r in rows), key=lambda t: xxhash.xxh64_intdigest(t.encode("utf-8", "replace")))])
    if share < 1:
        shared = docs.sparkSession.sparkContext.broadcast((known, model))
        trained = cut(drawn(training, 1 - SHARE, 1.1).mapInArrow(_train(shared), "n bigint, w binary"))
        # The sums of a square root of the partitions come to the driver, not all weights.
        few = trained.repartition(max(1, round(trained.count() ** 0.5))).mapInArrow(_add, "n bigint, w binary").collect()
        drop(trained)
        if few:
            mean = sum(np.frombuffer(r.w, "<f8") for r in few) / sum(r.n for r in few)
            at = 0
            for k in sorted(model.w):
                model.w[k] = mean[at : at + model.w[k].size].reshape(model.w[k].shape).astype(np.float32)
                at += model.w[k].size
    return known, model


def score(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, held_out, n_tokens, n_known, train_tokens, base_score, score) of each row of `docs`.

    A token is a word with A-Z lower-cased, or the end of a text. held_out: crc32(key as text) mod 7 is 2; the
    others are learned from. base_score: log10 of add-one unigram probabilities over all training tokens.
    score: log10 probability of the whole text by the recurrent model; a word that is no symbol of it has its
    ending's probability times its own share, (n + 1) of all such words' and one unknown word's. Words that
    workers do not hold are joined with the whole count table, so no count is approximate. Null texts are
    empty and have one token, the end. The integer key may be null or repeat; rows are scored each for itself.
    An empty table gives no rows; without training texts every word is unknown.
    """
    spark = docs.sparkSession
    read = docs.select(F.col(key).cast("bigint").alias("k"), F.coalesce(F.col(text), F.lit("")).alias("text"), (remainder(key, HELD_OUT[0]) == HELD_OUT[1]).alias("held_out"))
    counts = cut(word_counts(read.where(~F.col("held_out"))))
    known, model = fit(read, counts)
    shared = spark.sparkContext.broadcast((known, model))
    fields = "row bigint, k bigint, held_out boolean, n_tokens bigint, n_known bigint, sums double, lm double, words array<binary>, tf array<bigint>"
    scored = cut(read.mapInArrow(_score(shared), fields))
    others = scored.select("row", F.inline(F.arrays_zip(F.col("words").alias("word"), F.col("tf").alias("tf"))))
    found = others.join(counts.select("word", "n"), "word").groupBy("row").agg(F.sum("tf").alias("more"), F.sum(F.col("tf") * F.log10(F.col("n") + 1)).alias("log"))
    both = scored.drop("words", "tf").join(found, "row", "left")
    log = F.coalesce("log", F.lit(0.0))
    base = F.col("sums") + log - F.col("n_tokens") * F.lit(float(np.log10(known.total + known.distinct + 1)))
    return both.select(F.col("k").alias(key), "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(known.total).cast("bigint").alias("train_tokens"), base.alias("base_score"), (F.col("lm") + log).alias("score"))
