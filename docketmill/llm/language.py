"""Language identification by inferring each document's mixture of languages."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketmill.llm.common import remainder, slices

UNKNOWN = "und"
HELD_OUT = 4, 2
#: Bounded training sample: documents of each language, and the characters of one that it has at most.
SAMPLE, LONGEST_SAMPLE = 1500, 20_000
#: Characters that have numbers of their own, beside the edge of a word and any other character.
CHARACTERS = 62
#: Rounds of expectation-maximisation, and the log-likelihood that a further language must bring, as a multiple
#: of half the logarithm of the words' number.
ROUNDS, PENALTY = 12, 2.0
#: Distinct words that a worker remembers.
WORDS_KEPT = 200_000
WORD = re.compile(r"[^\W\d_]+")


def words(text: str | None) -> list[str]:
    """Runs of letters, in lower case."""
    return WORD.findall(text.lower()) if text else []


@dataclass
class Model:
    """ln P(character | two before it) of each language, as a table over numbered trigrams."""

    languages: list[str]
    characters: dict[str, int]
    table: np.ndarray  # trigrams x languages
    longest: int = 40

    @classmethod
    def fit(cls, texts: list[tuple[str, str]]) -> Model:
        """texts: (language, text). Trigram counts are smoothed by the characters' own frequencies."""
        counted: dict[str, Counter] = {}
        for lang, text in texts:
            counted.setdefault(lang, Counter()).update(words(text))
        languages = sorted(counted)
        used = Counter()
        for c in counted.values():
            for w, n in c.items():
                used.update({x: n for x in w})
        characters = {c: i + 2 for i, (c, _) in enumerate(sorted(used.items(), key=lambda x: (-x[1], x[0]))[:CHARACTERS])}
        size = CHARACTERS + 2
        model = cls(languages, characters, np.zeros((size**3, len(languages)), np.float32))
        for k, lang in enumerate(languages):
            names = list(counted[lang])
            n = np.array([counted[lang][w] for w in names], np.float64)
            grams, _, of = model.grams(names)
            tri = np.bincount(grams, n[of], size**3).reshape(size, size, size)
            one = tri.sum(axis=(0, 1)) + 0.5
            one /= one.sum()
            two = (tri.sum(axis=0) + 2 * one) / (tri.sum(axis=(0, 2))[:, None] + 2)
            three = (tri + 2 * two[None]) / (tri.sum(axis=2)[:, :, None] + 2)
            model.table[:, k] = np.log(three).reshape(-1)
        return model

    def grams(self, names: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Numbers of the trigrams of words with their edges, the words' sizes, and each trigram's word."""
        if not names:
            return (np.zeros(0, np.int64),) * 3
        size, get = CHARACTERS + 2, self.characters.get
        codes = np.fromiter((get(c, 1) if c != "\0" else 0 for c in "\0\0" + "\0\0".join(names) + "\0"), np.int64)
        lengths = np.fromiter(map(len, names), np.int64, len(names))
        each = (codes[:-2] * size + codes[1:-1]) * size + codes[2:]
        ends = np.cumsum(lengths + 2)
        keep = np.ones(len(each), bool)
        keep[ends[:-1] - 1] = False  # a trigram of the gap between two words: edge of one, edges of the next
        of = np.repeat(np.arange(len(names)), lengths + 1)
        return each[keep], lengths + 1, of

    def likelihoods(self, names: list[str]) -> np.ndarray:
        """ln P of each word in each language."""
        if not names:
            return np.zeros((0, len(self.languages)), np.float32)
        grams, sizes, _ = self.grams(names)
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        return np.add.reduceat(self.table[grams], starts, axis=0)


def mixtures(likelihoods: np.ndarray, counts: np.ndarray, sizes: np.ndarray, rounds: int = ROUNDS, penalty: float = PENALTY) -> np.ndarray:
    """Language proportions of documents; their distinct words stand one document after another.

    likelihoods: ln P of each word in each language; counts: how often it occurs; sizes: words of each document.
    Expectation-maximisation fits the proportions; then the least language is taken out again and again while
    that costs less likelihood than the penalty of a parameter, and the rest is fitted anew.
    """
    languages, starts = likelihoods.shape[1], np.concatenate([[0], np.cumsum(sizes)[:-1]])
    top = likelihoods.max(axis=1, keepdims=True)
    p = np.exp(np.maximum(likelihoods - top, -50)).astype(np.float64)
    total = np.add.reduceat(counts, starts).astype(np.float64)
    doc = np.repeat(np.arange(len(sizes)), sizes)

    def fit(share: np.ndarray, doc: np.ndarray, p: np.ndarray, counts: np.ndarray, starts: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        for _ in range(rounds):
            joint = p * share[doc]
            sums = joint.sum(axis=1)
            share = np.add.reduceat(joint * (counts / sums)[:, None], starts, axis=0) / total[:, None]
        return share, np.add.reduceat(counts * np.log(np.maximum((p * share[doc]).sum(axis=1), 1e-300)), starts)

    share, ln = fit(np.full((len(sizes), languages), 1 / languages), doc, p, counts, starts, total)
    active = np.arange(len(sizes))
    for _ in range(languages - 1):
        kept = share[active] > 0
        active = active[kept.sum(axis=1) > 1]
        if not len(active):
            break
        trial = share[active].copy()
        trial[np.arange(len(active)), np.where(trial > 0, trial, np.inf).argmin(axis=1)] = 0
        trial = np.where(trial > 0, np.maximum(trial, 1e-6), 0)
        trial /= trial.sum(axis=1, keepdims=True)
        rows = np.concatenate([np.arange(starts[i], starts[i] + sizes[i]) for i in active])
        small = sizes[active]
        new, new_ln = fit(trial, np.repeat(np.arange(len(active)), small), np.maximum(p[rows], 1e-22), counts[rows], np.concatenate([[0], np.cumsum(small)[:-1]]), total[active])
        better = ln[active] - new_ln < penalty * 0.5 * np.log(np.maximum(total[active], 2))
        share[active[better]], ln[active[better]] = new[better], new_ln[better]
        active = active[better]
    return share


class Predictor:
    def __init__(self, model: Model):
        self.model, self.rows = model, {}
        self.table = np.zeros((0, len(model.languages)), np.float32)

    def __call__(self, texts: list[str | None]) -> list[tuple[str, float, list[float]]]:
        """(language, its proportion, all proportions) of each text."""
        counted = [Counter(words(t)) if t and any(map(str.isalpha, t)) else Counter() for t in texts]
        if len(self.rows) > WORDS_KEPT:
            self.rows, self.table = {}, self.table[:0]
        fresh = list(set().union(*counted).difference(self.rows))
        self.rows.update(zip(fresh, range(len(self.rows), len(self.rows) + len(fresh)), strict=True))
        self.table = np.vstack([self.table, self.model.likelihoods(fresh)])
        full = [i for i, c in enumerate(counted) if c] if self.model.languages else []
        nothing = [0.0] * len(self.model.languages)
        out = [(UNKNOWN, 0.0, nothing)] * len(texts)
        if full:
            k = np.fromiter((self.rows[w] for i in full for w in counted[i]), np.int64)
            n = np.fromiter((v for i in full for v in counted[i].values()), np.float64)
            shares = mixtures(self.table[k], n, np.array([len(counted[i]) for i in full]))
            for i, share in zip(full, shares, strict=True):
                best = int(share.argmax())
                out[i] = (self.model.languages[best], float(min(1.0, share[best])), share.tolist())
        return out


def fit(docs: DataFrame, *, key: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE) -> Model:
    """Fitted on a bounded sample: about `sample` documents of each language by a hash of the key, none that is held out or
    has no language; one row of each key. Of a text of more than LONGEST_SAMPLE characters the sample has a stretch of
    so many, whose place a hash of key and length tells, so no language is left out for the length of its texts."""
    key_, spare = F.col(key).cast("bigint"), F.greatest(F.length(text) - LONGEST_SAMPLE, F.lit(0))
    start = F.pmod(F.xxhash64(key_, F.length(text)), (spare + 1).cast("bigint")).cast("int") + 1
    labelled = docs.where((remainder(key, HELD_OUT[0]) != HELD_OUT[1]) & F.col(lang).isNotNull() & F.col(text).isNotNull())
    read = labelled.select(key_.alias("k"), F.substring(text, start, F.lit(LONGEST_SAMPLE)).alias("t"), F.col(lang).cast("string").alias("l"))
    sizes = {r.l: r["count"] for r in read.groupBy("l").count().collect()}
    chosen = F.lit(False)
    for name, n in sizes.items():
        chosen = chosen | ((F.col("l") == name) & (F.pmod(F.xxhash64("k"), F.lit(1 << 50)) < int(min(1.0, sample / n) * (1 << 50))))
    rows = read.where(chosen).groupBy("l", "k").agg(F.min("t").alias("t")).collect()
    return Model.fit(sorted((r.l, r.t) for r in rows))


def identify(docs: DataFrame, *, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """(key, held_out, lang_pred, score, proportions) of each row of `docs`.

    held_out: crc32(key as text) mod 4 is 2; never learned from. lang_pred: the language with the largest
    proportion, score: that proportion; `und` and 0 where a text is null or has no letter, or nothing could be
    learned. The prediction looks at the text alone. Repeated rows and null keys are rows like any other; an
    empty table gives no rows.
    """
    model = fit(docs, key=key, text=text, lang=lang)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predict = Predictor(shared.value)
        for batch in slices(batches):
            found = predict(batch.column("text").to_pylist())
            columns = [pa.array([f[i] for f in found], t) for i, t in enumerate([pa.string(), pa.float64(), pa.list_(pa.float64())])]
            yield pa.RecordBatch.from_arrays([batch.column("k"), batch.column("held_out"), *columns], names=["k", "held_out", "lang_pred", "score", "proportions"])

    read = docs.select(F.col(key).alias("k"), F.col(text).alias("text"), (remainder(key, HELD_OUT[0]) == HELD_OUT[1]).alias("held_out"))
    found = read.mapInArrow(run, f"k {dict(read.dtypes)['k']}, held_out boolean, lang_pred string, score double, proportions array<double>")
    return found.withColumnRenamed("k", key)
