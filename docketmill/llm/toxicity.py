"""Toxicity by a bidirectional gated recurrent network with attention pooling over windows of a text."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docketmill.llm import gru
from docketmill.llm.common import ROWS_AT_ONCE, remainder

HELD_OUT, THRESHOLD = (4, 2), 0.3
#: Windows of words, and the distance between their starts.
WINDOW, STRIDE = 32, 16
#: Sizes of the network: frequent words and characters with vectors of their own, the vectors, and the states.
WORDS, CHARACTERS, WORD_SIZE, CHAR_SIZE, CHAR_STATES, STATES, ATTENTION = 3000, 60, 8, 8, 8, 12, 12
#: Bounded training sample: documents of each label and the longest of them in characters; passes and rate.
SAMPLE, LONGEST_SAMPLE, PASSES, BATCH, RATE = 2500, 20_000, 3, 64, 0.01
#: Random windows of clean documents to learn from, about (up to six of a document), and the least batches.
RANDOM_WINDOWS, LEAST_BATCHES = 3000, 200
#: Share of words that are read by their characters alone in training.
UNKNOWN = 0.3
#: Windows scored at once, words that a worker remembers, and characters of words that are spelled at once.
AT_ONCE, WORDS_KEPT, SPELLED = 512, 120_000, 60_000
WORD = re.compile(r"[^\W_]+")


def words(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def starts(n: int) -> list[int]:
    """Starts of the overlapping windows of n words: every word lies in one, the last one ends with the text."""
    return [0] if n <= WINDOW else [*range(0, n - WINDOW, STRIDE), n - WINDOW]


class Network:
    """Characters of a word -> forward and backward states, beside the word's own vector -> forward and backward
    states over a window -> attention -> a logit. Number 0 is the space outside a short window."""

    def __init__(self, vocabulary: list[str], characters: list[str], seed: int = 3):
        rng, f = np.random.default_rng(seed), np.float32
        self.words = {w: i + 1 for i, w in enumerate(vocabulary)}
        self.characters = {c: i + 2 for i, c in enumerate(characters)}
        inputs, w = WORD_SIZE + 2 * CHAR_STATES, {}
        w["word"] = 0.3 * rng.standard_normal((len(vocabulary) + 1, WORD_SIZE)).astype(f)
        w["char"] = 0.5 * rng.standard_normal((len(characters) + 2, CHAR_SIZE)).astype(f)
        for way in "fb":
            w[f"cx{way}"], w[f"cu{way}"], w[f"cb{way}"] = gru.weights(rng, CHAR_SIZE, 3 * CHAR_STATES), gru.weights(rng, CHAR_STATES, 3 * CHAR_STATES), np.zeros(CHAR_STATES, f)
            w[f"x{way}"], w[f"u{way}"], w[f"b{way}"] = gru.weights(rng, inputs, 3 * STATES), gru.weights(rng, STATES, 3 * STATES), np.zeros(STATES, f)
        w["a"], w["v"] = gru.weights(rng, 2 * STATES, ATTENTION), gru.weights(rng, ATTENTION, 1)
        w["out"], w["bias"] = gru.weights(rng, 2 * STATES, 1), np.zeros(1, f)
        self.w, self.scale = w, (1.0, 0.0)

    def codes(self, names: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Numbered characters of words, all of them, one word after another; where each begins, and its size."""
        get = self.characters.get
        sizes = np.fromiter(map(len, names), np.int64, len(names))
        flat = np.fromiter((get(c, 1) for name in names for c in name), np.int64, int(sizes.sum()))
        return flat, np.cumsum(sizes) - sizes, sizes

    def numbers(self, names: list[str], rng: np.random.Generator | None = None) -> np.ndarray:
        """Of words with vectors of their own, 0 for others; with rng, some of them count as others."""
        out = np.fromiter((self.words.get(n, 0) for n in names), np.int64, len(names))
        return out if rng is None else np.where(rng.random(len(out)) < UNKNOWN, 0, out)

    def spell(self, names: list[str], numbers: np.ndarray | None = None, record: list | None = None) -> np.ndarray:
        """The inputs of words: their own vectors and their characters' last states both ways. Words are read longest
        first, so that those still going on stand in front: the work is that of the characters there are."""
        flat, begin, sizes = self.codes(names)
        table = {way: self.w["char"] @ self.w[f"cx{way}"] for way in "fb"}
        order = np.argsort(-sizes, kind="stable")
        falling = -sizes[order]
        parts = [self.w["word"][self.numbers(names) if numbers is None else numbers]]
        for way in "fb":
            h, trail = np.zeros((len(names), CHAR_STATES), np.float32), []
            for t in range(int(sizes.max(initial=0))):
                on = order[: np.searchsorted(falling, -t, side="left")]  # words of more than t characters
                c = flat[begin[on] + (t if way == "f" else sizes[on] - 1 - t)]
                if record is None:
                    h[on] = gru.step(table[way][c], h[on], self.w[f"cu{way}"], self.w[f"cb{way}"])
                else:
                    out, saved = gru.forward(table[way][c][None], h[on], self.w[f"cu{way}"], self.w[f"cb{way}"])
                    h[on] = out[0]
                    trail.append((on, c, saved))
            parts.append(h)
            if record is not None:
                record.append(trail)
        return np.concatenate(parts, axis=1)

    def logits(self, x: dict[str, np.ndarray], there: np.ndarray) -> np.ndarray:
        """Of windows (windows, WINDOW): x has each word's share of the gates both ways."""
        h = self.states(x)
        score = (np.tanh(h @ self.w["a"]) @ self.w["v"])[..., 0]
        score = np.where(there.T, score, -1e9)
        weight = np.exp(score - score.max(axis=0))
        weight /= weight.sum(axis=0)
        return ((h @ self.w["out"])[..., 0] * weight).sum(axis=0) + self.w["bias"][0]

    def states(self, x: dict[str, np.ndarray]) -> np.ndarray:
        n, steps = x["f"].shape[1], x["f"].shape[0]
        out = np.empty((steps, n, 2 * STATES), np.float32)
        f = b = np.zeros((n, STATES), np.float32)
        for t in range(steps):
            f = gru.step(x["f"][t], f, self.w["uf"], self.w["bf"])
            b = gru.step(x["b"][steps - 1 - t], b, self.w["ub"], self.w["bb"])
            out[t, :, :STATES], out[steps - 1 - t, :, STATES:] = f, b
        return out

    def learn(self, windows: list[list[str]], labels: np.ndarray, rng: np.random.Generator | None = None) -> tuple[float, dict[str, np.ndarray]]:
        """Mean loss of a batch and its gradients."""
        w, n = self.w, len(windows)
        names = sorted({*(x for win in windows for x in win), ""})
        at = {x: i for i, x in enumerate(names)}  # "" is the space, number 0
        k = np.zeros((n, WINDOW), np.int64)
        there = np.zeros((n, WINDOW), bool)
        for i, win in enumerate(windows):
            k[i, : len(win)] = [at[x] for x in win]
            there[i, : max(1, len(win))] = True
        record: list = []
        numbers = self.numbers(names, rng)
        inputs = self.spell(names, numbers, record)
        seen = inputs[k.T]  # steps, windows, inputs
        trail, h = {}, np.empty((WINDOW, n, 2 * STATES), np.float32)
        zero = np.zeros((n, STATES), np.float32)
        hf, trail["f"] = gru.forward(seen @ w["xf"], zero, w["uf"], w["bf"])
        hb, trail["b"] = gru.forward((seen @ w["xb"])[::-1], zero, w["ub"], w["bb"])
        h[..., :STATES], h[..., STATES:] = hf, hb[::-1]
        act = np.tanh(h @ w["a"])
        score = np.where(there.T, (act @ w["v"])[..., 0], -1e9)
        weight = np.exp(score - score.max(axis=0))
        weight /= weight.sum(axis=0)
        value = (h @ w["out"])[..., 0]
        logit = (value * weight).sum(axis=0) + w["bias"][0]
        p = gru.sigmoid(logit)
        loss = float(-np.mean(np.log(np.where(labels > 0, p, 1 - p) + 1e-9)))
        g: dict[str, np.ndarray] = {}
        d_logit = ((p - labels) / n).astype(np.float32)
        g["bias"] = d_logit.sum(keepdims=True)
        d_value = weight * d_logit
        d_score = weight * (value - (value * weight).sum(axis=0)) * d_logit
        g["out"] = np.einsum("twk,tw->k", h, d_value)[:, None]
        d_act = d_score[..., None] * w["v"][:, 0] * (1 - act * act)
        g["v"] = np.einsum("twk,tw->k", act, d_score)[:, None]
        g["a"] = h.reshape(-1, 2 * STATES).T @ d_act.reshape(-1, ATTENTION)
        d_h = d_value[..., None] * w["out"][:, 0] + d_act @ w["a"].T
        d_seen = np.zeros_like(seen)
        for way, d in (("f", d_h[..., :STATES]), ("b", d_h[::-1, :, STATES:])):
            d_x, _, g[f"u{way}"], g[f"b{way}"] = gru.backward(np.ascontiguousarray(d), trail[way], w[f"u{way}"])
            d_x = d_x if way == "f" else d_x[::-1]
            g[f"x{way}"] = seen.reshape(-1, seen.shape[-1]).T @ d_x.reshape(-1, 3 * STATES)
            d_seen += d_x @ w[f"x{way}"].T
        d_in = np.zeros_like(inputs)
        np.add.at(d_in, k.T.reshape(-1), d_seen.reshape(-1, inputs.shape[1]))
        g["word"] = np.zeros_like(w["word"])
        np.add.at(g["word"], numbers, d_in[:, :WORD_SIZE])
        g["char"] = np.zeros_like(w["char"])
        for i, way in enumerate("fb"):
            d_hc = d_in[:, WORD_SIZE + i * CHAR_STATES : WORD_SIZE + (i + 1) * CHAR_STATES].copy()
            g[f"cu{way}"], g[f"cb{way}"], g[f"cx{way}"] = np.zeros_like(w[f"cu{way}"]), np.zeros(CHAR_STATES, np.float32), np.zeros_like(w[f"cx{way}"])
            for on, c, saved in reversed(record[i]):
                d_x, d_hc[on], d_u, d_b = gru.backward(d_hc[on][None], saved, w[f"cu{way}"])
                g[f"cu{way}"] += d_u
                g[f"cb{way}"] += d_b
                g[f"cx{way}"] += w["char"][c].T @ d_x[0]
                np.add.at(g["char"], c, d_x[0] @ w[f"cx{way}"].T)
        return loss, g


def suspicion(texts: list[list[str]], labels: np.ndarray) -> dict[str, float]:
    """How much more often toxic documents hold a word or a word's beginning: log odds, where that is plain."""
    yes, no = Counter(), Counter()
    for found, label in zip(texts, labels, strict=True):
        (yes if label else no).update({w for w in found} | {f"{w[:4]}*" for w in found if len(w) > 4})
    n_yes, n_no = labels.sum() + 1, (labels == 0).sum() + 1
    odds = {w: float(np.log((n + 0.5) / n_yes) - np.log((no[w] + 0.5) / n_no)) for w, n in yes.items() if n >= 3}
    return {w: o for w, o in odds.items() if o > 1}


def train(texts: list[str], labels: list[int], prior: float = 0.5, passes: int = PASSES, seed: int = 4) -> Network:
    """Labels are of whole documents: the windows to learn from lie around the most suspicious word of a toxic
    document; of another they are some at random and the most suspicious one. At last the logit of a document's
    top window is scaled to the chance of its label, where `prior` is the share of toxic documents outside the
    sample."""
    rng, read, y = np.random.default_rng(seed), [words(t) for t in texts], np.array(labels, np.float32)
    counted, spelled = Counter(w for r in read for w in r), Counter()
    for w, n in counted.items():
        spelled.update({c: n for c in w})
    top = lambda c, n, least=1: [x for x, k in sorted(c.items(), key=lambda i: (-i[1], i[0]))[:n] if k >= least]
    net = Network(top(counted, WORDS, 4), top(spelled, CHARACTERS))
    if not len(y) or y.min() == y.max():
        return net
    odds = suspicion(read, y)
    value = lambda w: max(odds.get(w, 0.0), odds.get(f"{w[:4]}*", 0.0))
    toxic, clean = [], []
    extra = int(np.clip(RANDOM_WINDOWS // (y == 0).sum(), 1, 6))
    for found, label in zip(read, labels, strict=True):
        each = [value(w) for w in found]
        if label:
            toxic.append((found, each, int(np.argmax(each)) if each else 0))
        else:
            parts = [found[s : s + WINDOW] for s in starts(len(found))]
            clean.append(max(parts, key=lambda p: max(map(value, p), default=0.0)))
            clean += [parts[i] for i in rng.permutation(len(parts))[:extra]]

    def example(found: list[str], each: list[float], at: int) -> list[str]:
        """A window at random around the most suspicious word; half of them keep only their suspicious words,
        in a clean window, so that what else stands there isn't learned by heart."""
        begin = int(np.clip(at - rng.integers(WINDOW), 0, max(0, len(found) - WINDOW)))
        window = found[begin : begin + WINDOW]
        if rng.random() < 0.5:
            other = clean[rng.integers(len(clean))] or window
            window = [w if v > 1 else other[i % len(other)] for i, (w, v) in enumerate(zip(window, each[begin:], strict=False))]
        return shorter(window, at - begin)

    def shorter(window: list[str], at: int) -> list[str]:
        """One in five windows is cut to a part around a word, as short texts are windows, too."""
        if rng.random() > 0.2 or not window:
            return window
        first, last = rng.integers(at + 1), rng.integers(at, len(window))
        return window[first : last + 1]

    adam, half = gru.Adam(net.w, RATE), BATCH // 2
    batches = max(passes * (len(toxic) + len(clean)) // BATCH, LEAST_BATCHES)
    marks = np.repeat(np.array([1, 0], np.float32), half)
    for i in range(batches):
        chosen = [example(*toxic[k]) for k in rng.integers(len(toxic), size=half)] + [shorter(c, rng.integers(max(1, len(c)))) for c in (clean[k] for k in rng.integers(len(clean), size=half))]
        _, grads = net.learn(chosen, marks, rng)
        adam(grads, RATE * max(0.1, 1 - i / batches))
    logit = np.array(Scorer(net).top(texts))
    logit, y = logit[np.isfinite(logit)], y[np.isfinite(logit)]
    if not len(y) or y.min() == y.max():
        return net
    weight = np.where(y > 0, prior / y.mean(), (1 - prior) / (1 - y.mean()))
    a, b = 1.0, 0.0
    for _ in range(200):
        p = gru.sigmoid(a * logit + b)
        e = weight * (p - y)
        s = weight * np.maximum(p * (1 - p), 1e-4)
        hess = np.array([[(s * logit * logit).mean() + 1e-3, (s * logit).mean()], [(s * logit).mean(), s.mean() + 1e-3]])
        step = np.linalg.solve(hess, np.array([(e * logit).mean(), e.mean()]))
        a, b = a - np.clip(step[0], -0.2, 0.2), b - np.clip(step[1], -0.5, 0.5)
    net.scale = (float(max(a, 0.1)), float(b))
    return net


class Scorer:
    """Scores whole texts; remembers words' shares of the gates, and forgets them all when they are too many."""

    def __init__(self, net: Network):
        self.net = net
        self._forget()

    def _forget(self) -> None:
        self.rows: dict[str, int] = {}
        self.table = np.zeros((0, 6 * STATES), np.float32)
        self._learn([""])

    def _learn(self, names: list[str]) -> None:
        if names:
            self.rows.update(zip(names, range(len(self.rows), len(self.rows) + len(names)), strict=True))
            gates = np.hstack([self.net.w["xf"], self.net.w["xb"]])
            ends = np.cumsum([len(n) + 1 for n in names])
            cuts = np.unique(np.searchsorted(ends, np.arange(SPELLED, ends[-1], SPELLED), side="right")).tolist()
            self.table = np.vstack([self.table, *(self.net.spell(names[a:b]) @ gates for a, b in zip([0, *cuts], [*cuts, len(names)], strict=True) if a < b)])

    def top(self, texts: list[str | None]) -> list[float]:
        """The largest logit of any window of each text; minus infinity for a text without words."""
        read = [words(t) for t in texts]
        if len(self.rows) > WORDS_KEPT:
            self._forget()
        self._learn(list(set().union(*read).difference(self.rows)))
        flat = np.fromiter((self.rows[w] for r in read for w in r), np.int64)
        sizes = np.fromiter(map(len, read), np.int64, len(read))
        first = np.concatenate([[0], np.cumsum(sizes)[:-1]]) if len(read) else sizes
        begins = [starts(n) for n in sizes.tolist()]
        owner = np.repeat(np.arange(len(read)), [len(b) for b in begins])
        at = np.array([s for b in begins for s in b], np.int64)
        size = np.minimum(sizes[owner] - at, WINDOW)
        out = np.full(len(read), -np.inf)
        for i in range(0, len(at), AT_ONCE):
            rows = slice(i, i + AT_ONCE)
            there = np.arange(WINDOW) < size[rows][:, None]
            place = np.minimum(first[owner[rows]][:, None] + at[rows][:, None] + np.arange(WINDOW), max(len(flat) - 1, 0))
            k = np.where(there, flat[place] if len(flat) else 0, 0).T
            there[:, 0] = True
            shares = self.table[k]
            logit = self.net.logits({"f": shares[..., : 3 * STATES], "b": shares[..., 3 * STATES :]}, there)
            np.maximum.at(out, owner[rows], logit)
        out[sizes == 0] = -np.inf
        return out.tolist()

    def __call__(self, texts: list[str | None]) -> list[float]:
        a, b = self.net.scale
        return gru.sigmoid(np.clip(a * np.array(self.top(texts)) + b, -30, 30)).tolist()


def fit(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE) -> Network:
    """Trained on a bounded sample: about `sample` documents of each label by a hash of the key, of at most
    LONGEST_SAMPLE characters, whole; none that is held out. A key with several labels has the larger one, and
    of rows that share a key one is learned from, so that no key can fill the sample."""
    marked = labels.select(F.col(key).cast("bigint").alias("k"), F.col(label).cast("int").alias("y")).where("k is not null and y is not null").groupBy("k").agg(F.max("y").alias("y"))
    read = docs.where((remainder(key, HELD_OUT[0]) != HELD_OUT[1]) & (F.length(text) <= LONGEST_SAMPLE)).select(F.col(key).cast("bigint").alias("k"), F.col(text).alias("t"))
    sizes = {r.y: r["count"] for r in marked.groupBy("y").count().collect()}
    share = F.coalesce(*(F.when(F.col("y") == y, F.lit(int(min(1.0, sample / n) * (1 << 50)))) for y, n in sizes.items()), F.lit(0))
    chosen = marked.where(F.pmod(F.xxhash64("k"), F.lit(1 << 50)) < share)
    rows = read.join(F.broadcast(chosen), "k").groupBy("k").agg(F.min("t").alias("t"), F.max("y").alias("y")).collect()
    rows = sorted((r.k, r.t, int(r.y > 0)) for r in rows)
    prior = sum(n for y, n in sizes.items() if y > 0) / max(1, sum(sizes.values()))
    return train([t for _, t, _ in rows], [y for _, _, y in rows], prior)


def chance(net: Network, spark: SparkSession, text: str = "text") -> Column:
    """The chance that a text is toxic, by its most toxic window; the network goes to each worker once."""
    shared = spark.sparkContext.broadcast(net)

    @F.pandas_udf("double")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(shared.value)
        for texts in batches:
            found: list[float] = []
            for at in range(0, len(texts), ROWS_AT_ONCE):
                found += scorer([None if t is None else t for t in texts.iloc[at : at + ROWS_AT_ONCE]])
            yield pd.Series(found, dtype="float64")

    return of(F.col(text))


def score(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "toxic") -> DataFrame:
    """(key, held_out, score, predicted) of each row of `docs`.

    held_out: crc32(key as text) mod 4 is 2; their labels are never learned from. score: from the most toxic of
    all overlapping windows of the whole text; nothing but the text is looked at. predicted: 1 from THRESHOLD
    on. Null and empty texts, and those without letters and digits, score next to 0. Repeated rows and null keys are rows like any
    other; without labels of both kinds the network is untrained; an empty table gives no rows.
    """
    net = fit(docs, labels, key=key, text=text, label=label)
    held_out = remainder(key, HELD_OUT[0]) == HELD_OUT[1]
    scored = docs.select(F.col(key).alias("k"), held_out.alias("held_out"), chance(net, docs.sparkSession, text).alias("score"))
    return scored.select(F.col("k").alias(key), "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "toxic") -> DataFrame:
    """The rows of `docs`, all columns, whose score is below THRESHOLD."""
    net = fit(docs, labels, key=key, text=text, label=label)
    return docs.where(chance(net, docs.sparkSession, text) < THRESHOLD)
