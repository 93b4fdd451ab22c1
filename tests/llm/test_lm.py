import math
import zlib
from collections import Counter

import numpy as np
import pytest

from docketmill.llm import gru, lm


def brute(rows):
    """Contract columns but score, from the definitions."""
    read = [(k, (lm.tokens(t) + [lm.END]), (zlib.crc32(str(k).encode()) if k is not None else 0) % 7 == 2) for k, t in rows]
    counts = Counter(w for _, words, held in read if not held for w in words)
    n, v = sum(counts.values()), len(counts)
    return [(k, held, len(words), sum(counts[w] > 0 for w in words), n, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words)) for k, words, held in read]


@pytest.mark.parametrize("held", [lm.HELD_WORDS, 5])
def test_base_against_brute_force(docs, awkward, monkeypatch, held):
    monkeypatch.setattr(lm, "HELD_WORDS", held)
    got = lm.score(docs).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[2], r[5])
    want = sorted(brute([(r[0], r[1]) for r in awkward]), key=key)
    rows = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got), key=key)
    for a, b in zip(rows, want, strict=True):
        assert a[:5] == b[:5] and a[5] == pytest.approx(b[5], rel=1e-9)
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)


def test_long_words_are_counted_and_held_like_any_other(spark):
    long, other = "x" * 500 + "ng", "x" * 501 + "ng"
    assert lm.ending(lm.tokens(long)[0]) == lm.ending(b"ng") and len(lm.tokens(long)[0]) == 19 and lm.tokens("y" * 64) == [b"y" * 64]
    rows = [(i, f"{long} a {long.upper() if i % 2 else other}") for i in range(60)]
    known = lm.table(lm.word_counts(spark.createDataFrame(rows, "k long, text string")))
    assert dict(zip(known.words, known.counts.tolist(), strict=True)) == {lm.tokens(long)[0]: 90, b"a": 60, lm.tokens(other)[0]: 30}
    training = [t for k, t in rows if zlib.crc32(str(k).encode()) % 7 != 2]
    counts = Counter(w for t in training for w in [*t.lower().split(), ""])
    total = sum(counts.values()) + len(counts) + 1
    for r in lm.score(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        assert r.base_score == pytest.approx(sum(math.log10((counts[w] + 1) / total) for w in [*rows[r.doc_id][1].lower().split(), ""])) and r.n_known == 4


def test_score_is_the_model_s_and_the_whole_text_s(spark):
    model = lm.Model(np.arange(200, 0, -1.0))
    rng = np.random.default_rng(1)
    model.w = {k: v + 0.3 * rng.standard_normal(v.shape).astype(np.float32) for k, v in model.w.items()}
    sequences = [rng.integers(0, 200, n) for n in (1, 5, 700, 64, 65, 3, 150)]

    def plain(s):
        h, total, before = np.zeros((1, lm.STATES), np.float32), 0.0, 0
        for x in s:
            h = gru.step(model.w["x"][[before]], h, model.w["u"], model.w["b"])
            total += model.outputs(h, np.array([x]))[0][0]
            before = x
        return total

    want = [plain(s) for s in sequences]
    assert np.allclose(model.score(sequences), want, rtol=1e-3)
    old, lm.SCORING_LANES = lm.SCORING_LANES, 2
    assert np.allclose(model.score(sequences), want, rtol=1e-3)
    lm.SCORING_LANES = old


def test_probabilities_sum_to_one(spark):
    words = [f"w{i} w{i * i % 17} the a" for i in range(300)]
    frame = spark.createDataFrame([*enumerate(words)], "k long, text string")
    counts = lm.word_counts(frame)
    known = lm.table(counts)
    scorer = lm.Scorer(known)
    model = lm.Model(scorer.symbol_counts())
    h = np.random.default_rng(0).standard_normal((1, lm.STATES)).astype(np.float32)
    every = np.arange(model.symbols)
    p = np.exp(model.outputs(np.repeat(h, model.symbols, 0), every)[0])
    assert p.sum() == pytest.approx(1, abs=1e-3)
    assert known.total == 300 * 5 and known.distinct == counts.count() and known.end == 300


def test_gradients():
    model = lm.Model(np.arange(100, 0, -1.0))
    model.w = {k: (v + 0.1 * np.random.default_rng(3).standard_normal(v.shape)).astype(np.float64) for k, v in model.w.items()}
    rng = np.random.default_rng(0)
    x, y = rng.integers(0, 3, (6, 4)), rng.integers(0, 100, (6, 4))
    keep = (x != 0).astype(float)

    def loss(grads=None):
        states, record = gru.forward(model.w["x"][x], np.zeros((4, lm.STATES)), model.w["u"], model.w["b"], keep)
        out, d = model.outputs(states.reshape(-1, lm.STATES), y.reshape(-1), grads)
        if grads is not None:
            d_x, _, grads["u"], grads["b"] = gru.backward(d.reshape(states.shape), record, model.w["u"], keep)
            grads["x"] = np.zeros_like(model.w["x"])
            np.add.at(grads["x"], x.reshape(-1), d_x.reshape(-1, 3 * lm.STATES))
        return -out.mean()

    grads: dict = {}
    loss(grads)
    for name, g in grads.items():
        for _ in range(4):
            at = tuple(rng.integers(min(s, 3)) for s in g.shape)
            kept = model.w[name][at]
            losses = []
            for d in (1e-5, -1e-5):
                model.w[name][at] = kept + d
                losses.append(loss())
            model.w[name][at] = kept
            assert (losses[0] - losses[1]) / 2e-5 == pytest.approx(g[at], rel=1e-3, abs=1e-7), name


def test_training_beats_the_unigram_model_on_held_out_texts(spark):
    rng = np.random.default_rng(5)
    topics = [[f"{c}{i}" for i in range(40)] for c in "abc"]
    rows = [(i, " ".join(rng.choice(topics[i % 3], 60))) for i in range(900)]
    got = [r for r in lm.score(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r.held_out]
    assert len(got) > 80 and np.mean([r.score > r.base_score for r in got]) > 0.95


def test_empty_table_untrained_and_clashing_columns(spark, none, clashing, docs):
    assert lm.score(none).collect() == []
    held = next(k for k in range(100) if zlib.crc32(str(k).encode()) % 7 == 2)
    r = lm.score(spark.createDataFrame([(held, "a b")], "doc_id long, text string")).first()
    assert (r.n_tokens, r.n_known, r.train_tokens, r.base_score) == (3, 0, 0, 0.0)
    rows = lambda d: sorted((r.doc_id or -1, r.n_tokens, r.n_known, round(r.base_score, 6)) for r in lm.score(d).collect())
    assert rows(clashing) == rows(docs)
