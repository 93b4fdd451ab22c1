import random
import zlib

import numpy as np
import pytest

from docketmill.llm import toxicity

rnd = random.Random(31)
WORDS = ["".join(rnd.choice("abcdefghij") for _ in range(rnd.randrange(2, 8))) for _ in range(400)]
BAD = ["zorkish", "blagga", "quumple"]
text = lambda n: [rnd.choice(WORDS) for _ in range(n)]


def document(bad, n):
    found = text(n)
    if bad:
        for _ in range(2):
            found.insert(rnd.randrange(len(found) + 1), rnd.choice([*BAD, "vext" + rnd.choice(WORDS)]))
    return " ".join(found)


@pytest.fixture(scope="module")
def rows():
    return [(i, document(i % 5 == 0, rnd.randrange(10, 300)), int(i % 5 == 0)) for i in range(700)]


def test_held_out_accuracy_and_contract(spark, rows):
    extra = [(9000, None), (9001, ""), (9002, " ".join(text(30_000))), (9003, " ".join(text(20_000)) + " zorkish vextabc " + " ".join(text(9_000))), (None, "zorkish blagga"), (None, "zorkish blagga")]
    docs = spark.createDataFrame([*((k, t) for k, t, _ in rows), *extra], "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([*((k, y) for k, _, y in rows), (None, 1), (5, None), (6, 0), (77777, 1)], "doc_id long, toxic int")
    got = toxicity.score(docs, labels).collect()
    assert len(got) == len(rows) + len(extra)
    truth = {k: y for k, _, y in rows}
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2 if r.doc_id is not None else False)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert np.mean([r.predicted for r in held if truth[r.doc_id]]) > 0.9
    assert np.mean([r.predicted for r in held if not truth[r.doc_id]]) < 0.05
    assert {r.doc_id: r.predicted for r in got if (r.doc_id or 0) >= 9000} == {9000: 0, 9001: 0, 9002: 0, 9003: 1}
    kept = toxicity.keep_clean(docs, labels).collect()
    assert len(kept) == sum(1 - r.predicted for r in got)


def test_gradients(rows):
    net = toxicity.Network(WORDS[:50], list("abcdefghij"))
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    windows = [t.split()[: toxicity.WINDOW] for _, t, _ in rows[:6]] + [["one"], []]
    labels = np.array([1, 0, 0, 1, 0, 1, 0, 1], np.float64)
    _, grads = net.learn(windows, labels)
    rng = np.random.default_rng(0)
    for name, g in grads.items():
        for _ in range(3):
            at = tuple(rng.integers(s) for s in g.shape)
            keep = net.w[name][at]
            losses = []
            for d in (1e-4, -1e-4):
                net.w[name][at] = keep + d
                losses.append(net.learn(windows, labels)[0])
            net.w[name][at] = keep
            assert (losses[0] - losses[1]) / 2e-4 == pytest.approx(g[at], rel=0.02, abs=2e-5), name


def plainly(net, found):
    """The largest logit of the windows of a list of words, one word, character and gate at a time."""
    w, sig = {k: v.astype(np.float64) for k, v in net.w.items()}, lambda x: 1 / (1 + np.exp(-x))

    def gru(inputs, wx, u, b, size):
        h = np.zeros(size)
        for x in inputs:
            i, a = x @ wx, h @ u
            z, r = sig(i[:size] + a[:size]), sig(i[size : 2 * size] + a[size : 2 * size])
            new = np.tanh(i[2 * size :] + r * (a[2 * size :] + b))
            h = (1 - z) * new + z * h
            yield h

    def spelled(word):
        chars = [w["char"][net.characters.get(c, 1)] for c in word]
        last = lambda way, cs: ([np.zeros(toxicity.CHAR_STATES), *gru(cs, w[f"cx{way}"], w[f"cu{way}"], w[f"cb{way}"], toxicity.CHAR_STATES)])[-1]
        return np.concatenate([w["word"][net.words.get(word, 0)], last("f", chars), last("b", chars[::-1])])

    logits = []
    for at in toxicity.starts(len(found)):
        window = found[at : at + toxicity.WINDOW]
        inputs = [spelled(x) for x in window] + [spelled("")] * (toxicity.WINDOW - len(window))
        states = toxicity.STATES
        forward = list(gru(inputs, w["xf"], w["uf"], w["bf"], states))
        backward = list(gru(inputs[::-1], w["xb"], w["ub"], w["bb"], states))[::-1]
        h = np.array([np.concatenate(x) for x in zip(forward, backward, strict=True)])[: len(window)]
        e = np.exp(np.tanh(h @ w["a"]) @ w["v"])[:, 0]
        logits.append(float((e / e.sum()) @ (h @ w["out"])[:, 0] + w["bias"][0]))
    return max(logits)


def test_scores_of_whole_documents_against_a_plain_forward_pass(rows):
    net = toxicity.train([t for _, t, _ in rows[:80]], [y for _, _, y in rows[:80]])
    long = "".join(rnd.choice("abcdefghijz") for _ in range(400))
    texts = [t for _, t, _ in rows[100:112]] + ["one", " ".join([*text(40), long, *text(40), "Abcdefghijabcdefghij"])]
    a, b = net.scale
    want = [1 / (1 + np.exp(-(a * plainly(net, toxicity.words(t)) + b))) for t in texts]
    assert np.allclose(toxicity.Scorer(net)(texts), want, atol=1e-4)


def test_every_character_of_a_long_word_is_read(monkeypatch):
    net = toxicity.Network([], list("abcdefghijklmnopqrstuvwxyz"))
    one, other = net.spell(["abcdefgqqqqqqhijklmn"]), net.spell(["abcdefgzzzzhijklmn"])
    assert np.abs(one - other).max() > 1e-3
    names = ["a" * n for n in (1, 14, 15, 300, 0, 60)] + ["bcd"]
    together = net.spell(names)
    assert np.allclose(together, np.vstack([net.spell([n]) for n in names]), atol=1e-6)
    whole = toxicity.Scorer(net)
    whole._learn(names)
    monkeypatch.setattr(toxicity, "SPELLED", 20)
    few = toxicity.Scorer(net)
    few._learn(names)
    assert np.allclose(whole.table, few.table, atol=1e-6)


def test_windows_cover_every_word_and_overlap():
    for n in (0, 1, 31, 32, 33, 100, 1000):
        s = toxicity.starts(n)
        assert s[0] == 0 and s[-1] + toxicity.WINDOW >= n and all(0 < b - a <= toxicity.STRIDE for a, b in zip(s, s[1:], strict=False))


def test_scores_do_not_depend_on_the_batch(rows):
    net = toxicity.train([t for _, t, _ in rows[:60]], [y for _, _, y in rows[:60]])
    texts = [t for _, t, _ in rows[:50]] + [None, "", "x"]
    whole = toxicity.Scorer(net)(texts)
    one = toxicity.Scorer(net)
    assert np.allclose(whole, [one([t])[0] for t in texts], atol=1e-4)


def test_no_labels_empty_tables_and_clashing_columns(spark, none, clashing, docs):
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.score(none, labels).collect() == []
    rows = lambda d: sorted((r.doc_id or -1, r.held_out, round(r.score, 4), r.predicted) for r in toxicity.score(d, labels).collect())
    assert rows(clashing) == rows(docs)
    assert toxicity.keep_clean(clashing, labels).columns == clashing.columns
