import random
import zlib

import numpy as np
import pytest

from docketmill.llm import language

SYLLABLES = {"aa": ["tha", "ing", "er", "the", "on"], "bb": ["che", "ung", "ei", "sch", "über"], "cc": ["ción", "os", "la", "que", "ra"]}


def text(rnd, lang, n):
    return " ".join("".join(rnd.choice(SYLLABLES[lang]) for _ in range(rnd.randrange(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(1)
    made = [(i, text(rnd, lang := rnd.choice("abc") * 2, rnd.randrange(8, 80)), lang, "s", 1) for i in range(400)]
    made += [(1000 + i, text(rnd, "aa", 60) + " " + text(rnd, "cc", 20), "aa", "s", 1) for i in range(30)]
    return made + [(2000, None, "aa", "s", 1), (2001, "", "bb", "s", 1), (2002, "12 34 _ ! ² Ⅷ", "aa", "s", 1), (None, "thaing theon", None, "s", 1), (2003, "que " * 40_000, None, None, None), (2003, "que " * 40_000, None, None, None)]


def test_held_out_accuracy_and_contract(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    got = language.identify(docs).collect()
    assert len(got) == len(rows)
    truth = {r[0]: r[2] for r in rows}
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2 if r.doc_id is not None else False)
        assert 0 <= r.score <= 1 and r.lang_pred in {"aa", "bb", "cc", "und"}
    clean = [r for r in got if r.held_out and r.doc_id < 1000]
    assert len(clean) > 60 and np.mean([r.lang_pred == truth[r.doc_id] for r in clean]) > 0.98
    mixed = [r for r in got if r.doc_id is not None and 1000 <= r.doc_id < 2000]
    assert all(r.lang_pred == "aa" and 0.55 < r.score < 0.95 for r in mixed)
    assert {r.doc_id: r.lang_pred for r in got if r.doc_id in (2000, 2001, 2002, 2003)} == {2000: "und", 2001: "und", 2002: "und", 2003: "cc"}
    only = np.mean([r.score == 1 for r in clean])
    assert only > 0.8  # the penalty takes out languages that are not there


def test_proportions_against_plain_em():
    rng = np.random.default_rng(0)
    ll, counts = rng.normal(-5, 3, (30, 3)), rng.integers(1, 5, 30).astype(float)
    share = np.full(3, 1 / 3)
    for _ in range(language.ROUNDS):
        joint = np.exp(ll) * share
        joint /= joint.sum(axis=1, keepdims=True)
        share = (joint * counts[:, None]).sum(axis=0) / counts.sum()
    got = language.mixtures(np.vstack([ll, ll[:4]]), np.concatenate([counts, counts[:4]]), np.array([30, 4]), penalty=-1e9)
    assert np.allclose(got[0], share)


def test_word_likelihoods_are_sums_over_trigrams(rows):
    model = language.Model.fit([(r[2], r[1]) for r in rows if r[1] and r[2]])
    names = ["tha", "überxyz", "q", "日本"]
    size = language.CHARACTERS + 2
    for name, got in zip(names, model.likelihoods(names), strict=True):
        codes = [0, 0, *(model.characters.get(c, 1) for c in name), 0]
        want = sum(model.table[(a * size + b) * size + c] for a, b, c in zip(codes, codes[1:], codes[2:], strict=False))
        assert np.allclose(got, want, rtol=1e-5)
    assert np.allclose(np.exp(model.table).reshape(size, size, size, -1)[0, 0, 1:].sum(axis=0), 1, atol=0.1)


def test_empty_table_and_clashing_columns(none, clashing, docs):
    assert language.identify(none).collect() == []
    rows = lambda d: sorted(map(str, language.identify(d).collect()))
    assert rows(clashing) == rows(docs)
    assert {r.lang_pred for r in language.identify(docs, lang="source").collect()} <= {"a", "b", "c", "und"}
    assert {r.lang_pred for r in language.identify(docs.withColumn("lang", docs.lang.substr(9, 1)).where("doc_id = 3")).collect()} == {"und"}


def test_a_language_of_long_texts_is_learned(spark):
    long, short = "le chat mange la souris et la nuit tombe sur la ville ", "the cat eats the mouse and night falls over the town "
    rows = [(i, long * 500 if i % 2 else short, "fr" if i % 2 else "en") for i in range(60)]
    found = language.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert all(r.lang_pred == ("fr" if r.doc_id % 2 else "en") for r in found)
