import time

import numpy as np

from docketmill.llm import lm

SCHEMA = "k long, text string, held_out boolean"


def fitted(frame):
    return lm.fit(frame, lm.word_counts(frame), sample=50)[1]


def test_weights_learn_from_more_than_the_first_sample(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows = [(None if i % 3 == 0 else i, " ".join(f"w{j}" for j in (np.arange(60) + rng.integers(40)) % 40), False) for i in range(1500)]
    frame = spark.createDataFrame(rows, SCHEMA).repartition(2)
    monkeypatch.setattr(lm, "SHARE", 0.0)
    first = fitted(frame)
    monkeypatch.setattr(lm, "SHARE", 0.5)
    more = fitted(frame)
    reader = lm.Scorer(lm.table(lm.word_counts(frame)))
    texts = [reader.read(t)[0] for _, t, _ in rows[:60]]
    # Scores are logarithms: before, both were the same.
    assert more.score(texts).sum() > 0.99 * first.score(texts).sum() and all(np.isfinite(w).all() for w in more.w.values())


def test_long_texts_come_whole_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(lm, "LONGEST_SAMPLE", 10)
    frame = spark.createDataFrame([(1, "abcdefghij" * 3 + "kl", False), (2, "", False), (None, "0123456789", False), (3, "é" * 11, False)], SCHEMA)
    got = sorted(r.text for r in lm.pieces(frame, 0.0, 1.1).collect())
    assert got == ["", "0123456789", *["abcdefghij"] * 3, "kl", "é", "é" * 10]


def test_pieces_are_drawn_alike_however_rows_lie(spark, monkeypatch):
    monkeypatch.setattr(lm, "LONGEST_SAMPLE", 20)
    frame = spark.createDataFrame([(i, f"text {i} " * 40, False) for i in range(300)], SCHEMA)
    low, high, all_ = (sorted(r.text for r in lm.pieces(f, a, b).collect()) for f, a, b in ((frame.repartition(5), 0.0, 0.25), (frame.repartition(2), 0.25, 1.1), (frame, 0.0, 1.1)))
    assert sorted(low + high) == all_ and 0.2 < len(low) / len(all_) < 0.3
    assert sorted(r.text for r in lm.pieces(frame.coalesce(1), 0.0, 0.25).collect()) == low


def test_a_very_long_text_is_cut_in_time(spark):
    began = time.time()
    assert lm.pieces(spark.range(1).selectExpr("id as k", "repeat('some words ', 3000000) as text"), 0.0, 1.1).count() == 1650
    assert time.time() - began < 60


def test_workers_train_on_every_piece(spark):
    frame = spark.createDataFrame([(i, f"text {i} " * 40, False) for i in range(300)] + [(300, "long " * 9000, False)], SCHEMA)
    trained, every = (sorted(r.text for r in lm.pieces(frame, low, 1.1).collect()) for low in (1 - lm.SHARE, 0.0))
    assert trained == every
