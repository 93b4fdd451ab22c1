import hashlib
import re

import pytest
from pyspark.sql import functions as F

from docketmill.llm import exact


def brute(rows):
    """(key, keep, size, kept, digest) of (key, text) rows."""
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in rows]
    groups = {}
    for i, t in enumerate(norm):
        groups.setdefault(t, []).append(i)
    out = []
    for i, (k, _) in enumerate(rows):
        own = groups[norm[i]]
        first = min(own, key=lambda j: (rows[j][0] is None, rows[j][0] or 0, j))
        out.append((k, rows[first][0], len(own), rows[first][0] == k, hashlib.sha256(norm[i].encode()).hexdigest()))
    return sorted(out, key=str)


def plain(frame):
    return sorted((tuple(r) for r in frame.collect()), key=str)


def test_rows_are_those_of_brute_force(docs, awkward):
    rows = [(r[0], r[1]) for r in awkward]
    got = plain(exact.exact_duplicates(docs, every_digest=True))
    want = brute(rows)
    assert [(r[0], r[1], r[2], r[4]) for r in got] == [(r[0], r[1], r[2], r[4]) for r in want]
    assert sum(r[3] for r in got) == len({r[4] for r in want})  # one row of each group stays, repeated rows included


def test_only_what_two_steps_leave_is_hashed_whole(spark):
    rows = [(1, "a" * 100), (2, "b" * 100), (3, "a" * 70 + "c" * 30), (4, "a" * 100), (5, "short")]
    got = {r[0]: r for r in plain(exact.exact_duplicates(spark.createDataFrame(rows, "doc_id long, text string")))}
    assert {k for k, r in got.items() if r[4]} == {1, 3, 4}  # 3 shares size and prefix, not its text
    assert [got[k][1:4] for k in (1, 2, 3, 4, 5)] == [(1, 2, True), (2, 1, True), (3, 1, True), (1, 2, False), (5, 1, True)]


def test_a_full_filter_changes_nothing(docs):
    few, many = (plain(exact.exact_duplicates(docs, every_digest=True, filter_bits=b)) for b in (1, 25))
    assert [r[:3] for r in few] == [r[:3] for r in many]


def test_every_bit_of_the_filter_is_read_back(spark):
    at = spark.range(1, 40_001).where("id % 3 = 0").select(F.col("id").alias("at"))
    made = at.groupBy(F.bitmap_bucket_number("at").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bitmap"))
    every = spark.range(1, 40_001).withColumn("bucket", F.bitmap_bucket_number("id")).join(made, "bucket", "left")
    wrong = every.where(exact._taken(F.col("bitmap"), F.bitmap_bit_position("id")) != (F.col("id") % 3 == 0))
    assert wrong.count() == 0


def test_whitespace_length_and_order(spark):
    rows = [(9, "a \t\n b"), (2, "a b"), (5, "a\x0bb"), (7, "a\x85b"), (None, "x"), (3, "x"), (None, ""), (None, None), (1, " "), (4, "  ")]
    got = plain(exact.exact_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), every_digest=True))
    assert [r[:3] for r in got] == [r[:3] for r in brute(rows)]
    assert sum(r[3] for r in got) == 5


def test_clashing_columns_empty_tables_and_text_keys(docs, clashing, none, spark):
    assert plain(exact.exact_duplicates(clashing.withColumns({c: F.lit(1) for c in ("size", "prefix", "bucket", "bitmap", "row", "t")}))) == plain(exact.exact_duplicates(docs))
    assert exact.exact_duplicates(none).collect() == []
    named = spark.createDataFrame([("b", "x y"), ("a", "x  y"), ("c", "z")], "name string, body string")
    assert [r[:4] for r in plain(exact.exact_duplicates(named, key="name", text="body"))] == [("a", "a", 2, True), ("b", "a", 2, False), ("c", "c", 1, True)]


def test_deduplicated_keeps_columns_and_first_rows(spark):
    rows = [(1, "a  b", "x"), (2, "a b", "y"), (3, "c", None)]
    kept = exact.deduplicated(spark.createDataFrame(rows, "doc_id long, text string, other string"))
    assert sorted(map(tuple, kept.collect())) == [rows[0], rows[2]]


@pytest.mark.parametrize("copies", [3000])
def test_a_hot_group(spark, copies):
    hot = spark.range(copies).select(F.col("id").alias("doc_id"), F.lit("same text  here").alias("text"))
    rest = spark.range(copies, 2 * copies).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"))
    found = exact.exact_duplicates(hot.union(rest))
    assert found.where("group_size = 3000 and keep_key = 0").count() == copies and found.where("kept").count() == copies + 1
