import random

import pytest

from docketmill import tables
from docketmill.operators.closure import Link, certificate, closure, out_of_reach

LINKS = [Link("a", "a", "t", "x", "y", "kind = 'aa'"), Link("a", "b", "t", "x", "y", "kind = 'ab'"), Link("b", "a", "t", "x", "y", "kind = 'ba'"), Link("b", "c", "t", "x", "concat('c', y)", "kind = 'bc'")]


def brute(rows, seeds, follow=None):
    seen, todo = set(seeds), list(seeds)
    while todo:
        kind, i = todo.pop()
        for k, x, y in rows:
            to = (k[1], f"c{y}" if k == "bc" else str(y))
            if k[0] == kind and str(x) == i and y is not None and (follow is None or (k[0], k[1]) in follow) and to not in seen:
                seen.add(to)
                todo.append(to)
    return seen


def run(spark, rows, seeds, **more):
    t = spark.createDataFrame(rows, "kind string, x long, y long")
    return closure({"t": t}, LINKS, spark.createDataFrame(seeds, "kind string, id string"), **more)


def pairs(frame):
    got = [tuple(r) for r in frame.collect()]
    assert len(got) == len(set(got))
    return set(got)


@pytest.mark.parametrize("seed", range(3))
def test_what_is_reached_is_what_a_walk_reaches(spark, seed):
    rnd = random.Random(seed)
    rows = [(rnd.choice(["aa", "ab", "ba", "bc"]), rnd.randrange(40), rnd.randrange(40)) for _ in range(70)] + [("aa", 3, 3), ("aa", None, 1), ("aa", 1, None), ("aa", 3, 3)]
    seeds = [("a", "3"), ("b", "7"), ("a", "3")]
    assert pairs(run(spark, rows, seeds)) == brute(rows, seeds)
    follow = {("a", "a"), ("a", "b")}
    assert pairs(run(spark, rows, seeds, follow=follow)) == brute(rows, seeds, follow)


def test_long_chains_hot_objects_and_nothing(spark):
    chain = [("aa", i, i + 1) for i in range(12)]
    hot = [("ab", 5, i) for i in range(3000)]
    got = pairs(run(spark, chain + hot, [("a", "0")]))
    assert len(got) == 13 + 3000
    assert pairs(run(spark, chain, [("z", "1"), ("a", None)])) == {("z", "1")}
    assert run(spark, chain[:0], []).collect() == []


def test_certificates_and_what_is_out_of_reach(spark):
    rows = [("aa", 1, 2), ("ab", 2, 3), ("bc", 9, 1)]
    t = {"t": spark.createDataFrame(rows, "kind string, x long, y long")}
    reached = closure(t, LINKS, spark.createDataFrame([("a", "1")], "kind string, id string"))
    assert {tuple(r) for r in out_of_reach(t, LINKS, reached).collect()} == {("b", 1), ("c", 1)}
    signed = {r.kind: r for r in certificate(reached, b"k").collect()}
    again = {r.kind: r for r in certificate(reached.orderBy("id", ascending=False), b"k").collect()}
    other = {r.kind: r for r in certificate(reached, b"other").collect()}
    assert signed == again and signed["a"].n == 2 and signed["a"].signature != other["a"].signature and signed["a"].digest == other["a"].digest


def test_written_tables_come_back_and_go(spark):
    frame = spark.createDataFrame([(1, None), (2, "b")], "k long, t string")
    kept = tables.written(frame)
    assert sorted(map(tuple, kept.collect())) == [(1, None), (2, "b")] and kept.schema == frame.schema
    files = kept.inputFiles()
    tables.dropped(kept)
    from pathlib import Path

    assert files and not Path(files[0].removeprefix("file://")).exists()
