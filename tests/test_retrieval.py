import difflib
import random

import pytest
from pyspark.sql import functions as F

from docketmill.operators import retrieval
from docketmill.plans import retrieval as plan
from docketmill.plans.compare import pairs

FOLDER = "/root/testdata/sf0.001"
FILES, THREADS = "file_id long, owner string, filename string, text string", "thread_id long, owner string, filename string, text string, seen_at long"


def ratio(a, b):
    return difflib.SequenceMatcher(None, (a or "").lower().split(), (b or "").lower().split(), autojunk=False).ratio()


def brute(files, threads, most=10, least=0.8):
    """Every file against every conversation of its owner, one by one."""
    out = {}
    for f in files:
        own = sorted((t for t in threads if t["owner"] == f["owner"] and f["owner"] is not None), key=lambda t: (-t["seen_at"], -t["thread_id"]))
        named = next((t["thread_id"] for t in own if f["stem"] and t["stem"] == f["stem"]), None)
        if named is not None:
            out[f["file_id"]] = (named, "name", None)
            continue
        near = next(((t["thread_id"], "text", r) for t in own[:most] if (r := ratio(f["text"], t["text"])) >= least), None)
        if near:
            out[f["file_id"]] = near
    return out


def stemmed(frame):
    from docketmill.functions.text import stem_of

    return [r.asDict() for r in frame.withColumn("stem", stem_of(F.col("filename"))).collect()]


def check(files, threads, **options):
    got = {r.file_id: (r.thread_id, r.how, r.likeness) for r in retrieval.conversations_of(files, threads, **options).collect()}
    assert got == brute(stemmed(files), stemmed(threads), **options)
    return got


def test_the_query_is_what_a_comparison_of_all_gives(spark):
    got = check(*plan.tables(spark, FOLDER))
    assert {how for _, how, _ in got.values()} == {"name", "text"}


@pytest.mark.parametrize("most,least", [(2, 0.8), (10, 0.4)])
def test_names_texts_ties_and_nulls(spark, most, least):
    rnd = random.Random(5)
    text = lambda: " ".join(rnd.choice("abcdef") for _ in range(rnd.randrange(0, 14)))
    threads = [(i, rnd.choice(["x", "y", None]), rnd.choice(["Deed.docx", "Lease v1.docx", "a.pdf", ""]), rnd.choice([text(), None]), rnd.randrange(5)) for i in range(60)]
    files = [(i, rnd.choice(["x", "y", "z", None]), rnd.choice(["deed (final).docx", "scan.pdf", ".docx"]), rnd.choice([text(), threads[rnd.randrange(60)][3], None])) for i in range(60)]
    check(spark.createDataFrame(files, FILES).repartition(3), spark.createDataFrame(threads, THREADS).repartition(3), most=most, least=least)
    assert retrieval.conversations_of(spark.createDataFrame([], FILES), spark.createDataFrame(threads, THREADS)).collect() == []


def test_bags_never_rule_out_what_is_alike(spark):
    rnd = random.Random(2)
    rows = [(" ".join(f"w{rnd.randrange(200)}" for _ in range(rnd.randrange(60))), " ".join(f"w{rnd.randrange(200)}" for _ in range(rnd.randrange(60)))) for _ in range(200)] + [("", ""), (None, "a")]
    frame = spark.createDataFrame(rows, "a string, b string")
    found = frame.select("a", "b", retrieval.bound(retrieval.bag(F.col("a")), retrieval.bag(F.col("b"))).alias("bound")).collect()
    assert all(ratio(r.a, r.b) <= r.bound + 1e-9 for r in found)


def test_similar_versions_against_every_pair(spark):
    from docketmill.plans.compare import similar_versions

    got = {r.doc_id: r.likeness for r in similar_versions(spark, FOLDER).collect()}
    texts = [r for r in pairs(spark, FOLDER).where("doc_id % 5 = 0").collect()]
    for r in texts:
        want = difflib.SequenceMatcher(None, r.old, r.new, autojunk=False).ratio()
        assert got[r.doc_id] == (round(want, 6) if want >= 0.8 else None)
    assert len(got) == pairs(spark, FOLDER).count()
