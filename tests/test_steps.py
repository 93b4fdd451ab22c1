import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from docketmill.streaming import jobs, rounds, steps

START = datetime(2026, 3, 1)
SCHEMA = "token long, event_id long, ts timestamp, kind string"


def brute(rows, seconds):
    out, issued = set(), {}
    for token, event, ts, kind in sorted(rows, key=lambda r: (r[2], r[1])):
        if kind == "issue":
            issued[token] = ts
        elif kind == "claim":
            at = issued.pop(token, None)
            out.add((token, event, "granted" if at is not None and (ts - at).total_seconds() <= seconds else "refused"))
    return out


def events(seed, n=200):
    rnd = random.Random(seed)
    return [(rnd.randrange(6), i, START + timedelta(minutes=rnd.randrange(400)), rnd.choice(["issue", "claim"])) for i in range(n)]


@pytest.mark.parametrize("seconds", [600, 3600])
def test_tokens_hold_once_and_for_a_time(spark, tmp_path, seconds):
    rows = events(seconds)
    assert {tuple(r) for r in steps.claimed_at_once(spark.createDataFrame(rows, SCHEMA), seconds).collect()} == brute(rows, seconds)
    random.Random(1).shuffle(rows)
    last = (77, 999, START + timedelta(days=9), "issue")
    for i, part in enumerate([rows[:70], [*rows[70:], last]]):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    own = rounds.session(spark)
    stream = own.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    found = [tuple(r) for r in jobs.collected(steps.claimed(stream, seconds, "1 day"), f"{tmp_path}/out").collect()]
    assert set(found) == brute(rows, seconds) and len(found) == len(set(found))


def test_steps_have_one_effect_however_often_a_batch_comes(spark, tmp_path):
    ledger, calls = f"{tmp_path}/ledger", []

    def named(name, fail=False):
        def effect(rows):
            calls.append(name)
            if fail:
                raise InterruptedError
            return rows.withColumn(name, F.expr("uuid()"))

        return name, effect

    batches = [[(1, 1), (1, 2), (2, 3)], [(2, 4), (3, 5)], [(1, 6), (2, 7)]]
    frames = [spark.createDataFrame(b, "job long, event long") for b in batches]
    run = lambda i, s: steps.run_steps(frames[i], i, ledger, s, keys=["job"], order=["event"])
    with pytest.raises(InterruptedError):
        run(0, [named("a"), named("b", fail=True)])
    made = {r.job: r.a for r in spark.read.parquet(f"{ledger}/a/batch=0").collect()}
    first = {r.job: tuple(r) for r in run(0, [named("a"), named("b")]).collect()}
    again = {r.job: tuple(r) for r in run(0, [named("a"), named("b")]).collect()}
    assert first == again and {k: v[2] for k, v in first.items()} == made and {k: v[1] for k, v in first.items()} == {1: 1, 2: 3}
    assert calls == ["a", "b", "b"]
    assert [r.job for r in run(1, [named("a"), named("b")]).collect()] == [3] and run(2, [named("a"), named("b")]).collect() == []


def test_steps_in_a_stream(spark, tmp_path):
    for i, part in enumerate([[(1, 1), (2, 2)], [(2, 3), (3, 4)]]):
        spark.createDataFrame(part, "job long, event long").coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    stream = spark.readStream.schema("job long, event long").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    done = lambda batch, n: [steps.run_steps(batch, n, f"{tmp_path}/ledger", [("send", lambda r: r)], keys=["job"], order=["event"]) for _ in range(2)]
    query = stream.writeStream.foreachBatch(done).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(tuple(r)[:2] for r in spark.read.option("recursiveFileLookup", "true").parquet(f"{tmp_path}/ledger").collect()) == [(1, 1), (2, 2), (3, 4)]
