"""Steps of jobs that survive a replay, and tokens that hold once and for a time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessorHandle

from docketmill.streaming.rounds import Ordered

CLAIMED = "token long, event_id long, outcome string"


def _exists(frame: DataFrame, file: str) -> bool:
    context = frame.sparkSession.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(file)
    return path.getFileSystem(context._jsc.hadoopConfiguration()).exists(path)


def first_of(batch: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key, by an order that tells rows apart."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return batch.withColumn("__place", F.row_number().over(w)).where("__place = 1").drop("__place")


def run_steps(batch: DataFrame, batch_id: int, ledger: str, steps: list[tuple[str, Callable[[DataFrame], DataFrame]]], *, keys: list[str], order: list[str]) -> DataFrame:
    """Takes the new jobs of a batch through steps, each of which has one effect on a job however often a batch is replayed;
    for foreachBatch. Returns the rows of the last step.

    A job is new if no earlier batch had it; of its rows in this one the first counts. What a step gives is written to
    `ledger`/step/batch=N before the next begins. A batch that comes again finds the steps that were finished, whose rows
    are read and not made again, so that a step that isn't the same twice (a new id, the time) keeps its first result; one
    that was stopped on the way is made again and written over. So nothing depends on whether the stream had committed a
    batch when it stopped. A step has to keep the keys.
    """
    spark, name = batch.sparkSession, steps[0][0]
    new = first_of(batch, keys, order)
    done = [f"{ledger}/{name}/batch={i}" for i in range(batch_id) if _exists(batch, f"{ledger}/{name}/batch={i}/_SUCCESS")]
    if done:
        new = new.join(spark.read.parquet(*done).select(*keys), keys, "left_anti")
    rows = new
    for name, effect in steps:
        path = f"{ledger}/{name}/batch={batch_id}"
        if not _exists(batch, f"{path}/_SUCCESS"):
            effect(rows).write.mode("overwrite").parquet(path)
        rows = spark.read.parquet(path)
    return rows


class Tokens(Ordered):
    """State besides: when a token was issued, in microseconds; it goes when its time is over."""

    columns = ("token", "event_id", "outcome")

    def __init__(self, seconds: int):
        self.us = seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.issued = handle.getValueState("issued", "us long")

    def fold(self, key: tuple, events: list[tuple], passed: int) -> tuple[list[tuple], int | None]:
        issued, out = self.issued.get()[0] if self.issued.exists() else None, []
        for event, us, kind, _, _ in events:
            if kind == "issue":
                issued = us
            elif kind == "claim":
                held = issued is not None and us - issued <= self.us
                out.append((key[0], event, "granted" if held else "refused"))
                issued = None
        if issued is not None and (issued + self.us) // 1000 <= passed:
            issued = None
        if issued is None:
            self.issued.clear()
            return out, None
        self.issued.update((issued,))
        return out, (issued + self.us) // 1000 + 1


def claimed(events: DataFrame, seconds: int, delay: str = "1 hour") -> DataFrame:
    """The stream of (token, event_id, outcome) of claims: granted if the token was issued at most so many seconds before,
    and not claimed since; else refused. Needs the session of rounds.session(). A token's state is one time, and goes
    with it."""
    marked = events.withWatermark("ts", delay).select("token", "event_id", "ts", F.unix_micros("ts").alias("us"), "kind", F.lit(None).cast("string").alias("clause"), F.lit(None).cast("string").alias("outcome"))
    return marked.groupBy("token").transformWithStateInPandas(statefulProcessor=Tokens(seconds), outputStructType=CLAIMED, outputMode="append", timeMode="EventTime")


def claimed_at_once(events: DataFrame, seconds: int) -> DataFrame:
    """The same rows of a table: a claim is granted if what came before it is an issue, at most so many seconds ago."""
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    order = Window.partitionBy("token").orderBy("us", "event_id")
    before = events.where(F.col("kind").isin("issue", "claim")).withColumn("us", us).withColumns({"kind_before": F.lag("kind").over(order), "us_before": F.lag("us").over(order)})
    held = (F.col("kind_before") == "issue") & (F.col("us") - F.col("us_before") <= seconds * 1_000_000)
    return before.where("kind = 'claim'").select("token", "event_id", F.when(held, "granted").otherwise("refused").alias("outcome"))
