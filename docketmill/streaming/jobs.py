"""Streams of events: deduplication, caps, waiting, holding and sending once.

Every function takes a streaming frame and gives one. Watermarks bound the state; timers run on event time, so
that a replay gives the same rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WAITED = "job_id long, started timestamp, ended timestamp, outcome string"


def source(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """A table's files as a stream."""
    schema = spark.read.parquet(f"{folder}/{table}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{table}.parquet").parquet(folder)


def deduplicated(events: DataFrame, key: str, delay: str = "1 day", time: str = "ts") -> DataFrame:
    """The first delivery of each key within the delay."""
    return events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def per_window(events: DataFrame, size: str = "1 day", delay: str = "1 hour", time: str = "ts") -> DataFrame:
    """(start, n): counts of windows, each once when it closes."""
    w = F.window(time, size)
    return events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay).groupBy(w.alias("w")).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "n")


def outside_pauses(events: DataFrame, pauses: DataFrame) -> DataFrame:
    """Events that no pause [from_at, to_at) of a static table holds back, joined on the day."""
    p = pauses.withColumn("day", F.explode(F.sequence(F.to_date("from_at"), F.to_date("to_at"))))
    e = events.withColumn("day", F.to_date("ts")).alias("e")
    hit = (F.col("e.day") == F.col("p.day")) & (F.col("e.ts") >= F.col("p.from_at")) & (F.col("e.ts") < F.col("p.to_at"))
    return e.join(p.alias("p"), hit, "left_anti").drop("day")


def waited(events: DataFrame, start: str, end: str, seconds: int, delay: str = "1 hour") -> DataFrame:
    """(job_id, started, ended, outcome): each job's first start, and its first end after it within the time, or
    that the time ran out. State is one pair of times for each job that waits."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        began, over = state.get if state.exists else (None, False)
        out = []
        if state.hasTimedOut:
            out.append((key[0], pd.Timestamp(began, unit="us"), pd.NaT, "timed out"))
            state.update((began, True))
        else:
            rows = pd.concat(frames).sort_values(["ts", "event_id"])
            for kind, ts in zip(rows["step"], rows["ts"], strict=True):
                at = int(pd.Timestamp(ts).value // 1000)
                if over:
                    break
                if began is None:
                    began = at if kind == start else None
                elif at - began > seconds * 1_000_000:
                    out.append((key[0], pd.Timestamp(began, unit="us"), pd.NaT, "timed out"))
                    over = True
                elif kind == end:
                    out.append((key[0], pd.Timestamp(began, unit="us"), ts, "finished"))
                    over = True
            if began is not None:
                state.update((began, over))
                if not over:
                    state.setTimeoutTimestamp(max(began // 1000 + seconds * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["job_id", "started", "ended", "outcome"])

    from pyspark.sql.streaming.state import GroupStateTimeout

    return events.withWatermark("ts", delay).groupBy("job_id").applyInPandasWithState(step, WAITED, "began long, over boolean", "append", GroupStateTimeout.EventTimeTimeout)


def send_once(batch: DataFrame, outbox: str, key: str = "event_id") -> int:
    """For foreachBatch: appends rows whose key isn't in the outbox yet, and says how many; a replay adds none."""
    spark = batch.sparkSession
    new = batch.dropDuplicates([key])
    try:
        new = new.join(spark.read.parquet(outbox).select(key), key, "left_anti")
    except Exception as e:  # the first batch finds no outbox
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
    new = new.select(batch.columns)
    n = new.count()
    new.write.mode("append").parquet(outbox)
    return n


def collected(stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """Runs a stream over what there is, into files of a shared folder, and reads them."""
    spark, to = stream.sparkSession, f"{folder}/{uuid.uuid4().hex}"
    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{to}/state").trigger(availableNow=True).format("parquet").start(f"{to}/rows")
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{to}/rows")
