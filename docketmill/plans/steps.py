"""Steps of jobs and one-time tokens."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from docketmill.plans.registry import query
from docketmill.plans.views import base
from docketmill.ship import shared_folder, ship
from docketmill.streaming import jobs, rounds, steps

BATCHES, SECONDS = 3, 12 * 3600
KIND = "case event_type when 'view' then 'issue' when 'purchase' then 'claim' end"
CLAIMS = f"""with e as (select user_id % 500 as token, event_id, ts, {KIND} as kind from events where event_type in ('view', 'purchase') {{cut}}), b as (select *, lag(kind) over w as kb, lag(ts) over w as tb from e window w as (partition by token order by ts, event_id))
 select token, event_id, case when kb = 'issue' and epoch_us(ts) - epoch_us(tb) <= {SECONDS}000000 then 'granted' else 'refused' end as outcome from b where kind = 'claim'"""


@query(CLAIMS.format(cut=""))
def claimed_tokens(spark, sf_dir):
    """Which claims of one-time tokens hold."""
    return steps.claimed_at_once(base(spark, sf_dir, "events").selectExpr("user_id % 500 as token", "event_id", "ts", f"{KIND} as kind"), SECONDS)


@query(CLAIMS.format(cut="and epoch_ms(ts) <= (select max(epoch_ms(ts)) - 3600000 from events)"))
def stream_claimed_tokens(spark, sf_dir):
    """The same from a stream, as far as its watermark came; all events move it."""
    ship(spark)
    own = rounds.session(spark)
    events = jobs.source(own, sf_dir, "events").selectExpr("user_id % 500 as token", "event_id", "cast(ts as timestamp) as ts", f"coalesce({KIND}, '') as kind")
    found = jobs.collected(steps.claimed(events, SECONDS), f"{shared_folder(spark)}/streams")
    return spark.read.schema(found.schema).parquet(found.inputFiles()[0].rpartition("/")[0]) if found.inputFiles() else found


@query(f"select user_id as job_id, arg_min(event_id, (event_id % {BATCHES}, ts, event_id)) as event_id, concat('job ', cast(user_id as varchar), ' begun by ', cast(arg_min(event_id, (event_id % {BATCHES}, ts, event_id)) as varchar)) as sent from events group by user_id")
def stream_steps(spark, sf_dir):
    """Jobs taken through two steps, batch by batch; each batch is stopped after its first step, comes again, and once more
    when it is done. Each job is sent once."""
    ledger = f"{shared_folder(spark)}/streams/{uuid.uuid4().hex}"
    events = base(spark, sf_dir, "events").select(F.col("user_id").alias("job_id"), "event_id", "ts")

    def stop(rows):
        raise InterruptedError

    def send(rows):
        return rows.select("job_id", "event_id", F.concat(F.lit("job "), F.col("job_id").cast("string"), F.lit(" begun by "), F.col("event_id").cast("string")).alias("sent"))

    for i in range(BATCHES):
        batch = events.where(F.col("event_id") % BATCHES == i)
        for last in (stop, send, send):
            try:
                steps.run_steps(batch, i, ledger, [("prepare", lambda rows: rows.withColumn("made", F.expr("uuid()"))), ("send", last)], keys=["job_id"], order=["ts", "event_id"])
            except InterruptedError:
                continue
    return spark.read.parquet(*(f"{ledger}/send/batch={i}" for i in range(BATCHES)))
