"""Rounds of negotiations, as a stream and at once."""

from __future__ import annotations

from pyspark.sql import functions as F

from docketmill.plans.registry import query
from docketmill.plans.views import base
from docketmill.ship import shared_folder, ship
from docketmill.streaming import jobs, rounds

COLUMNS = [
    "cast(user_id % 40 as bigint) as thread_id", "event_id", "ts", "case event_type when 'view' then 'raise' when 'click' then 'heard' when 'purchase' then 'heard' when 'error' then 'heard' else 'close' end as kind",
    "concat('clause ', cast(event_id % 3 as varchar(10))) as clause", "case event_type when 'click' then 'countered' when 'purchase' then 'accepted' when 'error' then 'rejected' end as outcome",
]
SETTLED = f"""with e0 as (select {', '.join(COLUMNS)} from events), e1 as (select *, row_number() over (partition by thread_id order by ts, event_id) as place, count(case when kind = 'close' then 1 end) over (partition by thread_id order by ts, event_id) as closed from e0 {{cut}}),
 p as (select thread_id, event_id as point_id, clause, place from e1 where kind = 'raise'), c as (select thread_id, closed as round, place from e1 where kind = 'close'),
 s as (select p.thread_id, c.round, p.point_id, coalesce((select arg_max(h.outcome, h.place) from e1 h where h.thread_id = p.thread_id and h.clause = p.clause and h.kind = 'heard' and h.place > p.place and h.place < c.place), 'silent') as status from p join c on c.thread_id = p.thread_id and c.place > p.place),
 d as (select thread_id, point_id, min(round) as done from s where status in ('accepted', 'rejected') group by 1, 2)
 select s.thread_id, cast(s.round as int) as round, s.point_id, s.status from s left join d on d.thread_id = s.thread_id and d.point_id = s.point_id where d.done is null or s.round <= d.done"""


@query(SETTLED.format(cut=""))
def settled_rounds(spark, sf_dir):
    """What stands of each point at the end of each round."""
    return rounds.settled_at_once(base(spark, sf_dir, "events").selectExpr(*COLUMNS))


@query(SETTLED.format(cut="where epoch_ms(ts) <= (select max(epoch_ms(ts)) - 3600000 from events)"))
def stream_settled_rounds(spark, sf_dir):
    """The same from a stream, as far as its watermark came."""
    ship(spark)
    own = rounds.session(spark)
    events = jobs.source(own, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")).selectExpr(*COLUMNS)
    found = jobs.collected(rounds.settled(events), f"{shared_folder(spark)}/streams")
    return spark.read.schema(found.schema).parquet(found.inputFiles()[0].rpartition("/")[0]) if found.inputFiles() else found
