"""Streaming queries, run over what there is, and queries over web pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from docketmill.plans.registry import query
from docketmill.plans.views import base
from docketmill.ship import shared_folder
from docketmill.sources import web
from docketmill.streaming import jobs


def _folder(spark) -> str:
    return f"{shared_folder(spark)}/streams"


@query("select event_id from events")
def stream_deliveries(spark, sf_dir):
    """Every event delivered twice, kept once."""
    events = jobs.source(spark, sf_dir, "events").select("event_id", "ts")
    return jobs.collected(jobs.deduplicated(events.union(events), "event_id", "40 days"), _folder(spark)).select("event_id")


@query("with w as (select cast(date_trunc('day', ts) as timestamp) as start, count(*) as n from events group by 1) select start, n from w where start + interval 1 day <= (select max(ts) - interval 1 hour from events)")
def stream_daily_counts(spark, sf_dir):
    out = jobs.collected(jobs.per_window(jobs.source(spark, sf_dir, "events").select("ts")), _folder(spark))
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "n")


@query("select event_id from events where not (hour(ts) >= 9 and hour(ts) < 12)")
def stream_outside_pauses(spark, sf_dir):
    e = base(spark, sf_dir, "events")
    day = F.date_trunc("day", "ts")
    pauses = e.select((day + F.expr("interval 9 hours")).alias("from_at"), (day + F.expr("interval 12 hours")).alias("to_at")).distinct()
    return jobs.collected(jobs.outside_pauses(jobs.source(spark, sf_dir, "events").select("event_id", "ts"), pauses), _folder(spark)).select("event_id")


@query("""with e as (select user_id % 40 as job_id, event_id, ts, event_type from events), s as (select job_id, min(ts) as started from e where event_type = 'view' group by 1),
 f as (select s.job_id, s.started, min(e.ts) as ended from s left join e on e.job_id = s.job_id and e.event_type = 'purchase' and e.ts > s.started and epoch_us(e.ts) - epoch_us(s.started) <= 43200000000 group by 1, 2) select job_id, case when ended is null then 'timed out' else 'finished' end as outcome from f""")
def stream_waits(spark, sf_dir):
    events = jobs.source(spark, sf_dir, "events").select((F.col("user_id") % 40).cast("long").alias("job_id"), "event_id", F.col("event_type").alias("step"), F.col("ts").cast("timestamp").alias("ts"))
    return jobs.collected(jobs.waited(events, "view", "purchase", 43_200), _folder(spark)).select("job_id", "outcome")


_LINES = r"""with t1 as (select page_id, regexp_replace(html, '(?is)<!--.*?-->', '', 'g') as t from pages),
 t2 as (select page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '(?is)<script\b[^>]*>.*?</script\s*>', ' ', 'g'), '(?is)<style\b[^>]*>.*?</style\s*>', ' ', 'g'), '(?is)<head\b[^>]*>.*?</head\s*>', ' ', 'g'), '(?is)<title\b[^>]*>.*?</title\s*>', ' ', 'g'), '(?is)<noscript\b[^>]*>.*?</noscript\s*>', ' ', 'g') as t from t1),
 t3 as (select page_id, regexp_replace(regexp_replace(regexp_replace(t, '\s+', ' ', 'g'), '(?i)</?(?:BLOCKS)\b[^>]*>', chr(10), 'g'), '<[^>]*>', '', 'g') as t from t2)
 select page_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, ' *\n *', chr(10), 'g'), '\n{2,}', chr(10), 'g'), '^\n+', ''), '\n+$', '')) as text from t3""".replace("BLOCKS", web.BLOCKS)


@query(_LINES.replace(" as text from t3", " as l from t3").replace("with t1 as", "with t1 as", 1).replace(" select page_id, trim(", " , t4 as (select page_id, trim(") + ") select page_id, regexp_replace(replace(replace(replace(l, '&middot;', '·'), '&copy;', '©'), '&quot;', '\"'), '&amp;?', '&', 'g') as text from t4")
def page_texts(spark, sf_dir):
    """Pages as readable text, entities decoded."""
    return base(spark, sf_dir, "pages").select("page_id", web.to_text(F.col("html")).alias("text"))


@query(_LINES)
def page_lines(spark, sf_dir):
    """Pages as lines, entities left as they are."""
    return base(spark, sf_dir, "pages").select("page_id", web.markup_to_lines(F.col("html")).alias("text"))
