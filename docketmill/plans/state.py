"""Queries over messages, outcomes and job events."""

from __future__ import annotations

from pyspark.sql import functions as F

from docketmill.operators import ledger
from docketmill.plans.registry import query
from docketmill.plans.views import base, view

CUTOFF = "(select max(ts) - interval 7 day from events)"


def mail(spark, sf_dir):
    return view(spark, sf_dir, "mail")


def outcomes(spark, sf_dir):
    return view(spark, sf_dir, "outcomes")


def events(spark, sf_dir):
    return view(spark, sf_dir, "audit_events")


def week_before_end(spark, sf_dir):
    return base(spark, sf_dir, "events").agg(F.max("ts") - F.expr("interval 7 days")).scalar()


@query("with m as (select *, split_part(lower(coalesce(nullif(regexp_extract(external, '<([^>]+)>', 1), ''), external)), '@', 2) as d from mail) select owner, d as counterparty, count(*) as n, max(msg_id) as last_msg from m where d is not null and d not in ('gmail.com', 'outlook.com', 'hotmail.com', 'yahoo.com', 'icloud.com', '') group by 1, 2")
def counterparties(spark, sf_dir):
    return ledger.counterparties(mail(spark, sf_dir))


RATES = "r as (select user_address, category, count(*) as total, count(case when outcome = 'rejected' then 1 end) as rejected, round(count(case when outcome = 'rejected' then 1 end) / count(*), 6) as rate from outcomes where outcome <> 'unknown' group by 1, 2)"


@query(f"with {RATES} select * from r")
def rejection_rates(spark, sf_dir):
    return ledger.rejection_rates(outcomes(spark, sf_dir), ["user_address", "category"])


@query(f"with {RATES} select * from r where total >= 5 and rate >= 0.3")
def learned_suppressions(spark, sf_dir):
    return ledger.learned(outcomes(spark, sf_dir), ["user_address", "category"], rate=0.3)


@query("select client_id, category, count(*) as dismissed from outcomes where outcome = 'dismissed' group by 1, 2 having count(*) >= 5")
def learned_dismissals(spark, sf_dir):
    return ledger.dismissals(outcomes(spark, sf_dir), ["client_id", "category"])


@query("with t as (select user_address, category, count(case when outcome = 'accepted' then 1 end) as accepted, count(case when outcome = 'rejected' then 1 end) as rejected, count(case when outcome = 'unknown' then 1 end) as silent from outcomes group by 1, 2) select *, case when rejected > 0 then 'contested' when silent > 0 then 'open' else 'settled' end as verdict from t")
def outcome_tally(spark, sf_dir):
    return ledger.tally(outcomes(spark, sf_dir), ["user_address", "category"])


@query("select o_custkey, case when count(distinct o_orderstatus) = 1 then min(o_orderstatus) else 'partial' end as status from orders group by 1")
def common_status(spark, sf_dir):
    return ledger.common_status(base(spark, sf_dir, "orders"), "o_custkey", "o_orderstatus")


JOBS = "j as (select job_id, min(ts) as received_at, max(ts) as last_at, arg_max(step, (ts, event_id)) as status, count(case when step = 'error' then 1 end) as errors, count(*) as steps, array_to_string(list_sort(list(distinct step)), '; ') as kinds from audit_events group by 1)"


@query(f"with {JOBS} select * from j")
def folded_jobs(spark, sf_dir):
    return ledger.jobs(events(spark, sf_dir))


@query(f"with {JOBS} select * from j where received_at >= (select min(ts) from events) and received_at < (select max(ts) from events)")
def audit_rows(spark, sf_dir):
    return ledger.audit(events(spark, sf_dir), "1900-01-01", "2100-01-01")


@query("select cast(ts as date) as day, count(*) as n from events group by 1")
def events_per_day(spark, sf_dir):
    return ledger.per_day(base(spark, sf_dir, "events"))


@query("select msg_id, thread_id, len(string_split(lower(body), 'the')) - 1 + len(string_split(lower(body), 'version')) - 1 as hits from mail where owner = 'u1@firm.example' and contains(lower(body), 'the') and contains(lower(body), 'version') order by hits desc, msg_id desc limit 20")
def archive_search(spark, sf_dir):
    return ledger.search(mail(spark, sf_dir), "u1@firm.example", ["the", "version"])


@query("select * from mail where thread_id = 1")
def one_thread(spark, sf_dir):
    return mail(spark, sf_dir).where("thread_id = 1").orderBy("turn")


@query("select * from mail order by msg_id desc limit 50")
def newest_messages(spark, sf_dir):
    return mail(spark, sf_dir).orderBy(F.desc("msg_id")).limit(50)


@query("select * from mail m where turn = (select max(turn) from mail x where x.thread_id = m.thread_id)")
def latest_of_thread(spark, sf_dir):
    return ledger.latest(mail(spark, sf_dir), ["thread_id"], ["turn"])


@query("select * from audit_events qualify row_number() over (partition by job_id, step order by ts, event_id) = 1")
def first_writers(spark, sf_dir):
    return ledger.earliest(events(spark, sf_dir), ["job_id", "step"], ["ts", "event_id"])


@query("select * from audit_events qualify row_number() over (partition by job_id order by ts desc, event_id desc) = 1")
def last_status(spark, sf_dir):
    return ledger.latest(events(spark, sf_dir), ["job_id"], ["ts", "event_id"])


@query("select msg_id, thread_id, row_number() over (partition by thread_id order by msg_id) as ordinal from mail")
def message_ordinals(spark, sf_dir):
    return ledger.ordinals(mail(spark, sf_dir).select("msg_id", "thread_id"), ["thread_id"], ["msg_id"])


@query("select user_address, category, total, rank from (select *, row_number() over (partition by user_address order by total desc, category) as rank from (select user_address, category, count(*) as total from outcomes group by 1, 2)) where rank <= 3")
def top_categories(spark, sf_dir):
    counted = outcomes(spark, sf_dir).groupBy("user_address", "category").agg(F.count(F.lit(1)).alias("total"))
    ranked = ledger.ordinals(counted, ["user_address"], [F.desc("total"), "category"], "rank")
    return ranked.where("rank <= 3").select("user_address", "category", "total", "rank")


@query("""with a as (select distinct owner, concat('alias-', cast(thread_id % 50 as varchar)) as alias, thread_id as thread from mail where thread_id % 3 <> 0), w as (select msg_id, owner, thread_id from mail),
 e as (select msg_id, owner, concat('alias-', cast((thread_id + i) % 50 as varchar)) as alias, i as priority from w, unnest(range(0, 3)) as t(i))
 select e.msg_id, arg_min(a.thread, (priority, a.thread)) as thread from e join a on a.owner = e.owner and a.alias = e.alias group by 1""")
def resolved_aliases(spark, sf_dir):
    m = mail(spark, sf_dir)
    name = lambda n: F.concat(F.lit("alias-"), (n % 50).cast("string"))
    aliases = m.where("thread_id % 3 <> 0").select("owner", name(F.col("thread_id")).alias("alias"), F.col("thread_id").alias("thread")).distinct()
    return ledger.resolve_aliases(m.select("msg_id", "owner", F.array(*(name(F.col("thread_id") + i) for i in range(3))).alias("wanted")), aliases)


@query("select * from mail where thread_id in (select conv_id from conversations where role = 'assistant')")
def threads_with_replies(spark, sf_dir):
    answered = base(spark, sf_dir, "conversations").where("role = 'assistant'").select(F.col("conv_id").alias("thread_id"))
    return mail(spark, sf_dir).join(answered, "thread_id", "left_semi").select(mail(spark, sf_dir).columns)


@query("select o_orderkey, o_custkey from orders where o_custkey is not null and o_custkey not in (select c_custkey from customer where c_custkey % 4 = 0)")
def orphaned_rows(spark, sf_dir):
    kept = base(spark, sf_dir, "customer").where("c_custkey % 4 = 0").select(F.col("c_custkey").alias("o_custkey"))
    return ledger.orphans(base(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), kept, "o_custkey").select("o_orderkey", "o_custkey")


SCOPE = """s as (select 'customer' as kind, cast(c_custkey as varchar) as id from customer where c_nationkey = 3 union select 'order', cast(o_orderkey as varchar) from orders join customer on c_custkey = o_custkey where c_nationkey = 3)"""


def _scope(spark, sf_dir):
    customer, orders = base(spark, sf_dir, "customer"), base(spark, sf_dir, "orders")
    wanted = customer.where("c_nationkey = 3").select(F.col("c_custkey").alias("key"))
    return ledger.scope({"customer": customer.select(F.col("c_custkey").alias("id"), F.col("c_custkey").alias("key")), "order": orders.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("key"))}, "key", wanted)


@query(f"with {SCOPE} select * from s")
def deletion_scope(spark, sf_dir):
    return _scope(spark, sf_dir)


@query(f"with {SCOPE} select kind, count(*) as n, sha256(string_agg(id, ',' order by id)) as digest from s group by kind")
def deletion_certificate(spark, sf_dir):
    return ledger.certificate(_scope(spark, sf_dir))


@query(f"with {SCOPE} select * from s where kind = 'order'")
def resumed_deletion(spark, sf_dir):
    plan = _scope(spark, sf_dir)
    return ledger.not_yet_done(plan, plan.where("kind = 'customer'"))


@query(f"select * from events where ts >= {CUTOFF}")
def retained_events(spark, sf_dir):
    return ledger.survivors(base(spark, sf_dir, "events"), "ts", week_before_end(spark, sf_dir))


@query(f"with t as (select user_id, max(ts) as updated_at, max(case when event_type = 'purchase' then ts end) as active_at from events group by 1) select * from t where greatest(updated_at, coalesce(active_at, updated_at)) < (select max(ts) - interval 1 day from events)")
def quiet_threads(spark, sf_dir):
    e = base(spark, sf_dir, "events")
    threads = e.groupBy("user_id").agg(F.max("ts").alias("updated_at"), F.max(F.when(F.col("event_type") == "purchase", F.col("ts"))).alias("active_at"))
    return ledger.quiet(threads, e.agg(F.max("ts") - F.expr("interval 1 day")).scalar())


@query("select c_custkey, case when c_nationkey = 3 then null else c_name end as c_name, c_nationkey from customer")
def redacted_names(spark, sf_dir):
    customer = base(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey")
    return ledger.redacted(customer, customer.where("c_nationkey = 3"), "c_custkey", ["c_name"])


@query("with n as (select c_custkey, 'new' as state from customer where c_custkey % 3 = 0 union all select c_custkey + 1000000, 'added' from customer where c_custkey % 5 = 0) select coalesce(c.c_custkey, n.c_custkey) as c_custkey, coalesce(n.state, c.state) as state from (select c_custkey, 'old' as state from customer) c full join n on n.c_custkey = c.c_custkey")
def upserted_rows(spark, sf_dir):
    keys = base(spark, sf_dir, "customer").select("c_custkey")
    new = keys.where("c_custkey % 3 = 0").withColumn("state", F.lit("new")).union(keys.where("c_custkey % 5 = 0").select(F.col("c_custkey") + 1_000_000, F.lit("added")))
    return ledger.upserted(keys.withColumn("state", F.lit("old")), new, ["c_custkey"], ["state"])


@query("with r as (select thread_id, left(sha256(lower(trim(left(body, 12)))), 16) as point_key, left(body, 12) as anchor, turn from mail) select thread_id, point_key, min(anchor) as anchor from r where turn > 0 and not exists (select 1 from r o where o.turn = 0 and o.thread_id = r.thread_id and o.point_key = r.point_key) group by 1, 2")
def added_points(spark, sf_dir):
    points = mail(spark, sf_dir).select("thread_id", F.substring("body", 1, 12).alias("anchor"), "turn")
    return ledger.added(points.where("turn = 0").drop("turn"), points.where("turn > 0").drop("turn"))


@query("select doc_id, case when doc_id % 2 = 0 then replace(replace(text, 'Buyer', 'Purchaser'), 'Purchaser', 'Client') else replace(text, 'Buyer', 'Purchaser') end as text from agreements")
def replayed_changes(spark, sf_dir):
    docs = view(spark, sf_dir, "agreements")
    change = lambda n, a, b, on: docs.select("doc_id", F.lit(n).cast("bigint").alias("change_id"), F.lit(a).alias("anchor"), F.lit(b).alias("replacement"), on.alias("active"))
    return ledger.replayed(change(1, "Buyer", "Purchaser", F.lit(True)).union(change(2, "Purchaser", "Client", F.col("doc_id") % 2 == 0)), docs)


@query("with f as (select thread_id, left(body, 12) as anchor, min(turn) as round from mail group by 1, 2) select thread_id, anchor, chr(cast(64 + n as int)) as letter from (select *, row_number() over (partition by thread_id order by round, anchor) as n from f) where n <= 24")
def stable_letters(spark, sf_dir):
    return ledger.stable_letters(mail(spark, sf_dir).select("thread_id", F.substring("body", 1, 12).alias("anchor"), F.col("turn").alias("round")))


PAUSES = "p as (select distinct date_trunc('day', ts) + interval 9 hour as from_at, date_trunc('day', ts) + interval 12 hour as to_at from events)"


@query(f"with {PAUSES} select event_id, max(to_at) as release_at from events join p on ts >= from_at and ts < to_at group by 1")
def held_messages(spark, sf_dir):
    e = base(spark, sf_dir, "events").select("event_id", "ts")
    day = F.date_trunc("day", "ts")
    pauses = e.select((day + F.expr("interval 9 hours")).alias("from_at"), (day + F.expr("interval 12 hours")).alias("to_at")).distinct()
    return ledger.held_back(e, pauses)


@query("select event_id, ts, cast(ts as date) as day from events qualify row_number() over (partition by cast(ts as date) order by ts, event_id) <= 10")
def daily_admissions(spark, sf_dir):
    return ledger.admitted(base(spark, sf_dir, "events").select("event_id", "ts"), 10)


@query("with e as (select *, min(case when step = 'purchase' then ts end) over (partition by job_id order by ts, event_id rows between 1 following and unbounded following) as end_at from audit_events) select job_id, event_id, cast(floor(epoch(end_at)) - floor(epoch(ts)) as bigint) as waited, coalesce(floor(epoch(end_at)) - floor(epoch(ts)) <= 86400, false) as in_time from e where step = 'view'")
def waited_for(spark, sf_dir):
    return ledger.first_after(events(spark, sf_dir), "view", "purchase", 86_400)


@query("with l as (select job_id, max(case when step = 'click' then ts end) as opened, max(case when step = 'purchase' then ts end) as closed from audit_events group by 1) select job_id, opened from l where opened is not null and opened < (select max(ts) from events) and (closed is null or closed < opened)")
def left_open(spark, sf_dir):
    return ledger.left_open(events(spark, sf_dir), "click", "purchase", base(spark, sf_dir, "events").agg(F.max("ts")).scalar())
