"""Relational state around review work: folds, rankings, joins, deletion. All of it is append and fold: an upsert
is the latest row of a key, a deletion is an anti join."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketmill.functions.text import bare_address, domain_of, key_of

FREE_MAIL = ["gmail.com", "outlook.com", "hotmail.com", "yahoo.com", "icloud.com"]


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key by the named columns."""
    w = Window.partitionBy(*keys).orderBy(*(F.desc(c) for c in order))
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def earliest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key: the first writer of a key wins."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def ordinals(rows: DataFrame, within: list[str], order: list[str], name: str = "ordinal") -> DataFrame:
    """Stable numbers from 1 within a group."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*within).orderBy(*order)))


def top(rows: DataFrame, within: list[str], order: list[Column], most: int) -> DataFrame:
    """The first `most` rows of each group."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*within).orderBy(*order))).where(F.col("__n") <= most).drop("__n")


def counterparty(external: Column) -> Column:
    """The domain of an outside address unless it is a free mail host."""
    domain = domain_of(bare_address(external))
    return F.when(~domain.isin(FREE_MAIL), domain)


def counterparties(mail: DataFrame) -> DataFrame:
    """(owner, counterparty, n, last_at): whom each owner deals with."""
    named = mail.withColumn("counterparty", counterparty(F.col("external"))).where("counterparty is not null")
    return named.groupBy("owner", "counterparty").agg(F.count(F.lit(1)).alias("n"), F.max("msg_id").alias("last_msg"))


def rejection_rates(outcomes: DataFrame, keys: list[str]) -> DataFrame:
    """(*keys, total, rejected, rate): how often suggestions are rejected; unknown outcomes don't count."""
    known = outcomes.where("outcome <> 'unknown'")
    rejected = F.count(F.when(F.col("outcome") == "rejected", 1))
    return known.groupBy(*keys).agg(F.count(F.lit(1)).alias("total"), rejected.alias("rejected"), F.round(rejected / F.count(F.lit(1)), 6).alias("rate"))


def learned(outcomes: DataFrame, keys: list[str], least: int = 5, rate: float = 0.7) -> DataFrame:
    """Keys whose suggestions are rejected so often that they are no longer made."""
    return rejection_rates(outcomes, keys).where((F.col("total") >= least) & (F.col("rate") >= rate))


def dismissals(outcomes: DataFrame, keys: list[str], least: int = 5) -> DataFrame:
    return outcomes.where("outcome = 'dismissed'").groupBy(*keys).agg(F.count(F.lit(1)).alias("dismissed")).where(F.col("dismissed") >= least)


def tally(outcomes: DataFrame, keys: list[str]) -> DataFrame:
    """(*keys, accepted, rejected, silent, verdict): by precedence, any rejection comes before silence."""
    n = lambda o: F.count(F.when(F.col("outcome") == o, 1))
    counted = outcomes.groupBy(*keys).agg(n("accepted").alias("accepted"), n("rejected").alias("rejected"), n("unknown").alias("silent"))
    return counted.withColumn("verdict", F.when(F.col("rejected") > 0, "contested").when(F.col("silent") > 0, "open").otherwise("settled"))


def common_status(parts: DataFrame, key: str, status: str) -> DataFrame:
    """(key, status): the status that all parts share, else partial."""
    return parts.groupBy(key).agg(F.when(F.count_distinct(status) == 1, F.min(status)).otherwise("partial").alias("status"))


def jobs(events: DataFrame) -> DataFrame:
    """One row for each job, folded from its events."""
    seen = lambda s: F.count(F.when(F.col("step") == s, 1))
    return events.groupBy("job_id").agg(
        F.min("ts").alias("received_at"),
        F.max("ts").alias("last_at"),
        F.max_by("step", F.struct("ts", "event_id")).alias("status"),
        seen("error").alias("errors"),
        F.count(F.lit(1)).alias("steps"),
        F.array_join(F.array_sort(F.collect_set("step")), "; ").alias("kinds"),
    )


def audit(events: DataFrame, since: str, until: str) -> DataFrame:
    """Jobs received in [since, until)."""
    return jobs(events).where((F.col("received_at") >= F.lit(since).cast("timestamp")) & (F.col("received_at") < F.lit(until).cast("timestamp")))


def per_day(events: DataFrame, column: str = "ts") -> DataFrame:
    return events.groupBy(F.to_date(column).alias("day")).agg(F.count(F.lit(1)).alias("n"))


def search(mail: DataFrame, owner: str, terms: list[str], most: int = 20) -> DataFrame:
    """An owner's messages that hold every term, newest first, at most `most`: ranked by how often they do."""
    text = F.lower("body")
    met = reduce(Column.__and__, (F.instr(text, t.lower()) > 0 for t in terms))
    hits = reduce(Column.__add__, (F.size(F.split(text, t.lower())) - 1 for t in terms))
    found = mail.where((F.col("owner") == owner) & met).withColumn("hits", hits)
    return found.orderBy(F.desc("hits"), F.desc("msg_id")).limit(most).select("msg_id", "thread_id", "hits")


def resolve_aliases(wanted: DataFrame, aliases: DataFrame) -> DataFrame:
    """(msg_id, thread): the thread of the first alias, in order of priority, that the same owner has."""
    each = wanted.select("msg_id", "owner", F.posexplode("wanted").alias("priority", "alias"))
    # of an alias only its least thread can be the answer, so a message meets one row for each name and never all threads
    least = aliases.groupBy("owner", "alias").agg(F.min("thread").alias("thread"))
    return each.join(least, ["owner", "alias"]).groupBy("msg_id").agg(F.min_by("thread", F.struct("priority", "thread")).alias("thread"))


def orphans(children: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """Rows whose parent is gone; rows without a key have none."""
    return children.where(F.col(key).isNotNull()).join(parents.select(key).distinct(), key, "left_anti")


def scope(tables: dict[str, DataFrame], key: str, wanted: DataFrame) -> DataFrame:
    """(kind, id): everything of several tables (id, key) that belongs to the wanted keys."""
    parts = [t.join(wanted, key, "left_semi").select(F.lit(kind).alias("kind"), F.col("id").cast("string").alias("id")) for kind, t in tables.items()]
    return reduce(DataFrame.union, parts).distinct()


def survivors(rows: DataFrame, at: str, cutoff: Column) -> DataFrame:
    """What an age limit leaves; rows without a time stay."""
    return rows.where(F.col(at).isNull() | (F.col(at) >= cutoff))


def quiet(threads: DataFrame, cutoff: Column) -> DataFrame:
    """Threads whose later time stamp lies before the cutoff."""
    return threads.where(F.greatest("updated_at", F.coalesce("active_at", "updated_at")) < cutoff)


def redacted(rows: DataFrame, wanted: DataFrame, key: str, blank: list[str]) -> DataFrame:
    """All rows; the named columns are null where the key is wanted."""
    marked = rows.join(wanted.select(key).distinct().withColumn("__hit", F.lit(True)), key, "left")
    for c in blank:
        marked = marked.withColumn(c, F.when(F.col("__hit").isNull(), F.col(c)))
    return marked.drop("__hit")


def certificate(deleted: DataFrame) -> DataFrame:
    """(kind, n, digest): what was deleted, by kind, with a digest of the ids in order."""
    ids = F.array_join(F.array_sort(F.collect_list("id")), ",")
    return deleted.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.sha2(ids.cast("binary"), 256).alias("digest"))


def not_yet_done(plan: DataFrame, done: DataFrame) -> DataFrame:
    """What a resumed deletion still has to do."""
    return plan.join(done.select("kind", "id").distinct(), ["kind", "id"], "left_anti")


def upserted(old: DataFrame, new: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Old rows with new values where there are any, and new rows that weren't there."""
    o, n = old.alias("o"), new.alias("n")
    both = o.join(n, [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys], "full_outer")
    fresh = F.col(f"n.{keys[0]}").isNotNull()
    return both.select(*(F.coalesce(f"o.{k}", f"n.{k}").alias(k) for k in keys), *(F.when(fresh, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in columns))


def added(points: DataFrame, raised: DataFrame) -> DataFrame:
    """Raised points (thread_id, anchor) that aren't open under the same key, once each."""
    key = lambda d: d.withColumn("point_key", key_of(F.lower(F.trim("anchor")), size=16))
    fresh = key(raised).join(key(points).select("thread_id", "point_key"), ["thread_id", "point_key"], "left_anti")
    return fresh.groupBy("thread_id", "point_key").agg(F.min("anchor").alias("anchor"))


def replayed(changes: DataFrame, texts: DataFrame) -> DataFrame:
    """(doc_id, text): the active changes (doc_id, change_id, anchor, replacement, active) applied in order."""
    each = changes.where("active").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("change_id", "anchor", "replacement"))).alias("c"))
    text = F.aggregate(F.coalesce("c", F.array().cast("array<struct<change_id:bigint,anchor:string,replacement:string>>")), F.col("text"), lambda t, c: F.replace(t, c["anchor"], c["replacement"]))
    return texts.join(each, "doc_id", "left").select("doc_id", text.alias("text"))


def stable_letters(found: DataFrame, most: int = 24) -> DataFrame:
    """(thread_id, anchor, letter): letters in order of first appearance; a known anchor keeps its letter."""
    first = found.groupBy("thread_id", "anchor").agg(F.min("round").alias("round"))
    ranked = first.withColumn("n", F.row_number().over(Window.partitionBy("thread_id").orderBy("round", "anchor"))).where(F.col("n") <= most)
    return ranked.select("thread_id", "anchor", F.chr(F.col("n") + 64).alias("letter"))


def held_back(messages: DataFrame, pauses: DataFrame) -> DataFrame:
    """(event_id, release_at): messages that fall in a pause [from_at, to_at), and when they go on; a day's
    pauses are joined on the day."""
    m = messages.withColumn("day", F.to_date("ts"))
    p = pauses.withColumn("day", F.explode(F.sequence(F.to_date("from_at"), F.to_date("to_at"))))
    met = m.join(p, "day").where((F.col("ts") >= F.col("from_at")) & (F.col("ts") < F.col("to_at")))
    return met.groupBy("event_id").agg(F.max("to_at").alias("release_at"))


def admitted(events: DataFrame, cap: int) -> DataFrame:
    """Each day's first `cap` events."""
    return top(events.withColumn("day", F.to_date("ts")), ["day"], [F.col("ts"), F.col("event_id")], cap)


def first_after(events: DataFrame, start: str, end: str, seconds: int) -> DataFrame:
    """(job_id, event_id, waited, in_time): for each start event, the job's next end event, and whether it came in time."""
    # from the end backwards, so that a row adds to what is known: a frame that runs on to the end is gone through for each row
    w = Window.partitionBy("job_id").orderBy(F.desc("ts"), F.desc("event_id")).rowsBetween(Window.unboundedPreceding, -1)
    nexts = events.withColumn("end_at", F.min(F.when(F.col("step") == end, F.col("ts"))).over(w)).where(F.col("step") == start)
    waited = F.unix_timestamp("end_at") - F.unix_timestamp("ts")
    return nexts.select("job_id", "event_id", waited.alias("waited"), F.coalesce(waited <= seconds, F.lit(False)).alias("in_time"))


def left_open(events: DataFrame, opening: str, closing: str, before: Column) -> DataFrame:
    """Jobs whose last opening event lies before a time and has no closing event after it."""
    last = events.groupBy("job_id").agg(F.max(F.when(F.col("step") == opening, F.col("ts"))).alias("opened"), F.max(F.when(F.col("step") == closing, F.col("ts"))).alias("closed"))
    return last.where(F.col("opened").isNotNull() & (F.col("opened") < before) & (F.col("closed").isNull() | (F.col("closed") < F.col("opened")))).select("job_id", "opened")


def matters_of_clients(links: DataFrame, seen: DataFrame) -> DataFrame:
    """(client, matter): matters linked to a client (client, matter), and those seen anywhere (matter) that carry a
    client's number before a hyphen and are linked to no other client."""
    linked = links.select(F.lower("client").alias("client"), F.lower("matter").alias("matter"))
    free = seen.select(F.lower("matter").alias("matter")).where("matter <> ''").distinct().join(linked.select("matter"), "matter", "left_anti")
    numbered = free.select(F.regexp_extract("matter", r"^([a-z0-9]+)-\d+$", 1).alias("client"), "matter").where("client <> ''")
    return linked.union(numbered.join(linked.select("client").distinct(), "client", "left_semi")).distinct()


def expired_closings(closings: DataFrame, pages: DataFrame, cutoff: Column) -> DataFrame:
    """(closing_id, n_pages): closings (closing_id, updated_at) without activity since a time, and how many signed
    pages (closing_id) go with each."""
    old = closings.where(F.col("updated_at") < cutoff).select("closing_id")
    held = pages.groupBy("closing_id").agg(F.count(F.lit(1)).alias("n_pages"))
    return old.join(held, "closing_id", "left").select("closing_id", F.coalesce("n_pages", F.lit(0)).cast("bigint").alias("n_pages"))


def archived(kept: DataFrame, arrivals: DataFrame, keys: list[str]) -> DataFrame:
    """The rows that an archive has to take in: of arrivals that share a key the one with the least `seq`, and none whose
    key is kept already, so that a replay adds nothing."""
    w = Window.partitionBy(*keys).orderBy("seq")
    first = arrivals.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
    return first.join(kept.select(*keys), keys, "left_anti")


def access_log(reads: DataFrame, kept: DataFrame) -> DataFrame:
    """(reader, msg_id, at, found): every read of the archive (reader, msg_id, at) is logged, whether or not it is there."""
    there = kept.select("msg_id").distinct().withColumn("__there", F.lit(True))
    return reads.join(there, "msg_id", "left").select("reader", "msg_id", "at", F.col("__there").isNotNull().alias("found"))


def notices_due(jobs: DataFrame, after: int = 600) -> DataFrame:
    """(job_id, due): when a slow job's notice is due: so many seconds after its start; none for jobs without a model to
    wait for, or on a document that was sent already."""
    owed = F.col("model") & (F.col("entry") != "sent") & F.lit(after > 0)
    return jobs.select("job_id", F.when(owed, F.col("started") + F.make_dt_interval(secs=F.lit(after))).alias("due"))
