"""What has been learned or said of people, clients and matters, and who may see it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Scopes by precedence: the nearer one outranks the wider one.
SCOPES = ["matter", "client", "person", "firm"]


def rank(scope: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, SCOPES)), scope)


def recalled(entries: DataFrame, most: int = 60) -> DataFrame:
    """Confirmed entries in order of scope, then confidence; at most `most` of each scope and owner."""
    w = Window.partitionBy("owner", "scope").orderBy(F.desc("confidence"), "entry_id")
    kept = entries.where("status = 'confirmed'").withColumn("n", F.row_number().over(w)).where(F.col("n") <= most)
    order = Window.partitionBy("owner").orderBy(rank(F.col("scope")), F.desc("confidence"), "entry_id")
    return kept.select("owner", "entry_id", "scope", F.row_number().over(order).alias("place"))


def walled(entries: DataFrame) -> DataFrame:
    """Entries about client content under the wall: a person's moves to its matter if that is known; otherwise it
    and the firm's are dropped."""
    about = F.col("about_client")
    scope = F.when(about & (F.col("scope") == "person") & F.col("matter").isNotNull(), "matter").otherwise(F.col("scope"))
    gone = about & (F.col("scope").isin("person", "firm")) & ~((F.col("scope") == "person") & F.col("matter").isNotNull())
    return entries.where(~gone).withColumn("scope", scope)


def live(versions: DataFrame, status: str = "live") -> DataFrame:
    """(owner, version_id): the latest version with a status."""
    return versions.where(F.col("status") == status).groupBy("owner").agg(F.max_by("version_id", F.struct("version", "version_id")).alias("version_id"))


def superseded(versions: DataFrame) -> DataFrame:
    """versions with the status that approval of later ones gives them: of live ones only the last stays live."""
    w = Window.partitionBy("owner", "status").orderBy(F.desc("version"), F.desc("version_id"))
    return versions.withColumn("n", F.row_number().over(w)).withColumn("status", F.when((F.col("status") == "live") & (F.col("n") > 1), "superseded").otherwise(F.col("status"))).drop("n")


def next_announcement(entries: DataFrame) -> DataFrame:
    """(owner, entry_id): the oldest entry that hasn't been announced."""
    return entries.where("not announced").groupBy("owner").agg(F.min("entry_id").alias("entry_id"))


def suppressed(findings: DataFrame, rules: DataFrame) -> DataFrame:
    """Findings (owner, kind, ...) that no rule (owner, kind, lifted) suppresses."""
    return findings.join(rules.where("not lifted").select("owner", "kind").distinct(), ["owner", "kind"], "left_anti")


def lifted(rules: DataFrame, wanted: DataFrame) -> DataFrame:
    """rules after lifting (owner, kind): learned ones stay as lifted, spoken ones go."""
    marked = rules.join(wanted.select("owner", "kind").distinct().withColumn("__hit", F.lit(True)), ["owner", "kind"], "left")
    hit = F.col("__hit").isNotNull()
    return marked.where(~(hit & (F.col("source") == "spoken"))).withColumn("lifted", F.col("lifted") | hit).drop("__hit")


def expired(entries: DataFrame, cutoff: Column) -> DataFrame:
    """What is left after expiry: pending notes older than the cutoff go, confirmed facts stay."""
    return entries.where((F.col("status") != "pending") | (F.col("noted_at") >= cutoff))


def client_of(messages: DataFrame, links: DataFrame, domains: DataFrame) -> DataFrame:
    """(msg_id, client_id): by the matter's link; else by the sender's domain, if exactly one client has it."""
    linked = messages.join(links, "matter", "left")
    one = domains.groupBy("domain").agg(F.count_distinct("client_id").alias("n"), F.min("client_id").alias("by_domain")).where("n = 1").select("domain", "by_domain")
    return linked.join(one, "domain", "left").select("msg_id", F.coalesce("client_id", "by_domain").alias("client_id"))


def excluded(messages: DataFrame, rules: DataFrame) -> DataFrame:
    """(msg_id, rule_id): messages that an exclusion (rule_id, kind, value) covers by matter or by domain. An OR of
    two equalities is two equi joins."""
    by = lambda kind, c: messages.join(rules.where(F.col("kind") == kind).select("rule_id", F.col("value").alias(c)), c).select("msg_id", "rule_id")
    return by("matter", "matter").union(by("domain", "domain")).groupBy("msg_id").agg(F.min("rule_id").alias("rule_id"))


def disagreements(a: DataFrame, b: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, fields): names of the fields in which two plans for one message differ, in order."""
    both = a.alias("a").join(b.alias("b"), key)
    differ = F.array_compact(F.array(*(F.when(~F.col(f"a.{f}").eqNullSafe(F.col(f"b.{f}")), F.lit(f)) for f in fields)))
    return both.select(key, F.array_join(differ, ", ").alias("fields")).where("fields <> ''")


def introduced(before: DataFrame, after: DataFrame) -> DataFrame:
    """Findings (doc_id, kind, anchor) that a repair brought in."""
    keys = ["doc_id", "kind", "anchor"]
    return after.select(*keys).distinct().join(before.select(*keys), keys, "left_anti")


#: Longest note, and notes that one review may leave.
LONGEST_NOTE, MOST_NOTES = 300, 3


def noted(notes: DataFrame) -> DataFrame:
    """(note_id, verdict): what becomes of notes (note_id, review_id, scope, matter, client, statement) that a review
    leaves: pending until somebody confirms it, or the first reason against it. Firm-wide notes are never taken; a
    personal one may hold no figure and no company; a review's notes beyond MOST_NOTES are refused in their order."""
    text = F.trim(F.coalesce("statement", F.lit("")))
    reason = (
        F.when(~F.col("scope").isin("personal", "client", "matter", "firm"), "no such scope").when(F.col("scope") == "firm", "firm notes come from the playbook").when((F.col("scope") == "matter") & F.col("matter").isNull(), "no matter")
        .when((F.col("scope") == "client") & F.col("client").isNull(), "no client").when(text == "", "empty").when(F.length(text) > LONGEST_NOTE, "too long")
        .when((F.col("scope") == "personal") & text.rlike(r"\d|\b[A-Z][a-z]+ (?:Limited|Ltd|LLP|Inc)\b"), "personal notes are of style only")
    )
    staged = notes.select("note_id", "review_id", reason.alias("reason"))
    w = Window.partitionBy("review_id", F.col("reason").isNull()).orderBy("note_id")
    over = F.col("reason").isNull() & (F.row_number().over(w) > MOST_NOTES)
    return staged.withColumn("over", over).select("note_id", F.when(F.col("over"), "too many").otherwise(F.coalesce("reason", F.lit("pending"))).alias("verdict"))
