"""All checks of a message that is about to go out, over one table of messages with what they attach.

A message (msg_id, sender, external, filename, body, doc, tracked, comments): who writes to whom, the attachment's name, the
note, the attachment's text, and whether the file carries tracked changes or comments.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketmill.functions.text import all_of
from docketmill.operators import checks, mail
from docketmill.operators.routing import INTERNAL

CALLED_FINAL = r"\bfinal\b"


def _finding(frame: DataFrame, kind: str, note: str | Column) -> DataFrame:
    return frame.select("msg_id", F.lit(kind).alias("kind"), (F.col(note) if isinstance(note, str) else note).cast("string").alias("note"))


def another_recipient(messages: DataFrame) -> DataFrame:
    """Outside domains that fit none of the companies in the attachment; attachments without companies tell nothing."""
    named = messages.select(F.col("msg_id").alias("thread_id"), F.explode(all_of(F.col("doc"), checks.COMPANY, 1)).alias("name"))
    telling = messages.where(F.col("doc").rlike(checks.COMPANY)).withColumn("thread_id", F.col("msg_id"))
    return _finding(mail.wrong_recipient(telling, named), "another recipient", "domain")


def another_kind(messages: DataFrame) -> DataFrame:
    """Notes and names that both name kinds of documents, but none alike."""
    both = messages.select("msg_id", mail.kinds(F.col("body")).alias("said"), mail.kinds(F.col("filename")).alias("sent"))
    return _finding(both.where((F.size("said") > 0) & (F.size("sent") > 0) & ~F.arrays_overlap("said", "sent")), "another kind", F.concat_ws(" and ", F.array_join("said", ", "), F.array_join("sent", ", ")))


def companion_missing(messages: DataFrame) -> DataFrame:
    """Kinds of documents that a sentence hands over beside the one attached: named with it, and not in the name."""
    handed = F.array_join(mail.handed_over(F.col("body")), "\n")
    both = messages.select("msg_id", mail.kinds(handed).alias("said"), mail.kinds(F.col("filename")).alias("sent")).where(F.arrays_overlap("said", "sent"))
    return _finding(both.select("msg_id", F.explode(F.array_except("said", "sent")).alias("kind")), "companion missing", F.col("kind"))


def final_but_marked(messages: DataFrame) -> DataFrame:
    """Attachments that are called final and carry changes or comments."""
    called = F.lower("filename").rlike(CALLED_FINAL) | F.lower("body").rlike(CALLED_FINAL)
    carries = F.concat_ws(", ", F.when(F.col("tracked"), "changes"), F.when(F.col("comments"), "comments"))
    return _finding(messages.where(called & (carries != "")), "final but marked", carries)


def internal_marking(messages: DataFrame) -> DataFrame:
    """Markings in the attachment of what must not go out."""
    found = messages.where(F.col("external").isNotNull()).select("msg_id", F.explode(F.array_distinct(all_of(F.lower("doc"), INTERNAL))).alias("marking"))
    return _finding(found, "internal marking", "marking")


#: The twelve checks by the kind of their findings.
CHECKS = {
    "another recipient": another_recipient,
    "claim about file": lambda m: _finding(mail.clean_but_final(m), "claim about file", "note"),
    "still there": lambda m: _finding(mail.removals_still_there(m), "still there", "phrase"),
    "not clean": lambda m: _finding(mail.clean_but_marked(m), "not clean", "carries"),
    "another kind": another_kind,
    "own webmail": lambda m: _finding(mail.own_webmail(m.withColumn("owner", F.col("sender"))), "own webmail", "address"),
    "schedule not there": lambda m: _finding(mail.promised(m), "schedule not there", "title"),
    "final but marked": final_but_marked,
    "another version": lambda m: _finding(mail.version_mismatch(m), "another version", F.concat_ws(" and ", "said", "sent")),
    "another company": lambda m: _finding(mail.companies_not_there(m, checks.COMPANY), "another company", "company"),
    "companion missing": companion_missing,
    "internal marking": internal_marking,
}


def findings(messages: DataFrame, only: list[str] | None = None) -> DataFrame:
    """(msg_id, kind, note): what all checks, or those named, find; a row for each finding, none twice. Null bodies, texts and
    recipients have nothing to be found in. Each check reads the messages; keep them where they are dear to make."""
    return reduce(DataFrame.union, (CHECKS[k](messages) for k in only or CHECKS)).distinct()
