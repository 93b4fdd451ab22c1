"""Which document, client, conversation or change a message is about; and checks that references are complete."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketmill.functions.text import all_of
from docketmill.operators import structure

STOP = ["the", "and", "for", "please", "undo", "change", "that", "this", "of", "to"]
SLASH = r"\b(\d{1,2})/(\d{1,2})/\d{4}\b"
INTERNAL = r"(?i)\b(?:internal only|privileged and confidential draft|not for circulation|for internal use)\b"


def slash_order(blocks: DataFrame) -> DataFrame:
    """(doc_id, reading): day first or month first, by the dates with slashes that can only be read one way, each
    counting three, and a line that names a month of words nearby counting one for the day; null on a tie."""
    each = blocks.select("doc_id", F.inline(F.arrays_zip(all_of(F.col("text"), SLASH, 1).alias("a"), all_of(F.col("text"), SLASH, 2).alias("b")))).select("doc_id", F.col("a").try_cast("int").alias("a"), F.col("b").try_cast("int").alias("b"))
    votes = each.groupBy("doc_id").agg(F.sum(F.when((F.col("a") > 12) & (F.col("b") <= 12), 3).otherwise(0)).alias("day"), F.sum(F.when((F.col("b") > 12) & (F.col("a") <= 12), 3).otherwise(0)).alias("month"))
    return votes.select("doc_id", F.when(F.col("day") > F.col("month"), "day first").when(F.col("month") > F.col("day"), "month first").alias("reading"))


def renumbering_plan(blocks: DataFrame) -> DataFrame:
    """(doc_id, idx, old, new, verdict): references beside the clauses' new numbers; a number that stood twice, or
    none, leaves the reference to be asked about."""
    mapping = structure.renumbered(blocks).groupBy("doc_id", "old").agg(F.count(F.lit(1)).alias("n"), F.min("new").alias("new"))
    p = structure.pointers(blocks).join(mapping.withColumnRenamed("old", "number"), ["doc_id", "number"], "left")
    verdict = F.when(F.col("n").isNull(), "no such clause").when(F.col("n") > 1, "ambiguous").when(F.col("new") == F.col("number"), "same").otherwise("renumber")
    return p.select("doc_id", "idx", F.col("number").alias("old"), F.when(F.col("n") == 1, F.col("new")).alias("new"), verdict.alias("verdict"))


def packets(pages: DataFrame) -> DataFrame:
    """(signatory, closing_id, documents, n): what each signatory gets to sign."""
    return pages.groupBy("signatory", "closing_id").agg(F.array_join(F.array_sort(F.collect_set("document")), ", ").alias("documents"), F.count_distinct("document").alias("n"))


def claims_before_release(deadlines: DataFrame) -> DataFrame:
    """(doc_id, anchor, n): periods of one anchor, one of which ends before another of it begins: equal anchors, then
    an inequality of bounds."""
    a, b = deadlines.alias("a"), deadlines.alias("b")
    met = a.join(b, (F.col("a.doc_id") == F.col("b.doc_id")) & (F.col("a.anchor") == F.col("b.anchor")) & (F.col("a.hi") < F.col("b.lo")))
    return met.groupBy(F.col("a.doc_id").alias("doc_id"), F.col("a.anchor").alias("anchor")).agg(F.count(F.lit(1)).alias("n"))


def dated_note(rows: DataFrame) -> DataFrame:
    """(doc_id, dated, undated, note): how many time limits have a day and how many don't."""
    n = rows.groupBy("doc_id").agg(F.count("day").alias("dated"), F.count(F.when(F.col("day").isNull(), 1)).alias("undated"))
    return n.withColumn("note", F.concat(F.col("dated").cast("string"), F.lit(" with a date, "), F.col("undated").cast("string"), F.lit(" without")))


def internal_markings(blocks: DataFrame, outgoing: DataFrame) -> DataFrame:
    """(doc_id, idx, marking): internal markings in documents that go out."""
    marked = blocks.select("doc_id", "idx", F.explode(all_of(F.col("text"), INTERNAL)).alias("marking"))
    return marked.join(outgoing.select("doc_id").distinct(), "doc_id", "left_semi")


def parties_by_text(messages: DataFrame, clients: DataFrame) -> DataFrame:
    """(msg_id, client_id): the one client whose name's first word stands in the message; none on several. Words are
    joined, so no message meets a client that it doesn't name."""
    word = lambda c: F.explode(F.array_distinct(F.split(F.lower(c), r"[^a-z0-9]+")))
    said = messages.select("msg_id", word("text").alias("word"))
    named = clients.select("client_id", F.lower(F.regexp_extract("name", r"^(\w+)", 1)).alias("word"))
    return said.join(named, "word").groupBy("msg_id").agg(F.count_distinct("client_id").alias("n"), F.min("client_id").alias("client_id")).where("n = 1").select("msg_id", "client_id")


def pages_of_transcript(transcripts: DataFrame, mark: str = r"\[page (\d+)\]") -> DataFrame:
    """(doc_id, page, text): a transcript cut at its page marks; what stands before the first is page 1."""
    numbers = F.concat(F.array(F.lit("1")), all_of(F.col("text"), mark, 1))
    bare = F.transform(F.split("text", mark, -1), lambda t: F.regexp_replace(t, r"^\s+|\s+$", ""))
    each = transcripts.select("doc_id", F.inline(F.arrays_zip(numbers.alias("page"), bare.alias("text"))))
    return each.where("text <> ''").select("doc_id", F.col("page").try_cast("int").alias("page"), "text")


def read_window(docs: DataFrame, start: int, size: int) -> DataFrame:
    """(doc_id, text, more): a part of each text, and whether there is more after it."""
    return docs.select("doc_id", F.substring("text", start + 1, size).alias("text"), (F.length("text") > start + size).alias("more"))


def pick_document(files: DataFrame) -> DataFrame:
    """(msg_id, filename, why): the one document to work on: of the readable files the only one, else the only one
    whose name the message says, else none and why."""
    readable = F.lower("filename").rlike(r"\.(docx|pdf|txt|rtf)$")
    apart = lambda c: F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(c), r"[^a-z0-9]+", " ")), F.lit(" "))
    named = readable & (F.instr(apart(F.col("body")), apart(F.regexp_extract("filename", r"^([^.]+)", 1))) > 0)
    n = files.groupBy("msg_id").agg(F.count(F.when(readable, 1)).alias("ok"), F.count(F.when(named, 1)).alias("said"), F.min(F.when(readable, F.col("filename"))).alias("one"), F.min(F.when(named, F.col("filename"))).alias("picked"))
    return n.select("msg_id", F.when(F.col("ok") == 1, F.col("one")).when(F.col("said") == 1, F.col("picked")).alias("filename"), F.when(F.col("ok") == 0, "nothing to read").when(F.col("ok") == 1, "only one").when(F.col("said") == 1, "named").otherwise("several").alias("why"))


def undo_by_words(requests: DataFrame, changes: DataFrame) -> DataFrame:
    """(msg_id, change_id): the change of the same thread that shares most words with a request, if one does best."""
    words = lambda c: F.array_except(F.array_distinct(F.split(F.lower(c), r"[^a-z0-9]+")), F.array(*map(F.lit, [*STOP, ""])))
    r = requests.select("msg_id", "thread_id", F.explode(words("body")).alias("word"))
    c = changes.select("thread_id", "change_id", F.explode(words("anchor")).alias("word"))
    shared = r.join(c, ["thread_id", "word"]).groupBy("msg_id", "change_id").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("msg_id")
    best = shared.withColumn("best", F.max("n").over(w)).where("n = best")
    return best.groupBy("msg_id").agg(F.count(F.lit(1)).alias("k"), F.min("change_id").alias("change_id")).where("k = 1").select("msg_id", "change_id")


def incomplete(draft: DataFrame, points: DataFrame, changes: DataFrame) -> DataFrame:
    """(thread_id, problem, ref): points without an answer, points answered twice, and changes that no answer cites."""
    answers = draft.groupBy("thread_id", "point").agg(F.count(F.lit(1)).alias("n"))
    none = points.join(answers, ["thread_id", "point"], "left_anti").select("thread_id", F.lit("unanswered").alias("problem"), F.col("point").cast("string").alias("ref"))
    twice = answers.where("n > 1").select("thread_id", F.lit("answered twice").alias("problem"), F.col("point").cast("string").alias("ref"))
    uncited = changes.join(draft.select("thread_id", F.col("cites").alias("change_id")), ["thread_id", "change_id"], "left_anti").select("thread_id", F.lit("uncited").alias("problem"), F.col("change_id").cast("string").alias("ref"))
    return none.union(twice).union(uncited)


def by_clause(points: DataFrame, changes: DataFrame) -> DataFrame:
    """(doc_id, clause, points, changes): points beside the changes of the same clause, and either alone."""
    p = points.groupBy("doc_id", "clause").agg(F.count(F.lit(1)).alias("points"))
    c = changes.groupBy("doc_id", "clause").agg(F.count(F.lit(1)).alias("changes"))
    return p.join(c, ["doc_id", "clause"], "full_outer").na.fill(0, ["points", "changes"])


def json_problems(payload: Column, required: dict[str, str]) -> Column:
    """Names of required fields that a JSON text lacks or that aren't of their type, in order; all at once."""
    schema = ", ".join(f"`{k}` string" for k in required)
    parsed = F.from_json(payload, schema)
    wrong = {"number": lambda c: c.try_cast("double").isNull(), "boolean": lambda c: ~F.coalesce(c.isin("true", "false"), F.lit(False)), "text": lambda c: c.isNull()}
    return F.array_join(F.array_compact(F.array(*(F.when(wrong[t](parsed[k]), F.lit(k)) for k, t in required.items()))), ", ")


def whose_draft(messages: DataFrame, home: str) -> DataFrame:
    """(msg_id, draft, why): ours or theirs by what the message says, then by who first sent it on, then by the file's
    author; unknown where nothing tells."""
    text = F.lower("body")
    said = F.when(text.rlike(r"\b(?:our|my) (?:draft|paper|form)\b"), "ours").when(text.rlike(r"\b(?:their|the other side's|counterparty's) (?:draft|paper|form)\b"), "theirs")
    side = lambda address: F.when(F.col(address).isNotNull(), F.when(F.lower(F.substring_index(address, "@", -1)) == home, "ours").otherwise("theirs"))
    sender, author = side("forwarded_from"), side("author")
    why = F.when(said.isNotNull(), "words").when(sender.isNotNull(), "sender").when(author.isNotNull(), "author").otherwise("nothing")
    return messages.select("msg_id", F.coalesce(said, sender, author, F.lit("unknown")).alias("draft"), why.alias("why"))


def playbook_intent(body: Column, phrases: dict[str, str], guard: str) -> Column:
    """A whole message that is a known phrase; else the first phrase in it, unless a guard says that it is not meant."""
    norm = F.trim(F.regexp_replace(F.lower(body), r"[^a-z]+", " "))
    table = F.create_map(*(F.lit(x) for p in phrases.items() for x in p))
    inside = F.coalesce(*(F.when(F.instr(norm, p) > 0, F.lit(i)) for p, i in phrases.items()))
    return F.coalesce(F.try_element_at(table, norm), F.when(~norm.rlike(guard), inside))


def closing_of(messages: DataFrame, aliases: DataFrame, closings: DataFrame) -> DataFrame:
    """(msg_id, closing_id, how): the closing that a message's thread belongs to; else the one open closing whose name
    it says; asked about where there are several."""
    by_thread = messages.join(aliases, "thread_id", "left").select("msg_id", "body", F.col("closing_id").alias("known"))
    words = by_thread.where("known is null").select("msg_id", F.explode(F.array_distinct(F.split(F.lower("body"), r"[^a-z0-9]+"))).alias("word"))
    named = words.join(closings.select("closing_id", F.lower("name").alias("word")), "word").groupBy("msg_id").agg(F.count_distinct("closing_id").alias("n"), F.min("closing_id").alias("one"))
    both = by_thread.join(named, "msg_id", "left")
    how = F.when(F.col("known").isNotNull(), "thread").when(F.col("n") == 1, "name").when(F.col("n") > 1, "ask").otherwise("none")
    return both.select("msg_id", F.coalesce("known", F.when(F.col("n") == 1, F.col("one"))).alias("closing_id"), how.alias("how"))
