"""Messages: whose words they are, what they ask for, where they belong, and what they claim of a document."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketmill.functions.text import all_of, bare_address, domain_of, stem_of
from docketmill.operators.ledger import FREE_MAIL

#: Whole messages of a few words that are orders, and what they order.
COMMANDS = {"undo": "undo", "undo all": "undo all", "stop": "stop", "status": "status", "compare": "compare", "help": "help"}
THANKS = ["thanks", "thank you", "many thanks", "ok", "great", "noted", "received"]
#: Lines at which quoted history begins.
QUOTED = [r"^\s*>", r"^On .+ wrote:\s*$", r"^-{2,} ?(?:Original|Forwarded) [Mm]essage", r"^From: .+@", r"^Am .+ schrieb .+:\s*$", r"^Le .+ a écrit\s*:\s*$"]
SIGNATURE = r"^(?:--\s*|(?:Kind|Best|Warm) regards,?|Regards,?|Sent from my .+)$"
#: Where a word begins and ends: beside it stands no letter of any script, digit, accent or underscore. Java's \b means this
#: or only A-Z, by its version.
BEGIN, END = r"(?<![\p{L}\p{Nd}\p{M}_])", r"(?![\p{L}\p{Nd}\p{M}_])"
#: Phrases of a message by the wish that they show; the first that applies, in this order, is the plan.
INTENTS = {"compare": rf"{BEGIN}(?:compare|redline|blackline|what changed){END}", "previous version": rf"{BEGIN}(?:previous|last|earlier) version{END}", "renumber": rf"{BEGIN}renumber{END}", "repair": rf"{BEGIN}(?:repair|corrupt|won't open){END}", "signature pack": rf"{BEGIN}signature pages?{END}", "undo": rf"{BEGIN}undo{END}", "review": rf"{BEGIN}(?:review|attached|check){END}"}
KINDS = {"agreement": r"\bagreement\b", "lease": r"\blease\b", "minutes": r"\bminutes\b", "schedule": r"\bschedule\b", "power of attorney": r"\bpower of attorney\b"}


def own_words(body: Column) -> Column:
    """What a sender wrote: lines before quoted history and before a signature."""
    lines = F.split(body, "\r?\n", -1)
    stop = lambda x: reduce(Column.__or__, (x.rlike(p) for p in [*QUOTED, SIGNATURE]))
    marked = F.transform(lines, lambda x, i: F.when(stop(x), i))
    end = F.coalesce(F.array_min(marked), F.size(lines))
    return F.trim(F.array_join(F.slice(lines, F.lit(1), end), "\n"))


def sentences(text: Column) -> Column:
    """Sentences of a text with soft line ends undone."""
    flat = F.regexp_replace(text, r"\s+", " ")
    return F.filter(F.transform(F.split(F.regexp_replace(flat, r"([.!?]) ", "$1\n"), "\n", -1), lambda x: F.trim(x)), lambda x: x != "")


def handed_over(body: Column) -> Column:
    """Sentences that hand something over now, not later."""
    return F.filter(sentences(body), lambda s: s.rlike(r"(?i)\b(?:attach|enclos|find)") & ~s.rlike(r"(?i)\b(?:will follow|to follow|not yet|later)\b"))


def routed(mail: DataFrame) -> DataFrame:
    """mail with `route`: automated mail, thanks, an order, a wish, or else a question, by precedence."""
    body = F.trim(F.regexp_replace(F.lower("body"), r"[.!\s]+", " "))
    automated = F.lower("subject").rlike(r"automatic reply|out of office|undeliverable|delivery status")
    table = F.create_map(*(F.lit(x) for p in COMMANDS.items() for x in p))
    wishes = [F.when(F.lower("body").rlike(p), F.concat(F.lit("wish: "), F.lit(w))) for w, p in INTENTS.items()]
    route = F.when(automated, "automated").when(body.isin(THANKS), "thanks")
    return mail.withColumn("route", F.coalesce(route, F.concat(F.lit("order: "), F.try_element_at(table, body)), *wishes, F.lit("question")))


def undo_numbers(text: Column) -> Column:
    """The numbers that a request to undo names, ascending; null where it is none."""
    asked = F.lower(text).rlike(rf"{BEGIN}undo{END}")
    found = F.transform(all_of(F.regexp_extract(F.lower(text), rf"{BEGIN}undo{END}([^.]*)", 1), r"\d+"), lambda n: n.try_cast("int"))
    return F.when(asked, F.array_sort(F.array_distinct(F.array_compact(found))))


def answers(body: Column, options: Column) -> Column:
    """The option that a short reply repeats, else null."""
    norm = lambda x: F.trim(F.regexp_replace(F.lower(x), r"[^a-z0-9]+", " "))
    return F.get(F.filter(options, lambda o: norm(o) == norm(body)), F.lit(0))


def dismissed_letters(text: Column) -> Column:
    """Letters after a wish to dismiss, in order; null where there is none."""
    rest = F.regexp_extract(F.lower(text), r"\b(?:dismiss|ignore)\b([a-z ,]*)", 1)
    return F.when(F.lower(text).rlike(r"\b(?:dismiss|ignore)\b"), F.transform(all_of(rest, r"\b[a-x]\b"), lambda x: F.upper(x)))


def entry_mode(headers: Column, to_us: Column) -> Column:
    """How a message came: sent to us, forwarded, or copied."""
    return F.when(F.lower(headers).startswith("fwd:") | F.lower(headers).startswith("fw:"), "forwarded").when(to_us, "direct").otherwise("copied")


def authentication(header: Column) -> Column:
    """method -> verdict of an authentication-results header."""
    parts = F.filter(F.transform(F.split(header, ";"), lambda p: F.regexp_extract(p, r"^\s*([a-z0-9]+=[a-z]+)", 1)), lambda p: p != "")
    return F.str_to_map(F.array_join(parts, ";"), F.lit(";"), F.lit("="))


def admitted(header: Column) -> Column:
    """pass only if one method passes and none fails; unknown is no failure."""
    verdicts = F.map_values(authentication(header))
    return F.when(F.array_contains(verdicts, "fail"), "refused").when(F.array_contains(verdicts, "pass"), "admitted").otherwise("unknown")


def outside(addresses: Column, home: str) -> Column:
    """Bare addresses of other domains, once each, in order."""
    return F.array_distinct(F.filter(F.transform(addresses, bare_address), lambda a: F.coalesce(domain_of(a) != home, F.lit(False))))


def kinds(text: Column) -> Column:
    """The kinds of document that a text names."""
    return F.array_compact(F.array(*(F.when(F.lower(text).rlike(p), k) for k, p in KINDS.items())))


def version_of(text: Column) -> Column:
    """A version number that a text states, else null."""
    return F.nullif(F.regexp_extract(F.lower(text), r"\b(?:v|version ?|draft ?)(\d+)\b", 1), F.lit("")).try_cast("int")


def version_mismatch(mail: DataFrame) -> DataFrame:
    """Messages that state one version and attach another."""
    both = mail.select("msg_id", version_of(F.col("body")).alias("said"), version_of(F.col("filename")).alias("sent"))
    return both.where("said <> sent")


def clean_but_final(mail: DataFrame) -> DataFrame:
    """(msg_id, note): attachments whose name and whose message disagree on being final or a draft."""
    final = F.lower("filename").contains("final") & F.lower("body").rlike(r"\bversion \d")
    follows = F.lower("body").rlike(r"\bwill follow\b")
    note = F.when(final, "called final but numbered").when(follows, "promises more")
    return mail.select("msg_id", note.alias("note")).where("note is not null")


def promised(mail: DataFrame) -> DataFrame:
    """(msg_id, title): schedules that a message names and that its attachment's name lacks; ranges count as all,
    of a thousand at most: a longer one is none."""
    named = mail.select("msg_id", "filename", F.explode(all_of(F.col("body"), r"\bSchedules? (\d+(?:-\d+)?)", 1)).alias("r"))
    first, last = F.substring_index("r", "-", 1).try_cast("int"), F.substring_index("r", "-", -1).try_cast("int")
    each = named.where((first <= last) & (last - first < 1000)).select("msg_id", "filename", F.explode(F.sequence(first, last)).alias("n"))
    return each.where(~F.lower("filename").contains(F.concat(F.lit("schedule "), F.col("n").cast("string")))).select("msg_id", F.concat(F.lit("Schedule "), F.col("n").cast("string")).alias("title")).distinct()


def own_webmail(mail: DataFrame) -> DataFrame:
    """Messages that go to a free mail address."""
    address = bare_address(F.col("external"))
    return mail.where(domain_of(address).isin(FREE_MAIL)).select("msg_id", "owner", address.alias("address"))


def wrong_recipient(mail: DataFrame, parties: DataFrame) -> DataFrame:
    """(msg_id, domain): outside recipients none of whose thread's parties (thread_id, name) fits their domain."""
    domain = F.regexp_replace(domain_of(bare_address(F.col("external"))), r"\.[a-z]+$", "")
    named = mail.where("external is not null").select("msg_id", "thread_id", domain.alias("domain"))
    fits = named.join(parties, "thread_id").where(F.instr(F.lower("name"), F.col("domain")) > 0)
    return named.join(fits.select("msg_id"), "msg_id", "left_anti").select("msg_id", "domain")


def matter(mail: DataFrame) -> DataFrame:
    """(msg_id, matter): the matter number in a subject."""
    return mail.select("msg_id", F.nullif(F.regexp_extract("subject", r"\bMatter (\d{4,})\b", 1), F.lit("")).alias("matter")).where("matter is not null")


def quote_found(quote: Column, text: Column) -> Column:
    """Whether a quotation stands in a text word for word; an ellipsis stands for anything between its parts."""
    plain = lambda low: F.trim(F.regexp_replace(low, r"[^a-z0-9.]+", " "))
    words = lambda x, between: F.filter(F.transform(F.split(x, between), lambda p: F.trim(p)), lambda p: p != "")
    parts, single = words(plain(F.lower(quote)), r"\.\.\."), words(plain(F.lower(quote)), r"\.\.\.| ")

    def in_order(pieces: Column, whole: Column) -> Column:
        def step(at: Column, p: Column) -> Column:
            found = F.position(p, whole, at)
            return F.when((at == 0) | (found == 0), F.lit(0)).otherwise(found + F.length(p))

        return F.aggregate(pieces, F.lit(1), step) > 0

    def within(low: Column) -> Column:
        # parts that stand there as they are stand in the plain text, and words that do not stand there in order do not; only
        # what neither tells needs the plain text, which costs more than all else
        return F.when(in_order(parts, low), True).when(~in_order(single, low), False).otherwise(F.element_at(F.transform(F.array(plain(low)), lambda whole: in_order(parts, whole)), 1))

    # a variable of a lambda, so that the text is put in lower case once and not in each step
    return F.element_at(F.transform(F.array(F.lower(text)), within), 1)


def conversations_by_stem(files: DataFrame) -> DataFrame:
    """(stem, n, first, last): messages whose attachments are versions of one document."""
    return files.withColumn("stem", stem_of(F.col("filename"))).groupBy("stem").agg(F.count(F.lit(1)).alias("n"), F.min("msg_id").alias("first"), F.max("msg_id").alias("last"))


#: How a note says that something went, who did it named or not, and what may stand between that and the thing.
WENT = r"(?:removed|deleted|dropped|omitted|excised|cut(?: out)?|struck(?: out| through)?|taken out|stripped out)"
THING, BEFORE = r"([a-z0-9][a-z0-9 .'’-]*?)", r"(?:(?:the|all|any|every|our|your|references? to) )*"
KIND_OF_TEXT = r"(?: (?:clauses?|wording|language|text|provisions?|paragraphs?))?"
#: Somebody took it out, it was taken out, the text no longer has it: the thing is the first group.
REMOVALS = [
    rf"\b(?:{WENT}|took out|no longer (?:contains?|includes?|mentions?|has)) {BEFORE}{THING}{KIND_OF_TEXT}(?: (?:from|as|and|per|so|in|at|which|because)\b|[,;:!?]|[.](?: |$)|$)",
    rf"(?:^|[,;:.!?] |\b(?:and|that|but|agreed) ){BEFORE}{THING}{KIND_OF_TEXT} (?:is|are|was|were|has been|have been|had been)(?: now| also| all)? (?:{WENT}|gone)\b",
]
#: Words at the beginning of a thing that are none of it.
LEADING = r"^(?:(?:as|agreed|and|that|but|also|then|so|you|will|see|the|all|any|every|our|your) )+"


def removals_still_there(notes: DataFrame) -> DataFrame:
    """(msg_id, phrase): what a note (msg_id, body, doc) says was taken out, or is no longer there, and the document still
    holds as whole words. A single common word tells nothing: a phrase has two words, a hyphen or a number."""
    flat = lambda c: F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))
    body = flat(F.col("body"))
    said = F.array_distinct(F.transform(F.concat(*(all_of(body, p, 1) for p in REMOVALS)), lambda x: F.regexp_replace(F.trim(x), LEADING, "")))
    each = notes.select("msg_id", flat(F.col("doc")).alias("doc"), F.explode(said).alias("phrase"))
    spaced = lambda c: F.concat(F.lit(" "), F.regexp_replace(c, r"[^a-z0-9.'’-]+|[.](?: |$)", " "), F.lit(" "))
    telling = F.col("phrase").rlike("[ 0-9-]") & (F.length("phrase") >= 6)
    return each.where(telling & F.contains(spaced("doc"), spaced("phrase"))).select("msg_id", "phrase").distinct()


def clean_but_marked(notes: DataFrame) -> DataFrame:
    """(msg_id, carries): attachments that their name or note calls clean and that carry changes or comments (notes
    has the booleans tracked and comments)."""
    called = F.lower("filename").rlike(r"\bclean\b") | F.lower("body").rlike(r"\bclean (?:copy|version|draft)\b")
    carries = F.concat_ws(", ", F.when(F.col("tracked"), "changes"), F.when(F.col("comments"), "comments"))
    return notes.where(called).select("msg_id", carries.alias("carries")).where("carries <> ''")


def companies_not_there(notes: DataFrame, company: str) -> DataFrame:
    """(msg_id, company): companies in the sentences that hand a document over which neither it nor its name holds.
    Law firms (LLP) and the sender's own are left out, and documents that name no company tell nothing."""
    own = F.regexp_replace(domain_of(bare_address(F.col("sender"))), r"\..*$", "")
    handed = F.array_join(handed_over(F.col("body")), "\n")
    named = notes.where(F.col("doc").rlike(company)).withColumn("__handed", handed).select("msg_id", "doc", "filename", own.alias("own"), F.inline(F.arrays_zip(all_of(F.col("__handed"), company, 1).alias("base"), all_of(F.col("__handed"), company, 2).alias("suffix"))))
    base = F.lower(F.trim("base"))
    there = (F.instr(F.lower("doc"), base) > 0) | (F.instr(F.lower("filename"), base) > 0)
    theirs = F.instr(F.replace(base, F.lit(" "), F.lit("")), F.col("own")) > 0
    return named.where(~there & ~theirs & (F.col("suffix") != "LLP")).select("msg_id", F.concat_ws(" ", F.trim("base"), "suffix").alias("company")).distinct()


def all_checks(notes: DataFrame, checks: dict) -> DataFrame:
    """(msg_id, kind, note): every check of messages, {kind: (function, column of the note)}. A check that can't be set
    up over these columns is told in a row of its own, without a message, and the others go on."""
    from pyspark.errors import PySparkException

    out = None
    for kind, (check, column) in checks.items():
        try:
            found = check(notes).select(F.col("msg_id").cast("bigint").alias("msg_id"), F.lit(kind).alias("kind"), F.col(column).cast("string").alias("note"))
        except PySparkException as e:
            found = notes.sparkSession.createDataFrame([(None, kind, f"not run: {type(e).__name__}")], "msg_id bigint, kind string, note string")
        out = found if out is None else out.union(found)
    return out
