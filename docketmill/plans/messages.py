"""Queries over messages and scalar functions over text."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from docketmill.functions import text as T
from docketmill.operators import mail as M
from docketmill.plans.registry import query
from docketmill.sources import web
from docketmill.plans.views import base, view


def mail(spark, sf_dir):
    return view(spark, sf_dir, "mail")


_STOP = r"regexp_matches(x, '^\s*>') or regexp_matches(x, '^On .+ wrote:\s*$') or regexp_matches(x, '^-{2,} ?(?:Original|Forwarded) [Mm]essage') or regexp_matches(x, '^From: .+@') or regexp_matches(x, '^(?:--\s*|(?:Kind|Best|Warm) regards,?|Regards,?|Sent from my .+)$')"
_QUOTED = "concat(body, chr(10), case when turn % 2 = 0 then concat('On Monday someone wrote:', chr(10), '> older text') when turn % 3 = 0 then concat('Kind regards,', chr(10), 'A Person') else 'the end' end)"


@query(f"with b as (select msg_id, string_split({_QUOTED}, chr(10)) as lines from mail), e as (select msg_id, lines, coalesce(list_min(list_filter(list_transform(lines, lambda x, i: case when {_STOP} then i end), lambda x: x is not null)), len(lines) + 1) as stop from b) select msg_id, trim(array_to_string(lines[1:stop - 1], chr(10))) as own from e")
def own_words(spark, sf_dir):
    quoted = F.concat("body", F.lit("\n"), F.when(F.col("turn") % 2 == 0, F.lit("On Monday someone wrote:\n> older text")).when(F.col("turn") % 3 == 0, F.lit("Kind regards,\nA Person")).otherwise("the end"))
    return mail(spark, sf_dir).select("msg_id", M.own_words(quoted).alias("own"))


@query(r"""select msg_id, trim(s) as sentence from (select msg_id, unnest(string_split(regexp_replace(regexp_replace(body, '\s+', ' ', 'g'), '([.!?]) ', '\1' || chr(10), 'g'), chr(10))) as s from mail) where trim(s) <> ''""")
def message_sentences(spark, sf_dir):
    return mail(spark, sf_dir).select("msg_id", F.explode(M.sentences(F.col("body"))).alias("sentence"))


@query(r"""select msg_id, trim(s) as sentence from (select msg_id, unnest(string_split(regexp_replace(regexp_replace(body, '\s+', ' ', 'g'), '([.!?]) ', '\1' || chr(10), 'g'), chr(10))) as s from mail) where regexp_matches(s, '(?i)\b(?:attach|enclos|find)') and not regexp_matches(s, '(?i)\b(?:will follow|to follow|not yet|later)\b')""")
def handed_over(spark, sf_dir):
    return mail(spark, sf_dir).select("msg_id", F.explode(M.handed_over(F.col("body"))).alias("sentence"))


def _words(sql: str) -> str:
    r"""SQL whose patterns mark a word's begin and end by < and >: its neighbour is no letter of any script, digit, accent or
    underscore. DuckDB's \b knows only A-Z."""
    word = r"\p{L}\p{Nd}\p{M}_"
    return re.sub(r"'<([^'<>]*(?:''[^'<>]*)*)(>?)'", lambda m: f"'(?:^|[^{word}]){m[1].replace('WORD', word)}{f'(?:$|[^{word}])' if m[2] else ''}'", sql)


@query(_words(r"""with b as (select msg_id, subject, lower(body) as l, trim(regexp_replace(lower(body), '[.!\s]+', ' ', 'g')) as b from mail)
 select msg_id, case when regexp_matches(lower(subject), 'automatic reply|out of office|undeliverable|delivery status') then 'automated' when b in ('thanks', 'thank you', 'many thanks', 'ok', 'great', 'noted', 'received') then 'thanks' when b in ('undo', 'undo all', 'stop', 'status', 'compare', 'help') then concat('order: ', b)
 when regexp_matches(l, '<(?:compare|redline|blackline|what changed)>') then 'wish: compare' when regexp_matches(l, '<(?:previous|last|earlier) version>') then 'wish: previous version' when regexp_matches(l, '<renumber>') then 'wish: renumber' when regexp_matches(l, '<(?:repair|corrupt|won''t open)>') then 'wish: repair'
 when regexp_matches(l, '<signature pages?>') then 'wish: signature pack' when regexp_matches(l, '<undo>') then 'wish: undo' when regexp_matches(l, '<(?:review|attached|check)>') then 'wish: review' else 'question' end as route from b"""))
def routed_messages(spark, sf_dir):
    return M.routed(mail(spark, sf_dir)).select("msg_id", "route")


@query(_words(r"""select msg_id, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(regexp_extract(lower(body), '<undo(?:$|[.]|([^WORD.][^.]*))', 1), '\d+'), lambda n: cast(n as int)))), ',') as numbers from mail where regexp_matches(lower(body), '<undo>')"""))
def undo_requests(spark, sf_dir):
    found = mail(spark, sf_dir).select("msg_id", M.undo_numbers(F.col("body")).alias("n")).where("n is not null")
    return found.select("msg_id", F.array_join(F.transform("n", lambda x: x.cast("string")), ",").alias("numbers"))


@query("select msg_id, case when turn % 4 = 1 then 'Thanks!' end as answer from mail")
def answers_to_options(spark, sf_dir):
    return mail(spark, sf_dir).select("msg_id", M.answers(F.col("body"), F.array(F.lit("No"), F.lit("Thanks!"))).alias("answer"))


@query("select msg_id, case when msg_id % 2 = 0 then 'A,C' end as letters from mail")
def dismissed_points(spark, sf_dir):
    words = F.when(F.col("msg_id") % 2 == 0, "please dismiss a and c").otherwise("keep a")
    return mail(spark, sf_dir).select("msg_id", F.array_join(M.dismissed_letters(words), ",").alias("letters"))


@query("select msg_id, case when subject like 'Fwd:%' then 'forwarded' when direction = 'received' then 'direct' else 'copied' end as entry from mail")
def entry_modes(spark, sf_dir):
    return mail(spark, sf_dir).select("msg_id", M.entry_mode(F.col("subject"), F.col("direction") == "received").alias("entry"))


@query("select msg_id, case turn % 3 when 0 then 'admitted' when 1 then 'refused' else 'unknown' end as verdict from mail")
def admission_verdicts(spark, sf_dir):
    header = F.when(F.col("turn") % 3 == 0, "mx.example; spf=pass smtp.mailfrom=a.example; dkim=pass").when(F.col("turn") % 3 == 1, "mx.example; spf=pass; dmarc=fail").otherwise("mx.example; none")
    return mail(spark, sf_dir).select("msg_id", M.admitted(header).alias("verdict"))


@query("select msg_id, lower(regexp_extract(external, '<([^>]+)>', 1)) as outside from mail where external like '%<%' union all select msg_id, external from mail where external is not null and external not like '%<%'")
def outside_recipients(spark, sf_dir):
    both = mail(spark, sf_dir).select("msg_id", M.outside(F.array("external", "owner", "external"), "firm.example").alias("all"))
    return both.select("msg_id", F.explode("all").alias("outside"))


@query(r"select msg_id, concat_ws(',', case when regexp_matches(lower(concat(body, ' ', filename)), '\bagreement\b') then 'agreement' end, case when regexp_matches(lower(concat(body, ' ', filename)), '\blease\b') then 'lease' end, case when regexp_matches(lower(concat(body, ' ', filename)), '\bminutes\b') then 'minutes' end, case when regexp_matches(lower(concat(body, ' ', filename)), '\bschedule\b') then 'schedule' end, case when regexp_matches(lower(concat(body, ' ', filename)), '\bpower of attorney\b') then 'power of attorney' end) as kinds from mail")
def named_kinds(spark, sf_dir):
    return mail(spark, sf_dir).select("msg_id", F.array_join(M.kinds(F.concat_ws(" ", "body", "filename")), ",").alias("kinds"))


@query(r"""with v as (select msg_id, try_cast(regexp_extract(lower(body), '\b(?:v|version ?|draft ?)(\d+)\b', 1) as int) as said, try_cast(regexp_extract(lower(replace(filename, 'v2', 'v3')), '\b(?:v|version ?|draft ?)(\d+)\b', 1) as int) as sent from mail) select * from v where said <> sent union all select msg_id, 2, 3 from mail where turn % 3 = 1 and turn % 4 = 0 and false""")
def version_mismatches(spark, sf_dir):
    return M.version_mismatch(mail(spark, sf_dir).withColumn("filename", F.replace("filename", F.lit("v2"), F.lit("v3"))))


@query(r"select msg_id, case when contains(lower(filename), 'final') and regexp_matches(lower(body), '\bversion \d') then 'called final but numbered' else 'promises more' end as note from mail where (contains(lower(filename), 'final') and regexp_matches(lower(body), '\bversion \d')) or contains(lower(body), 'will follow')")
def claims_about_files(spark, sf_dir):
    return M.clean_but_final(mail(spark, sf_dir))


@query("select msg_id, concat('Schedule ', cast(i as varchar)) as title from mail, unnest(range(2, 4)) as t(i) where turn % 4 = 3")
def promised_schedules(spark, sf_dir):
    return M.promised(mail(spark, sf_dir).withColumn("body", F.replace("body", F.lit("Schedule 2"), F.lit("Schedules 2-3"))))


@query("select msg_id, owner, external as address from mail where external like '%gmail.com'")
def sent_to_webmail(spark, sf_dir):
    return M.own_webmail(mail(spark, sf_dir))


@query("with m as (select msg_id, thread_id, case when external like '%acme%' then 'acme' when external like '%northgate%' then 'northgate' else 'gmail' end as domain from mail where external is not null) select msg_id, domain from m where not (thread_id % 3 = 0 and domain = 'acme') and not (thread_id % 3 <> 0 and domain = 'northgate')")
def wrong_recipients(spark, sf_dir):
    m = mail(spark, sf_dir)
    parties = m.select("thread_id", F.when(F.col("thread_id") % 3 == 0, "Acme Holdings Limited").otherwise("Northgate Freight LLP").alias("name")).distinct()
    return M.wrong_recipient(m, parties)


@query(r"select msg_id, regexp_extract(subject, '\bMatter (\d{4,})\b', 1) as matter from mail where regexp_matches(subject, '\bMatter \d{4,}\b')")
def matters_of_messages(spark, sf_dir):
    return M.matter(mail(spark, sf_dir))


@query("select doc_id, true as whole, doc_id % 5 = 0 as with_gap, false as swapped from agreements")
def quotations_found(spark, sf_dir):
    docs = view(spark, sf_dir, "agreements")
    q = lambda s: M.quote_found(F.lit(s), F.col("text"))
    return docs.select("doc_id", (q("The Seller delivers") | q("is made on 3 March")).alias("whole"), q("Northgate Freight LLP ... Notice takes effect").alias("with_gap"), q("Notice takes effect ... is made on").alias("swapped"))


@query("select 'agreement' as stem, count(*) as n, min(msg_id) as first, max(msg_id) as last from mail")
def versions_by_stem(spark, sf_dir):
    return M.conversations_by_stem(mail(spark, sf_dir))


@query(r"select doc_id, trim(regexp_replace(replace(replace(text, '’', ''''), '“', '\"'), '\s+', ' ', 'g')) as squashed, left(sha256(concat_ws('|', cast(doc_id as varchar), lang)), 32) as key, upper(left(sha256(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'))), 6)) as reference from documents".replace('\\"', '"'))
def document_keys(spark, sf_dir):
    docs = base(spark, sf_dir, "documents")
    return docs.select("doc_id", T.squashed(F.col("text")).alias("squashed"), T.key_of(F.col("doc_id").cast("string"), F.col("lang")).alias("key"), T.reference(F.col("text")).alias("reference"))


@query("select doc_id, case when length(text) > 40 then concat(rtrim(left(text, 39)), '…') else text end as clipped from documents")
def clipped_texts(spark, sf_dir):
    return base(spark, sf_dir, "documents").select("doc_id", T.clipped(F.col("text"), 40).alias("clipped"))


@query("with v(word, value) as (values " + ", ".join(f"('{w}', {n})" for w, n in T.NUMBERS.items()) + ") select c_custkey, word as words, cast(value as int) as value from customer join v on value = c_custkey % 100")
def number_words(spark, sf_dir):
    words = T.in_words(F.col("c_custkey") % 100)
    return base(spark, sf_dir, "customer").select("c_custkey", words.alias("words"), T.number_of(words).alias("value"))


_ROMAN = "concat(repeat('m', cast(floor(n / 1000) as int)), (['', 'c', 'cc', 'ccc', 'cd', 'd', 'dc', 'dcc', 'dccc', 'cm'])[cast(floor(n / 100) as int) % 10 + 1], (['', 'x', 'xx', 'xxx', 'xl', 'l', 'lx', 'lxx', 'lxxx', 'xc'])[cast(floor(n / 10) as int) % 10 + 1], (['', 'i', 'ii', 'iii', 'iv', 'v', 'vi', 'vii', 'viii', 'ix'])[cast(n as int) % 10 + 1])"


@query(f"select c_custkey, {_ROMAN} as roman, repeat(chr(cast(97 + (n - 1) % 26 as int)), cast(floor((n - 1) / 26) + 1 as int)) as letters from (select c_custkey, 1 + c_custkey % 3999 as n from customer)")
def list_counters(spark, sf_dir):
    n = F.lit(1) + F.col("c_custkey") % 3999
    return base(spark, sf_dir, "customer").select("c_custkey", T.roman(n).alias("roman"), T.letters(n).alias("letters"))


@query("select doc_id, (length(left(text, instr(text, 'Buyer') - 1)) - length(replace(left(text, instr(text, 'Buyer') - 1), '\"', ''))) % 2 = 1 as quoted, '\"Buyer\")' as token from agreements")
def quoted_tokens(spark, sf_dir):
    docs = view(spark, sf_dir, "agreements")
    at = F.instr("text", "Buyer")
    return docs.select("doc_id", T.inside_quotes(F.col("text"), at).alias("quoted"), T.token_around(F.col("text"), at).alias("token")).withColumn("token", F.regexp_replace("token", r"^\(the ", ""))


@query("select msg_id, cast(thread_id as varchar) as thread, owner as sender, external as recipient, subject, body, filename, concat('answer to ', subject) as answer from mail where external is not null")
def vendor_messages(spark, sf_dir):
    """Messages as another vendor's JSON gives them, the conversation under three names, bare or wrapped, and answers as JSON."""
    m = mail(spark, sf_dir).where("external is not null").withColumn("thread", F.col("thread_id").cast("string"))
    named = [F.when(F.col("turn") % 3 == i, F.col("thread")).alias(n) for i, n in enumerate(("thread_id", "threadId", "conversation_id"))]
    raw = F.struct(F.col("msg_id").cast("string").alias("message_id"), *named, F.col("owner").alias("from"), F.array("external").alias("to"), "subject", F.col("body").alias("text"), F.array(F.struct("filename")).alias("attachments"))
    payload = F.when(F.col("turn") % 2 == 0, F.to_json(raw)).otherwise(F.to_json(F.struct(raw.alias("message"))))
    read = m.select(payload.alias("payload")).select(web.from_vendor(F.col("payload")).alias("v"))
    sent = F.from_json(web.outbound(F.array("v.sender"), F.concat(F.lit("answer to "), "v.subject"), F.col("v.body"), in_reply_to=F.col("v.message_id")), "subject string, headers map<string,string>")
    return read.select(F.col("v.message_id").cast("bigint").alias("msg_id"), "v.thread", "v.sender", F.get("v.to", F.lit(0)).alias("recipient"), "v.subject", "v.body", F.get("v.attachments", F.lit(0))["name"].alias("filename"), sent["subject"].alias("answer"))
