"""Queries over what messages and references are about."""

from __future__ import annotations

from pyspark.sql import functions as F

from docketmill.operators import checks, deadlines, routing
from docketmill.operators.structure import blocks
from docketmill.plans.documents import PARTED, agreements, finding, lines
from docketmill.plans.figures import ANCHORED, TABLE
from docketmill.plans.registry import query
from docketmill.plans.review import PAGES, pages
from docketmill.plans.views import base, view
from docketmill.sinks import word


@query("select doc_id, case when doc_id % 3 = 0 then 'day first' when doc_id % 3 = 1 then 'month first' end as reading from agreements")
def slash_orders(spark, sf_dir):
    dates = F.when(F.col("doc_id") % 3 == 0, "25/03/2026 and 04/05/2026").when(F.col("doc_id") % 3 == 1, "03/25/2026").otherwise("04/05/2026")
    return routing.slash_order(blocks(agreements(spark, sf_dir).select("doc_id", dates.alias("text"))))


@query(finding(r""", p0 as (select doc_id, idx, regexp_extract_all(text, '\b(Section|Clause|Article) (\d+)', 2) as n from blocks), p as (select doc_id, idx, cast(n[i] as int) as num from p0, unnest(range(1, len(n) + 1)) as t(i)),
 m0 as (select doc_id, num, row_number() over (partition by doc_id order by idx) as k from c where num is not null and part is null), m as (select doc_id, num, count(*) as n, min(k) as k from m0 group by 1, 2)
 select p.doc_id, p.idx, p.num as old, case when n = 1 then cast(k as int) end as new, case when n is null then 'no such clause' when n > 1 then 'ambiguous' when k = p.num then 'same' else 'renumber' end as verdict from p left join m on m.doc_id = p.doc_id and m.num = p.num"""))
def renumbering_plans(spark, sf_dir):
    return routing.renumbering_plan(lines(spark, sf_dir))


@query(f"with {PAGES} select signatory, closing_id, array_to_string(list_sort(list(distinct document)), ', ') as documents, count(distinct document) as n from pg group by 1, 2")
def signing_packets(spark, sf_dir):
    return routing.packets(pages(spark, sf_dir))


@query(f"""with vlines as (select doc_id, cast(i - 1 as int) as idx, p[i] as text from (select doc_id, string_split(text, chr(10)) as p from versions), unnest(range(1, len(p) + 1)) as t(i)), {ANCHORED.replace("from blocks", "from vlines")}
 select x.doc_id, x.anchor, count(*) as n from a x join a y on x.doc_id = y.doc_id and x.anchor = y.anchor and x.hi < y.lo group by 1, 2""")
def check_claims_before_release(spark, sf_dir):
    return routing.claims_before_release(deadlines.anchored(blocks(view(spark, sf_dir, "versions").select("doc_id", "text"))))


@query(f"with {TABLE}, n as (select doc_id, count(day) as dated, count(case when day is null then 1 end) as undated from tab group by 1) select *, concat(cast(dated as varchar), ' with a date, ', cast(undated as varchar), ' without') as note from n")
def deadline_notes(spark, sf_dir):
    return routing.dated_note(deadlines.table(lines(spark, sf_dir)))


@query("select doc_id, 23 as idx, 'INTERNAL ONLY' as marking from agreements where doc_id % 4 = 0 and doc_id % 3 <> 0")
def internal_markings(spark, sf_dir):
    docs = agreements(spark, sf_dir)
    marked = F.when(F.col("doc_id") % 4 == 0, F.concat("text", F.lit("\nINTERNAL ONLY: margin notes"))).otherwise(F.col("text"))
    return routing.internal_markings(blocks(docs.select("doc_id", marked.alias("text"))), docs.where("doc_id % 3 <> 0"))


@query("select msg_id, case turn % 3 when 0 then 1 else 2 end as client_id from mail where turn % 3 < 2")
def clients_named(spark, sf_dir):
    text = F.when(F.col("turn") % 3 == 0, "for Acme today").when(F.col("turn") % 3 == 1, "Northgate's copy").otherwise("Acme and Northgate")
    clients = spark.createDataFrame([(1, "Acme Holdings"), (2, "Northgate Freight")], "client_id int, name string")
    return routing.parties_by_text(view(spark, sf_dir, "mail").select("msg_id", text.alias("text")), clients)


@query("select doc_id, i as page, case i when 1 then 'cover' when 2 then concat('page two of ', cast(doc_id as varchar)) else 'end' end as text from agreements, unnest(range(1, 4)) as t(i)")
def transcript_pages(spark, sf_dir):
    text = F.concat(F.lit("cover [page 2] page two of "), F.col("doc_id").cast("string"), F.lit("[page 3]\nend"))
    return routing.pages_of_transcript(agreements(spark, sf_dir).select("doc_id", text.alias("text")))


@query("select doc_id, substr(text, 101, 80) as text, length(text) > 180 as more from documents")
def read_windows(spark, sf_dir):
    return routing.read_window(base(spark, sf_dir, "documents"), 100, 80)


@query("select msg_id, case turn % 4 when 0 then 'lease.docx' when 1 then 'note.pdf' end as filename, case turn % 4 when 0 then 'only one' when 1 then 'named' when 2 then 'several' else 'nothing to read' end as why from mail")
def picked_documents(spark, sf_dir):
    m = view(spark, sf_dir, "mail")
    names = F.when(F.col("turn") % 4 == 0, F.array(F.lit("lease.docx"), F.lit("logo.png"))).when(F.col("turn") % 4 == 3, F.array(F.lit("logo.png"))).otherwise(F.array(F.lit("lease.docx"), F.lit("note.pdf")))
    body = F.when(F.col("turn") % 4 == 1, "see the note please").otherwise("see here")
    return routing.pick_document(m.select("msg_id", body.alias("body"), F.explode(names).alias("filename")))


@query("select msg_id, case when turn % 2 = 0 then 1 else 2 end as change_id from mail")
def undone_by_words(spark, sf_dir):
    m = view(spark, sf_dir, "mail")
    asked = F.when(F.col("turn") % 2 == 0, "please undo the payment days change").otherwise("undo payment and freight")
    changes = m.select("thread_id").distinct().select("thread_id", F.inline(F.array(F.struct(F.lit(1).alias("change_id"), F.lit("payment within thirty days").alias("anchor")), F.struct(F.lit(2).alias("change_id"), F.lit("freight insurance of payment").alias("anchor")))))
    return routing.undo_by_words(m.select("msg_id", "thread_id", asked.alias("body")), changes)


@query("select distinct thread_id, problem, ref from (select thread_id, 'unanswered' as problem, '3' as ref from mail union all select thread_id, 'answered twice', '2' from mail where thread_id % 2 = 0 union all select thread_id, 'uncited', '9' from mail)")
def incomplete_drafts(spark, sf_dir):
    threads = view(spark, sf_dir, "mail").select("thread_id").distinct()
    rows = lambda *values: threads.select("thread_id", F.explode(F.array(*map(F.lit, values))).alias("point"))
    twice = rows(2).where("thread_id % 2 = 0")
    draft = rows(1, 2).union(twice).withColumn("cites", F.col("point") + 6)
    return routing.incomplete(draft, rows(1, 2, 3), rows(7, 8, 9).withColumnRenamed("point", "change_id"))


@query(f"with {PARTED}, f as (select c.doc_id, c.clause from c where regexp_matches(text, '\\[[A-Z][A-Z ]*\\]|_{{3,}}')), d as (select c.doc_id, c.clause from c where contains(text, 'thirty')) select coalesce(f.doc_id, d.doc_id) as doc_id, coalesce(f.clause, d.clause) as clause, coalesce(f.n, 0) as points, coalesce(d.n, 0) as changes from (select doc_id, clause, count(*) as n from f group by 1, 2) f full join (select doc_id, clause, count(*) as n from d group by 1, 2) d on d.doc_id = f.doc_id and d.clause = f.clause")
def points_by_clause(spark, sf_dir):
    from docketmill.operators.structure import with_clauses

    c = with_clauses(lines(spark, sf_dir))
    points = checks.blanks(lines(spark, sf_dir)).join(c.select("doc_id", "idx", "clause"), ["doc_id", "idx"])
    return routing.by_clause(points, c.where(F.instr("text", "thirty") > 0))


@query("select event_id, case event_id % 3 when 0 then '' when 1 then 'amount' else 'amount, done' end as problems from events")
def json_problems(spark, sf_dir):
    e = F.col("event_id")
    good, bad = F.lit('{"name": "a", "amount": 1.5, "done": true}'), F.lit('{"name": "a", "amount": "x", "done": false}')
    payload = F.when(e % 3 == 0, good).when(e % 3 == 1, bad).otherwise(F.lit('{"name": "a"}'))
    return base(spark, sf_dir, "events").select("event_id", routing.json_problems(payload, {"name": "text", "amount": "number", "done": "boolean"}).alias("problems"))


@query("select doc_id, anchor, case anchor when 'is made on' then 'safe' when 'Goods' then 'several' when 'nowhere at all' then 'nowhere' else 'across lines' end as verdict from agreements, (values ('is made on'), ('Goods'), ('nowhere at all'), ('Definitions \"Completion')) as v(anchor)")
def located_anchors(spark, sf_dir):
    anchors = agreements(spark, sf_dir).select("doc_id", F.explode(F.array(*map(F.lit, ["is made on", "Goods", "nowhere at all", 'Definitions "Completion']))).alias("anchor"))
    return word.located(lines(spark, sf_dir), anchors)


@query("select msg_id, case turn % 4 when 0 then 'ours' when 1 then 'theirs' when 2 then 'ours' else 'unknown' end as draft, case turn % 4 when 0 then 'words' when 1 then 'sender' when 2 then 'author' else 'nothing' end as why from mail")
def whose_drafts(spark, sf_dir):
    t = F.col("turn") % 4
    m = view(spark, sf_dir, "mail").select("msg_id", F.when(t == 0, "this is our draft").otherwise("see attached").alias("body"), F.when(t == 0, "x@acme.example").when(t == 1, "Y@Acme.example").alias("forwarded_from"), F.when(t < 3, "z@firm.example").alias("author"))
    return routing.whose_draft(m, "firm.example")


@query("select msg_id, case turn % 4 when 0 then 'approve' when 1 then 'show' end as intent from mail")
def playbook_intents(spark, sf_dir):
    t = F.col("turn") % 4
    body = F.when(t == 0, "Approve the playbook!").when(t == 1, "Could you show the playbook to Ann?").when(t == 2, "Don't show the playbook yet").otherwise("hello")
    intent = routing.playbook_intent(body, {"approve the playbook": "approve", "show the playbook": "show"}, r"\b(?:don t|do not|not)\b")
    return view(spark, sf_dir, "mail").select("msg_id", intent.alias("intent"))


@query("select msg_id, case when thread_id % 3 = 0 then 1 when turn % 3 = 0 then 2 end as closing_id, case when thread_id % 3 = 0 then 'thread' when turn % 3 = 0 then 'name' when turn % 3 = 1 then 'ask' else 'none' end as how from mail")
def closings_of_messages(spark, sf_dir):
    t = F.col("turn") % 3
    m = view(spark, sf_dir, "mail").select("msg_id", "thread_id", F.when(t == 0, "about Falcon").when(t == 1, "Falcon and Heron").otherwise("hello").alias("body"))
    aliases = m.where("thread_id % 3 = 0").select("thread_id", F.lit(1).alias("closing_id")).distinct()
    return routing.closing_of(m, aliases, spark.createDataFrame([(2, "Falcon"), (3, "Heron")], "closing_id int, name string"))
