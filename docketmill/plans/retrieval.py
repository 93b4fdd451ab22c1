"""Queries for the conversations that files came from."""

from __future__ import annotations

from docketmill.operators import retrieval
from docketmill.plans.registry import query
from docketmill.plans.views import base

#: Conversations with their first text, and the files that come back: under the old name, or under another with the words
#: of one turn changed.
THREADS = """threads as (select conv_id as thread_id, concat('u', cast(conv_id % 7 as varchar(10)), '@firm.example') as owner, conv_id as seen_at, text,
 concat(case conv_id % 3 when 0 then 'Lease ' when 1 then 'Deed ' else 'Minutes ' end, cast(conv_id % 13 as varchar(10)), ' (draft).docx') as filename from conversations where turn = 0)"""
FILES = """files as (select conv_id * 10 + turn as file_id, concat('u', cast(conv_id % 7 as varchar(10)), '@firm.example') as owner,
 case when conv_id % 4 = 0 then 'scan.pdf' when turn % 2 = 0 then concat(case conv_id % 3 when 0 then 'lease ' when 1 then 'deed ' else 'minutes ' end, cast(conv_id % 17 as varchar(10)), ' v2 final.docx') else '' end as filename,
 replace(text, ' the ', ' a ') as text from conversations where turn <= 1)"""
STEM = "trim(regexp_replace(regexp_replace(regexp_replace(lower(filename), '\\.[a-z0-9]+$', ''), '\\((clean|draft|final|redline)\\)|\\bv[0-9]+\\b|\\b(clean|draft|final|redline|copy)\\b', ' ', 'g'), '[^a-z0-9]+', ' ', 'g'))"
FOUND = f"""{THREADS}, {FILES}, newest as (select owner, {STEM} as stem, arg_max(thread_id, (seen_at, thread_id)) as thread_id from threads group by 1, 2),
 named as (select file_id, n.thread_id from files f join newest n on n.owner = f.owner and n.stem = {STEM} where n.stem <> ''),
 recent as (select * from (select owner, thread_id, row_number() over (partition by owner order by seen_at desc, thread_id desc) as place from threads) where place <= 10),
 found as (select file_id, thread_id, 'name' as how, 0 as place from named union all select file_id, thread_id, 'recent', place from files join recent using (owner) where file_id not in (select file_id from named))"""


def tables(spark, sf_dir):
    c = base(spark, sf_dir, "conversations")
    made = lambda text, name: spark.sql(f"with {text.replace('from conversations', 'from {c}')} select * from {name}", c=c)
    return made(FILES, "files"), made(THREADS, "threads")


@query(f"with {FOUND} select file_id, thread_id, how, cast(place as int) as place from found")
def conversation_candidates(spark, sf_dir):
    """Where a file may have come from: one conversation by name, else the ten newest of its owner."""
    return retrieval.candidates(*tables(spark, sf_dir))


@query()
def conversations_of_files(spark, sf_dir):
    """Where each file came from; tests hold it against a comparison of all candidates."""
    return retrieval.conversations_of(*tables(spark, sf_dir))
