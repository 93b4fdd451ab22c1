"""Queries over notes that hand documents over, clients and matters, archives, and what reviews leave behind."""

from __future__ import annotations

from pyspark.sql import functions as F

from docketmill.functions import secure
from docketmill.operators import checks, ledger, mail, memory
from docketmill.plans.registry import query
from docketmill.plans.views import base, view

KEY = b"a key for the checks"


def notes(spark, sf_dir):
    return view(spark, sf_dir, "notes")


FLAT = r"f as (select msg_id, trim(regexp_replace(lower(doc), '\s+', ' ', 'g')) as doc, trim(regexp_replace(lower(body), '\s+', ' ', 'g')) as body from notes)"
_quoted = lambda p: p.replace("'", "''")
_SPACED = "concat(' ', regexp_replace({x}, '[^a-z0-9.''’-]+|[.](?: |$)', ' ', 'g'), ' ')"
STILL = f"with {FLAT}, p as ({' union all '.join(f"select msg_id, doc, regexp_replace(trim(unnest(regexp_extract_all(body, '{_quoted(p)}', 1))), '{mail.LEADING}', '') as phrase from f" for p in mail.REMOVALS)}) select distinct msg_id, phrase from p where regexp_matches(phrase, '[ 0-9-]') and length(phrase) >= 6 and contains({_SPACED.format(x='doc')}, {_SPACED.format(x='phrase')})"
MARKED = r"""select msg_id, concat_ws(', ', case when tracked then 'changes' end, case when comments then 'comments' end) as carries from notes where (regexp_matches(lower(filename), '\bclean\b') or regexp_matches(lower(body), '\bclean (?:copy|version|draft)\b')) and (tracked or comments)"""
MISSING = rf"""with s as (select msg_id, doc, filename, sender, unnest(string_split(regexp_replace(regexp_replace(body, '\s+', ' ', 'g'), '([.!?]) ', '\1' || chr(10), 'g'), chr(10))) as s from notes where regexp_matches(doc, '{checks.COMPANY}')),
 h as (select * from s where regexp_matches(s, '(?i)\b(?:attach|enclos|find)') and not regexp_matches(s, '(?i)\b(?:will follow|to follow|not yet|later)\b')),
 c as (select msg_id, lower(doc) as doc, lower(filename) as filename, split_part(split_part(lower(sender), '@', 2), '.', 1) as own, trim(unnest(regexp_extract_all(s, '{checks.COMPANY}', 1))) as base, unnest(regexp_extract_all(s, '{checks.COMPANY}', 2)) as suffix from h)
 select distinct msg_id, concat(base, ' ', suffix) as company from c where suffix <> 'LLP' and not contains(doc, lower(base)) and not contains(filename, lower(base)) and not contains(replace(lower(base), ' ', ''), own)"""


@query(STILL)
def removals_still_there(spark, sf_dir):
    return mail.removals_still_there(notes(spark, sf_dir))


@query(MARKED)
def clean_but_marked(spark, sf_dir):
    return mail.clean_but_marked(notes(spark, sf_dir))


@query(MISSING)
def companies_not_there(spark, sf_dir):
    return mail.companies_not_there(notes(spark, sf_dir), checks.COMPANY)


@query(f"select msg_id, 'still there' as kind, phrase as note from ({STILL}) union all select msg_id, 'not clean', carries from ({MARKED}) union all select msg_id, 'another company', company from ({MISSING}) union all select null, 'no such columns', 'not run: AnalysisException'")
def message_checks(spark, sf_dir):
    """All checks of notes, and one over columns that are not there, which doesn't keep the others from running."""
    every = {"still there": (mail.removals_still_there, "phrase"), "not clean": (mail.clean_but_marked, "carries"), "another company": (lambda n: mail.companies_not_there(n, checks.COMPANY), "company"), "no such columns": (lambda n: n.select("nothing"), "nothing")}
    return mail.all_checks(notes(spark, sf_dir), every)


LINKS = "links as (select concat('c', cast(c_nationkey as varchar)) as client, concat('C', cast(c_nationkey as varchar), '-', cast(c_custkey as varchar)) as matter from customer where c_custkey % 3 = 0 union all select 'c1', concat('c2-', cast(c_custkey as varchar)) from customer where c_custkey % 50 = 1)"
SEEN = "seen as (select concat('c', cast(c_nationkey as varchar), '-', cast(c_custkey as varchar)) as matter from customer union all select concat('c2-', cast(c_custkey as varchar)) from customer union all select 'unnumbered' union all select concat('x9-', cast(c_custkey as varchar)) from customer)"


@query(rf"""with {LINKS}, {SEEN}, l as (select distinct lower(client) as client, lower(matter) as matter from links), n as (select distinct regexp_extract(lower(matter), '^([a-z0-9]+)-\d+$', 1) as client, lower(matter) as matter from seen where lower(matter) not in (select matter from l))
 select client, matter from l union select client, matter from n where client in (select client from l)""")
def matters_of_clients(spark, sf_dir):
    customer = base(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    made = lambda text, name: spark.sql(f"with {text.replace('from customer', 'from {customer}').replace('varchar', 'string')} select * from {name}", customer=customer)
    return ledger.matters_of_clients(made(LINKS, "links"), made(SEEN, "seen"))


@query("""with c as (select user_id as closing_id, max(ts) as updated_at from events group by 1), p as (select user_id as closing_id, count(*) as n_pages from events where event_type = 'purchase' group by 1)
 select c.closing_id, coalesce(n_pages, 0) as n_pages from c left join p on p.closing_id = c.closing_id where updated_at < (select max(ts) - interval 6 hour from events)""")
def expired_closings(spark, sf_dir):
    events = base(spark, sf_dir, "events")
    closings = events.groupBy(F.col("user_id").alias("closing_id")).agg(F.max("ts").alias("updated_at"))
    pages = events.where("event_type = 'purchase'").select(F.col("user_id").alias("closing_id"))
    return ledger.expired_closings(closings, pages, events.agg(F.max("ts") - F.expr("interval 6 hours")).scalar())


@query("select msg_id, owner, body from mail where msg_id % 3 <> 0")
def archive_writes(spark, sf_dir):
    """A third of the messages are kept already, and every message arrives twice."""
    m = view(spark, sf_dir, "mail").select("msg_id", "owner", "body")
    arrivals = m.withColumn("seq", F.lit(1)).union(m.withColumn("seq", F.lit(2)).withColumn("body", F.lit("replayed")))
    return ledger.archived(m.where("msg_id % 3 = 0"), arrivals, ["msg_id", "owner"]).drop("seq")


@query("select concat('u', cast(user_id as varchar)) as reader, event_id as msg_id, ts as at, event_id in (select msg_id from mail) as found from events")
def archive_reads(spark, sf_dir):
    reads = base(spark, sf_dir, "events").select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("reader"), F.col("event_id").alias("msg_id"), F.col("ts").alias("at"))
    return ledger.access_log(reads, view(spark, sf_dir, "mail"))


@query("select event_id as job_id, case when event_id % 3 <> 0 and event_type <> 'view' then ts + interval 600 second end as due from events")
def notices_due(spark, sf_dir):
    jobs = base(spark, sf_dir, "events").select(F.col("event_id").alias("job_id"), F.col("ts").alias("started"), (F.col("event_id") % 3 != 0).alias("model"), F.when(F.col("event_type") == "view", "sent").otherwise("asked").alias("entry"))
    return ledger.notices_due(jobs)


NOTED = "n as (select msg_id as note_id, thread_id as review_id, (['personal', 'client', 'matter', 'firm', 'world'])[cast(msg_id % 5 as int) + 1] as scope, case when turn % 3 > 0 then 'm1' end as matter, case when turn % 4 > 0 then 'c1' end as client, case when turn = 6 then ' ' when turn = 5 then 'Acme Limited prefers it' when turn = 4 then repeat('long ', 100) else 'Says will, not shall.' end as statement from mail)"


@query(rf"""with {NOTED}, r as (select *, case when scope = 'world' then 'no such scope' when scope = 'firm' then 'firm notes come from the playbook' when scope = 'matter' and matter is null then 'no matter' when scope = 'client' and client is null then 'no client' when trim(statement) = '' then 'empty' when length(trim(statement)) > {memory.LONGEST_NOTE} then 'too long'
 when scope = 'personal' and regexp_matches(trim(statement), '\d|\b[A-Z][a-z]+ (?:Limited|Ltd|LLP|Inc)\b') then 'personal notes are of style only' end as reason from n)
 select note_id, case when reason is null and row_number() over (partition by review_id, reason is null order by note_id) > {memory.MOST_NOTES} then 'too many' else coalesce(reason, 'pending') end as verdict from r""")
def noted_facts(spark, sf_dir):
    m = view(spark, sf_dir, "mail")
    scope = F.element_at(F.array(*map(F.lit, ("personal", "client", "matter", "firm", "world"))), (F.col("msg_id") % 5).cast("int") + 1)
    statement = F.when(F.col("turn") == 6, " ").when(F.col("turn") == 5, "Acme Limited prefers it").when(F.col("turn") == 4, F.repeat(F.lit("long "), F.lit(100))).otherwise("Says will, not shall.")
    return memory.noted(m.select(F.col("msg_id").alias("note_id"), F.col("thread_id").alias("review_id"), scope.alias("scope"), F.when(F.col("turn") % 3 > 0, "m1").alias("matter"), F.when(F.col("turn") % 4 > 0, "c1").alias("client"), statement.alias("statement")))


_PAD = {n: "".join(f"\\x{b ^ x:02X}" for b in KEY.ljust(64, b"\0")) for n, x in (("i", 0x36), ("o", 0x5C))}


@query(f"""with m as (select msg_id, concat(owner, chr(10), 'm', cast(thread_id as varchar), chr(10), cast(1000 + turn as varchar)) as message, turn from mail)
 select msg_id, concat(cast(1000 + turn as varchar), '.', sha256('{_PAD["o"]}'::blob || unhex(sha256('{_PAD["i"]}'::blob || encode(message))))) as token, turn > 3 as holds, false as holds_for_another from m""")
def capabilities(spark, sf_dir):
    """Leaves to read a matter, held up to the user that they are for and to another, at second 1003."""
    m = view(spark, sf_dir, "mail")
    matter, expires = F.concat(F.lit("m"), F.col("thread_id").cast("string")), 1000 + F.col("turn")
    made = m.select("msg_id", "owner", matter.alias("matter"), secure.capability(F.col("owner"), matter, expires, KEY).alias("token"))
    holds = lambda user: secure.is_capable(F.col("token"), user, F.col("matter"), F.lit(1003), KEY)
    return made.select("msg_id", "token", holds(F.col("owner")).alias("holds"), holds(F.lit("someone else")).alias("holds_for_another"))


@query("select event_id, user_id, event_type, value from events")
def saved_states(spark, sf_dir):
    """A job's state between steps goes to JSON and comes back with its types."""
    events = base(spark, sf_dir, "events")
    state = F.struct("user_id", F.struct("event_type", "value").alias("step"))
    kind = "user_id bigint, step struct<event_type: string, value: double>"
    back = events.select("event_id", F.from_json(F.to_json(state), kind).alias("s"))
    return back.select("event_id", "s.user_id", "s.step.event_type", "s.step.value")
