"""Queries over all that hangs together with a client, a matter or a person."""

from __future__ import annotations

from pyspark.sql import functions as F

from docketmill.operators.closure import Link, certificate, closure, out_of_reach
from docketmill.plans.claims import KEY, _PAD
from docketmill.plans.registry import query
from docketmill.plans.views import base

#: Sixteen kinds of objects that clients, matters and persons lead to.
LINKS = [
    Link("client", "matter", "customer", "c_nationkey", "c_custkey"),
    Link("client", "store", "nation", "n_nationkey", "n_nationkey"),
    Link("matter", "matter", "customer", "c_custkey", "cast(floor(c_custkey / 2) as bigint)", "c_custkey % 3 = 0 and c_custkey > 1"),
    Link("matter", "conversation", "orders", "o_custkey", "o_orderkey"),
    Link("matter", "message", "conversations", "conv_id", "conv_id * 100 + turn"),
    Link("conversation", "version", "lineitem", "l_orderkey", "concat(l_orderkey, '-', l_linenumber)"),
    Link("conversation", "negotiation", "lineitem", "l_orderkey", "concat(l_orderkey, '-', l_linenumber)", "l_returnflag = 'R'"),
    Link("conversation", "closing", "orders", "o_orderkey", "o_orderkey", "o_orderstatus = 'F'"),
    Link("closing", "conversation", "orders", "o_orderkey", "o_orderkey + 1", "o_orderstatus = 'F' and o_orderkey % 4 = 0"),
    Link("person", "message", "conversations", "conv_id % 7", "conv_id * 100 + turn"),
    Link("message", "read", "conversations", "conv_id * 100 + turn", "conv_id * 100 + turn", "role = 'user'"),
    Link("person", "note", "events", "user_id", "event_id", "event_type = 'view'"),
    Link("person", "suppression", "events", "user_id", "event_id", "event_type = 'error'"),
    Link("person", "outcome", "events", "user_id", "event_id", "event_type = 'purchase'"),
    Link("person", "job", "events", "user_id", "event_id", "event_type = 'click'"),
    Link("person", "access", "events", "user_id", "user_id"),
    Link("note", "projection", "events", "event_id", "event_id % 31", "event_type = 'view'"),
    Link("job", "audit", "events", "event_id", "event_id", "event_type = 'click'"),
    Link("audit", "session", "events", "event_id", "event_id % 97", "event_type = 'click'"),
    Link("session", "file", "events", "event_id % 97", "event_id % 1009", "event_type = 'click'"),
]
SEEDS = [("client", "3"), ("matter", "17"), ("person", "5")]
EDGES = "edges as (" + " union all ".join(f"select '{x.of}' as of_kind, cast({x.source} as varchar) as source, '{x.to}' as kind, cast({x.target} as varchar) as id from {x.table} where {x.where}" for x in LINKS) + ")"
FROM = lambda seeds: f"with recursive {EDGES}, reached(kind, id) as ({seeds} union select e.kind, e.id from reached r join edges e on e.of_kind = r.kind and e.source = r.id where e.id is not null)"
HELD = FROM(" union ".join(f"select '{k}', '{i}'" for k, i in SEEDS))
CLIENTS = FROM("select 'client', cast(n_nationkey as varchar) from nation")


def tables(spark, sf_dir):
    return {t: base(spark, sf_dir, t) for t in {x.table for x in LINKS}}


def held(spark, sf_dir):
    return closure(tables(spark, sf_dir), LINKS, spark.createDataFrame(SEEDS, "kind string, id string"))


@query(f"{HELD} select kind, id from reached")
def scope_closure(spark, sf_dir):
    """All objects of a client, a matter and a person together, over links that go on from one to the next."""
    return held(spark, sf_dir)


@query(f"""{HELD}, c as (select kind, count(*) as n, cast(sum(cast(concat('0x', left(sha256(id), 15)) as bigint)) as varchar) as digest from reached group by kind)
 select *, sha256('{_PAD["o"]}'::blob || unhex(sha256('{_PAD["i"]}'::blob || encode(concat_ws('|', kind, cast(n as varchar), digest))))) as signature from c""")
def scope_certificate(spark, sf_dir):
    """What a deletion of that scope would certify, signed."""
    return certificate(held(spark, sf_dir), KEY)


@query(f"{CLIENTS}, every as (select of_kind as kind, source as id from edges where source is not null and id is not null union select kind, id from edges where id is not null) select kind, count(*) as n from every e where not exists (select 1 from reached r where r.kind = e.kind and r.id = e.id) group by kind")
def out_of_clients_reach(spark, sf_dir):
    """What a deletion by client never finds, by kind."""
    t = tables(spark, sf_dir)
    clients = t["nation"].select(F.lit("client").alias("kind"), F.col("n_nationkey").cast("string").alias("id"))
    return out_of_reach(t, LINKS, closure(t, LINKS, clients))
