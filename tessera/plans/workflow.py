"""Registered queries of graph documents, review queue, jobs, event streams and exports, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import export, jobs, queue
from tessera.plans.graph import _ENT, _REL, all_entities, all_relations, query, table
from tessera.sources.graph_json import read_graphs
from tessera.sources.replies import answer_address
from tessera.streaming import jobs as stream

_NOW = "2024-01-15 00:00:00"


def _jobs(spark, d):
    states = F.array(*map(F.lit, ["PENDING", "RUNNING", "NEEDS_REVIEW", "SUCCEEDED"]))
    ts = F.col("ts").cast("timestamp")
    state = F.get(states, (F.col("event_id") % 4).cast("int"))
    return table(spark, d, "events").select(F.col("event_id").alias("job_id"), state.alias("state"), (F.col("event_id") % 3).alias("fence"), ts.alias("lease_until"), ts.alias("created_at"), ts.alias("updated_at"), (F.col("event_id") % 8 == 2).alias("has_conflict"))


_JOBS = "(SELECT event_id AS job_id, ['PENDING', 'RUNNING', 'NEEDS_REVIEW', 'SUCCEEDED'][CAST(event_id % 4 AS INTEGER) + 1] AS state, event_id % 3 AS fence, ts, event_id % 8 = 2 AS has_conflict FROM events)"


@query(f"""SELECT job_id, was, state FROM (SELECT job_id, state AS was, CASE WHEN state = 'RUNNING' THEN CASE WHEN ts <= TIMESTAMP '{_NOW}' THEN 'PENDING' END
WHEN ts + to_seconds(CASE WHEN state IN ('PENDING', 'SUCCEEDED') THEN 3600 WHEN has_conflict THEN 604800 ELSE 86400 END) <= TIMESTAMP '{_NOW}' THEN CASE WHEN state = 'SUCCEEDED' THEN 'reaped' ELSE 'EXPIRED' END END AS state FROM {_JOBS}) WHERE state IS NOT NULL""")
def job_sweep(spark, d):
    return jobs.sweep(_jobs(spark, d), F.lit(_NOW).cast("timestamp"))


@query(f"SELECT job_id, 'RUNNING' AS state, fence + 1 AS fence FROM {_JOBS} WHERE state = 'PENDING' OR (state = 'RUNNING' AND ts <= TIMESTAMP '{_NOW}') ORDER BY ts, job_id LIMIT 50")
def job_claim(spark, d):
    return jobs.claim(_jobs(spark, d), F.lit(_NOW).cast("timestamp"), 30, 50).select("job_id", "state", "fence")


@query(f"""SELECT job_id, CASE WHEN state = 'RUNNING' AND job_id % 5 <> fence THEN 'RUNNING' WHEN state IN ('RUNNING', 'PENDING') AND job_id % 2 = 1 AND state = 'RUNNING' THEN 'SUCCEEDED' ELSE state END AS state,
CASE WHEN state = 'RUNNING' AND job_id % 5 <> fence THEN 'stale_fence' WHEN state <> 'RUNNING' THEN 'not_allowed' END AS refused FROM {_JOBS}""")
def job_transitions(spark, d):
    """A worker reports the success of every job under a fence that is often an old one."""
    wanted = table(spark, d, "events").select(F.col("event_id").alias("job_id"), F.lit("SUCCEEDED").alias("to"), F.lit("worker").alias("by"), (F.col("event_id") % 5).alias("fence"))
    return jobs.transitions(_jobs(spark, d), wanted).select("job_id", "state", "refused")


def _events(spark, d):
    return table(spark, d, "events").select(F.col("user_id").alias("job_id"), F.when(F.col("event_type") == "purchase", "conflict").otherwise("progress").alias("kind"), F.col("ts").cast("timestamp").alias("at"), F.col("event_id").alias("seq"), F.col("props").alias("payload"))


@query("SELECT user_id AS job_id, max(event_id) AS seq, arg_max(props, event_id) AS payload FROM events WHERE event_type <> 'purchase' GROUP BY user_id")
def job_latest_progress(spark, d):
    return stream.latest_progress(_events(spark, d)).select("job_id", "seq", "payload")


@query("SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS start, CASE WHEN event_type = 'purchase' THEN 'conflict' ELSE 'progress' END AS kind, count(*) AS n FROM events GROUP BY ALL")
def job_activity(spark, d):
    return stream.activity(_events(spark, d), "1 hour").select(F.col("start").cast("string").alias("start"), "kind", "n")


def _lines(spark, d):
    """Lines say which supplier an order has: several say it of one pair."""
    ends = (F.concat(F.lit("order:"), "l_orderkey").alias("from_id"), F.lit("SUPPLIED_BY").alias("type"), F.concat(F.lit("supplier:"), "l_suppkey").alias("to_id"))
    prov = F.struct(F.lit("lineitem").alias("source"), F.lit("tabular").alias("producer"))
    return table(spark, d, "lineitem").select(*ends, F.lit("").alias("key"), F.to_json(F.struct(F.col("l_returnflag").alias("flag"))).alias("attributes"), prov.alias("prov"), F.struct("l_linenumber", "l_partkey", "l_returnflag").alias("ord"))


@query("SELECT 'order:' || l_orderkey AS from_id, 'supplier:' || l_suppkey AS to_id, count(DISTINCT l_returnflag) - 1 AS merged FROM lineitem GROUP BY ALL HAVING count(DISTINCT l_returnflag) > 1")
def export_merged_edges(spark, d):
    return export.stored_edges(_lines(spark, d), "triple")[1].select("from_id", "to_id", "merged")


@query("SELECT DISTINCT 'order:' || l_orderkey AS from_id, 'supplier:' || l_suppkey AS to_id FROM lineitem")
def export_triple_edges(spark, d):
    return export.stored_edges(_lines(spark, d), "triple")[0].select("from_id", "to_id")


@query(f"""WITH e AS (SELECT id, min(name) AS name, min(type) AS kind FROM {_ENT} GROUP BY id) SELECT from_id, r.type, to_id, a.name AS from_name, a.kind AS from_type, coalesce(b.name, to_id) AS to_name, b.kind AS to_type, a.name IS NULL OR b.name IS NULL AS dangling
FROM {_REL} r LEFT JOIN e a ON a.id = from_id LEFT JOIN e b ON b.id = to_id""")
def export_endpoints(spark, d):
    nodes = all_entities(spark, d).withColumn("ord", F.struct("id", "name"))
    return export.with_endpoints(all_relations(spark, d), nodes).select("from_id", "type", "to_id", "from_name", "from_type", "to_name", "to_type", "dangling")


@query("""SELECT '<urn:t:entity/nation%3A' || n_nationkey || '> a <urn:t:type/Nation> .' AS line FROM nation
UNION ALL SELECT '<urn:t:entity/nation%3A' || n_nationkey || '> <http://www.w3.org/2000/01/rdf-schema#label> "' || n_name || '" .' FROM nation
UNION ALL SELECT '<urn:t:entity/nation%3A' || n_nationkey || '> <urn:t:relation/PART_OF> <urn:t:entity/region%3A' || n_regionkey || '> .' FROM nation
UNION ALL SELECT '<< <urn:t:entity/nation%3A' || n_nationkey || '> <urn:t:relation/PART_OF> <urn:t:entity/region%3A' || n_regionkey || '> >> <urn:t:prov/source> "nation" ; <urn:t:prov/producer> "tabular" .' FROM nation""")
def export_turtle(spark, d):
    return export.turtle(all_entities(spark, d, ("nation",)), all_relations(spark, d, ("nation",)), "urn:t:")


@query("""SELECT kind_no, ord, CAST(floor((row_number() OVER (ORDER BY kind_no, ord) - 1) / 500) AS BIGINT) + 1 AS page
FROM (SELECT 1 AS kind_no, c_custkey AS ord FROM customer UNION ALL SELECT 2, o_orderkey FROM orders)""")
def export_pages(spark, d):
    rows = table(spark, d, "customer").select(F.lit(1).alias("kind_no"), F.col("c_custkey").alias("ord")).unionByName(table(spark, d, "orders").select(F.lit(2).alias("kind_no"), F.col("o_orderkey").alias("ord")))
    return export.pages(rows)


def _items(spark, d):
    kind = F.when(F.col("o_orderstatus") == "F", "conflict").when(F.col("o_orderstatus") == "O", "duplicate").otherwise("violation")
    return table(spark, d, "orders").select(kind.alias("kind"), F.concat(F.lit("customer:"), "o_custkey").alias("subject"), F.concat_ws("/", kind, "o_orderpriority").alias("shape"), F.col("o_orderkey").alias("ord"))


def _rules(spark):
    return spark.createDataFrame([("duplicate/1-URGENT", "reject", "ann", True, 1), ("duplicate/1-URGENT", "always", "bob", False, 2), ("conflict/2-HIGH", "always", "bob", False, 3), ("conflict/1-URGENT", "reject", "ann", True, 4)], "shape string, verb string, by string, authored boolean, ord long")


_ITEMS = "(SELECT *, kind || ':' || subject || CASE WHEN n > 1 THEN '#' || n ELSE '' END AS item_id FROM (SELECT kind, 'customer:' || o_custkey AS subject, kind || '/' || o_orderpriority AS shape, row_number() OVER (PARTITION BY kind, o_custkey ORDER BY o_orderkey) AS n FROM (SELECT *, CASE o_orderstatus WHEN 'F' THEN 'conflict' WHEN 'O' THEN 'duplicate' ELSE 'violation' END AS kind FROM orders) WHERE {0}))"


@query("SELECT item_id, kind, subject FROM " + _ITEMS.format("kind = 'conflict' OR kind || '/' || o_orderpriority = 'duplicate/1-URGENT'"))
def review_queue(spark, d):
    return queue.build(_items(spark, d), _rules(spark), False).select("item_id", "kind", "subject")


@query("SELECT item_id, CASE shape WHEN 'duplicate/1-URGENT' THEN 'reject' WHEN 'conflict/2-HIGH' THEN 'always' END AS verb, CASE shape WHEN 'duplicate/1-URGENT' THEN 'ann' WHEN 'conflict/2-HIGH' THEN 'bob' END AS by FROM " + _ITEMS.format("true"))
def review_resolve(spark, d):
    rules = _rules(spark)
    nobody = spark.createDataFrame([], "item_id string, verb string, by string, edit string, ord long")
    return queue.resolve(queue.build(_items(spark, d), rules, True), nobody, rules).select("item_id", "verb", "by")


def _documents(spark, d):
    """One graph document a nation, of its customers; the nation itself is not among its nodes."""
    node = F.struct(F.concat(F.lit("customer:"), "c_custkey").alias("id"), F.lit("Customer").alias("type"), F.col("c_name").alias("label"), F.col("c_mktsegment").alias("segment"))
    edge = F.struct(F.concat(F.lit("customer:"), "c_custkey").alias("from"), F.concat(F.lit("nation:"), "c_nationkey").alias("target"), F.lit("LOCATED_IN").alias("relation"))
    lists = table(spark, d, "customer").groupBy("c_nationkey").agg(F.collect_list(node).alias("nodes"), F.collect_list(edge).alias("links"))
    return lists.select(F.col("c_nationkey").cast("string").alias("source"), F.to_json(F.struct("nodes", "links")).alias("text"))


@query("SELECT 'customer:' || c_custkey AS id, 'Customer' AS type, c_name AS name, '{\"segment\":\"' || c_mktsegment || '\"}' AS attributes, c_nationkey::VARCHAR AS source FROM customer")
def graph_entities(spark, d):
    return read_graphs(_documents(spark, d)).entities.select("id", "type", "name", "attributes", F.col("prov.source").alias("source"))


@query("SELECT 'customer:' || c_custkey AS from_id, 'LOCATED_IN' AS type, 'nation:' || c_nationkey AS to_id, 'nation:' || c_nationkey AS missing FROM customer")
def graph_dangling(spark, d):
    return read_graphs(_documents(spark, d)).dangling.select("from_id", "type", "to_id", F.array_join("missing", ",").alias("missing"))


@query("SELECT item_id, sha256(unhex(printf('%016x', octet_length(encode(text)))) || encode(text) || unhex('0000000000000001') || encode('m')) AS address FROM benchmark")
def answer_addresses(spark, d):
    return table(spark, d, "benchmark").select("item_id", answer_address(F.col("text"), F.lit("m")).alias("address"))
