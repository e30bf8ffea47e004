"""Registered queries of the store, its log and readers, with their SQL twins."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import token_estimate
from tessera.operators import answers, budget, check, leases, lists, load, messages, recheck, review, sink
from tessera.operators.cut import cut
from tessera.operators.folder import import_folder
from tessera.operators.txlog import Folder
from tessera.plans.graph import all_entities, all_relations, query, table
from tessera.plans.workflow import _JOBS, _NOW, _jobs
from tessera.streaming import hub


def folder(spark: SparkSession, what: str) -> str:
    """A new folder in the shared one."""
    cut(spark.range(1))  # names the shared folder
    return f"{spark.sparkContext.getCheckpointDir()}/{what}-{uuid.uuid4().hex}"


def _ordered(rows: DataFrame) -> DataFrame:
    return rows.withColumn("ord", F.xxhash64("id"))


@query("""SELECT CAST(n AS BIGINT) AS number, load_id, done, entities FROM (VALUES (1, '007', 'begun', NULL), (2, '007', 'written', (SELECT count(*) FROM nation)), (3, 'x/y=1', 'begun', NULL), (4, 'x/y=1', 'written', (SELECT count(*) FROM supplier)),
(5, '007', 'begun', NULL), (6, '007', 'written', (SELECT count(*) FROM customer)), (7, 'x/y=1', 'deleted', NULL)) t(n, load_id, done, entities)""")
def store_history(spark, d):
    """What happened to two loads with awkward names, of which one was exchanged and the other deleted."""
    store = load.Store(spark, folder(spark, "history"))
    for name, kind in (("007", "nation"), ("x/y=1", "supplier"), ("007", "customer")):
        store.load(name, {"entities": _ordered(all_entities(spark, d, (kind,))), "relations": all_relations(spark, d, (kind,))}, replace=True)
    store.delete("x/y=1")
    return store.history().select("number", "load_id", "done", F.col("rows")["entities"].alias("entities"))


@query(f"""WITH free AS (SELECT job_id, fence, row_number() OVER (ORDER BY ts, job_id::VARCHAR) AS r FROM {_JOBS} WHERE state = 'PENDING' OR (state = 'RUNNING' AND ts <= TIMESTAMP '{_NOW}'))
SELECT j.job_id::VARCHAR AS job_id, CASE WHEN r <= 80 THEN 'RUNNING' ELSE state END AS state, CASE WHEN r <= 80 THEN j.fence + 1 ELSE j.fence END AS fence, CASE WHEN r <= 40 THEN 'a' WHEN r <= 80 THEN 'b' END AS holder
FROM {_JOBS} j LEFT JOIN free ON free.job_id = j.job_id""")
def job_claim_committed(spark, d):
    """All jobs after two workers have claimed forty each through one log."""
    held = leases.Leases(spark, folder(spark, "leases"))
    held.add(_jobs(spark, d))
    for holder in ("a", "b"):
        held.claim(holder, F.lit(_NOW).cast("timestamp"), 30, 40)
    return held.table().select("job_id", "state", "fence", "holder")


def _mail(spark: SparkSession, d: str) -> DataFrame:
    """Documents, customers and orders as records of a result, in order."""
    docs = table(spark, d, "documents").select(F.lit(1).alias("kind_no"), F.col("doc_id").alias("ord"), F.octet_length("text").alias("size"))
    people = table(spark, d, "customer").select(F.lit(2).alias("kind_no"), F.col("c_custkey").alias("ord"), F.octet_length(F.concat("c_name", "c_mktsegment")).alias("size"))
    orders = table(spark, d, "orders").select(F.lit(3).alias("kind_no"), F.col("o_orderkey").alias("ord"), F.octet_length(F.concat("o_orderstatus", "o_orderpriority")).alias("size"))
    return docs.unionByName(people).unionByName(orders)


_MAIL = """(SELECT *, row_number() OVER (ORDER BY kind_no, ord) AS r, sum(size) OVER (ORDER BY kind_no, ord) AS upto FROM (SELECT 1 AS kind_no, doc_id AS ord, coalesce(octet_length(encode(text)), 0) AS size FROM documents
UNION ALL SELECT 2, c_custkey, octet_length(encode(c_name || c_mktsegment)) FROM customer UNION ALL SELECT 3, o_orderkey, octet_length(encode(o_orderstatus || o_orderpriority)) FROM orders))"""


@query(f"""WITH RECURSIVE m AS {_MAIL}, s AS (SELECT 1::BIGINT AS page, 0::HUGEINT AS sent UNION ALL SELECT page + 1, (SELECT max(upto) FROM m WHERE upto <= sent + 262144) FROM s WHERE (SELECT max(upto) FROM m) > sent + 262144)
SELECT kind_no, ord, page FROM m ASOF JOIN s ON m.upto > s.sent""")
def export_byte_pages(spark, d):
    """Every record's message of at most 256 KiB."""
    return messages.byte_pages(_mail(spark, d), ["kind_no", "ord"], F.col("size"), 1 << 18).select("kind_no", "ord", "page")


@query("""SELECT doc_id, CAST(sum(cost) OVER (ORDER BY doc_id) AS BIGINT) AS total, sum(cost) OVER (ORDER BY doc_id) <= (SELECT sum(cost) / 3 FROM t) AS admitted FROM t""".replace(" FROM t", " FROM (SELECT doc_id, CAST(ceil((length(coalesce(text, '')) + 3 * length(regexp_replace(coalesce(text, ''), '[\\x00-\\x7F]', '', 'g'))) / 4.0) AS BIGINT) AS cost FROM documents) t"))
def extract_budget(spark, d):
    """Documents that fit in a third of all tokens, in order of their ids, with the running sum."""
    docs = table(spark, d, "documents").select("doc_id", token_estimate(F.coalesce("text", F.lit(""))).alias("cost"))
    third = docs.agg((F.sum("cost") / 3).cast("long").alias("n")).first()["n"]
    return budget.running_total(budget.admit(docs, third, ["doc_id"], F.col("cost")), ["doc_id"], F.col("cost")).select("doc_id", "total", "admitted")


@query("""WITH q AS (SELECT embedding e FROM embeddings WHERE vec_id = 7), s AS (SELECT vec_id AS idx, list_cosine_similarity(embedding::DOUBLE[], (SELECT e FROM q)::DOUBLE[]) c FROM embeddings)
SELECT idx, round(1 - c, 6) AS distance FROM s ORDER BY c DESC, idx LIMIT 10""")
def recall_search_lists(spark, d):
    """The ten nearest by an inverted file of 16 lists, read until no other list can hold a nearer one."""
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("idx"), F.col("embedding").alias("values"))
    index = lists.VectorLists.build(rows, folder(spark, "lists"), lists=16)
    return index.search(list(rows.filter("idx = 7").first()["values"]), 10).withColumn("distance", F.round("distance", 6))


@query("SELECT 'order:' || o_orderkey AS from_id, 'customer:' || o_custkey AS to_id FROM orders WHERE 'customer:' || o_custkey = 'customer:7' UNION ALL SELECT 'customer:' || c_custkey, c_name FROM customer WHERE 'customer:' || c_custkey >= 'customer:9'")
def sink_round_trip(spark, d):
    """A graph through a sink of bounded batches; two questions are answered by conditions that its files answer first."""
    store = sink.FilesSink(spark, folder(spark, "sink"))
    parts = {"entities": _ordered(all_entities(spark, d, ("customer",))), "relations": all_relations(spark, d, ("orders",))}
    sink.load_graph(store, "job", parts)
    edges = store.read("relations", "job", ("to_id", "==", "customer:7")).select("from_id", "to_id")
    return edges.unionByName(store.read("entities", "job", ("id", ">=", "customer:9")).select(F.col("id").alias("from_id"), F.col("name").alias("to_id")))


@query("""WITH w AS (SELECT user_id AS job, 'user ' || event_id % 3 AS watcher FROM events WHERE event_type = 'view' GROUP BY ALL),
p AS (SELECT user_id AS job, max(event_id) AS seq, arg_max(event_type, event_id) AS stage, CAST(max(floor(value)) AS BIGINT) AS calls FROM events WHERE event_type NOT IN ('purchase', 'view') GROUP BY user_id)
SELECT job::VARCHAR AS job_id, watcher, 'progress' AS kind, seq, stage, calls, NULL AS payload FROM w JOIN p USING (job) UNION ALL SELECT w.job::VARCHAR, watcher, 'conflict', event_id, NULL, NULL, props FROM w JOIN events e ON e.user_id = w.job AND event_type = 'purchase'""")
def job_deliveries(spark, d):
    """What everyone who watches a job has seen at its end."""
    kind = F.when(F.col("event_type") == "purchase", "conflict").when(F.col("event_type") == "view", "watch").otherwise("progress")
    rows = table(spark, d, "events").select(F.col("user_id").alias("job_id"), kind.alias("kind"), F.col("event_id").alias("seq"), F.concat(F.lit("user "), F.col("event_id") % 3).alias("watcher"), F.col("event_type").alias("stage"), F.floor("value").alias("calls"), F.lit(None).cast("string").alias("counts"), F.col("props").alias("payload"))
    return hub.delivered(rows).select("job_id", "watcher", "kind", "seq", "stage", "calls", "payload")


@query("""SELECT 'entity' AS what, 'customer:' || c_custkey AS id, c_name AS name FROM customer UNION ALL SELECT 'entity', 'nation:' || c_nationkey, c_nationkey::VARCHAR FROM customer GROUP BY c_nationkey
UNION ALL SELECT 'relation', 'customer:' || c_custkey, 'nation:' || c_nationkey FROM customer
UNION ALL SELECT 'entity', 'table:region_' || r_regionkey, 'region_' || r_regionkey FROM region UNION ALL SELECT 'entity', 'n' || n_nationkey, n_name FROM nation UNION ALL SELECT 'relation', 'n' || n_nationkey, 'n' || (n_nationkey + 1) % 25 FROM nation
UNION ALL SELECT 'chunk', CAST(row_number() OVER (ORDER BY item_id::VARCHAR) - 1 AS VARCHAR), trim(text) FROM benchmark WHERE length(text) < 1500""")
def pipeline_files(spark, d):
    """A folder of tables, dumps, graph documents and texts, written from the given tables and imported as one load."""
    root = folder(spark, "files")
    table(spark, d, "customer").select(F.col("c_custkey").alias("customer_id"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation_key")).write.option("header", True).csv(f"{root}/in/customers")
    files = Folder(spark, f"{root}/in")
    for r in table(spark, d, "region").collect():  # five and twenty-five rows at every size
        files.create(f"dumps/{r['r_regionkey']}.sql", f"CREATE TABLE region_{r['r_regionkey']} (id INT PRIMARY KEY, name TEXT);")
    for n in table(spark, d, "nation").collect():
        near = f"n{(n['n_nationkey'] + 1) % 25}"
        files.create(f"graphs/{n['n_nationkey']}.json", json.dumps({"nodes": [{"id": f"n{n['n_nationkey']}", "type": "Nation", "name": n["n_name"]}], "edges": [{"source": f"n{n['n_nationkey']}", "target": near, "type": "NEXT_TO"}]}))
    texts = table(spark, d, "benchmark").filter("length(text) < 1500").select(F.concat(F.lit("item "), "item_id").alias("item"), "text")
    texts.repartition("item").write.partitionBy("item").text(f"{root}/in/texts")
    store = load.Store(spark, f"{root}/store")
    import_folder(spark, store, "all", f"{root}/in/customers", f"{root}/in/dumps", f"{root}/in/graphs", f"{root}/in/texts/*", targets=["Nation"])
    nodes = store.read("entities", "all").select(F.lit("entity").alias("what"), "id", "name")
    edges = store.read("relations", "all").select(F.lit("relation").alias("what"), F.col("from_id").alias("id"), F.col("to_id").alias("name"))
    return nodes.unionByName(edges).unionByName(store.read("chunks", "all").select(F.lit("chunk").alias("what"), F.col("idx").cast("string").alias("id"), F.trim(F.regexp_replace("text", "\n+$", "")).alias("name")))


@query("""SELECT 'cardinality' AS kind, 'customer:' || a.c_custkey || ' LOCATED_IN out' AS subject, 'nation:' || a.c_nationkey AS left_value, 'nation:' || b.c_nationkey AS right_value
FROM customer a JOIN customer b ON b.c_custkey = a.c_custkey + 1 WHERE b.c_custkey % 10 = 2 AND a.c_nationkey <> b.c_nationkey""")
def recheck_after_merges(spark, d):
    """Conflicts that merging each tenth customer into the one before it makes: somebody is then in two nations."""
    rules = spark.createDataFrame([("LOCATED_IN", [], [], False, False, True)], "name string, from_types array<string>, to_types array<string>, both_ways boolean, at_most_one_in boolean, at_most_one_out boolean")
    vocabulary = check.Vocabulary(spark.createDataFrame([], "name string, attributes array<string>"), rules, "business")
    kept = recheck.Checked(spark, folder(spark, "checked"), vocabulary)
    kept.start(all_entities(spark, d).withColumn("ord", F.col("id")), all_relations(spark, d).withColumns({"attributes": F.lit("{}"), "ord": F.concat_ws(" ", "from_id", "to_id")}))
    merges = table(spark, d, "customer").filter("c_custkey % 10 = 2").select(F.concat(F.lit("customer:"), "c_custkey").alias("id"), F.concat(F.lit("customer:"), F.col("c_custkey") - 1).alias("into"))
    named = merges.select("id").unionByName(merges.select(F.col("into").alias("id")))
    done = kept.recheck(named, lambda nodes, edges: review.merge_into(nodes, edges, merges))
    return done.opened.select("kind", "subject", "left_value", "right_value")


@query("""SELECT doc_id FROM (SELECT doc_id, sum(octet_length(encode(coalesce(text, '')))) OVER (ORDER BY doc_id % 97 DESC, lpad(doc_id::VARCHAR, 12, '0')) AS n, sum(octet_length(encode(coalesce(text, '')))) OVER () AS total FROM documents) WHERE n > total // 3""")
def cache_evicted(spark, d):
    """Of answers as long as the documents, used at few moments, those that go when a third of all bytes is kept."""
    rows = table(spark, d, "documents").select("doc_id", F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("address"), (F.col("doc_id") % 97).alias("used_at"), F.octet_length("text").alias("bytes"))
    most = rows.agg(F.sum("bytes")).first()[0] or 0
    return rows.join(answers.fitting(rows, most // 3).select("doc_id"), "doc_id", "left_anti").select("doc_id")
