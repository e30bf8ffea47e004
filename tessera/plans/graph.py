"""The graph of the business tables, and the registered queries over it with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import fold_key, identity, token_estimate
from tessera.operators import load, merge, recall, review, verify
from tessera.sources.html import html_text
from tessera.sources.tabular import Mapping, RelationColumn, checked_rows, entities, provenance, referenced, relations

CUSTOMER = Mapping("Customer", "c_custkey", "c_name", {"c_mktsegment": "segment"}, (RelationColumn("c_nationkey", "LOCATED_IN", "Nation"),))
SUPPLIER = Mapping("Supplier", "s_suppkey", "s_name", {}, (RelationColumn("s_nationkey", "LOCATED_IN", "Nation"),))
NATION = Mapping("Nation", "n_nationkey", "n_name", {}, (RelationColumn("n_regionkey", "PART_OF", "Region"),))
ORDER = Mapping("Order", "o_orderkey", None, {"o_orderstatus": "status"}, (RelationColumn("o_custkey", "PLACED_BY", "Customer"),))
SOURCES = {"customer": CUSTOMER, "supplier": SUPPLIER, "nation": NATION, "orders": ORDER}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def all_entities(spark: SparkSession, sf_dir: str, names=tuple(SOURCES)) -> DataFrame:
    out = None
    for n in names:
        one = entities(table(spark, sf_dir, n), SOURCES[n], n)
        out = one if out is None else out.unionByName(one)
    return out


def all_relations(spark: SparkSession, sf_dir: str, names=tuple(SOURCES)) -> DataFrame:
    out = None
    for n in names:
        one = relations(table(spark, sf_dir, n), SOURCES[n], n)
        out = one if out is None else out.unionByName(one)
    return out


Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_ENT = """(SELECT 'customer:' || c_custkey id, 'Customer' AS type, c_name AS name, 'customer' source FROM customer
UNION ALL SELECT 'supplier:' || s_suppkey, 'Supplier', s_name, 'supplier' FROM supplier
UNION ALL SELECT 'nation:' || n_nationkey, 'Nation', n_name, 'nation' FROM nation
UNION ALL SELECT 'order:' || o_orderkey, 'Order', CAST(o_orderkey AS VARCHAR), 'orders' FROM orders)"""
_REL = """(SELECT 'customer:' || c_custkey from_id, 'LOCATED_IN' AS type, 'nation:' || c_nationkey to_id, 'customer' source FROM customer
UNION ALL SELECT 'supplier:' || s_suppkey, 'LOCATED_IN', 'nation:' || s_nationkey, 'supplier' FROM supplier
UNION ALL SELECT 'nation:' || n_nationkey, 'PART_OF', 'region:' || n_regionkey, 'nation' FROM nation
UNION ALL SELECT 'order:' || o_orderkey, 'PLACED_BY', 'customer:' || o_custkey, 'orders' FROM orders)"""


@query(f"SELECT id, type, name, source FROM {_ENT}")
def tabular_entities(spark, d):
    return all_entities(spark, d).select("id", "type", "name", F.col("prov.source").alias("source"))


@query(f"SELECT from_id, type, to_id, source FROM {_REL}")
def tabular_relations(spark, d):
    return all_relations(spark, d).select("from_id", "type", "to_id", F.col("prov.source").alias("source"))


@query("SELECT DISTINCT 'region:' || n_regionkey AS id, 'Region' AS type, CAST(n_regionkey AS VARCHAR) AS name FROM nation")
def tabular_referenced(spark, d):
    edges = relations(table(spark, d, "nation"), NATION, "nation")
    return referenced(edges, all_entities(spark, d, ("nation",)), "nation").select("id", "type", "name")


_LINE = "SELECT l_orderkey || '-' || l_linenumber AS line, l_partkey, l_suppkey, l_quantity FROM lineitem"


@query(f"""WITH l AS ({_LINE}), r AS (SELECT *, row_number() OVER (PARTITION BY line ORDER BY l_partkey, l_suppkey, l_quantity) n, first_value(l_partkey) OVER (PARTITION BY line ORDER BY l_partkey, l_suppkey, l_quantity) f FROM l)
SELECT 'line:' || line AS subject, count(*) AS n FROM r WHERE n > 1 AND l_partkey <> f GROUP BY 1""")
def tabular_duplicate_ids(spark, d):
    rows = table(spark, d, "lineitem").select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("line"), "l_partkey", "l_suppkey", "l_quantity")
    read = checked_rows(rows, Mapping("Line", "line", None, {"l_partkey": "part"}), ["l_partkey", "l_suppkey", "l_quantity"])
    return read.violations.groupBy("subject").agg(F.count("*").alias("n"))


@query(f"SELECT type, count(*) AS n FROM {_ENT} GROUP BY type")
def recall_types(spark, d):
    return recall.types(all_entities(spark, d))


@query(f"SELECT id, type, name, (SELECT count(*) FROM {_ENT} WHERE contains(lower(name), 'customer#00000012')) AS total FROM {_ENT} WHERE contains(lower(name), 'customer#00000012') ORDER BY name, id LIMIT 25")
def recall_find(spark, d):
    return recall.find(all_entities(spark, d), "CUSTOMER#00000012", 25)


@query(f"SELECT id, type, name, (SELECT count(*) FROM {_ENT} WHERE type = 'Nation') AS total FROM {_ENT} WHERE type = 'Nation' ORDER BY name, id LIMIT 10")
def recall_of_type(spark, d):
    return recall.of_type(all_entities(spark, d), "Nation", 10)


@query("SELECT 'customer:42' AS id, 'Customer' AS type, c_name AS name, '{\"segment\":\"' || c_mktsegment || '\"}' AS attributes, 'customer' AS source FROM customer WHERE c_custkey = 42")
def recall_describe(spark, d):
    return recall.describe(all_entities(spark, d), "customer:42").select("id", "type", "name", "attributes", F.col("prov.source").alias("source"))


@query(f"""WITH e AS (SELECT * FROM {_ENT}) SELECT DISTINCT coalesce(a.name, from_id) AS subject, r.type, coalesce(b.name, to_id) AS object, from_id, to_id, r.source
FROM {_REL} r LEFT JOIN e a ON a.id = from_id LEFT JOIN e b ON b.id = to_id WHERE from_id = 'customer:42' OR to_id = 'customer:42'""")
def recall_claims(spark, d):
    return recall.claims(all_entities(spark, d), all_relations(spark, d), "customer:42").select("subject", "type", "object", "from_id", "to_id", "source")


@query(f"""SELECT source, CAST(-1 AS INTEGER) AS chunk, 'tabular' AS producer, max(name) AS name FROM (SELECT source, name FROM {_ENT} WHERE id = 'nation:7'
UNION ALL SELECT source, NULL FROM {_REL} WHERE from_id = 'nation:7' OR to_id = 'nation:7') GROUP BY source""")
def recall_contributions(spark, d):
    return recall.contributions(all_entities(spark, d), all_relations(spark, d), "nation:7")


@query(f"""WITH r AS (SELECT from_id a, to_id b FROM {_REL} UNION SELECT to_id, from_id FROM {_REL}), h1 AS (SELECT DISTINCT b id FROM r WHERE a = 'region:1'),
h2 AS (SELECT DISTINCT b id FROM r JOIN h1 ON a = h1.id WHERE b <> 'region:1' AND b NOT IN (SELECT id FROM h1))
SELECT 'region:1' AS id, 0 AS hop UNION ALL SELECT id, 1 FROM h1 UNION ALL SELECT id, 2 FROM h2""")
def recall_around(spark, d):
    return recall.around(spark.createDataFrame([("region:1",)], "id string"), all_relations(spark, d), 2)


@query(f"SELECT id, type FROM {_ENT} WHERE source IN ('nation', 'supplier') AND type = 'Supplier'")
def recall_record_filter(spark, d):
    return recall.record_filter(all_entities(spark, d), source=["nation", "supplier"], type="Supplier").select("id", "type")


@query(f"""WITH n AS (SELECT * FROM {_ENT} WHERE source IN ('nation', 'supplier') ORDER BY id LIMIT 60) SELECT from_id, type, to_id FROM {_REL} WHERE from_id IN (SELECT id FROM n) AND to_id IN (SELECT id FROM n) ORDER BY from_id, type, to_id LIMIT 3000""")
def recall_drawable(spark, d):
    return recall.drawable(all_entities(spark, d, ("nation", "supplier")), all_relations(spark, d), 60, 3000)[1].select("from_id", "type", "to_id")


@query("""WITH q AS (SELECT embedding e FROM embeddings WHERE vec_id = 7), s AS (SELECT vec_id AS idx, list_cosine_similarity(embedding::DOUBLE[], (SELECT e FROM q)::DOUBLE[]) c FROM embeddings)
SELECT idx, round(1 - c, 6) AS distance FROM s ORDER BY c DESC, idx LIMIT 10""")
def recall_vector_search(spark, d):
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("idx"), F.col("embedding").alias("values"))
    q = rows.filter("idx = 7").first()["values"]
    return recall.vector_search(rows, list(q), 10).withColumn("distance", F.round("distance", 6))


_VOCAB = [("customer", ["segment"]), ("Nation", []), ("SUPPLIER", [])]


def _vocabulary(spark):
    return spark.createDataFrame(_VOCAB, "name string, attributes array<string>")


@query("SELECT 'unknown_entity_type' AS kind, 'order:' || o_orderkey AS subject, 'Order' AS type FROM orders")
def verify_unknown_type(spark, d):
    return verify.unknown_types(all_entities(spark, d), _vocabulary(spark), "unknown_entity_type", "id")


@query(f"SELECT CASE type WHEN 'Customer' THEN 'customer' WHEN 'Supplier' THEN 'SUPPLIER' ELSE type END AS type, count(*) AS n FROM {_ENT} GROUP BY 1")
def verify_canonical(spark, d):
    return verify.canonical(all_entities(spark, d), _vocabulary(spark)).groupBy("type").agg(F.count("*").alias("n"))


@query("SELECT 'unknown_attribute' AS kind, 'customer:' || c_custkey AS subject, 'Customer' AS type, 'segment' AS attr FROM customer")
def verify_unknown_attribute(spark, d):
    return verify.unknown_attributes(all_entities(spark, d), spark.createDataFrame([("customer", ["tier"])], "name string, attributes array<string>"))


@query("SELECT 'dangling_relation' AS kind, 'nation:' || n_nationkey AS from_id, 'PART_OF' AS type, 'region:' || n_regionkey AS to_id FROM nation")
def verify_dangling(spark, d):
    e = all_entities(spark, d).withColumn("ord", F.lit(0))
    return verify.dangling(verify.with_ends(all_relations(spark, d), e))


@query("SELECT 'relation_not_allowed' AS kind, 'supplier:' || s_suppkey AS from_id, 'LOCATED_IN' AS type, 'nation:' || s_nationkey AS to_id FROM supplier")
def verify_not_allowed(spark, d):
    e = all_entities(spark, d).withColumn("ord", F.lit(0))
    v = spark.createDataFrame([("located_in", ["Customer"], [], False), ("PLACED_BY", ["Customer"], ["Order"], True)], "name string, from_types array<string>, to_types array<string>, both_ways boolean")
    return verify.not_allowed(verify.with_ends(all_relations(spark, d), e), v, spark.createDataFrame([("Customer",), ("Nation",), ("Order",), ("Supplier",)], "name string"))


_EV = "SELECT user_id, event_type, min(event_id) AS ord FROM events GROUP BY user_id, event_type"


@query(f"""WITH e AS ({_EV}), w AS (SELECT *, first_value(event_type) OVER (PARTITION BY user_id ORDER BY ord) AS f, row_number() OVER (PARTITION BY user_id ORDER BY ord) AS n FROM e)
SELECT 'entity_attributes' AS kind, 'user:' || user_id AS id, 'kind' AS attr, f AS left_value, event_type AS right_value, ord FROM w WHERE n > 1""")
def verify_attribute_conflicts(spark, d):
    e = table(spark, d, "events").select(F.concat(F.lit("user:"), "user_id").alias("id"), F.lit("").alias("name"), F.to_json(F.struct(F.col("event_type").alias("kind"))).alias("attributes"), F.col("event_id").alias("ord"))
    return verify.value_conflicts(verify.attribute_claims(e), ["id", "attr"], "entity_attributes")


_MUTUAL = """SELECT o_custkey % 50 AS a, o_orderkey % 50 AS b, o_orderkey AS ord, CASE WHEN o_orderstatus = 'F' THEN 'ddl' ELSE 'tabular' END AS p FROM orders"""


@query(f"""WITH m AS ({_MUTUAL}), g AS (SELECT least(a, b) lo, greatest(a, b) hi, min(ord) FILTER (a < b AND p = 'ddl') us, min(ord) FILTER (a < b AND p <> 'ddl') ui,
min(ord) FILTER (a > b AND p = 'ddl') ds, min(ord) FILTER (a > b AND p <> 'ddl') di FROM m WHERE a <> b GROUP BY 1, 2),
c AS (SELECT lo, hi, 'relation_direction' AS kind, least(CASE WHEN us IS NOT NULL AND ds IS NOT NULL THEN greatest(us, ds) END, CASE WHEN ui IS NOT NULL AND di IS NOT NULL THEN greatest(ui, di) END) AS ord FROM g
UNION ALL SELECT lo, hi, 'contradiction', least(CASE WHEN us IS NOT NULL AND di IS NOT NULL THEN greatest(us, di) END, CASE WHEN ui IS NOT NULL AND ds IS NOT NULL THEN greatest(ui, ds) END) FROM g)
SELECT kind, lpad(lo::VARCHAR, 3, '0') AS low, lpad(hi::VARCHAR, 3, '0') AS high, ord FROM c WHERE ord IS NOT NULL""")
def verify_direction_conflicts(spark, d):
    side = lambda c: F.lpad((F.col(c) % 50).cast("string"), 3, "0")
    producer = F.when(F.col("o_orderstatus") == "F", "ddl").otherwise("tabular")
    r = table(spark, d, "orders").select(side("o_custkey").alias("from_id"), F.lit("LINKS").alias("type"), side("o_orderkey").alias("to_id"), F.lit("").alias("key"), F.struct(producer.alias("producer")).alias("prov"), F.col("o_orderkey").alias("ord"))
    return verify.direction_conflicts(r).select("kind", "low", "high", "ord")


@query("""WITH e AS (SELECT l_partkey AS node, l_suppkey AS v, min(l_orderkey * 10 + l_linenumber) AS ord FROM lineitem GROUP BY 1, 2),
w AS (SELECT *, first_value(v) OVER (PARTITION BY node ORDER BY ord, v::VARCHAR) f, row_number() OVER (PARTITION BY node ORDER BY ord, v::VARCHAR) n FROM e)
SELECT 'cardinality' AS kind, node::VARCHAR AS node, 'SUPPLIED_BY' AS type, 'out' AS side, f::VARCHAR AS left_value, v::VARCHAR AS right_value FROM w WHERE n > 1""")
def verify_cardinality(spark, d):
    r = table(spark, d, "lineitem").select(F.col("l_partkey").cast("string").alias("from_id"), F.lit("SUPPLIED_BY").alias("type"), F.col("l_suppkey").cast("string").alias("to_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"))
    return verify.cardinality_conflicts(r, [], ["SUPPLIED_BY"]).drop("ord")


_PART = "SELECT p_partkey, lower(trim(p_name)) AS n, CASE WHEN p_size % 2 = 0 THEN 'ddl' ELSE 'tabular' END AS p FROM part"


@query(f"""WITH p AS ({_PART}), h AS (SELECT n, arg_min(p_partkey, p_partkey) AS k, arg_min(p, p_partkey) AS hp FROM p GROUP BY n)
SELECT DISTINCT h.k AS left_id, p.p_partkey AS right_id, 'name_across_producers' AS signal FROM p JOIN h USING (n) WHERE p.p_partkey <> h.k AND p.p <> h.hp""")
def verify_same_name(spark, d):
    return verify.same_name_duplicates(_parts(spark, d))


def _short_names(spark, d):
    name = F.when(F.col("id") % 3 == 0, F.substring_index("name", " ", 1)).otherwise(F.col("name"))
    return _parts(spark, d).withColumn("name", name)


def _parts(spark, d):
    producer = F.when(F.col("p_size") % 2 == 0, "ddl").otherwise("tabular")
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.lit("Part").alias("type"), F.col("p_name").alias("name"), F.struct(producer.alias("producer")).alias("prov"), F.col("p_partkey").alias("ord"))


@query("""WITH x AS (SELECT lower(trim(CASE WHEN p_partkey % 3 = 0 THEN split_part(p_name, ' ', 1) ELSE p_name END)) AS n, p_partkey AS k FROM part), p AS (SELECT n, min(k) AS k FROM x GROUP BY 1), w AS (SELECT n, k, string_split(n, ' ') AS s FROM x),
a AS (SELECT k, array_to_string(s[1:i], ' ') AS x FROM w, range(1, len(s)) t(i) UNION SELECT k, array_to_string(s[len(s) - i + 1:], ' ') FROM w, range(1, len(s)) t(i))
SELECT DISTINCT p.k AS left_id, a.k AS right_id, 'name_affix' AS signal FROM a JOIN p ON p.n = a.x WHERE p.k <> a.k""")
def verify_affix(spark, d):
    return verify.affix_duplicates(_short_names(spark, d))


@query("SELECT 'unknown_entity_type' AS kind, 'Order' AS type, count(*) AS records, min('order:' || o_orderkey) AS example FROM orders")
def verify_proposals(spark, d):
    return verify.type_proposals(verify_unknown_type(spark, d))


@query(f"SELECT (SELECT count(*) FROM {_ENT}) AS entities, (SELECT count(*) FROM {_REL}) AS relations, CAST(0 AS BIGINT) AS deterministic, (SELECT count(*) FROM {_REL}) AS inferred")
def verify_counts(spark, d):
    return verify.counts(all_entities(spark, d), all_relations(spark, d))


@query("""WITH e AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) n FROM events), f AS (SELECT user_id, max(event_type) FILTER (n = 1) a, max(event_type) FILTER (n = 2) b FROM e GROUP BY 1)
SELECT CASE WHEN a = b THEN 'entity_corroborated' ELSE 'entity_id_reused' END AS kind, CAST(user_id AS VARCHAR) AS id, CASE WHEN a = b THEN 'report' ELSE 'refuse' END AS severity FROM f WHERE b IS NOT NULL""")
def preflight_entities(spark, d):
    return load.entity_defects(table(spark, d, "events").select(F.col("user_id").alias("id"), F.lit("User").alias("type"), F.col("event_type").alias("name"), F.col("event_id").alias("ord")))


@query("SELECT 'chunk_index_reused' AS kind, l_orderkey AS idx FROM lineitem GROUP BY l_orderkey HAVING count(*) > 1")
def preflight_chunks(spark, d):
    return load.chunk_defects(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("idx")))


@query("SELECT 'vector_without_chunk' AS kind, vec_id AS chunk FROM embeddings WHERE vec_id NOT IN (SELECT item_id FROM benchmark)")
def preflight_vectors(spark, d):
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk"), F.col("embedding").alias("values"))
    return load.vector_defects(v, table(spark, d, "benchmark").select(F.col("item_id").alias("idx")))


@query("SELECT user_id AS id, arg_min(event_type, event_id) AS name, count(*) - 1 AS others FROM events GROUP BY user_id")
def sink_corroborated(spark, d):
    return load.corroborated(table(spark, d, "events").select(F.col("user_id").alias("id"), F.col("event_type").alias("name"), F.col("event_id").alias("ord"))).select("id", "name", "others")


@query("SELECT item_id AS idx, embedding IS NOT NULL AS has_vector FROM benchmark LEFT JOIN embeddings ON vec_id = item_id")
def sink_paired(spark, d):
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk"), F.col("embedding").alias("values"), F.lit(0).alias("ord"))
    return load.paired(table(spark, d, "benchmark").select(F.col("item_id").alias("idx")), v).select("idx", F.col("values").isNotNull().alias("has_vector"))


def _framed_sql(x: str) -> str:
    return f"unhex(printf('%016x', octet_length(encode({x})))) || encode({x})"


@query("SELECT 'nation:' || n_nationkey AS from_id, sha256(" + " || ".join(map(_framed_sql, ("'relation'", "'nation:' || n_nationkey", "'PART_OF'", "'region:' || n_regionkey", "''"))) + ") AS name FROM nation")
def relation_identity(spark, d):
    r = all_relations(spark, d, ("nation",))
    return r.select("from_id", identity(F.col("from_id"), F.col("type"), F.col("to_id"), F.col("key")).alias("name"))


@query(f"SELECT grade, count(*) AS n FROM (SELECT CASE WHEN source = 'nation' THEN 'refused' ELSE 'self_consistent' END AS grade FROM {_REL}) GROUP BY grade")
def trust_grades(spark, d):
    return recall.weakest(recall.trust(all_relations(spark, d), verify_dangling(spark, d))).groupBy("grade").agg(F.count("*").alias("n"))


@query("SELECT doc_id, CAST(ceil((length(text) + 3 * length(regexp_replace(text, '[\\x00-\\x7F]', '', 'g'))) / 4.0) AS BIGINT) AS tokens FROM documents")
def token_estimates(spark, d):
    return table(spark, d, "documents").select("doc_id", token_estimate(F.col("text")).alias("tokens"))


@query("SELECT page_id, lower(trim(regexp_replace(url, '\\s+', ' ', 'g'))) AS folded FROM pages")
def folded_names(spark, d):
    return table(spark, d, "pages").select("page_id", fold_key(F.col("url")).alias("folded"))


_TOUCH = f"(SELECT id, source, 0 AS ends FROM {_ENT} UNION ALL SELECT from_id, source, 1 FROM {_REL} UNION ALL SELECT to_id, source, 1 FROM {_REL})"


@query(f"SELECT id, count(DISTINCT source) AS sources, CAST(sum(ends) AS BIGINT) AS degree FROM {_TOUCH} GROUP BY id")
def review_footprint(spark, d):
    return review.footprint(all_entities(spark, d), all_relations(spark, d))


def _orders_as_customers(spark, d):
    """Every order is one more record of its customer: many records an id, in the order of their keys."""
    cells = F.to_json(F.struct(F.col("o_orderpriority").alias("priority"), F.col("o_orderstatus").alias("status")))
    named = F.concat(F.lit("customer:"), "o_custkey")
    return table(spark, d, "orders").select(named.alias("id"), F.lit("Customer").alias("type"), F.concat(F.lit("Order "), "o_orderkey").alias("name"), cells.alias("attributes"), provenance("orders").alias("prov"), F.col("o_orderkey").alias("ord"))


@query("""SELECT 'customer:' || o_custkey AS id, 'Customer' AS type, 'Order ' || min(o_orderkey) AS name,
'{"priority":"' || arg_min(o_orderpriority, o_orderkey) || '","status":"' || arg_min(o_orderstatus, o_orderkey) || '"}' AS attributes FROM orders GROUP BY o_custkey""")
def merge_entities(spark, d):
    return merge.merge_entities(_orders_as_customers(spark, d))[0].select("id", "type", "name", "attributes")


@query("""WITH v AS (SELECT o_custkey, o_orderkey, 'priority' AS attr, o_orderpriority AS value FROM orders UNION ALL SELECT o_custkey, o_orderkey, 'status', o_orderstatus FROM orders),
f AS (SELECT o_custkey, attr, arg_min(value, o_orderkey) AS kept FROM v GROUP BY ALL)
SELECT DISTINCT 'customer:' || o_custkey AS subject, attr, '"' || kept || '"' AS kept_value, '"' || value || '"' AS other_value FROM v JOIN f USING (o_custkey, attr) WHERE value <> kept""")
def merge_conflicts(spark, d):
    return merge.merge_entities(_orders_as_customers(spark, d))[1].select("subject", "attr", F.col("left").alias("kept_value"), F.col("right").alias("other_value"))


@query("""SELECT DISTINCT 'order:' || l_orderkey AS from_id, 'SUPPLIED_BY' AS type, 'supplier:' || l_suppkey AS to_id,
'{"returnflag":"' || first_value(l_returnflag) OVER (PARTITION BY l_orderkey, l_suppkey ORDER BY l_linenumber, l_partkey, l_returnflag) || '"}' AS attributes FROM lineitem""")
def merge_relations(spark, d):
    order = F.struct("l_linenumber", "l_partkey", "l_returnflag")
    ends = (F.concat(F.lit("order:"), "l_orderkey").alias("from_id"), F.lit("SUPPLIED_BY").alias("type"), F.concat(F.lit("supplier:"), "l_suppkey").alias("to_id"))
    cells = F.to_json(F.struct(F.col("l_returnflag").alias("returnflag")))
    rows = table(spark, d, "lineitem").select(*ends, F.lit("").alias("key"), cells.alias("attributes"), provenance("lineitem").alias("prov"), order.alias("ord"))
    return merge.merge_relations(rows).select("from_id", "type", "to_id", "attributes")


@query("SELECT 'event:' || event_id AS subject, CAST((event_id % 100) AS DOUBLE) / 100 AS confidence FROM events WHERE event_id % 100 BETWEEN 1 AND 49")
def review_low_confidence(spark, d):
    sure = (F.col("event_id") % 100).cast("double") / 100
    prov = F.struct(F.lit("events").alias("source"), F.lit("model").alias("producer"), sure.alias("confidence"))
    return review.low_confidence(table(spark, d, "events").select(F.concat(F.lit("event:"), "event_id").alias("id"), prov.alias("prov")), 0.5).select("subject", "confidence")


@query(f"SELECT from_id, type, to_id FROM {_REL} WHERE from_id NOT IN (SELECT 'supplier:' || s_suppkey FROM supplier WHERE s_nationkey < 5) AND 'nation:7' NOT IN (from_id, to_id)")
def review_reject(spark, d):
    gone = table(spark, d, "supplier").filter("s_nationkey < 5").select(F.concat(F.lit("supplier:"), "s_suppkey").alias("id"))
    gone = gone.unionByName(table(spark, d, "nation").filter("n_nationkey = 7").select(F.concat(F.lit("nation:"), "n_nationkey").alias("id")))
    return review.reject(all_entities(spark, d), all_relations(spark, d), gone)[1].select("from_id", "type", "to_id")


@query(f"""WITH m AS (SELECT 'customer:' || c_custkey AS id, 'customer:' || (c_custkey - c_custkey % 8) AS survivor FROM customer WHERE c_custkey % 8 <> 0 AND c_custkey > 8)
SELECT DISTINCT coalesce(a.survivor, from_id) AS from_id, type, coalesce(b.survivor, to_id) AS to_id FROM {_REL} LEFT JOIN m a ON a.id = from_id LEFT JOIN m b ON b.id = to_id""")
def review_merge_into(spark, d):
    """Chains of up to seven customers become one."""
    key = F.col("c_custkey")
    merges = table(spark, d, "customer").filter((key % 8 != 0) & (key > 8)).select(F.concat(F.lit("customer:"), key).alias("id"), F.concat(F.lit("customer:"), key - 1).alias("into"))
    nodes = all_entities(spark, d).withColumn("ord", F.struct("id", "name"))
    edges = all_relations(spark, d).withColumn("ord", F.struct("from_id", "to_id"))
    return review.merge_into(nodes, edges, merges)[1].select("from_id", "type", "to_id")


@query()
def html_texts(spark, d):
    """SQL cannot express it; tests compare it with texts worked out by hand."""
    return html_text(table(spark, d, "pages"), "page_id", "html")
