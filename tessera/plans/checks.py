"""Registered queries of the check stage, preflight, review decisions and reading, with their SQL twins.

Orders make a graph that disagrees with itself: many orders are records of one customer, and several say different things
of one edge.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import apply, check, load, preflight, recall, review, verify
from tessera.plans.graph import _ENT, _REL, all_entities, all_relations, query, table
from tessera.sources.tabular import provenance

_PRODUCER = "CASE WHEN o_orderkey % 3 = 0 THEN 'ddl' ELSE 'model' END"
_TYPE = "CASE WHEN o_orderkey % 11 = 0 THEN 'Asks' WHEN o_custkey % 4 = 0 THEN 'MEETS' ELSE 'ASKS' END"
_EDGES = f"""(SELECT 'c:' || lpad((o_custkey % 100)::VARCHAR, 3, '0') AS low, 'p:' || o_orderpriority AS high, {_TYPE} AS type, o_orderkey % 5 <> 0 AS up, {_PRODUCER} AS producer, o_orderkey AS ord,
CASE WHEN o_orderkey % 7 = 0 THEN lower(o_orderstatus) ELSE o_orderstatus END AS value FROM orders)"""


def _edges(spark, d):
    """Customers and priorities, related by orders in either direction; the status is an attribute."""
    key = F.col("o_orderkey")
    a, b = F.concat(F.lit("c:"), F.lpad((F.col("o_custkey") % 100).cast("string"), 3, "0")), F.concat(F.lit("p:"), "o_orderpriority")
    kind = F.when(key % 11 == 0, "Asks").when(F.col("o_custkey") % 4 == 0, "MEETS").otherwise("ASKS")
    up, status = key % 5 != 0, F.when(key % 7 == 0, F.lower("o_orderstatus")).otherwise(F.col("o_orderstatus"))
    prov = F.struct(F.lit("orders").alias("source"), F.lit(-1).alias("chunk"), F.when(key % 3 == 0, "ddl").otherwise("model").alias("producer"))
    return table(spark, d, "orders").select(F.when(up, a).otherwise(b).alias("from_id"), kind.alias("type"), F.when(up, b).otherwise(a).alias("to_id"), F.lit("").alias("key"), F.to_json(F.struct(status.alias("status"))).alias("attributes"), prov.alias("prov"), key.alias("ord"))


def _records(spark, d):
    """Every order is a record of its customer, whose type and name it states anew."""
    key = F.col("o_orderkey")
    prov = F.struct(F.lit("orders").alias("source"), F.lit(-1).alias("chunk"), F.when(key % 3 == 0, "ddl").otherwise("model").alias("producer"))
    return table(spark, d, "orders").select(F.concat(F.lit("customer:"), "o_custkey").alias("id"), F.col("o_orderstatus").alias("type"), F.lit("").alias("name"), F.to_json(F.struct(F.col("o_orderpriority").alias("priority"))).alias("attributes"), prov.alias("prov"), key.alias("ord"))


@query("""WITH e AS (SELECT o_custkey, o_orderstatus AS value, min(o_orderkey) AS ord FROM orders GROUP BY 1, 2), w AS (SELECT *, first_value(value) OVER (PARTITION BY o_custkey ORDER BY ord) AS f FROM e)
SELECT 'entity_type' AS kind, 'customer:' || o_custkey AS id, f AS left_value, value AS right_value, ord FROM w WHERE value <> f""")
def check_entity_types(spark, d):
    return check.entity_type_conflicts(_records(spark, d))


_ATTR = f"""WITH v AS (SELECT low, high, type, up, producer = 'ddl' AS sure, lower(value) AS f, min(ord) AS ord, arg_min(value, ord) AS value FROM {_EDGES} GROUP BY ALL),
w AS (SELECT *, first_value(f) OVER g AS ff, first_value(value) OVER g AS fv FROM v WINDOW g AS (PARTITION BY low, high, type, up, sure ORDER BY ord))
SELECT 'relation_attributes' AS kind, low, high, type, up, sure, fv AS left_value, value AS right_value, ord FROM w WHERE f <> ff"""


@query(_ATTR)
def check_relation_attributes(spark, d):
    return check.relation_attribute_conflicts(check.edge_claims(_edges(spark, d))).drop("edge_key", "attr")


_AGAINST = f"""WITH e AS (SELECT *, producer = 'ddl' AS sure FROM {_EDGES}), f AS (SELECT low, high, type, up, min(ord) FILTER (sure) AS so, arg_min(value, ord) FILTER (sure) AS sv, min(ord) FILTER (NOT sure) AS io, arg_min(value, ord) FILTER (NOT sure) AS iv FROM e GROUP BY ALL),
c AS (SELECT e.*, CASE WHEN sure THEN value ELSE sv END AS l, CASE WHEN sure THEN iv ELSE value END AS r, row_number() OVER (PARTITION BY low, high, type, up ORDER BY ord) AS n FROM e JOIN f USING (low, high, type, up)
WHERE CASE WHEN sure THEN io < ord AND iv <> value ELSE so < ord AND sv <> value END)
SELECT 'contradiction' AS kind, low, high, type, up, l AS left_value, r AS right_value, ord FROM c WHERE n = 1"""


@query(_AGAINST)
def check_attribute_contradictions(spark, d):
    return check.relation_attribute_contradictions(check.edge_claims(_edges(spark, d))).drop("edge_key", "attr")


_WAYS = f"""WITH e AS (SELECT *, producer = 'ddl' AS sure FROM {_EDGES} WHERE lower(type) = 'asks'), g AS (SELECT low, high, type, min(ord) FILTER (up AND sure) us, min(ord) FILTER (up AND NOT sure) ui, min(ord) FILTER (NOT up AND sure) ds, min(ord) FILTER (NOT up AND NOT sure) di FROM e GROUP BY ALL),
c AS (SELECT low, high, type, 'relation_direction' AS kind, greatest(us, ds) AS ord, us < ds AS straight FROM g WHERE us IS NOT NULL AND ds IS NOT NULL UNION ALL SELECT low, high, type, 'relation_direction', greatest(ui, di), ui < di FROM g WHERE ui IS NOT NULL AND di IS NOT NULL
UNION ALL SELECT low, high, type, 'contradiction', greatest(us, di), true FROM g WHERE us IS NOT NULL AND di IS NOT NULL UNION ALL SELECT low, high, type, 'contradiction', greatest(ds, ui), false FROM g WHERE ds IS NOT NULL AND ui IS NOT NULL)
SELECT kind, low, high, type, CASE WHEN straight THEN low ELSE high END AS left_from, CASE WHEN straight THEN high ELSE low END AS right_from, ord FROM c QUALIFY row_number() OVER (PARTITION BY low, high, type, kind ORDER BY ord) = 1"""


@query(_WAYS)
def check_directions(spark, d):
    """Only the type that is declared and runs one way is asked about."""
    return verify.direction_conflicts(_edges(spark, d), one_way_types=["asks"]).select("kind", "low", "high", "type", "left_from", "right_from", "ord")


@query("""WITH e AS (SELECT l_suppkey AS node, l_partkey AS v, min((l_orderkey * 10 + l_linenumber) * 100000 + l_partkey) AS ord FROM lineitem GROUP BY 1, 2), w AS (SELECT *, first_value(v) OVER (PARTITION BY node ORDER BY ord) AS f FROM e)
SELECT node::VARCHAR AS node, 'in' AS side, f::VARCHAR AS left_value, v::VARCHAR AS right_value FROM w WHERE v <> f""")
def check_cardinality_in(spark, d):
    ord_ = (F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 100000 + F.col("l_partkey")
    r = table(spark, d, "lineitem").select(F.col("l_partkey").cast("string").alias("from_id"), F.lit("SOLD_BY").alias("type"), F.col("l_suppkey").cast("string").alias("to_id"), ord_.alias("ord"))
    return verify.cardinality_conflicts(r, ["SOLD_BY"], []).select("node", "side", "left_value", "right_value")


@query("""WITH r AS (SELECT least(o_custkey % 40, o_orderkey % 40) AS lo, greatest(o_custkey % 40, o_orderkey % 40) AS hi, o_orderkey, CASE WHEN o_custkey % 3 = 0 AND o_orderstatus <> 'P' THEN o_orderstatus ELSE '' END AS k FROM orders),
m AS (SELECT lo, hi FROM r WHERE k <> '' GROUP BY ALL HAVING count(DISTINCT k) > 1) SELECT o_orderkey AS ord, CASE WHEN m.lo IS NULL THEN '' ELSE k END AS edge_key FROM r LEFT JOIN m USING (lo, hi)""")
def check_parallel_keys(spark, d):
    side = lambda c: F.lpad((F.col(c) % 40).cast("string"), 2, "0")
    named = F.when((F.col("o_custkey") % 3 == 0) & (F.col("o_orderstatus") != "P"), F.col("o_orderstatus")).otherwise(F.lit(""))
    r = table(spark, d, "orders").select(side("o_custkey").alias("from_id"), F.lit("R").alias("type"), side("o_orderkey").alias("to_id"), named.alias("key"), F.col("o_orderkey").alias("ord"))
    return verify.parallel_keys(r).select("ord", "edge_key")


_NAMES = """n AS (SELECT p_partkey AS k, lower(CASE WHEN p_partkey % 3 = 0 THEN split_part(p_name, ' ', 1) ELSE p_name END) AS n, CASE WHEN p_size % 2 = 0 THEN 'ddl' ELSE 'tabular' END AS p, CASE WHEN p_partkey % 7 = 0 THEN lower(split_part(p_name, ' ', 1)) END AS alias FROM part),
h AS (SELECT n, min(k) AS hk, arg_min(p, k) AS hp FROM n GROUP BY n), w AS (SELECT h.n, string_split(h.n, ' ') AS s FROM h),
a AS (SELECT n, len(s) - 1 - i AS place, array_to_string(s[1:i], ' ') AS x FROM w, range(1, len(s)) t(i) UNION ALL SELECT n, 2 * (len(s) - 1) - i, array_to_string(s[len(s) - i + 1:], ' ') FROM w, range(1, len(s)) t(i))"""


def _named_parts(spark, d):
    name = F.when(F.col("p_partkey") % 3 == 0, F.substring_index("p_name", " ", 1)).otherwise(F.col("p_name"))
    alias = F.when(F.col("p_partkey") % 7 == 0, F.array(F.split("p_name", " ")[0])).otherwise(F.array().cast("array<string>"))
    prov = F.struct(F.lit("part").alias("source"), F.when(F.col("p_size") % 2 == 0, "ddl").otherwise("tabular").alias("producer"))
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.lit("Part").alias("type"), name.alias("name"), alias.alias("aliases"), prov.alias("prov"), F.col("p_partkey").alias("ord"))


@query(f"WITH {_NAMES} SELECT DISTINCT h.hk AS right_id, n.k AS left_id FROM n JOIN h ON h.n = n.alias WHERE h.hk <> n.k")
def check_aliases(spark, d):
    return verify.alias_duplicates(_named_parts(spark, d)).select("left_id", "right_id")


_TWINS = f"""WITH {_NAMES}, c AS (SELECT h.hk AS l, n.k AS r, n.k AS ord, 0 AS stage, 0 AS place FROM n JOIN h USING (n) WHERE h.hk <> n.k AND h.hp <> n.p
UNION ALL SELECT h.hk, n.k, n.k, 1, 0 FROM n JOIN h ON h.n = n.alias WHERE h.hk <> n.k
UNION ALL SELECT h.hk, n.k, n.k, 2, a.place FROM n JOIN a USING (n) JOIN h ON h.n = a.x WHERE h.hk <> n.k),
f AS (SELECT *, row_number() OVER (PARTITION BY least(l, r), greatest(l, r) ORDER BY ord, stage, place, l) AS n, first_value(l) OVER (PARTITION BY least(l, r), greatest(l, r) ORDER BY ord, stage, place, l) AS fl FROM c),
o AS (SELECT l, r, ord, stage, place FROM f WHERE n = 1 UNION ALL SELECT l, r, min(ord), 0, 0 FROM f WHERE stage = 0 AND l <> fl GROUP BY l, r)
SELECT CASE stage WHEN 1 THEN 1 WHEN 0 THEN 2 ELSE 3 END AS rank, CASE stage WHEN 1 THEN 'alias' WHEN 0 THEN 'name_across_producers' ELSE 'name_affix' END AS signal, l AS left_id, r AS right_id, ord FROM o"""


@query(_TWINS)
def check_duplicates(spark, d):
    return check.duplicates(_named_parts(spark, d)).select("rank", "signal", "left_id", "right_id", "ord")


def _vocabulary(spark):
    nodes = spark.createDataFrame([("customer", ["tier"]), ("Nation", []), ("SUPPLIER", [])], "name string, attributes array<string>")
    edges = spark.createDataFrame([("located_in", ["Customer"], [], False, False, True)], "name string, from_types array<string>, to_types array<string>, both_ways boolean, at_most_one_in boolean, at_most_one_out boolean")
    return check.Vocabulary(nodes, edges, "trade@1")


def _ordered(spark, d):
    nodes = all_entities(spark, d).withColumn("ord", F.struct("prov.source", "id"))
    edges = all_relations(spark, d).withColumn("attributes", F.lit("{}")).withColumn("ord", F.struct("prov.source", F.col("from_id").alias("id")))
    return nodes, edges


_BROKEN = """(SELECT 'unknown_entity_type' AS kind, 'Order' AS type, 'order:' || o_orderkey AS id, 'orders' AS source FROM orders
UNION ALL SELECT 'unknown_attribute', 'customer', 'customer:' || c_custkey, 'customer' FROM customer
UNION ALL SELECT 'dangling_relation', 'PART_OF', 'nation:' || n_nationkey || ' -> region:' || n_regionkey, 'nation' FROM nation
UNION ALL SELECT 'unknown_relation_type', 'PART_OF', 'nation:' || n_nationkey || ' -> region:' || n_regionkey, 'nation' FROM nation
UNION ALL SELECT 'unknown_relation_type', 'PLACED_BY', 'order:' || o_orderkey || ' -> customer:' || o_custkey, 'orders' FROM orders
UNION ALL SELECT 'relation_not_allowed', 'located_in', 'supplier:' || s_suppkey || ' -> nation:' || s_nationkey, 'supplier' FROM supplier)"""


@query(f"SELECT kind, type, id AS subject, source FROM {_BROKEN}")
def check_violations(spark, d):
    found = check.check(*_ordered(spark, d), _vocabulary(spark)).violations
    return found.select("kind", "type", F.coalesce("id", F.concat_ws(" -> ", "from_id", "to_id")).alias("subject"), "source")


@query(f"""WITH v AS (SELECT *, CASE kind WHEN 'unknown_entity_type' THEN 'entity' WHEN 'unknown_relation_type' THEN 'relation' WHEN 'unknown_attribute' THEN 'attribute' ELSE 'relation_ends' END AS asks FROM {_BROKEN} WHERE kind <> 'dangling_relation')
SELECT CASE asks WHEN 'entity' THEN 1 WHEN 'relation' THEN 2 WHEN 'attribute' THEN 3 ELSE 4 END AS kind_no, asks AS kind, CASE asks WHEN 'attribute' THEN 'segment' ELSE type END AS type, count(*) AS records,
CASE WHEN type = 'PART_OF' THEN 'Nation' WHEN asks = 'attribute' THEN 'customer' WHEN asks = 'relation_ends' THEN 'SUPPLIER' ELSE '' END AS from_types, CASE WHEN type = 'PLACED_BY' THEN 'customer' WHEN asks = 'relation_ends' THEN 'Nation' ELSE '' END AS to_types,
min(source) AS sources, CASE WHEN asks = 'attribute' THEN '' ELSE 'tabular' END AS producers, min(id) AS example FROM v GROUP BY asks, v.type""")
def check_proposals(spark, d):
    out = check.check(*_ordered(spark, d), _vocabulary(spark)).proposals
    lists = {c: F.array_join(c, ",") for c in ("from_types", "to_types", "sources", "producers")}
    return out.withColumns(lists)


@query(f"""SELECT (SELECT count(*) FROM orders) AS entities, (SELECT count(*) FROM orders) AS relations, (SELECT count(*) FROM orders WHERE o_orderkey % 3 = 0) AS deterministic, (SELECT count(*) FROM orders WHERE o_orderkey % 3 <> 0) AS inferred,
(SELECT count(*) FROM orders) AS violations, (SELECT count(*) FROM ({_ATTR})) + (SELECT count(*) FROM ({_AGAINST})) + (SELECT count(*) FROM (SELECT DISTINCT o_custkey, o_orderstatus FROM orders)) - (SELECT count(DISTINCT o_custkey) FROM orders)
+ (SELECT count(*) FROM (SELECT DISTINCT o_custkey, o_orderpriority FROM orders)) - (SELECT count(DISTINCT o_custkey) FROM orders) AS conflicts, CAST(0 AS BIGINT) AS duplicates""")
def check_counts(spark, d):
    """Nobody declared a type, so every edge dangles and directions are no question."""
    return check.check(_records(spark, d), _edges(spark, d)).counts


# ---- preflight


def _conflicts(spark, d):
    by = F.when(F.col("event_id") % 2 == 0, "ann")
    return table(spark, d, "events").filter("event_type = 'error'").select(F.lit("entity_type").alias("kind"), F.concat(F.lit("user:"), "user_id").alias("subject"), F.when(F.col("user_id") % 2 == 0, by).alias("left_reviewed_by"), F.when(F.col("user_id") % 2 == 1, by).alias("right_reviewed_by"), F.col("event_id").alias("ord"))


@query("SELECT 'held' AS kind, 'user:' || arg_min(user_id, event_id) AS subject, 'refuse' AS severity FROM events WHERE event_type = 'error' AND event_id % 2 = 1")
def preflight_held(spark, d):
    return preflight.held(_conflicts(spark, d))


@query(f"SELECT 'counts_disagree' AS kind, field AS subject, 'report' AS severity FROM (SELECT unnest(['entities', 'chunks', 'inferred']) AS field, unnest([(SELECT count(*) FROM {_ENT}) <> 7, (SELECT count(*) FROM documents) <> 10, (SELECT count(*) FROM {_REL}) <> 3]) AS bad) WHERE bad")
def preflight_counts(spark, d):
    graph = {"entities": all_entities(spark, d), "relations": all_relations(spark, d), "chunks": table(spark, d, "documents")}
    n = graph["relations"].agg(F.count("*").alias("relations"))
    claimed = n.select(F.lit(7).alias("entities"), "relations", F.lit(10).alias("chunks"), F.lit(0).alias("deterministic"), F.lit(3).alias("inferred"))
    return preflight.counts_disagree({**graph, "counts": claimed})


def _ruled(spark, d):
    prov = F.struct(F.concat(F.lit("set"), F.col("event_id") % 9).alias("rule_set"), F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("rule"), F.col("user_id") % 20)).alias("ruled_by"), F.when(F.col("event_id") % 3 == 0, "human").otherwise("model").alias("producer"), F.when(F.col("user_id") % 2 == 0, "ann").alias("by"), F.when(F.col("user_id") % 5 != 0, "2024-01-01").alias("at"))
    return table(spark, d, "events").select(F.concat(F.lit("user:"), "user_id").alias("id"), F.col("props").alias("attributes"), prov.alias("prov"), F.col("event_id"))


@query("""SELECT DISTINCT 'rule_set_unresolved' AS kind, 'set' || event_id % 9 AS subject, 'report' AS severity FROM events WHERE event_id % 9 >= 5
UNION ALL SELECT DISTINCT 'rule_unresolved', 'rule' || user_id % 20, 'report' FROM events WHERE event_id % 4 = 0 AND user_id % 20 >= 10""")
def preflight_rules(spark, d):
    sets = spark.range(5).select(F.concat(F.lit("set"), "id").alias("name"), F.explode(F.transform(F.sequence(F.lit(0), F.lit(1)), lambda i: F.concat(F.lit("rule"), i * 5 + F.col("id")))).alias("rule"))
    return preflight.unresolved_rules([_ruled(spark, d)], sets)


@query("""SELECT DISTINCT 'attribute_type' AS kind, CASE event_id % 5 WHEN 1 THEN 'array' WHEN 2 THEN 'bigint' ELSE 'unreadable' END AS subject, 'report' AS severity FROM events WHERE event_id % 5 BETWEEN 1 AND 3""")
def preflight_attribute_type(spark, d):
    text = F.when(F.col("event_id") % 5 == 1, "[1, 2]").when(F.col("event_id") % 5 == 2, "17").when(F.col("event_id") % 5 == 3, "{no json").otherwise(F.col("attributes"))
    return preflight.attribute_types(_ruled(spark, d).withColumn("attributes", text))


@query("SELECT DISTINCT 'assertion_unsigned' AS kind, 'user:' || user_id AS subject, 'report' AS severity FROM events WHERE event_id % 3 = 0 AND (user_id % 2 <> 0 OR user_id % 5 = 0)")
def preflight_unsigned(spark, d):
    return preflight.unsigned(_ruled(spark, d), F.col("id"))


@query("SELECT 'provenance_without_chunk' AS kind, item AS idx FROM (SELECT DISTINCT l_suppkey AS item FROM lineitem) WHERE item NOT IN (SELECT item_id FROM benchmark)")
def preflight_citations(spark, d):
    rows = table(spark, d, "lineitem").select(F.struct(F.col("l_suppkey").alias("chunk")).alias("prov"))
    return load.citation_defects(rows, table(spark, d, "benchmark").select(F.col("item_id").alias("idx")))


@query("""SELECT 'chunk_vectored_twice' AS kind, vec_id % 200 AS chunk FROM embeddings GROUP BY vec_id % 200 HAVING count(*) > 1 UNION ALL SELECT 'vector_empty', vec_id % 200 FROM embeddings WHERE vec_id % 10 = 3
UNION ALL SELECT 'vector_without_chunk', vec_id % 200 FROM embeddings WHERE vec_id % 200 NOT IN (SELECT item_id FROM benchmark) UNION ALL SELECT 'vector_width', vec_id % 200 FROM embeddings WHERE vec_id % 10 = 7""")
def preflight_vector_kinds(spark, d):
    values = F.when(F.col("vec_id") % 10 == 3, F.array().cast("array<float>")).when(F.col("vec_id") % 10 == 7, F.slice("embedding", 1, 8)).otherwise(F.col("embedding"))
    v = table(spark, d, "embeddings").select((F.col("vec_id") % 200).alias("chunk"), values.alias("values"), F.col("vec_id").alias("ord"))
    return load.vector_defects(v, table(spark, d, "benchmark").select(F.col("item_id").alias("idx")))


# ---- review decisions

_VERB = "CASE c_custkey % 6 WHEN 0 THEN 'reject' WHEN 1 THEN 'accept' WHEN 2 THEN 'edit' WHEN 3 THEN 'rule' END"


def _decided(spark, d):
    """Items about customers: some decided by people, some (shape "quiet") by a rule that rejects, some open."""
    key = F.col("c_custkey")
    c = table(spark, d, "customer")
    items = c.select(F.concat(F.lit("item:"), F.lpad(key.cast("string"), 9, "0")).alias("item_id"), F.lit("violation").alias("kind"), F.concat(F.lit("customer:"), key).alias("subject"), F.when(key % 6 == 3, "quiet").otherwise("loud").alias("shape"), key.alias("ord"), F.lit("customer").alias("source"), F.lit(-1).alias("chunk"), F.lit("tabular").alias("producer"))
    verb = F.when(key % 6 == 0, "reject").when(key % 6 == 1, "accept").when(key % 6 == 2, "edit")
    none = F.lit(None).cast("string")
    said = c.select(F.concat(F.lit("item:"), F.lpad(key.cast("string"), 9, "0")).alias("item_id"), verb.alias("verb"), F.when(key % 2 == 0, "ann").otherwise("bob").alias("by"), F.when(key % 6 == 2, "Client").alias("edit_type"), none.alias("edit_name"), none.alias("edit_from"), none.alias("edit_to")).filter("verb is not null")
    rules = spark.createDataFrame([("quiet", "reject", "eve", "R1", False, 1)], "shape string, verb string, by string, name string, authored boolean, ord long")
    return items, said, rules


def _applied(spark, d):
    items, said, rules = _decided(spark, d)
    nodes, edges = all_entities(spark, d), all_relations(spark, d)
    aimed = apply.targets(items, nodes, edges)
    apply.refuse_bad(items, said, aimed)
    return apply.apply(nodes, edges, apply.plan(apply.decided(items, said, rules), aimed))


@query("SELECT 'item:' || lpad(c_custkey::VARCHAR, 9, '0') AS item_id, 'customer:' || c_custkey AS id FROM customer")
def review_targets(spark, d):
    nodes, edges = all_entities(spark, d), all_relations(spark, d)
    aimed = apply.targets(_decided(spark, d)[0], nodes, edges)
    return aimed.join(nodes.select("id", apply.entity_ref().alias("ref")), "ref").select("item_id", "id")


@query(f"""WITH e AS (SELECT * FROM {_ENT}), c AS (SELECT 'customer:' || c_custkey AS id, {_VERB} AS verb, CASE WHEN c_custkey % 2 = 0 THEN 'ann' ELSE 'bob' END AS person FROM customer)
SELECT e.id, CASE WHEN verb = 'edit' THEN 'Client' ELSE e.type END AS type, CASE WHEN verb IN ('accept', 'edit') THEN person ELSE '' END AS reviewed_by, '' AS ruled_by FROM e LEFT JOIN c ON c.id = e.id WHERE verb IS NULL OR verb IN ('accept', 'edit')""")
def review_apply(spark, d):
    return _applied(spark, d)[0].select("id", "type", "reviewed_by", "ruled_by")


@query(f"SELECT from_id, type, to_id FROM {_REL} WHERE from_id NOT IN (SELECT 'customer:' || c_custkey FROM customer WHERE c_custkey % 3 = 0) AND to_id NOT IN (SELECT 'customer:' || c_custkey FROM customer WHERE c_custkey % 3 = 0)")
def review_apply_edges(spark, d):
    return _applied(spark, d)[1].select("from_id", "type", "to_id")


@query(f"""WITH g AS (SELECT 'customer:' || c_custkey AS id, c_custkey % 6 AS m FROM customer WHERE c_custkey % 3 = 0), r AS (SELECT from_id FROM {_REL} WHERE from_id IN (SELECT id FROM g) OR to_id IN (SELECT id FROM g))
SELECT CAST(11 AS BIGINT) AS chunks, (SELECT count(*) FROM {_ENT}) - (SELECT count(*) FROM g) AS entities, (SELECT count(*) FROM {_REL}) - (SELECT count(*) FROM r) AS relations, CAST(0 AS BIGINT) AS deterministic,
(SELECT count(*) FROM {_REL}) - (SELECT count(*) FROM r) AS inferred, 5 + (SELECT count(*) FROM g WHERE m = 3) + (SELECT count(*) FROM r) AS dropped""")
def review_recount(spark, d):
    """Records that a rule removed without anybody reading them add to those dropped before."""
    prior = spark.createDataFrame([(11, 5)], "chunks long, dropped long")
    nodes, edges, dropped = _applied(spark, d)
    return apply.recount(nodes, edges, prior, dropped)


@query(f"""WITH m AS (SELECT 'customer:' || c_custkey AS id, 'customer:' || (c_custkey - c_custkey % 8) AS survivor FROM customer WHERE c_custkey % 8 <> 0 AND c_custkey > 8)
SELECT e.id, e.type, e.name FROM {_ENT} e LEFT JOIN m ON m.id = e.id WHERE m.id IS NULL""")
def review_merge_entities(spark, d):
    """Entities of chains of up to seven customers that become one."""
    key = F.col("c_custkey")
    merges = table(spark, d, "customer").filter((key % 8 != 0) & (key > 8)).select(F.concat(F.lit("customer:"), key).alias("id"), F.concat(F.lit("customer:"), key - 1).alias("into"))
    nodes = all_entities(spark, d).withColumn("ord", F.struct("id", "name"))
    edges = all_relations(spark, d).withColumn("ord", F.struct("from_id", "to_id"))
    return review.merge_into(nodes, edges, merges)[0].select("id", "type", "name")


@query("""SELECT item_id, verb, "by", via FROM (SELECT 'item:' || lpad(c_custkey::VARCHAR, 9, '0') AS item_id, CASE c_custkey % 6 WHEN 0 THEN 'reject' WHEN 1 THEN 'accept' WHEN 2 THEN 'edit' WHEN 3 THEN 'reject' END AS verb,
CASE WHEN c_custkey % 6 = 3 THEN 'eve' WHEN c_custkey % 6 > 3 THEN NULL WHEN c_custkey % 2 = 0 THEN 'ann' ELSE 'bob' END AS "by", CASE WHEN c_custkey % 6 = 3 THEN 'rule' WHEN c_custkey % 6 < 3 THEN 'decision' END AS via FROM customer)""")
def review_decisions(spark, d):
    from tessera.operators import queue

    items, said, rules = _decided(spark, d)
    return queue.resolve(items, said.withColumn("ord", F.lit(1)), rules).select("item_id", "verb", "by", "via")


@query("""SELECT item_id, CASE WHEN c % 5 = 0 THEN 'closed' WHEN c % 2 = 0 THEN 'unknown_item' ELSE 'taken' END AS verdict FROM (SELECT c_custkey AS c, 'item:' || c_custkey AS item_id FROM customer)""")
def review_batch(spark, d):
    key = F.col("c_custkey")
    named = table(spark, d, "customer").select((key % 5).alias("job_id"), F.concat(F.lit("item:"), key).alias("item_id"), key)
    return apply.batch(named.filter(key % 2 == 1), named, spark.createDataFrame([(0,)], "job_id long")).select("item_id", "verdict")


# ---- reading


def _unnamed(spark, d):
    """Every third nation and every second customer has no name."""
    number = F.substring_index("id", ":", -1).cast("long")
    blank = ((F.col("type") == "Nation") & (number % 3 == 1)) | ((F.col("type") == "Customer") & (number % 2 == 0))
    return all_entities(spark, d).withColumn("name", F.when(blank, "").otherwise(F.col("name")))


@query(f"""WITH e AS (SELECT id, CASE WHEN (type = 'Nation' AND split_part(id, ':', 2)::BIGINT % 3 = 1) OR (type = 'Customer' AND split_part(id, ':', 2)::BIGINT % 2 = 0) THEN '' ELSE name END AS name FROM {_ENT})
SELECT DISTINCT coalesce(nullif(a.name, ''), from_id) AS subject, r.type, coalesce(nullif(b.name, ''), to_id) AS object, r.source FROM {_REL} r LEFT JOIN e a ON a.id = from_id LEFT JOIN e b ON b.id = to_id WHERE from_id = 'nation:7' OR to_id = 'nation:7'""")
def recall_claims_unnamed(spark, d):
    return recall.claims(_unnamed(spark, d), all_relations(spark, d), "nation:7").select("subject", "type", "object", "source")


@query(f"""WITH e AS (SELECT * FROM {_ENT}) SELECT DISTINCT coalesce(a.name, from_id) || ' -[' || r.type || ']-> ' || coalesce(b.name, to_id) || ' (inferred, tabular) [' || r.source || ']' AS text
FROM {_REL} r LEFT JOIN e a ON a.id = from_id LEFT JOIN e b ON b.id = to_id WHERE from_id = 'nation:3' OR to_id = 'nation:3'""")
def recall_rendered(spark, d):
    return recall.rendered(recall.claims(all_entities(spark, d), all_relations(spark, d), "nation:3")).select("text")


@query("SELECT source, doc_id AS idx, text FROM documents WHERE doc_id = 7")
def recall_cite(spark, d):
    docs = table(spark, d, "documents")
    chunks = docs.select("source", F.col("doc_id").alias("idx"), "text", F.lit(0).alias("start_byte"), F.octet_length("text").alias("end_byte"))
    source = docs.filter("doc_id = 7").select("source").first()["source"]
    return recall.cite(chunks, source, 7).select("source", "idx", "text")


@query("SELECT p_partkey AS id, p_name AS subject, p_type AS detail FROM part WHERE contains(lower(p_name), 'ring') OR contains(lower(p_type), 'ring') OR contains(lower(p_brand), 'ring') ORDER BY subject, detail")
def recall_unanswered(spark, d):
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("subject"), F.col("p_type").alias("detail"), F.col("p_brand").alias("left_name"), F.lit("").alias("right_name"))
    return recall.unanswered(rows, "RING").select("id", "subject", "detail")


def _search(spark, d, distance):
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("idx"), F.col("embedding").alias("values"))
    q = rows.filter("idx = 11").first()["values"]
    return recall.vector_search(rows, list(q), 10, distance).withColumn("distance", F.round("distance", 6))


@query("WITH q AS (SELECT embedding e FROM embeddings WHERE vec_id = 11), s AS (SELECT vec_id AS idx, list_distance(embedding::DOUBLE[], (SELECT e FROM q)::DOUBLE[]) c FROM embeddings) SELECT idx, round(c, 6) AS distance FROM s ORDER BY c, idx LIMIT 10")
def recall_search_l2(spark, d):
    return _search(spark, d, "l2")


@query("WITH q AS (SELECT embedding e FROM embeddings WHERE vec_id = 11), s AS (SELECT vec_id AS idx, -list_inner_product(embedding::DOUBLE[], (SELECT e FROM q)::DOUBLE[]) c FROM embeddings) SELECT idx, round(c, 6) AS distance FROM s ORDER BY c, idx LIMIT 10")
def recall_search_ip(spark, d):
    return _search(spark, d, "ip")


@query(f"""WITH r AS (SELECT from_id a, to_id b FROM {_REL} UNION SELECT to_id, from_id FROM {_REL}), s AS (SELECT 'supplier:' || s_suppkey AS id FROM supplier WHERE s_suppkey < 3), h AS (SELECT DISTINCT b AS id FROM r JOIN s ON a = s.id WHERE b NOT IN (SELECT id FROM s))
SELECT id, 0 AS hop FROM s UNION ALL SELECT id, 1 FROM h""")
def recall_around_hits(spark, d):
    """Search hits are rows of the supplier table; their entities are the seeds."""
    chunk = F.when(F.col("type") == "Supplier", F.substring_index("id", ":", -1).cast("int")).otherwise(F.lit(-1))
    nodes = all_entities(spark, d).withColumn("prov", F.col("prov").withField("chunk", chunk))
    hits = table(spark, d, "supplier").filter("s_suppkey < 3").select(F.lit("supplier").alias("source"), F.col("s_suppkey").cast("int").alias("idx"))
    return recall.around(recall.seeds_of(nodes, hits), all_relations(spark, d), 1)


@query("SELECT event_id AS id, json_extract_string(props, '$.k') AS k FROM events")
def export_flat(spark, d):
    from tessera.operators import export

    flat = export.flattened(table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("props").alias("attributes")))
    return flat.select("id", F.col("flat")["k"].alias("k"))


@query("""WITH w AS (SELECT DISTINCT user_id AS job_id FROM events), k AS (SELECT DISTINCT user_id AS job_id FROM events WHERE user_id % 3 = 0), live AS (SELECT count(*) AS n FROM k WHERE job_id % 2 = 0),
f AS (SELECT job_id, row_number() OVER (ORDER BY job_id) AS n FROM w WHERE job_id NOT IN (SELECT job_id FROM k)) SELECT w.job_id, CASE WHEN w.job_id % 3 = 0 THEN 'existing' WHEN f.n <= greatest(0, 60 - live.n) THEN 'admitted' ELSE 'refused' END AS verdict FROM w LEFT JOIN f USING (job_id), live""")
def job_admission(spark, d):
    from tessera.operators import jobs

    named = table(spark, d, "events").select(F.col("user_id").alias("job_id")).distinct()
    known = named.filter("job_id % 3 = 0").withColumn("state", F.when(F.col("job_id") % 2 == 0, "RUNNING").otherwise("SUCCEEDED"))
    return jobs.admit(known, named, 60)


@query("SELECT 'customer:' || c_custkey AS id, 'customer' AS source, c_name AS name FROM customer")
def store_round_trip(spark, d):
    """Two loads, of which one is exchanged: readers see the other and the new one, whole."""
    import uuid

    from tessera.operators.cut import cut

    context = spark.sparkContext
    cut(spark.range(1))  # names the shared folder
    store = load.Store(spark, f"{context.getCheckpointDir()}/store-{uuid.uuid4().hex}")
    c = table(spark, d, "customer")
    nodes = c.select(F.concat(F.lit("customer:"), "c_custkey").alias("id"), F.lit("Customer").alias("type"), F.col("c_name").alias("name"), F.lit("{}").alias("attributes"), provenance("customer").alias("prov"), F.col("c_custkey").alias("ord"))
    edges = all_relations(spark, d, ("supplier",))
    even, odd, wrong = nodes.filter("ord % 2 = 0"), nodes.filter("ord % 2 = 1"), nodes.filter("ord % 2 = 1").withColumn("name", F.lit("?"))
    for name, part, replace in (("even", even, False), ("odd", wrong, False), ("odd", odd, True)):
        store.load(name, {"entities": part, "relations": edges}, replace)
    return store.read("entities").select("id", F.col("prov.source").alias("source"), "name")
