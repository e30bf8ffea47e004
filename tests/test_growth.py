"""Shapes of plans that keep a task's rows and memory from growing with the input."""

import re

from pyspark.sql import functions as F

from tessera.operators import check, export, merge, verify

PROV = "struct('s' AS source, 'model' AS producer) AS prov"


def _edges(spark):
    return spark.range(200).select(F.concat(F.lit("a"), F.col("id") % 50).alias("from_id"), F.lit("USES").alias("type"), F.concat(F.lit("b"), F.col("id") % 2).alias("to_id"), F.lit("").alias("key"), F.to_json(F.struct((F.col("id") % 3).alias("n"))).alias("attributes"), F.expr(PROV), F.col("id").alias("ord"))


def test_types_of_proposals_are_distinct_before_they_are_compared(spark):
    nodes = spark.range(100).select(F.concat(F.lit("a"), "id").alias("id"), F.when(F.col("id") == 0, "Known").otherwise("Odd").alias("type"), F.expr(PROV), F.col("id").alias("ord"))
    none = lambda c: F.lit(None).cast("string").alias(c)
    odd = nodes.filter("type = 'Odd'").select(F.lit("unknown_entity_type").alias("kind"), "id", none("from_id"), "type", none("to_id"), none("attr"), F.lit("s").alias("source"), F.lit("model").alias("producer"), "ord")
    edge = nodes.select(F.lit("unknown_relation_type").alias("kind"), none("id"), F.lit("a0").alias("from_id"), F.lit("SEES").alias("type"), F.col("id").alias("to_id"), none("attr"), F.lit("s").alias("source"), F.lit("model").alias("producer"), "ord")
    out = check.proposals(odd.unionByName(edge), nodes)
    assert [(r["kind"], r["type"], r["records"], r["from_types"], r["to_types"], r["example"]) for r in out.orderBy("kind_no").collect()] == [("entity", "Odd", 99, [], [], "a1"), ("relation", "SEES", 100, ["Known"], ["Known"], "a0 -> a0")]
    # one type of most rows would take them all to one task
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search(r"Join LeftOuter, \(type#\d+ = _u#\d+\)", plan)


def test_keys_of_assertions_are_bytes(spark):
    kept, lost = export.stored_edges(_edges(spark), "triple")
    assert kept.count() == 50
    assert {r["merged"] for r in lost.collect()} == {2}
    assert "unhex(sha2(" in lost._jdf.queryExecution().optimizedPlan().toString()


def test_relations_meet_once(spark):
    out = merge.merge_relations(_edges(spark))
    assert {(r["from_id"], r["attributes"], r["ord"]) for r in out.collect()} == {(f"a{i}", f'{{"n":{i % 3}}}', i) for i in range(50)}
    assert len(re.findall(r"Exchange hashpartitioning", out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1])) == 1


def test_claims_are_dealt_by_key_once(spark):
    claims = spark.sql("SELECT concat('a', id % 50) AS id, 'x' AS attr, concat('V', id % 100) AS value, id AS ord FROM range(200) UNION ALL SELECT 'a0', 'x', NULL, 900L UNION ALL SELECT NULL, 'x', 'V', 901L")
    plain = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = verify.value_conflicts(claims, ["id", "attr"], "k")
        assert {(r["id"], r["left_value"], r["right_value"], r["ord"]) for r in out.collect()} == {(f"a{i}", f"V{i}", f"V{i + 50}", i + 50) for i in range(50)}
        plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan")[0]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", plain)
    # one shuffle by value, one by key; the second use of the latter is no shuffle
    assert len(re.findall(r"(?<!Reused)Exchange hashpartitioning", plan)) - len(re.findall(r"ReusedExchange", plan)) <= 2, plan
