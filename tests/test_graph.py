"""Graph operators on small cases."""

import pytest
from pyspark.sql import functions as F

from tessera.functions.text import affixes, fold, fold_key
from tessera.operators import load, preflight, recall, verify
from tessera.sources.tabular import Mapping, RelationColumn, checked_rows, relations

PROV = "struct<source:string,chunk:int,producer:string>"


def test_folds_differ(spark):
    df = spark.createDataFrame([("  A  b ",)], "s string").select(fold_key(F.col("s")).alias("k"), fold(F.col("s")).alias("f"))
    assert tuple(df.first()) == ("a b", "a  b")


def test_affixes_longest_first(spark):
    got = spark.createDataFrame([("a b c",), ("x",)], "s string").select(affixes(F.col("s")).alias("a")).collect()
    assert [r["a"] for r in got] == [["a b", "a", "b c", "c"], []]


def test_rows_with_missing_and_repeated_ids(spark):
    df = spark.createDataFrame([(1, "a", "x"), (2, "a", "x"), (3, "a", "y"), (4, " ", "z"), (5, "b", "")], "line int, k string, v string")
    m = Mapping("Thing", "k", None, {}, (RelationColumn("v", "HAS", "Value"),))
    read = checked_rows(df, m, ["line"])
    assert sorted(r["k"] for r in read.rows.collect()) == ["a", "b"]
    assert sorted(tuple(r) for r in read.violations.collect()) == [("duplicate_id", "thing:a"), ("missing_id", "")]
    assert [(r["from_id"], r["to_id"]) for r in relations(read.rows, m, "t").collect()] == [("thing:a", "value:x")]
    with pytest.raises(ValueError):
        checked_rows(df, Mapping("Thing", "nope"), ["line"])


def test_alias_and_parallel_edges(spark):
    e = spark.createDataFrame([("1", "T", "Acme", ["Globex"], ("s", -1, "tabular"), 1), ("2", "t", " globex ", [], ("s", -1, "ddl"), 2)], f"id string, type string, name string, aliases array<string>, prov {PROV}, ord int")
    assert [tuple(r) for r in verify.alias_duplicates(e).collect()] == [("1", "2", "alias")]
    rows = [("a", "R", "b", "k1", 1), ("a", "R", "b", "k2", 2), ("b", "R", "a", "k1", 3), ("c", "R", "d", "", 4), ("d", "R", "c", "x", 5)]
    r = spark.createDataFrame([(*x[:4], ("s", -1, "ddl"), x[4]) for x in rows], f"from_id string, type string, to_id string, key string, prov {PROV}, ord int")
    got = sorted((c["kind"], c["low"], c["edge_key"], c["ord"]) for c in verify.direction_conflicts(r).collect())
    assert got == [("relation_direction", "a", "k1", 3), ("relation_direction", "c", "", 5)]
    assert verify.direction_conflicts(r, ["r"]).count() == 0


def test_order_of_partitions_does_not_matter(spark):
    rows = [(str(i % 7), v, i) for i, v in enumerate("aAbBcabcAB" * 5)]
    df = spark.createDataFrame(rows, "id string, value string, ord int")
    one = sorted(map(tuple, verify.value_conflicts(df.coalesce(1), ["id"], "k").collect()))
    assert one == sorted(map(tuple, verify.value_conflicts(df.repartition(5, "value"), ["id"], "k").collect()))


def test_store_is_idempotent_and_refuses(spark, tmp_path):
    e = spark.createDataFrame([("1", "T", "x", 1), ("1", "t", "X", 2), ("2", "T", "y", 3)], "id string, type string, name string, ord int")
    store = load.Store(spark, tmp_path.as_uri())
    assert store.load("a", {"entities": e}).status == "written"
    assert store.load("a", {"entities": e.repartition(3)}).status == "converged"
    with pytest.raises(load.Held):
        store.load("a", {"entities": e.filter("id = '2'")})
    with pytest.raises(preflight.Refused, match="entity_id_reused"):
        store.load("b", {"entities": e.filter("ord > 1").withColumn("id", F.lit("1"))})
    # two records of one entity that agree are one row
    assert store.read("entities").filter("load_id = 'a'").count() == 2


def test_reads(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 2.0]), (3, [1.0])], "idx int, values array<double>")
    assert [r["idx"] for r in recall.vector_search(v, [0.1, 1.0], 5).collect()] == [2, 1]
    assert [r["idx"] for r in recall.vector_search(v, [1.0, 0.0], 1, "l2").collect()] == [1]
    with pytest.raises(ValueError):
        recall.vector_search(v, [1.0], 0)
    d = spark.createDataFrame([("s", "Mentions X", "l", "r")], "subject string, detail string, left_name string, right_name string")
    assert recall.unanswered(d, "mentions x").count() == 1 and recall.unanswered(d, "none").count() == 0
