"""The check after decisions equals the whole check of the decided graph, and reads touched buckets alone."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import apply, check, queue, recheck, review
from tessera.operators.cut import cut
from tessera.operators.txlog import Conflict

PROV = "struct<source:string,chunk:int,producer:string,confidence:double>"
ENTITY = f"id string, type string, name string, attributes string, prov {PROV}, ord long"
EDGE = f"from_id string, type string, to_id string, key string, attributes string, prov {PROV}, ord long"


def vocabulary(spark):
    types = spark.createDataFrame([("Thing", []), ("Place", [])], "name string, attributes array<string>")
    rules = [("IN", [], [], False, False, True), ("HEADS", [], [], False, True, True), ("NEAR", [], [], True, False, False)]
    return check.Vocabulary(types, spark.createDataFrame(rules, "name string, from_types array<string>, to_types array<string>, both_ways boolean, at_most_one_in boolean, at_most_one_out boolean"), "o")


def graph(spark, seed, n=60, m=120):
    dice = random.Random(seed)
    node = lambda: f"n{dice.randrange(n)}"
    prov = lambda: ("d", 0, dice.choice(["model", "ddl"]), 0.5)
    nodes = [(f"n{i}", dice.choice(["Thing", "thing", "Place"]), f"N{i}", f'{{"x":"{dice.randrange(2)}"}}', prov(), 1000 + i) for i in range(n)]
    nodes += [(node(), "Place", f"N{dice.randrange(n)}", '{"x":"1"}', prov(), 2000 + i) for i in range(n // 6)]
    edges, seen = [], set()
    for i in range(m):
        e = (node(), dice.choice(["IN", "HEADS", "NEAR", "odd"]), node(), dice.choice(["", "", "k1", "k2"]))
        if e not in seen:
            seen.add(e)
            edges.append((*e, f'{{"w":"{dice.randrange(2)}"}}', prov(), i))
    return spark.createDataFrame(nodes, ENTITY), spark.createDataFrame(edges, EDGE)


def rows(frame):
    return sorted(tuple(r) for r in frame.select("kind", "subject", "left_value", "right_value", "ord").collect())


def edit_of(spark, dice, n):
    """Decisions: one merge chain, one removed node, one retyped one; and the nodes that they name."""
    a, b, c, gone, other = (f"n{i}" for i in dice.sample(range(n), 5))
    merges = spark.createDataFrame([(a, b), (b, c)], "id string, into string")

    def edit(nodes, edges):
        nodes = nodes.filter(F.col("id") != gone).withColumn("type", F.when(F.col("id") == other, "Place").otherwise(F.col("type")))
        edges = edges.filter((F.col("from_id") != gone) & (F.col("to_id") != gone))
        return review.merge_into(nodes, edges, merges)

    return spark.createDataFrame([(x,) for x in (a, b, c, gone, other)], "id string"), edit


@pytest.mark.parametrize("governed", [True, False])
def test_equals_the_whole_check_over_rounds(spark, tmp_path, governed):
    words = vocabulary(spark) if governed else None
    nodes, edges = graph(spark, 5)
    kept = recheck.Checked(spark, f"file://{tmp_path}/g", words, buckets=8)
    whole = check.check(nodes, edges, words)
    conflicts = cut(whole.conflicts)
    before = kept.start(nodes, edges)
    assert rows(before) == rows(conflicts) and before.count() > 10
    dice = random.Random(9)
    for _ in range(2):
        named, edit = edit_of(spark, dice, 60)
        nodes, edges = map(cut, edit(cut(whole.entities), cut(whole.relations)))
        old = conflicts
        whole = check.check(nodes, edges, words)
        conflicts = cut(whole.conflicts)
        done = kept.recheck(named, edit)
        assert rows(kept.conflicts()) == rows(conflicts)
        assert rows(done.opened) == rows(queue.reopened(old, conflicts)) and rows(done.closed) == rows(queue.reopened(conflicts, old))
        assert sorted(r.id for r in kept.entities().collect()) == sorted(r.id for r in nodes.collect())
        assert sorted(kept.relations().select("from_id", "type", "to_id", "key").collect()) == sorted(edges.select("from_id", "type", "to_id", "key").collect())


def test_other_buckets_are_neither_read_nor_written(spark, tmp_path):
    nodes = spark.createDataFrame([(f"n{i}", "Thing", f"N{i}", "{}", ("d", 0, "model", 0.5), i) for i in range(200)], ENTITY)
    edges = spark.createDataFrame([(f"n{i}", "IN", f"n{i + 1}", "", "{}", ("d", 0, "model", 0.5), i) for i in range(0, 200, 2)], EDGE)
    kept = recheck.Checked(spark, f"file://{tmp_path}/g", vocabulary(spark), buckets=64)
    assert kept.start(nodes, edges).count() == 0
    _, first = kept._state()
    merges = spark.createDataFrame([("n0", "n2")], "id string, into string")
    done = kept.recheck(spark.createDataFrame([("n0",), ("n2",), (None,)], "id string"), lambda e, r: review.merge_into(e, r, merges))
    assert [(r.kind, r.subject, r.left_value, r.right_value) for r in done.opened.collect()] == [("cardinality", "n2 IN out", "n1", "n3")]
    assert 0 < len(done.read) <= 4
    _, second = kept._state()
    assert {k for k in first if first[k] != second[k]} <= {f"bucket {b}" for b in done.read}
    used = {p.split("bucket=")[1].split("/")[0] for p in kept._read(second, "entities", done.read).inputFiles()}
    assert used <= {str(b) for b in done.read}


def test_nothing_decided_unknown_nodes_and_empty_graphs(spark, tmp_path):
    nodes, edges = graph(spark, 1, 10, 10)
    kept = recheck.Checked(spark, f"file://{tmp_path}/g", None, buckets=4)
    found = rows(kept.start(nodes.limit(0), edges.limit(0)))
    none = spark.createDataFrame([], "id string")
    same = lambda e, r: (e, r)
    assert found == [] and kept.recheck(none, same).read == []
    done = kept.recheck(spark.createDataFrame([("no such node",)], "id string"), same)
    assert done.opened.count() == done.closed.count() == kept.entities().count() == 0
    with pytest.raises(ValueError):
        kept.start(nodes, edges.withColumn("attributes", F.lit(None).cast("string")))


def test_two_rechecks_of_one_bucket_conflict(spark, tmp_path):
    nodes, edges = graph(spark, 3, 10, 10)
    kept = recheck.Checked(spark, f"file://{tmp_path}/g", None, buckets=1)
    kept.start(nodes, edges)
    one, same = spark.createDataFrame([("n1",)], "id string"), lambda e, r: (e, r)

    def slow(e, r):
        kept.recheck(one, same)
        return e, r

    with pytest.raises(Conflict):
        kept.recheck(one, slow)
    assert kept.entities().count() == nodes.count()
    assert apply.recount(kept.entities(), kept.relations(), spark.createDataFrame([(0,)], "dropped long"), spark.createDataFrame([(0,)], "n long")).first()["entities"] == nodes.count()
