"""Review queue and graph documents on small fixtures."""

from pyspark.sql import functions as F

from tessera.operators import queue
from tessera.sources.graph_json import read_graphs

ITEM = "kind string, subject string, shape string, ord long"
RULE = "shape string, verb string, by string, authored boolean, ord long"


def test_graph_document(spark):
    text = """{"nodes": [{"id": "a", "type": "file", "name": "A", "summary": "what a is", "lines": 3, "aliases": ["x"]}, {"id": "a", "type": "file", "name": "A", "summary": "what a is", "lines": 3, "aliases": ["x"]},
    {"label": "B"}, {"id": null, "type": "t"}], "links": [{"source": "a", "target": "B", "type": "uses", "weight": 1.5, "direction": "forward"}, {"from": "a", "to": "gone", "predicate": "uses"}, {"from": "a", "to": "a"}, {"from": "a", "subject": "b", "to": "a", "type": "t", "direction": "back"}]}"""
    docs = spark.createDataFrame([("d", text), ("broken", '{"nodes": [\n  {]}'), ("none", None), ("list", "[1]"), ("other", '{"a": 1}'), ("two", '{"nodes": [], "entities": [{"id": "q"}]}'), ("clash", '{"nodes": [{"id": "q", "n": 1}, {"id": "q", "n": 2}], "edges": []}')], "source string, text string")
    got = read_graphs(docs)
    mine = F.col("prov.source") == "d"
    assert sorted((r.id, r.type, r.name, r.attributes, tuple(r.aliases)) for r in got.entities.filter(mine).collect()) == [("B", "", "B", "{}", ()), ("a", "file", "A", '{"lines":"3"}', ("x",))]
    assert [(r.from_id, r.type, r.to_id, r.attributes) for r in got.relations.filter(mine).orderBy("ord").collect()] == [("a", "uses", "B", '{"weight":"1.5"}'), ("a", "uses", "gone", "{}"), ("a", "t", "a", "{}")]
    assert [(r.idx, r.text) for r in got.chunks.collect()] == [(0, "what a is")]
    assert [r.chosen_as for r in got.guesses.collect()] == ["B"]
    assert [(r.to_id, r.missing) for r in got.dangling.collect()] == [("gone", ["gone"])]
    said = sorted((r.source, r.kind, r.place) for r in got.defects.collect())
    assert said == [("broken", "malformed_json", "line 2, column 4"), ("clash", "duplicate_node", "nodes[0]"), ("d", "ambiguous_field", "edges[3]"), ("d", "missing_field", "edges[2]"), ("d", "missing_field", "nodes[3]"), ("d", "unknown_direction", "edges[3]"), ("list", "malformed_json", "$"), ("list", "no_graph", "$"), ("none", "malformed_json", "line 1, column 1"), ("other", "no_graph", "$"), ("two", "ambiguous_field", "$")]


def test_shapes_drop_instances_and_order(spark):
    side = lambda p, m: (F.lit(p), F.lit(m))
    one = queue.shape(F.lit("conflict"), F.lit("attr"), side("model", "m/1"), side("ddl", None), F.lit("T"))
    two = queue.shape(F.lit("conflict"), F.lit("attr"), side("ddl", None), side("model", "m/1"), F.lit("T"))
    other = queue.shape(F.lit("conflict"), F.lit("attr/T"), side("ddl", None), side("model", "m/1"))
    row = spark.range(1).select(one.alias("a"), two.alias("b"), other.alias("c")).first()
    assert row.a == row.b != row.c


def test_queue_decisions_and_rules(spark):
    items = spark.createDataFrame([("conflict", "x", "c", 1), ("conflict", "x", "c", 2), ("duplicate", "p", "d", 3), ("violation", "v", "v", 4), ("duplicate", "q", None, 5)], ITEM)
    rules = spark.createDataFrame([("d", "always", "ann", True, 1), ("d", "reject", "bob", False, 2), ("c", "reject", "ann", True, 3), ("", "always", "z", False, 4)], RULE)
    asked = queue.build(items, rules, False)
    assert sorted(r.item_id for r in asked.collect()) == ["conflict:x", "conflict:x#2", "duplicate:p"]
    full = queue.build(items, rules, True)
    assert full.count() == 5
    decisions = spark.createDataFrame([("conflict:x", "always", "eve", None, 1), ("nothing", "accept", "eve", None, 2), ("violation:v", "accept", "eve", None, 3), ("violation:v", "reject", "eve", None, 4)], "item_id string, verb string, by string, edit string, ord long")
    assert sorted(map(tuple, queue.decision_defects(full, decisions).collect())) == [("nothing", "unknown_item"), ("violation:v", "two_decisions")]
    out = queue.resolve(full, decisions, rules)
    assert {r.item_id: (r.verb, r.by, r.via) for r in out.collect()} == {"conflict:x": ("always", "eve", "decision"), "conflict:x#2": (None, None, None), "duplicate:p": ("always", "ann", "rule"), "violation:v": ("accept", "eve", "decision"), "duplicate:q": (None, None, None)}
    assert [r.item_id for r in queue.open_questions(out, False).collect()] == ["conflict:x#2"]
    assert [(r.shape, r.by, r.because) for r in queue.standing_rules(full, decisions).collect()] == [("c", "eve", "conflict:x")]
    found = spark.createDataFrame([("conflict:x", "kim"), ("duplicate:p", ""), ("conflict:x#2", "kim")], "item_id string, reviewed_by string")
    assert sorted(map(tuple, queue.stamped(found, out).collect())) == [("conflict:x", "kim, eve"), ("conflict:x#2", "kim"), ("duplicate:p", "ann")]


def test_authored_rules(spark):
    fields = "name string, kind string, signal string, producer string, verb string, by string, because string, at string"
    rules = spark.createDataFrame([("good", "duplicate", "name_affix", "model", "reject", "ann", "why", "2026"), ("bad", "conflict", None, "human", "accept", " ", None, "2026"), ("alias", "duplicate", "alias", None, "always", "a", "b", "c")], fields)
    assert sorted(map(tuple, queue.authored_defects(rules).collect())) == [("alias", "signal"), ("bad", "conflict"), ("bad", "no_because"), ("bad", "no_by"), ("bad", "producer"), ("bad", "verb")]
    named = spark.createDataFrame([("a", "x"), ("b", None), ("a", "x")], "name string, told string")
    one, two = queue.rule_set(named).first(), queue.rule_set(named.orderBy(F.desc("name"))).first()
    assert one == two and len(one.rule_set) == 16 and one.n == 2


def test_reopened(spark):
    before = spark.createDataFrame([("k", "a")], "kind string, subject string")
    after = spark.createDataFrame([("k", "a"), ("k", "b")], "kind string, subject string")
    assert [r.subject for r in queue.reopened(before, after).collect()] == ["b"]
