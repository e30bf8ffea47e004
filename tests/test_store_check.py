"""Store, preflight, the check stage and decisions on small graphs."""

import pytest

from tessera.operators import apply, check, load, preflight, recall, verify

PROV = "struct<source:string,chunk:int,producer:string,by:string,at:string,ontology:string>"
NODE = f"id string, type string, name string, attributes string, prov {PROV}, ord long"
EDGE = f"from_id string, type string, to_id string, key string, attributes string, prov {PROV}, ord long"


def prov(producer="model", source="d", chunk=-1, by=None, at=None):
    return (source, chunk, producer, by, at, None)


def nodes(spark, *rows):
    return spark.createDataFrame([(i, t, n, "{}", p, o) for o, (i, t, n, p) in enumerate(rows)], NODE)


def edges(spark, *rows):
    return spark.createDataFrame([(f, t, to, k, a, p, o) for o, (f, t, to, k, a, p) in enumerate(rows)], EDGE)


def graph(spark, name="A"):
    return {"entities": nodes(spark, ("a", "T", name, prov()), ("a", "t ", name, prov("ddl")), ("b", "T", "B", prov())), "relations": edges(spark, ("a", "R", "b", "", "{}", prov()))}


def test_replacing_one_load_leaves_others_and_readers_see_whole_loads(spark, tmp_path):
    store = load.Store(spark, tmp_path.as_uri())
    assert store.load("A", graph(spark, "one")).status == "written"
    assert store.load("B", graph(spark, "two")).corroborated == 1
    with pytest.raises(load.Held):
        store.load("B", graph(spark, "three"))
    assert store.load("B", graph(spark, "three"), replace=True).status == "written"
    names = lambda: sorted((r.load_id, r.name) for r in store.read("entities").filter("id = 'a'").collect())
    assert names() == [("A", "one"), ("B", "three")]
    assert {r.name for r in recall.whole(store, "B")[0].collect()} == {"three", "B"}
    # the same content under another name, or none, is there already
    assert store.load("C", graph(spark, "one")).load_id == "A" and store.load("", graph(spark, "three")).load_id == "B"
    assert store.load("", graph(spark, "four")).load_id.startswith("ld_")
    # an unfinished write of a new version is never seen
    graph(spark, "half")["entities"].write.parquet(f"{tmp_path.as_uri()}/entities/half")
    assert ("A", "half") not in names() and len(names()) == 3
    assert store.delete("A") and not store.delete("A")
    assert [n for n in names() if n[0] == "A"] == []
    with pytest.raises(recall.NoLoad):
        recall.whole(store, "A")
    assert store.sweep() >= 3 and ("B", "three") in names()


def test_vectors_of_another_width_or_model_are_refused(spark, tmp_path):
    store = load.Store(spark, tmp_path.as_uri())
    vectors = lambda n, model: spark.createDataFrame([(0, [0.5] * n, model, 0)], "chunk int, values array<float>, model string, ord int")
    assert store.load("A", {**graph(spark, "one"), "vectors": vectors(4, "m")}).status == "written"
    for bad in (vectors(5, "m"), vectors(4, "n")):
        with pytest.raises(load.Held):
            store.load("B", {**graph(spark, "two"), "vectors": bad})
    assert store.load("B", {**graph(spark, "two"), "vectors": vectors(4, "m")}).status == "written"


def test_digest_ignores_order_and_sees_every_part(spark):
    one = graph(spark)
    assert load.digest(one) == load.digest({k: v.orderBy("ord", ascending=False).repartition(3) for k, v in one.items()})
    assert load.digest(one) != load.digest(graph(spark, "other")) != load.digest({**one, "chunks": spark.range(1)})


def test_all_refusing_defects_are_named(spark):
    bad = {
        "entities": nodes(spark, ("a", "T", "A", prov()), ("a", "U", "A", prov()), ("h", "T", "H", prov("human", by="ann")), ("g", "T", "G", prov("human", by="ann", at="2024-01-01"))),
        "relations": edges(spark, ("a", "R", "h", "", "[1]", prov("human", chunk=9))),
        "chunks": spark.createDataFrame([(0,), (0,), (1,)], "idx int"),
        "vectors": spark.createDataFrame([(0, [1.0], 0), (1, [1.0, 2.0], 1), (5, [], 2)], "chunk int, values array<float>, ord int"),
        "conflicts": spark.createDataFrame([("k", "s2", "ann", None, 1), ("k", "s1", None, "", 2)], "kind string, subject string, left_reviewed_by string, right_reviewed_by string, ord int"),
    }
    found = sorted((r.kind, r.subject, r.severity) for r in preflight.check(bad).collect())
    assert found == [
        ("assertion_unsigned", "a -[R]-> h", "report"), ("assertion_unsigned", "h", "report"), ("attribute_type", "array", "report"), ("chunk_index_reused", "0", "refuse"),
        ("entity_id_reused", "a", "refuse"), ("held", "s1", "refuse"), ("provenance_without_chunk", "9", "report"), ("vector_empty", "5", "refuse"), ("vector_width", "1", "refuse"), ("vector_without_chunk", "5", "refuse"),
    ]
    with pytest.raises(preflight.Refused, match="chunk_index_reused.*entity_id_reused.*held.*vector_empty.*vector_width"):
        preflight.refuse(bad)
    preflight.refuse({k: v for k, v in graph(spark).items()})


def vocabulary(spark, types=(), kinds=(), ontology=""):
    return check.Vocabulary(spark.createDataFrame(list(types), "name string, attributes array<string>"), spark.createDataFrame(list(kinds), "name string, from_types array<string>, to_types array<string>, both_ways boolean, at_most_one_in boolean, at_most_one_out boolean"), ontology)


def test_an_empty_vocabulary_under_a_name_refuses_all_types_and_none_refuses_nothing(spark):
    e, r = graph(spark)["entities"], edges(spark, ("a", "R", "b", "", "{}", prov()), ("a", "R", "z", "", "{}", prov()))
    assert {v.kind for v in check.check(e, r, vocabulary(spark)).violations.collect()} == {"dangling_relation"}
    named = check.check(e, r, vocabulary(spark, ontology="o@1"))
    assert sorted(v.kind for v in named.violations.collect()) == ["dangling_relation"] + ["unknown_entity_type"] * 3 + ["unknown_relation_type"] * 2
    assert {x.prov.ontology for x in named.entities.collect()} == {"o@1"}
    row = named.counts.first()
    assert (row.entities, row.relations, row.violations, row.inferred) == (3, 2, 6, 2)


def test_directions_are_asked_only_of_declared_one_way_types(spark):
    pair = [("a", "R", "b", "", "{}", prov("model")), ("b", "R", "a", "", "{}", prov("ddl")), ("b", "R", "a", "", "{}", prov("model"))]
    e = nodes(spark, ("a", "T", "A", prov()), ("b", "T", "B", prov()))
    kinds = lambda both: [("r", [], [], both, False, False)]
    ask = lambda v: sorted((c.kind, c.left_value, c.right_value) for c in check.check(e, edges(spark, *pair), v).conflicts.collect())
    assert ask(vocabulary(spark, [("T", [])], kinds(False))) == [("contradiction", "b -> a", "a -> b"), ("relation_direction", "a -> b", "b -> a")]
    assert ask(vocabulary(spark, [("T", [])], kinds(True))) == ask(vocabulary(spark, [("T", [])])) == ask(None) == []


def test_an_edges_attribute_is_compared_folded_with_its_own_standing_and_as_written_with_the_other(spark):
    said = [("x", "model"), (" X ", "model"), ("X", "ddl"), ("y", "model"), ("Y", "model")]
    rows = edges(spark, *[("a", "R", "b", "", f'{{"v":"{v}"}}', prov(p)) for v, p in said])
    claims = check.edge_claims(rows)
    assert [(c.left_value, c.right_value) for c in check.relation_attribute_conflicts(claims).collect()] == [("x", "y")]
    assert [(c.left_value, c.right_value, c.ord) for c in check.relation_attribute_contradictions(claims).collect()] == [("X", "x", 2)]


def test_a_pair_is_asked_once_except_by_a_name_the_other_way_round(spark):
    rows = [(1, "T", "foo bar", ["qux"], "m"), (2, "T", "qux", [], "ddl"), (3, "T", "foo", [], "m"), (4, "T", "Foo Bar", [], "ddl"), (5, "T", "foo  bar", [], "m")]
    df = spark.createDataFrame([(i, t, n, a, (p,), i) for i, t, n, a, p in rows], "id long, type string, name string, aliases array<string>, prov struct<producer:string>, ord long")
    got = sorted((d.rank, d.signal, d.left_id, d.right_id) for d in check.duplicates(df).collect())
    assert got == [(1, "alias", 2, 1), (2, "name_across_producers", 1, 4), (3, "name_affix", 3, 1), (3, "name_affix", 3, 4), (3, "name_affix", 3, 5)]


def test_decisions_have_one_result_whatever_their_order(spark):
    e = nodes(spark, ("a", "T", "A", prov()), ("a", "T", "A2", prov(source="other")), ("b", "T", "B", prov()), ("c", "T", "C", prov()))
    r = edges(spark, ("a", "R", "b", "k", "{}", prov()), ("b", "R", "c", "", "{}", prov()), ("c", "S", "c", "", "{}", prov()))
    item = lambda i, s, kind="violation", shape="x", source="d": (i, kind, s, shape, int(i), source, -1, "model")
    queue = spark.createDataFrame([item("1", "a"), item("2", "b"), item("3", "c.color"), item("4", "a -[R#k]- b"), item("5", "c", shape="quiet"), item("6", "nobody"), item("7", "b -[R]-> c", shape="quiet")], "item_id string, kind string, subject string, shape string, ord long, source string, chunk int, producer string")
    aimed = apply.targets(queue, e, r)
    assert sorted((t.item_id, t.attr) for t in aimed.collect()) == [("1", None), ("2", None), ("3", "color"), ("4", None), ("5", None), ("7", None)]
    say = lambda *rows: spark.createDataFrame([(i, v, by, t, None, None, None) for i, v, by, t in rows], "item_id string, verb string, by string, edit_type string, edit_name string, edit_from string, edit_to string")
    rules = spark.createDataFrame([("quiet", "reject", "eve", "R1", False, 1)], "shape string, verb string, by string, name string, authored boolean, ord long")
    decisions = say(("1", "edit", "ann", "U"), ("2", "accept", "bob", None), ("2", "accept", "bob", None), ("3", "accept", "ann", None), ("4", "always", "ann", "Q"))
    apply.refuse_bad(queue, decisions, aimed)
    kept, links, dropped = apply.apply(e, r, apply.plan(apply.decided(queue, decisions, rules), aimed))
    # the rule removes c (its other item was read by a person, so it is not counted as dropped) with its edges; the edge from b to c went by the rule, the loop with c
    assert sorted((x.id, x.name, x.type, x.reviewed_by, x.ruled_by) for x in kept.collect()) == [("a", "A", "U", "ann", ""), ("a", "A2", "T", "", ""), ("b", "B", "T", "bob", "")]
    assert [(x.from_id, x.type, x.to_id, x.reviewed_by) for x in links.collect()] == [("a", "Q", "b", "ann")]
    assert dropped.first().n == 2
    counts = apply.recount(kept, links, spark.createDataFrame([(4, 10)], "chunks long, dropped long"), dropped).first()
    assert (counts.chunks, counts.entities, counts.relations, counts.dropped) == (4, 3, 1, 12)
    bad = say(("1", "edit", "ann", None), ("2", "reject", "", None), ("6", "reject", "ann", None), ("8", "accept", "ann", None), ("3", "accept", "ann", None), ("3", "reject", "ann", None), ("4", "shrug", "ann", None))
    with pytest.raises(apply.BadDecisions, match="empty_edit: 1; no_record: 6; two_answers: 3; unknown_item: 8; unknown_verb: 4; unsigned: 2"):
        apply.refuse_bad(queue, bad, aimed)
    with pytest.raises(apply.BadDecisions, match="differently"):
        two = spark.createDataFrame([("9", "violation", "a", "x", 9, "d", -1, "model")], queue.schema).unionByName(queue)
        apply.plan(apply.decided(two, say(("1", "edit", "ann", "U"), ("9", "edit", "bob", "V")), rules), apply.targets(two, e, r))


def test_cardinality_and_values_survive_a_hot_key(spark):
    rows = spark.range(3000).selectExpr("'hub' as from_id", "'R' as type", "concat('t', id % 1500) as to_id", "id as ord")
    got = verify.cardinality_conflicts(rows, [], ["R"])
    assert got.count() == 1499 and {r.left_value for r in got.select("left_value").distinct().collect()} == {"t0"}
