"""Files, statements, vocabularies, mappings, models and rows for other stores on small fixtures."""

import json

import pytest
from pyspark.sql import functions as F

from tessera.operators import check, embed, extract, load, numbering, writers
from tessera.sources import assertions, chunking, documents, infer, replies, vocabulary

PROV = "struct<source:string,chunk:int,producer:string,model:string,confidence:double>"


def test_files_are_known_by_bytes_then_by_name(spark):
    rows = [("a.txt", "plain"), ("b.md", "# Title"), ("c.txt", " \n<!DOCTYPE html><p>Hi &amp; bye</p>"), ("d.htm", "<p>One</p>"), ("e.pdf", "%PDF-1.7 text"), ("f.bin", "a\0b"), ("g.sql", "create table t (id int)"), ("h.csv", "a,b"), ("i.json", "{}"), ("j.txt", b"\xff\xfe\xfd" * 9), ("k.txt", ""), ("l.txt", "é" * 600), ("m.txt", "﻿mark")]
    df = spark.createDataFrame([(s, bytearray(c if isinstance(c, bytes) else c.encode())) for s, c in rows], "source string, content binary")
    kinds = {r.source: r.kind for r in df.withColumn("kind", documents.kind_of(F.col("source"), F.col("content"))).collect()}
    assert kinds == {"a.txt": "text", "b.md": "markdown", "c.txt": "html", "d.htm": "html", "e.pdf": "pdf", "f.bin": "binary", "g.sql": "ddl", "h.csv": "table", "i.json": "graph", "j.txt": "binary", "k.txt": "text", "l.txt": "text", "m.txt": "text"}
    got = documents.read_texts(df)
    texts = {r.source: r.text for r in got.texts.collect()}
    assert texts["m.txt"] == "mark" and texts["c.txt"].strip() == "Hi & bye" and texts["k.txt"] == "" and set(texts) == {"a.txt", "b.md", "c.txt", "d.htm", "k.txt", "l.txt", "m.txt"}
    assert sorted(r.source for r in got.unread.collect()) == ["e.pdf", "f.bin", "j.txt"]

    def reader(content):
        if b"text" not in content:
            raise ValueError("no text")
        return "from paper"

    papers = spark.createDataFrame([("e.pdf", bytearray(b"%PDF-1 text")), ("x.pdf", bytearray(b"%PDF-1"))], "source string, content binary")
    got = documents.read_texts(papers, reader)
    assert [(r.source, r.text) for r in got.texts.collect()] == [("e.pdf", "from paper")] and [r.source for r in got.unread.collect()] == ["x.pdf"]


def test_statements_must_be_signed_and_dated(spark):
    rows = [("Person", "Ann B", "KNOWS", "Person", "Bob", "eve", "2024-01-01", "met"), ("Person", "Ann B", None, None, None, "eve", "2024-01-02", None), ("Person", "X", "KNOWS", "Person", "Y", "", "2024-01-01", None), ("Person", "Z", "KNOWS", "Person", None, "eve", None, None)]
    df = spark.createDataFrame(rows, "subject_type string, subject string, predicate string, object_type string, object string, by string, at string, note string")
    nodes, edges = assertions.asserted(df, "desk")
    assert sorted((n.id, n.prov.by) for n in nodes.collect()) == [("person:ann b", "eve"), ("person:ann b", "eve"), ("person:bob", "eve")]
    assert [(e.from_id, e.type, e.to_id, e.attributes, e.prov.producer) for e in edges.collect()] == [("person:ann b", "KNOWS", "person:bob", '{"note":"met"}', "human")]
    assert sorted((d.subject, d.defect) for d in assertions.defects(df).collect()) == [("X", "unsigned"), ("Z", "no_object"), ("Z", "undated")]


DOC = {"id": "trade@3", "parts": {"prose": {"entities": [{"name": "Company", "attributes": ["city"]}, {"name": "Person"}], "relations": [{"name": "WORKS_FOR", "from": ["Person"], "to": ["Company"]}, {"name": "MEETS"}]}}}


@pytest.mark.parametrize(("change", "said"), [({"id": "trade"}, "name@version"), ({"parts": {}}, "no parts"), ({"parts": {"poem": DOC["parts"]["prose"]}}, "unknown"), ({"parts": {"prose": {"entities": [{"name": "A"}, {"name": "a "}]}}}, "twice"), ({"parts": {"prose": {"entities": [{"name": "A"}], "relations": [{"name": "R", "form": ["A"]}]}}}, "form"), ({"parts": {"prose": {"entities": [{"name": "A"}], "relations": [{"name": "R", "to": ["B"]}]}}}, "not declared"), ({"parts": {"prose": {"entities": []}}}, "no entity types")])
def test_bad_vocabularies_are_refused(change, said):
    with pytest.raises(vocabulary.BadVocabulary, match=said):
        vocabulary.load(json.dumps({**DOC, **change}))


def test_accepted_proposals_extend_a_vocabulary(spark):
    doc = vocabulary.load(json.dumps(DOC))
    ask = lambda kind, name, a=(), b=(): {"kind": kind, "type": name, "from_types": list(a), "to_types": list(b), "records": 2}
    wider, added = vocabulary.extend(doc, "prose", [ask("entity", "Town"), ask("entity", "company"), ask("relation", "LIVES_IN", ["Person"], ["Town"]), ask("attribute", "Size", ["Company"]), ask("relation_ends", "works_for", ["Company"], ["Company"])], "ann", "2024-01-01")
    assert (wider["id"], added, doc["id"]) == ("trade@4", ["Company.Size", "LIVES_IN", "Town", "works_for"], "trade@3")
    v = vocabulary.tables(spark, wider, "prose")
    assert v.governs() and {r.name: (r.from_types, r.to_types) for r in v.relation_types.collect()}["WORKS_FOR"] == (["Person", "Company"], ["Company"])
    assert "- WORKS_FOR: Person | Company -> Company" in vocabulary.prompt(wider, "prose") and "- MEETS: any -> any" in vocabulary.prompt(wider, "prose")
    for bad in (ask("relation", "X", ["Person"], []), ask("attribute", "a", []), ask("attribute", "a", ["Nobody"]), ask("relation_ends", "MEETS", ["Person"]), ask("relation_ends", "NONE", ["Person"]), ask("", "x")):
        with pytest.raises(vocabulary.BadVocabulary):
            vocabulary.extend(doc, "prose", [bad], "ann", "2024-01-01")
    with pytest.raises(vocabulary.BadVocabulary, match="nobody"):
        vocabulary.extend(doc, "prose", [], " ", "2024-01-01")


def test_mappings_are_inferred_with_reasons(spark):
    df = spark.range(300).selectExpr("cast(id as string) as o_orderkey", "cast(id % 7 as string) as o_custkey", "concat('Order ', id) as o_name", "if(id % 3 = 0, null, 'x') as o_note", "cast(null as string) as o_blank")
    mapping, guesses = infer.infer("orders", infer.profile(df), ["Cust", "Nation"])
    assert (mapping.entity_type, mapping.id_column, mapping.name_column, mapping.attributes) == ("Order", "o_orderkey", "o_name", {"o_note": "o_note"})
    assert [(r.column, r.target_type) for r in mapping.relations] == [("o_custkey", "Cust")]
    mapping.check(df.columns)
    assert any(line.startswith("o_orderkey: id (") and "or o_name" in line for line in infer.rendered(guesses))
    assert [infer.singular(w) for w in ("cities", "boxes", "status", "class", "orders", "bus")] == ["city", "box", "status", "class", "order", "bus"]
    assert infer.camel("line_items") == "LineItems" and infer.words("orderIDNumber2") == ["order", "id", "number", "2"]
    reply = 'Sure: {"entity_type": "Order", "id_column": "o_orderkey", "attributes": {"o_note": ""}, "relations": [{"column": "o_custkey", "relation_type": "BY", "target_type": "Customer"}], "reasons": {"o_note": "free text"},}'
    mapping, guesses = infer.mapping_of(reply, df.columns)
    assert mapping.attributes == {"o_note": "o_note"} and {g.column: g.why for g in guesses}["o_note"] == "free text"
    with pytest.raises(ValueError):
        infer.mapping_of(reply.replace("o_custkey", "nowhere"), df.columns)
    with pytest.raises(ValueError):
        infer.infer("t", infer.profile(df.limit(0)))


def test_numbers_are_consecutive_in_order(spark):
    rows = spark.range(1000).selectExpr("id * 7919 % 1000 as k", "id").repartition(5)
    got = sorted(map(tuple, numbering.numbered(rows, ["k"], "n").select("k", "n").collect()))
    assert got == [(k, k) for k in range(1000)] and numbering.numbered(rows.limit(0), ["k"]).count() == 0


def test_chunks_have_byte_offsets_and_numbers_through_the_job(spark):
    texts = [("b", "Ärger über alles. " * 40), ("a", "plain words here. " * 40), ("c", "\U0001F600 " * 50), ("d", None)]
    df = spark.createDataFrame(texts, "source string, text string")
    got = chunking.chunks(df, chunking.Options("fixed", 50)).collect()
    whole = {s: (t or "").encode() for s, t in texts}
    assert all(whole[r.source][r.start_byte : r.end_byte].decode() == r.text for r in got) and {r.source for r in got} == {"a", "b", "c"}
    again = extract.renumbered(chunking.chunks(df, chunking.Options("fixed", 50))).orderBy("idx").collect()
    assert [(r.idx, r.source, r.place) for r in again] == [(i, *k) for i, k in enumerate(sorted((r.source, r.idx) for r in got))]


def test_objects_in_replies():
    for text, want in (('x {"a": "}"} y', {"a": "}"}), ('{"a": "\\\\"} tail {"b": 1}', {"a": "\\"}), ('{"a": "\\"}{"}', {"a": '"}{'}), ('{bad} {"b": [1,]}', {"b": [1]}), ("{'c': 2}", {"c": 2})):
        assert json.loads(replies.decoded(text)) == want, text
    assert replies.decoded("none {") is None and replies.decoded(None) is None


def fake(texts):
    """Vectors by the first letter; a text that says so makes the call fail."""
    if any("fail" in t for t in texts):
        raise RuntimeError("refused")
    return [[1.0, 0.0] if t.strip()[:1] < "m" else [0.0, 1.0] for t in texts]


def test_embedding_and_chunks_of_one_subject(spark):
    chunks = spark.createDataFrame([("s", 0, "abc"), ("s", 1, "  "), ("s", 2, "xyz"), ("t", 3, "fail here")], "source string, idx int, text string")
    vectors, unread = embed.embedded(chunks, fake, "toy", 1)
    assert sorted((v.chunk, list(v.values), v.model) for v in vectors.collect()) == [(0, [1.0, 0.0], "toy"), (2, [0.0, 1.0], "toy")] and [(u.source, u.locator, u.reason) for u in unread.collect()] == [("t", "chunk 3", "refused")]
    short = embed.embedded(chunks.filter("idx = 0"), lambda t: [], "toy")[1].first()
    assert short.reason == "0 vectors for 1 texts"
    text = "a one.\n\nb two.\n\nx three.\n\nz four.\n\nc five."
    docs = spark.createDataFrame([("d", text), ("same", "a a.\n\nb b.\n\nc c."), ("one", "a word"), ("none", "")], "source string, text string")
    made, unread = embed.semantic_chunks(docs, fake)
    got = {}
    for c in made.orderBy("source", "idx").collect():
        got.setdefault(c.source, []).append(c.text)
    assert got == {"d": ["a one.\n\nb two.", "x three.\n\nz four.", "c five."], "same": ["a a.\n\nb b.\n\nc c."], "one": ["a word"]} and unread.count() == 0


def reader(prompts):
    text = prompts[0].rsplit("\n", 2)[1]
    if "fail" in text:
        raise RuntimeError("down")
    if "prose" in text:
        return ["no object at all"]
    names = text.split()
    return [json.dumps({"entities": [{"type": "Word", "name": n} for n in names], "relations": [{"from": {"name": a, "type": "Word"}, "type": "BEFORE", "to": {"name": b}} for a, b in zip(names, names[1:])]})]


def test_a_job_from_texts_to_a_stored_graph(spark, tmp_path):
    rows = [("a", 0, "one two"), ("a", 1, "two three"), ("b", 2, "fail"), ("b", 3, "only prose"), ("b", 4, " "), ("b", 5, "one two"), ("c", 6, "")]
    chunks = spark.createDataFrame(rows, "source string, idx int, text string")
    nodes = spark.createDataFrame([("Word", [])], "name string, attributes array<string>")
    edges = spark.createDataFrame([("BEFORE", [], [], False, False, False)], "name string, from_types array<string>, to_types array<string>, both_ways boolean, at_most_one_in boolean, at_most_one_out boolean")
    out = extract.run(chunks, reader, "toy", "Find words.", vocabulary=check.Vocabulary(nodes, edges, "w@1"))
    assert {r.outcome: r["count"] for r in out.accounts.groupBy("outcome").count().collect()} == {"read": 3, "unread": 2, "blank": 2}
    assert sorted(u.reason for u in out.unread.collect()) == ["down", "the reply holds no JSON object"]
    assert sorted(e.id for e in out.graph["entities"].collect()) == ["word:one", "word:three", "word:two"]
    assert sorted((e.from_id, e.to_id) for e in out.graph["relations"].collect()) == [("word:one", "word:two"), ("word:two", "word:three")]
    counts = extract.counted(out).first()
    assert (counts.entities, counts.relations, counts.violations, counts.chunks, counts.chunks_unread, counts.chunks_empty) == (3, 2, 0, 7, 2, 2)
    assert out.answers.count() == 3
    store = load.Store(spark, tmp_path.as_uri())
    assert extract.stored(out, store, "job").status == "written"
    assert store.read("entities").count() == 3 and store.read("counts").first().relations == 2
    # standing answers are not asked again, and a spent budget is named
    standing = out.answers.withColumn("stored_at", F.current_timestamp())
    calls = lambda prompts: (_ for _ in ()).throw(RuntimeError("asked"))
    again = extract.run(chunks, calls, "toy", "Find words.", vocabulary=check.Vocabulary(nodes, edges, "w@1"), standing=standing, calls=0)
    assert sorted(u.reason for u in again.unread.collect()) == ["the budget is spent", "the budget is spent"] and again.graph["entities"].count() == 3
    kept = extract.kept_answers(spark.sql("select 'a' as address, timestamp'2024-01-01 00:00:00' as stored_at, timestamp'2024-01-01 01:00:00' as used_at union all select 'b', timestamp'2024-01-01 00:30:00', timestamp'2024-01-01 00:31:00' union all select 'c', timestamp'2023-01-01', timestamp'2024-01-01 01:10:00'"), F.lit("2024-01-01 01:20:00").cast("timestamp"), 86400, 1)
    assert [k.address for k in kept.collect()] == ["a"]


def test_rows_for_other_stores(spark):
    entities = spark.createDataFrame([("a", "T", "A", '{"x":{"y":1},"z":"q"}', ("d", 0, "model", None, 0.5), 1), ("b", "T", "", "{}", ("d", -1, "ddl", "m", None), 2)], f"id string, type string, name string, attributes string, prov {PROV}, ord long")
    relations = spark.createDataFrame([("a", "R", "b", k, '{"n":1}', (s, 0, "model", None, None), o) for o, (k, s) in enumerate([("k1", "d"), ("k2", "d"), ("", "e")])] + [("a", "R", "z", "", None, ("d", -1, "model", None, None), 9)], f"from_id string, type string, to_id string, key string, attributes string, prov {PROV}, ord long")
    nodes = {r.id: r for r in writers.property_nodes(entities, "L").collect()}
    assert nodes["a"].properties == {"x": '{"y":1}', "z": "q", "name": "A", "prov_load": "L", "prov_source": "d", "prov_chunk": "0", "prov_producer": "model", "prov_confidence": "0.5"} and nodes["a"].encoded == ["x"]
    assert nodes["b"].properties == {"prov_load": "L", "prov_source": "d", "prov_producer": "ddl", "prov_model": "m"} and nodes["b"].labels == ["Node", "T"]
    assert writers.property_edges(relations, "L").count() == 4
    chunks, vectors = spark.createDataFrame([("d", 0, "text")], "source string, idx int, text string"), spark.createDataFrame([(0, [1.0, 2.0])], "chunk int, values array<float>")
    points = {r.kind: r for r in writers.points(entities, relations, chunks, vectors, "L").filter("kind = 'chunk' or payload like '%\"to_id\":\"z\"%'").collect()}
    assert json.loads(points["relation"].payload)["dangling"] is True and json.loads(points["chunk"].payload)["entity_names"] == ["A"] and list(points["chunk"]["values"]) == [1.0, 2.0]
    ids = [r.point for r in writers.points(entities, relations, chunks, vectors, "L").collect()]
    assert len(set(ids)) == len(ids) == 7 and all(len(i) == 36 for i in ids)
    edges, lost = writers.facets(relations)
    assert edges.count() == 2 and [(r.to_id, r.merged) for r in lost.collect()] == [("b", 2)]
    assert sorted((r.document, r.kind) for r in writers.brain(entities, relations).collect()) == [("d", "entity")] * 2 + [("d", "relation")] * 2 + [("e", "relation")]
    assert writers.guard_width(vectors) == 2
    with pytest.raises(writers.WidthMismatch):
        writers.guard_width(vectors.unionByName(spark.createDataFrame([(1, [1.0])], "chunk int, values array<float>")))
    found = writers.findings("violation", relations.select("from_id", "type").distinct(), "L").collect()
    assert len(found) == 1 and json.loads(found[0].body) == {"from_id": "a", "type": "R"}
    sizes = writers.batched(spark.range(1000).repartition(3), 100).groupBy("batch").count().agg(F.max("count"), F.sum("count")).first()
    assert sizes[0] <= 100 and sizes[1] == 1000
