"""Replies of extraction models on small fixtures."""

from pyspark.sql import functions as F

from tessera.sources import replies


def test_decoding():
    assert replies.decoded('so: {"a": "}"} and {"b": 1}') == '{"a": "}"}'
    assert replies.decoded("{'a': [1, 2,],}") == '{"a": [1, 2]}'
    assert replies.decoded('{oops} {"b": "x\\"{"}') == '{"b": "x\\"{"}'
    assert replies.decoded('{"a": {"b": 1}') == '{"b": 1}'
    assert replies.decoded("no") is replies.decoded(None) is replies.decoded("") is None
    assert replies.decoded("{" * 50_000) is None


def test_records(spark):
    text = """Here: {"entities": [{"type": "Person", "name": " Ann  Lee ", "attributes": {"age": 3}, "confidence": 0.5, "aliases": ["A"]}, {"type": "", "name": "x"}],
    "relations": [{"type": "KNOWS", "from": "Ann Lee", "from_type": "Person", "to": "bob", "confidence": 1}, {"type": "KNOWS", "from": {"name": "Bob", "type": "Person"}, "to": "Ann Lee"}, {"type": "KNOWS", "from": "", "to": "b"}],
    "guesses": [{"about": "a", "read_as": "b", "alternatives": ["c"], "why": "d"}, {"about": "a", "read_as": "b", "alternatives": []}],}"""
    rows = spark.createDataFrame([("d", 1, "m", text), ("d", 0, "m", "cut {"), ("d", 2, "m", None), ("d", 3, "m", "{}")], "source string, chunk int, model string, text string")
    got = replies.read_replies(rows)
    assert [(r.id, r.type, r.name, r.attributes, r.aliases, r.prov.confidence, r.ord.chunk) for r in got.entities.collect()] == [("person:ann lee", "Person", "Ann  Lee", '{"age":"3"}', ["A"], 0.5, 1)]
    assert [(r.from_id, r.to_id) for r in got.relations.orderBy("ord").collect()] == [("person:ann lee", ":bob"), ("person:bob", ":ann lee")]
    assert [(r.field, r.chosen_as, r.alternatives) for r in got.guesses.collect()] == [("a", "b", ["c"])]
    assert sorted(r.locator for r in got.unread.collect()) == ["chunk 0", "chunk 2"]


def test_cache(spark):
    chunks = spark.createDataFrame([("p", "m"), ("pm", ""), ("p", None)], "prompt string, model string").withColumn("address", replies.answer_address(F.col("prompt"), F.col("model")))
    assert chunks.select("address").distinct().count() == 3
    hit = chunks.filter("model = 'm'").select("address", F.lit('{"entities": []}').alias("text"), F.lit(1).alias("stored_at"))
    bad = chunks.filter("model = ''").select("address", F.lit("[1]").alias("text"), F.lit(2).alias("stored_at"))
    found, ask = replies.cached(chunks, hit.unionByName(bad))
    assert [r.prompt for r in found.collect()] == ["p"] and ask.count() == 2
