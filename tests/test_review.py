"""Merging of records, review decisions and delimited files on small fixtures."""

import pytest

from tessera.operators import merge, review
from tessera.sources import delimited

PROV = "struct<source:string,chunk:int,producer:string,confidence:double>"
ENTITY = f"id string, type string, name string, attributes string, prov {PROV}, ord long"
EDGE = f"from_id string, type string, to_id string, key string, attributes string, prov {PROV}, ord long"


def prov(source="d", chunk=0, producer="model", confidence=0.5):
    return (source, chunk, producer, confidence)


def entity(spark, *rows):
    return spark.createDataFrame([(i, "T", n, a, p, o) for i, n, a, p, o in rows], ENTITY)


def edge(spark, *rows):
    return spark.createDataFrame([(f, t, to, "", a, prov(), o) for f, t, to, a, o in rows], EDGE)


def test_first_record_stays_and_gaps_are_filled(spark):
    rows = entity(spark, ("a", "A", '{"x":1}', prov(), 1), ("a", "B", '{"x":"1","y\\"":[2]}', prov("e"), 2), ("a", "C", '{"x":1}', prov(), 3), ("b", "B", None, prov(), 4), ("c", "C", "no json", prov(), 5))
    out, clash = merge.merge_entities(rows)
    assert sorted((r.id, r.name, r.attributes) for r in out.collect()) == [("a", "A", '{"x":1,"y\\"":[2]}'), ("b", "B", "{}"), ("c", "C", "{}")]
    assert [(r.subject, r.attr, r.left, r.right) for r in clash.collect()] == [("a", "x", "1", '"1"')]


def test_relations_fold_their_type(spark):
    out = merge.merge_relations(edge(spark, ("a", "USES", "b", '{"n":1}', 1), ("a", " uses ", "b", '{"n":2,"m":3}', 2), ("b", "USES", "a", None, 3)))
    assert sorted((r.from_id, r.type, r.attributes) for r in out.collect()) == [("a", "USES", '{"m":3,"n":1}'), ("b", "USES", "{}")]


def test_only_a_unique_name_resolves(spark):
    nodes = entity(spark, ("a", "One  Thing", "{}", prov(), 1), ("b", "two", "{}", prov(), 2), ("c", "Two", "{}", prov(), 3), ("z", "far", "{}", prov("other"), 4))
    out = merge.resolve_ends(edge(spark, (":one thing", "R", ":two", "{}", 1), ("b", "R", ":far", "{}", 2)), nodes)
    assert sorted((r.from_id, r.to_id) for r in out.collect()) == [("a", ":two"), ("b", ":far")]


def test_low_confidence_asks_once_and_not_about_stated_records(spark):
    rows = entity(spark, ("a", "", "{}", prov(confidence=0.2), 1), ("b", "", "{}", prov(confidence=0.0), 2), ("c", "", "{}", prov(producer="ddl", confidence=0.2), 3), ("d", "", "{}", prov(confidence=0.3), 4), ("e", "", "{}", prov(confidence=0.5), 5))
    asked = spark.createDataFrame([("d",)], "subject string")
    assert [r.subject for r in review.low_confidence(rows, 0.5, asked).collect()] == ["a"]


def test_merges_are_transitive_and_drop_only_new_loops(spark):
    nodes = entity(spark, ("a", "A", '{"x":1}', prov(), 3), ("b", "B", '{"x":2,"y":2}', prov(), 1), ("c", "C", '{"y":3,"z":3}', prov(), 2), ("d", "D", "{}", prov(), 4))
    edges = edge(spark, ("b", "R", "a", "{}", 1), ("c", "R", "d", "{}", 2), ("b", "R", "d", "{}", 3), ("d", "R", "d", "{}", 4))
    merges = spark.createDataFrame([("c", "b"), ("b", "a")], "id string, into string")
    out, left = review.merge_into(nodes, edges, merges)
    assert sorted((r.id, r.name, r.attributes, r.ord) for r in out.collect()) == [("a", "A", '{"x":1,"y":2,"z":3}', 3), ("d", "D", "{}", 4)]
    assert sorted((r.from_id, r.to_id, r.ord) for r in left.collect()) == [("a", "d", 2), ("d", "d", 4)]


@pytest.mark.parametrize("pairs", [[("a", "b"), ("b", "a")], [("a", "a")], [("a", "b"), ("a", "c")], [("a", "b"), ("b", "c"), ("c", "b")]])
def test_circles_are_refused(spark, pairs):
    with pytest.raises(review.MergeCycle):
        review.survivors(spark.createDataFrame(pairs, "id string, into string"))


def test_long_chain(spark):
    chain = spark.createDataFrame([(str(i), str(i - 1)) for i in range(1, 40)], "id string, into string")
    assert {r.survivor for r in review.survivors(chain).collect()} == {"0"}


def test_reject_takes_edges_along_and_empties_chunks(spark):
    nodes = entity(spark, ("a", "", "{}", prov(chunk=1), 1), ("b", "", "{}", prov(chunk=2), 2))
    kept, edges = review.reject(nodes, edge(spark, ("a", "R", "b", "{}", 1), ("a", "R", "c", "{}", 2)), spark.createDataFrame([("b",)], "id string"))
    assert [r.id for r in kept.collect()] == ["a"] and [r.to_id for r in edges.collect()] == ["c"]
    chunks = spark.createDataFrame([("d", 1), ("d", 2), ("d", 3)], "source string, idx int")
    assert sorted(r.idx for r in review.surviving_chunks(chunks, nodes, kept).collect()) == [1, 3]


def test_footprint_counts_sources_of_edges_too(spark):
    nodes = entity(spark, ("a", "", "{}", prov("x"), 1), ("a", "", "{}", prov("y"), 2), ("b", "", "{}", prov(""), 3))
    out = review.footprint(nodes, edge(spark, ("a", "R", "a", "{}", 1), ("a", "R", "c", "{}", 2)))
    assert sorted((r.id, r.sources, r.degree) for r in out.collect()) == [("a", 3, 3), ("b", 0, 0), ("c", 1, 1)]


def test_sniff():
    assert delimited.sniff(["a;b\n", '"x,;y";2\n']) == ";"
    assert delimited.sniff(["one\n", "two\n"]) == ","
    with pytest.raises(delimited.DelimiterError):
        delimited.sniff(["a,b;c\n", "1,2;3\n"])
    with pytest.raises(delimited.DelimiterError):
        delimited.sniff(["a,b\n", "1,2,3\n"])


def test_scan(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_bytes(b'\xef\xbb\xbf id ,,"na""me"\n1,x,"a, b"\n2,,\n3,4\n5,6,7,8\n')
    got = delimited.scan(spark, str(path), ",")
    assert got.columns == ["id", 'na"me']
    rows = got.rows.orderBy("ord").collect()
    assert [tuple(r)[:2] for r in rows] == [("1", "a, b"), ("2", "")]
    assert sorted((r.kind, r.detail) for r in got.violations.collect()) == [("malformed_row", "3,4"), ("malformed_row", "5,6,7,8"), ("unnamed_column", "2")]
    assert got.violations.filter("kind = 'malformed_row'").count() == 2


def test_bad_headers(spark, tmp_path):
    (tmp_path / "e.csv").write_text("")
    (tmp_path / "d.csv").write_text("a,a\n1,2\n")
    for name in ("e.csv", "d.csv"):
        with pytest.raises(delimited.HeaderError):
            delimited.scan(spark, str(tmp_path / name))
