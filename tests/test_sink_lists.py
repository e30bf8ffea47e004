"""Batch files, sinks and the inverted file."""

import json

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.operators import load, recall, sink
from tessera.operators.lists import VectorLists
from tessera.sources import batch_files
from tests.test_store_check import graph


def test_batches_are_bounded_by_rows_and_bytes():
    big = pa.RecordBatch.from_pydict({"x": ["a" * 10] * 100})
    for rows, size in ((7, 1 << 20), (1000, 200), (1000, 1), (3, 100)):
        out = list(batch_files.bounded([big, big.slice(0, 0), big.slice(0, 5)], rows, size))
        assert sum(map(len, out)) == 105 and max(map(len, out)) <= rows
        assert pa.Table.from_batches(out).column("x").to_pylist() == ["a" * 10] * 105
    assert max(len(b) for b in batch_files.bounded([big], 1000, 200)) <= 200 // 10


@pytest.fixture()
def files(spark, tmp_path):
    batch_files.register(spark)
    return lambda name: f"{tmp_path.as_uri()}/{name}"


def test_round_trip_with_pushed_filters(spark, files):
    df = spark.range(1000).repartitionByRange(4, "id").selectExpr("id", "cast(id % 7 as string) as s", "if(id % 5 = 0, null, id / 2) as d", "named_struct('a', id, 'b', array(id)) as r", "map('k', id) as m")
    df.write.format("tessera").mode("append").option("rows", 100).save(files("t"))
    back = spark.read.format("tessera").load(files("t"))
    assert back.schema == df.schema and sorted(map(repr, back.collect())) == sorted(map(repr, df.collect()))
    part = lambda *where: batch_files.read(spark, files("t"), *where)
    some = part(("id", ">=", 990), ("s", "==", "3")).select("id")
    assert sorted(r.id for r in some.collect()) == [i for i in range(990, 1000) if i % 7 == 3]
    assert some.rdd.getNumPartitions() == 1 and back.rdd.getNumPartitions() >= 10
    for condition in ("id >= 990", "d is null or id > 5", "d > 490", "id < 0"):  # one DataFrame answers one question after the other
        assert back.filter(condition).count() == df.filter(condition).count()
    assert part(("id", "in", [1, 999])).rdd.getNumPartitions() == 2 and part(("id", "<", 0)).count() == 0 and part(("d", "<=", 3.0)).count() == df.filter("d <= 3").count()
    with pytest.raises(Exception, match="written already"):
        df.write.format("tessera").mode("append").save(files("t"))
    assert back.count() == 1000
    df.limit(0).write.format("tessera").mode("append").save(files("none"))
    assert spark.read.format("tessera").load(files("none")).count() == 0 and spark.read.format("tessera").load(files("none")).columns == df.columns


def test_a_failed_task_leaves_nothing(spark, files, tmp_path):
    df = spark.range(100).repartition(4).select("id", F.when(F.col("id") == 50, F.raise_error(F.lit("bad row"))).otherwise(F.col("id")).alias("x").cast("string"))
    with pytest.raises(Exception, match="bad row"):
        df.write.format("tessera").mode("append").option("rows", 5).save(files("t"))
    assert not (tmp_path / "t" / "manifest.json").exists() and not list((tmp_path).glob("t/*.parquet"))
    # files of an attempt that nobody names are invisible, and go with the commit
    (tmp_path / "u").mkdir()
    (tmp_path / "u" / "stray.parquet").write_bytes(b"half")
    spark.range(10).write.format("tessera").mode("append").save(files("u"))
    assert spark.read.format("tessera").load(files("u")).count() == 10 and not (tmp_path / "u" / "stray.parquet").exists()


def test_graph_goes_to_a_sink_whole_or_not_at_all(spark, tmp_path):
    store = sink.FilesSink(spark, tmp_path.as_uri(), rows=1)
    report = sink.load_graph(store, "007", graph(spark))
    assert (report.load_id, report.converged, report.landed) == ("007", False, {"entities": 2, "relations": 1}) and list(report.landed) == ["entities", "relations"]
    assert {(r.id, r.others) for r in store.read("entities", "007").collect()} == {("a", 1), ("b", 0)}
    again = sink.load_graph(store, "other", graph(spark))
    assert again.converged and again.load_id == "007"
    with pytest.raises(load.Held):
        sink.load_graph(store, "007", graph(spark, "new"))
    assert not sink.load_graph(store, "007", graph(spark, "new"), replace=True).converged
    assert {r.name for r in store.read("entities", "007").collect()} == {"new", "B"}
    with pytest.raises(LookupError):
        store.read("chunks", "007")

    class Failing(sink.FilesTx):
        def write(self, kind, records):
            if kind == "relations":
                self.kinds.append(kind)
                raise OSError("disk full")
            return super().write(kind, records)

    real = sink.FilesTx
    sink.FilesTx = Failing
    try:
        with pytest.raises(sink.LoadFailed) as e:
            sink.load_graph(store, "half", graph(spark, "half"))
    finally:
        sink.FilesTx = real
    assert e.value.report.landed == {"entities": 2}
    with pytest.raises(LookupError):
        store.read("entities", "half")
    assert len(list((tmp_path / "entities").iterdir())) == 2  # the load and the one it replaced


def vectors(spark, x):
    return spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "idx long, values array<double>")


@pytest.mark.parametrize("distance", ["cosine", "l2", "ip"])
def test_lists_are_exact_without_probes_and_near_it_with_few(spark, tmp_path, distance):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((20, 8)) * 3
    x = centres[rng.integers(0, 20, 3000)] + rng.standard_normal((3000, 8)) * 0.5
    df = vectors(spark, x)
    index = VectorLists.build(df, f"{tmp_path.as_uri()}/i", distance, lists=20)
    assert index.rows.sum() == 3000 and len(list((tmp_path / "i" / "lists").glob("list=*"))) == len(index.list) == 20
    hits = scanned = 0
    for q in x[::300]:
        want = [(r.idx, r.distance) for r in recall.vector_search(df, q.tolist(), 10, distance).collect()]
        got = [(r.idx, r.distance) for r in index.search(q.tolist(), 10).collect()]
        assert [g[0] for g in got] == [w[0] for w in want] and np.allclose([g[1] for g in got], [w[1] for w in want])
        assert index.scanned <= 3000
        hits += len({r.idx for r in index.search(q.tolist(), 10, probes=4).collect()} & {w[0] for w in want})
        scanned += index.scanned
    assert hits >= 0.95 * 100 and scanned < 10 * 0.5 * 3000


def test_index_policy_bad_vectors_and_empty_table(spark, tmp_path):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 2.0]), (3, [1.0]), (4, None), (5, [None, 1.0]), (6, [0.0, 0.0]), (None, [1.0, 1.0])], "idx long, values array<double>")
    index = VectorLists.build(rows, f"{tmp_path.as_uri()}/a")
    assert len(index.list) == 1 and [r.idx for r in index.search([0.1, 1.0], 5).collect()] == [2, 1]
    assert index.search([1.0], 5).count() == 0
    with pytest.raises(ValueError):
        index.search([], 5)
    empty = VectorLists.build(rows.limit(0), f"{tmp_path.as_uri()}/b")
    assert empty.search([1.0, 0.0], 5).count() == 0 and json.loads((next((tmp_path / "b" / "about").glob("part-*"))).read_text())["width"] == 0
