"""Jobs, their event streams and graph exports on small fixtures."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tessera.operators import export, jobs
from tessera.streaming import jobs as stream

T = dt.datetime(2026, 1, 1, 12)
JOB = "job_id string, state string, fence long, lease_until timestamp, created_at timestamp, updated_at timestamp, has_conflict boolean"


def ago(**k):
    return T - dt.timedelta(**k)


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame([("a", "PENDING", 0, None, ago(minutes=5), ago(minutes=5), None), ("b", "RUNNING", 3, ago(seconds=1), ago(minutes=9), ago(minutes=9), None), ("c", "RUNNING", 1, T + dt.timedelta(seconds=9), ago(hours=9), ago(hours=9), None), ("d", "PENDING", 0, None, ago(hours=2), ago(hours=2), None), ("e", "SUCCEEDED", 1, None, ago(hours=3), ago(hours=2), None), ("f", "NEEDS_REVIEW", 1, None, ago(days=3), ago(days=3), True), ("g", "NEEDS_REVIEW", 1, None, ago(days=3), ago(days=2), None)], JOB)


def test_jobs(spark, table):
    now = F.lit(T)
    assert [(r.job_id, r.fence, r.lease_until) for r in jobs.claim(table, now, 30, 2).collect()] == [("d", 1, T + dt.timedelta(seconds=30)), ("b", 4, T + dt.timedelta(seconds=30))]
    assert sorted(map(tuple, jobs.sweep(table, now).collect())) == [("b", "RUNNING", "PENDING"), ("d", "PENDING", "EXPIRED"), ("e", "SUCCEEDED", "reaped"), ("g", "NEEDS_REVIEW", "EXPIRED")]
    held = spark.createDataFrame([("b", 2), ("c", 1)], "job_id string, fence long")
    assert [r.job_id for r in jobs.heartbeat(table, held, now, 30).collect()] == ["c"]
    wanted = spark.createDataFrame([("c", "SUCCEEDED", "worker", 1), ("b", "SUCCEEDED", "worker", 2), ("e", "RUNNING", "worker", 1), ("zz", "RUNNING", "worker", 0), ("f", "SUCCEEDED", "worker", 1), ("g", "SUCCEEDED", "caller", None)], "job_id string, to string, by string, fence long")
    assert {r.job_id: (r.state, r.refused) for r in jobs.transitions(table, wanted).collect()} == {"c": ("SUCCEEDED", None), "b": ("RUNNING", "stale_fence"), "e": ("SUCCEEDED", "not_allowed"), "zz": (None, "unknown_job"), "f": ("NEEDS_REVIEW", "not_allowed"), "g": ("SUCCEEDED", None)}
    new = spark.createDataFrame([("a",), ("x",), ("y",), ("x",)], "job_id string")
    assert {r.job_id: r.verdict for r in jobs.admit(table, new, 7).collect()} == {"a": "existing", "x": "admitted", "y": "refused"}
    assert {r.job_id: r.verdict for r in jobs.admit(table, new, 6).collect()} == {"a": "existing", "x": "refused", "y": "refused"}


def test_streams(spark, tmp_path):
    fields = "job_id string, kind string, at timestamp, seq long, payload string"
    first = [("a", "progress", T, 1, "1%"), ("a", "conflict", T, 2, "c"), ("b", "progress", T, 1, "5%"), (None, "progress", T, 9, "?")]
    second = [("a", "progress", T + dt.timedelta(seconds=30), 3, "9%"), ("a", "conflict", T, 2, "c"), ("a", "progress", T, 2, "2%")]
    for rows in (first, second):
        spark.createDataFrame(rows, fields).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    events = spark.readStream.schema(fields).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    for name, df, mode in (("latest", stream.latest_progress(events), "complete"), ("clash", stream.conflicts(events), "append"), ("active", stream.activity(events), "update")):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        assert q.awaitTermination(120)
    assert sorted((r.job_id, r.seq, r.payload) for r in spark.table("latest").collect()) == [("a", 3, "9%"), ("b", 1, "5%")]
    assert [(r.job_id, r.seq) for r in spark.table("clash").collect()] == [("a", 2)]
    assert max(r.n for r in spark.table("active").filter("kind = 'progress'").collect()) == 4
    batch = spark.createDataFrame(first + second, fields)
    assert sorted((r.job_id, r.n) for r in stream.sessions(batch).collect()) == [("a", 5), ("b", 1)]


def test_export(spark):
    edge = "from_id string, type string, to_id string, key string, attributes string, prov struct<source:string,producer:string>, ord long"
    r = spark.createDataFrame([("a", "R", "b", "", "{}", ("d", "ddl"), 1), ("a", "R", "b", "", "{}", ("d", "ddl"), 2), ("a", "R", "b", "k", '{"x":1}', ("e", "ddl"), 3), ("a", "R", "z", "", None, ("d", "ddl"), 4)], edge)
    assert {s: (lambda x: (x[0].count(), [q.merged for q in x[1].collect()]))(export.stored_edges(r, s)) for s in export.EDGE_KEYS} == {"property": (3, []), "triple": (2, [1]), "facet": (2, [1]), "document": (3, [])}
    e = spark.createDataFrame([("a", "T", "say \"A\"\n", 1), ("b", "T", "", 2)], "id string, type string, name string, ord long")
    assert sorted((x.to_id, x.from_name, x.to_name, x.dangling) for x in export.with_endpoints(r, e).distinct().select("to_id", "from_name", "to_name", "dangling").distinct().collect()) == [("b", 'say "A"\n', "b", False), ("z", 'say "A"\n', "z", True)]
    lines = {x.line for x in export.turtle(e, r, "urn:x:").collect()}
    assert '<urn:x:entity/a> <http://www.w3.org/2000/01/rdf-schema#label> "say \\"A\\"\\n" .' in lines
    assert '<< <urn:x:entity/a> <urn:x:relation/R> <urn:x:entity/b> >> <urn:x:prov/source> "e" ; <urn:x:prov/producer> "ddl" .' in lines
    assert len(lines) == 2 + 1 + 2 + 3
    flat = export.flattened(spark.createDataFrame([('{"a":[1],"b":null,"c":"t","d":{"e":1}}',), (None,)], "attributes string")).collect()
    assert flat[0].flat == {"a": "[1]", "c": "t", "d": '{"e":1}'} and flat[0].encoded == ["a", "d"] and flat[1].flat == {}
    with pytest.raises(export.ReservedName):
        export.refuse_reserved(spark.createDataFrame([('{"prov_x":1}',)], "attributes string"))
    rows = spark.range(1003).select((F.col("id") % 2).cast("int").alias("kind_no"), F.col("id").alias("ord"))
    got = [x.page for x in export.pages(rows, 100).orderBy("kind_no", "ord").collect()]
    assert got == [i // 100 + 1 for i in range(1003)]
    bad = spark.createDataFrame([(1, False), (3, True), (3, True)], "page int, last boolean")
    assert sorted(x.defect for x in export.page_defects(bad).collect()) == ["gap", "repeated", "several_last"]
