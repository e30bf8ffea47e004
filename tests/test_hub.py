"""The event hub as a stream, with restarts, against its table form."""

import datetime

import pytest

from tessera.streaming import hub

SCHEMA = "job_id string, kind string, seq long, at timestamp, watcher string, stage string, calls long, counts string, payload string"
T0 = datetime.datetime(2024, 1, 1)


def event(job, kind, seq, minute=0, watcher=None, stage=None, calls=None, counts=None, payload=None):
    return (job, kind, seq, T0 + datetime.timedelta(minutes=minute), watcher, stage, calls, counts, payload)


@pytest.fixture()
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.unset(key)


def test_late_watchers_restarts_coalescing_and_leases(spark, rocks, tmp_path):
    batches = [
        [event("a", "progress", 1, 0, stage="read", calls=5), event("a", "conflict", 2, 0, payload="x"), event("a", "watch", 3, 0, "ann"), event("b", "progress", 1, 0, stage="read")],
        # many ticks coalesce, a repeated conflict is not delivered again, a partial event changes its own field only
        [event("a", "progress", 4 + i, 1, calls=i) for i in range(50)] + [event("a", "conflict", 2, 1, payload="x"), event("a", "conflict", 60, 1, payload="y"), event("a", "progress", 61, 1, stage="check")],
        [event("a", "watch", 70, 2, "bob"), event("b", "watch", 5, 2, "bob")],
        # the watermark passes both leases
        [event("c", "progress", 1, 60, stage="read"), event("c", "watch", 2, 60, "cy"), event(None, "watch", 3, 60, "cy"), event("c", "done", 4, 60)],
        [event("c", "watch", 9, 90, "dan")],
    ]
    got = []
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/{i}")
        stream = spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in/*")
        out = []
        query = hub.hub(stream, 60, "1 minute").writeStream.foreachBatch(lambda df, _: out.extend(map(tuple, df.collect()))).option("checkpointLocation", f"{tmp_path}/state").outputMode("append").trigger(availableNow=True).start()  # noqa: B023
        query.awaitTermination(120)
        assert query.exception() is None
        got.append(sorted(out, key=repr))
    assert got[0] == [("a", "ann", "conflict", 2, "read", 5, None, "x"), ("a", "ann", "progress", 1, "read", 5, None, None)]
    assert got[1] == [("a", "ann", "conflict", 60, "check", 49, None, "y"), ("a", "ann", "progress", 61, "check", 49, None, None)]
    assert [g for g in got[2] if g[2] != "silent"] == [("a", "bob", "conflict", 2, "check", 49, None, "x"), ("a", "bob", "conflict", 60, "check", 49, None, "y"), ("a", "bob", "progress", 61, "check", 49, None, None), ("b", "bob", "progress", 1, "read", None, None, None)]
    silent = {g[:3] for out in got[2:] for g in out if g[2] == "silent"}
    assert silent == {("a", "ann", "silent"), ("a", "bob", "silent"), ("b", "bob", "silent")}
    assert [g[:3] for g in got[3] if g[0] == "c"] == [("c", "cy", "closed"), ("c", "cy", "progress")] and ("c", "dan", "closed") in {g[:3] for g in got[4]}
    # what every watcher has in the end is what the table of all events says
    rows = spark.createDataFrame([r for b in batches[:3] for r in b], SCHEMA)
    want = {(r.job_id, r.watcher, r.kind, r.seq) for r in hub.delivered(rows).collect()}
    assert {(j, w, k, s) for out in got[:3] for j, w, k, s, *_ in out if k == "conflict"} == {x for x in want if x[2] == "conflict"}
    last = {}
    for out in got[:3]:
        for j, w, k, s, stage, calls, *_ in out:
            if k == "progress":
                last[j, w] = (s, stage, calls)
    assert last == {(r.job_id, r.watcher): (r.seq, r.stage, r.calls) for r in hub.delivered(rows).filter("kind = 'progress'").collect()}


def test_final_deliveries_of_watchers_who_stay(spark):
    rows = [event("a", "watch", 1, watcher="x"), event("a", "leave", 2, watcher="x"), event("a", "watch", 3, watcher="y"), event("a", "conflict", 4, payload="p"), event("a", "conflict", 4, payload="p"), event("a", None, 5), event("z", "watch", 1, watcher="y")]
    df = spark.createDataFrame(rows, SCHEMA)
    assert [tuple(r)[:4] for r in hub.delivered(df).collect()] == [("a", "y", "conflict", 4)]
    assert hub.delivered(df.limit(0)).count() == 0
