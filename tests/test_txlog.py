"""The transaction log, the store and job leases with several writers at once."""

import json
import threading

import pytest
from pyspark.sql import functions as F

from tessera.operators import leases, load
from tessera.operators.txlog import Conflict, Folder, Log
from tests.test_store_check import graph, nodes, prov


def state(log, version=None):
    return {r["key"]: r["value"] for r in log.state(version).collect()}


def test_snapshots_checkpoints_and_conflicts(spark, tmp_path):
    log = Log(spark, tmp_path.as_uri(), every=3)
    assert log.version() == 0 and state(log) == {}
    for i in range(7):
        assert log.commit({f"k{i % 2}": str(i), "gone": None if i % 3 else "x"}, log.version()) == i + 1
    assert state(log) == {"k0": "6", "k1": "5", "gone": "x"} and state(log, 2) == {"k0": "0", "k1": "1"}
    # a key that was read or written since the snapshot is a conflict, another is not
    with pytest.raises(Conflict, match="k1"):
        log.commit({"k1": "y"}, 5)
    with pytest.raises(Conflict):
        log.commit({"new": "y"}, 5, read=["k0"])
    assert log.commit({"new": "y"}, 5, read=["other"]) == 8
    table = spark.createDataFrame([("a", "1"), ("k0", "bulk")], "key string, value string")
    with pytest.raises(Conflict):
        log.commit({}, 3, table=table)
    assert log.commit({}, 8, table=table) == 9 and state(log)["k0"] == "bulk"
    with pytest.raises(Conflict):
        log.commit({"a": "2"}, 8)
    whole = state(log)
    assert log.expire(keep=2) == 7 and state(log) == whole and state(log, 9) == whole
    assert {r["version"] for r in log.history().collect()} == {8, 9}
    with pytest.raises(LookupError):
        log.state(4)
    with pytest.raises(Conflict, match="gone"):
        log.commit({"a": "3"}, 4)


def test_many_writers_of_one_counter_lose_nothing(spark, tmp_path):
    def count():
        log = Log(spark, tmp_path.as_uri(), every=4)
        for _ in range(4):
            while True:
                seen = log.version()
                try:
                    log.commit({"n": str(int(state(log, seen).get("n", "0")) + 1)}, seen)
                    break
                except Conflict:
                    continue

    run_all([count] * 3)
    log = Log(spark, tmp_path.as_uri())
    assert state(log) == {"n": "12"} and log.version() == 12


def run_all(work):
    failed = []

    def safe(f):
        try:
            f()
        except BaseException as e:  # noqa: BLE001  shown by the assertion
            failed.append(e)

    threads = [threading.Thread(target=safe, args=(f,)) for f in work]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not failed


def test_creation_by_rename_never_replaces(spark, tmp_path):
    folder = Folder(spark, tmp_path.as_uri())
    assert folder.rename_new("log/.a", "log/1.json", "one") and not folder.rename_new("log/.b", "log/1.json", "two")
    assert (tmp_path / "log/1.json").read_text() == "one" and folder.names("log") == ["1.json"]
    assert folder.create("log/2.json", "é") and not folder.create("log/2.json", "x")
    assert folder.names("log") == ["1.json", "2.json"] and folder.names("absent") == []


def test_any_text_is_a_name(spark, tmp_path):
    store = load.Store(spark, tmp_path.as_uri())
    names = ["007", "7", "1.0", "1e5", "x/y=1", "it's", "a b", "..", "%41", "é\n"]
    for n in names:
        assert store.load(n, graph(spark, f"of {n}")).load_id == n
    for n in names:
        assert {(r.load_id, r.name) for r in store.read("entities", n).filter("id = 'a'").collect()} == {(n, f"of {n}")}
        assert store.read("relations", n).count() == 1
    assert {r.load_id for r in store.read("entities").collect()} == set(names)
    assert store.sweep() == 0 and store.delete("x/y=1") and store.sweep() == 2
    assert store.read("entities", "x/y=1").count() == 0 and store.read("entities").count() == 2 * len(names) - 2
    assert {r.load_id: r.rows["entities"] for r in store.loads().collect()} == {n: 2 for n in names if n != "x/y=1"}


def test_absent_kinds_are_empty_and_other_columns_are_united(spark, tmp_path):
    store = load.Store(spark, tmp_path.as_uri())
    assert store.read("relations").count() == 0 and "from_id" in store.read("relations").columns and store.read("anything").columns == ["load_id"]
    store.load("A", {"entities": graph(spark)["entities"]})
    assert store.read("relations").count() == 0 and store.read("relations", "A").count() == 0
    store.load("B", {"entities": graph(spark, "more")["entities"].withColumn("extra", F.lit(1))})
    assert sorted((r.load_id, r.extra) for r in store.read("entities").collect() if r.extra) == [("B", 1)] * 2


def test_plans_run_once_and_what_was_written_is_digested(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    store = load.Store(spark, tmp_path.as_uri())
    g = graph(spark)
    e = g["entities"].mapInArrow(counted, g["entities"].schema)
    made = store.load("A", {"entities": e, "relations": g["relations"]})
    assert seen.value == 3 and made.digest == load.digest(g) and made.corroborated == 1
    # a plan that never gives the same rows twice has one content, that which is stored
    other = g["entities"].withColumn("name", F.concat("name", F.monotonically_increasing_id().cast("string"), F.expr("uuid()"))).filter("ord <> 1")
    again = store.load("B", {"entities": other, "relations": g["relations"]})
    assert again.digest == load.digest({"entities": store.read("entities", "B").drop("load_id", "others"), "relations": store.read("relations", "B").drop("load_id")})


def test_two_sessions_load_at_once_and_sweeps_spare_work_in_progress(spark, tmp_path):
    root = tmp_path.as_uri()

    def loader(session, names):
        def run():
            store = load.Store(session, root)
            for n in names:
                store.load(n, {"entities": nodes(session, (n, "T", n, prov()))})
                store.sweep()

        return run

    run_all([loader(spark, ["a", "b", "c"]), loader(spark.newSession(), ["d", "e", "f"])])
    store = load.Store(spark, root)
    assert sorted((r.load_id, r.id) for r in store.read("entities").collect()) == [(x, x) for x in "abcdef"]
    # a load of one content under two names at once is there once
    results = []
    same = lambda s, n: lambda: results.append(load.Store(s, root).load(n, {"entities": nodes(s, ("z", "T", "z", prov()))}))
    run_all([same(spark, "one"), same(spark.newSession(), "two")])
    assert sorted(r.status for r in results) == ["converged", "written"] and len({r.load_id for r in results}) == 1
    assert store.read("entities").filter("id = 'z'").count() == 1 and store.sweep() == 0


def test_a_swept_writer_cannot_commit(spark, tmp_path):
    store = load.Store(spark, tmp_path.as_uri())
    finish = store._finish

    def slow(*args):
        assert store.sweep() == 0 and store.sweep(abandoned=0) == 2
        return finish(*args)

    store._finish = slow
    with pytest.raises(load.Held, match="abandoned"):
        store.load("A", graph(spark))
    assert store.loads().count() == 0 and store.sweep() == 0
    assert [(r.load_id, r.done) for r in store.history().orderBy("number").collect()][:2] == [("A", "begun"), ("A", "given up")]


def test_two_workers_never_hold_one_job(spark, tmp_path):
    root = tmp_path.as_uri()
    now = F.lit("2024-01-01 00:00:00").cast("timestamp")
    rows = spark.range(30).select(F.col("id").alias("job_id"), F.lit("PENDING").alias("state"), F.lit(0).cast("long").alias("fence"), now.alias("created_at"), now.alias("updated_at"))
    table = leases.Leases(spark, root)
    table.add(rows)
    assert table.add(rows) == 2 and table.table().count() == 30
    got = {"x": [], "y": []}

    def worker(session, name):
        def run():
            mine = leases.Leases(session, root)
            for _ in range(3):
                got[name] += [r["job_id"] for r in mine.claim(name, now, 60, 4).collect()]

        return run

    run_all([worker(spark, "x"), worker(spark.newSession(), "y")])
    assert len(got["x"]) == len(got["y"]) == 12 and not set(got["x"]) & set(got["y"])
    held = {r["job_id"]: r["holder"] for r in table.table().filter("state = 'RUNNING'").collect()}
    assert held == {j: n for n, js in got.items() for j in js}
    # after its lease another worker may have the job, and a late report is refused
    later = now + F.make_interval(secs=F.lit(61))
    taken = table.claim("z", later, 60, 2).collect()
    assert [t["fence"] for t in taken] == [2, 2]
    wanted = spark.createDataFrame([(taken[0]["job_id"], "SUCCEEDED", "worker", 1), (taken[1]["job_id"], "SUCCEEDED", "worker", 2), ("none", "FAILED", "worker", 1)], "job_id string, to string, by string, fence long")
    said = {r["job_id"]: r["refused"] for r in table.report(wanted, later).collect()}
    assert said == {taken[0]["job_id"]: "stale_fence", taken[1]["job_id"]: None, "none": "unknown_job"}
    beat = table.heartbeat(spark.createDataFrame([(taken[0]["job_id"], 2), (taken[1]["job_id"], 2)], "job_id string, fence long"), later, 600)
    assert [r["job_id"] for r in beat.collect()] == [taken[0]["job_id"]]
    assert table.sweep(later) == 22 and table.table().filter("state = 'RUNNING'").count() == 2 - 1
    assert json.loads(state(table.log)[f"job/{taken[1]['job_id']}"])["state"] == "SUCCEEDED"
