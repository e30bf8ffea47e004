"""Neighbours against brute force; every table is large enough that lists come from NN-descent."""

import numpy as np
import pytest

from tessera.llm import ann, queries
from tessera.llm.common import Scratch, ensure_importable

SF = "/root/testdata/sf0.001"


def brute_force(ids, x, q, k=20):
    s = x @ x[ids == q][0]
    s[ids == q] = -np.inf
    return ids[np.lexsort((ids, -s))[:k]].tolist()


def shares(got, ids, x):
    """Share of each query's true nearest that was found."""
    found = {}
    for r in got:
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
    asked = [i for i in ids.tolist() if i % 20 == 0]
    assert set(found) == set(asked)
    return [len(found[q] & set(brute_force(ids, x, q))) / 20 for q in asked]


def frame(spark, x):
    ensure_importable(spark)
    return spark.createDataFrame(list(enumerate(x.tolist())), "vec_id long, embedding array<double>")


def sample(kind, n=2500, width=48, seed=21):
    dice = np.random.default_rng(seed)
    x = dice.standard_normal((n, width))
    if kind == "clustered":
        x = dice.standard_normal((25, width))[dice.integers(0, 25, n)] + 0.2 * x
    if kind == "uneven norms and an outlier":
        x *= np.exp(1.5 * dice.standard_normal((n, 1)))
        x[7] *= 1e6
    if kind == "common offset and huge values":
        x = (x + 30) * 1e150
    return x


@pytest.mark.parametrize("kind", ["normal", "clustered", "uneven norms and an outlier", "common offset and huge values"])
def test_recall_against_brute_force(spark, kind):
    """Tables of 25 groups and more: a start group holds 4 % of the vectors, the rest is found by descent and search."""
    x = sample(kind)
    found = shares(ann.nearest(frame(spark, x)).collect(), np.arange(len(x)), x / np.abs(x).max())
    assert np.mean(found) >= 0.93, (np.mean(found), min(found))


def test_descent_is_what_finds_neighbours(spark):
    """The start alone has less than half of the nearest; when rounds end another one changes next to nothing."""
    x = sample("normal")
    scratch = Scratch(spark, "test")
    _, vectors = ann.distinct_vectors(frame(spark, x), "vec_id", "embedding", scratch)
    graph, coder = ann.build_graph(vectors, scratch)
    start = ann._start(graph.select("node", "point"), coder)
    name = {r["node"]: np.array(r["vec"]) for r in vectors.collect()}
    nodes = np.array(sorted(name))
    points = np.stack([name[n] for n in nodes.tolist()])

    def recall(lists):
        near = {r["node"]: set(r["near"][:20]) for r in lists.collect()}
        assert len(near) == len(x)
        return np.mean([len(near[n] & set(brute_force(nodes, points, n))) / 20 for n in nodes[::10].tolist()])

    assert recall(start) < 0.5
    assert recall(graph) > 0.85
    flags = graph.selectExpr("node", "point", "near", "sim", "transform(near, x -> true) as new", "0 as gained")
    more = scratch.table(ann._descend(flags, coder, scratch, 99), "more")
    entries = more.selectExpr("sum(gained) as gained", "sum(size(near)) as entries").first()
    assert entries["gained"] < 0.05 * entries["entries"]


def test_search_goes_on_while_a_node_is_open(spark, monkeypatch):
    """A chain of lists of one node each: only hop after hop leads to its end."""
    monkeypatch.setattr(ann, "LONGEST", 1)
    x = np.array([[1.0, 1.0 + i / 4] for i in range(12)])[::-1]
    scratch = Scratch(spark, "test")
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "node long, vec array<double>")
    ensure_importable(spark)
    coder = ann.Coder(df)
    points = coder.code(x / coder.largest)
    rows = [(i, bytearray(points[i]), [i - 1] if i else [], [float(x[i] @ x[i - 1])] if i else []) for i in range(12)]
    graph = spark.createDataFrame(rows, "node long, point binary, near array<long>, sim array<float>")
    got = ann.search(spark.createDataFrame([(11,)], "node long"), graph, coder, df, scratch, 3).collect()
    assert {r["node"] for r in got} == set(range(12))


def test_small_table_equals_brute_force(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    ids, x = np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], float)
    got = queries.queries()["op4_neighbours"](spark, SF).collect()
    assert np.mean(shares(got, ids, x)) >= 0.98
    place = {int(i): n for n, i in enumerate(ids)}
    for r in got:
        assert r["score"] == pytest.approx(x[place[r["query_id"]]] @ x[place[r["vec_id"]]], abs=1e-9) and r["query_id"] != r["vec_id"]
    for q in {r["query_id"] for r in got}:
        mine = sorted((r["rank"], -r["score"], r["vec_id"]) for r in got if r["query_id"] == q)
        assert [r[0] for r in mine] == list(range(1, 21)) and [r[1:] for r in mine] == sorted(r[1:] for r in mine)


def test_bad_vectors_ties_and_repeats(spark, awkward_df):
    nan = float("nan")
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [None, 1.0]), (7, [1.0]), (8, [-1.0, 0.0]), (None, [1.0, 1.0]), (8, [-1.0, 0.0]), (9, [-3.0, 0.0]), (9, [-2.0, 0.0])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, node string")
    assert [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in ann.nearest(df).orderBy("rank").collect()] == [(0, 1, 1, 2.0), (0, 2, 2, 2.0), (0, 3, 8, -1.0), (0, 4, 9, -2.0)]
    assert ann.nearest(df.limit(0)).count() == 0


def test_a_crowd_of_equal_vectors(spark):
    """A third of all rows share one vector: one node, every row of it is answered and can be an answer."""
    x = sample("normal", 300, 16)
    x[::3] = x[0]
    got = ann.nearest(frame(spark, x)).collect()
    same = [r for r in got if r["query_id"] == 0]
    assert [r["vec_id"] for r in sorted(same, key=lambda r: r["rank"])] == brute_force(np.arange(300), x, 0)
    assert len(got) == 15 * 20


def test_a_hop_makes_a_row_for_an_expanded_node_not_for_a_candidate(spark, monkeypatch):
    """What is sent back of a list is what can enter the beam, with its inner products; candidates are no rows."""
    x = sample("normal", 600, 16)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    scratch, plans = Scratch(spark, "test"), []
    _, vectors = ann.distinct_vectors(frame(spark, x), "vec_id", "embedding", scratch)
    graph, coder = ann.build_graph(vectors, scratch)
    table = Scratch.table

    def noted(self, df, name):
        if name.startswith("search-") and name != "search-0":
            plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return table(self, df, name)

    monkeypatch.setattr(Scratch, "table", noted)
    with ann._by_node(graph, scratch) as graph:
        asked = vectors.select("node").orderBy("node").limit(300)
        ann.search(asked, graph, coder, vectors, scratch, 20).count()
        assert plans and all(p.count("Generate explode") == 1 and "array_except" not in p for p in plans)
        some = graph.orderBy("node").limit(2).collect()
        state = spark.createDataFrame([(some[0]["node"], some[0]["point"], [0, 1], [0.5, 0.25], [True, True], [some[1]["node"]])], ann._STATE)
        got = {n: s for part in ann._expanded(state, graph, coder, 1).first()["met"] for n, s in zip(part["near"], part["sim"], strict=True)}
    at = {r["node"]: np.array(r["vec"]) for r in vectors.collect()}
    near = [n for n in some[1]["near"] if n != some[0]["node"]]
    want = {n: float(at[n] @ at[some[0]["node"]]) / coder.largest**2 for n in near}
    assert all(s >= 0.25 and abs(s - want[n]) < 0.1 for n, s in got.items())
    assert {n for n in near if want[n] > 0.35} <= set(got) < set(near)
