"""Approximate nearest neighbours by NN-descent and greedy graph search; nearness is the inner product.

Graph: a node's list holds ``KEEP`` nodes of large inner product with it. Lists start from one random
grouping and ``TREES`` groupings by sign patterns of random projections, each of about ``LEAF`` nodes at
every table size; large groups are cut, so a crowd of alike vectors stays in several tasks. Then rounds of
NN-descent: every node brings together neighbours and reverse neighbours, a sample of those new since the
last round and a sample of the others, and offers each of them the new ones that beat the end of its list:
neighbours of neighbours, by Spark joins. A pair is looked at again only if one of the two is new. Rounds
go on until less than ``STILL`` of all list entries change.

Points travel as one byte per component of what is left of the vector without its part along the mean direction, with a
scale and the length of that part, so neither a common offset nor uneven norms cost precision. Offers are merged inside a task before they shuffle,
which keeps the groups of popular (long) vectors small.

Search: each distinct query vector begins with its own list and the ``LONGEST`` longest vectors, expands
the nearest unexpanded nodes of its beam (an eighth of it) in each hop by one join to the graph, and is done when
the nearer half of its beam is expanded; the graph is bucketed by node and holds the points of each list beside it, so a hop makes one row for each expanded node, scores
its list there and sends back only what beats the end of the query's beam; hops go on while any query has an open node. ``CHECKED`` queries are compared with all vectors first, in one
scan, and searched with a beam that is widened by half until they have found ``TARGET`` of their nearest; the others take that width: no size or kind of table keeps a narrow beam that loses too much. Found nodes are scored in double
precision on the original vectors and widened to all ids of a node that can matter.

Left out: null vectors, those with null or non-finite components, zero vectors and vectors of another
length than the most frequent one (the smaller of two). Equal vectors share a node (named by a 64-bit hash of the vector:
the chance that any two of a billion different ones share it is about 3 %, of a million 3e-8). Ties go to the smaller
vec_id; a null vec_id takes no part. A vec_id on several different vectors asks once, with one of them, and
is found once, at its best score. Vectors shorter than about 1e-19 of the largest component count as equally
far while lists are made. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Scratch, partitions
from tessera.llm.skew import keyed_join

TREES, LEAF, KEEP, SAMPLE = 5, 100, 40, 16
BEAM, LONGEST = 96, 48
#: Queries whose nearest are also found by comparing them with every vector, the share of these that the search must reach, and the widest beam.
CHECKED, TARGET, WIDEST = 256, 0.95, 1024
#: Share of list entries changed by a round below which NN-descent has converged.
STILL = 0.01
#: Offers that a task merges at once, and merged ones that it holds before they leave it.
BUFFER, HELD = 600_000, 2_000_000
#: Rows of one Arrow batch of offers.
SENT = 10_000
_OFFERS = "node long, near array<long>, sim array<float>"
_GRAPH = "node long, point binary, near array<long>, sim array<float>, new array<boolean>, gained int"
_STATE = "node long, point binary, beam array<long>, score array<float>, done array<boolean>, go array<long>"


def distinct_vectors(df: DataFrame, vec_id: str, vector: str, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(ids: vec_id, node), (vectors: node, vec) of the rows that take part."""
    kind = df.schema[vector].dataType.simpleString()
    own = df[vector] if kind in ("array<float>", "array<double>") else df[vector].cast("array<double>")
    rows = df.select(df[vec_id].cast("long").alias("vec_id"), own.alias("vec")).filter("vec_id is not null and size(vec) > 0")
    fine = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vec", lambda x: x != 0)
    rows = rows.filter(fine).withColumn("vec", F.transform("vec", lambda x: x + F.lit(0).cast("float")))  # no negative zero
    usual = rows.groupBy(F.size("vec").alias("width")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "width").limit(1)
    rows = rows.join(F.broadcast(usual.select("width")), F.size("vec") == F.col("width")).select("vec_id", F.xxhash64("vec").alias("node"), "vec")
    ids = scratch.table(rows.select("vec_id", "node").distinct(), "ids")
    return ids, scratch.table(rows.groupBy("node").agg(F.first("vec").alias("vec")), "vectors")


class Coder:
    """Points of one byte per component; small enough to go with every task: one vector and three numbers."""

    def __init__(self, vectors: DataFrame) -> None:
        stats = vectors.agg(F.count("*").alias("n"), F.max(F.size("vec")).alias("width"), F.max(F.array_max(F.transform("vec", lambda x: F.abs(x.cast("double"))))).alias("largest")).first()
        self.n, self.width, self.largest = stats["n"], stats["width"] or 0, stats["largest"] or 1.0
        width, scaled = self.width, self.scaled

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(width)
            for batch in batches:
                if len(batch):
                    total += _units(scaled(batch.column(0))).sum(0)
            yield pa.RecordBatch.from_arrays([pa.array(range(width), pa.int32()), pa.array(total)], names=["at", "x"])

        mean = vectors.select("vec").mapInArrow(sums, "at int, x double").groupBy("at").agg(F.sum("x").alias("x")).collect()
        self.mean = np.array([m["x"] for m in sorted(mean)]) / max(1, self.n)
        self.heading = self.mean / max(float(np.linalg.norm(self.mean)), 1e-30)

    def scaled(self, column: pa.Array) -> np.ndarray:
        return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1) / self.largest

    def code(self, x: np.ndarray) -> list[bytes]:
        along = x @ self.heading
        rest = x - along[:, None] * self.heading
        scale = np.maximum(np.abs(rest).max(1) / 127, 1e-37)
        head = np.stack([scale, along], 1).astype("<f4").view(np.uint8)
        return [p.tobytes() for p in np.concatenate([head, np.rint(rest / scale[:, None]).astype(np.int8).view(np.uint8)], 1)]

    def points(self, coded: pa.Array) -> np.ndarray:
        """What is left without the mean direction, and the part along it as the last component: inner products are kept."""
        fixed = coded.cast(pa.binary(8 + self.width))
        raw = np.frombuffer(fixed.buffers()[1] if len(fixed) else b"", np.uint8)[fixed.offset * (8 + self.width) :][: len(fixed) * (8 + self.width)].reshape(len(fixed), 8 + self.width)
        head = raw[:, :8].copy().view("<f4")
        return np.concatenate([raw[:, 8:].view(np.int8) * head[:, :1], head[:, 1:]], 1)

    def signs(self, coded: pa.Array, planes: np.ndarray) -> np.ndarray:
        points = self.points(coded).astype(np.float64)
        return (_units(points[:, :-1] + points[:, -1:] * self.heading) - self.mean) @ planes > 0


def _units(x: np.ndarray) -> np.ndarray:
    x = x / np.maximum(np.abs(x).max(1, keepdims=True), 1e-300)
    return x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-300)


def _nearest_of_each(node: np.ndarray, near: np.ndarray, sim: np.ndarray, prefer: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(indices of the KEEP nearest distinct entries of each node, in order; their nodes). Of equal entries the preferred stays."""
    order = np.lexsort((near, node)) if prefer is None else np.lexsort((~prefer, near, node))
    order = order[np.concatenate([[True], (np.diff(node[order]) != 0) | (np.diff(near[order]) != 0)])] if len(order) else order
    order = order[np.lexsort((near[order], -sim[order], node[order]))]
    begins = np.flatnonzero(np.diff(node[order], prepend=node[order][:1] - 1))
    rank = np.arange(len(order)) - np.repeat(begins, np.diff(begins, append=len(order)))
    order = order[rank < KEEP]
    return order, node[order]


def _lists(values: np.ndarray, sizes: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(values))


class _Offers:
    """Offers of one task, merged to at most KEEP per node before they leave it."""

    def __init__(self) -> None:
        self.parts, self.size, self.held = [], 0, 0

    def add(self, node: np.ndarray, near: np.ndarray, sim: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.parts.append((node, near, sim.astype(np.float32)))
        self.size += len(node)
        if self.size - self.held > BUFFER:
            self._merge()
            if self.held > HELD:
                yield from self.flush()

    def _merge(self) -> None:
        node, near, sim = (np.concatenate(p) for p in zip(*self.parts, strict=True))
        order, at = _nearest_of_each(node, near, sim)
        self.parts = [(at, near[order], sim[order])]
        self.size = self.held = len(order)

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.size:
            self._merge()
            at, near, sim = self.parts[0]
            nodes, sizes = np.unique(at, return_counts=True)
            self.parts, self.size, self.held = [], 0, 0
            ends = np.cumsum(sizes)
            for i in range(0, len(nodes), SENT):
                rows = slice(ends[i] - sizes[i], ends[min(i + SENT, len(nodes)) - 1])
                yield pa.RecordBatch.from_arrays([pa.array(nodes[i : i + SENT]), _lists(near[rows], sizes[i : i + SENT]), _lists(sim[rows], sizes[i : i + SENT])], names=["node", "near", "sim"])


def _whole_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of rows sorted by their first column, cut so that the rows of a key are in one of them."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        if not len(batch):
            continue
        keys = batch.column(0).to_numpy()
        cut = int(np.searchsorted(keys, keys[-1]))
        if cut or (rest and rest[-1].column(0)[-1].as_py() != keys[-1]):
            yield pa.concat_batches([*rest, batch.slice(0, cut)])
            rest = []
        rest.append(batch.slice(cut))
    if rest:
        yield pa.concat_batches(rest)


def _together(rows: DataFrame, key: str) -> DataFrame:
    """Rows of a key side by side in one task, for ``_whole_keys``."""
    return rows.repartition(key).sortWithinPartitions(key)


def _merged(rows: DataFrame) -> DataFrame:
    """One list per node from its old one (the row with its point) and all offers; ``gained``: entries that it did not have.

    Entries of the old list that the round has sampled as new count as known from now on.
    """

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _whole_keys(batches):
            nodes, row = np.unique(batch["node"].to_numpy(), return_inverse=True)
            point = batch["point"].filter(batch["point"].is_valid())  # one for each node, in order
            sizes = batch["near"].value_lengths().to_numpy()
            near, sim = batch["near"].flatten().to_numpy(), batch["sim"].flatten().to_numpy()
            offer = np.repeat(batch["new"].is_null().to_numpy(zero_copy_only=False), sizes)
            new = offer.copy()
            new[~offer] = _aged(batch["new"].drop_null())
            order, at = _nearest_of_each(np.repeat(row, sizes), near, sim, ~offer)
            sizes = np.bincount(at, minlength=len(nodes))
            gained = np.bincount(at, offer[order], minlength=len(nodes)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(nodes), point, _lists(near[order], sizes), _lists(sim[order], sizes), _lists(new[order], sizes), pa.array(gained)], names=["node", "point", "near", "sim", "new", "gained"])

    return _together(rows, "node").mapInArrow(merge, _GRAPH)


def _flags(new: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of each entry, whether it is new, its place among those of its kind in its row)."""
    sizes = new.value_lengths().to_numpy()
    row, flag = np.repeat(np.arange(len(sizes)), sizes), new.flatten().to_numpy(zero_copy_only=False)
    upto, begin = np.cumsum(flag) - flag, np.repeat(np.cumsum(sizes) - sizes, sizes)
    news = upto - (upto[begin] if len(upto) else 0)
    return row, flag, np.where(flag, news, np.arange(len(row)) - begin - news)


def _aged(new: pa.ListArray) -> np.ndarray:
    _, flag, place = _flags(new)
    return flag & (place >= SAMPLE)


def _offered(offers: DataFrame) -> DataFrame:
    return offers.select("node", F.lit(None).cast("binary").alias("point"), "near", "sim", F.lit(None).cast("array<boolean>").alias("new"))


def _sampled(hub: np.ndarray, node: np.ndarray, fresh: np.ndarray, most: int, step: int) -> np.ndarray:
    """Indices of at most ``most`` entries per hub and kind, by a hash of the round; sorted by hub."""
    with np.errstate(over="ignore"):
        dice = (node.view(np.uint64) ^ np.uint64(step * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) * np.uint64(0xD1342543DE82EF95)
    order = np.lexsort((dice, fresh, hub))
    first = np.concatenate([[True], (np.diff(hub[order]) != 0) | (np.diff(fresh[order].view(np.int8)) != 0)]) if len(order) else np.zeros(0, bool)
    begins = np.flatnonzero(first)
    return order[np.arange(len(order)) - np.repeat(begins, np.diff(begins, append=len(order))) < most]


def _start(points: DataFrame, coder: Coder) -> DataFrame:
    """Lists from one random grouping and TREES groupings by signs of random projections of the centred directions."""
    n, width = coder.n, coder.width
    bits = max(0, int(np.ceil(np.log2(max(1, n / LEAF)))))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes = np.random.default_rng(7).standard_normal((width, TREES * max(1, bits)))
        weights = 1 << np.arange(bits, dtype=np.int64)
        for batch in batches:
            if len(batch):
                signs = coder.signs(batch.column(1), planes)
                groups = [batch.column(0).to_numpy() % max(1, n // LEAF)]
                groups += [(signs[:, t * bits : (t + 1) * bits] @ weights) * TREES + t + (1 << 50) for t in range(TREES)] if bits else []
                for g in groups:
                    yield pa.RecordBatch.from_arrays([pa.array(g.astype(np.int64)), batch.column(0), batch.column(1)], names=["grp", "node", "point"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        offers = _Offers()
        for batch in batches:
            for nodes, coded in zip(batch["nodes"], batch["points"], strict=True):
                nodes, x = nodes.values.to_numpy(), coder.points(coded.values)
                if len(nodes) > 1:
                    sims = x @ x.T
                    np.fill_diagonal(sims, -np.inf)
                    most = min(KEEP // 2, len(nodes) - 1)
                    at = np.argpartition(-sims, most - 1, axis=1)[:, :most]
                    yield from offers.add(np.repeat(nodes, most), nodes[at].ravel(), np.take_along_axis(sims, at, 1).ravel())
        yield from offers.flush()

    rows = points.mapInArrow(place, "grp long, node long, point binary")
    sizes = rows.groupBy("grp").agg(F.ceil(F.count("*") / (4 * LEAF)).cast("int").alias("parts"))
    rows = keyed_join(rows, sizes, "grp", rows=n * (TREES + 1)).withColumn("part", F.expr("pmod(xxhash64(node, grp), parts)"))
    groups = rows.groupBy("grp", "part").agg(F.collect_list(F.struct("node", "point")).alias("g")).select(F.col("g.node").alias("nodes"), F.col("g.point").alias("points"))
    none = [F.array().cast(f"array<{c}>").alias(a) for a, c in (("near", "bigint"), ("sim", "float"), ("new", "boolean"))]
    return _merged(points.select("node", "point", *none).unionByName(_offered(groups.mapInArrow(meet, _OFFERS))))


def _descend(graph: DataFrame, coder: Coder, scratch: Scratch, step: int) -> DataFrame:
    """One round of NN-descent: lists merged with offers from neighbours of neighbours."""

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a node's own neighbours as they are; reverse neighbours limited in every task before they shuffle
        parts, size = [], 0

        def rows(own: bool, hub: np.ndarray, node: np.ndarray, fresh: np.ndarray) -> pa.RecordBatch:
            hubs, sizes = np.unique(hub, return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(hubs), pa.array(np.full(len(hubs), own)), _lists(node, sizes), _lists(fresh, sizes)], names=["hub", "own", "nodes", "fresh"])

        def back() -> pa.RecordBatch:
            hub, node, fresh = (np.concatenate(p) for p in zip(*parts, strict=True))
            at = _sampled(hub, node, fresh, SAMPLE, step)
            return rows(False, hub[at], node[at], fresh[at])

        for batch in batches:
            if not len(batch):
                continue
            row, flag, place = _flags(batch["new"])
            at = np.flatnonzero(place < SAMPLE)
            hub, node, fresh = batch["node"].to_numpy()[row[at]], batch["near"].flatten().to_numpy()[at], flag[at]
            order = np.argsort(hub, kind="stable")
            yield rows(True, hub[order], node[order], fresh[order])
            parts.append((node, hub, fresh))
            size += len(hub)
            if size > BUFFER:
                yield back()
                parts, size = [], 0
        if parts:
            yield back()

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _whole_keys(batches):
            sizes = batch["nodes"].value_lengths().to_numpy()
            hub, own = np.repeat(batch["hub"].to_numpy(), sizes), np.repeat(batch["own"].to_numpy(zero_copy_only=False), sizes)
            node, fresh = batch["nodes"].flatten().to_numpy(), batch["fresh"].flatten().to_numpy(zero_copy_only=False)
            mine, back = np.flatnonzero(own), np.flatnonzero(~own)
            back = back[_sampled(hub[back], node[back], fresh[back], SAMPLE, step)]
            hubs = np.unique(hub)
            hub, node, fresh = (np.concatenate(x) for x in ((hub[mine], hub[back], hubs), (node[mine], node[back], hubs), (fresh[mine], fresh[back], np.zeros(len(hubs), bool))))
            # of one met twice the fresh entry counts; a hub without fresh ones has nothing to offer
            order = np.lexsort((~fresh, node, hub))
            order = order[np.concatenate([[True], (np.diff(hub[order]) != 0) | (np.diff(node[order]) != 0)])]
            order = order[np.isin(hub[order], hub[fresh])]
            yield pa.RecordBatch.from_arrays([pa.array(hub[order]), pa.array(node[order]), pa.array(fresh[order])], names=["hub", "node", "fresh"])

    around = graph.select("node", "near", "new").mapInArrow(sample, "hub long, own boolean, nodes array<long>, fresh array<boolean>")
    around = scratch.table(_together(around, "hub").mapInArrow(gather, "hub long, node long, fresh boolean"), f"around-{step}")
    last = F.when(F.size("near") >= KEEP, F.element_at("sim", -1)).otherwise(F.lit(float("-inf"))).cast("float")
    met = keyed_join(around, graph.select("node", "point", last.alias("last")), "node").select("hub", "node", "fresh", "point", "last")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        offers = _Offers()
        for batch in _whole_keys(batches):
            hubs, nodes, fresh, last = (batch[c].to_numpy(zero_copy_only=False) for c in ("hub", "node", "fresh", "last"))
            points = coder.points(batch["point"])
            begins = np.flatnonzero(np.diff(hubs, prepend=hubs[0] - 1)).tolist()
            for i, j in zip(begins, [*begins[1:], len(hubs)], strict=True):
                order = np.argsort(~fresh[i:j], kind="stable") + i
                a, b = (k := order[: int(fresh[i:j].sum())]), order[len(k) :]
                sims = points[a] @ points[order].T
                sims[np.arange(len(a)), np.arange(len(a))] = -np.inf
                x, y = np.nonzero(sims > last[a][:, None])
                yield from offers.add(nodes[a][x], nodes[order][y], sims[x, y])
                sims = sims[:, len(a) :]
                x, y = np.nonzero(sims > last[b][None, :])
                yield from offers.add(nodes[b][y], nodes[a][x], sims[x, y])
        yield from offers.flush()

    offers = _together(met, "hub").mapInArrow(meet, _OFFERS)
    return _merged(graph.select("node", "point", "near", "sim", "new").unionByName(_offered(offers)))


def build_graph(vectors: DataFrame, scratch: Scratch) -> tuple[DataFrame, Coder]:
    """node, point, near, sim: the neighbour lists of distinct vectors (columns node, vec). Lists only get nearer, so the rounds end."""
    coder = Coder(vectors)

    def point(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(coder.code(coder.scaled(batch.column(1))), pa.binary())], names=["node", "point"])

    points = scratch.table(vectors.select("node", "vec").mapInArrow(point, "node long, point binary"), "points")
    graph, step = scratch.table(_start(points, coder), "graph-0"), 0
    while True:
        step += 1
        graph = scratch.table(_descend(graph, coder, scratch, step), f"graph-{step}")
        scratch.drop(f"graph-{step - 1}")
        scratch.drop(f"around-{step}")
        moved = graph.agg(F.sum("gained").alias("gained"), F.sum(F.size("near")).alias("all")).first()
        if (moved["gained"] or 0) <= STILL * (moved["all"] or 0):
            scratch.drop("points")
            return graph.select("node", "point", "near", "sim"), coder


@contextmanager
def _by_node(graph: DataFrame, scratch: Scratch) -> Iterator[DataFrame]:
    """The graph written once in buckets by node, as many as a shuffle has partitions: joins on node move only their other side.

    ``around`` are the points of the nodes in ``near``, in its order.
    """
    spark, name, n = graph.sparkSession, f"ann_{uuid.uuid4().hex}", partitions(graph.sparkSession)
    each = graph.select(F.col("node").alias("of"), F.posexplode("near").alias("at", "node"))
    met = keyed_join(each, graph.select("node", "point"), "node").groupBy(F.col("of").alias("node")).agg(F.array_sort(F.collect_list(F.struct("at", "point"))).alias("met"))
    graph.join(met, "node", "left").select("node", "point", "near", "sim", F.col("met.point").alias("around")).repartition(n, "node").write.bucketBy(n, "node").sortBy("node").option("path", scratch.path("by-node")).saveAsTable(name)
    try:
        yield spark.table(name)
    finally:
        spark.sql(f"DROP TABLE {name}")


def _turn(beam: np.ndarray, score: np.ndarray, done: np.ndarray, width: int) -> tuple:
    """The nearest, twice as many as are to be expanded, with those to expand now marked as done."""
    at = np.lexsort((beam, -score))[: 2 * width]
    beam, score, done = beam[at], score[at], done[at].copy()
    go = np.flatnonzero(~done[:width])[: max(16, width // 4)]
    done[go] = True
    return beam, score, done, beam[go]


def _states(nodes: list, points: pa.Array, found: list[tuple]) -> pa.RecordBatch:
    beams = [pa.array([f[i] for f in found], pa.list_(kind)) for i, kind in enumerate((pa.int64(), pa.float32(), pa.bool_(), pa.int64()))]
    return pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), points, *beams], names=["node", "point", "beam", "score", "done", "go"])


def _expanded(state: DataFrame, graph: DataFrame, coder: Coder, width: int) -> DataFrame:
    """node, met (array of near, sim): for each query node with nodes to expand, what of their lists can still enter its beam of ``2 * width``."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch["near"].value_lengths().to_numpy()
            if not sizes.sum():
                continue
            row, near = np.repeat(np.arange(len(sizes)), sizes), batch["near"].flatten().to_numpy()
            sims = np.einsum("ij,ij->i", coder.points(batch["around"].flatten()), coder.points(batch["point"])[row]).astype(np.float32)
            good = np.flatnonzero((sims >= batch["least"].to_numpy()[row]) & (near != batch["query"].to_numpy()[row]))
            rows, sizes = np.unique(row[good], return_counts=True)
            yield pa.RecordBatch.from_arrays([batch["query"].take(pa.array(rows)), _lists(near[good], sizes), _lists(sims[good], sizes)], names=["node", "near", "sim"])

    least = F.when(F.size("score") >= 2 * width, F.element_at("score", -1)).otherwise(F.lit(float("-inf"))).cast("float")
    go = state.select(F.col("node").alias("query"), "point", least.alias("least"), F.explode("go").alias("node"))
    lists = go.join(graph.select("node", "near", "around"), "node").select("query", "point", "least", "near", "around")
    return lists.mapInArrow(score, _OFFERS).groupBy("node").agg(F.collect_list(F.struct("near", "sim")).alias("met"))


def exact_least(checked: DataFrame, vectors: DataFrame, coder: Coder, k: int) -> DataFrame:
    """query, wanted, least: how many nearest (``k`` at most) each query node of ``checked`` (node, vec; at most CHECKED rows) has, and the score of the last, by comparison with all vectors."""
    rows = checked.toArrow()
    mine, x = rows["node"].to_numpy(), coder.scaled(rows["vec"].combine_chunks()) if rows.num_rows else None

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, score = np.zeros((len(mine), 0), np.int64), np.zeros((len(mine), 0))
        for batch in batches:
            if len(batch):
                nodes = batch["node"].to_numpy()
                sims = x @ coder.scaled(batch["vec"]).T
                sims[mine[:, None] == nodes[None, :]] = -np.inf
                score = np.concatenate([score, sims], 1)
                node = np.concatenate([node, np.broadcast_to(nodes, sims.shape)], 1)
                most = min(k, score.shape[1])
                at = np.argpartition(-score, most - 1, axis=1)[:, :most]
                node, score = np.take_along_axis(node, at, 1), np.take_along_axis(score, at, 1)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(mine, node.shape[1])), pa.array(node.ravel()), pa.array(score.ravel())], names=["query", "node", "score"])

    found = vectors.select("node", "vec").mapInArrow(compare, "query long, node long, score double").filter("score > double('-infinity')")
    best = found.groupBy("query").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("far"), "node"))), 1, k).alias("b"))
    return best.select("query", F.size("b").alias("wanted"), (-F.element_at("b.far", -1)).alias("least"))


def search(queries: DataFrame, graph: DataFrame, coder: Coder, vectors: DataFrame, scratch: Scratch, k: int) -> DataFrame:
    """query, node: nodes found near each query node (column node of ``queries``, distinct).

    The checked queries alone are searched with wider and wider beams until they have found TARGET of their nearest; then all
    are searched with that width. So recall doesn't fall as tables grow, and no query is searched twice but those few.
    """
    # lists of long vectors lead to those of large inner product; a constant number of them
    size = F.aggregate(F.transform("vec", lambda x: (x.cast("double") / coder.largest) ** 2), F.lit(0.0), lambda s, x: s + x)
    longest = vectors.orderBy(F.desc(size), "node").limit(LONGEST).select("node").join(graph.select("node", "point"), "node").toArrow()
    hubs = longest["node"].to_numpy()
    hub_points = coder.points(longest["point"].combine_chunks()) if len(hubs) else None

    def begin(width: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if len(batch):
                    sims, found = coder.points(batch["point"]) @ hub_points.T, []
                    for node, near, sim, far in zip(batch["node"].to_pylist(), batch["near"].to_pylist(), batch["sim"].to_pylist(), sims, strict=True):
                        beam = np.array([*near, *hubs], np.int64)
                        _, first = np.unique(beam, return_index=True)
                        first = first[beam[first] != node]
                        score = np.concatenate([np.array(sim, np.float32), far]).astype(np.float32)
                        found.append(_turn(beam[first], score[first], np.zeros(len(first), bool), width))
                    yield _states(batch["node"].to_pylist(), batch["point"], found)

        return run

    def go_on(width: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = []
                for i, node in enumerate(batch["node"].to_pylist()):
                    beam, score, done = (batch[c][i].values.to_numpy(zero_copy_only=False) for c in ("beam", "score", "done"))
                    met = batch["met"][i] if "met" in batch.schema.names else None
                    if met is None:  # a wider beam: what was to be expanded still is
                        done = done & ~np.isin(beam, batch["go"][i].values.to_numpy())
                    elif met.is_valid:
                        near, first = np.unique(met.values.field(0).flatten().to_numpy(), return_index=True)
                        first = first[~np.isin(near, np.append(beam, node))]
                        beam, score = (np.concatenate([own, met.values.field(f).flatten().to_numpy()[first]]) for own, f in ((beam, 0), (score, 1)))
                        done = np.concatenate([done, np.zeros(len(first), bool)])
                    found.append(_turn(beam, score, done, width))
                yield _states(batch["node"].to_pylist(), batch["point"], found)

        return run

    def settled(state: DataFrame, name: str, width: int, open_: int = 0) -> DataFrame:
        """States after hops until at most ``open_`` queries have an open node."""
        hop = 0
        state = scratch.table(state, f"{name}-0")
        while state.filter("size(go) > 0").limit(open_ + 1).count() > open_:
            hop += 1
            state = scratch.table(state.join(_expanded(state, graph, coder, width), "node", "left").mapInArrow(go_on(width), _STATE), f"{name}-{hop}")
            scratch.drop(f"{name}-{hop - 1}")
        return state

    def found(state: DataFrame, width: int) -> DataFrame:
        return state.select(F.col("node").alias("query"), F.explode(F.slice("beam", 1, max(2 * k + 8, width))).alias("node"))

    width = max(BEAM // 2, k + 4)
    few = scratch.table(queries.select("node").orderBy(F.xxhash64("node"), "node").limit(CHECKED), "checked")
    asked = scratch.table(vectors.join(F.broadcast(few), "node", "left_semi").select("node", "vec"), "asked-vectors")
    truth = scratch.table(exact_least(asked, vectors, coder, k), "truth")
    wanted = truth.agg(F.sum("wanted")).first()[0] or 0

    def hits(state: DataFrame, width: int) -> int:
        """Nearest that the checked queries have found: as near as the last of the true ones, so ties count whichever is found."""
        score = F.aggregate(F.zip_with("query_vec", "vec", lambda x, y: x.cast("double") / coder.largest * (y.cast("double") / coder.largest)), F.lit(0.0), lambda s, x: s + x)
        pairs = found(state, width).join(vectors, "node").join(asked.select(F.col("node").alias("query"), F.col("vec").alias("query_vec")), "query").select("query", score.alias("score"))
        near = pairs.join(truth, "query").filter(F.col("score") >= F.col("least") - 1e-12).groupBy("query").agg(F.least(F.count("*"), F.first("wanted")).alias("n"))
        return near.agg(F.sum("n")).first()[0] or 0
    state = settled(graph.join(F.broadcast(few), "node", "left_semi").mapInArrow(begin(width), _STATE), f"check-{width}", width, CHECKED // 8)
    while hits(state, width) < TARGET * wanted and width < WIDEST:
        width = width * 3 // 2
        state = settled(state.mapInArrow(go_on(width), _STATE), f"check-{width}", width, CHECKED // 8)
    if queries.limit(CHECKED + 1).count() <= CHECKED:
        state = settled(state, "search", width)
    else:
        state = settled(graph.join(queries.select("node"), "node", "left_semi").mapInArrow(begin(width), _STATE), "search", width)
    return found(state, width).unionByName(state.select(F.col("node").alias("query"), "node"))


def nearest(df: DataFrame, k: int = 20, every: int = 20, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found for each row whose id is divisible by ``every``."""
    scratch = Scratch(df.sparkSession, "ann")
    ids, vectors = distinct_vectors(df, vec_id, vector, scratch)
    asked = scratch.table(ids.filter(F.col("vec_id") % every == 0).groupBy(F.col("vec_id").alias("query_id")).agg(F.min("node").alias("node")), "asked")
    graph, coder = build_graph(vectors, scratch)
    with _by_node(graph, scratch) as graph:
        found = scratch.table(search(asked.select("node").distinct(), graph, coder, vectors, scratch, k), "found")
    dot = F.aggregate(F.zip_with("query_vec", "vec", lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    scored = found.join(vectors, "node").join(vectors.select(F.col("node").alias("query"), F.col("vec").alias("query_vec")), "query").select("query", "node", dot.alias("score"))
    # of each node only the k + 1 smallest ids can be among a query's k nearest; salted, then merged
    part = ids.groupBy("node", F.expr("pmod(xxhash64(vec_id), 64)").alias("salt")).agg(F.slice(F.array_sort(F.collect_list("vec_id")), 1, k + 1).alias("ids"))
    some = part.groupBy("node").agg(F.slice(F.array_sort(F.flatten(F.collect_list("ids"))), 1, k + 1).alias("ids"))
    wide = scored.join(some, "node").select("query", F.explode("ids").alias("vec_id"), "score").groupBy("query", "vec_id").agg(F.max("score").alias("score"))
    row = F.struct((-F.col("score")).alias("far"), "vec_id", "score")
    best = wide.groupBy(F.col("query").alias("node")).agg(F.slice(F.array_sort(F.collect_list(row)), 1, k + 1).alias("best"))
    lists = keyed_join(asked, best, "node").select("query_id", F.slice(F.filter("best", lambda b: b["vec_id"] != F.col("query_id")), 1, k).alias("best"))
    return lists.select("query_id", F.posexplode("best").alias("rank", "b")).select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), "b.vec_id", "b.score")
