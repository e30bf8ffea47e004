"""An inverted file over vectors: k-means lists in folders of their own, probed by partition pruning.

Centroids come from k-means of Spark over a bounded sample; every vector is put into the list of its nearest centroid. Each list keeps its centroid, its number of rows and
its radius, the largest distance from the centroid, so a search can say how near a vector of a list may be at best. A search over the ``probes``
nearest lists is approximate; without ``probes`` it reads lists until the others can't hold anything nearer, which is exact. Below ``EXACT_BELOW`` rows there is one
list. Folders of other lists are neither listed nor read.

Nulls and vectors of another width than most aren't indexed; zero vectors aren't either where the distance is by angle. Ties go to the smaller idx. An empty table gives an index without lists.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.recall import index_policy, vector_search

#: Rows of the sample on which centroids are fitted: so many per list, and at most. Everything else covers all rows.
PER_LIST, SAMPLE = 256, 500_000
#: Added to a radius, so rounding never hides a row.
SLACK = 1e-5
ITERATIONS = 10


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _fit(vectors: DataFrame, lists: int, rows: int) -> np.ndarray:
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    share = min(1.0, min(SAMPLE, PER_LIST * lists) / max(1, rows))
    part = F.pmod(F.xxhash64("idx"), F.lit(1 << 20)) < share * (1 << 20)
    sample = (vectors.filter(part) if share < 1 else vectors).select(array_to_vector("unit").alias("features"))
    if lists == 1:
        from pyspark.ml.stat import Summarizer

        return np.array([sample.select(Summarizer.mean(F.col("features"))).first()[0].toArray()])
    return np.array(KMeans(k=lists, seed=7, maxIter=ITERATIONS).fit(sample).clusterCenters())


class VectorLists:
    """An index in a folder: ``build`` makes one, the constructor opens it."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        about = json.loads(spark.read.text(f"{self.root}/about").first()[0])
        self.distance, self.width = about["distance"], about["width"]
        rows = self.spark.read.parquet(f"{self.root}/centroids").orderBy("list").collect()
        self.list = np.array([r["list"] for r in rows], np.int64)
        self.centroid = np.array([r["centroid"] for r in rows], float).reshape(len(rows), self.width)
        self.radius, self.rows = np.array([r["radius"] for r in rows], float), np.array([r["rows"] for r in rows], np.int64)
        self.scanned = 0

    @classmethod
    def build(cls, vectors: DataFrame, root: str, distance: str = "cosine", lists: int | None = None, vector: str = "values") -> VectorLists:
        """Index ``vectors`` (idx and a vector). ``lists``: their number, by ``index_policy`` if not given."""
        spark = vectors.sparkSession
        rows = vectors.select(F.col("idx").cast("long").alias("idx"), F.col(vector).cast("array<double>").alias("values")).filter("idx is not null and size(values) > 0 and forall(values, x -> x is not null and not isnan(x))")
        usual = rows.groupBy(F.size("values").alias("w")).count().orderBy(F.desc("count"), "w").first()
        width = usual["w"] if usual else 0
        norm = F.sqrt(F.aggregate("values", F.lit(0.0), lambda s, x: s + x * x))
        rows = rows.filter(F.size("values") == width)
        if distance == "cosine":
            rows = rows.withColumn("_norm", norm).filter("_norm > 0").withColumn("unit", F.transform("values", lambda x: x / F.col("_norm"))).drop("_norm")
        else:
            rows = rows.withColumn("unit", F.col("values"))
        n = rows.count() if width else 0
        wanted = lists if lists is not None else max(1, index_policy(n)[1])
        spark.createDataFrame([(json.dumps({"distance": distance, "width": width}),)], "value string").coalesce(1).write.text(f"{root}/about")
        centroids = _fit(rows, min(wanted, n), n) if n else np.zeros((0, width))
        squares = (centroids**2).sum(1)

        def assign(batches):
            for batch in batches:
                if len(batch):
                    x = _matrix(batch["unit"])
                    near = np.argmin(squares[None] - 2 * x @ centroids.T, axis=1)
                    far = np.sqrt(((x - centroids[near]) ** 2).sum(1))
                    yield pa.RecordBatch.from_arrays([batch["idx"], batch["values"], pa.array(near, pa.int32()), pa.array(far)], names=["idx", "values", "list", "far"])

        dealt = rows.mapInArrow(assign, "idx long, values array<double>, list int, far double") if n else spark.createDataFrame([], "idx long, values array<double>, list int, far double")
        # large lists are split over files, small ones share a task
        dealt.hint("rebalance", "list").write.partitionBy("list").parquet(f"{root}/lists")
        stored = spark.read.schema("idx long, values array<double>, far double, list int").parquet(f"{root}/lists").groupBy("list").agg(F.max("far").alias("radius"), F.count("*").alias("rows"))
        table = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centroids)], "list int, centroid array<double>")
        table.join(stored, "list").coalesce(1).write.parquet(f"{root}/centroids")
        return cls(spark, root)

    def _bounds(self, query: np.ndarray) -> np.ndarray:
        """The least distance that a row of each list may have."""
        radius = self.radius * (1 + SLACK) + SLACK
        if self.distance == "l2":
            return np.sqrt(((self.centroid - query) ** 2).sum(1)) - radius
        if self.distance == "ip":
            return -(self.centroid @ query) - np.linalg.norm(query) * radius
        unit = query / np.linalg.norm(query)
        return 1 - self.centroid @ unit - radius

    def _read(self, lists: np.ndarray) -> DataFrame:
        # the lists' own paths, so that no other folder is even listed
        paths = [f"{self.root}/lists/list={n}" for n in self.list[lists]]
        self.scanned += int(self.rows[lists].sum())
        return self.spark.read.schema("idx long, values array<double>").parquet(*paths)

    def search(self, query: list[float], k: int, probes: int | None = None) -> DataFrame:
        """idx, distance of the ``k`` nearest: among the ``probes`` nearest lists, or of all rows. ``scanned`` counts rows of the lists read."""
        if k <= 0 or not query:
            raise ValueError("k and the query must not be empty")
        self.scanned = 0
        q = np.array(query, float)
        if len(q) != self.width or not len(self.list):
            return self.spark.createDataFrame([], "idx long, distance double")
        bounds = self._bounds(q)
        order = np.argsort(bounds, kind="stable")
        if probes is not None:
            centre = bounds + (self.radius if self.distance != "ip" else np.linalg.norm(q) * self.radius)
            return vector_search(self._read(np.argsort(centre, kind="stable")[:probes]), query, k, self.distance)
        first = order[: 1 + int(np.searchsorted(np.cumsum(self.rows[order]), k))]
        best = vector_search(self._read(first), query, k, self.distance)
        rest = np.setdiff1d(order, first)
        if not len(rest):
            return best
        found = best.collect()
        if len(found) >= k:
            rest = rest[bounds[rest] <= found[-1]["distance"]]
        near = self.spark.createDataFrame([tuple(r) for r in found], "idx long, distance double")
        if len(rest):
            near = near.unionByName(vector_search(self._read(rest), query, k, self.distance))
        return near.orderBy("distance", "idx").limit(k)
