"""Standing answers of models as a table: kept by address, asked for once at a time, evicted by bytes.

Answers lie in Parquet folders of hash buckets of their address; a lookup reads the buckets of its addresses alone. Putting, using and claiming are commits of
the transaction log, so jobs share one table: a claimed address is asked about by one job until its claim ends, an eviction loses no
answer that is put meanwhile. Only answers that are JSON objects are kept. Of several answers of an address the newest counts.

Eviction keeps the longest run of last used answers that fits. Its end is found by histograms of bytes over the time of use, refined until a bin is
one moment; answers of that moment are admitted by address. There is no sort of all answers, and no task sees them all.
Null addresses and texts are no answers. An empty table answers nothing and evicts nothing.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.budget import running_total
from tessera.operators.cut import cut
from tessera.operators.txlog import Conflict, Log

#: Bins of a histogram in eviction; a moment among 2^62 is found in eight rounds.
BINS = 256
_ROW = "address string, text string, stored_at long, used_at long"


def fitting(rows: DataFrame, most: int, used: str = "used_at", size: str = "bytes", tie: str = "address") -> DataFrame:
    """The longest prefix of ``rows`` by ``used`` (a long, latest first), then ``tie``, whose sizes add up to ``most`` at most.

    Null sizes count as 0, null uses as the oldest. Equal ties are refused or admitted one by one in no stated order.
    """
    oldest = -(2**62)
    rows = cut(rows.withColumns({"_u": F.coalesce(F.col(used).cast("long"), F.lit(oldest)), "_b": F.coalesce(F.col(size).cast("long"), F.lit(0))}))
    ends = rows.agg(F.min("_u").alias("low"), F.max("_u").alias("high"), F.sum("_b").alias("total")).first()
    if ends["total"] is None or ends["total"] <= most:
        return rows.drop("_u", "_b")
    low, high, room = ends["low"], ends["high"], most
    while low < high:  # the run ends within [low, high]; all that was used later fits and is taken off ``room``
        step = (high - low) // BINS + 1
        inside = rows.filter(F.col("_u").between(low, high))
        bins = inside.groupBy(F.expr(f"({high} - _u) div {step}").alias("bin")).agg(F.sum("_b").alias("n")).collect()
        for r in sorted(bins):
            if r["n"] > room:
                low, high = max(low, high - (r["bin"] + 1) * step + 1), high - r["bin"] * step
                break
            room -= r["n"]
    at = running_total(rows.filter(F.col("_u") == low), [tie], F.col("_b"), "_sum").filter(F.col("_sum") <= room)
    return rows.filter(F.col("_u") > low).unionByName(at.drop("_sum")).drop("_u", "_b")


class Answers:
    """The table under ``root``. Times are seconds as longs; the caller's clock decides."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = 64) -> None:
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets
        self.log = Log(spark, root)

    def _bucket(self, address: str = "address") -> Column:
        return F.pmod(F.xxhash64(address), F.lit(self.buckets)).cast("int")

    def _parts(self, number: int) -> dict[str, list[int]]:
        """Buckets of each folder that holds answers or uses."""
        return {r["key"]: json.loads(r["value"]) for r in self.log.state(number).filter("key like 'part %'").collect()}

    def _read(self, parts: dict[str, list[int]], buckets: set[int] | None = None) -> DataFrame:
        """address, text, stored_at, used_at: one row for each address that has an answer."""
        paths = [f"{self.root}/{key.removeprefix('part ')}/bucket={b}" for key, have in parts.items() for b in have if buckets is None or b in buckets]
        rows = self.spark.read.schema(_ROW).parquet(*paths) if paths else self.spark.createDataFrame([], _ROW)
        newest = rows.groupBy("address").agg(F.max(F.when(F.col("text").isNotNull(), F.struct("stored_at", "text"))).alias("a"), F.max("used_at").alias("used_at"))
        return newest.filter("a is not null").select("address", "a.text", "a.stored_at", "used_at")

    def _write(self, rows: DataFrame) -> tuple[str, str]:
        """Key and value that name a new folder with these rows."""
        version = f"v-{uuid.uuid4().hex}"
        n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        rows.withColumn("bucket", self._bucket()).repartitionByRange(n, "bucket", "address").write.partitionBy("bucket").parquet(f"{self.root}/{version}")
        return f"part {version}", json.dumps([int(x.removeprefix("bucket=")) for x in self.log.folder.names(version) if x.startswith("bucket=")])

    def rows(self) -> DataFrame:
        return self._read(self._parts(self.log.version()))

    def put(self, answers: DataFrame, now: int) -> None:
        """Keep ``answers`` (address, text) and end the claims on their addresses, those of refused answers included."""
        answers = cut(answers.select("address", "text").filter("address is not null"))
        good = answers.filter(F.coalesce(F.schema_of_variant(F.try_parse_json("text")).startswith("OBJECT"), F.lit(False)))
        key, value = self._write(good.select("address", "text", F.lit(now).cast("long").alias("stored_at"), F.lit(now).cast("long").alias("used_at")))
        ended = answers.select(F.concat(F.lit("asking "), "address").alias("key"), F.lit(None).cast("string").alias("value")).distinct()
        self.log.commit({key: value}, table=ended)

    def lookup(self, wanted: DataFrame, now: int) -> tuple[DataFrame, DataFrame]:
        """(address, text of those with an answer, addresses without one) of ``wanted`` (address); answers found are used now."""
        wanted = cut(wanted.select("address").filter("address is not null").distinct())
        buckets = {r[0] for r in wanted.select(self._bucket()).distinct().collect()}
        known = cut(self._read(self._parts(self.log.version()), buckets).join(wanted, "address", "left_semi").select("address", "text"))
        if not known.isEmpty():
            none = F.lit(None).cast("string")
            key, value = self._write(known.select("address", none.alias("text"), none.cast("long").alias("stored_at"), F.lit(now).cast("long").alias("used_at")))
            self.log.commit({key: value})
        return known, wanted.join(known, "address", "left_anti")

    def claim(self, wanted: DataFrame, holder: str, now: int, seconds: int) -> DataFrame:
        """Those of ``wanted`` (address) that this holder is to ask about: nobody else does until ``now`` + ``seconds``."""
        wanted = cut(wanted.select("address").filter("address is not null").distinct())
        until = F.get_json_object("value", "$.until").cast("long")
        other = ~F.get_json_object("value", "$.holder").eqNullSafe(F.lit(holder))
        value = json.dumps({"holder": holder, "until": now + seconds})
        while True:
            seen = self.log.version()
            state = self.log.state(seen).filter("key like 'asking %'").filter((until > now) & other)
            free = cut(wanted.join(state.select(F.substring("key", 8, 1 << 30).alias("address")), "address", "left_anti"))
            try:
                self.log.commit({}, seen=seen, table=free.select(F.concat(F.lit("asking "), "address").alias("key"), F.lit(value).alias("value")))
                return free
            except Conflict:
                continue

    def evict(self, now: int, ttl: int, most: int) -> int:
        """Keep answers stored less than ``ttl`` seconds ago, and of those the last used ones of ``most`` bytes; returns how many went.

        Folders are exchanged in one commit; answers put or used since the snapshot have folders of their own and stay.
        """
        seen = self.log.version()
        parts = self._parts(seen)
        have = cut(self._read(parts))
        young = have.filter(F.col("stored_at") > now - ttl).withColumn("bytes", F.octet_length("text"))
        kept = cut(fitting(young, most).drop("bytes"))
        key, value = self._write(kept)
        self.log.commit({**dict.fromkeys(parts), key: value}, seen=seen)
        return have.count() - kept.count()
