"""Jobs of many workers in one transaction log: claims, heartbeats, reports and expiry are commits.

A worker reads a snapshot, lets ``jobs`` say which rows change, and commits them; if another worker's commit touches one of
these jobs in between, it reads anew. So a job has one holder at a time, and a late report meets a newer fence. Times are given by the caller.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import jobs
from tessera.operators.txlog import Conflict, Log

_JOB = "state string, fence long, lease_until timestamp, created_at timestamp, updated_at timestamp, has_conflict boolean, holder string"
#: Jobs changed by one commit of a sweep.
STEP = 10_000


class Leases:
    """The jobs of a log (keys ``job/`` and the id)."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.log = spark, Log(spark, root)

    def table(self, version: int | None = None) -> DataFrame:
        """job_id and the fields of every job."""
        rows = self.log.state(version).filter(F.col("key").startswith("job/"))
        return rows.select(F.substring("key", 5, 1 << 20).alias("job_id"), F.from_json("value", _JOB).alias("j")).select("job_id", "j.*")

    @staticmethod
    def _rows(changed: DataFrame) -> DataFrame:
        fields = [c.split()[0] for c in _JOB.split(", ")]
        have = [F.col(c) if c in changed.columns else F.lit(None).alias(c) for c in fields]
        return changed.select(F.concat(F.lit("job/"), F.col("job_id").cast("string")).alias("key"), F.to_json(F.struct(*have)).alias("value"))

    def add(self, new: DataFrame) -> int:
        """Add jobs (job_id and any fields) as one commit; ids that are there already are left as they are. A conflict with another adder is tried again."""
        while True:
            seen = self.log.version()
            fresh = new.withColumn("job_id", F.col("job_id").cast("string")).join(self.table(seen).select("job_id"), "job_id", "left_anti")
            try:
                return self.log.commit({}, seen, table=self._rows(fresh))
            except Conflict:
                continue

    def _change(self, decide: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """Commit what ``decide`` makes of the newest jobs (whole rows), again and again until nobody interferes."""
        while True:
            seen = self.log.version()
            changed = decide(self.table(seen))
            rows = self._rows(changed).collect()
            if rows:
                try:
                    self.log.commit({r["key"]: r["value"] for r in rows}, seen)
                except Conflict:
                    continue
            fields = self.spark.createDataFrame([tuple(r) for r in rows], "key string, value string")
            return fields.select(F.substring("key", 5, 1 << 20).alias("job_id"), F.from_json("value", _JOB).alias("j")).select("job_id", "j.*")

    def claim(self, holder: str, now: Column, lease_seconds: int, n: int = 1) -> DataFrame:
        """The jobs that this worker now holds, at most ``n``."""
        return self._change(lambda t: jobs.claim(t, now, lease_seconds, n).withColumn("holder", F.lit(holder)).withColumn("updated_at", now))

    def heartbeat(self, held: DataFrame, now: Column, lease_seconds: int) -> DataFrame:
        """Longer leases for those of ``held`` (job_id, fence) that are still held; the rest is lost to others."""
        return self._change(lambda t: jobs.heartbeat(t, held.withColumn("job_id", F.col("job_id").cast("string")), now, lease_seconds))

    def report(self, wanted: DataFrame, now: Column) -> DataFrame:
        """Carry out requests (job_id, to, by, fence) that hold; returns job_id, state, fence, refused of all of them, as decided with the commit."""
        said: list[DataFrame] = []
        wanted = wanted.withColumn("job_id", F.col("job_id").cast("string"))

        def decide(t: DataFrame) -> DataFrame:
            out = jobs.transitions(t, wanted)
            said[:] = [out]
            return t.join(out.filter("refused is null").select("job_id", F.col("state").alias("to")), "job_id").withColumn("state", F.col("to")).withColumn("updated_at", now).drop("to")

        self._change(decide)
        return said[0]

    def sweep(self, now: Column) -> int:
        """Commit what time has decided, ``STEP`` jobs at a time; reaped jobs leave the table. Returns how many changed."""
        done = 0
        while True:
            seen = self.log.version()
            table = self.table(seen)
            over = jobs.sweep(table, now).orderBy("job_id").limit(STEP).select("job_id", F.col("state").alias("to"))
            rows = table.join(over, "job_id").withColumn("state", F.col("to")).withColumn("updated_at", now)
            found = self._rows(rows).select("key", F.when(F.get_json_object("value", "$.state") != "reaped", F.col("value")).alias("value")).collect()
            if not found:
                return done
            try:
                self.log.commit({r["key"]: r["value"] for r in found}, seen)
                done += len(found)
            except Conflict:
                continue
