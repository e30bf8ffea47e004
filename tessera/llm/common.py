"""Shared helpers: scratch tables in the folder the cluster names, and session set-up.

Every table that cuts lineage is written as Parquet under ``spark.checkpoint.dir`` (a folder that
all executors share), so a lost executor only costs the tasks it was running.
"""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of one Arrow batch; a longer row is a batch by itself. Shuffle files go when the action that made them ends, not when the
#: driver happens to collect its garbage: what later steps read is written as tables.
SETTINGS = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": "4m", "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}

_own_folder: dict[str, str] = {}


def ensure_importable(spark: SparkSession) -> None:
    """Let Python workers import this package wherever the driver found it, bound Arrow batches by bytes, and drop shuffle files early.

    Results are lazy and Spark reads these settings when they are planned, so they are set for the session, but only
    where its user left them unset.
    """
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    have = env.get("PYTHONPATH", "").split(os.pathsep) + os.environ.get("PYTHONPATH", "").split(os.pathsep)
    if root not in have:
        env["PYTHONPATH"] = os.pathsep.join([root, *filter(None, env.get("PYTHONPATH", "").split(os.pathsep))])
    own = spark.conf.getAll
    for key, value in SETTINGS.items():
        if key not in own:
            spark.conf.set(key, value)


def give_back() -> None:
    """At the end of a task, return its worker's free memory to the system: the worker lives on for other stages."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where it is unset, a temporary one of our own if all runs on this machine."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_folder:
        _own_folder[app] = Path(tempfile.mkdtemp(prefix="tessera-")).as_uri()
        spark.sparkContext.setCheckpointDir(_own_folder[app])
    return _own_folder[app]


def delete(spark: SparkSession, uri: str) -> None:
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(uri)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


class Scratch:
    """Names a folder in the shared one for the intermediate tables of one call."""

    def __init__(self, spark: SparkSession, what: str) -> None:
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{what}-{uuid.uuid4().hex}"
        atexit.register(self._remove, os.getpid())

    def _remove(self, pid: int) -> None:
        if pid == os.getpid():
            try:
                delete(self.spark, self.root)
            except Exception:  # noqa: BLE001  the JVM may already be gone at exit
                return

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and return it as read back, without its lineage."""
        df.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, name: str) -> None:
        delete(self.spark, self.path(name))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def fresh(df: DataFrame, *wanted: str) -> list[str]:
    """Column names close to ``wanted`` that ``df`` does not have (case is ignored, as in Spark)."""
    have, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in have:
            name = f"_{name}"
        have.add(name.lower())
        out.append(name)
    return out


def text_of(df: DataFrame, text: str) -> Column:
    return F.coalesce(df[text].cast("string"), F.lit(""))


def uri_fs(uri: str):
    """pyarrow file system and path of a folder or file; works for local and shared stores alike."""
    from pyarrow import fs

    if "://" not in uri and uri.startswith("file:/"):
        uri = "file://" + uri[len("file:") :]
    return fs.FileSystem.from_uri(uri)


def as_list(values: str | Sequence[str]) -> list[str]:
    return [values] if isinstance(values, str) else list(values)
