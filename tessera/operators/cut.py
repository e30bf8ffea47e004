"""Cutting lineage between the rounds of iterative operators, and broadcasts behind a check of size."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a side that may be broadcast; a larger one is joined by shuffle.
FEW = 100_000


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage by ``checkpoint()`` in the folder that the cluster names; one of our own only where all runs on this machine."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir", None)
        if not folder and (not context.master.startswith("local") or context.master.startswith("local-cluster")):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="tessera-"))
    return df.checkpoint()


def few(df: DataFrame, most: int = FEW) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``most`` rows, else as it is. Counts it, so it should be cheap or cut."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df
