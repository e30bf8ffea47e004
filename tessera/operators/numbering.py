"""Consecutive numbers over a whole table in a given order, without a task that sees it all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.cut import cut


def numbered(rows: DataFrame, order: list[str | Column], name: str = "number") -> DataFrame:
    """``rows`` with ``name``: 0, 1, 2 ... in the given order, which must be total for the numbers to be reproducible.

    Rows are sorted by ranges and written, so a range keeps its rows when a task runs again. Each range counts its
    rows, the driver adds up one number a range, and rows are numbered inside their range. An empty table stays empty.
    """
    spark = rows.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    part, at = f"_{name}_part", f"_{name}_at"
    dealt = cut(rows.repartitionByRange(n, *order).withColumn(part, F.spark_partition_id()))
    base, bases = 0, []
    for r in sorted(dealt.groupBy(part).agg(F.count("*").alias("n")).collect()):
        bases.append((r[part], base))
        base += r["n"]
    bases = spark.createDataFrame(bases, f"{part} int, _{name}_base long")
    inside = dealt.withColumn(at, F.row_number().over(Window.partitionBy(part).orderBy(*order)) - 1)
    return inside.join(F.broadcast(bases), part).withColumn(name, F.col(f"_{name}_base") + F.col(at)).drop(part, at, f"_{name}_base")
