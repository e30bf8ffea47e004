"""Joins and membership tests that stay even when one key holds a third of all rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Scratch

#: A key with this share of the left rows is heavy; there are at most 1 / HEAVY of them.
HEAVY = 1e-3
#: Below that many left rows a plain join is even enough.
FEW = 10_000


def heavy_keys(left: DataFrame, key: str, rows: int | None = None) -> list:
    """Keys with a share of HEAVY of the rows or more; none where a plain join is even enough."""
    rows = left.count() if rows is None else rows
    if rows < FEW:
        return []
    found = left.groupBy(key).count().filter(F.col("count") >= HEAVY * rows).select(key).collect()
    return [r[0] for r in found if r[0] is not None]


def keyed_join(left: DataFrame, right: DataFrame, key: str, how: str = "inner", rows: int | None = None, heavy: list | None = None) -> DataFrame:
    """``left`` joined to ``right`` on ``key``, which is unique in ``right``. ``left`` is read more than once.

    Rows of heavy keys meet a broadcast of those few right rows, all others are joined by shuffle.
    """
    heavy = heavy_keys(left, key, rows) if heavy is None else heavy
    if not heavy:
        return left.join(right, key, how)
    among = F.coalesce(F.col(key).isin(heavy), F.lit(False))
    few = F.broadcast(right.filter(among))
    return left.filter(among).join(few, key, how).unionByName(left.filter(~among).join(right, key, how))


def word_and_mask(key: Column, words: int) -> list[Column]:
    """A key's place in a blocked Bloom filter: one 64-bit word (of a power of two) and four bits in it."""
    bits = F.xxhash64(key, F.lit(1))
    mask = F.lit(0).cast("long")
    for i in range(4):
        one = F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(bits, 6 * i).bitwiseAND(F.lit(63)).cast("int"))
        mask = mask.bitwiseOR(one)
    return [F.xxhash64(key, F.lit(0)).bitwiseAND(F.lit(words - 1)).alias("word"), mask.alias("mask")]


def filter_words(rows: int, bits_per_row: int, max_bits: int) -> int:
    """Words of a filter: a power of two, at least 16 and at most ``max_bits`` bits."""
    return 1 << max(4, min(max_bits.bit_length() - 7, int(rows * bits_per_row).bit_length() - 6))


class Members:
    """A Bloom filter over a column, broadcast: at most ``max_bits`` bits, so false hits grow instead of its size."""

    def __init__(self, df: DataFrame, column: str, max_bits: int = 1 << 28) -> None:
        self.words = filter_words(df.count(), 16, max_bits)
        found = df.select(*word_and_mask(F.col(column), self.words)).groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()
        bitset = np.zeros(self.words, np.int64)
        bitset[found["word"].to_numpy()] = found["mask"].to_numpy()
        self.bitset = df.sparkSession.sparkContext.broadcast(bitset.tobytes())

    def place(self, key: Column) -> list[Column]:
        return word_and_mask(key, self.words)

    def test(self, word: pa.Array, mask: pa.Array) -> pa.Array:
        """Inside a task: whether all bits of each row are set."""
        mask = mask.to_numpy()
        return pa.array(np.frombuffer(self.bitset.value, np.int64)[word.to_numpy()] & mask == mask)

    def may_hold(self, key: Column) -> Column:
        @F.arrow_udf("boolean")
        def test(word: pa.Array, mask: pa.Array) -> pa.Array:
            return self.test(word, mask)

        return test(*self.place(key))


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, root) for every end of ``edges`` (columns a, b): root is the smallest node that is connected.

    Rounds of taking the least label of the neighbours and then the label's own label; each round is
    written to the shared folder. Aggregation is partial before the shuffle and hubs join by broadcast.
    """
    both = scratch.table(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), f"{name}-edges")
    n_edges = both.count()
    labels = scratch.table(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("root")), f"{name}-labels-0")
    n_nodes, step = labels.count(), 0
    while n_edges:
        step += 1
        near = keyed_join(both.withColumnRenamed("a", "node"), labels, "node", rows=n_edges)
        near = near.groupBy(F.col("b").alias("node")).agg(F.min("root").alias("low"))
        low = scratch.table(labels.join(near, "node").select("node", F.col("root").alias("was"), F.least("root", "low").alias("root")), f"{name}-low-{step}")
        jump = low.select(F.col("node").alias("root"), F.col("root").alias("next"))
        new = keyed_join(low, jump, "root", rows=n_nodes).select("node", "was", F.col("next").alias("root"))
        new = scratch.table(new, f"{name}-labels-{step}")
        changed = new.filter("root <> was").limit(1).count()
        labels = new.select("node", "root")
        if step > 1:
            scratch.drop(f"{name}-low-{step - 1}")
            scratch.drop(f"{name}-labels-{step - 1}")
        if not changed:
            break
    return labels
