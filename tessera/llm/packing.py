"""Packing by power-of-two decomposition.

Each document's ids are cut into pieces whose lengths are the powers of two in the binary form of its
length, none above the sequence length. Pieces of equal length share a bucket, and each piece is a
sequence of its own: no sequence crosses documents and none needs padding. Sequence ids number the
buckets' pieces from the longest bucket to the shortest without gaps.

Nulls, empty and long texts: a null or empty text has the end id alone and gives one piece of length 1; a text of any length is
encoded whole. A null doc_id is kept.
Rows with the same doc_id are packed each by itself. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import Scratch, give_back, text_of

SEQUENCE = 1024
#: Partitions whose counts are summed before the driver sees them, and the most counts that are broadcast (else they are joined by shuffle).
BLOCK, SENT = 1024, 200_000
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, part long, place long"


def decompose(counts: np.ndarray, longest: int = SEQUENCE) -> tuple[np.ndarray, np.ndarray]:
    """(document, length) of the pieces of documents of ``counts`` ids, in order within each document.

    Whole sequences come first, then the remainder's binary digits from the highest.
    """
    top = longest.bit_length() - 1
    docs, lengths = [np.repeat(np.arange(len(counts)), counts >> top)], [np.full(int((counts >> top).sum()), longest, np.int64)]
    for bit in range(top - 1, -1, -1):
        has = np.flatnonzero(counts >> bit & 1)
        docs.append(has)
        lengths.append(np.full(len(has), 1 << bit, np.int64))
    doc = np.concatenate(docs)
    order = np.argsort(doc, kind="stable")
    return doc[order], np.concatenate(lengths)[order]


def pack_documents(df: DataFrame, vocabulary: str, *, longest: int = SEQUENCE, end_id: int = 0, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces with their sequence: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, bucket.

    ``longest`` is a power of two. Texts don't move between tasks; only the small piece rows are
    written, and per (partition, bucket) counts give every piece its number. The driver gets 11 sums per ``BLOCK`` partitions.
    """
    if longest & (longest - 1):
        raise ValueError("the sequence length must be a power of two")
    spark = df.sparkSession

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        from tessera.llm.encode import byte_level_encoder

        encoder = byte_level_encoder(vocabulary, end_id)
        part = TaskContext.get().partitionId()
        seen = np.zeros(longest.bit_length(), np.int64)
        for batch in batches:
            ids, begin = batch.column(0), 0
            for flat, counts in encoder.encode(batch.column(1).to_pylist()):
                doc, length = decompose(counts, longest)
                cuts = np.cumsum(length)
                base = np.cumsum(counts) - counts
                start = cuts - length - base[doc]
                data = memoryview(flat.astype("<u4").tobytes())
                edges = cuts.tolist()
                sums = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip([0, *edges], edges, strict=False)]
                bucket = np.log2(length).astype(np.int64)
                place = np.empty(len(bucket), np.int64)
                for b in np.unique(bucket):
                    at = np.flatnonzero(bucket == b)
                    place[at] = seen[b] + np.arange(len(at))
                    seen[b] += len(at)
                yield pa.RecordBatch.from_arrays([ids.slice(begin, len(counts)).take(pa.array(doc)), pa.array(start), pa.array(length), pa.array(sums, pa.int64()), pa.array(counts[doc]), pa.array(np.full(len(doc), part, np.int64)), pa.array(place)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "part", "place"])
                begin += len(counts)
        give_back()

    rows = df.select(df[doc_id].cast("long").alias("doc_id"), text_of(df, text).alias("text")).mapInArrow(pieces, SCHEMA)
    scratch = Scratch(spark, "packing")
    rows = scratch.table(rows, "pieces")
    # where each partition's pieces of a bucket begin: sums over blocks of partitions, then within each block
    counts = rows.groupBy("length", "part").agg(F.count("*").alias("n")).withColumn("block", F.expr(f"part div {BLOCK}"))
    counts = scratch.table(counts, "counts")
    blocks = sorted((-r["length"], r["block"], r["n"]) for r in counts.groupBy("length", "block").agg(F.sum("n").alias("n")).collect())
    bases, at = [], 0
    for minus, block, n in blocks:
        bases.append((-minus, block, at))
        at += n
    bases = spark.createDataFrame(bases, "length long, block long, base long")
    before = F.sum("n").over(Window.partitionBy("length", "block").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    firsts = counts.withColumn("before", F.coalesce(before, F.lit(0))).join(F.broadcast(bases), ["length", "block"]).select("length", "part", (F.col("base") + F.col("before")).alias("first"))
    if counts.count() <= SENT:
        firsts = F.broadcast(firsts)
    return rows.join(firsts, ["length", "part"]).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("first") + F.col("place")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"), F.log2("length").cast("int").alias("bucket"))
