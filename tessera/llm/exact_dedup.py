"""Exact deduplication with a two-pass Bloom filter.

Texts are equal when identical after every run of ``[\\x20\\x09-\\x0D]`` is one space. Pass one puts all text
hashes into a blocked filter (one 64-bit word and four of its bits a text): every task keeps the bits hit once
and those hit again, in memory bounded by ``BUFFER``, and only these words are merged. Pass two tests every hash against the bits hit at least twice: a
row with a bit hit once has no twin and passes straight through; only the others ("suspects") shuffle, and a comparison of
full SHA-256 sums decides. A filter has at most ``max_bits`` bits: a larger corpus is cut by a
prefix of the hash, and the two passes run prefix by prefix, so the share of suspects without a twin stays the same
(about one in a hundred) at every size.

Nulls, empty and long texts, ties and repeated rows: a null text counts as empty, empty texts equal each other, a text of
any length is hashed whole. Of equal texts the smallest doc_id stays; null doc_ids come last. If that row itself is repeated
(same doc_id, same text) one of the repeats stays. An empty table gives no rows. Other columns are kept as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import Scratch, fresh, text_of
from tessera.llm.skew import Members, filter_words, word_and_mask

#: Bits per text, and the most bits of one filter (32 MB when broadcast).
BITS_PER_ROW, MAX_BITS = 16, 1 << 28
#: Words that a task merges at once, and words of the filter that come back as one row.
BUFFER, SEGMENT = 500_000, 4096
#: A group with at least this share of all rows is joined by broadcast; there are at most 1 / HOT such groups.
HOT = 1e-3


def text_sha256(text: Column) -> Column:
    return F.sha2(F.regexp_replace(text, r"[\x20\x09-\x0D]+", " ").cast("binary"), 256)


def merge_words(word: np.ndarray, once: np.ndarray, twice: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words, the bits that any row hit, and those hit by two rows or marked as such by one."""
    order = np.lexsort((once, word))
    word, once, twice = word[order], once[order], twice[order]
    same = np.flatnonzero(np.concatenate([[True], (np.diff(word) != 0) | (np.diff(once) != 0)]))
    repeated = np.diff(same, append=len(word)) > 1
    twice = np.bitwise_or.reduceat(twice, same) | np.where(repeated, once[same], 0)
    word, once = word[same], once[same]
    begins = np.flatnonzero(np.diff(word, prepend=word[0] - 1))
    any_, again = once[begins].copy(), np.bitwise_or.reduceat(twice, begins)
    sizes = np.diff(begins, append=len(word))
    for k in range(1, int(sizes.max())):
        more = np.flatnonzero(sizes > k)
        bits = once[begins[more] + k]
        again[more] |= any_[more] & bits
        any_[more] |= bits
    return word[begins], any_, again


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    parts, size = [], 0
    for batch in batches:
        if len(batch):
            parts.append([c.to_numpy() for c in batch.columns])
            size += len(batch)
            if size > BUFFER:
                parts = [merge_words(*map(np.concatenate, zip(*parts, strict=True)))]
                size = len(parts[0][0])
                if size > BUFFER // 2:
                    yield parts.pop()
                    size = 0
    if parts:
        yield merge_words(*map(np.concatenate, zip(*parts, strict=True)))


def repeated_bits(hashes: DataFrame, sha: str, words: int):
    """Broadcast words of the filter bits that at least two rows hit."""

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in _merged(batches):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], names=["word", "once", "twice"])

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # the rows of a partition's words fit a task: each comes once from a task's buffer
        rows = [[c.to_numpy() for c in batch.columns] for batch in batches if len(batch)]
        if rows:
            word, _, twice = merge_words(*map(np.concatenate, zip(*rows, strict=True)))
            word, twice = word[twice != 0], twice[twice != 0]
            for s in np.unique(word // SEGMENT).tolist():
                out, mine = np.zeros(min(SEGMENT, words), np.int64), word // SEGMENT == s
                out[word[mine] % SEGMENT] = twice[mine]
                yield pa.RecordBatch.from_arrays([pa.array([s]), pa.array([out.tobytes()], pa.binary())], names=["segment", "bits"])

    place = hashes.select(*word_and_mask(F.col(sha), words)).withColumn("twice", F.lit(0).cast("long"))
    some = place.mapInArrow(first, "word long, once long, twice long").repartition(F.expr(f"word div {SEGMENT}"))
    bitset = np.zeros(words, np.int64)
    for r in some.mapInArrow(second, "segment long, bits binary").toLocalIterator():
        bits = np.frombuffer(r["bits"], np.int64)
        bitset[r["segment"] * SEGMENT :][: len(bits)] = bits
    return hashes.sparkSession.sparkContext.broadcast(bitset.tobytes())


def suspect(sha: Column, words: int, bitset) -> Column:
    """Whether every bit of the hash was hit at least twice."""

    @F.arrow_udf("boolean")
    def test(word: pa.Array, mask: pa.Array) -> pa.Array:
        mask = mask.to_numpy()
        return pa.array(np.frombuffer(bitset.value, np.int64)[word.to_numpy()] & mask == mask)

    return test(*word_and_mask(sha, words))


def _plan(df: DataFrame, doc_id: str, text: str, max_bits: int) -> tuple[DataFrame, DataFrame, int]:
    """(doc_id, text_sha256 and suspect of every row; the groups of suspects; rows). One scan of the texts."""
    scratch = Scratch(df.sparkSession, "exact-dedup")
    hashes = scratch.table(df.select(df[doc_id].alias("doc_id"), text_sha256(text_of(df, text)).alias("text_sha256")), "hashes")
    rows = hashes.count()
    prefixes = max(1, -(-rows * BITS_PER_ROW // max_bits))
    words = filter_words(-(-rows // prefixes), BITS_PER_ROW, max_bits)
    if prefixes > 1:
        cut = F.expr(f"pmod(xxhash64(text_sha256, 2), {prefixes})").alias("prefix")
        hashes.select("*", cut).write.partitionBy("prefix").parquet(scratch.path("cut"))
        cut = df.sparkSession.read.parquet(scratch.path("cut"))
        parts = [cut.filter(F.col("prefix") == p).drop("prefix") for p in range(prefixes)]
    else:
        parts = [hashes]
    for part in parts:
        bitset = repeated_bits(part, "text_sha256", words)
        flagged = part.withColumn("suspect", suspect(F.col("text_sha256"), words, bitset))
        flagged.write.mode("append").parquet(scratch.path("flagged"))
        bitset.destroy()
    flagged = df.sparkSession.read.schema(flagged.schema).parquet(scratch.path("flagged"))
    groups = scratch.table(flagged.filter("suspect").groupBy("text_sha256").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size")), "groups")
    for name in ("hashes", "cut"):
        scratch.drop(name)
    return flagged, groups, rows


def _grouped(flagged: DataFrame, groups: DataFrame, rows: int) -> DataFrame:
    """Suspects with keep_id and group_size; rows of hot groups meet a broadcast of those few."""
    suspects = flagged.filter("suspect").drop("suspect")
    hot = F.broadcast(groups.filter(F.col("group_size") >= F.lit(HOT * rows)))
    cool = groups.filter(F.col("group_size") < F.lit(HOT * rows))
    return suspects.join(hot, "text_sha256").unionByName(suspects.join(hot, "text_sha256", "left_anti").join(cool, "text_sha256"))


def dedup_decisions(df: DataFrame, doc_id: str = "doc_id", text: str = "text", max_bits: int = MAX_BITS) -> DataFrame:
    """One row per row of ``df``: doc_id, keep_id, group_size, kept, text_sha256."""
    flagged, groups, rows = _plan(df, doc_id, text, max_bits)
    out = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    alone = flagged.filter(~F.col("suspect")).select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    joined = _grouped(flagged, groups, rows)
    stays = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    first = F.row_number().over(Window.partitionBy("text_sha256").orderBy("doc_id")) == 1
    kept = joined.filter(stays).withColumn("kept", first)
    return alone.unionByName(kept.select(*out)).unionByName(joined.filter(~stays).withColumn("kept", F.lit(False)).select(*out))


def exact_dedup(df: DataFrame, doc_id: str = "doc_id", text: str = "text", max_bits: int = MAX_BITS) -> DataFrame:
    """The rows of ``df`` that stay, with their columns.

    Only texts of rows that go, or whose id and text are repeated, shuffle (a Bloom filter tells), by both, so a hot group is spread.
    """
    flagged, groups, rows = _plan(df, doc_id, text, max_bits)
    pairs = _grouped(flagged, groups, rows).groupBy("text_sha256", "doc_id", "keep_id").agg(F.count("*").alias("n"))
    goes = ~F.col("doc_id").eqNullSafe(F.col("keep_id"))
    mark = lambda sha, key: F.xxhash64(sha, F.coalesce(key.cast("string"), F.lit("")))
    pairs = pairs.filter(goes | (F.col("n") > 1)).select("text_sha256", "doc_id", goes.alias("goes"), mark(F.col("text_sha256"), F.col("doc_id")).alias("mark"))
    pairs = Scratch(df.sparkSession, "exact-dropped").table(pairs, "pairs")
    sha, flag, key, gone = fresh(df, "text_sha256", "touched", "gone_sha256", "gone_id")
    texts = df.withColumn(sha, text_sha256(text_of(df, text)))
    texts = texts.withColumn(flag, Members(pairs, "mark").may_hold(mark(F.col(sha), F.col(doc_id))))
    dropped = pairs.filter("goes").select(F.col("text_sha256").alias(key), F.col("doc_id").alias(gone))
    stay = texts.filter(F.col(flag)).join(dropped, (F.col(sha) == F.col(key)) & F.col(doc_id).eqNullSafe(F.col(gone)), "left_anti").dropDuplicates([sha, doc_id])
    return texts.filter(~F.col(flag)).unionByName(stay).select(*df.columns)
