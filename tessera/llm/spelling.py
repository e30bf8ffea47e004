"""Spelling variants: words one code point apart, each pointing to a far more frequent one.

Words come from the texts by SQL functions and are counted with partial sums before the shuffle. Two words are one
replacement apart if they agree after deleting the same place of both, one insertion apart if one agrees with a
deletion of the other. So every word sends a key for itself and one for each deletion: 64-bit polynomial hashes made of prefix and suffix sums, in
numpy. The keys are radix-partitioned by their leading bits and sorted in each task; only keys that meet get their words by a join, and the strings
behind equal keys are compared, so a collision of hashes has no effect. Keys carry no words, so a word of a million letters costs a million small
keys. No pairs are made: words that agree
after deleting one place are all near each other, so each of them gets the size of its group less one and the group's most frequent other
word; the place is the only one for two words of equal length, and of a run of equal letters only the first deletion meets the shorter word, so
nothing counts twice. Such a group has as many words as there are letters at most.

Nulls, empty and long texts: null or empty texts hold no words, texts are read whole, a null doc_id counts as an empty string in the draw of
deletions. Repeated rows count as often as they stand there. Ties go to the word that is smaller in code-point order. An
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Scratch, text_of

#: Letters of a word, its least length and count, and how many times as frequent its form must be.
LETTERS, LENGTH, COUNT, TIMES = "A-Za-z\\u00C0-\\u00FF", 7, 2, 10
#: One word in so many loses a letter on purpose.
DRAW = 31
#: Keys that one task sorts, about (the radix gets as many bits as it takes).
TASK_KEYS = 400_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rows of one Arrow batch that leaves a task.
SENT = 20_000
_KEYS = "radix int, key long, place int, first boolean, id long, n long"
_MET = "key long, place int, first boolean, id long, n long"
_NEAR = "id long, n_near long, near_n long, near string"


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def words_with_slips(df: DataFrame, doc_id: str = "doc_id", text: str = "text", *, draw: int = DRAW, length: int = LENGTH, count: int = COUNT) -> DataFrame:
    """word, n: runs of letters, A-Z lower-cased, where one in ``draw`` (by crc32 of doc_id and word) has lost a code point.

    A run that is too short stays so, hence the pattern skips it.
    """
    runs = F.regexp_extract_all(text_of(df, text), F.lit(f"[{LETTERS}]{{{length},}}"), F.lit(0))
    rows = df.select(F.coalesce(df[doc_id].cast("string"), F.lit("")).alias("doc"), F.explode(runs).alias("run"))
    rows = rows.select("doc", F.translate("run", UPPER, LOWER).alias("run"))
    rows = rows.select("run", F.crc32(F.concat("doc", F.lit(":"), "run")).alias("h"))
    at = F.pmod("h", F.length("run")).cast("int")
    slip = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    word = F.when(F.col("h") % draw == 0, slip).otherwise(F.col("run"))
    return rows.select(word.alias("word")).filter(F.length("word") >= length).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= count)


def _deletions(bits: int):
    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tessera.llm.flat import deletion_hashes

        for batch in batches:
            words = batch["word"].to_pylist()
            if not words:
                continue
            lengths = np.fromiter(map(len, words), np.int64, len(words))
            codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
            item, place, key = deletion_hashes(codes, lengths)
            radix = (key >> np.uint64(64 - bits)).astype(np.int32) if bits else np.zeros(len(key), np.int32)
            first = np.concatenate([np.ones(len(words), bool), np.diff(codes.astype(np.int64), prepend=-1) != 0]) | (place == 0)
            ids, n = batch["id"].to_numpy()[item], batch["n"].to_numpy()[item]
            columns = [pa.array(radix), pa.array(key.view(np.int64)), pa.array(place, pa.int32()), pa.array(first), pa.array(ids), pa.array(n)]
            whole = pa.RecordBatch.from_arrays(columns, names=_names(_KEYS))
            for begin in range(0, len(whole), SENT):
                yield whole.slice(begin, SENT)

    return keys


def _meetings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of all keys of one radix, sorted: those deletions of one place that agree, and whole words with the deletions that give them."""
    rows = [b for b in batches if len(b)]
    if not rows:
        return
    table = pa.Table.from_batches(rows)
    key, place, first = table["key"].to_numpy(), table["place"].to_numpy(), table["first"].to_numpy()
    order = np.lexsort((place, key))
    key, place, first = key[order], place[order], first[order]
    run = np.cumsum(np.diff(key, prepend=key[:1]) != 0)
    spot = np.cumsum((np.diff(run, prepend=0) != 0) | (np.diff(place, prepend=place[:1]) != 0))
    longer = first & (place >= 0)
    whole, cut = np.bincount(run, place < 0) > 0, np.bincount(run, longer) > 0
    keep = np.where(place < 0, cut[run], (np.bincount(spot)[spot] > 1) | (longer & whole[run]))
    yield from table.take(pa.array(order[keep])).select(_names(_MET)).to_batches(SENT)


def _group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Meetings by key with their words: what each word gets from the words that meet it."""
    rows = [b for b in batches if len(b)]
    if not rows:
        return
    table = pa.Table.from_batches(rows)
    words, place, n, first = table["word"].to_pylist(), table["place"].to_numpy(), table["n"].to_numpy(), table["first"].to_numpy()
    rest = [w if p < 0 else w[:p] + w[p + 1 :] for w, p in zip(words, place.tolist(), strict=True)]
    group = pd.factorize(np.array(rest, object))[0]  # by the strings, so keys that only collide part here
    alphabetic = pd.factorize(np.array(words, object), sort=True)[0]
    rank = np.empty(len(words), np.int64)
    rank[np.lexsort((alphabetic, -n))] = np.arange(len(words))  # the most frequent first

    out = []  # (word, how many near, the best of them)
    order = np.lexsort((rank, place, group))
    order = order[place[order] >= 0]
    if len(order):
        begins = np.flatnonzero(np.concatenate([[True], (np.diff(group[order]) != 0) | (np.diff(place[order]) != 0)]))
        sizes = np.diff(begins, append=len(order))
        top, second = np.repeat(order[begins], sizes), np.repeat(order[np.minimum(begins + 1, len(order) - 1)], sizes)
        many = np.repeat(sizes, sizes) > 1
        out.append((order[many], (np.repeat(sizes, sizes) - 1)[many], np.where(order == top, second, top)[many]))

    full = np.full(group.max() + 1, -1)
    full[group[place < 0]] = np.flatnonzero(place < 0)
    longer = np.flatnonzero(first & (place >= 0) & (full[group] >= 0))
    if len(longer):
        out.append((longer, np.ones(len(longer), np.int64), full[group[longer]]))
        longer = longer[np.lexsort((rank[longer], group[longer]))]
        begins = np.flatnonzero(np.diff(group[longer], prepend=-1))
        out.append((full[group[longer[begins]]], np.diff(begins, append=len(longer)), longer[begins]))
    if out:
        word, count, best = (np.concatenate(x) for x in zip(*out, strict=True))
        ids, names = table["id"].to_numpy(), table["word"].combine_chunks()
        columns = [pa.array(ids[word]), pa.array(count), pa.array(n[best]), names.take(pa.array(best))]
        yield from pa.Table.from_arrays(columns, names=_names(_NEAR)).to_batches(SENT)


def variants(words: DataFrame, *, times: int = TIMES) -> DataFrame:
    """word, n, n_near, form, form_n of distinct words (columns id, word, n; already written)."""
    total = words.agg(F.sum(F.length("word") + 1)).first()[0] or 0
    bits = max(0, math.ceil(math.log2(max(1, total / TASK_KEYS))))
    keys = words.mapInArrow(_deletions(bits), _KEYS).repartitionById(1 << bits, F.col("radix"))
    met = keys.mapInArrow(_meetings, _MET).join(words.select("id", "word"), "id")
    found = met.repartition("key").mapInArrow(_group, _NEAR)
    best = F.min(F.struct((-F.col("near_n")).alias("minus"), F.col("near").alias("near")))
    found = found.groupBy("id").agg(F.sum("n_near").alias("n_near"), best.alias("best"))
    rows = words.join(found, "id", "left")
    frequent = -F.col("best.minus") >= times * F.col("n")
    return rows.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(frequent, F.col("best.near")).alias("form"), F.when(frequent, -F.col("best.minus")).alias("form_n"))


def with_roots(rows: DataFrame, scratch: Scratch, *, times: int = TIMES) -> DataFrame:
    """``rows`` (of ``variants``, written) with the end of each chain of forms.

    Counts grow by ``times`` from link to link, so the largest count bounds the length of a chain, and half as many links are left after each join.
    """
    links = rows.filter("form is not null").select("word", F.col("form").alias("root"))
    most = rows.agg(F.max("n")).first()[0] or 1
    for step in range(math.ceil(math.log2(1 + math.log(most, times)))):
        after = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        links = scratch.table(links.join(after, "root", "left").select("word", F.coalesce("next", "root").alias("root")), f"links-{step}")
    return rows.join(links, "word", "left").withColumn("root", F.coalesce("root", "word"))


def spelling_groups(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of the texts."""
    scratch = Scratch(df.sparkSession, "spelling")
    words = scratch.table(words_with_slips(df, doc_id, text).withColumn("id", F.monotonically_increasing_id()), "words")
    rows = scratch.table(variants(words), "variants")
    return with_roots(rows, scratch).select("word", "form", "root", "n", "n_near", "form_n")
