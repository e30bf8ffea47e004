"""Best-fit packing, planned on the histogram of piece lengths.

A document's ids are one piece; a longer one than a sequence is cut into whole sequences, what is left over comes first. Best-fit
decreasing runs over counts: of each length, from the longest, all pieces are placed at once into the fullest
sequences that still hold them, in runs of sequences with equal filling. The plan so has a run for each (length, group of alike
sequences): a length makes at most four new groups and a sequence holds at most 44 different lengths, so 1,024 lengths give
180,000 runs at the very most (thousands in practice) at any number of documents. Every piece then takes
the slot planned for its rank among the pieces of its length. The number of sequences is that of best-fit decreasing over the documents.

Nulls, empty and long texts: a null or empty text has the end id alone and is a piece of length 1; a text of any length is encoded whole. A
null doc_id is kept. Rows with the same doc_id are packed each by itself, equal lengths take slots in table order. An empty table gives no
rows; other columns are ignored.
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
#: The most counts of (length, partition) that are broadcast; more are joined by shuffle.
SENT = 200_000
_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part long, place long"
_PLACED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def cut(counts: np.ndarray, longest: int = SEQUENCE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, piece, length) of the pieces of documents of ``counts`` ids; only the first piece may be shorter than ``longest``."""
    pieces = -(-counts // longest)
    doc = np.repeat(np.arange(len(counts)), pieces)
    piece = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    return doc, piece, np.where(piece == 0, counts[doc] - (pieces[doc] - 1) * longest, longest)


def plan(counts: dict[int, int], longest: int = SEQUENCE) -> dict[str, np.ndarray]:
    """Runs of slots by length and rank: pieces ``rank`` on go to sequences ``sequence`` on, ``each`` of them side by side from ``offset``."""
    free: list[list[tuple[int, int]]] = [[] for _ in range(longest + 1)]
    runs, sequences = [], 0

    def fill(length: int, rank: int, room: int, first: int, number: int, left: int) -> int:
        """Give ``number`` sequences with ``room`` as many pieces as they hold; returns how many are placed."""
        each = room // length
        whole = min(number, left // each)
        rest = left - whole * each if whole < number else 0
        for begin, n, k in ((first, whole, each), (first + whole, int(rest > 0), rest)):
            if n:
                runs.append((length, rank, begin, k, longest - room))
                rank += n * k
                free[room - k * length].append((begin, n))
        untouched = number - whole - (rest > 0)
        if untouched:
            free[room].append((first + number - untouched, untouched))
        return whole * each + rest

    for length in range(longest, 0, -1):
        left, rank = counts.get(length, 0), 0
        for room in range(length, longest):
            groups, free[room] = free[room], []
            for at, (first, number) in enumerate(groups):
                if not left:
                    free[room] += groups[at:]
                    break
                placed = fill(length, rank, room, first, number, left)
                left, rank = left - placed, rank + placed
            if not left:
                break
        if left:
            number = -(-left // (longest // length))
            fill(length, rank, longest, sequences, number, left)
            sequences += number
    table = np.array(runs, np.int64).reshape(-1, 5)
    table = table[np.lexsort((table[:, 1], table[:, 0]))]
    return dict(zip(("length", "rank", "sequence", "each", "offset"), table.T, strict=True)) | {"sequences": np.array(sequences)}


def slots(runs: dict[str, np.ndarray], length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) planned for each piece by its rank within its length."""
    first = np.searchsorted(runs["length"], length)
    at = np.empty(len(length), np.int64)
    for value in np.unique(length):
        mine = np.flatnonzero(length == value)
        begin, end = first[mine[0]], np.searchsorted(runs["length"], value, "right")
        at[mine] = begin + np.searchsorted(runs["rank"][begin:end], rank[mine], "right") - 1
    inside = rank - runs["rank"][at]
    return runs["sequence"][at] + inside // runs["each"][at], runs["offset"][at] + inside % runs["each"][at] * length


def best_fit(df: DataFrame, vocabulary: str, *, longest: int = SEQUENCE, end_id: int = 2, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces with their place: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Texts don't move between tasks; piece rows are written once, and counts by (length, partition) give each its rank.
    The driver gets one sum per length.
    """
    spark = df.sparkSession

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        from tessera.llm.encode import byte_level_encoder

        encoder = byte_level_encoder(vocabulary, end_id)
        part = TaskContext.get().partitionId()
        seen = np.zeros(longest + 1, np.int64)
        for batch in batches:
            ids, begin = batch.column(0), 0
            for flat, counts in encoder.encode(batch.column(1).to_pylist()):
                doc, piece, length = cut(counts, longest)
                ends = np.cumsum(length)
                start = ends - length - (np.cumsum(counts) - counts)[doc]
                data, edges = memoryview(flat.astype("<u4").tobytes()), ends.tolist()
                sums = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip([0, *edges], edges, strict=False)]
                order = np.argsort(length, kind="stable")
                sizes = np.bincount(length, minlength=longest + 1)
                place = np.empty(len(length), np.int64)
                place[order] = np.arange(len(length)) - (np.cumsum(sizes) - sizes)[length[order]] + seen[length[order]]
                seen += sizes
                columns = [ids.slice(begin, len(counts)).take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(sums, pa.int64()), pa.array(np.full(len(doc), part, np.int64)), pa.array(place)]
                yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in _PIECES.split(", ")])
                begin += len(counts)
        give_back()

    scratch = Scratch(spark, "best-fit")
    rows = scratch.table(df.select(df[doc_id].cast("long").alias("doc_id"), text_of(df, text).alias("text")).mapInArrow(pieces, _PIECES), "pieces")
    counts = scratch.table(rows.groupBy("length", "part").agg(F.count("*").alias("n")), "counts")
    runs = plan({r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}, longest)
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    firsts = counts.select("length", "part", F.coalesce(before, F.lit(0)).alias("first"))
    ranked = rows.join(F.broadcast(firsts) if counts.count() <= SENT else firsts, ["length", "part"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("first") + F.col("place")).alias("rank"))

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequence, offset = slots(runs, batch["length"].to_numpy(), batch["rank"].to_numpy())
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], names=[c.split()[0] for c in _PLACED.split(", ")])

    return ranked.mapInArrow(take, _PLACED)
