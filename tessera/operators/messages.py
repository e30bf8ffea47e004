"""Messages of bounded bytes: records in order, packed greedily, without one task that sees them all.

Greedy packing is sequential: a message is closed by the record that no longer fits. Records are sorted by ranges and written with their range. What a range does depends
only on the bytes it is handed in the open message, and only through the place of its first closing, so every range is a step function from
bytes carried in to bytes carried out and messages closed. It has a step for each record that can close the first message, runs of equal outcomes count as one. The
driver reads the functions one after the other and follows the bytes from range to range; then every range, knowing what it was handed, numbers
its own records.

Nulls: a null size counts as 0. Ties of order keep the records whole but their numbers are not fixed. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.cut import cut

#: The most bytes of one message (fixed value), under the usual 4 MiB of a transport.
MESSAGE = 3 << 20


class Oversized(ValueError):
    """A record alone is larger than a message; it is named, nothing is cut off."""


def transition(sizes: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(from how many bytes carried in on, bytes carried out, messages closed), ascending, of records in order; none is larger than ``most``."""
    n = len(sizes)
    upto = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    # a message that begins with record j holds records before after[j]
    after = np.searchsorted(upto, upto[:-1] + most, "right") - 1
    out, closed = np.empty(n + 1, np.int64), np.zeros(n + 1, np.int64)
    for j in range(n - 1, -1, -1):
        if after[j] >= n:
            out[j] = upto[n] - upto[j]
        else:
            out[j], closed[j] = out[after[j]], closed[after[j]] + 1
    # record j is the first that doesn't fit behind c bytes from c = most - upto[j + 1] + 1 on; of equal ones the earliest counts
    table = {0: (-1, 0)} if upto[n] <= most else {}  # all fit: carried out is what came in and all of these
    last = min(int(np.searchsorted(upto, most, "right")) - 1, n - 1)
    for j in range(last, -1, -1):
        if upto[j + 1]:
            table[max(0, int(most - upto[j + 1] + 1))] = (int(out[j]), int(closed[j]) + 1)
    keys = sorted(table)
    kept = [k for i, k in enumerate(keys) if i == 0 or table[k] != table[keys[i - 1]]]
    return np.array(kept, np.int64), np.array([table[k][0] for k in kept], np.int64), np.array([table[k][1] for k in kept], np.int64)


def carried(function: tuple[np.ndarray, np.ndarray, np.ndarray], total: int, handed: int) -> tuple[int, int]:
    """(bytes carried out, messages closed) of a range with ``total`` bytes for the bytes handed to it."""
    at = int(np.searchsorted(function[0], handed, "right")) - 1
    return (handed + total if function[1][at] < 0 else int(function[1][at])), int(function[2][at])


def numbers(sizes: np.ndarray, most: int, handed: int, number: int) -> np.ndarray:
    """The message of each record of a range."""
    upto = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    out, at, room = np.empty(len(sizes), np.int64), 0, most - handed
    while at < len(sizes):
        end = int(np.searchsorted(upto, upto[at] + room, "right")) - 1
        out[at:end] = number
        at, number, room = end, number + 1, most
    return out


def byte_pages(records: DataFrame, order: list[str | Column], size: Column, most: int = MESSAGE) -> DataFrame:
    """``records`` with ``page`` (from 1) and ``bytes``: consecutive records in the given total order, as many in a page as fit in ``most`` bytes."""
    spark = records.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sized = records.withColumn("bytes", F.coalesce(size.cast("long"), F.lit(0)))
    dealt = cut(sized.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}))
    large = dealt.filter(F.col("bytes") > most).sort(*order).limit(1).drop("_part", "_at").collect()
    if large:
        raise Oversized(f"{large[0].asDict()} has more than {most} bytes")
    slim = dealt.select("_part", "_at", "bytes").repartition("_part").sortWithinPartitions("_part", "_at")

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(range, places, sizes) of one range after the other."""
        part, places, sizes = None, [], []
        for batch in batches:
            parts = batch["_part"].to_numpy()
            for i, j in _runs(parts):
                if part is not None and parts[i] != part:
                    yield part, np.concatenate(places), np.concatenate(sizes)
                    places, sizes = [], []
                part = int(parts[i])
                places.append(batch["_at"].to_numpy()[i:j])
                sizes.append(batch["bytes"].to_numpy()[i:j])
        if part is not None:
            yield part, np.concatenate(places), np.concatenate(sizes)

    def functions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, _, sizes in whole(batches):
            columns = [pa.array([part], pa.int32()), pa.array([int(sizes.sum())]), *(pa.array([x.tolist()], pa.list_(pa.int64())) for x in transition(sizes, most))]
            yield pa.RecordBatch.from_arrays(columns, names=["part", "total", "begin", "out", "closed"])

    steps = cut(slim.mapInArrow(functions, "part int, total long, begin array<long>, out array<long>, closed array<long>"))
    handed: dict[int, tuple[int, int]] = {}
    now, number = 0, 1
    for r in steps.orderBy("part").toLocalIterator():
        handed[r["part"]] = (now, number)
        now, more = carried(tuple(np.array(r[c], np.int64) for c in ("begin", "out", "closed")), r["total"], now)
        number += more

    def number_them(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, places, sizes in whole(batches):
            yield pa.RecordBatch.from_arrays([pa.array(places), pa.array(numbers(sizes, most, *handed[part]))], names=["_at", "page"])

    return dealt.join(slim.mapInArrow(number_them, "_at long, page long"), "_at").drop("_part", "_at")


def _runs(values: np.ndarray) -> Iterator[tuple[int, int]]:
    begins = np.flatnonzero(np.diff(values, prepend=values[:1] - 1)).tolist() if len(values) else []
    yield from zip(begins, [*begins[1:], len(values)], strict=True)
