"""Sharding by histogram sort, with DataFrame functions only.

Rows are ordered by (hash of the text, hash of doc_id), so equal texts are neighbours. Splitters are
found without sorting: rows and bytes are counted exactly in equal key ranges, the range that holds a
wanted position is divided into finer ranges, and so on until the nearest range edge is within the
tolerance or the range is a single key. Counting is a partial aggregation to a bounded number of
ranges; rows then move once.

Two sets of splitters are refined together: the shard splitters on bytes, and finer ones on row counts
that cut the shards into tasks of even size, so a group of equal texts never lands in one task: its rows
are ordered, and cut, by the hash of doc_id. Shard edges fall between groups of equal texts unless one
group is too large for that. Slots need no further pass: the counts below each splitter are known.

Law: ``bytes``. Sizes differ by the tolerance (a thousandth of a shard) and at most one row's bytes.
Nulls, empty and long texts, ties and repeated rows: a null or empty text has size 1 and the checksum of the empty text; a null doc_id
is a key like any other; repeated rows share a key and stay together; a text of any length is hashed whole and counts with all its bytes. Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import Scratch

FIRST_BITS, NEXT_BITS = 12, 6
TOLERANCE = 1e-3
#: Ranges that tasks are cut into: at least and at most so many, in between of so many rows each. The most bounds what the
#: driver and every task see of the splitters; larger tables make larger ranges, which a task sorts with spilling.
TASKS, MOST_TASKS, TASK_ROWS = 256, 4096, 250_000
#: A text with more task splitters inside its rows than this gets a table of its own over the hash of doc_id.
SPLIT, SPLIT_BITS = 16, 8


@dataclass(frozen=True)
class Edge:
    """A key (two signed 64-bit words) with the exact bytes and rows below it."""

    a: int
    b: int
    bytes: int
    rows: int


@dataclass(frozen=True)
class Range:
    """All keys that share the first ``bits`` bits with (a, b), with what lies below and in it."""

    a: int
    b: int
    bits: int
    bytes: int
    rows: int
    own_bytes: int
    own_rows: int

    def edges(self) -> tuple[Edge, Edge]:
        low = Edge(self.a, self.b, self.bytes, self.rows)
        a, b = self.a, self.b
        if self.bits <= 64:
            a += 1 << (64 - self.bits)
        else:
            b += 1 << (128 - self.bits)
            if b >= 1 << 63:
                a, b = a + 1, -(1 << 63)
        return low, Edge(a, b, self.bytes + self.own_bytes, self.rows + self.own_rows)


def _prefix(bits: int) -> tuple:
    """The first ``bits`` bits of the key as two columns, with the other bits zero."""
    low = F.lit(-(1 << 63))
    if bits <= 64:
        return F.shiftleft(F.shiftright("a", 64 - bits), 64 - bits), low
    return F.col("a"), F.shiftleft(F.shiftright("b", 128 - bits), 128 - bits)


def _histogram(keys: DataFrame, bits: int, parents: list[Range] | None) -> list[tuple[int, int, int, int]]:
    """(a, b, bytes, rows) of every non-empty range of ``bits`` bits, inside ``parents`` only if given.

    At most 2**FIRST_BITS rows come back at first, then 2**NEXT_BITS per splitter.
    """
    if parents is not None:
        pa, pb = _prefix(parents[0].bits)
        inside = keys.sparkSession.createDataFrame([(r.a, r.b) for r in parents], "pa long, pb long")
        keys = keys.withColumn("pa", pa).withColumn("pb", pb).join(F.broadcast(inside), ["pa", "pb"], "left_semi")
    ra, rb = _prefix(bits)
    found = keys.groupBy(ra.alias("ra"), rb.alias("rb")).agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).collect()
    return sorted((r["ra"], r["rb"], r["bytes"], r["rows"]) for r in found)


def find_splitters(keys: DataFrame, shards: int, tolerance: float, tasks: int, task_rows: int) -> tuple[list[Edge], list[Edge], Edge]:
    """(shard splitters, task splitters, end) for rows with columns a, b, size."""
    first = _histogram(keys, FIRST_BITS, None)
    end = Edge(1 << 63, -(1 << 63), sum(x[2] for x in first), sum(x[3] for x in first))
    if not end.rows:
        return [], [], end
    tasks = max(tasks, min(MOST_TASKS, -(-end.rows // task_rows)))
    wanted = [("bytes", end.bytes * j / shards, tolerance * end.bytes / shards) for j in range(1, shards)]
    wanted += [("rows", end.rows * j / tasks, 0.1 * end.rows / tasks) for j in range(1, tasks)]
    done: dict[int, Edge] = {}
    ranges: dict[Range | None, list[int]] = {None: list(range(len(wanted)))}
    bits, rows_of = FIRST_BITS, {None: first}
    while ranges:
        finer: dict[Range | None, list[int]] = {}
        for parent, targets in ranges.items():
            below_bytes, below_rows = (parent.bytes, parent.rows) if parent else (0, 0)
            inside, k = [], 0
            for a, b, n_bytes, n_rows in rows_of[parent]:
                inside.append(Range(a, b, bits, below_bytes, below_rows, n_bytes, n_rows))
                below_bytes, below_rows = below_bytes + n_bytes, below_rows + n_rows
            for t in targets:  # ascending within each unit
                unit, at, slack = wanted[t]
                if k and getattr(inside[k], unit) > at:
                    k = 0
                while k + 1 < len(inside) and getattr(inside[k + 1], unit) <= at:
                    k += 1
                low, high = inside[k].edges()
                best = min((low, high), key=lambda e: abs(getattr(e, unit) - at))
                if abs(getattr(best, unit) - at) <= slack or inside[k].own_rows <= 1 or bits >= 128:
                    done[t] = best
                else:
                    finer.setdefault(inside[k], []).append(t)
        ranges = finer
        if ranges:
            step = min(NEXT_BITS, (64 if bits < 64 else 128) - bits)
            parents = list(ranges)
            found = _histogram(keys, bits + step, parents)
            bits += step
            rows_of = {p: [] for p in parents}
            by_key = sorted(parents, key=lambda p: (p.a, p.b))
            i = 0
            for x in found:
                while i + 1 < len(by_key) and (by_key[i + 1].a, by_key[i + 1].b) <= x[:2]:
                    i += 1
                rows_of[by_key[i]].append(x)
    return [done[t] for t in range(shards - 1)], [done[t] for t in range(shards - 1, len(wanted))], end


def _cells(edges: list[tuple[int, int, int]], cell_of, cells: range, first: int = 0) -> list[tuple[int, int, list]]:
    """(cell, number of the last edge at or below the cell's first key, the cell's other edges) of every cell."""
    by_cell: dict[int, list] = {}
    for e in edges:
        by_cell.setdefault(cell_of(e), []).append(e)
    out = []
    for cell in cells:
        within = by_cell.get(cell, [])
        out.append((cell, first, within))
        first = within[-1][2] if within else first
    return out


def shard(df: DataFrame, shards: int = 8, doc_id: str = "doc_id", text: str = "text", tolerance: float = TOLERANCE, tasks: int = TASKS, task_rows: int = TASK_ROWS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row; slots count from 0 in each shard."""
    spark = df.sparkSession
    raw = F.coalesce(df[text].cast("string"), F.lit("")).cast("binary")
    keys = df.select(df[doc_id].cast("long").alias("doc_id"), (F.octet_length(df[text].cast("string"))).alias("n"), F.crc32(raw).alias("text_crc32"), F.xxhash64(raw).alias("a"), F.xxhash64(df[doc_id].cast("long"), F.lit(1)).alias("b"))
    keys = Scratch(spark, "sharding").table(keys.select("doc_id", (F.coalesce("n", F.lit(0)) + 1).cast("long").alias("size"), "text_crc32", "a", "b"), "keys")
    by_bytes, by_rows, end = find_splitters(keys, shards, tolerance, tasks, task_rows)
    shard_edges = [Edge(-(1 << 63), -(1 << 63), 0, 0), *by_bytes]
    edges = sorted({(e.a, e.b): e for e in [*shard_edges, *by_rows] if e.rows < end.rows or e.rows == 0}.values(), key=lambda e: (e.a, e.b))
    # for each edge: its shard, and the slot of its first row
    cuts = []
    for e in edges:
        s = max(i for i, x in enumerate(shard_edges) if (x.a, x.b) <= (e.a, e.b))
        cuts.append((s, e.rows - shard_edges[s].rows))
    # rows find the last edge not above them through the first bits of their key: a table of at most 2**FIRST_BITS rows.
    # A hot text has many edges of one ``a``: there the table has the last one only, and a second table has them by bits of ``b``
    many = {a for a, n in Counter(e.a for e in edges).items() if n > SPLIT}
    listed = [(e.a, e.b, k) for k, e in enumerate(edges)]
    alone = [x for i, x in enumerate(listed) if x[0] not in many or i + 1 == len(listed) or listed[i + 1][0] != x[0]]
    width, narrow = 64 - FIRST_BITS, 64 - SPLIT_BITS
    cells = spark.createDataFrame(_cells(alone, lambda x: x[0] >> width, range(-(1 << (FIRST_BITS - 1)), 1 << (FIRST_BITS - 1))), "cell long, first int, within array<struct<a:long,b:long,k:int>>")
    split = [(a, *row) for a in sorted(many) for row in _cells([(x[1], 0, x[2]) for x in listed if x[0] == a], lambda x: x[0] >> narrow, range(-(1 << (SPLIT_BITS - 1)), 1 << (SPLIT_BITS - 1)), max([x[2] for x in listed if x[0] < a], default=0))]
    split = spark.createDataFrame(split, "a long, part long, first_in int, within_in array<struct<a:long,b:long,k:int>>")
    places = spark.createDataFrame([(k, s, slot) for k, (s, slot) in enumerate(cuts)], "task int, shard int, base long")
    rows = keys.withColumn("cell", F.shiftright("a", width)).withColumn("part", F.shiftright("b", narrow))
    rows = rows.join(F.broadcast(cells), "cell").join(F.broadcast(split), ["a", "part"], "left")
    last = "coalesce(array_max(transform(filter({0}, e -> {2}), e -> e.k)), {1})"
    inside, outside = last.format("within_in", "first_in", "e.a <= b"), last.format("within", "first", "e.a < a or (e.a = a and e.b <= b)")
    rows = rows.withColumn("task", F.expr(f"if(first_in is not null, {inside}, {outside})"))
    rows = rows.withColumn("at", F.row_number().over(Window.partitionBy("task").orderBy("a", "b", "doc_id")) - 1)
    rows = rows.join(F.broadcast(places), "task")
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("base") + F.col("at")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
