"""Conversation structure repair as a min-plus matrix scan.

The initials of the roles of a good conversation match ``(s?(ua)+)?``: four states, nothing so far, after ``s``, after ``u``, after ``a``. A turn is
a 4x4 matrix of its cheapest edits from state to state, elements are (cost, audit); insertions before it are closed into
the matrix, so every audit ends with the letter of a turn. No audit of the same turns is then the beginning of another, order by (cost,
audit) survives multiplication, and products may be taken in any grouping. Adjacent sums (turns, gaps, faults, illegal pairs) are carried along.

Rows without their texts are dealt by range of (conversation, turn, key), so a conversation of any length is spread over tasks, each of which
multiplies its stretch as a balanced tree. Conversations inside one stretch are done there. Those at the ends of a stretch, two
per task at most, are multiplied on in a tree of ``FAN`` children by Spark, their audits are cut at the stretches and given back to the rows. Texts of kept
turns alone are joined to their places and hashed in order: that a SHA-256 is one chain of all the text of a conversation is the only step that one task
does for a long one, as a stream, and its audit is one string by contract.

A duplicate is found by the first row of each (conversation, role, text), by an MD5 of the three: partial minima before the shuffle, heavy keys by broadcast.

Nulls: a null role or text counts as one space, also a null conversation or turn in the draw of damage; null turns come first and make no gap; rows of a null
conv_id are one conversation. An empty role fits nowhere. Ties of turn go by the MD5 of role and text, so the order of the table plays no part;
repeated rows are duplicates of the first. A conversation without rows after damage has zeros, an empty audit and the hash of nothing. An empty table gives no rows; other
columns are ignored. Sums beyond 64 bits end at the largest long.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterable, Iterator
from functools import cache, lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Scratch
from tessera.llm.skew import keyed_join

#: Costs of edits, and of leaving a truncated turn in.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
START, SYSTEM, USER, ASSISTANT = range(4)
#: State after a role's initial.
STEP = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
ENDS = (START, ASSISTANT)
LEGAL = {"su", "ua", "au"}
#: A turn's code: its initial (o: another), upper case where truncated; the digits of the same place where blank or duplicate.
INITIALS, TRUNC, BLANK, DUPLICATE = "suao", "SUAO", "0123", "4567"
#: Turns multiplied at once and remembered, children of a node of the tree over stretches, rows of a batch that leaves a task.
BLOCK, FAN, SENT = 8, 16, 5_000
SPACE = "\\x20\\x09-\\x0D"
_MOST = (1 << 63) - 1

Matrix = tuple  # rows of (cost, audit), or None where there is no way


def _best(ways: Iterable) -> tuple | None:
    return min((w for w in ways if w is not None), default=None)


def times(a: Matrix, b: Matrix) -> Matrix:
    """The min-plus product: cheapest edits of two stretches, audits joined."""
    return tuple(tuple(_best(x and y and (x[0] + y[0], x[1] + y[1]) for x, y in zip(row, column, strict=True)) for column in zip(*b, strict=True)) for row in a)


@cache
def insertions() -> Matrix:
    """Closure of inserted user and assistant turns."""
    rows = [[(0, "") if i == j else None for j in range(4)] for i in range(4)]
    for _ in range(4):
        for i in range(4):
            for (at, initial), to in STEP.items():
                if initial != "s" and rows[i][at] is not None:
                    rows[i][to] = _best([rows[i][to], (rows[i][at][0] + INSERT, rows[i][at][1] + "I")])
    return tuple(map(tuple, rows))


@cache
def turn_matrix(code: str) -> Matrix:
    """Insertions, then what may be done with a turn of this code."""
    rows = [[(DELETE, "D") if i == j else None for j in range(4)] for i in range(4)]
    if code not in BLANK + DUPLICATE:
        extra = TRUNCATED * (code in TRUNC)
        for (at, initial), to in STEP.items():
            ways = [(extra, "K")] if initial == code.lower() else []
            ways += [(extra + REROLE, "R")] if initial != "s" else []
            rows[at][to] = _best([rows[at][to], *ways])
    return times(insertions(), tuple(map(tuple, rows)))


@lru_cache(maxsize=100_000)
def _block(codes: str) -> Matrix:
    if len(codes) == 1:
        return turn_matrix(codes)
    return times(_block(codes[: len(codes) // 2]), _block(codes[len(codes) // 2 :]))


def product(matrices: list[Matrix]) -> Matrix:
    """A balanced tree of products, in order."""
    while len(matrices) > 1:
        pairs = [times(a, b) for a, b in zip(matrices[::2], matrices[1::2], strict=False)]
        matrices = pairs + matrices[len(pairs) * 2 :]
    return matrices[0]


def scan(codes: str) -> Matrix:
    return product([_block(codes[i : i + BLOCK]) for i in range(0, len(codes), BLOCK)])


def settle(matrix: Matrix) -> tuple[int, str]:
    """Cost and audit of a whole conversation: from the start to an end, insertions behind the last turn included."""
    return _best(x and y and (x[0] + y[0], x[1] + y[1]) for q, x in enumerate(matrix[START]) for y in (insertions()[q][end] for end in ENDS))


def sums(codes: str, turns: list) -> dict:
    """What adjacent stretches add up: sizes, faults, distinct turns, illegal pairs."""
    known = [t for t in turns if t is not None]
    initials = "".join(INITIALS["SUAO".find(c.upper()) if c.isalpha() else int(c) % 4] for c in codes)
    return {
        "rows": len(codes), "low": min(known, default=None), "high": max(known, default=None), "distinct": len(set(known)), "first": turns[0], "last": turns[-1], "ends": initials[0] + initials[-1],
        "blank": sum(c in BLANK for c in codes), "duplicate": sum(c in DUPLICATE for c in codes), "truncated": sum(c in TRUNC for c in codes),
        "illegal": sum(a + b not in LEGAL for a, b in zip(initials, initials[1:], strict=False)),
    }


def add(a: dict, b: dict) -> dict:
    """Sums of two stretches, the second right behind the first in order of turns."""
    out = {k: a[k] + b[k] for k in ("rows", "distinct", "blank", "duplicate", "truncated", "illegal")}
    out |= {"low": b["low"] if a["low"] is None else a["low"], "high": a["high"] if b["high"] is None else b["high"], "first": a["first"], "last": b["last"], "ends": a["ends"][0] + b["ends"][1]}
    out["distinct"] -= a["last"] is not None and a["last"] == b["first"]
    out["illegal"] += a["ends"][1] + b["ends"][0] not in LEGAL
    return out


def _report(total: dict, cost: int, audit: str) -> dict:
    gaps = 0 if total["low"] is None else min(_MOST, total["high"] - total["low"] + 1 - total["distinct"])
    return {"gaps": gaps, "blank": total["blank"], "duplicate": total["duplicate"], "truncated": total["truncated"], "illegal": total["illegal"], "cost": cost, "audit": audit}


def _edits(audit: str, uids: list[int], at: int, system: bool) -> Iterator[tuple[int, int | None, str | None]]:
    """(place, row or None where inserted, new role or None where kept) of the turns that the audit leaves, from place ``at``."""
    row = 0
    for letter in audit:
        if letter != "D":
            role = None if letter == "K" else ("user", "assistant")[(at - system) % 2]
            yield at, None if letter == "I" else uids[row], role
            at += 1
        row += letter != "I"


def _is_odd(audit: str) -> bool:
    """Whether the conversation that is left begins with a system turn."""
    return (len(audit) - audit.count("D")) % 2 == 1


_REPORT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


class _Rows:
    """Rows of a task's output, sent in batches of ``SENT``; columns that a row does not name are null."""

    def __init__(self, schema: pa.Schema) -> None:
        self.schema, self.rows = schema, []

    def add(self, **row: object) -> Iterator[pa.RecordBatch]:
        self.rows.append(row)
        if len(self.rows) >= SENT:
            yield self.flush()

    def flush(self) -> pa.RecordBatch:
        rows, self.rows = self.rows, []
        return pa.RecordBatch.from_pylist(rows, schema=self.schema)


def _arrow(schema: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_()}
    return pa.schema([(name, kinds[kind]) for name, kind in (c.split() for c in schema.split(", "))])


def _spoken(column: Column) -> Column:
    """A column as text, null as one space."""
    return F.coalesce(column.cast("string"), F.lit(" "))


def damaged(df: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, turn, role, text with the faults drawn by crc32(``conv_id:turn``) % 20: rows lost, emptied, cut off, repeated, of a wrong role."""
    draw = F.crc32(F.concat(_spoken(df[conv_id]), F.lit(":"), _spoken(df[turn]))) % 20
    rows = df.select(df[conv_id].alias("conv_id"), df[turn].cast("long").alias("turn"), _spoken(df[role]).alias("role"), _spoken(df[text]).alias("text"), draw.alias("draw")).filter("draw <> 0")
    said = F.when(F.col("draw") == 1, F.lit("")).when(F.col("draw") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = rows.select("conv_id", "turn", F.when(F.col("draw") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"), said.alias("text"), F.when(F.col("draw") == 3, F.lit(2)).otherwise(F.lit(1)).alias("times"))
    return rows.withColumn("copy", F.explode(F.array_repeat(F.lit(0), F.col("times")))).drop("copy", "times")


def _coded(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """conv_id, turn, key, uid, code of written rows: each with its first fault."""
    initial = F.substring("role", 1, 1)
    initial = F.when(initial.isin("s", "u", "a"), initial).otherwise(F.lit("o"))
    spoken = rows.select("conv_id", "turn", "key", "uid", initial.alias("initial"), F.col("text").rlike(f"[^{SPACE}]").alias("filled"), F.col("text").rlike(f"[.!?][{SPACE}]*\\z").alias("ended"))
    spoken = scratch.table(spoken, "spoken")
    filled, blank = spoken.filter("filled"), spoken.filter("not filled")
    first = filled.groupBy("key").agg(F.min(F.struct("turn", "uid")).alias("at"), F.count("*").alias("n")).filter("n > 1").select("key", F.col("at.uid").alias("first"))
    filled = keyed_join(filled, first, "key", "left")
    code = F.when(F.col("first") != F.col("uid"), F.translate("initial", INITIALS, DUPLICATE)).when(~F.col("ended"), F.upper("initial")).otherwise(F.col("initial"))
    return filled.select("conv_id", "turn", "key", "uid", code.alias("code")).unionByName(blank.select("conv_id", "turn", "key", "uid", F.translate("initial", INITIALS, BLANK).alias("code")))


def _solved(coded: DataFrame, scratch: Scratch, kind: str) -> tuple[DataFrame, DataFrame]:
    """(reports: conv_id and its sums, cost, audit), (edits: conv_id, at, uid, role) by the scan."""
    out = f"what string, conv_id {kind}, seg int, idx long, at long, uid long, role string, element binary, {_REPORT}"
    schema = _arrow(out)

    def stretch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        seg, rows = TaskContext.get().partitionId(), _Rows(schema)
        begun, conv, codes, turns, uids = False, None, [], [], []

        def close(edge: bool) -> Iterator[pa.RecordBatch]:
            text = "".join(codes)
            matrix, total = scan(text), sums(text, turns)
            if edge:
                yield from rows.add(what="stretch", conv_id=conv, seg=seg, element=pickle.dumps((matrix, total)), idx=total["rows"])
                for i, uid in enumerate(uids):
                    yield from rows.add(what="row", conv_id=conv, seg=seg, idx=i, uid=uid)
                return
            cost, audit = settle(matrix)
            yield from rows.add(what="report", conv_id=conv, **_report(total, cost, audit))
            for at, uid, role in _edits(audit, uids, 0, _is_odd(audit)):
                yield from rows.add(what="edit", conv_id=conv, at=at, uid=uid, role=role)

        edge = True
        for batch in batches:
            for c, t, u, code in zip(*(batch[x].to_pylist() for x in ("conv_id", "turn", "uid", "code")), strict=True):
                if begun and c != conv:
                    yield from close(edge)
                    edge, codes, turns, uids = False, [], [], []
                begun, conv = True, c
                codes.append(code)
                turns.append(t)
                uids.append(u)
        if begun:
            yield from close(True)
        yield rows.flush()

    order = ["conv_id", F.asc_nulls_first("turn"), "key", "uid"]
    done = scratch.table(coded.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(stretch, out), "solved")
    report = ["conv_id", *(c.split()[0] for c in _REPORT.split(", "))]
    reports, edits = done.filter("what = 'report'").select(report), done.filter("what = 'edit'").select("conv_id", "at", "uid", "role")

    # conversations at the ends of stretches: a tree over their elements
    parts = done.filter("what = 'stretch'").select("conv_id", "seg", "element")
    tree = parts

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def join() -> pa.RecordBatch:
            total = held[0][1]
            for _, more in held[1:]:
                total = add(total, more)
            return pa.RecordBatch.from_pylist([{"conv_id": now[0], "seg": now[1], "element": pickle.dumps((product([m for m, _ in held]), total))}], schema=_arrow(f"conv_id {kind}, seg int, element binary"))

        for batch in batches:
            for c, s, e in zip(*(batch[x].to_pylist() for x in ("conv_id", "seg", "element")), strict=True):
                if now is not None and now != (c, s // FAN):
                    yield join()
                    held = []
                now = (c, s // FAN)
                held.append(pickle.loads(e))
        if now is not None:
            yield join()

    level = 0
    while tree.groupBy("conv_id").count().filter("count > 1").limit(1).count():
        level += 1
        up = tree.repartition("conv_id", F.expr(f"seg div {FAN}")).sortWithinPartitions("conv_id", "seg")
        tree = scratch.table(up.mapInArrow(fold, f"conv_id {kind}, seg int, element binary"), f"tree-{level}")

    ends = f"conv_id {kind}, {_REPORT}"

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for c, e in zip(batch["conv_id"].to_pylist(), batch["element"].to_pylist(), strict=True):
                matrix, total = pickle.loads(e)
                found.append({"conv_id": c, **_report(total, *settle(matrix))})
            yield pa.RecordBatch.from_pylist(found, schema=_arrow(ends))

    last = scratch.table(tree.select("conv_id", "element").mapInArrow(finish, ends), "last")

    # their audits cut at the stretches, then given to the rows of each
    cuts = f"conv_id {kind}, seg int, idx long, at long, audit string, system boolean"

    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        audit, begin, at, system, rows = "", 0, 0, False, _Rows(_arrow(cuts))
        for batch in batches:
            for c, s, n, a in zip(*(batch[x].to_pylist() for x in ("conv_id", "seg", "idx", "audit")), strict=True):
                if s < 0:
                    audit, begin, at, system = a, 0, 0, _is_odd(a)
                    left = len(a) - a.count("I")
                    continue
                left -= n
                end, seen = begin, 0
                while seen < n or (left == 0 and end < len(audit)):
                    seen += audit[end] != "I"
                    end += 1
                part = audit[begin:end]
                yield from rows.add(conv_id=c, seg=s, idx=-1, at=at, audit=part, system=system)
                begin, at = end, at + len(part) - part.count("D")
        yield rows.flush()

    sizes = done.filter("what = 'stretch'").select("conv_id", "seg", "idx", F.lit(None).cast("string").alias("audit"))
    heads = last.select("conv_id", F.lit(-1).alias("seg"), F.lit(0).cast("long").alias("idx"), "audit")
    cut = sizes.unionByName(heads).repartition("conv_id").sortWithinPartitions("conv_id", "seg").mapInArrow(slices, cuts)
    edited = f"conv_id {kind}, at long, uid long, role string"

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, uids, rows = None, [], _Rows(_arrow(edited))

        def close() -> Iterator[pa.RecordBatch]:
            conv, at, audit, system = head
            for place, uid, role in _edits(audit, uids, at, system):
                yield from rows.add(conv_id=conv, at=place, uid=uid, role=role)

        for batch in batches:
            for c, i, at, uid, a, odd in zip(*(batch[x].to_pylist() for x in ("conv_id", "idx", "at", "uid", "audit", "system")), strict=True):
                if i < 0:
                    if head:
                        yield from close()
                    head, uids = (c, at, a, odd), []
                else:
                    uids.append(uid)
        if head:
            yield from close()
        yield rows.flush()

    raw = done.filter("what = 'row'").select("conv_id", "seg", "idx", F.lit(None).cast("long").alias("at"), "uid", F.lit(None).cast("string").alias("audit"), F.lit(None).cast("boolean").alias("system"))
    both = raw.unionByName(cut.withColumn("uid", F.lit(None).cast("long")))
    more = both.repartition("conv_id", "seg").sortWithinPartitions("conv_id", "seg", "idx").mapInArrow(apply, edited)
    return reports.unionByName(last.select(report)), edits.unionByName(more)


def _written(df: DataFrame, scratch: Scratch, conv_id: str, turn: str, role: str, text: str) -> DataFrame:
    key = F.md5(F.concat_ws("\x1f", F.coalesce(df[conv_id].cast("string"), F.lit("\x1e")), F.length(_spoken(df[role])).cast("string"), _spoken(df[role]), _spoken(df[text])))
    conv = df[conv_id] if df.schema[conv_id].dataType.simpleString() in ("bigint", "int", "string") else df[conv_id].cast("string")
    rows = df.select(conv.alias("conv_id"), df[turn].cast("long").alias("turn"), _spoken(df[role]).alias("role"), _spoken(df[text]).alias("text"), key.alias("key"))
    return scratch.table(rows.withColumn("uid", F.monotonically_increasing_id()), "rows")


def repair(df: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(reports: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit), (turns: conv_id, at, role, text of the repaired conversations)."""
    scratch = Scratch(df.sparkSession, "conversations")
    rows = _written(df, scratch, conv_id, turn, role, text)
    kind = rows.schema["conv_id"].dataType.simpleString()
    reports, edits = _solved(_coded(rows, scratch), scratch, kind)
    edits = scratch.table(edits, "edits")
    kept = edits.filter("uid is not null").withColumnRenamed("role", "new").join(rows.select("uid", "role", "text"), "uid")
    turns = kept.select("conv_id", "at", F.coalesce("new", "role").alias("role"), "text").unionByName(edits.filter("uid is null").select("conv_id", "at", "role", F.lit("").alias("text")))
    return reports, turns


def repair_digest(df: DataFrame, everyone: DataFrame) -> DataFrame:
    """Of every conv_id of ``everyone``: gaps, blank, duplicate, truncated, illegal, cost, audit of ``df``'s rows, and repaired_sha256.

    Reports and turns of a conversation meet in order in one task, which hashes them as a stream.
    """
    reports, turns = repair(df)
    kind = reports.schema["conv_id"].dataType.simpleString()
    names = [c.split()[0] for c in _REPORT.split(", ")]
    out = f"conv_id {kind}, {_REPORT}, repaired_sha256 string"
    empty = {n: F.lit(None).cast(reports.schema[n].dataType).alias(n) for n in names}
    lines = turns.select("conv_id", "at", F.concat("role", F.lit(":"), "text").alias("line"), *empty.values())
    heads = reports.select("conv_id", F.lit(-1).cast("long").alias("at"), F.lit(None).cast("string").alias("line"), *names)
    marks = everyone.select(everyone["conv_id"].cast(kind).alias("conv_id")).distinct().select("conv_id", F.lit(-2).cast("long").alias("at"), F.lit(None).cast("string").alias("line"), *empty.values())

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, now, report, sha, begun = _Rows(_arrow(out)), None, {}, None, False
        nothing = {n: 0 for n in names} | {"audit": ""}
        for batch in batches:
            columns = [batch[n].to_pylist() for n in names]
            for i, (c, at, line) in enumerate(zip(*(batch[x].to_pylist() for x in ("conv_id", "at", "line")), strict=True)):
                if at == -2:
                    if sha:
                        yield from rows.add(conv_id=now, **report, repaired_sha256=sha.hexdigest())
                    now, report, sha, begun = c, nothing, hashlib.sha256(), False
                elif at == -1:
                    report = {n: column[i] for n, column in zip(names, columns, strict=True)}
                else:
                    sha.update(("\n" * begun + line).encode())
                    begun = True
        if sha:
            yield from rows.add(conv_id=now, **report, repaired_sha256=sha.hexdigest())
        yield rows.flush()

    return marks.unionByName(heads).unionByName(lines).repartition("conv_id").sortWithinPartitions("conv_id", "at").mapInArrow(digest, out)
