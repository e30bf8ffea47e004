"""Near-duplicate documents: MinHash banding with sequential Bayesian verification.

1. One scan gives every document its shingle set's size, a 64-bit fingerprint of the set and a MinHash
   signature. Documents with equal sets are one class from here on.
2. Signatures are cut into bands; classes that share a band are candidates. The number of rows per
   band is the largest whose chance to miss a pair at the threshold stays below ``BAND_MISS``.
3. Candidates are compared batch by batch of the signature. After each batch the posterior of the
   similarity (uniform prior, so a Beta distribution) gives the chance that the pair reaches the
   threshold; below ``PRUNE_MISS`` the pair is dropped. Survivors are verified on their full sets.
4. A band's bucket of any size is handled without all its pairs. In a star round its members are compared
   to one leader, which links most of a large group; buckets whose members all belong to one
   component are done, as no link inside can change a component. Star rounds with new leaders go on (at most
   ``STAR_ROUNDS``) while what spans several components holds more than ``PAIRS`` pairs a member; the rest is compared exactly,
   block by block. Blocks and Arrow batches are bounded by bytes, so long texts make more blocks, not larger ones.
5. Links are joined to components in Spark.

Nulls, ties and repeated rows: a null or blank text has an empty set and is linked with nothing.
Documents with equal sets are linked. Rows that repeat a doc_id are each classified by their own text; a null
doc_id is only a component's name if no other is there. A text of any length has its whole set. An empty table gives no
rows. Other columns are ignored by ``near_classes`` and kept by ``near_dedup``, which drops rows by doc_id and text together: of rows that
repeat a doc_id only those whose own text is a copy go. Rows equal in both stay together, as do copies none of which has a doc_id.
Shingles and sets are compared by 64-bit hashes: two different sets of a billion share a fingerprint with a chance of about 3 %.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Scratch, fresh, give_back, text_of
from tessera.llm.skew import Members, components, keyed_join

SIGNATURE, BATCH = 100, 20
BAND_MISS, PRUNE_MISS = 1e-5, 1e-6
STAR_ROUNDS, PAIRS = 3, 1000
#: Bytes of sets and signatures in one block of the exact comparison; a larger set is a block by itself.
BLOCK_BYTES = 300_000


def band_rows(percent: int) -> int:
    """The most rows per band that keep the chance to miss a pair at the threshold below BAND_MISS."""
    t = percent / 100
    fit = [r for r in range(1, 21) if (1 - t**r) ** (SIGNATURE // r) <= BAND_MISS]
    return max(fit, default=1)


def least_matches(percent: int) -> list[int]:
    """For each batch end: fewer equal signature values than this make the threshold improbable.

    With m values compared, s of them equal and a uniform prior, P(similarity >= t) is the
    probability of at most s successes in m + 1 trials of chance t.
    """
    t, out = percent / 100, []
    for m in range(BATCH, SIGNATURE + 1, BATCH):
        total, s = 0.0, -1
        while total < PRUNE_MISS:
            s += 1
            total += comb(m + 1, s) * t**s * (1 - t) ** (m + 1 - s)
        out.append(s)
    return out


def prune(left: np.ndarray, right: np.ndarray, n_left: np.ndarray, n_right: np.ndarray, percent: int) -> np.ndarray:
    """Indices of the pairs that survive the size bound and all signature batches."""
    alive = np.flatnonzero(100 * np.minimum(n_left, n_right) >= percent * np.maximum(n_left, n_right))
    matches = np.zeros(len(alive), np.int64)
    for i, least in enumerate(least_matches(percent)):
        part = slice(i * BATCH, (i + 1) * BATCH)
        matches += (left[alive, part] == right[alive, part]).sum(axis=1)
        stay = matches >= least
        alive, matches = alive[stay], matches[stay]
    return alive


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(len(column), SIGNATURE)


def _fingerprint(shingles: np.ndarray) -> int:
    import xxhash

    return int(np.uint64(xxhash.xxh64_intdigest(shingles.tobytes())).astype(np.int64))


def _mark(doc_id: Column, text: Column) -> Column:
    """Names a row by its id and text."""
    return F.xxhash64(doc_id, text)


def _signed(docs: DataFrame, width: int) -> DataFrame:
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tessera.llm.shingles import shingle_sets, signatures

        for batch in batches:
            sets, out = [], {"n": [], "node": [], "sig": []}

            def flush(sets=sets, out=out):
                full = [s for s in sets if len(s)]
                rows = iter(signatures(full, SIGNATURE) if full else ())
                for s in sets:
                    out["n"].append(len(s))
                    out["node"].append(_fingerprint(s) if len(s) else None)
                    out["sig"].append(next(rows).tobytes() if len(s) else None)
                sets.clear()

            pending = 0
            for s in shingle_sets(batch.column(1).to_pylist(), width):
                sets.append(s)
                pending += len(s)
                if pending > 100_000:
                    flush()
                    pending = 0
            flush()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(out["n"], pa.int64()), pa.array(out["node"], pa.int64()), pa.array(out["sig"], pa.binary())], names=["doc_id", "mark", "n", "node", "sig"])
        give_back()

    return docs.withColumn("mark", _mark(F.col("doc_id"), F.col("text"))).mapInArrow(scan, "doc_id long, mark long, n long, node long, sig binary")


def _banded(nodes: DataFrame, percent: int) -> DataFrame:
    rows = band_rows(percent)

    def bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tessera.llm.flat import mix

        for batch in batches:
            if not len(batch):
                continue
            sig = _matrix(batch.column(1)).astype(np.uint64)
            count = SIGNATURE // rows
            keys = np.empty((len(sig), count), np.uint64)
            with np.errstate(over="ignore"):
                for b in range(count):
                    h = np.full(len(sig), b + 1, np.uint64)
                    for k in range(rows):
                        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + sig[:, b * rows + k])
                    keys[:, b] = h
            yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1).view(np.int64)), *(pa.array(np.repeat(batch.column(i).to_numpy(), count)) for i in (0, 2))], names=["bucket", "node", "n"])

    return nodes.select("node", "sig", "n").mapInArrow(bands, "bucket long, node long, n long")


def _pruned(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose signatures leave the threshold probable."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                at = prune(_matrix(batch["sig_a"]), _matrix(batch["sig_b"]), batch["n_a"].to_numpy(), batch["n_b"].to_numpy(), percent)
                yield pa.RecordBatch.from_arrays([batch["a"].take(pa.array(at)), batch["b"].take(pa.array(at))], names=["a", "b"])

    side = nodes.select("node", "n", "sig")
    left = keyed_join(pairs, side.select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("sig").alias("sig_a")), "a")
    both = left.join(side.select(F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("sig").alias("sig_b")), "b")
    return both.select("a", "b", "n_a", "n_b", "sig_a", "sig_b").mapInArrow(check, "a long, b long")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose full sets reach the threshold."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tessera.llm.shingles import overlap

        for batch in batches:
            at = []
            for i, (x, y) in enumerate(zip(batch["set_a"], batch["set_b"], strict=True)):
                left, right = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = overlap(left, right)
                if 100 * both >= percent * (len(left) + len(right) - both):
                    at.append(i)
            take = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([batch["a"].take(take), batch["b"].take(take)], names=["a", "b"])

    left = keyed_join(pairs, sets.select(F.col("node").alias("a"), F.col("shingles").alias("set_a")), "a")
    both = left.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("set_b")), "b")
    return both.select("a", "b", "set_a", "set_b").mapInArrow(check, "a long, b long")


def _candidate_sets(docs: DataFrame, reps: DataFrame, width: int) -> DataFrame:
    """(node, sorted shingle hashes) of the candidate classes, from one text each. Texts don't shuffle."""
    wanted = Members(reps, "rep")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tessera.llm.shingles import shingle_sets

        for batch in batches:
            texts = batch.column(0).filter(wanted.test(*batch.columns[1:])).to_pylist()
            for i in range(0, len(texts), 200):
                sets = [s for s in shingle_sets(texts[i : i + 200], width) if len(s)]
                yield pa.RecordBatch.from_arrays([pa.array([_fingerprint(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["node", "shingles"])
        give_back()

    # the filter is asked inside the scan, so a task has one Python worker
    some = docs.select("text", *wanted.place(F.col("doc_id"))).mapInArrow(scan, "node long, shingles binary")
    return some.join(reps.select("node"), "node", "left_semi").dropDuplicates(["node"])


def _leftover(spread: DataFrame, leaders: DataFrame, own: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links that join different components inside the given buckets, found by comparing blocks.

    Of two members in different components at least one is outside the leader's component. So those
    outside ("minor" members) are compared with all members: a task has one block of all members and
    one block of minor ones. Pairs are pruned on signatures, verified on full sets, and skipped once
    their ends are joined, so a task returns fewer links than it has members.
    """

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tessera.llm.shingles import overlap

        for batch in batches:
            for minor, every in zip(batch["minor"].to_pylist(), batch["every"].to_pylist(), strict=True):
                a, b = ({k: [x[k] for x in side] for k in ("node", "root", "n", "sig", "shingles")} for side in (minor, every))
                sa, sb = (np.frombuffer(b"".join(x["sig"]), np.uint32).reshape(-1, SIGNATURE) for x in (a, b))
                na, nb = np.array(a["n"], np.int64), np.array(b["n"], np.int64)
                joined: dict[int, int] = {}

                def find(x: int, joined=joined) -> int:
                    while (y := joined.get(x, x)) != x:
                        x = joined[x] = joined.get(y, y)
                    return x

                found = []
                for i in range(len(na)):
                    at = prune(np.broadcast_to(sa[i], sb.shape), sb, np.broadcast_to(na[i], nb.shape), nb, percent)
                    left = np.frombuffer(a["shingles"][i], np.uint64)
                    for j in at.tolist():
                        x, y = find(a["root"][i]), find(b["root"][j])
                        if x != y:
                            right = np.frombuffer(b["shingles"][j], np.uint64)
                            both = overlap(left, right)
                            if 100 * both >= percent * (len(left) + len(right) - both):
                                joined[x] = y
                                found.append((a["node"][i], b["node"][j]))
                yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64())], names=["a", "b"])
        give_back()

    blocks_of = F.ceil(F.col("bytes") / BLOCK_BYTES).cast("int").alias("blocks")
    rows = keyed_join(spread.select("bucket", "node", "root"), leaders.select("bucket", F.col("leader.root").alias("main"), blocks_of), "bucket")
    rows = rows.join(own, "node").join(sets, "node")
    rows = rows.withColumn("block", F.expr("cast(pmod(xxhash64(node, 7), blocks) as int)"))
    member = F.struct("node", "root", "n", "sig", "shingles")
    every = rows.groupBy("bucket", F.col("block").alias("at")).agg(F.collect_list(member).alias("every"))
    minor = rows.filter("root <> main").groupBy("bucket", "block", "blocks").agg(F.collect_list(member).alias("minor"))
    minor = minor.select("bucket", "minor", F.explode(F.expr("sequence(0, blocks - 1)")).alias("at"))
    return minor.join(every, ["bucket", "at"]).select("minor", "every").mapInArrow(blocks, "a long, b long")


def near_classes(df: DataFrame, width: int = 3, percent: int = 85, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``df``: doc_id, n_shingles, component_id, kept."""
    return _classes(df, width, percent, doc_id, text).drop("mark")


def _classes(df: DataFrame, width: int, percent: int, doc_id: str, text: str) -> DataFrame:
    """Rows of ``near_classes`` with their mark."""
    spark = df.sparkSession
    scratch = Scratch(spark, "near-dedup")
    docs = df.select(df[doc_id].cast("long").alias("doc_id"), text_of(df, text).alias("text"))
    signed = scratch.table(_signed(docs, width), "signed")
    nodes = scratch.table(signed.filter("n > 0").groupBy("node").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("sig").alias("sig")), "nodes")
    banded = scratch.table(_banded(nodes, percent), "banded")
    # buckets of several bands that hold the same classes are one
    who = [F.bit_xor(F.xxhash64("node", F.lit(i))).alias(f"who_{i}") for i in range(2)]
    shared = banded.groupBy("bucket").agg(F.count("*").alias("size"), *who).filter("size > 1").groupBy("size", "who_0", "who_1").agg(F.min("bucket").alias("bucket")).select("bucket")
    members = scratch.table(keyed_join(banded, shared, "bucket"), "members")
    labels = None
    if members.limit(1).count():
        reps = nodes.select("node", "rep").join(members.select("node").distinct(), "node", "left_semi")
        reps = scratch.table(reps, "reps")
        sets = scratch.table(_candidate_sets(docs, reps, width), "sets")
        own = nodes.join(reps.select("node"), "node", "left_semi").select("node", "n", "sig")
        own = scratch.table(own, "own")
        labels = _link(scratch, members, own, sets, percent)
    scratch.drop("banded")
    if labels is None:
        roots = nodes.select("node", F.col("node").alias("root"), "rep")
    else:
        roots = nodes.select("node", "rep").join(labels, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "rep")
    roots = scratch.table(roots, "roots")
    firsts = roots.groupBy("root").agg(F.min("rep").alias("component_id"))
    names = scratch.table(keyed_join(roots, firsts, "root").select("node", "component_id"), "names")
    real = keyed_join(signed.filter("n > 0").select("doc_id", "mark", "n", "node"), names, "node").select("doc_id", "mark", F.col("n").alias("n_shingles"), "component_id")
    blank = signed.filter("n = 0").select("doc_id", "mark", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return real.unionByName(blank).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _link(scratch: Scratch, members: DataFrame, own: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(node, root) of all linked candidate classes."""
    links, labels, step, last = None, None, 0, STAR_ROUNDS == 0
    while True:
        if labels is None:
            spread = members.withColumn("root", F.col("node"))
        else:
            spread = members.join(labels, "node", "left").withColumn("root", F.coalesce("root", "node"))
        spread = scratch.table(spread.select("bucket", "node", "n", "root"), f"spread-{step}")
        # the leader's root travels with it, so members of its component are left out
        leaders = spread.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.min_by(F.struct("node", "root"), F.xxhash64("node", F.lit(step))).alias("leader"), F.count("*").alias("size"), F.sum(F.col("n") * 8 + 4 * SIGNATURE).alias("bytes"))
        # the only pair of a bucket of two was compared in the first round
        leaders = leaders.filter("low <> high" if step == 0 else "low <> high and size > 2").select("bucket", "leader", "bytes")
        leaders = scratch.table(leaders, f"leaders-{step}")
        if not leaders.limit(1).count():
            break
        if step:
            scratch.drop(f"spread-{step - 1}")
            last = step >= STAR_ROUNDS or _pairs_a_member(spread) <= PAIRS
        if not last:
            pairs = keyed_join(spread, leaders, "bucket").filter("root <> leader.root")
            pairs = scratch.table(pairs.select(F.col("leader.node").alias("a"), F.col("node").alias("b")).distinct(), f"pairs-{step}")
            pairs = scratch.table(_pruned(pairs, own, percent), f"pruned-{step}")
            found = scratch.table(_verified(pairs, sets, percent), f"links-{step}")
        else:
            found = scratch.table(_leftover(spread, leaders, own, sets, percent), f"links-{step}")
        links = found if links is None else links.unionByName(found)
        if found.limit(1).count():
            labels = components(links, scratch, f"components-{step}")
        step += 1
        if last:
            break
    for name in ("sets", "own", "members", "reps"):
        scratch.drop(name)
    return labels


def _pairs_a_member(spread: DataFrame) -> float:
    """Pairs that the exact comparison would look at, over the members of all buckets."""
    roots = spread.groupBy("bucket", "root").agg(F.count("*").alias("n"))
    buckets = roots.groupBy("bucket").agg(F.sum("n").alias("size"), F.max("n").alias("top"))
    total = buckets.agg(F.sum((F.col("size") - F.col("top")) * F.col("size")).alias("pairs"), F.sum("size").alias("size")).first()
    return (total["pairs"] or 0) / max(1, total["size"] or 0)


def near_dedup(df: DataFrame, width: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``df`` that stay, with their columns: of each component the document of smallest id.

    Rows that cannot be among the dropped ones (a Bloom filter tells) don't shuffle.
    """
    scratch = Scratch(df.sparkSession, "near-dropped")
    dropped = scratch.table(_classes(df, width, percent, doc_id, text).filter("not kept").select("mark").distinct(), "marks")
    flag, mark, key = fresh(df, "may_drop", "mark", "drop_mark")
    rows = df.withColumn(mark, _mark(df[doc_id].cast("long"), text_of(df, text)))
    rows = rows.withColumn(flag, Members(dropped, "mark").may_hold(F.col(mark)))
    gone = dropped.select(F.col("mark").alias(key))
    stay = rows.filter(F.col(flag)).join(gone, F.col(mark) == F.col(key), "left_anti")
    return rows.filter(~F.col(flag)).unionByName(stay).select(*df.columns)
