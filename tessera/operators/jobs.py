"""Import jobs as rows: states, claims under a lease with a fence, expiry and admission.

Every function takes the table of jobs and returns rows that are to change, so the caller writes them by the
means of its store (a merge, an overwritten partition). Times are timestamps given by the caller; nothing reads a clock.

Ties in age go to the smaller job_id. A null lease counts as expired, a null time as the oldest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Who may move a job from one state to the next, and seconds that it may stay in a state.
MOVES = {
    "PENDING": {"RUNNING": ["worker"], "CANCELLED": ["caller"], "EXPIRED": ["sweeper"]},
    "RUNNING": {"RUNNING": ["worker"], "PENDING": ["worker", "sweeper"], "NEEDS_REVIEW": ["worker"], "SUCCEEDED": ["worker"], "FAILED": ["worker"], "CANCELLED": ["caller"]},
    "NEEDS_REVIEW": {"SUCCEEDED": ["caller"], "FAILED": ["caller"], "CANCELLED": ["caller"], "EXPIRED": ["sweeper"]},
    "SUCCEEDED": {},
    "FAILED": {},
    "EXPIRED": {},
    "CANCELLED": {},
}
PENDING_TTL, REVIEW_TTL, CONFLICT_TTL, DONE_TTL = 3600, 86400, 7 * 86400, 3600
TERMINAL = [s for s, after in MOVES.items() if not after]
CAPACITY = 128


def transitions(jobs: DataFrame, wanted: DataFrame) -> DataFrame:
    """job_id, state, fence, refused: each request of ``wanted`` (job_id, to, by, fence) on its job.

    ``refused`` is null where the request holds, else ``unknown_job``, ``stale_fence`` (a worker that no longer
    holds the running job) or ``not_allowed``.
    """
    moves = F.array(*[F.lit(f"{a}>{b}:{who}") for a, after in MOVES.items() for b, may in after.items() for who in may])
    rows = wanted.select("job_id", "to", "by", F.col("fence").alias("held")).join(jobs.select("job_id", F.col("state").alias("was"), "fence"), "job_id", "left")
    stale = (F.col("was") == "RUNNING") & (F.col("by") == "worker") & ~F.col("held").eqNullSafe(F.col("fence"))
    fits = F.array_contains(moves, F.concat("was", F.lit(">"), "to", F.lit(":"), "by"))
    refused = F.when(F.col("was").isNull(), "unknown_job").when(stale, "stale_fence").when(~F.coalesce(fits, F.lit(False)), "not_allowed")
    return rows.withColumn("refused", refused).select("job_id", F.when(F.col("refused").isNull(), F.col("to")).otherwise(F.col("was")).alias("state"), "fence", "refused")


def expired_lease(now: Column) -> Column:
    return (F.col("state") == "RUNNING") & F.coalesce(F.col("lease_until") <= now, F.lit(True))


def claim(jobs: DataFrame, now: Column, lease_seconds: int, n: int = 1) -> DataFrame:
    """The ``n`` oldest jobs that are pending or whose lease has run out, running under a new fence and lease."""
    free = jobs.filter((F.col("state") == "PENDING") | expired_lease(now)).orderBy("created_at", "job_id").limit(n)
    return free.withColumns({"state": F.lit("RUNNING"), "fence": F.col("fence") + 1, "lease_until": now + F.make_interval(secs=F.lit(lease_seconds))})


def heartbeat(jobs: DataFrame, held: DataFrame, now: Column, lease_seconds: int) -> DataFrame:
    """Running jobs whose ``held`` (job_id, fence) is the newest fence, with a longer lease."""
    own = jobs.filter("state = 'RUNNING'").join(held.select("job_id", "fence").distinct(), ["job_id", "fence"], "left_semi")
    return own.withColumn("lease_until", now + F.make_interval(secs=F.lit(lease_seconds)))


def sweep(jobs: DataFrame, now: Column) -> DataFrame:
    """job_id, was, state of jobs whose time is over: back to PENDING, EXPIRED, or ``reaped`` if they had ended.

    Jobs in review stay longer where ``has_conflict`` is true.
    """
    state = F.col("state")
    seconds = F.when(state == "PENDING", PENDING_TTL).when(state.isin(*TERMINAL), DONE_TTL).when(F.coalesce("has_conflict", F.lit(False)), CONFLICT_TTL).otherwise(REVIEW_TTL)
    over = F.coalesce(F.col("updated_at") + F.make_interval(secs=seconds) <= now, F.lit(True))
    to = F.when(state == "RUNNING", F.when(expired_lease(now), "PENDING")).when(over, F.when(state.isin(*TERMINAL), "reaped").otherwise("EXPIRED"))
    return jobs.select("job_id", state.alias("was"), to.alias("state")).filter("state is not null")


def admit(jobs: DataFrame, wanted: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """job_id, verdict of new requests: ``existing`` for a known id, ``admitted`` while there is room, else ``refused``.

    At most ``capacity`` ids are ranked, so no window runs over all requests.
    """
    new = wanted.select("job_id").distinct()
    known = jobs.select("job_id").distinct()
    room = max(0, capacity - jobs.filter(~F.col("state").isin(*TERMINAL)).limit(capacity).count())
    fresh = new.join(known, "job_id", "left_anti")
    let_in = fresh.orderBy("job_id").limit(room)
    said = new.join(known.withColumn("known", F.lit(True)), "job_id", "left").join(let_in.withColumn("fits", F.lit(True)), "job_id", "left")
    return said.select("job_id", F.when(F.col("known"), "existing").when(F.col("fits"), "admitted").otherwise("refused").alias("verdict"))
