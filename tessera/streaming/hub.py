"""A hub of job events: watchers who may come late get the running picture and every conflict, slow ones get less progress, never less conflicts.

Events (job_id, kind, seq, at, watcher, stage, calls, counts, payload): ``progress`` and ``conflict`` come from runs, ``watch`` and ``leave`` from watchers, ``done`` ends a
job. State per job is the picture merged field by field (the newest stage and counts, the largest number of calls), its conflicts by
seq, its watchers, and the time up to which its lease is good. In each micro-batch the progress of a job coalesces into one delivery for
each watcher, so however fast a run is, a watcher's queue grows by one picture per batch; conflicts are delivered each once. A watcher who attaches gets picture and
conflicts from state, also after a restart. A timer tells watchers of a job that has been silent for longer than its lease; ``done`` closes all and clears the state, ``KEPT`` after
its time the memory of it goes too.

Deliveries: job_id, watcher, kind (``progress``, ``conflict``, ``silent``, ``closed``), seq, stage, calls, counts, payload. ``delivered`` makes the final ones of a table of
events by joins: what each watcher must have at the end, whatever the batches were.

Nulls: rows without job_id, kind or seq are left out, null fields of a progress event mean unchanged. Repeated events change nothing. Ties of seq are repeats of one event.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

DELIVERY = "job_id string, watcher string, kind string, seq long, stage string, calls long, counts string, payload string"
_PICTURE = "seq long, stage_seq long, stage string, calls long, counts_seq long, counts string, lease_ms long, timer_ms long, closed boolean"
#: Milliseconds for which a closed job is remembered, so late events don't open it again.
KEPT = 24 * 3600 * 1000


class Hub(StatefulProcessor):
    """State and timers of one job."""

    def __init__(self, lease_ms: int) -> None:
        self.lease_ms = lease_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.picture = handle.getValueState("picture", _PICTURE)
        self.conflicts = handle.getMapState("conflicts", "seq long", "payload string")
        self.watchers = handle.getMapState("watchers", "watcher string", "seq long")

    def _read(self) -> dict:
        if self.picture.exists():
            return dict(zip((c.split()[0] for c in _PICTURE.split(", ")), self.picture.get(), strict=True))
        return {c.split()[0]: None for c in _PICTURE.split(", ")} | {"closed": False}

    @staticmethod
    def _merge(p: dict, e: Row) -> None:
        """Events are partial: each field takes its newest value, calls never fall."""
        p["seq"] = max(p["seq"] or 0, e.seq)
        for name in ("stage", "counts"):
            if getattr(e, name) is not None and e.seq >= (p[f"{name}_seq"] if p[f"{name}_seq"] is not None else -1):
                p[name], p[f"{name}_seq"] = getattr(e, name), e.seq
        if e.calls is not None:
            p["calls"] = max(p["calls"] or 0, e.calls)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        job, p = key[0], self._read()
        events = sorted({(r.seq, r.kind, r.watcher or ""): r for r in rows}.items())
        if p["closed"]:
            for (_, kind, watcher), _ in events:
                if kind == "watch":
                    yield self._say(job, watcher, "closed", p)
            return
        known = {w[0] for w in self.watchers.keys()}
        moved, newest, new_conflicts, joined, done = False, p["lease_ms"] or 0, [], [], False
        for (seq, kind, watcher), e in events:
            newest = max(newest, (int(e.at.timestamp() * 1000) if e.at else 0) + self.lease_ms)
            if kind == "progress":
                self._merge(p, e)
                moved = True
            elif kind == "conflict" and not self.conflicts.containsKey((seq,)):
                self.conflicts.updateValue((seq,), (e.payload,))
                new_conflicts.append((seq, e.payload))
            elif kind == "watch" and watcher not in known:
                self.watchers.updateValue((watcher,), (seq,))
                joined.append(watcher)
            elif kind == "leave" and (watcher in known or watcher in joined):
                self.watchers.removeKey((watcher,))
                known.discard(watcher)
                joined = [w for w in joined if w != watcher]
            done = done or kind == "done"
        for w in sorted(known):
            if moved:
                yield self._say(job, w, "progress", p)
            for seq, payload in new_conflicts:
                yield self._say(job, w, "conflict", p, seq, payload)
        if joined:
            everything = sorted((k[0], v[0]) for k, v in self.conflicts.iterator())
            for w in joined:
                if p["seq"] is not None:
                    yield self._say(job, w, "progress", p)
                for seq, payload in everything:
                    yield self._say(job, w, "conflict", p, seq, payload)
        if p["timer_ms"] is not None:
            self.handle.deleteTimer(p["timer_ms"])
        p["lease_ms"] = newest
        if done:
            for w in sorted(known | set(joined)):
                yield self._say(job, w, "closed", p)
            self.conflicts.clear()
            self.watchers.clear()
            p["closed"] = True
        now = timerValues.getCurrentWatermarkInMs()
        p["timer_ms"] = max(newest + KEPT if done else newest, now + 1)
        self.handle.registerTimer(p["timer_ms"])
        self.picture.update(tuple(p.values()))

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        p = self._read()
        if p["closed"]:
            self.picture.clear()
            return
        for w in sorted(w[0] for w in self.watchers.keys()):
            yield self._say(key[0], w, "silent", p)
        p["timer_ms"] = None
        self.picture.update(tuple(p.values()))

    def close(self) -> None:
        pass

    @staticmethod
    def _say(job: str, watcher: str, kind: str, p: dict, seq: int | None = None, payload: str | None = None) -> Row:
        return Row(job_id=job, watcher=watcher, kind=kind, seq=p["seq"] if seq is None else seq, stage=p["stage"], calls=p["calls"], counts=p["counts"], payload=payload)


def hub(events: DataFrame, lease_seconds: int = 60, late: str = "10 minutes") -> DataFrame:
    """Deliveries of a stream of events; the session's state store must be one that keeps maps and timers (RocksDB)."""
    rows = events.filter("job_id is not null and kind is not null and seq is not null").withWatermark("at", late)
    rows = rows.select(F.col("job_id").cast("string").alias("job_id"), "kind", F.col("seq").cast("long").alias("seq"), "at", F.col("watcher").cast("string").alias("watcher"), "stage", F.col("calls").cast("long").alias("calls"), "counts", "payload")
    return rows.groupBy("job_id").transformWithState(Hub(lease_seconds * 1000), DELIVERY, "Append", "EventTime")


def delivered(events: DataFrame) -> DataFrame:
    """job_id, watcher, kind, seq, stage, calls, counts, payload that each watcher who stayed has at the end: the last picture, and each conflict once."""
    rows = events.filter("job_id is not null and kind is not null and seq is not null").withColumn("job_id", F.col("job_id").cast("string"))
    newest = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(c)
    picture = rows.filter("kind = 'progress'").groupBy("job_id").agg(F.max("seq").alias("seq"), newest("stage"), F.max("calls").alias("calls"), newest("counts"))
    last = rows.filter("kind in ('watch', 'leave')").groupBy("job_id", "watcher").agg(F.max_by("kind", F.struct("seq", "kind")).alias("kind")).filter("kind = 'watch'").select("job_id", "watcher")
    found = rows.filter("kind = 'conflict'").groupBy("job_id", "seq").agg(F.min("payload").alias("payload"))
    shown = last.join(picture, "job_id").select("job_id", "watcher", F.lit("progress").alias("kind"), "seq", "stage", "calls", "counts", F.lit(None).cast("string").alias("payload"))
    told = last.join(found, "job_id").select("job_id", "watcher", F.lit("conflict").alias("kind"), "seq", *[F.lit(None).cast(t).alias(c) for c, t in (("stage", "string"), ("calls", "long"), ("counts", "string"))], "payload")
    return shown.unionByName(told)
