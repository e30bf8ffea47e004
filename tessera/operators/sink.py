"""What a store owes a graph: a load begun under an identity, written kind by kind, and committed or aborted as a whole."""

from __future__ import annotations

import datetime
import json
import uuid
from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import load, preflight
from tessera.operators.cut import cut
from tessera.operators.txlog import Log
from tessera.sources import batch_files

#: Entities come before the relations that name them, findings last.
ORDER = ["entities", "relations", "chunks", "vectors"]


class Tx(Protocol):
    """One load in progress. ``converged``: the store has this graph already, so nothing needs to be written."""

    converged: str | None

    def write(self, kind: str, records: DataFrame) -> int:
        """Hand over records of a kind; returns how many landed."""

    def commit(self) -> str:
        """Make the load visible; returns its name."""

    def abort(self) -> None:
        """Leave nothing of the load."""


class Sink(Protocol):
    def begin(self, load_id: str, digest: str, replace: bool) -> Tx:
        """Open a load; raises ``load.Held`` where the name is taken by a different graph."""


@dataclass
class Report:
    """What became of a load: its name, whether the store had it, rows that landed by kind (also on failure, in ``failed``)."""

    load_id: str
    digest: str
    converged: bool = False
    landed: dict[str, int] = field(default_factory=dict)


class LoadFailed(RuntimeError):
    def __init__(self, report: Report) -> None:
        super().__init__(f"load {report.load_id} failed after {report.landed}")
        self.report = report


def load_graph(sink: Sink, load_id: str, records: dict[str, DataFrame], replace: bool = False) -> Report:
    """Check a graph, name it by its content and hand it to a store; an error aborts the load and says what had landed."""
    records = {k: cut(df) for k, df in records.items()}
    preflight.refuse(records)
    name = load.digest(records)
    report = Report(load_id or f"ld_{name[:24]}", name)
    tx = sink.begin(report.load_id, name, replace)
    if tx.converged:
        report.load_id, report.converged = tx.converged, True
        return report
    try:
        parts = records | {"entities": load.corroborated(records["entities"])}
        for kind in sorted(parts, key=lambda k: (ORDER.index(k) if k in ORDER else len(ORDER), k)):
            report.landed[kind] = tx.write(kind, parts[kind])
        report.load_id = tx.commit()
    except Exception as e:
        tx.abort()
        raise LoadFailed(report) from e
    return report


class FilesSink:
    """A store of bounded batches (``sources.batch_files``) whose loads become visible by a commit of its log."""

    def __init__(self, spark: SparkSession, root: str, rows: int = batch_files.ROWS, size: int = batch_files.BYTES) -> None:
        batch_files.register(spark)
        self.spark, self.root, self.log, self.rows, self.size = spark, root.rstrip("/"), Log(spark, root), rows, size

    def _state(self, seen: int | None, *keys: str) -> dict[str, dict]:
        return {r["key"]: json.loads(r["value"]) for r in self.log.state(seen).filter(F.col("key").isin(*keys)).collect()}

    def begin(self, load_id: str, digest: str, replace: bool) -> FilesTx:
        seen = self.log.version()
        state = self._state(seen, f"load/{load_id}", f"content/{digest}")
        if f"content/{digest}" in state:
            return FilesTx(self, load_id, digest, seen, None, state[f"content/{digest}"]["load_id"])
        if f"load/{load_id}" in state and not replace:
            raise load.Held(f"{load_id} holds a different graph")
        return FilesTx(self, load_id, digest, seen, state.get(f"load/{load_id}"), None)

    def read(self, kind: str, load_id: str, *where: batch_files.Condition) -> DataFrame:
        """Records of a kind of one load that meet the conditions; raises LookupError without it."""
        entry = self._state(None, f"load/{load_id}").get(f"load/{load_id}")
        if not entry or kind not in entry["kinds"]:
            raise LookupError(f"{load_id} has no {kind}")
        return batch_files.read(self.spark, f"{self.root}/{kind}/{entry['version']}", *where)


class FilesTx:
    def __init__(self, sink: FilesSink, load_id: str, digest: str, seen: int, old: dict | None, converged: str | None) -> None:
        self.sink, self.load_id, self.digest, self.seen, self.old, self.converged = sink, load_id, digest, seen, old, converged
        self.version, self.kinds = uuid.uuid4().hex, []

    def _path(self, kind: str) -> str:
        return f"{self.sink.root}/{kind}/{self.version}"

    def write(self, kind: str, records: DataFrame) -> int:
        self.kinds.append(kind)
        records.write.format(batch_files.FORMAT).mode("append").option("rows", self.sink.rows).option("bytes", self.sink.size).save(self._path(kind))
        return self.sink.spark.read.format(batch_files.FORMAT).load(self._path(kind)).count()

    def commit(self) -> str:
        entry = {"load_id": self.load_id, "digest": self.digest, "version": self.version, "kinds": self.kinds, "at": datetime.datetime.now(datetime.UTC).isoformat()}
        changes = {f"load/{self.load_id}": json.dumps(entry), f"content/{self.digest}": json.dumps({"load_id": self.load_id})}
        if self.old:
            changes[f"content/{self.old['digest']}"] = None
        self.sink.log.commit(changes, self.seen)
        return self.load_id

    def abort(self) -> None:
        for kind in self.kinds:
            self.sink.log.folder.remove(f"{kind}/{self.version}")
