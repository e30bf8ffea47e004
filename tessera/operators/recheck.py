"""Checking again after decisions: only nodes that a decision touched are checked anew, all else is neither read nor checked.

A conflict depends on the records and relations of one node, its owner (``check.owned_conflicts``). So the graph is kept by
owner: entities by id, each relation once for each of its ends, conflicts by owner, in Parquet folders of hash buckets. Decisions name
nodes; the relations of these nodes name the others whose conflicts may change. Their buckets alone are read, by path, and written as a new
version; a commit of the transaction log makes it visible. Two rechecks that meet in a bucket are a ``Conflict``: the later one decides anew.

Relations must have been merged before (one record for each from, type, to and key), so merging the touched ones again changes no others.
``ord`` of entities and relations has one type. Nulls in ids own nothing. A hub is spread over many files of its bucket. Without decisions nothing is read. Decisions on nodes that are not
there change nothing. Files of older versions stay for readers of older snapshots.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessera.operators import check, verify
from tessera.operators.cut import cut
from tessera.operators.txlog import Log

Edit = Callable[[DataFrame, DataFrame], tuple[DataFrame, DataFrame]]
KINDS = ["entities", "relations", "conflicts"]


def owned(relations: DataFrame) -> DataFrame:
    """Each relation once for each of its ends, which is its ``owner``."""
    return relations.withColumn("owner", F.explode(F.array_distinct(F.array("from_id", "to_id")))).filter("owner is not null")


@dataclass
class Rechecked:
    """``opened`` and ``closed``: conflicts that are there only after or only before; ``read``: numbers of the buckets read."""

    opened: DataFrame
    closed: DataFrame
    read: list[int]


class Checked:
    """A checked graph under ``root``. ``buckets`` holds for its whole life; take so many that a bucket fits a few tasks."""

    def __init__(self, spark: SparkSession, root: str, vocabulary: check.Vocabulary | None = None, buckets: int = 64) -> None:
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets
        self.rules = vocabulary if vocabulary is not None and vocabulary.governs() else None
        self.log = Log(spark, root)

    def _state(self) -> tuple[int, dict]:
        """The newest commit and its values: of each bucket the version of each kind, and the columns of each kind."""
        number = self.log.version()
        return number, {r["key"]: json.loads(r["value"]) for r in self.log.state(number).collect()}

    def _bucket(self, owner: str):
        return F.pmod(F.xxhash64(owner), F.lit(self.buckets)).cast("int")

    def _read(self, state: dict, kind: str, buckets: list[int]) -> DataFrame:
        schema = StructType.fromJson(state[f"columns {kind}"])
        at = [(b, state.get(f"bucket {b}", {}).get(kind)) for b in buckets]
        paths = [f"{self.root}/{version}/{kind}/bucket={b}" for b, version in at if version]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _write(self, version: str, kind: str, rows: DataFrame) -> list[int]:
        """Write rows by bucket of their owner, large buckets by many tasks, and return the buckets that have any."""
        n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        dealt = rows.withColumns({"bucket": self._bucket("owner"), "_salt": F.xxhash64("ord")}).repartitionByRange(n, "bucket", "_salt")
        dealt.drop("_salt").write.partitionBy("bucket").parquet(f"{self.root}/{version}/{kind}")
        return [int(x.removeprefix("bucket=")) for x in self.log.folder.names(f"{version}/{kind}") if x.startswith("bucket=")]

    def _canonical(self, entities: DataFrame, relations: DataFrame) -> tuple[DataFrame, DataFrame]:
        if self.rules is None:
            return entities, relations
        records = ((entities, self.rules.entity_types), (relations, self.rules.relation_types))
        return tuple(check.stamped(verify.canonical(rows, types), self.rules.ontology) for rows, types in records)

    def _commit(self, seen: int, tables: dict[str, DataFrame], state: dict, touched: list[int]) -> None:
        version = f"v-{uuid.uuid4().hex}"
        try:
            have = {kind: set(self._write(version, kind, rows)) for kind, rows in tables.items()}
            changes = {f"bucket {b}": json.dumps({kind: version for kind in KINDS if b in have[kind]}) for b in touched}
            for kind, rows in tables.items():
                columns = rows.schema.jsonValue()
                if state.get(f"columns {kind}") != columns:
                    changes[f"columns {kind}"] = json.dumps(columns)
            self.log.commit(changes, seen=seen)
        except BaseException:
            self.log.folder.remove(version)
            raise

    def start(self, entities: DataFrame, relations: DataFrame) -> DataFrame:
        """Check the whole graph once, keep it by owner, and return its conflicts."""
        seen, state = self._state()
        if state:
            raise ValueError(f"{self.root} holds a graph already")
        entities, relations = map(cut, self._canonical(entities, relations))
        ends = owned(relations)
        found = check.owned_conflicts(entities, relations, self.rules.relation_types if self.rules else None)
        tables = {"entities": entities.withColumn("owner", F.col("id")).filter("owner is not null"), "relations": ends, "conflicts": cut(found)}
        self._commit(seen, tables, state, list(range(self.buckets)))
        return self.conflicts()

    def entities(self) -> DataFrame:
        return self._read(self._state()[1], "entities", list(range(self.buckets))).drop("owner")

    def relations(self) -> DataFrame:
        return self._read(self._state()[1], "relations", list(range(self.buckets))).filter("owner = coalesce(from_id, to_id)").drop("owner")

    def conflicts(self) -> DataFrame:
        """kind, subject, left_value, right_value, ord of the newest snapshot."""
        return self._read(self._state()[1], "conflicts", list(range(self.buckets))).drop("owner")

    def _of(self, owners: DataFrame) -> list[int]:
        """Buckets of these nodes: at most ``buckets`` numbers."""
        return sorted(r[0] for r in owners.select(self._bucket("owner")).distinct().collect())

    def recheck(self, nodes: DataFrame, edit: Edit) -> Rechecked:
        """Edit the records of ``nodes`` (id) and check what that touches.

        ``nodes`` holds every entity that a decision changes, removes, merges or merges into, and both ends of every relation that it
        names. ``edit`` makes entities and relations after the decisions from those nodes' entities and all of their relations
        (``apply.apply`` and ``review.merge_into`` as they are).
        """
        seen, state = self._state()
        decided = cut(nodes.select(F.col("id").alias("owner")).filter("owner is not null").distinct())
        first = self._of(decided)
        if not first:
            none = self._read(state, "conflicts", []).drop("owner")
            return Rechecked(none, none, [])
        at = self._read(state, "relations", first).join(decided, "owner", "left_semi")
        # a relation between two decided nodes has two rows here; the row of its first end counts
        inner = decided.select(F.col("owner").alias("from_id"), F.lit(True).alias("_from"))
        mine = cut(at.join(inner, "from_id", "left").filter("_from is null or owner = from_id").drop("_from", "owner"))
        own = self._read(state, "entities", first).join(decided, "owner", "left_semi").drop("owner")
        now, links = map(cut, self._canonical(*edit(own, mine.select(*[c for c in at.columns if c != "owner"]))))
        moved = owned(links)
        reached = cut(decided.unionByName(owned(mine).select("owner")).unionByName(moved.select("owner")).unionByName(now.select(F.col("id").alias("owner"))).distinct())
        touched = self._of(reached)

        def split(kind: str) -> tuple[DataFrame, DataFrame]:
            """Rows of touched buckets whose owner is reached, and the others."""
            rows = self._read(state, kind, touched)
            return rows.join(reached, "owner", "left_semi").select(*rows.columns), rows.join(reached, "owner", "left_anti").select(*rows.columns)

        near, far = split("entities")
        calm = near.join(decided, "owner", "left_anti")
        people = cut(calm.unionByName(now.withColumn("owner", F.col("id")), allowMissingColumns=True))
        around, beyond = split("relations")
        for end in ("from_id", "to_id"):
            around = around.join(decided.select(F.col("owner").alias(end)), end, "left_anti")
        edges = cut(around.unionByName(moved, allowMissingColumns=True))
        before, rest = split("conflicts")
        after = cut(check.owned_conflicts(people.drop("owner"), edges, self.rules.relation_types if self.rules else None).join(reached, "owner", "left_semi").select(*before.columns))
        before = cut(before)
        tables = {"entities": far.unionByName(people, allowMissingColumns=True), "relations": beyond.unionByName(edges, allowMissingColumns=True), "conflicts": rest.unionByName(after)}
        self._commit(seen, tables, state, touched)
        key = ["owner", "kind", "subject"]
        differ = lambda a, b: a.join(b.select(*key).distinct(), key, "left_anti").select(*[c for c in before.columns if c != "owner"])
        return Rechecked(differ(after, before), differ(before, after), touched)
