"""Rows of a table to entities and relations.

A mapping names the entity type, its id and name columns, attribute columns and columns whose cells
refer to other entities. Every record carries its source, producer and an ``ord`` that orders records.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DETERMINISTIC = ("ddl", "graph-import", "human")


@dataclass(frozen=True)
class RelationColumn:
    column: str
    relation_type: str
    target_type: str


@dataclass(frozen=True)
class Mapping:
    entity_type: str
    id_column: str
    name_column: str | None = None
    attributes: dict[str, str] = field(default_factory=dict)
    relations: tuple[RelationColumn, ...] = ()

    def check(self, columns: list[str]) -> None:
        """Raise unless every mapped column exists and is mapped once, and types are given."""
        used = [self.id_column, *([self.name_column] if self.name_column else []), *self.attributes, *(r.column for r in self.relations)]
        missing = [c for c in used if c not in columns]
        twice = {c for c in used if used.count(c) > 1 and c not in (self.id_column, self.name_column)}
        if missing or twice or not self.entity_type or any(not r.relation_type or not r.target_type for r in self.relations):
            raise ValueError(f"bad mapping: missing {missing}, mapped twice {sorted(twice)}")


def entity_id(entity_type: str, key: Column) -> Column:
    return F.concat(F.lit(f"{entity_type.lower()}:"), F.trim(key.cast("string")))


def provenance(source: str | Column, producer: str = "tabular") -> Column:
    return F.struct(F.lit(source).alias("source"), F.lit(-1).alias("chunk"), F.lit(producer).alias("producer"))


@dataclass
class TableRead:
    rows: DataFrame
    violations: DataFrame


def checked_rows(df: DataFrame, mapping: Mapping, order: list[str]) -> TableRead:
    """Rows that count, and violations: ``missing_id``, and ``duplicate_id`` where mapped cells differ.

    The first row of an id in the given order stays; equal repeats are dropped silently.
    """
    mapping.check(df.columns)
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in sorted({mapping.id_column, *filter(None, [mapping.name_column]), *mapping.attributes, *(r.column for r in mapping.relations)})]
    rows = df.withColumn("_id", F.trim(F.coalesce(F.col(mapping.id_column).cast("string"), F.lit("")))).withColumn("_print", F.xxhash64(*cells))
    w = Window.partitionBy("_id").orderBy(*order)
    real = rows.filter("_id <> ''").withColumn("_at", F.row_number().over(w)).withColumn("_first", F.first("_print").over(w))
    missing = rows.filter("_id = ''").select(F.lit("missing_id").alias("kind"), F.lit("").alias("subject"))
    twice = real.filter("_at > 1 and _print <> _first").select(F.lit("duplicate_id").alias("kind"), entity_id(mapping.entity_type, F.col("_id")).alias("subject"))
    return TableRead(real.filter("_at = 1").drop("_id", "_print", "_at", "_first"), missing.unionByName(twice))


def entities(rows: DataFrame, mapping: Mapping, source: str | Column) -> DataFrame:
    """id, type, name, attributes (JSON of the mapped columns, by name), prov."""
    name = F.col(mapping.name_column).cast("string") if mapping.name_column else F.trim(F.col(mapping.id_column).cast("string"))
    made = [F.col(c).cast("string").alias(a) for c, a in sorted(mapping.attributes.items(), key=lambda x: x[1])]
    attributes = F.to_json(F.struct(*made)) if made else F.lit("{}")
    return rows.select(entity_id(mapping.entity_type, F.col(mapping.id_column)).alias("id"), F.lit(mapping.entity_type).alias("type"), F.coalesce(name, F.lit("")).alias("name"), attributes.alias("attributes"), provenance(source).alias("prov"))


def relations(rows: DataFrame, mapping: Mapping, source: str | Column) -> DataFrame:
    """One edge per mapped relation column and non-empty cell: an unpivot, not a join."""
    each = [F.struct(F.lit(r.relation_type).alias("type"), F.lit(r.target_type).alias("target_type"), F.trim(F.col(r.column).cast("string")).alias("cell")) for r in mapping.relations]
    out = rows.select(entity_id(mapping.entity_type, F.col(mapping.id_column)).alias("from_id"), provenance(source).alias("prov"), F.explode(F.array(*each)).alias("r")).filter("r.cell <> ''")
    return out.select("from_id", F.col("r.type").alias("type"), F.concat(F.lower("r.target_type"), F.lit(":"), "r.cell").alias("to_id"), F.lit("").alias("key"), F.col("r.target_type").alias("target_type"), F.col("r.cell").alias("cell"), "prov")


def referenced(edges: DataFrame, own: DataFrame, source: str) -> DataFrame:
    """Stub entities for targets that no row of this source claims."""
    targets = edges.groupBy(F.col("to_id").alias("id")).agg(F.first("target_type").alias("type"), F.first("cell").alias("name"))
    stubs = targets.join(own.select("id"), "id", "left_anti")
    return stubs.select("id", "type", "name", F.lit("{}").alias("attributes"), provenance(source).alias("prov"))
