"""Records of several chunks to one record each: entities by id, relations by ends and type.

Records have ``attributes`` (a JSON object) and ``ord``, a total order; the first record stays and
its gaps are filled from later ones. Values are compared and kept as JSON text, so ``1`` and ``"1"``
differ. Null or unreadable attributes count as none. Entities, of which each has many records, are partial aggregation on
the keys; relations, of which most have one, meet once by their ends. No list of a group's records is ever built.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import fold, fold_key


def _values(records: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key, attribute and distinct value, with the first ``ord`` that has it."""
    parsed = F.from_json("attributes", "map<string,variant>")
    rows = records.select(*keys, "ord", F.explode(parsed).alias("attr", "raw"))
    rows = rows.select(*keys, "ord", "attr", F.to_json("raw").alias("value"))
    return rows.groupBy(*keys, "attr", "value").agg(F.min("ord").alias("ord"))


def _as_object(pairs: Column) -> Column:
    """JSON object of an array of structs (attr, value as JSON text), by attribute name."""
    quoted = lambda p: F.regexp_replace(F.to_json(F.create_map(p["attr"], F.lit(1))), r"^\{|:1\}$", "")
    return F.concat(F.lit("{"), F.array_join(F.transform(F.array_sort(pairs), lambda p: F.concat(quoted(p), F.lit(":"), p["value"])), ","), F.lit("}"))


def _folded(records: DataFrame, keys: list[str], keep: list[str]) -> tuple[DataFrame, DataFrame]:
    """First record of each key with filled attributes, and the first value of each attribute."""
    values = _values(records, keys)
    kept = values.groupBy(*keys, "attr").agg(F.min_by("value", "ord").alias("kept"))
    filled = kept.groupBy(*keys).agg(_as_object(F.collect_list(F.struct("attr", F.col("kept").alias("value")))).alias("attributes"))
    first = records.groupBy(*keys).agg(F.min("ord").alias("ord"), *(F.min_by(c, "ord").alias(c) for c in keep))
    out = first.join(filled, keys, "left").withColumn("attributes", F.coalesce("attributes", F.lit("{}")))
    return out, values.join(kept, [*keys, "attr"])


def _met(records: DataFrame, ids: list[str], keys: list[str], keep: list[str]) -> DataFrame:
    """First record of each key with filled attributes.

    Rows meet once, by ``ids`` (a part of the key), and are sorted there once for both aggregations, so what a task holds is bounded by a
    partition and spills; a record travels with the first of its attributes.
    """
    parsed = F.from_json("attributes", "map<string,variant>")
    rows = records.select(*keys, "ord", F.struct("ord", *keep).alias("_record"), F.posexplode_outer(parsed).alias("_at", "attr", "raw"))
    record = F.when(F.coalesce("_at", F.lit(0)) == 0, F.col("_record"))
    rows = rows.select(*keys, "ord", "attr", F.to_json("raw").alias("value"), record.alias("_record")).repartition(*ids)
    first = F.min_by("_record", "_record.ord").alias("_record")
    each = rows.groupBy(*keys, "attr").agg(F.min_by("value", "ord").alias("value"), first)
    pairs = F.collect_list(F.when(F.col("attr").isNotNull(), F.struct("attr", "value")))
    out = each.groupBy(*keys).agg(first, pairs.alias("_pairs"))
    return out.select(*keys, "_record.*", F.when(F.size("_pairs") > 0, _as_object(F.col("_pairs"))).otherwise("{}").alias("attributes"))


def merge_entities(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Merged entities (id, type, name, attributes, prov, ord) and ``entity_attributes`` conflicts.

    A conflict names the attribute, the value that stays and one that differs; each such value once.
    """
    out, seen = _folded(records, ["id"], ["type", "name", "prov"])
    clash = seen.filter("value <> kept").select(F.lit("entity_attributes").alias("kind"), F.col("id").alias("subject"), "attr", F.col("kept").alias("left"), F.col("value").alias("right"))
    return out.select("id", "type", "name", "attributes", "prov", "ord"), clash


def merge_relations(records: DataFrame) -> DataFrame:
    """One relation per (from, folded type, to): the first, with gaps filled; differing values are no conflict."""
    out = _met(records.withColumn("_type", fold(F.col("type"))), ["from_id", "to_id"], ["from_id", "_type", "to_id"], ["type", "key", "prov"])
    return out.select("from_id", "type", "to_id", "key", "attributes", "prov", "ord")


def resolve_ends(relations: DataFrame, entities: DataFrame) -> DataFrame:
    """Ends written ``:name`` become the id of the only entity of their source with that folded name.

    Where none or several have the name the end stays as it is and later checks report it.
    """
    names = entities.select(F.col("prov.source").alias("_source"), fold_key(F.col("name")).alias("_name"), "id")
    only = names.groupBy("_source", "_name").agg(F.min("id").alias("_low"), F.max("id").alias("_high")).filter("_low = _high").drop("_high")
    columns, out = relations.columns, relations.withColumn("_source", F.col("prov.source"))
    for end in ("from_id", "to_id"):
        named = F.when(F.col(end).startswith(":"), fold_key(F.substring(end, 2, 1 << 30)))
        out = out.withColumn("_name", named).join(only, ["_source", "_name"], "left").withColumn(end, F.coalesce("_low", end)).drop("_name", "_low")
    return out.select(*columns)
