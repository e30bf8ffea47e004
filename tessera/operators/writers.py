"""Rows for stores of other kinds: property graphs, point stores, facet graphs and document brains.

The rows are what a store's own loader writes: every value is a text, number, flag, or list of them, and every record keeps
its provenance under a reserved prefix. Writing them to a server is left to the caller's connector (``foreachPartition`` over batches).

Nested attribute values are kept as JSON text and named in ``_encoded``. Nulls are left out. Repeats of a record in a store
that keeps one are folded by ``export.stored_edges`` first, which counts what is lost.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import framed
from tessera.operators import export

PREFIX = export.RESERVED
BATCH = 500
#: Provenance fields in the order in which stores list them (fixed values).
FIELDS = ["source", "chunk", "producer", "model", "ontology", "confidence", "reviewed_by", "rule_set", "ruled_by", "by", "at"]


class WidthMismatch(ValueError):
    """Vectors of one load have different widths."""


def provenance(records: DataFrame) -> Column:
    """A map of the provenance fields that a record has, as texts under the prefix; a record without a chunk names none."""
    have = records.schema["prov"].dataType.names
    pairs = []
    for f in FIELDS:
        if f in have:
            value = F.col(f"prov.{f}")
            shown = F.when(value >= 0, value.cast("string")) if f == "chunk" else F.when(value.cast("string") != "", value.cast("string"))
            pairs.append(F.struct(F.lit(PREFIX + f).alias("key"), shown.alias("value")))
    return F.map_from_entries(F.filter(F.array(*pairs), lambda p: p["value"].isNotNull()))


def identity(kind: str, *parts: str | Column) -> Column:
    """A UUID of a record's kind and identity: equal records get equal names in every load."""
    h = F.sha2(F.concat(*[framed(F.coalesce(F.col(p).cast("string") if isinstance(p, str) else p, F.lit(""))) for p in (F.lit(kind), *parts)]), 256)
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12))


def property_nodes(entities: DataFrame, load_id: str) -> DataFrame:
    """id, labels, properties, encoded: the type is a label; properties are the attributes, name, load and provenance."""
    flat = export.flattened(entities)
    own = F.map_from_entries(F.filter(F.array(F.struct(F.lit("name").alias("key"), F.col("name").alias("value")), F.struct(F.lit(f"{PREFIX}load").alias("key"), F.lit(load_id).alias("value"))), lambda p: F.coalesce(p["value"], F.lit("")) != ""))
    return flat.select("id", F.array(F.lit("Node"), "type").alias("labels"), _maps("flat", own, provenance(flat)).alias("properties"), "encoded")


def property_edges(relations: DataFrame, load_id: str) -> DataFrame:
    """from_id, type, to_id, key, properties, encoded; parallel edges stay apart."""
    flat = export.flattened(relations)
    own = F.create_map(F.lit(f"{PREFIX}load"), F.lit(load_id))
    return flat.select("from_id", "type", "to_id", "key", _maps("flat", own, provenance(flat)).alias("properties"), "encoded")


def _maps(first: str, *more: Column) -> Column:
    """Maps as one, by key; a later map's value holds where two have a key."""
    out = F.col(first)
    for m in more:
        out = F.map_concat(_without(out, m), m)
    return F.map_from_entries(F.array_sort(F.map_entries(out)))


def _without(of: Column, other: Column) -> Column:
    return F.map_filter(of, lambda k, v: ~F.map_contains_key(other, k))


def points(entities: DataFrame, relations: DataFrame, chunks: DataFrame, vectors: DataFrame, load_id: str) -> DataFrame:
    """point, kind, payload (JSON), values: entities and edges without a vector, chunks with theirs and the entities read from them."""
    ends = export.with_endpoints(relations, entities)
    e = entities.select(identity("entity", F.lit(load_id), "id").alias("point"), F.lit("entity").alias("kind"), F.to_json(F.struct(F.lit(load_id).alias("load"), "id", "type", "name", F.col("attributes"), provenance(entities).alias("provenance"))).alias("payload"))
    r = ends.select(identity("relation", F.lit(load_id), "from_id", "type", "to_id", "key", "prov.source").alias("point"), F.lit("relation").alias("kind"), F.to_json(F.struct(F.lit(load_id).alias("load"), "from_id", "type", "to_id", "key", "from_name", "from_type", "to_name", "to_type", "dangling", "attributes", provenance(ends).alias("provenance"))).alias("payload"))
    named = entities.filter("prov.chunk >= 0").groupBy(F.col("prov.chunk").alias("idx")).agg(F.sort_array(F.collect_set(F.struct("id", "name"))).alias("named"))
    last = vectors.groupBy(F.col("chunk").alias("idx")).agg(F.max_by("values", "ord" if "ord" in vectors.columns else "chunk").alias("values"))
    c = chunks.join(named, "idx", "left").join(last, "idx", "left")
    empty = F.array().cast("array<string>")
    c = c.select(identity("chunk", F.lit(load_id), "idx").alias("point"), F.lit("chunk").alias("kind"), F.to_json(F.struct(F.lit(load_id).alias("load"), "source", "idx", "text", F.coalesce("named.id", empty).alias("entities"), F.coalesce("named.name", empty).alias("entity_names"))).alias("payload"), "values")
    none = F.lit(None).cast(c.schema["values"].dataType).alias("values")
    return e.withColumn("values", none).unionByName(r.withColumn("values", none)).unionByName(c)


def guard_width(vectors: DataFrame) -> int:
    """The width that all vectors share (0 for none); raises WidthMismatch."""
    row = vectors.agg(F.min(F.size("values")).alias("low"), F.max(F.size("values")).alias("high")).first()
    if row["low"] != row["high"]:
        raise WidthMismatch(f"vectors are {row['low']} to {row['high']} wide")
    return row["low"] or 0


def facets(relations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges with facets, losses) of a store that keeps one edge for two nodes and a type: attributes and provenance lie on the edge.

    Facets hold texts, so nested values are JSON.
    """
    kept, lost = export.stored_edges(relations, "facet")
    flat = export.flattened(kept)
    return flat.select("from_id", "type", "to_id", _maps("flat", provenance(flat)).alias("facets")), lost


def brain(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """document, kind, id, line of a store that keeps triples under the document which said them."""
    own = entities.select(F.col("prov.source").alias("document"), F.lit("entity").alias("kind"), "id", F.concat(F.col("name"), F.lit(" is a "), F.col("type")).alias("line"))
    edges, _ = export.stored_edges(relations, "document")
    said = edges.select(F.col("prov.source").alias("document"), F.lit("relation").alias("kind"), identity("relation", "from_id", "type", "to_id", "prov.source").alias("id"), F.concat_ws(" ", "from_id", "type", "to_id").alias("line"))
    return own.unionByName(said).distinct()


def findings(kind: str, rows: DataFrame, load_id: str) -> DataFrame:
    """id, kind, load_id, body: findings of a report (violations, conflicts, duplicates, proposals) as JSON rows of a store."""
    body = F.to_json(F.struct(*sorted(rows.columns)))
    return rows.select(identity(kind, F.lit(load_id), body).alias("id"), F.lit(kind).alias("kind"), F.lit(load_id).alias("load_id"), body.alias("body")).distinct()


def batched(rows: DataFrame, size: int = BATCH) -> DataFrame:
    """Rows with ``batch``: what a task sends in one call. Batches of different tasks have different numbers; none has more than ``size`` rows."""
    place = F.monotonically_increasing_id()
    return rows.withColumn("batch", F.concat_ws("-", F.spark_partition_id(), F.floor(place.bitwiseAND((1 << 33) - 1) / size)))
