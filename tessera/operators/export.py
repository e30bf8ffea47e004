"""Graphs for other stores: edge identity, losses, flattened attributes, Turtle lines, pages of a result.

Everything is built from column functions; groups are reduced by partial aggregation.
Nulls count as absent: a null attribute is dropped, a null name falls back to the id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What makes an edge of a store one edge.
EDGE_KEYS = {
    "property": ["from_id", "type", "to_id", "key", "attributes", "prov"],
    "triple": ["from_id", "type", "to_id"],
    "facet": ["from_id", "type", "to_id"],
    "document": ["from_id", "type", "to_id", "document"],
}
RESERVED = "prov_"


class ReservedName(ValueError):
    """An attribute has the prefix that a store keeps for provenance."""


def stored_edges(relations: DataFrame, store: str) -> tuple[DataFrame, DataFrame]:
    """First edge of each identity in the store, and what is lost: from_id, type, to_id, merged.

    Equal repeats (same key, attributes and provenance) are no loss.
    """
    rows = relations.withColumn("document", F.col("prov.source"))
    keys = EDGE_KEYS[store]
    whole = F.unhex(F.sha2(F.to_json(F.struct("key", "attributes", "prov")), 256))  # 32 bytes in every task's table of keys, not 64
    rest = [c for c in relations.columns if c not in keys]
    # distinct assertions are reduced before edges are, so a hub's repeats never meet in one task
    once = rows.withColumn("_h", whole).groupBy(*dict.fromkeys([*keys, "_h"])).agg(F.min_by(F.struct(*rest), "ord").alias("r"), F.min("ord").alias("_o"))
    grouped = once.groupBy(*keys).agg(F.min_by("r", "_o").alias("r"), (F.count("*") - 1).alias("merged"))
    kept = grouped.select(*keys, "r.*").select(*relations.columns)
    return kept, grouped.filter("merged > 0").groupBy("from_id", "type", "to_id").agg(F.sum("merged").alias("merged"))


def with_endpoints(relations: DataFrame, entities: DataFrame) -> DataFrame:
    """Edges with from_name, from_type, to_name, to_type and ``dangling``; an unknown or nameless end is named by its id."""
    first = entities.groupBy("id").agg(F.min_by(F.struct("name", "type"), "ord").alias("e"))
    out = relations
    for side in ("from", "to"):
        end = first.select(F.col("id").alias(f"{side}_id"), F.col("e").alias(f"_{side}"))
        out = out.join(end, f"{side}_id", "left")
        name = F.col(f"_{side}.name")
        out = out.withColumns({f"{side}_name": F.when(F.coalesce(name, F.lit("")) == "", F.col(f"{side}_id")).otherwise(name), f"{side}_type": F.col(f"_{side}.type")})
    return out.withColumn("dangling", F.col("_from").isNull() | F.col("_to").isNull()).drop("_from", "_to")


def flattened(records: DataFrame, attributes: str = "attributes") -> DataFrame:
    """``flat`` (map of text) and ``encoded`` (names whose values are JSON text), in place of nested attributes."""
    fields = F.map_filter(F.coalesce(F.from_json(attributes, "map<string,string>"), F.create_map().cast("map<string,string>")), lambda k, v: v.isNotNull())
    types = F.map_filter(fields, lambda k, v: v.startswith("{") | v.startswith("["))
    return records.withColumn("flat", fields).withColumn("encoded", F.array_sort(F.map_keys(types)))


def refuse_reserved(records: DataFrame, attributes: str = "attributes") -> None:
    named = records.filter(F.exists(F.coalesce(F.json_object_keys(attributes), F.array().cast("array<string>")), lambda k: k.startswith(RESERVED))).limit(1).collect()
    if named:
        raise ReservedName(f"an attribute begins with {RESERVED}")


def iri(base: str, *parts: Column) -> Column:
    """An IRI of encoded parts; parts that differ give IRIs that differ."""
    coded = [F.replace(F.url_encode(F.coalesce(p.cast("string"), F.lit(""))), F.lit("+"), F.lit("%20")) for p in parts]
    return F.concat(F.lit(f"<{base}"), F.concat_ws("/", *coded), F.lit(">"))


def literal(value: Column) -> Column:
    out = value.cast("string")
    for sign, coded in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        out = F.replace(out, F.lit(sign), F.lit(coded))
    return F.concat(F.lit('"'), out, F.lit('"'))


def turtle(entities: DataFrame, relations: DataFrame, base: str) -> DataFrame:
    """Column line: type and label of each entity, each edge, and each edge's provenance on the quoted triple."""
    node = iri(f"{base}entity/", F.col("id"))
    kinds = entities.select(F.concat_ws(" ", node, F.lit("a"), iri(f"{base}type/", F.col("type")), F.lit(".")).alias("line"))
    labels = entities.filter("coalesce(name, '') <> ''").select(F.concat_ws(" ", node, F.lit("<http://www.w3.org/2000/01/rdf-schema#label>"), literal(F.col("name")), F.lit(".")).alias("line"))
    triple = F.concat_ws(" ", iri(f"{base}entity/", F.col("from_id")), iri(f"{base}relation/", F.col("type")), iri(f"{base}entity/", F.col("to_id")))
    edges = relations.select(F.concat_ws(" ", triple, F.lit(".")).alias("line"))
    said = F.concat(F.lit("<< "), triple, F.lit(f" >> <{base}prov/source> "), literal(F.col("prov.source")), F.lit(f" ; <{base}prov/producer> "), literal(F.col("prov.producer")), F.lit(" ."))
    facts = relations.filter("prov.source is not null and prov.producer is not null").select(said.alias("line"))
    return kinds.unionByName(labels).unionByName(edges).unionByName(facts).distinct()


def pages(records: DataFrame, size: int = 500) -> DataFrame:
    """Column page (from 1) behind ``records`` (columns kind_no and ord of any type that sorts): ``size`` records each, the last may have fewer."""
    from tessera.operators.numbering import numbered

    out = numbered(records, ["kind_no", "ord"], "_number")
    return out.withColumn("page", F.floor(F.col("_number") / size).cast("long") + 1).drop("_number")


def page_defects(got: DataFrame) -> DataFrame:
    """Why pages (page, last) cannot be put together: ``gap``, ``repeated``, ``no_last`` or ``several_last``."""
    s = got.agg(F.count("*").alias("n"), F.count_distinct("page").alias("d"), F.max("page").alias("top"), F.min("page").alias("low"), F.count_if("last").alias("lasts"), F.max(F.when(F.col("last"), F.col("page"))).alias("end"))
    checks = {"repeated": F.col("n") > F.col("d"), "gap": (F.col("d") != F.col("top")) | (F.col("low") != 1), "no_last": (F.col("lasts") == 0) | (F.col("end") < F.col("top")), "several_last": F.col("lasts") > 1}
    found = F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in checks.items()]))
    return s.select(F.explode(found).alias("defect"))
