"""Checks of a graph: violations, conflicts, duplicates, proposals and counts. Nothing is dropped.

Entities have id, type, name, prov and ``ord``; relations from_id, type, to_id, key, prov and ``ord``;
``ord`` is a total order, "first" always means smallest ``ord``. Vocabulary tables are small and fixed by
hand, so they are broadcast; everything else joins or aggregates on its keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import affixes, fold, fold_key
from tessera.sources.tabular import DETERMINISTIC


def deterministic(producer: str = "prov.producer") -> Column:
    return F.col(producer).isin(*DETERMINISTIC)


def canonical(entities: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Types in their declared spelling (``vocabulary`` has name); undeclared ones stay as they are."""
    v = F.broadcast(vocabulary.select(fold(F.col("name")).alias("_f"), F.col("name").alias("_n")))
    return entities.join(v, fold(F.col("type")) == F.col("_f"), "left").withColumn("type", F.coalesce("_n", "type")).drop("_f", "_n")


def unknown_types(records: DataFrame, vocabulary: DataFrame, kind: str, subject: str) -> DataFrame:
    """``unknown_entity_type`` or ``unknown_relation_type``."""
    v = F.broadcast(vocabulary.select(fold(F.col("name")).alias("_f")))
    return records.join(v, fold(F.col("type")) == F.col("_f"), "left_anti").select(F.lit(kind).alias("kind"), F.col(subject).alias("subject"), "type")


def unknown_attributes(entities: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Attributes that their type does not declare; types that declare none are open, ``note`` is exempt."""
    v = F.broadcast(vocabulary.filter("size(attributes) > 0").select(fold(F.col("name")).alias("_f"), F.transform("attributes", fold).alias("_a")))
    rows = entities.join(v, fold(F.col("type")) == F.col("_f")).select("id", "type", F.explode(F.json_object_keys("attributes")).alias("attr"), "_a")
    return rows.filter(~F.array_contains("_a", fold(F.col("attr"))) & (fold(F.col("attr")) != "note")).select(F.lit("unknown_attribute").alias("kind"), F.col("id").alias("subject"), "type", "attr")


def first_types(entities: DataFrame) -> DataFrame:
    return entities.groupBy("id").agg(F.min_by("type", "ord").alias("node_type"))


def with_ends(relations: DataFrame, entities: DataFrame) -> DataFrame:
    types = first_types(entities)
    out = relations.join(types.select(F.col("id").alias("from_id"), F.col("node_type").alias("from_type")), "from_id", "left")
    return out.join(types.select(F.col("id").alias("to_id"), F.col("node_type").alias("to_type")), "to_id", "left")


def dangling(ends: DataFrame) -> DataFrame:
    """One violation per edge, even where both ends are missing."""
    return ends.filter("from_type is null or to_type is null").select(F.lit("dangling_relation").alias("kind"), "from_id", "type", "to_id")


def not_allowed(ends: DataFrame, vocabulary: DataFrame, declared: DataFrame) -> DataFrame:
    """``relation_not_allowed``: an empty end list means any declared type; both_ways also admits the swap."""
    v = F.broadcast(vocabulary.select(fold(F.col("name")).alias("_f"), F.transform("from_types", fold).alias("_from"), F.transform("to_types", fold).alias("_to"), "both_ways"))
    known = F.broadcast(declared.agg(F.collect_set(fold(F.col("name"))).alias("_known")))
    rows = ends.filter("from_type is not null and to_type is not null").join(v, fold(F.col("type")) == F.col("_f")).crossJoin(known)

    def fits(side: str, end: str) -> Column:
        t = fold(F.col(end))
        return F.when(F.size(side) == 0, F.array_contains("_known", t)).otherwise(F.array_contains(side, t))

    good = (fits("_from", "from_type") & fits("_to", "to_type")) | (F.col("both_ways") & fits("_from", "to_type") & fits("_to", "from_type"))
    return rows.filter(~good).select(F.lit("relation_not_allowed").alias("kind"), "from_id", "type", "to_id")


def value_conflicts(claims: DataFrame, keys: list[str], kind: str) -> DataFrame:
    """Each distinct later value (folded) that differs from the first claim of its key, reported once.

    ``claims`` has the keys, ``value`` and ``ord``. Aggregations on the keys and a join of what is left: no window holds a
    hot key, and no rows are joined to each other. Distinct claims are dealt by key once, for the first ones and for the join.
    """
    named = claims.dropna(subset=keys).withColumn("_v", fold_key(F.col("value")))
    each = named.groupBy(*keys, "_v").agg(F.min("ord").alias("ord"), F.min_by("value", "ord").alias("value")).repartition(*keys)
    first = each.groupBy(*keys).agg(F.min_by(F.struct("value", "_v"), "ord").alias("_first"), F.count("*").alias("_n")).filter("_n > 1").drop("_n")
    # a null comparison counts as equal; said so, it puts no filter of its own on one of the two sides, which are one shuffle
    out = each.join(first, keys).filter(~F.coalesce(F.col("_v") == F.col("_first._v"), F.lit(True)))
    return out.select(F.lit(kind).alias("kind"), *keys, F.col("_first.value").alias("left_value"), F.col("value").alias("right_value"), "ord")


def attribute_claims(entities: DataFrame) -> DataFrame:
    """Entity, attribute, value: the name counts where it is not empty, absent attributes claim nothing."""
    pairs = F.map_entries(F.from_json("attributes", "map<string,string>"))
    named = F.when(F.col("name") != "", F.array(F.struct(F.lit("name").alias("key"), F.col("name").alias("value")))).otherwise(F.array().cast("array<struct<key:string,value:string>>"))
    return entities.select("id", "ord", F.explode(F.concat(named, pairs)).alias("a")).select("id", F.col("a.key").alias("attr"), F.col("a.value").alias("value"), "ord").filter("value is not null")


def parallel_keys(relations: DataFrame) -> DataFrame:
    """``edge_key``: the relation's key where its pair and type have two or more distinct ones, else empty."""
    pair = ["_lo", "_hi", "type"]
    rows = relations.withColumn("_lo", F.least("from_id", "to_id")).withColumn("_hi", F.greatest("from_id", "to_id"))
    many = rows.filter("key <> ''").groupBy(*pair).agg(F.countDistinct("key").alias("_n")).filter("_n > 1")
    return rows.join(many, pair, "left").withColumn("edge_key", F.when(F.col("_n") > 1, F.col("key")).otherwise(F.lit(""))).drop("_n")


def direction_conflicts(relations: DataFrame, two_way_types: list[str] = (), one_way_types: list[str] | None = None) -> DataFrame:
    """``relation_direction`` and ``contradiction`` of edges that run both ways between one pair.

    Only types that run one way are asked about: those of ``one_way_types`` (declared and not both ways) where given, else all
    but ``two_way_types``. Four slots per group hold the first record of each direction and standing. Both slots of one standing
    make a direction conflict, whose right side is the later one; slots of different standing a contradiction, whose left side is
    the stated one. The one completed earliest is reported, once per group and kind.
    """
    name = fold(F.col("type"))
    asked = name.isin(*[t.lower() for t in one_way_types]) if one_way_types is not None else ~name.isin(*[t.lower() for t in two_way_types]) if two_way_types else F.lit(True)
    rows = parallel_keys(relations).filter(F.col("_lo") != F.col("_hi")).filter(asked)
    up, sure = F.col("from_id") == F.col("_lo"), deterministic()
    said = F.struct("ord", "from_id", "to_id", F.col("prov.producer").alias("producer"))
    slot = lambda c: F.min_by(F.when(c, said), F.when(c, F.col("ord")))
    g = rows.groupBy("_lo", "_hi", "type", "edge_key").agg(slot(up & sure).alias("us"), slot(up & ~sure).alias("ui"), slot(~up & sure).alias("ds"), slot(~up & ~sure).alias("di"))

    def pair(kind: str, a: str, b: str) -> Column:
        both = F.col(a).isNotNull() & F.col(b).isNotNull()
        swap = (F.col(f"{a}.ord") > F.col(f"{b}.ord")) if kind == "relation_direction" else F.lit(False)
        left, right = F.when(swap, F.col(b)).otherwise(F.col(a)), F.when(swap, F.col(a)).otherwise(F.col(b))
        return F.when(both, F.struct(F.greatest(f"{a}.ord", f"{b}.ord").alias("ord"), F.lit(kind).alias("kind"), left["from_id"].alias("left_from"), left["to_id"].alias("left_to"), right["from_id"].alias("right_from"), right["to_id"].alias("right_to")))

    same = F.least(pair("relation_direction", "us", "ds"), pair("relation_direction", "ui", "di"))
    other = F.least(pair("contradiction", "us", "di"), pair("contradiction", "ds", "ui"))
    out = g.select(F.col("_lo").alias("low"), F.col("_hi").alias("high"), "type", "edge_key", F.explode(F.array(same, other)).alias("c"))
    return out.filter("c is not null").select("c.kind", "low", "high", "type", "edge_key", "c.left_from", "c.left_to", "c.right_from", "c.right_to", "c.ord")


def cardinality_conflicts(relations: DataFrame, at_most_one_in: list[str], at_most_one_out: list[str]) -> DataFrame:
    """Each further distinct other end of a node that may have one edge of the type only."""
    return cardinality_of(relations.withColumns({"at_most_one_in": F.col("type").isin(*at_most_one_in), "at_most_one_out": F.col("type").isin(*at_most_one_out)}))


def cardinality_of(ruled: DataFrame) -> DataFrame:
    """The same for relations that carry their type's at_most_one_in and at_most_one_out.

    The first end of a node is found by aggregation and joined to the distinct others, so no window holds a hub.
    """
    sides = F.array(F.when(F.col("at_most_one_out"), F.struct(F.lit("out").alias("side"), F.col("from_id").alias("node"), F.col("to_id").alias("value"))), F.when(F.col("at_most_one_in"), F.struct(F.lit("in").alias("side"), F.col("to_id").alias("node"), F.col("from_id").alias("value"))))
    each = ruled.select("type", "ord", F.explode(F.array_compact(sides)).alias("s")).groupBy("s.node", "type", "s.side", "s.value").agg(F.min("ord").alias("ord"))
    keys = ["node", "type", "side"]
    first = each.groupBy(*keys).agg(F.min_by("value", F.struct("ord", "value")).alias("left_value"), F.count("*").alias("_n")).filter("_n > 1").drop("_n")
    out = each.join(first, keys).filter(F.col("value") != F.col("left_value"))
    return out.select(F.lit("cardinality").alias("kind"), *keys, "left_value", F.col("value").alias("right_value"), "ord")


def first_holders(entities: DataFrame) -> DataFrame:
    return entities.filter("name <> ''").groupBy(fold_key(F.col("type")).alias("_t"), fold_key(F.col("name")).alias("_n")).agg(F.min_by(F.struct("id", F.col("prov.producer").alias("producer"), "ord"), "ord").alias("held"))


def same_name_duplicates(entities: DataFrame) -> DataFrame:
    """``name_across_producers``: a later entity of the first holder's type and name from another producer."""
    rows = entities.filter("name <> ''").withColumn("_t", fold_key(F.col("type"))).withColumn("_n", fold_key(F.col("name"))).join(first_holders(entities), ["_t", "_n"])
    return rows.filter("id <> held.id and prov.producer <> held.producer").groupBy(F.col("held.id").alias("left_id"), F.col("id").alias("right_id")).agg(F.lit("name_across_producers").alias("signal"))


def alias_duplicates(entities: DataFrame) -> DataFrame:
    """``alias``: a declared alias equals the name of another entity of the same type."""
    a = entities.select("id", fold_key(F.col("type")).alias("_t"), F.explode("aliases").alias("_a")).withColumn("_n", fold_key(F.col("_a")))
    return a.join(first_holders(entities), ["_t", "_n"]).filter("id <> held.id").select(F.col("id").alias("left_id"), F.col("held.id").alias("right_id"), F.lit("alias").alias("signal")).distinct()


def affix_duplicates(entities: DataFrame) -> DataFrame:
    """``name_affix``: word beginnings or endings of an entity's name that are a first holder's whole name.

    Affixes are made once a name and joined by equality; names are never compared in pairs.
    """
    held = first_holders(entities)
    stems = held.select("_t", F.col("_n").alias("_whole"), F.explode(affixes(F.col("_n"))).alias("_n")).join(held, ["_t", "_n"]).select("_t", F.col("_whole").alias("_n"), "held")
    rows = entities.filter("name <> ''").select("id", fold_key(F.col("type")).alias("_t"), fold_key(F.col("name")).alias("_n"))
    return rows.join(stems, ["_t", "_n"]).filter("held.id <> id").select(F.col("held.id").alias("left_id"), F.col("id").alias("right_id"), F.lit("name_affix").alias("signal")).distinct()


def type_proposals(violations: DataFrame) -> DataFrame:
    """Undeclared types with the number of records that ask for them."""
    return violations.groupBy("kind", "type").agg(F.count("*").alias("records"), F.min("subject").alias("example"))


def counts(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """entities, relations, deterministic, inferred: one row."""
    e = entities.agg(F.count("*").alias("entities"))
    r = relations.agg(F.count("*").alias("relations"), F.count_if(deterministic()).alias("deterministic"))
    return e.crossJoin(r).withColumn("inferred", F.col("relations") - F.col("deterministic"))
