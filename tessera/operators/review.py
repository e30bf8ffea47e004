"""Application of review decisions to a graph: what to ask, what goes, what becomes one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.cut import cut
from tessera.operators.merge import merge_entities
from tessera.operators.verify import deterministic


class MergeCycle(ValueError):
    """Entities were to be merged into each other in a circle, or one into two."""


def low_confidence(entities: DataFrame, least: float, targeted: DataFrame | None = None) -> DataFrame:
    """Inferred records of confidence above 0 and below ``least`` that no other item (column subject) asks about."""
    rows = entities.filter(~deterministic() & (F.col("prov.confidence") > 0) & (F.col("prov.confidence") < least))
    if targeted is not None:
        rows = rows.join(targeted.select(F.col("subject").alias("id")).distinct(), "id", "left_anti")
    return rows.select(F.lit("low_confidence").alias("kind"), F.col("id").alias("subject"), F.col("prov.confidence").alias("confidence"))


def footprint(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """id, sources, degree: distinct sources of a node's records and edges, and ends of edges at it (a loop counts twice).

    Ends that no entity claims have a footprint too; an empty or null source does not count.
    """
    records = entities.select("id", F.col("prov.source").alias("source"), F.lit(0).alias("ends"))
    ends = relations.select(F.explode(F.array("from_id", "to_id")).alias("id"), F.col("prov.source").alias("source"), F.lit(1).alias("ends"))
    each = records.unionByName(ends).groupBy("id", "source").agg(F.sum("ends").alias("ends"))
    return each.groupBy("id").agg(F.count(F.when(F.col("source") != "", F.lit(1))).alias("sources"), F.sum("ends").alias("degree"))


def reject(entities: DataFrame, relations: DataFrame, removed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Graph without the entities of ``removed`` (id) and without the edges that touch them."""
    gone = removed.select("id").distinct()
    kept = relations
    for end in ("from_id", "to_id"):
        kept = kept.join(gone.withColumnRenamed("id", end), end, "left_anti")
    return entities.join(gone, "id", "left_anti"), kept.select(*relations.columns)


def survivors(merges: DataFrame) -> DataFrame:
    """(id, survivor) of ``merges`` (id, into), followed to the end; raises MergeCycle.

    Pointers double in length every round, so a chain of n merges takes about log2 n joins.
    """
    at = cut(merges.select("id", F.col("into").alias("survivor")).distinct())
    n = at.count()
    if at.select("id").distinct().count() != n or at.filter("id = survivor").limit(1).count():
        raise MergeCycle("an entity is merged into itself or into two others")
    # rows that have reached their end are left as they are
    done, moving = None, at
    for _ in range(n.bit_length() + 1):
        ahead = at.select(F.col("id").alias("survivor"), F.col("survivor").alias("next"))
        step = cut(moving.join(ahead, "survivor", "left").select("id", F.coalesce("next", "survivor").alias("survivor"), F.col("next").isNotNull().alias("moved")))
        ended = step.filter("not moved").select("id", "survivor")
        done = ended if done is None else done.unionByName(ended)
        moving = step.filter("moved").select("id", "survivor")
        if not moving.limit(1).count():
            return done
        at = done.unionByName(moving)
    raise MergeCycle("merges form a circle")


def merge_into(entities: DataFrame, relations: DataFrame, merges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Graph after ``merges`` (id, into): survivors keep their values, absorbed records fill gaps, first wins.

    Edges follow the survivor; loops that a merge makes go, others stay; of edges with equal ends, type
    and key the first stays. All records of a survivor and those it absorbs become one record.
    """
    final = survivors(merges)
    touched = final.unionByName(final.select(F.col("survivor").alias("id"), "survivor").distinct())
    rows = entities.join(touched, "id", "left")
    columns = ["id", "type", "name", "attributes", "prov", "ord"]
    grouped = rows.filter("survivor is not null").select(F.col("survivor").alias("id"), "type", "name", "attributes", "prov", F.struct((F.col("id") != F.col("survivor")).alias("absorbed"), "ord").alias("ord"))
    one = merge_entities(grouped)[0].withColumn("ord", F.col("ord.ord"))
    nodes = rows.filter("survivor is null").select(*columns).unionByName(one)
    edges = relations.withColumn("_loop", F.col("from_id") == F.col("to_id"))
    for end in ("from_id", "to_id"):
        edges = edges.join(final.select(F.col("id").alias(end), "survivor"), end, "left").withColumn(end, F.coalesce("survivor", end)).drop("survivor")
    edges = edges.filter("from_id <> to_id or _loop")
    keys = ["from_id", "type", "to_id", "key"]
    rest = [c for c in relations.columns if c not in keys]
    first = F.min_by(F.struct(*rest), "ord").alias("_rest")
    return nodes, edges.groupBy(*keys).agg(first).select(*keys, "_rest.*").select(*relations.columns)


def surviving_chunks(chunks: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """``chunks`` (source, idx) without those that had records (prov) before review and have none after."""
    def cited(records: DataFrame) -> DataFrame:
        return records.select(F.col("prov.source").alias("source"), F.col("prov.chunk").alias("idx")).distinct()

    emptied = cited(before).join(cited(after), ["source", "idx"], "left_anti")
    return chunks.join(emptied, ["source", "idx"], "left_anti").select(*chunks.columns)
