"""Statements of named people as entities and relations.

A statement is a row: subject_type, subject, predicate, object_type, object, by, at, note. Its records carry the producer ``human``
with the person and the date, so they count as stated; a statement that is not signed and dated is refused, and named.
A statement without a predicate asserts its subject only. Nulls count as empty texts. Repeated statements are repeated records.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import fold_key


def _blank(c: str) -> Column:
    return F.trim(F.coalesce(c, F.lit(""))) == ""


def defects(statements: DataFrame) -> DataFrame:
    """subject, defect of each statement that is refused: ``unsigned``, ``undated``, ``no_subject``, ``no_type`` or ``no_object``."""
    edge = ~_blank("predicate")
    checks = {"unsigned": _blank("by"), "undated": _blank("at"), "no_subject": _blank("subject"), "no_type": _blank("subject_type") | (edge & _blank("object_type")), "no_object": edge & _blank("object")}
    return statements.select("subject", F.explode(F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in checks.items()]))).alias("defect"))


def asserted(statements: DataFrame, source: str) -> tuple[DataFrame, DataFrame]:
    """(entities, relations) of the statements that stand."""
    fine = statements.filter(~_blank("by") & ~_blank("at") & ~_blank("subject") & ~_blank("subject_type") & (_blank("predicate") | (~_blank("object") & ~_blank("object_type"))))
    prov = F.struct(F.lit(source).alias("source"), F.lit(-1).alias("chunk"), F.lit("human").alias("producer"), F.trim("by").alias("by"), F.trim("at").alias("at"))
    name = lambda kind, value: F.concat(fold_key(F.col(kind)), F.lit(":"), fold_key(F.col(value)))
    cells = F.when(_blank("note"), F.lit("{}")).otherwise(F.to_json(F.struct(F.trim("note").alias("note"))))
    ends = F.array_compact(F.array(F.struct(F.col("subject_type").alias("type"), F.col("subject").alias("name")), F.when(~_blank("predicate"), F.struct(F.col("object_type").alias("type"), F.col("object").alias("name")))))
    nodes = fine.select(F.explode(ends).alias("e"), prov.alias("prov")).select(F.trim("e.type").alias("type"), F.trim("e.name").alias("name"), "prov")
    nodes = nodes.select(name("type", "name").alias("id"), "type", "name", F.lit("{}").alias("attributes"), "prov")
    edges = fine.filter(~_blank("predicate")).select(name("subject_type", "subject").alias("from_id"), F.trim("predicate").alias("type"), name("object_type", "object").alias("to_id"), F.lit("").alias("key"), cells.alias("attributes"), prov.alias("prov"))
    return nodes, edges
