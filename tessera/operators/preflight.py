"""Integrity of a finished graph before it is stored: every defect is named, those that would lose data refuse the load.

A graph is a dict of DataFrames; only ``entities`` must be there. Further parts: ``relations``, ``conflicts`` (kind, subject,
left_reviewed_by, right_reviewed_by, ord), ``violations`` and ``duplicates``, ``chunks`` (idx), ``vectors`` (chunk, values, ord), ``rule_sets`` (name,
rule), ``counts`` (one row). Provenance fields that a graph's records lack count as empty.

Defects have kind, subject and severity (``refuse`` or ``report``), and each is reported once per subject. Every detector
is an aggregation or an anti join on its key. Nulls count as empty texts; an empty graph has no defects.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators import load, verify
from tessera.operators.check import disagreeing

Graph = dict[str, DataFrame]


class Refused(ValueError):
    """The graph has defects that would be written as data loss; all of them are named."""


def _defects(rows: DataFrame, kind: str, subject: Column, severity: str) -> DataFrame:
    return rows.select(F.lit(kind).alias("kind"), subject.cast("string").alias("subject"), F.lit(severity).alias("severity")).distinct()


def _prov(records: DataFrame, field: str) -> Column:
    return F.coalesce(F.col(f"prov.{field}").cast("string"), F.lit("")) if field in records.schema["prov"].dataType.names else F.lit("")


def held(conflicts: DataFrame) -> DataFrame:
    """Conflicts of which neither side is reviewed hold the graph: one defect, about the first of them."""
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    open_ = conflicts.filter(blank("left_reviewed_by") & blank("right_reviewed_by"))
    first = open_.agg(F.min_by("subject", "ord").alias("subject"), F.count("*").alias("n")).filter("n > 0")
    return _defects(first, "held", F.col("subject"), "refuse")


def derivable(graph: Graph) -> DataFrame:
    """The counts that follow from the parts themselves: one row."""
    out = verify.counts(graph["entities"], graph["relations"])
    for part in ("chunks", "vectors", "violations", "conflicts", "guesses", "duplicates"):
        if part in graph:
            out = out.crossJoin(graph[part].agg(F.count("*").alias(part)))
    return out


def counts_disagree(graph: Graph) -> DataFrame:
    """Fields of the claimed counts that the parts contradict."""
    return _defects(disagreeing(graph["counts"], derivable(graph)), "counts_disagree", F.col("field"), "report")


def unresolved_rules(records: list[DataFrame], rule_sets: DataFrame) -> DataFrame:
    """``rule_set_unresolved`` and ``rule_unresolved``: names in provenance that the graph's rule sets don't have."""
    out = None
    for field, column, kind in (("rule_set", "name", "rule_set_unresolved"), ("ruled_by", "rule", "rule_unresolved")):
        for r in records:
            named = r.select(_prov(r, field).alias("_name")).filter("_name <> ''").distinct()
            lost = _defects(named.join(rule_sets.select(F.col(column).alias("_name")).distinct(), "_name", "left_anti"), kind, F.col("_name"), "report")
            out = lost if out is None else out.unionByName(lost)
    return out.distinct()


def attribute_types(records: DataFrame) -> DataFrame:
    """Attributes that are no JSON object: no two stores would hold them alike. One defect for each kind of value found."""
    shape = F.schema_of_variant(F.try_parse_json("attributes"))
    kind = F.when(shape.isNull(), "unreadable").when(~shape.startswith("OBJECT"), F.lower(F.substring_index(F.substring_index(shape, "<", 1), "(", 1)))
    return _defects(records.filter("attributes is not null").select(kind.alias("_kind")).filter("_kind is not null"), "attribute_type", F.col("_kind"), "report")


def unsigned(records: DataFrame, subject: Column) -> DataFrame:
    """Records that a person asserted without their name or the date."""
    rows = records.filter((_prov(records, "producer") == "human") & ((_prov(records, "by") == "") | (_prov(records, "at") == "")))
    return _defects(rows, "assertion_unsigned", subject, "report")


def check(graph: Graph) -> DataFrame:
    """kind, subject, severity of all defects."""
    entities = graph["entities"]
    records = [r for r in (entities, graph.get("relations")) if r is not None]
    cited = [r for r in records if "prov" in r.columns]
    parts = [load.entity_defects(entities).select("kind", F.col("id").alias("subject"), "severity")]
    if "conflicts" in graph:
        parts.append(held(graph["conflicts"]))
    if "chunks" in graph:
        parts.append(_defects(load.chunk_defects(graph["chunks"]), "chunk_index_reused", F.col("idx"), "refuse"))
        parts += [_defects(load.citation_defects(r, graph["chunks"]), "provenance_without_chunk", F.col("idx"), "report") for r in cited]
    if "vectors" in graph:
        vectors = load.vector_defects(graph["vectors"], graph.get("chunks"))
        parts.append(vectors.select("kind", F.col("chunk").cast("string").alias("subject"), F.lit("refuse").alias("severity")).distinct())
    if "counts" in graph and len(records) == 2:
        parts.append(counts_disagree(graph))
    if "rule_sets" in graph:
        parts.append(unresolved_rules(cited, graph["rule_sets"]))
    parts += [attribute_types(r) for r in records if "attributes" in r.columns]
    edge = F.concat_ws(" ", "from_id", F.concat(F.lit("-["), "type", F.lit("]->")), "to_id")
    parts += [unsigned(r, F.col("id") if "id" in r.columns else edge) for r in cited]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


def refuse(graph: Graph, named: int = 20) -> None:
    """Raise Refused if any defect refuses: every kind with its number, and the first subjects of each."""
    rows = check(graph).filter("severity = 'refuse'").groupBy("kind").agg(F.count("*").alias("n"), F.min("subject").alias("first")).orderBy("kind").limit(named).collect()
    if rows:
        raise Refused("; ".join(f"{r['kind']}: {r['n']}, the first about {r['first']!r}" for r in rows))
