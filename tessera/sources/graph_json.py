"""Graph documents in JSON: nodes to entities and chunks, edges to relations, defects and dangling ends.

A document is one row (source, text), so many files are read in parallel and each is parsed on its executor by
built-in functions; only malformed texts, which end the import, meet Python, for the place of the mistake.

Nulls: a field of value null counts as absent, a null text as malformed. Repeated equal nodes are one
entity; nodes that share an id and differ are a ``duplicate_node`` defect. Nested values keep
their own JSON text, so two of them are equal only if they are written alike.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The spellings of each field that graph documents use.
NODES, EDGES = ["nodes", "entities"], ["edges", "relations", "links"]
NODE_NAME, NODE_SUMMARY = ["name", "label"], ["summary", "description"]
NODE_ALIASES = ["aliases", "alt_labels", "also_known_as"]
EDGE_FROM, EDGE_TO = ["source", "from", "subject"], ["target", "to", "object"]
EDGE_TYPE = ["type", "relation", "predicate", "label"]
FORWARD = "forward"

_PRODUCER = "graph-import"


@dataclass
class GraphRead:
    entities: DataFrame
    relations: DataFrame
    chunks: DataFrame
    guesses: DataFrame
    #: kind, source, place, detail: any row here means that the document is refused
    defects: DataFrame
    #: relations whose ends no node of the document claims; they stay in ``relations`` too
    dangling: DataFrame


def _values(fields: str, spellings: list[str]) -> Column:
    """Distinct values under the given spellings that are there and not empty."""
    found = F.array(*[F.trim(F.col(fields)[s]) for s in spellings])
    return F.array_distinct(F.filter(found, lambda x: x.isNotNull() & (x != "")))


def _pick(fields: str, spellings: list[str]) -> Column:
    return F.coalesce(F.get(_values(fields, spellings), F.lit(0)), F.lit(""))


def _rest(fields: str, used: list[str]) -> Column:
    """Canonical JSON of the fields that nothing else took, sorted by name; null values are left out."""
    left = F.array_sort(F.map_entries(F.map_filter(fields, lambda k, v: ~k.isin(*used) & v.isNotNull())))
    return F.to_json(F.map_from_entries(left))


def _items(docs: DataFrame, spellings: list[str]) -> DataFrame:
    lists = F.array_distinct(F.filter(F.array(*[F.get_json_object("text", f"$.{s}") for s in spellings]), lambda x: x.isNotNull()))
    rows = docs.select("source", F.posexplode(F.from_json(F.get(lists, F.lit(0)), "array<string>")).alias("place", "item"))
    return rows.select("source", "place", F.from_json("item", "map<string,string>").alias("f"))


def _defect(rows: DataFrame, kind: str, where: str, detail: Column) -> DataFrame:
    return rows.select(F.lit(kind).alias("kind"), "source", F.concat(F.lit(f"{where}["), "place", F.lit("]")).alias("place"), detail.alias("detail"))


def _ambiguous(rows: DataFrame, where: str, slots: dict[str, list[str]]) -> DataFrame:
    checks = [F.struct(F.lit(slot).alias("slot"), _values("f", s).alias("found")) for slot, s in slots.items()]
    rows = rows.select("source", "place", F.explode(F.array(*checks)).alias("c")).filter(F.size("c.found") > 1)
    return _defect(rows, "ambiguous_field", where, F.concat(F.col("c.slot"), F.lit(": "), F.array_join("c.found", " / ")))


def _malformed(docs: DataFrame) -> DataFrame:
    def locate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import json

        for batch in batches:
            out = []
            for source, text in zip(batch["source"], batch["text"], strict=True):
                try:
                    json.loads(text or "")
                    said = ("$", "the document is not an object")
                except json.JSONDecodeError as e:
                    said = (f"line {e.lineno}, column {e.colno}", e.msg)
                out.append(("malformed_json", source, *said))
            yield pd.DataFrame(out, columns=["kind", "source", "place", "detail"])

    broken = F.col("text").isNull() | F.try_parse_json("text").isNull() | (F.schema_of_variant(F.try_parse_json("text")).startswith("OBJECT") == F.lit(False))
    return docs.filter(broken).select("source", "text").mapInPandas(locate, "kind string, source string, place string, detail string")


def read_graphs(docs: DataFrame, source: str = "source", text: str = "text") -> GraphRead:
    """Everything the documents say; ``defects`` is empty for those that may be imported."""
    docs = docs.select(docs[source].cast("string").alias("source"), docs[text].cast("string").alias("text"))
    nodes, edges = _items(docs, NODES), _items(docs, EDGES)
    prov = F.struct(F.col("source").alias("source"), F.lit(-1).alias("chunk"), F.lit(_PRODUCER).alias("producer"))

    aliases = F.flatten(F.array(*[F.coalesce(F.from_json(F.col("f")[s], "array<string>"), F.array().cast("array<string>")) for s in NODE_ALIASES]))
    used = ["id", "type", *NODE_NAME, *NODE_SUMMARY, *NODE_ALIASES]
    named = nodes.select("source", "place", "f", _pick("f", ["id"]).alias("own"), _pick("f", NODE_NAME).alias("name"), _pick("f", ["type"]).alias("type"))
    named = named.withColumn("id", F.when(F.col("own") != "", F.col("own")).otherwise(F.col("name")))
    full = named.withColumn("attributes", _rest("f", used)).withColumn("aliases", aliases).withColumn("summary", _pick("f", NODE_SUMMARY)).filter("id <> ''")
    first = full.withColumn("_at", F.row_number().over(Window.partitionBy("source", "id").orderBy("place"))).filter("_at = 1")
    entities = first.select("id", "type", "name", "attributes", "aliases", prov.alias("prov"), F.col("place").cast("long").alias("ord"))
    chunks = first.filter("summary <> ''").select(F.col("place").alias("idx"), F.col("summary").alias("text"), "source", F.lit("graph-node-summary").alias("strategy"), F.lit("").alias("heading"), F.lit(-1).alias("start_byte"), F.lit(-1).alias("end_byte"))
    guesses = named.filter("own = '' and name <> ''").select(F.lit("id").alias("field"), F.col("name").alias("chosen_as"), F.lit("the node has a name but no id").alias("reason"), prov.alias("prov"))

    parts = {"from": EDGE_FROM, "to": EDGE_TO, "type": EDGE_TYPE}
    ends = edges.select("source", "place", "f", *[_pick("f", s).alias(f"_{n}") for n, s in parts.items()], _pick("f", ["id"]).alias("key"), _pick("f", ["direction"]).alias("direction"))
    relations = ends.filter("_from <> '' and _to <> '' and _type <> ''").select(F.col("_from").alias("from_id"), F.col("_to").alias("to_id"), F.col("_type").alias("type"), "key", _rest("f", ["id", "direction", *EDGE_FROM, *EDGE_TO, *EDGE_TYPE]).alias("attributes"), prov.alias("prov"), F.col("place").cast("long").alias("ord"))

    twice = full.groupBy("source", "id").agg(F.min("place").alias("place"), F.count_distinct(F.to_json(F.map_from_entries(F.array_sort(F.map_entries("f"))))).alias("n")).filter("n > 1")
    lists = [_two_lists(docs, s) for s in (NODES, EDGES)]
    neither = docs.filter(F.coalesce(*[F.get_json_object("text", f"$.{s}") for s in NODES + EDGES]).isNull() & F.try_parse_json("text").isNotNull())
    defects = [
        _malformed(docs),
        *lists,
        neither.select(F.lit("no_graph").alias("kind"), "source", F.lit("$").alias("place"), F.lit("neither nodes nor edges are there").alias("detail")),
        _ambiguous(nodes, "nodes", {"name": NODE_NAME, "summary": NODE_SUMMARY}),
        _ambiguous(edges, "edges", parts),
        _defect(named.filter("id = ''"), "missing_field", "nodes", F.lit("id")),
        _defect(twice, "duplicate_node", "nodes", F.col("id")),
        *[_defect(ends.filter(f"_{n} = ''"), "missing_field", "edges", F.lit(n)) for n in parts],
        _defect(ends.filter((F.col("direction") != "") & (F.col("direction") != FORWARD)), "unknown_direction", "edges", F.col("direction")),
    ]
    found = defects[0]
    for d in defects[1:]:
        found = found.unionByName(d)

    known = entities.select(F.col("prov.source").alias("source"), F.col("id").alias("end")).distinct()
    each = relations.select(F.col("prov.source").alias("source"), "ord", "from_id", "type", "to_id", F.explode(F.array_distinct(F.array("from_id", "to_id"))).alias("end"))
    dangling = each.join(known, ["source", "end"], "left_anti").groupBy("source", "ord", "from_id", "type", "to_id").agg(F.array_sort(F.collect_list("end")).alias("missing"))
    return GraphRead(entities, relations, chunks, guesses, found, dangling)


def _two_lists(docs: DataFrame, spellings: list[str]) -> DataFrame:
    """Documents that hold different lists under two spellings; equal lists agree."""
    held = F.array_distinct(F.filter(F.array(*[F.get_json_object("text", f"$.{s}") for s in spellings]), lambda x: x.isNotNull()))
    return docs.filter(F.size(held) > 1).select(F.lit("ambiguous_field").alias("kind"), "source", F.lit("$").alias("place"), F.lit(" / ".join(spellings)).alias("detail"))
