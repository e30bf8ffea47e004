"""Replies of extraction models to entities, relations, guesses and unread chunks.

Replies are rows (source, chunk, model, text): calling a model is the caller's business. A reply is read by its first
balanced JSON object that decodes; single quotes and trailing commas are mended, nothing else is. Text without such an object is an
``unread`` row, never an empty success. Aliases that a reply gives are kept.

A null text is unread. Entities without a type or name and relations without a type or end are left out. An untyped end stays
``:name`` (``operators.merge.resolve_ends`` resolves it).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tessera.functions.text import fold_key, framed

_ENTITY = "array<struct<type:string,name:string,attributes:map<string,string>,confidence:double,aliases:array<string>>>"
_RELATION = "array<struct<type:string,`from`:string,from_type:string,`to`:string,to_type:string,attributes:map<string,string>,confidence:double>>"
_GUESS = "array<struct<about:string,read_as:string,alternatives:array<string>,why:string>>"


@dataclass
class Extracted:
    entities: DataFrame
    relations: DataFrame
    guesses: DataFrame
    unread: DataFrame


_MARKS = re.compile(r'[{}"\\]')


def _objects(text: str) -> Iterator[str]:
    """Balanced brace spans in order of their beginning; braces inside double-quoted strings do not count."""
    ends: dict[int, int] = {}
    opened: list[int] = []
    quoted = False
    passed = -2
    for m in _MARKS.finditer(text):
        i, c = m.start(), m.group()
        if quoted:
            escaped = passed == i - 1  # behind a backslash that is not itself escaped
            if c == "\\" and not escaped:
                passed = i
            elif c == '"' and not escaped:
                quoted = False
        elif c == '"' and opened:
            quoted = True
        elif c == "{":
            opened.append(i)
        elif c == "}" and opened:
            ends[opened.pop()] = i + 1
    last = 0
    for begin in sorted(ends):
        if begin >= last:
            last = ends[begin]
            yield text[begin:last]


def decoded(text: str | None) -> str | None:
    """JSON text of the reply's object, or None."""
    import json

    for part in _objects(text or ""):
        commas = re.sub(r",(\s*[}\]])", r"\1", part)
        for attempt in (part, commas, commas.replace("'", '"')):
            try:
                return json.dumps(json.loads(attempt), ensure_ascii=False)
            except ValueError:
                continue
    return None


@F.pandas_udf(StringType())
def _decoded(text: pd.Series) -> pd.Series:
    return text.map(decoded)


def node_id(kind: Column, name: Column) -> Column:
    return F.concat(fold_key(kind), F.lit(":"), fold_key(name))


def _blank(c: str) -> Column:
    return F.trim(F.coalesce(c, F.lit(""))) == ""


def read_replies(replies: DataFrame) -> Extracted:
    """Records of all replies in the order of their chunks, whatever the order of the calls."""
    rows = replies.select("source", "chunk", "model", _decoded("text").alias("reply"))
    unread = rows.filter("reply is null").select("source", F.concat(F.lit("chunk "), "chunk").alias("locator"), F.lit("the reply holds no JSON object").alias("reason"))

    def each(field: str, kind: str) -> DataFrame:
        items = F.from_json(F.get_json_object("reply", f"$.{field}"), kind)
        return rows.filter("reply is not null").select("source", "chunk", "model", F.posexplode(items).alias("place", "r"))

    def prov(sure: Column) -> Column:
        return F.struct(F.col("source").alias("source"), F.col("chunk").alias("chunk"), F.lit("model").alias("producer"), F.col("model").alias("model"), sure.alias("confidence"))

    order = F.struct("source", "chunk", "place").alias("ord")
    e = each("entities", _ENTITY).filter(~_blank("r.type") & ~_blank("r.name"))
    cells = lambda: F.to_json(F.coalesce("r.attributes", F.create_map().cast("map<string,string>")))
    entities = e.select(node_id(F.col("r.type"), F.col("r.name")).alias("id"), F.trim("r.type").alias("type"), F.trim("r.name").alias("name"), cells().alias("attributes"), F.coalesce("r.aliases", F.array().cast("array<string>")).alias("aliases"), prov(F.col("r.confidence")).alias("prov"), order)

    def end(side: str) -> Column:
        # an end is a name, or an object of a name and a type
        inner = F.get_json_object(f"r.{side}", "$.name")
        name = F.when(inner.isNotNull(), inner).otherwise(F.col(f"r.{side}"))
        kind = F.coalesce(F.get_json_object(f"r.{side}", "$.type"), F.col(f"r.{side}_type"), F.lit(""))
        return F.when(F.trim(kind) == "", F.concat(F.lit(":"), fold_key(name))).otherwise(node_id(kind, name))

    r = each("relations", _RELATION).filter(~_blank("r.type") & ~_blank("r.from") & ~_blank("r.to"))
    relations = r.select(end("from").alias("from_id"), end("to").alias("to_id"), F.trim("r.type").alias("type"), F.lit("").alias("key"), cells().alias("attributes"), prov(F.col("r.confidence")).alias("prov"), order)
    g = each("guesses", _GUESS).filter(~_blank("r.about") & ~_blank("r.read_as") & (F.size(F.coalesce("r.alternatives", F.array().cast("array<string>"))) > 0))
    guesses = g.select(F.col("r.about").alias("field"), F.col("r.read_as").alias("chosen_as"), F.col("r.why").alias("reason"), F.col("r.alternatives").alias("alternatives"), prov(F.lit(None).cast("double")).alias("prov"))
    return Extracted(entities, relations, guesses, unread)


def answer_address(*parts: Column) -> Column:
    """Where an answer is cached: SHA-256 over the framed prompt, model, ontology, prompt version and question."""
    return F.sha2(F.concat(*[framed(F.coalesce(p.cast("string"), F.lit(""))) for p in parts]), 256)


def cached(chunks: DataFrame, answers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chunks (address) with the newest answer that is a JSON object, and chunks that must be asked."""
    valid = answers.filter(F.schema_of_variant(F.try_parse_json("text")).startswith("OBJECT"))
    newest = valid.groupBy("address").agg(F.max_by("text", "stored_at").alias("text"))
    return chunks.join(newest, "address"), chunks.join(newest.select("address"), "address", "left_anti")
