"""One job over a folder of mixed files: each file goes to the reader of its kind, and all they say becomes one graph.

Files are told apart by their first bytes and names. Tables with the same header are one table, read and split by Spark's CSV reader under one inferred or given mapping, so there is one pass per kind
of table and not per file; dumps, graph documents and texts are rows of their readers. Texts are cut into chunks that are numbered through the job; a model, if one is
given, is asked about them. What no reader takes is ``unread``, with its reason. Every record says which file it comes from and has an ``ord`` that is total through the job.

A file that can't be read is named and leaves the others alone. Empty folders give empty parts.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import check, extract, load
from tessera.operators.cut import cut
from tessera.sources import chunking, ddl, delimited, documents, graph_json, infer, tabular

#: Bytes of a table file in which its header is looked for.
HEAD = 64 * 1024
_PROV = "struct<source:string,chunk:int,producer:string,model:string,confidence:double>"
_ORD = "struct<kind:int,file:string,block:bigint,at:bigint>"
_ENTITY = {"id": "string", "type": "string", "name": "string", "attributes": "string", "aliases": "array<string>", "prov": _PROV, "ord": _ORD}
_RELATION = {"from_id": "string", "type": "string", "to_id": "string", "key": "string", "attributes": "string", "prov": _PROV, "ord": _ORD}
_CHUNK = {"source": "string", "idx": "int", "text": "string", "strategy": "string", "heading": "string", "start_byte": "bigint", "end_byte": "bigint"}
_VIOLATION = {"kind": "string", "subject": "string", "detail": "string", "source": "string"}
_UNREAD = {"source": "string", "locator": "string", "reason": "string"}
_GUESS = {"source": "string", "about": "string", "read_as": "string", "alternatives": "array<string>", "why": "string"}
_PARTS = {"entities": _ENTITY, "relations": _RELATION, "chunks": _CHUNK, "violations": _VIOLATION, "unread": _UNREAD, "guesses": _GUESS}


@dataclass
class Read:
    """What the files say: entities, relations, chunks, violations, unread, guesses; ``files`` has source and kind of each."""

    files: DataFrame
    parts: dict[str, DataFrame]


def _shaped(df: DataFrame, shape: dict[str, str]) -> DataFrame:
    """``df`` with exactly these columns; absent ones are null, also in provenance."""
    fields = re.findall(r"(\w+):(\w+)", _PROV.removeprefix("struct<"))

    def column(name: str, kind: str) -> Column:
        if name not in df.columns:
            return F.lit(None).cast(kind).alias(name)
        if name == "prov":
            have = df.schema["prov"].dataType.names
            return F.struct(*[(F.col(f"prov.{f}") if f in have else F.lit(None)).cast(k).alias(f) for f, k in fields]).alias(name)
        return F.col(name).cast(kind).alias(name)

    return df.select(*[column(n, k) for n, k in shape.items()])


def _ord(kind: int, file: Column, block: Column, at: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), file.cast("string").alias("file"), block.cast("long").alias("block"), at.cast("long").alias("at"))


class _Parts:
    def __init__(self, spark: SparkSession) -> None:
        self.found: dict[str, DataFrame] = {k: spark.createDataFrame([], ", ".join(f"{n} {t}" for n, t in shape.items())) for k, shape in _PARTS.items()}

    def add(self, part: str, df: DataFrame) -> None:
        self.found[part] = self.found[part].unionByName(_shaped(df, _PARTS[part]))


def _tables(spark: SparkSession, parts: _Parts, files: DataFrame, mappings: dict[str, tabular.Mapping], targets: list[str]) -> None:
    """Files of one header are one table. The driver gets the headers, one row each with the files that have it."""
    first = F.split(F.regexp_replace(F.substring("content", 1, HEAD).cast("string"), "^\\uFEFF", ""), "\r\n|\n|\r")[0]
    groups = files.select("source", first.alias("header")).groupBy("header").agg(F.sort_array(F.collect_list("source")).alias("sources")).orderBy("header").collect()
    for g in groups:
        sources = g["sources"]
        folder = sources[0].rstrip("/").split("/")
        stem = re.sub(r"\.\w+$", "", folder[-1])
        name = folder[-2] if stem.startswith("part-") and len(folder) > 1 else stem
        try:
            read = delimited.scan(spark, sources)
            rows = cut(read.rows)
            mapping, guesses = (mappings[name], []) if name in mappings else infer.infer(name, infer.profile(rows.drop("ord")), targets)
            checked = tabular.checked_rows(rows, mapping, ["ord"])
        except ValueError as e:  # what the readers raise about a header, a delimiter or a mapping
            parts.add("unread", spark.createDataFrame([(s, "", str(e)) for s in sources], "source string, locator string, reason string"))
            continue
        file = F.col("ord.file")
        keyed = checked.rows.select(tabular.entity_id(mapping.entity_type, F.col(mapping.id_column)).alias("_own"), "ord")
        at = keyed.select("_own", _ord(1, F.col("ord.file"), F.col("ord.block"), F.col("ord.at")).alias("ord"))
        own = tabular.entities(checked.rows, mapping, file)
        parts.add("entities", own.join(at, own["id"] == at["_own"]).drop("_own"))
        if mapping.relations:
            edges = tabular.relations(checked.rows, mapping, file)
            parts.add("relations", edges.join(at, edges["from_id"] == at["_own"]).drop("_own"))
            stubs = tabular.referenced(edges, own, sources[0])
            parts.add("entities", stubs.withColumn("ord", _ord(9, F.lit(sources[0]), F.lit(0), F.xxhash64("id"))))
        about = F.lit(sources[0]).alias("source")
        parts.add("violations", read.violations.select("kind", "subject", "detail", about))
        parts.add("violations", checked.violations.select("kind", "subject", about))
        if guesses:
            parts.add("guesses", spark.createDataFrame([(sources[0], x.column, x.read_as, list(x.alternatives), x.why) for x in guesses], "source string, about string, read_as string, alternatives array<string>, why string"))


def read_folder(spark: SparkSession, *paths: str, mappings: dict[str, tabular.Mapping] | None = None, targets: list[str] = (), model: extract.Model | None = None, told: str = "", options: chunking.Options | None = None, pdf: Callable[[bytes], str] | None = None) -> Read:
    """Everything the files under ``paths`` say. ``mappings`` are by table name (the file's, or its folder's for part files)."""
    rows = documents.files(spark, *paths)
    kinds = cut(rows.select("source", documents.kind_of(F.col("source"), F.col("content")).alias("kind")))
    parts = _Parts(spark)
    of = lambda kind: rows.join(kinds.filter(F.col("kind") == kind).select("source"), "source", "left_semi")
    there = {r["kind"] for r in kinds.select("kind").distinct().collect()}
    text = F.regexp_replace(F.coalesce("content", F.lit(b"")).cast("string"), "^\\uFEFF", "").alias("text")
    if "table" in there:
        _tables(spark, parts, of("table"), mappings or {}, list(targets))
    if "ddl" in there:
        schema = ddl.import_ddl(of("ddl").select("source", text.alias("ddl")))
        order = _ord(2, F.col("ord.source"), F.lit(0), F.col("ord.ord")).alias("ord")
        parts.add("entities", schema.entities.withColumn("ord", order))
        parts.add("relations", schema.relations.withColumn("ord", order))
        parts.add("unread", schema.findings.filter("kind = 'unreadable'").select("source", F.lit("").alias("locator"), F.col("detail").alias("reason")))
        parts.add("violations", schema.findings.filter("kind <> 'unreadable'"))
    if "graph" in there:
        graph = graph_json.read_graphs(of("graph").select("source", text))
        order = _ord(3, F.col("prov.source"), F.lit(0), F.col("ord")).alias("ord")
        parts.add("entities", graph.entities.withColumn("ord", order))
        parts.add("relations", graph.relations.withColumn("ord", order))
        parts.add("violations", graph.defects.select("kind", F.col("place").alias("subject"), "detail", "source"))
        summaries = graph.chunks
    else:
        summaries = None
    texts = documents.read_texts(rows.join(kinds.filter(F.col("kind").isin("text", "markdown", "html", "pdf", "binary")).select("source"), "source", "left_semi"), pdf)
    parts.add("unread", texts.unread)
    pieces = chunking.chunks(texts.texts, options or chunking.Options())
    pieces = pieces if summaries is None else pieces.unionByName(_shaped(summaries, _CHUNK))
    pieces = cut(extract.renumbered(pieces))
    parts.add("chunks", pieces)
    if model is not None:
        run = extract.run(pieces.filter("strategy <> 'graph-node-summary'"), model, "model", told)
        order = _ord(4, F.col("prov.source"), F.col("prov.chunk"), F.xxhash64("id")).alias("ord")
        parts.add("entities", run.graph["entities"].withColumn("ord", order))
        parts.add("relations", run.graph["relations"].withColumn("ord", _ord(4, F.col("prov.source"), F.col("prov.chunk"), F.xxhash64("from_id", "type", "to_id"))))
        parts.add("unread", run.unread)
    return Read(kinds, parts.found)


def import_folder(spark: SparkSession, store: load.Store, load_id: str, *paths: str, vocabulary: check.Vocabulary | None = None, replace: bool = False, **how) -> tuple[load.Loaded, Read]:
    """Read a folder, check what it says and store it as one load, with what could not be read."""
    read = read_folder(spark, *paths, **how)
    report = check.check(cut(read.parts["entities"]), cut(read.parts["relations"]), vocabulary)
    found = report.violations.select("kind", F.coalesce("id", F.concat_ws(" ", "from_id", "type", "to_id")).alias("subject"), F.col("attr").alias("detail"), "source")
    graph = {"entities": report.entities, "relations": report.relations, "chunks": read.parts["chunks"], "violations": read.parts["violations"].unionByName(found), "unread": read.parts["unread"], "guesses": read.parts["guesses"]}
    return store.load(load_id, graph, replace), read
