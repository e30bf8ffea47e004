"""Files of mixed kinds to texts: what a file is, its text, and what could not be read and why.

Files are rows (source, content as binary), as Spark's ``binaryFile`` reader gives them. A file is known by its first bytes, then by its
name. Text must be UTF-8; a byte-order mark is dropped. Scanned pages and PDF need a reader that the caller gives; without
one they are ``unread``, never an empty success.

A null or empty content is an empty text file. A source that occurs twice is read twice.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.html import html_text

# Endings that decide between kinds of text.
MARKDOWN = ["md", "markdown", "mdown", "mkd"]
HTML = ["html", "htm", "xhtml"]
TABLES = ["csv", "tsv"]
SNIFF = 1024


@dataclass
class Texts:
    """texts: source, kind, text; unread: source, locator, reason."""

    texts: DataFrame
    unread: DataFrame


def files(spark: SparkSession, *paths: str) -> DataFrame:
    return spark.read.format("binaryFile").load(list(paths)).select(F.col("path").alias("source"), "content")


def kind_of(source: Column, content: Column) -> Column:
    """pdf, html, table, ddl, graph, markdown, text or binary."""
    head = F.substring(F.coalesce(content, F.lit(b"")), 1, SNIFF)
    shown = F.regexp_replace(F.lower(F.decode(head, "ISO-8859-1")), r"^(\xEF\xBB\xBF|\s)+", "")
    ending = F.lower(F.regexp_extract(source, r"\.([^./\\]+)$", 1))
    textual = ~F.contains(F.decode(head, "ISO-8859-1"), F.lit("\x00")) & _cut_utf8(head)
    return (
        F.when(shown.startswith("%pdf-"), "pdf").when(shown.startswith("<!doctype html") | shown.startswith("<html"), "html").when(~textual, "binary")
        .when(ending.isin(*MARKDOWN), "markdown").when(ending.isin(*HTML), "html").when(ending.isin(*TABLES), "table").when(ending == "sql", "ddl").when(ending == "json", "graph").otherwise("text"))


def _cut_utf8(head: Column) -> Column:
    """Whether bytes are UTF-8, up to three bytes of a sign that is cut off at their end."""
    n, out = F.octet_length(head), F.lit(False)
    for i in range(4):
        out = out | F.is_valid_utf8(F.substring(head, F.lit(1), F.greatest(n - i, F.lit(0))).cast("string"))
    return out


def read_texts(rows: DataFrame, pdf: Callable[[bytes], str] | None = None) -> Texts:
    """The text of every document among ``rows`` (source, content); tables, dumps and graphs are left to their own readers."""
    known = rows.withColumn("kind", kind_of(F.col("source"), F.col("content")))
    raw = F.coalesce("content", F.lit(b""))
    text = F.regexp_replace(raw.cast("string"), "^\\uFEFF", "")
    plain = known.filter(F.col("kind").isin("text", "markdown", "html"))
    whole = F.is_valid_utf8(raw.cast("string"))
    texts = plain.filter(whole & (F.col("kind") != "html")).select("source", "kind", text.alias("text"))
    pages = html_text(plain.filter(whole & (F.col("kind") == "html")).select("source", text.alias("html")), "source", "html")
    texts = texts.unionByName(pages.select(F.col("source").cast("string").alias("source"), F.lit("html").alias("kind"), "text"))
    lost = lambda r, why: r.select("source", F.lit("").alias("locator"), F.lit(why).alias("reason"))
    unread = lost(plain.filter(~whole), "the text is not UTF-8").unionByName(lost(known.filter("kind = 'binary'"), "neither text nor a known format"))
    papers = known.filter("kind = 'pdf'")
    if pdf is None:
        return Texts(texts, unread.unionByName(lost(papers, "no reader for PDF was given")))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[str | None] = []
            for content in batch.column(1).to_pylist():
                try:
                    out.append(pdf(content) or None)
                except ValueError:  # what a reader raises on a file that it cannot read
                    out.append(None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["source", "text"])

    opened = papers.select("source", "content").mapInArrow(read, "source string, text string")
    texts = texts.unionByName(opened.filter("text is not null").select("source", F.lit("pdf").alias("kind"), "text"))
    return Texts(texts, unread.unionByName(lost(opened.filter("text is null"), "the PDF reader found no text")))
