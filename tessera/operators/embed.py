"""Embedding of chunks by a model that the caller gives, and chunks cut where the subject changes.

A model is a function from texts to vectors, called inside tasks with at most ``BATCH`` texts at a time; it must give one
vector for each text. A batch that fails is reported chunk by chunk as unread, and no vector of it is kept.
Blank texts are not worth a call.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import cosine

Model = Callable[[list[str]], list[list[float]]]
BATCH = 32
#: How far below the mean the likeness of neighbours must fall to be a boundary, in standard deviations.
SPREAD = 0.5


def worth(chunks: DataFrame) -> DataFrame:
    return chunks.filter(F.trim(F.coalesce("text", F.lit(""))) != "")


def called(rows: DataFrame, model: Model, keys: list[str], batch: int = BATCH) -> DataFrame:
    """``keys``, values, failed of each row with a text, in calls of at most ``batch`` texts."""
    schema = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys) + ", values array<float>, failed string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for got in batches:
            values: list[list[float] | None] = []
            failed: list[str | None] = []
            texts = got.column(len(keys)).to_pylist()
            for i in range(0, len(texts), batch):
                some = texts[i : i + batch]
                try:
                    vectors, why = model(some), None
                    if len(vectors) != len(some):
                        why = f"{len(vectors)} vectors for {len(some)} texts"
                except Exception as e:  # noqa: BLE001  whatever a model's client raises is a failed call
                    why = str(e) or type(e).__name__
                values += [None] * len(some) if why else [list(map(float, v)) for v in vectors]
                failed += [why] * len(some)
            yield pa.RecordBatch.from_arrays([*(got.column(k) for k in range(len(keys))), pa.array(values, pa.list_(pa.float32())), pa.array(failed, pa.string())], names=[*keys, "values", "failed"])

    return rows.select(*keys, "text").mapInArrow(run, schema)


def embedded(chunks: DataFrame, model: Model, name: str, batch: int = BATCH) -> tuple[DataFrame, DataFrame]:
    """(vectors: chunk, values, model; unread: source, locator, reason) of ``chunks`` (source, idx, text)."""
    rows = called(worth(chunks), model, ["source", "idx"], batch)
    vectors = rows.filter("failed is null").select(F.col("idx").alias("chunk"), "values", F.lit(name).alias("model"))
    return vectors, rows.filter("failed is not null").select("source", F.concat(F.lit("chunk "), "idx").alias("locator"), F.col("failed").alias("reason"))


def subjects(units: DataFrame, spread: float = SPREAD) -> DataFrame:
    """source, unit, subject: units (source, unit, values) of one text numbered by the subject that they belong to.

    A boundary is where a unit is less like the one before it than the mean of its text less ``spread`` standard
    deviations; texts of equal likeness throughout have one subject. A text's units are one window, so they meet in one
    task; they are as many as its paragraphs.
    """
    text = Window.partitionBy("source").orderBy("unit")
    like = F.when(F.col("_before").isNotNull(), F.when(F.size("values") == F.size("_before"), F.coalesce(cosine("values", "_before"), F.lit(0.0))).otherwise(0.0))
    rows = units.withColumn("_before", F.lag("values").over(text)).withColumn("_like", F.nanvl(like, F.lit(0.0)))
    every = Window.partitionBy("source")
    low = F.avg("_like").over(every) - F.lit(spread) * F.stddev_pop("_like").over(every)
    rows = rows.withColumn("_cut", F.coalesce((F.col("_like") < low - 1e-12).cast("int"), F.lit(0)))
    return rows.withColumn("subject", F.sum("_cut").over(text)).select("source", "unit", "subject")


def semantic_units(texts: DataFrame, source: str = "source", text: str = "text") -> DataFrame:
    """source, unit, text, start, end of each text's paragraphs, or of its sentences where it has one paragraph."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tessera.sources.chunking import paragraphs, sentences

        for batch in batches:
            out: tuple[list, list, list, list, list] = ([], [], [], [], [])
            for name, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                spans = paragraphs(t, (0, len(t)))
                if len(spans) < 2:
                    spans = sentences(t, (0, len(t))) or spans
                for i, (a, b) in enumerate(spans):
                    for column, value in zip(out, (name, i, t[a:b], a, b), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, (pa.string(), pa.int32(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=["source", "unit", "text", "start", "end"])

    return texts.select(F.col(source).cast("string"), F.coalesce(F.col(text).cast("string"), F.lit(""))).mapInArrow(run, "source string, unit int, text string, start long, end long")


def semantic_chunks(texts: DataFrame, model: Model, source: str = "source", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(chunks: source, idx, text, strategy, start, end in characters; unread) of whole subjects; a subject above a size is the packer's business."""
    units = semantic_units(texts, source, text)
    made = called(units, model, ["source", "unit"])
    placed = units.join(subjects(made.filter("failed is null")), ["source", "unit"])
    spans = placed.groupBy("source", "subject").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    whole = texts.select(F.col(source).cast("string").alias("source"), F.col(text).cast("string").alias("_text"))
    out = spans.join(whole, "source").select("source", F.col("subject").cast("int").alias("idx"), F.expr("substring(_text, cast(start as int) + 1, cast(end - start as int))").alias("text"), F.lit("semantic").alias("strategy"), "start", "end")
    return out, made.filter("failed is not null").groupBy("source").agg(F.lit("").alias("locator"), F.min("failed").alias("reason"))
