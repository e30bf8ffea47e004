"""Training-corpus pipeline over ``documents``: each stage works on all that its predecessor kept.

Toxic documents go, one of each group of equal texts stays, one of each group of near-duplicates stays
(shingles of five words, similarity of 0.8 or more), personal data is replaced in the texts, and what
is left is packed. Every stage but the last returns the columns of its input.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import Scratch, ensure_importable, read
from tessera.llm.exact_dedup import exact_dedup
from tessera.llm.near_dedup import near_dedup
from tessera.llm.packing import pack_documents
from tessera.llm.pii import redact_pii
from tessera.llm.queries import BYTE_BPE
from tessera.llm.toxicity import drop_toxic

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ensure_importable(spark)
    return drop_toxic(docs, read(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ensure_importable(spark)
    return exact_dedup(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ensure_importable(spark)
    return near_dedup(docs, width=5, percent=80)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ensure_importable(spark)
    out = redact_pii(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ensure_importable(spark)
    return pack_documents(docs, BYTE_BPE)


STAGES: list[tuple[str, Stage]] = [("toxicity", toxicity), ("exact_dedup", exact), ("near_dedup", near), ("pii", pii), ("packing", packing)]

#: Stages learn, decode and tokenise: SQL cannot express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; each one's rows are written as Parquet and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
