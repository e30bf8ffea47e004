"""From texts to a stored graph: models are asked about chunks, their replies read, merged, checked and stored.

A model is a function from prompts to replies that the caller gives; tasks call it, so Spark bounds how many calls run at once
by the partitions. Nothing depends on the order in which replies come. What could not be read is counted and named, never
dropped. Standing answers (the cache) are looked up by address before any call.

Nulls count as empty texts; a chunk without words is ``empty`` and not asked about. Repeated chunks are asked about once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators import check, merge
from tessera.operators.budget import ask_within
from tessera.operators.cut import cut
from tessera.operators.embed import worth
from tessera.operators.numbering import numbered
from tessera.sources.replies import answer_address, cached, read_replies

Model = Callable[[list[str]], list[str]]
#: Version of the prompt; part of an answer's address, so a new wording asks anew.
PROMPT = "1"


def renumbered(chunks: DataFrame) -> DataFrame:
    """Chunks of all sources with ``idx`` from 0 through the whole job, by source and place; ``place`` keeps the old number."""
    return numbered(chunks.withColumnRenamed("idx", "place"), ["source", "place"], "idx").withColumn("idx", F.col("idx").cast("int"))


def prompts(chunks: DataFrame, told: str) -> DataFrame:
    """Chunks with ``prompt``: what the model is told, then the text between marks that the text itself cannot end."""
    mark = F.concat(F.lit("===="), F.substring(F.sha2(F.col("text"), 256), 1, 12))
    return chunks.withColumn("prompt", F.concat(F.lit(f"{told}\nReply with one JSON object. The text stands between two lines "), mark, F.lit(".\n"), mark, F.lit("\n"), "text", F.lit("\n"), mark))


def asked(rows: DataFrame, model: Model, name: str) -> DataFrame:
    """address, model, text (the reply; null where the call failed) and failed of ``rows`` (address, prompt)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            replies: list[str | None] = []
            failed: list[str | None] = []
            for prompt in batch.column(1).to_pylist():
                try:
                    replies.append(model([prompt])[0])
                    failed.append(None)
                except Exception as e:  # noqa: BLE001  whatever a model's client raises is a failed call
                    replies.append(None)
                    failed.append(str(e) or type(e).__name__)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([name] * len(batch)), pa.array(replies, pa.string()), pa.array(failed, pa.string())], names=["address", "model", "text", "failed"])

    return rows.select("address", "prompt").mapInArrow(run, "address string, model string, text string, failed string")


def within_budget(rows: DataFrame, calls: int | None, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows that may be asked about, the others): the first ``calls`` in order; the limit is the budget's purpose."""
    if calls is None:
        return rows, rows.limit(0)
    first = rows.orderBy(*order).limit(calls)
    return first, rows.join(first.select(*order), order, "left_anti")


def kept_answers(answers: DataFrame, now: Column, ttl_seconds: int, most: int) -> DataFrame:
    """Standing answers (address, text, stored_at, used_at) that stay: younger than the limit, and of those the last used ones."""
    young = answers.filter(F.col("stored_at") + F.make_interval(secs=F.lit(ttl_seconds)) > now)
    return young.orderBy(F.desc("used_at"), "address").limit(most)


@dataclass
class Run:
    """What a job made of its texts; ``answers`` are the new ones to keep."""

    graph: dict[str, DataFrame]
    report: check.Report
    unread: DataFrame
    answers: DataFrame
    accounts: DataFrame


def run(chunks: DataFrame, model: Model, name: str, told: str, *, vocabulary: check.Vocabulary | None = None, standing: DataFrame | None = None, calls: int | None = None, budget: int | None = None) -> Run:
    """Ask, read, merge and check ``chunks`` (source, idx, text), within a number of calls or a budget of tokens (``budget.ask_within``)."""
    rows = worth(chunks).withColumn("address", answer_address(F.lit(told), F.lit(name), F.lit(vocabulary.ontology if vocabulary else ""), F.lit(PROMPT), F.col("text")))
    spark = chunks.sparkSession
    old = standing if standing is not None else spark.createDataFrame([], "address string, text string, stored_at timestamp")
    known, open_ = cached(rows.select("address").distinct(), old)
    open_, over = within_budget(open_, calls, ["address"])
    texts = rows.groupBy("address").agg(F.first("text").alias("text"))
    wanted = prompts(open_.join(texts, "address"), told)
    if budget is None:
        fresh = cut(asked(wanted, model, name))  # calls are made once, however often their replies are read
    else:
        spent = ask_within(wanted, lambda rows: asked(rows, model, name), budget)
        fresh = spent.answers.withColumn("failed", F.lit(None).cast("string"))
        over = spent.left.join(open_.select("address"), "address", "left_semi").unionByName(over.select("address", F.lit("the budget is spent").alias("reason")))
    replies = known.select("address", F.lit(name).alias("model"), "text").unionByName(fresh.filter("failed is null").select("address", "model", "text"))
    read = read_replies(rows.select("source", F.col("idx").alias("chunk"), "address").join(replies, "address").select("source", "chunk", "model", "text"))
    lost = fresh.filter("failed is not null").select("address", F.col("failed").alias("reason")).unionByName(over if "reason" in over.columns else over.select("address", F.lit("the budget is spent").alias("reason")))
    unread = read.unread.unionByName(rows.join(lost, "address").select("source", F.concat(F.lit("chunk "), "idx").alias("locator"), "reason"))
    entities, clashes = merge.merge_entities(read.entities)
    entities = cut(entities.join(read.entities.groupBy("id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("aliases")))).alias("aliases")), "id"))
    relations = cut(merge.merge_relations(merge.resolve_ends(read.relations, read.entities)))
    report = check.check(entities, relations, vocabulary)
    cited = read.entities.select("prov.source", "prov.chunk").unionByName(read.relations.select("prov.source", "prov.chunk")).distinct()
    accounts = accounted(chunks, unread, cited)
    graph = {"entities": report.entities, "relations": report.relations, "chunks": chunks}
    return Run(graph, report, unread, fresh.filter("failed is null").select("address", "text"), accounts)


def accounted(chunks: DataFrame, unread: DataFrame, cited: DataFrame) -> DataFrame:
    """source, idx, outcome of every chunk: ``blank``, ``unread``, ``empty`` (read, and nothing in it) or ``read``."""
    blank = F.trim(F.coalesce("text", F.lit(""))) == ""
    missing = unread.select("source", F.regexp_extract("locator", r"(\d+)$", 1).cast("int").alias("idx")).distinct().withColumn("_lost", F.lit(True))
    found = cited.select("source", F.col("chunk").alias("idx")).distinct().withColumn("_found", F.lit(True))
    rows = chunks.select("source", "idx", blank.alias("_blank")).join(missing, ["source", "idx"], "left").join(found, ["source", "idx"], "left")
    return rows.select("source", "idx", F.when(F.col("_blank"), "blank").when(F.col("_lost"), "unread").when(F.col("_found"), "read").otherwise("empty").alias("outcome"))


def counted(result: Run) -> DataFrame:
    """One row: the counts of the check, with chunks, and how many of them were unread and empty."""
    n = lambda what: F.count_if(F.col("outcome") == what)
    chunks = result.accounts.agg(F.count("*").alias("chunks"), n("unread").alias("chunks_unread"), (n("empty") + n("blank")).alias("chunks_empty"))
    return result.report.counts.crossJoin(chunks)


def stored(result: Run, store, load_id: str = "", replace: bool = False):
    """Store a run's graph, with the counts that say what it is; the store's preflight refuses what would lose data."""
    return store.load(load_id, {**result.graph, "counts": counted(result)}, replace)
