"""A budget of tokens for calls of models: reserve by estimates in order, settle with what was used, back off after failures.

The prefix that fits is found by a running sum over ranges: each range sums its own rows, the driver adds one number per range. Every
round reserves, asks and settles; what an estimate reserved too much serves the next round. Rows that no longer fit are named, not dropped.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import token_estimate as tokens
from tessera.operators.cut import cut

#: Seconds before the second round of an endpoint that refused, and the most (they double).
BASE, MOST = 1.0, 60.0


def delay(attempt: int) -> float:
    """Seconds to wait before round ``attempt`` (1 is the first)."""
    return 0.0 if attempt < 2 else min(MOST, BASE * 2.0 ** min(attempt - 2, 40))


def running_total(rows: DataFrame, order: list[str | Column], amount: Column, name: str = "total") -> DataFrame:
    """``rows`` with ``name``: the sum of ``amount`` up to and with each row in the given total order, without a task that sees them all."""
    spark = rows.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut(rows.withColumn("_amount", F.coalesce(amount.cast("long"), F.lit(0))).repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()))
    base, bases = 0, []
    for r in sorted(dealt.groupBy("_part").agg(F.sum("_amount").alias("n")).collect()):
        bases.append((r["_part"], base))
        base += r["n"]
    inside = F.sum("_amount").over(Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    bases = spark.createDataFrame(bases, "_part int, _base long")
    return dealt.withColumn("_inside", inside).join(F.broadcast(bases), "_part").withColumn(name, F.col("_base") + F.col("_inside")).drop("_part", "_amount", "_base", "_inside")


def admit(rows: DataFrame, most: int, order: list[str | Column], cost: Column) -> DataFrame:
    """``rows`` with ``admitted``: true for the longest prefix in order whose estimated tokens fit in ``most``."""
    return running_total(rows, order, cost, "_sum").withColumn("admitted", F.col("_sum") <= most).drop("_sum")


@dataclass
class Spent:
    """What a budget bought: ``answers`` (address, model, text), ``left`` (address and why it has none), tokens used and rounds made."""

    answers: DataFrame
    left: DataFrame
    used: int
    rounds: int


def ask_within(rows: DataFrame, ask: Callable[[DataFrame], DataFrame], most: int, *, reply: int = 0, attempts: int = 3, wait: Callable[[float], None] = time.sleep) -> Spent:
    """Ask about ``rows`` (address, prompt), by address, while estimated tokens fit in ``most``.

    ``ask`` makes address, model, text, failed of rows. ``reply`` tokens are reserved for each answer, used are those of prompt and answer. A failed call uses its prompt
    and is tried again behind the others, ``attempts`` times at most; after a round in which most calls failed the next asks about half as many tokens, later.
    """
    spark = rows.sparkSession
    left = cut(rows.select("address", "prompt", F.lit(0).alias("tries"), F.lit(None).cast("string").alias("reason")))
    answers, used, rounds, share, refused = None, 0, 0, 1.0, 1
    cost = tokens(F.col("prompt")) + F.lit(reply)
    while most > used:
        open_ = left.filter(F.col("tries") < attempts)
        room = int((most - used) * share)
        marked = cut(admit(open_, room, ["tries", "address"], cost))
        chosen = marked.filter("admitted").drop("admitted")
        if not chosen.limit(1).count():
            if share == 1.0 or not open_.limit(1).count():
                break
            share = 1.0
            continue
        rounds += 1
        wait(delay(refused))
        got = cut(ask(chosen.select("address", "prompt")))
        told = chosen.join(got.select("address", "text", "failed"), "address")
        row = told.agg(F.sum(tokens(F.col("prompt")) + F.coalesce(tokens(F.col("text")), F.lit(0))).alias("used"), F.count_if(F.col("failed").isNotNull()).alias("failed"), F.count("*").alias("n")).first()
        used += row["used"] or 0
        refused, share = (refused + 1, max(share / 2, 1 / 64)) if 2 * row["failed"] > row["n"] else (1, 1.0)
        good = got.filter("failed is null").select("address", "model", "text")
        answers = good if answers is None else answers.unionByName(good)
        again = told.filter("failed is not null").select("address", "prompt", (F.col("tries") + 1).alias("tries"), F.col("failed").alias("reason"))
        left = cut(left.join(chosen.select("address"), "address", "left_anti").unionByName(again))
    why = F.coalesce("reason", F.lit("the budget is spent"))
    empty = spark.createDataFrame([], "address string, model string, text string")
    return Spent(empty if answers is None else answers, left.select("address", why.alias("reason")), used, rounds)
