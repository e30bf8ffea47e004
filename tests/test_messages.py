"""Byte pages against plain greedy packing, budgets against a running sum."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import budget, extract, messages


def greedy(sizes, most, handed=0, number=1):
    out = []
    for s in sizes:
        if handed + s > most:
            handed, number = 0, number + 1
        handed += s
        out.append(number)
    return out, handed


def test_transition_of_a_range_is_greedy_packing_for_every_carried_byte():
    dice = random.Random(1)
    for _ in range(300):
        most = dice.choice([1, 5, 17])
        sizes = [dice.choice([0, 1, most, dice.randint(0, most)]) for _ in range(dice.randint(0, 15))]
        function = messages.transition(np.array(sizes, np.int64), most)
        for handed in range(most + 1):
            pages, out = greedy(sizes, most, handed)
            assert messages.carried(function, sum(sizes), handed) == (out, pages[-1] - 1 if pages else 0)
            assert messages.numbers(np.array(sizes, np.int64), most, handed, 1).tolist() == pages


def test_byte_pages_equal_greedy_packing_and_name_what_is_too_large(spark):
    dice = random.Random(2)
    sizes = [dice.choice([0, 3, 50, dice.randint(0, 100)]) for _ in range(3000)]
    rows = spark.createDataFrame([(i, s if s != 3 else None, "x") for i, s in enumerate(sizes)], "ord long, size int, page string").repartition(7)
    got = messages.byte_pages(rows.drop("page"), ["ord"], F.col("size"), 100).orderBy("ord").collect()
    assert [r["page"] for r in got] == greedy([0 if s == 3 else s for s in sizes], 100)[0]
    assert messages.byte_pages(rows.drop("page").limit(0), ["ord"], F.col("size"), 100).count() == 0
    with pytest.raises(messages.Oversized, match="'ord': 4000.*more than 100 bytes"):
        messages.byte_pages(rows.drop("page").union(spark.createDataFrame([(4000, 101)], "ord long, size int")), ["ord"], F.col("size"), 100)


def test_prefix_within_a_budget(spark):
    rows = spark.range(1000).selectExpr("id", "id % 7 as cost").repartition(5)
    got = budget.running_total(budget.admit(rows, 1500, ["id"], F.col("cost")), ["id"], F.col("cost")).orderBy("id").collect()
    total = 0
    for r in got:
        total += r["id"] % 7
        assert (r["total"], r["admitted"]) == (total, total <= 1500)


def test_budget_is_reserved_settled_and_backed_off(spark):
    rows = spark.createDataFrame([(f"{i:02}", "p" * 40) for i in range(20)], "address string, prompt string")  # 10 tokens each
    model = lambda prompts: ["r" * 4 for _ in prompts]  # noqa: E731  one token
    ask = lambda r: extract.asked(r, model, "toy")
    # nine tokens of each reserved reply come back, so later rounds ask about more: 110 tokens buy ten answers of eleven tokens
    spent = budget.ask_within(rows, ask, 110, reply=10, wait=lambda s: None)
    assert sorted(r["address"] for r in spent.answers.collect()) == [f"{i:02}" for i in range(9)] and spent.used == 99 and spent.rounds > 1
    assert {(r["address"], r["reason"]) for r in spent.left.collect()} == {(f"{i:02}", "the budget is spent") for i in range(9, 20)}
    waits = []

    def flaky(prompts):
        raise RuntimeError("too many requests")

    spent = budget.ask_within(rows, lambda r: extract.asked(r, flaky, "toy"), 10_000, wait=waits.append)
    assert spent.answers.count() == 0 and {r["reason"] for r in spent.left.collect()} == {"too many requests"} and spent.used == 600
    assert waits[0] == 0 and waits[1:3] == [1.0, 2.0]
    assert [budget.delay(n) for n in (1, 2, 3, 20)] == [0, 1, 2, 60]
    assert budget.ask_within(rows, ask, 5, wait=waits.append).rounds == 0
