"""Standing answers: lookup by bucket, claims, eviction by bytes against plain code."""

import random

import pytest

from tessera.operators import answers


def rows(frame):
    return sorted((r.address, r.text) for r in frame.select("address", "text").collect())


def plain(table, most):
    kept, total = [], 0
    for address, used, size in sorted(table, key=lambda r: (-(r[1] if r[1] is not None else -(2**62)), r[0])):
        total += size or 0
        if total > most:
            break
        kept.append(address)
    return sorted(kept)


@pytest.mark.parametrize("spread", [1, 5, 10**15])
def test_fitting_equals_plain_eviction(spark, spread):
    dice = random.Random(spread)
    table = [(f"a{i:04d}", dice.choice([None, -3, dice.randrange(spread), dice.randrange(spread)]), dice.choice([None, 0, 1, 7, 300])) for i in range(400)]
    frame = spark.createDataFrame(table, "address string, used_at long, bytes long")
    total = sum(size or 0 for _, _, size in table)
    for most in (-1, 0, total // 3, total):
        want = plain(table, most)
        assert sorted(r.address for r in answers.fitting(frame, most).collect()) == want
    assert answers.fitting(frame.limit(0), 5).count() == 0


def test_put_lookup_evict(spark, tmp_path):
    kept = answers.Answers(spark, f"file://{tmp_path}/a", buckets=4)
    ask = lambda *names: spark.createDataFrame([(n,) for n in names], "address string")
    put = lambda now, *pairs: kept.put(spark.createDataFrame(pairs, "address string, text string"), now)
    assert kept.rows().count() == 0 and kept.evict(1, 10, 10) == 0
    put(10, ("a", '{"x":1}'), ("b", '{"x":2}'), ("c", "no object"), ("d", None), (None, "{}"), ("e", "[1]"))
    put(20, ("a", '{"x":3}'))
    known, open_ = kept.lookup(ask("a", "a", "c", "z", None), 30)
    assert rows(known) == [("a", '{"x":3}')] and sorted(r.address for r in open_.collect()) == ["c", "z"]
    put(25, ("f", '{"x":4}'))
    assert kept.evict(40, 100, 14) == 1  # b was used last at 10
    assert rows(kept.rows()) == [("a", '{"x":3}'), ("f", '{"x":4}')]
    kept.lookup(ask("f"), 50)
    assert kept.evict(121, 100, 10**6) == 1  # a is too old, whenever it was used
    assert rows(kept.rows()) == [("f", '{"x":4}')]


def test_an_address_is_asked_about_by_one_at_a_time(spark, tmp_path):
    kept = answers.Answers(spark, f"file://{tmp_path}/a", buckets=4)
    ask = lambda *names: spark.createDataFrame([(n,) for n in names], "address string")
    got = lambda frame: sorted(r.address for r in frame.collect())
    assert got(kept.claim(ask("x", "y"), "one", 0, 10)) == ["x", "y"]
    assert got(kept.claim(ask("y", "z"), "two", 5, 10)) == ["z"]
    assert got(kept.claim(ask("y"), "two", 10, 10)) == ["y"]  # the first claim has run out
    kept.put(spark.createDataFrame([("z", "{}")], "address string, text string"), 11)
    assert got(kept.claim(ask("z"), "one", 12, 10)) == ["z"]
