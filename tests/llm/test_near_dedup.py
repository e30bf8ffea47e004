"""Near-duplicates against all pairs of full sets."""

import random
from collections import defaultdict

import numpy as np
import pytest

from tessera.llm import near_dedup, queries
from tessera.llm.shingles import shingle_sets

SF = "/root/testdata/sf0.001"


def plain_set(text, width):
    words = (text or "").encode().lower().split()
    if not words:
        return set()
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))}


def plain_components(pairs, width, percent):
    sets = [plain_set(t, width) for _, t in pairs]
    root = list(range(len(pairs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, s in enumerate(sets):
        for j in range(i):
            both = len(s & sets[j])
            if s and sets[j] and 100 * both >= percent * (len(s) + len(sets[j]) - both):
                root[max(find(i), find(j))] = min(find(i), find(j))
    ids = defaultdict(list)
    for i, (d, _) in enumerate(pairs):
        ids[find(i)].append(d)
    return sorted((str(d), len(sets[i]), str(min((x for x in ids[find(i)] if x is not None), default=None))) for i, (d, _) in enumerate(pairs))


def result(df):
    rows = df.collect()
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in rows)
    return sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in rows)


def test_sets_equal_plain_words(awkward):
    for width in (3, 5):
        assert [len(s) for s in shingle_sets([t for _, t in awkward], width)] == [len(plain_set(t, width)) for _, t in awkward]


def test_bounds():
    assert near_dedup.least_matches(85) == sorted(near_dedup.least_matches(85))
    for percent in (80, 85):
        r = near_dedup.band_rows(percent)
        assert (1 - (percent / 100) ** r) ** (near_dedup.SIGNATURE // r) <= near_dedup.BAND_MISS
    rng = np.random.default_rng(0)
    a = rng.integers(0, 1 << 32, (500, near_dedup.SIGNATURE), dtype=np.uint32)
    b = np.where(rng.random(a.shape) < 0.9, a, 0).astype(np.uint32)
    n = np.full(500, 100)
    assert len(near_dedup.prune(a, b, n, n, 85)) == 500
    assert len(near_dedup.prune(a, a[::-1], n, n, 85)) == 0


@pytest.mark.parametrize(("star_rounds", "pairs"), [(near_dedup.STAR_ROUNDS, near_dedup.PAIRS), (near_dedup.STAR_ROUNDS, 0), (0, 0)])
def test_chains_and_groups(spark, awkward_df, awkward, monkeypatch, star_rounds, pairs):
    """Few star rounds, as many as there may be, and none (the exact comparison by blocks alone) find the same components."""
    monkeypatch.setattr(near_dedup, "STAR_ROUNDS", star_rounds)
    monkeypatch.setattr(near_dedup, "PAIRS", pairs)
    monkeypatch.setattr(near_dedup, "BLOCK_BYTES", 20_000)
    rng = random.Random(1)
    words = [f"w{i}" for i in range(400)]
    base, texts = rng.choices(words, k=120), []
    for i in range(60):
        copy = list(base)
        for _ in range(rng.randrange(6)):
            copy[rng.randrange(len(copy))] = rng.choice(words)
        texts.append(" ".join(copy))
    chain = rng.choices(words, k=100)
    for i in range(12):
        chain = chain[2:] + rng.choices(words, k=2)
        texts.append(" ".join(chain))
    texts += [" ".join(rng.choices(words, k=40)) for _ in range(30)] + [None, "", "A b", "a B"]
    pairs = list(enumerate(texts))
    rng.shuffle(pairs)
    df = spark.createDataFrame(pairs, "doc_id long, text string")
    assert result(near_dedup.near_classes(df, 3, 85)) == plain_components(pairs, 3, 85)


def test_awkward_rows_and_filter(spark, awkward, awkward_df, empty_df):
    assert result(near_dedup.near_classes(awkward_df, 3, 85)) == plain_components(awkward, 3, 85)
    stay = near_dedup.near_dedup(awkward_df)
    assert stay.columns == awkward_df.columns
    kept = {r["doc_id"] for r in stay.collect()}
    assert {100} <= kept and 101 not in kept
    assert near_dedup.near_classes(empty_df).count() == 0
    assert near_dedup.near_dedup(empty_df).count() == 0


def test_query(spark):
    pairs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert result(queries.queries()["op2_near_dedup"](spark, SF)) == plain_components(pairs, 3, 85)


def test_filter_drops_by_id_and_text(spark):
    """Of rows that repeat a doc_id only the copy goes; a row without a doc_id goes if its group has one."""
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    rows = [(1, a), (2, a), (2, b), (None, a), (3, None), (None, "")]
    stay = near_dedup.near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r["doc_id"]), r["text"]) for r in stay) == sorted([("1", a), ("2", b), ("3", None), ("None", "")], key=lambda r: (r[0], str(r[1])))
