"""Spelling variants against all words one edit away."""

import random
import re
import zlib
from collections import Counter

import pytest

from tessera.llm import flat, queries, spelling
from tessera.llm.common import ensure_importable

SF = "/root/testdata/sf0.001"
RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = str.maketrans(spelling.UPPER, spelling.LOWER)


def plain(docs):
    counts = Counter()
    for i, text in docs:
        for w in RUN.findall(text or ""):
            w = w.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            k = h % len(w)
            counts[w[:k] + w[k + 1 :] if h % 31 == 0 else w] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}
    letters = set("".join(words))
    form, near = {}, {}
    for w in words:
        cuts = [(w[:i], w[i:]) for i in range(len(w) + 1)]
        around = {a + b[1:] for a, b in cuts if b} | {a + c + b for a, b in cuts for c in letters} | {a + c + b[1:] for a, b in cuts if b for c in letters}
        found = [x for x in around if x in words and x != w]
        best = min(found, key=lambda x: (-words[x], x), default=None)
        near[w], form[w] = len(found), best if best and words[best] >= 10 * words[w] else None
    out = []
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, near[w], words[form[w]] if form[w] else None))
    return sorted(map(repr, out))


def got(df):
    return sorted(repr(tuple(r)) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect())


@pytest.mark.parametrize("keys", [spelling.TASK_KEYS, 50])
def test_groups_equal_plain_search(spark, awkward, awkward_df, empty_df, monkeypatch, keys):
    monkeypatch.setattr(spelling, "TASK_KEYS", keys)
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert got(queries.queries()["op13_spelling"](spark, SF)) == plain(docs)
    assert got(spelling.spelling_groups(awkward_df)) == plain(awkward)
    assert spelling.spelling_groups(empty_df).count() == 0


def test_runs_of_letters_chains_and_ties(spark):
    ensure_importable(spark)
    dice = random.Random(2)
    base = ["aaaaaaa", "aaaaaaaa", "aaabaaaa", "abababab", "babababa", "bababab", "étéétéété", "×÷×÷×÷×"]
    words = base + ["".join(dice.choice("ab") for _ in range(dice.randint(7, 10))) for _ in range(150)]
    texts = [" ".join([w] * dice.choice([2, 3, 25, 300, 4000])) for w in words]
    docs = list(enumerate(texts))
    rows = plain(docs)
    assert got(spelling.spelling_groups(spark.createDataFrame(docs, "doc_id long, text string"))) == rows
    assert sum("None" not in r for r in rows) > 20


def test_a_very_long_word_costs_keys_only(spark):
    ensure_importable(spark)
    docs = [(1, "a" * 40_000 + " " + "a" * 40_000), (2, "a" * 39_999 + " " + "a" * 39_999), (3, "a" * 39_998 + "b " + "a" * 39_998 + "b")]
    rows = {len(r["word"]) + r["word"].count("b") / 2: r["n_near"] for r in spelling.spelling_groups(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert rows == {40_000: 1, 39_999: 2, 39_999.5: 1}


def test_colliding_keys_are_told_apart_by_their_strings(spark, monkeypatch):
    import numpy as np

    from tessera.llm.flat import deletion_hashes

    words = ["kitten", "mitten", "kittens", "sitting"]
    codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    item, place, key = deletion_hashes(codes, np.array([len(w) for w in words]))
    rest = [words[i] if p < 0 else words[i][:p] + words[i][p + 1 :] for i, p in zip(item.tolist(), place.tolist())]
    assert len(set(zip(rest, key.tolist()))) == len(set(rest)) == len(set(key.tolist()))
    import pyarrow as pa

    rows = pa.RecordBatch.from_pydict({"key": [1, 1, 1, 1], "place": pa.array([0, 0, 0, 0], pa.int32()), "first": [True] * 4, "id": [1, 2, 3, 4], "n": [5, 6, 7, 8], "word": ["kitten", "mitten", "sat", "cat"]})
    out = [r for b in spelling._group(iter([rows])) for r in b.to_pylist()]
    assert sorted((r["id"], r["n_near"], r["near"]) for r in out) == [(1, 1, "mitten"), (2, 1, "kitten"), (3, 1, "cat"), (4, 1, "sat")]
    assert flat.deletion_hashes(np.zeros(0, np.uint32), np.zeros(0, np.int64))[0].size == 0
