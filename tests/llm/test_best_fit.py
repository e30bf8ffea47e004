"""Best-fit packing over counts against best-fit decreasing over single pieces."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np

from tessera.llm import best_fit as bf
from tessera.llm import queries
from tessera.llm.encode import load_tokenizer

SF = "/root/testdata/sf0.001"


def plain_rooms(lengths, longest):
    """What is left in each sequence after best-fit decreasing, piece by piece."""
    rooms = []
    for x in sorted(lengths, reverse=True):
        fitting = [r for r in rooms if r >= x]
        if fitting:
            rooms.remove(min(fitting))
            rooms.append(min(fitting) - x)
        else:
            rooms.append(longest - x)
    return sorted(rooms)


def placed(lengths, longest):
    runs = bf.plan(Counter(lengths), longest)
    length = np.array(sorted(lengths), np.int64)
    rank = np.concatenate([np.arange(n) for _, n in sorted(Counter(lengths).items())]) if lengths else np.zeros(0, np.int64)
    return runs, length, *bf.slots(runs, length, rank)


def test_plan_equals_best_fit_decreasing():
    dice = random.Random(1)
    for longest in (7, 16, 100):
        for _ in range(60):
            lengths = [dice.choice([dice.randint(1, longest), dice.randint(1, max(1, longest // 4)), longest // 2]) for _ in range(dice.randint(0, 200))]
            runs, length, sequence, offset = placed(lengths, longest)
            inside = defaultdict(list)
            for s, o, n in zip(sequence.tolist(), offset.tolist(), length.tolist()):
                inside[s].append((o, n))
            for pieces in inside.values():
                at = 0
                for o, n in sorted(pieces):
                    assert o == at
                    at += n
                assert at <= longest
            assert sorted(longest - sum(n for _, n in p) for p in inside.values()) == plain_rooms(lengths, longest)
            assert sorted(inside) == list(range(int(runs["sequences"])))


def test_plan_of_a_billion_pieces_stays_small():
    counts = {n: 10**6 + n * 7919 % 1000 for n in range(1, 1025)}
    runs = bf.plan(counts)
    assert len(runs["length"]) < 10_000
    assert (1024 * int(runs["sequences"])) / sum(n * c for n, c in counts.items()) < 1.001


def test_cut_shortens_the_first_piece_only():
    doc, piece, length = bf.cut(np.array([1, 10, 11, 20, 25]), 10)
    assert list(zip(doc.tolist(), piece.tolist(), length.tolist())) == [(0, 0, 1), (1, 0, 10), (2, 0, 1), (2, 1, 10), (3, 0, 10), (3, 1, 10), (4, 0, 5), (4, 1, 10), (4, 2, 10)]


def check(pairs, rows):
    tokenizer = load_tokenizer(queries.BYTE_BPE)
    want = Counter()
    for i, t in pairs:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
        first = (len(ids) - 1) % 1024 + 1
        for piece, start in enumerate([0, *range(first, len(ids), 1024)]):
            part = ids[start : first if piece == 0 else start + 1024]
            want[(i, piece, start, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))] += 1
    assert Counter(tuple(r)[:5] for r in rows) == want
    inside = defaultdict(list)
    for r in rows:
        inside[r["sequence_id"]].append((r["offset"], r["length"]))
    for pieces in inside.values():
        ends = np.cumsum([n for _, n in sorted(pieces)])
        assert [o for o, _ in sorted(pieces)] == [0, *ends[:-1]] and ends[-1] <= 1024
    assert len(inside) == len(plain_rooms([r["length"] for r in rows], 1024))


def test_documents_take_their_slots(spark, awkward, awkward_df, empty_df, monkeypatch):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    check(docs, queries.queries()["op11_best_fit"](spark, SF).collect())
    check(awkward, bf.best_fit(awkward_df.repartition(3), queries.BYTE_BPE).collect())
    monkeypatch.setattr(bf, "SENT", 0)
    check(awkward, bf.best_fit(awkward_df.repartition(3), queries.BYTE_BPE).collect())
    assert bf.best_fit(empty_df, queries.BYTE_BPE).count() == 0
