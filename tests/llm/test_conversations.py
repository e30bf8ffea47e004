"""Conversation repair against enumeration of all edits, a sequential scan and plain damage."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from tessera.llm import conversations as cv

GOOD = re.compile(r"(s?(ua)+)?")


def enumerated(codes):
    """(cost, audit) over all edits with at most two insertions in a place."""
    inserts = [(5 * len(x), "I" * len(x), x) for x in ("", "u", "a", "ua", "au")]
    places = []
    for c in codes:
        ways = [(2, "D", "")]
        if c.isalpha():
            late = 5 * c.isupper()
            ways += [(late, "K", c.lower()), (late + 1, "R", "u"), (late + 1, "R", "a")]
        places.append([(i[0] + w[0], i[1] + w[1], i[2] + w[2]) for i in inserts for w in ways])
    found = []
    for way in itertools.product(*places, inserts):
        if GOOD.fullmatch("".join(w[2] for w in way)):
            found.append((sum(w[0] for w in way), "".join(w[1] for w in way)))
    return min(found)


def test_scan_equals_enumeration_of_edits():
    codes = cv.INITIALS + cv.TRUNC + "05"
    cases = ["", *codes, *map("".join, itertools.product(codes, repeat=2))]
    dice = random.Random(3)
    cases += ["".join(dice.choice(codes) for _ in range(3)) for _ in range(60)]
    for case in cases:
        got = cv.settle(cv.scan(case)) if case else (0, "")
        assert got == enumerated(case), case


def test_products_may_be_grouped_in_any_way():
    dice = random.Random(4)
    for _ in range(200):
        a, b, c = ("".join(dice.choice("suaoSUAO05") for _ in range(dice.randint(1, 6))) for _ in range(3))
        a, b, c = map(cv.scan, (a, b, c))
        assert cv.times(cv.times(a, b), c) == cv.times(a, cv.times(b, c))


def plain(rows):
    """Reports of rows (conv, turn, role, text) after damage, by one pass over each conversation."""
    groups = {}
    for conv, turn, role, text in rows:
        groups.setdefault(conv, []).append((turn, " " if role is None else role, " " if text is None else text))
    out = {}
    for conv, said in groups.items():
        said.sort(key=lambda r: (r[0] is not None, r[0] or 0))
        seen, codes, count = set(), "", dict.fromkeys(("blank", "duplicate", "truncated"), 0)
        initials = [r[1][:1] if r[1][:1] in ("s", "u", "a") else "o" for r in said]
        for i, (_, role, text) in zip(initials, said):
            last = text.rstrip(" \t\n\v\f\r")[-1:]
            fault = "blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last not in ".!?" else ""
            seen.add((role, text))
            if fault:
                count[fault] += 1
            codes += "0" if fault == "blank" else "4" if fault == "duplicate" else i.upper() if fault else i
        ways = {0: (0, "", [])}  # state -> cost, audit, roles
        insert = lambda ways: {q: min((c + 5 * len(x), a + "I" * len(x), r + [(y, "") for y in x]) for p, (c, a, r) in ways.items() for x in ("", "u", "a", "ua", "au") if go(p, x) == q) for q in {go(p, x) for p in ways for x in ("", "u", "a", "ua", "au")} - {None}}
        for code, (_, role, text) in zip(codes, said):
            ways, new = insert(ways), {}
            for p, (c, a, r) in ways.items():
                steps = [(p, 2, "D", [])]
                if code.isalpha():
                    late = 5 * code.isupper()
                    steps += [(go(p, code.lower()), late, "K", [(role, text)])] + [(go(p, x), late + 1, "R", [(x, text)]) for x in "ua"]
                for q, cost, letter, kept in steps:
                    if q is not None:
                        new[q] = min(new.get(q, (1 << 60, "", [])), (c + cost, a + letter, r + kept))
            ways = new
        cost, audit, kept = min(w for q, w in insert(ways).items() if q in (0, 3))
        names = {"u": "user", "a": "assistant"}
        text = "\n".join(f"{names.get(r, r)}:{t}" for r, t in kept)
        turns = [t for t, _, _ in said if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        out[conv] = (gaps, *count.values(), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())
    return out


def go(state, roles):
    for r in roles:
        state = cv.STEP.get((state, r))
        if state is None:
            return None
    return state


SCHEMA = "conv_id long, turn long, role string, text string, uid long, key string, at long, seg int, what string"
COLUMNS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 2, 3, "y") for r in rows], SCHEMA)


def random_rows(seed, sizes):
    dice = random.Random(seed)
    rows = []
    for conv, n in enumerate(sizes):
        for turn in range(n):
            role = dice.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
            text = dice.choice(["Good.", "Well?", "no end", " ", "", None, f"Line {dice.randint(0, 10**6)}!", f"cut {dice.randint(0, 10**6)}", "end. \n"])
            rows.append((conv if conv else None, turn * 2 if turn else None, role, text))
    return rows


@pytest.fixture()
def many_stretches(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    for name, value in {"spark.sql.shuffle.partitions": "13", "spark.sql.adaptive.coalescePartitions.enabled": "false"}.items():
        spark.conf.set(name, value)
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_repair_across_stretches_equals_plain_scan(spark, many_stretches, monkeypatch):
    monkeypatch.setattr(cv, "FAN", 2)
    rows = random_rows(5, [3, 600, 1, 2, 0, 5, 900, 4, 4, 7])
    df = table(spark, rows)
    got = {r["conv_id"]: tuple(r[c] for c in COLUMNS) for r in cv.repair_digest(df, df).collect()}
    assert got == plain(rows)


def test_damage_and_missing_conversations(spark):
    rows = random_rows(6, [1] * 40 + [6] * 40)
    hurt = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        d = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if d == 1 else re.sub("[.!?]", "", text) if d == 2 else text
        hurt += [(conv, turn, "user" if d == 4 else role, text)] * (0 if d == 0 else 2 if d == 3 else 1)
    df = table(spark, rows)
    assert sorted(map(repr, cv.damaged(df).collect())) == sorted(repr(r) for r in table(spark, hurt).select("conv_id", "turn", "role", "text").collect())
    got = {r["conv_id"]: tuple(r[c] for c in COLUMNS) for r in cv.repair_digest(cv.damaged(df), df).collect()}
    nothing = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    want = plain(hurt)
    assert got == {conv: want.get(conv, nothing) for conv, *_ in rows}
    assert len(want) < len(got)


def test_repaired_turns_repeats_ties_long_texts_and_empty_table(spark):
    long = "word " * 50_000 + "end."
    rows = [(1, 0, "user", long)] + [(1, 0, "user", "Same.")] * 50 + [(1, 1, "assistant", "Yes."), (1, 1, "assistant", "Yes.")]
    reports, turns = cv.repair(table(spark, rows))
    assert [(r["duplicate"], r["cost"], len(r["audit"])) for r in reports.collect()] == [(50, 102, 53)]
    left = [(r["role"], r["text"]) for r in turns.orderBy("at").collect()]
    assert left in ([("user", long), ("assistant", "Yes.")], [("user", "Same."), ("assistant", "Yes.")])
    empty = table(spark, [])
    assert cv.repair_digest(cv.damaged(empty), empty).count() == 0
    names = spark.createDataFrame([("b", 0, "user", "Hi."), ("b", 1, "assistant", "Yes."), ("a", 0, "user", "Hi.")], "conv_id string, turn int, role string, text string")
    assert {r["conv_id"]: r["audit"] for r in cv.repair_digest(names, names).collect()} == {"b": "KK", "a": "D"}
