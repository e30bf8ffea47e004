"""Uploads in shuffled and repeated parts."""

import hashlib
import random
from pathlib import Path

from tessera.sources import uploads


def test_shuffled_and_repeated_parts_give_the_same_bytes_and_defects_are_named(spark, tmp_path):
    dice = random.Random(1)
    rows, whole = [], {}
    for u in range(12):
        data = dice.randbytes(dice.randint(0, 3000))
        whole[f"u{u}"] = data
        cuts = sorted({0, *(dice.randint(0, len(data)) for _ in range(5))})
        for a, b in zip(cuts, [*cuts[1:], len(data)]):
            rows += [(f"u{u}", a, data[a:b], f"file {u}" if a == 0 else None, len(data), hashlib.sha256(data).hexdigest())] * dice.randint(1, 3)
    say = lambda u, *parts, name="n", total=None, sha=None: [(u, o, d, name, total, sha) for o, d in parts]
    rows += say("gap", (0, b"ab"), (3, b"d")) + say("overlap", (0, b"abc"), (2, b"XY")) + say("same place", (0, b"ab"), (0, b"cd")) + say("short", (0, b"ab"), total=3)
    rows += say("checksum", (0, b"ab"), sha="00") + say("unnamed", (0, b"ab"), name=None) + say("late start", (1, b"b")) + say("empty", (0, None), total=0) + [(None, 0, b"x", "n", None, None), ("nothing", None, b"x", "n", None, None)]
    dice.shuffle(rows)
    df = spark.createDataFrame(rows, "upload string, offset long, data binary, name string, total long, sha256 string").repartition(5)
    got = {r.upload: r for r in uploads.spooled(df, f"{tmp_path.as_uri()}/spool").collect()}
    for u, data in whole.items():
        assert got[u].defect is None and got[u].size == len(data) and Path(got[u].path).read_bytes() == data and got[u].sha256 == hashlib.sha256(data).hexdigest()
    assert {u: (r.defect, r.place) for u, r in got.items() if u not in whole} == {"gap": ("gap", 2), "overlap": ("overlap", 2), "same place": ("overlap", 0), "short": ("short", 2), "checksum": ("checksum", 2), "unnamed": ("unnamed", 2), "late start": ("gap", 0), "empty": (None, None)}
    assert len(list((tmp_path / "spool").iterdir())) == len(whole) + 1
