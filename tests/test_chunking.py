"""Chunkers: spans, budgets, overlap and byte offsets."""

import pytest

from tessera.sources.chunking import Measured, Options, TooLarge, chunks, fixed_spans, sections, sentences, split

TEXT = "# One\n\nFirst part here. It goes on!\n\nSecond été part.\n\n## Two\n\n" + "word " * 400


def test_fixed_spans_keep_words_and_overlap():
    text = "alpha beta gamma delta epsilon zeta"
    spans = fixed_spans(Measured(text), (0, len(text)), 3, 1)
    assert spans[0][0] == 0 and spans[-1][1] == len(text)
    assert all(b <= c[1] and c[0] <= b for (_, b), c in zip(spans, spans[1:], strict=False))
    assert all((m := Measured(text)).quarters(s) <= 12 for s in spans)
    assert all(a == 0 or not (text[a - 1].isalpha() and text[a].isalpha()) for a, _ in spans)


def test_units():
    t = "One. Two! v1.2 stays? (Yes.) 三。四"
    assert [t[a:b] for a, b in sentences(t, (0, len(t)))] == ["One.", "Two!", "v1.2 stays?", "(Yes.)", "三。", "四"]
    assert [h for h, _ in sections("intro\n# A\nx\n<h2>B <b>c</b></h2>y")] == ["", "A", "B c"]


def test_strategies():
    assert split("  \n", Options()) == []
    assert {s for s, _, _ in split(TEXT, Options(max_tokens=50))} == {"heading", "heading+split"}
    assert split("a\n\nb", Options())[0][0] == "paragraph" and split("a b", Options())[0][0] == "fixed"
    with pytest.raises(TooLarge):
        split(TEXT, Options("whole", 10))
    with pytest.raises(ValueError):
        Options(max_tokens=5, overlap=5)
    with pytest.raises(ValueError):
        split("x", Options("none"))


def test_byte_offsets(spark):
    df = spark.createDataFrame([("d", TEXT), ("n", None), ("e", "")], "source string, text string")
    rows = chunks(df, Options(max_tokens=40)).collect()
    assert {r["source"] for r in rows} == {"d"} and [r["idx"] for r in rows] == list(range(len(rows)))
    assert all(TEXT.encode()[r["start_byte"] : r["end_byte"]].decode() == r["text"] for r in rows)
