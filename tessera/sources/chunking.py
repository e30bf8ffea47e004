"""Texts to chunks: whole, fixed, sentence, paragraph, heading and auto strategies.

A chunk is a span of the text with its UTF-8 byte offsets. Sizes are estimated in quarter tokens: an ASCII
sign is one quarter, any other sign four. Splitting is a pure function of one text, so it runs in Arrow
batches without a shuffle; each text's chunk indices count from 0.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_TOKENS, OVERLAP_DIVISOR = 1000, 10
SCHEMA = "source string, idx int, text string, strategy string, heading string, start_byte long, end_byte long"
_HEADING = re.compile(r"(?m)^ {0,3}#{1,6}[ \t]+(?P<mark>[^\n]*?)[ \t#]*$|(?is:<h([1-6])\b[^>]*>(?P<tag>.*?)</h\2\s*>)")
_BLANK = re.compile(r"\n[ \t\r]*\n[ \t\r\n]*")
_SENTENCE = re.compile(r"(?:[.!?…]+[\"'”’)\]]*(?=\s|\Z)|[。！？]+[”’」』）]*)")
_SCRIPT = re.compile(r"[ᄀ-ᇿ⺀-鿿가-힯豈-﫿]")

Span = tuple[int, int]


class TooLarge(ValueError):
    """The text exceeds the budget of the ``whole`` strategy."""


@dataclass(frozen=True)
class Options:
    strategy: str = "auto"
    max_tokens: int = MAX_TOKENS
    overlap: int | None = None

    def __post_init__(self) -> None:
        if self.max_tokens <= 0 or not 0 <= self.overlap_tokens < self.max_tokens:
            raise ValueError("the overlap must be smaller than a positive size")

    @property
    def overlap_tokens(self) -> int:
        return self.max_tokens // OVERLAP_DIVISOR if self.overlap is None else self.overlap


class Measured:
    """A text with the running sums of its quarter tokens and UTF-8 bytes (eight bytes a sign each; none for ASCII)."""

    def __init__(self, text: str) -> None:
        self.text = text
        self.sums = self.bytes = None
        if not text.isascii():
            codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
            self.sums = np.concatenate([[0], np.cumsum(np.where(codes < 0x80, 1, 4))])
            self.bytes = np.concatenate([[0], np.cumsum(1 + (codes >= 0x80) + (codes >= 0x800) + (codes >= 0x10000))])

    def quarters(self, span: Span) -> int:
        return span[1] - span[0] if self.sums is None else int(self.sums[span[1]] - self.sums[span[0]])

    def byte(self, at: int) -> int:
        return at if self.bytes is None else int(self.bytes[at])

    def forward(self, start: int, quarters: int) -> int:
        """The last position that keeps start..position within the budget, at least one sign on."""
        if start >= len(self.text):
            return start
        if self.sums is None:
            return max(start + 1, min(len(self.text), start + quarters))
        return max(start + 1, int(np.searchsorted(self.sums, self.sums[start] + quarters, side="right")) - 1)

    def back(self, end: int, quarters: int) -> int:
        return max(0, end - quarters) if self.sums is None else int(np.searchsorted(self.sums, self.sums[end] - quarters))


def _in_word(c: str) -> bool:
    return (c.isalnum() or c in "_-'") and not _SCRIPT.match(c)


def _cuts_word(text: str, at: int) -> bool:
    return 0 < at < len(text) and _in_word(text[at - 1]) and _in_word(text[at])


def fixed_spans(m: Measured, span: Span, max_tokens: int, overlap: int) -> list[Span]:
    """Greedy spans of the budget; ends go back to a word's edge, the next start goes back by the overlap and on to a word's start."""
    out, (start, stop) = [], span
    while start < stop:
        end = min(stop, m.forward(start, 4 * max_tokens))
        snapped = end
        while snapped > start and snapped < stop and _cuts_word(m.text, snapped):
            snapped -= 1
        end = snapped if snapped > start else end
        out.append((start, end))
        if end >= stop:
            break
        begin = max(start + 1, m.back(end, 4 * overlap)) if overlap else end
        while begin < end and _cuts_word(m.text, begin):
            begin += 1
        start = begin
    return out


def _trim(text: str, span: Span) -> Span:
    a, b = span
    while a < b and text[a].isspace():
        a += 1
    while b > a and text[b - 1].isspace():
        b -= 1
    return a, b


def _between(pattern: re.Pattern, text: str, span: Span, keep: bool) -> list[Span]:
    out, at = [], span[0]
    for m in pattern.finditer(text, *span):
        out.append((at, m.end() if keep else m.start()))
        at = m.end()
    return [s for s in (_trim(text, x) for x in [*out, (at, span[1])]) if s[0] < s[1]]


def paragraphs(text: str, span: Span) -> list[Span]:
    return _between(_BLANK, text, span, False)


def sentences(text: str, span: Span) -> list[Span]:
    return _between(_SENTENCE, text, span, True)


def sections(text: str) -> list[tuple[str, Span]]:
    """(heading, span) from each heading to the next; what precedes the first is a section of its own."""
    marks = list(_HEADING.finditer(text))
    edges = [m.start() for m in marks] + [len(text)]
    names = [re.sub(r"<[^>]*>", "", m.group("mark") or m.group("tag") or "").strip() for m in marks]
    out = [("", (0, edges[0]))] + [(n, (edges[i], edges[i + 1])) for i, n in enumerate(names)]
    return [(n, s) for n, x in out if (s := _trim(text, x)) and s[0] < s[1]]


def packed(m: Measured, units: list[Span], o: Options) -> list[Span]:
    """Units joined greedily while they fit the budget less the overlap; a larger unit is cut as fixed spans.

    Then every later span begins earlier by the overlap, but after the start of the one before it.
    """
    room, out = 4 * (o.max_tokens - o.overlap_tokens), []
    for u in units:
        if m.quarters(u) > room:
            out += fixed_spans(m, u, o.max_tokens - o.overlap_tokens, 0)
        elif out and u[0] >= out[-1][1] and m.quarters((out[-1][0], u[1])) <= room:
            out[-1] = (out[-1][0], u[1])
        else:
            out.append(u)
    return [s if not i else (max(out[i - 1][0] + 1, min(s[0], m.back(s[0], 4 * o.overlap_tokens))), s[1]) for i, s in enumerate(out)]


def split(text: str, o: Options, measured: Measured | None = None) -> list[tuple[str, str, Span]]:
    """(strategy, heading, span) of every chunk; a blank text has none."""
    if not text.strip():
        return []
    m, everything = measured or Measured(text), (0, len(text))
    strategy = o.strategy
    if strategy == "auto":
        strategy = "heading" if _HEADING.search(text) else "paragraph" if len(paragraphs(text, everything)) > 1 else "fixed"
    if strategy == "whole":
        if m.quarters(everything) > 4 * o.max_tokens:
            raise TooLarge(f"{-(-m.quarters(everything) // 4)} tokens")
        return [("whole", "", everything)]
    if strategy == "fixed":
        return [("fixed", "", s) for s in fixed_spans(m, everything, o.max_tokens, o.overlap_tokens)]
    if strategy in ("paragraph", "sentence"):
        units = (paragraphs if strategy == "paragraph" else sentences)(text, everything)
        return [(strategy, "", s) for s in packed(m, units, o)]
    if strategy == "heading":
        out = []
        for name, span in sections(text):
            if m.quarters(span) <= 4 * o.max_tokens:
                out.append(("heading", name, span))
            else:
                out += [("heading+split", name, s) for s in packed(m, paragraphs(text, span), o)]
        return out
    raise ValueError(f"unknown strategy {strategy!r}")


def chunks(df: DataFrame, options: Options, source: str = "source", text: str = "text") -> DataFrame:
    """One row per chunk of every text; a null text has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for name, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                m = Measured(t or "")
                for i, (strategy, heading, (a, b)) in enumerate(split(t or "", options, m)):
                    rows.append((name, i, t[a:b], strategy, heading, m.byte(a), m.byte(b)))
            columns = list(zip(*rows, strict=True)) or [[]] * 7
            kinds = [pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in SCHEMA.split(", ")])

    return df.select(F.col(source).cast("string").alias("source"), F.col(text).cast("string").alias("text")).mapInArrow(run, SCHEMA)
