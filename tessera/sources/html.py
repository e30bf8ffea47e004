"""HTML pages to text that the chunkers read: headings as ``#`` lines, list items as ``- ``, blank lines between blocks.

Tags become marks in the text, and one pattern then settles every run of marks and spaces. No tree is
built, so unclosed elements do no harm. A page is one row; nothing shuffles. A null page has no text.
The noncharacters U+FDD0 to U+FDEF serve as marks and are taken out of the input.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.entities import html5, name2codepoint

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Elements without text, elements that stand apart, and names decoded besides those of Latin-1.
SILENT = "script style noscript template title iframe svg"
BLOCKS = set("p div section article header footer main aside nav blockquote ul ol dl dt dd table thead tbody tr hr figure figcaption form fieldset address details summary body".split())
TYPOGRAPHIC = "amp lt gt quot apos ndash mdash horbar minus lsquo rsquo sbquo ldquo rdquo bdquo hellip bull middot dagger Dagger prime Prime permil trade euro larr uarr rarr darr harr ne le ge asymp equiv lsaquo rsaquo oline frasl ensp emsp thinsp zwnj zwj"
NAMED = {n: html5[f"{n};"] for n in TYPOGRAPHIC.split()} | {n: chr(c) for n, c in name2codepoint.items() if 160 <= c <= 255}

GAP, LINE, BLOCK, END, ITEM = (chr(0xFDD0 + i) for i in range(5))
_HEADS = {f"h{i}": chr(0xFDD4 + i) for i in range(1, 7)}
_PREFIX = {ITEM: "- "} | {mark: "#" * int(h[1]) + " " for h, mark in _HEADS.items()}
_KEPT = {ord(c): chr(0xFDE0 + i) for i, c in enumerate(" \t\n\r\f\v")}
_LOOSE = {ord(kept): chr(c) for c, kept in _KEPT.items()}
_MARKS = re.compile("[\ufdd0-\ufdef]")
_DROPPED = re.compile(rf"(?is)<!--.*?(?:-->|\Z)|<[!?].*?(?:>|\Z)|<({'|'.join(SILENT.split())})(?![\w:-])[^>]*>.*?(?:</\1[^>]*(?:>|\Z)|\Z)")
_TAG = re.compile(r"""<(/?)([A-Za-z0-9:_-]+)((?:[^"'>]|"[^"]*(?:"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)""")
_ENTITY = re.compile(r"&(?:#(\d{1,8})|#[xX]([0-9a-fA-F]{1,7})|(\w{1,10}));")
_RUN = re.compile(f"[ \t\n\r\f\v{GAP}-\ufdda]+")


def decode(text: str) -> str:
    """Named, decimal and hexadecimal references; what is unknown stays as it is, a no-break space becomes a plain one."""

    def one(m: re.Match) -> str:
        if m[3]:
            return NAMED.get(m[3], m[0]).replace("\xa0", " ")
        code = int(m[1]) if m[1] else int(m[2], 16)
        fine = 0 < code < 0x110000 and not 0xD800 <= code < 0xE000 and not 0xFDD0 <= code < 0xFDF0
        return (" " if code == 160 else chr(code)) if fine else m[0]

    return _ENTITY.sub(one, text)


def _settle(m: re.Match) -> str:
    """The break and the prefix that a run of marks asks for; a prefix is void if its element ends in the run."""
    run, prefix = m[0], ""
    for c in run:
        prefix = "" if c == END else _PREFIX.get(c, prefix)
    if m.end() == len(m.string):
        return ""
    if m.start() == 0:
        return prefix
    return ("\n\n" if BLOCK in run else "\n" if LINE in run else " ") + prefix


def text_of_html(page: str) -> str:
    page, out, at, head, pre = _DROPPED.sub("", _MARKS.sub("", page)), [], 0, False, 0

    def text(s: str) -> str:
        return decode(s).translate(_KEPT) if pre else decode(s)

    for m in _TAG.finditer(page):
        out.append(text(page[at : m.start()]))
        at, closing, name = m.end(), bool(m[1]), m[2].lower()
        if name in _HEADS:
            head = not closing
            out.append(BLOCK + (END if closing else _HEADS[name]))
        elif name == "pre":
            pre = max(0, pre + (-1 if closing else 1))
            out.append(GAP if head else BLOCK)
        elif name == "li":
            out.append(END if closing else GAP if head else BLOCK + ITEM)
        elif name in ("td", "th"):
            out.append("" if closing else GAP)
        elif name == "br":
            out.append(GAP if head else LINE)
        elif name in BLOCKS:
            out.append(GAP if head else BLOCK)
    out.append(text(page[at:]))
    settled = _RUN.sub(_settle, "".join(out)).translate(_LOOSE)
    return settled.rstrip() + "\n" if settled.strip() else ""


def html_text(pages: DataFrame, key: str, html: str | Column) -> DataFrame:
    """``key`` and text of every page."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if p is None else text_of_html(p) for p in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[key, "text"])

    body = html if isinstance(html, Column) else F.col(html)
    kind = pages.schema[key].dataType.simpleString()
    return pages.select(key, body.cast("string").alias("_html")).mapInArrow(read, f"`{key}` {kind}, text string")
