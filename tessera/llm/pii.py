"""Personal data in texts.

Regular expressions propose spans, checksums confirm them (Luhn for cards, mod-97 for IBANs, the 7-3-1 digits of passports' machine-readable
lines, parts of at most 255 for addresses), and words near a span move its score up or down. The base kinds (email,
ip, card, phone) are reported whenever their pattern and check hold; the kinds that the method adds
(iban, ssn, passport, key) are reported when their score reaches ``threshold``. Every span carries its score. Matches of one kind are leftmost and
don't overlap; a proposal that fails its check is dropped and not tried again.

Nulls, empty and long texts: a null text counts as empty and has no spans; whole texts are scanned,
every scan takes time in proportion to the text. Repeated rows are each scanned. An empty table gives
no rows. Columns of the table keep their names; the operator's column is named by the caller.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import text_of

#: Order of kinds in digests; the first four are the base kinds.
KINDS = ("email", "ip", "card", "phone", "iban", "ssn", "passport", "key")
BASE = 4
#: Reach of context words to either side, in characters, and their weight.
REACH, WEIGHT = 40, 0.25
THRESHOLD = 0.6

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
#: Second line of a passport's machine-readable zone; access keys and private keys by their fixed beginnings.
_PASSPORT = re.compile(r"(?<![A-Z0-9<])[A-Z0-9<]{9}[0-9][A-Z<]{3}[0-9]{7}[MFX<][0-9]{7}[A-Z0-9<]{14}[0-9<][0-9](?![A-Z0-9<])")
_KEY = re.compile(r"(?<![A-Za-z0-9])(?:A(?:KIA|SIA)[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|-----BEGIN (?:[A-Z]{1,10} ){0,3}PRIVATE KEY-----)(?![A-Za-z0-9])")
#: Length of an IBAN by country (fixed values); of other countries the whole match must hold.
IBAN_LENGTHS = {"AT": 20, "BE": 16, "BG": 22, "CH": 21, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "EE": 20, "ES": 24, "FI": 18, "FR": 27, "GB": 22, "GR": 27, "HR": 21, "HU": 28, "IE": 22, "IS": 26, "IT": 27, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MT": 31, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "RO": 24, "SE": 24, "SI": 19, "SK": 24, "TR": 26}
_DIGITS = re.compile(r"[0-9]")
_SUPPORT = {
    "email": re.compile(r"\b(?:e-?mail|contact|mail|reach|write)\b", re.I),
    "ip": re.compile(r"\b(?:ip|address|host|server|login)\b", re.I),
    "card": re.compile(r"\b(?:card|visa|mastercard|amex|credit|debit|payment)\b", re.I),
    "phone": re.compile(r"\b(?:phone|tel|telephone|call|mobile|fax|cell)\b", re.I),
    "iban": re.compile(r"\b(?:iban|bank|account|konto|transfer)\b", re.I),
    "ssn": re.compile(r"\b(?:ssn|social security|security number)\b", re.I),
    "passport": re.compile(r"\b(?:passport|travel document|mrz)\b", re.I),
    "key": re.compile(r"\b(?:key|secret|token|credential|aws|github)\b", re.I),
}
_AGAINST = re.compile(r"\b(?:example|sample|dummy|version|isbn|serial|order)\b", re.I)
_PRIOR = {"email": 0.9, "ip": 0.7, "card": 0.8, "phone": 0.7, "iban": 0.8, "ssn": 0.45, "passport": 0.8, "key": 0.85}


class Span(NamedTuple):
    kind: str
    start: int
    end: int
    score: float


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def mod97(iban: str) -> bool:
    """Letters become two digits, the first four characters go last, the remainder must be 1."""
    rest = 0
    for c in iban[4:] + iban[:4]:
        v = int(c, 36)
        rest = (rest * (100 if v > 9 else 10) + v) % 97
    return rest == 1


def passport_line(line: str) -> bool:
    """Check digits of number, birth date, expiry, personal number and of all four: weights 7, 3, 1, remainder by 10."""

    def digit(part: str) -> int:
        return sum((0 if c == "<" else int(c, 36)) * (7, 3, 1)[i % 3] for i, c in enumerate(part)) % 10

    checks = ((line[:9], line[9]), (line[13:19], line[19]), (line[21:27], line[27]), (line[28:42], line[42]), (line[:10] + line[13:20] + line[21:43], line[43]))
    return all(digit(part) == (0 if c == "<" else int(c)) for part, c in checks)


def iban_end(match: str) -> int:
    """Length of the IBAN that a match begins with, spaces included; 0 if there is none.

    A match may run on into further words; it ends where the country's length is reached.
    """
    want = IBAN_LENGTHS.get(match[:2])
    end, n = len(match), len(match.replace(" ", ""))
    if want and n > want:
        seen = 0
        for end, c in enumerate(match, 1):  # noqa: B007
            seen += c != " "
            if seen == want:
                break
        if match[end : end + 1] not in ("", " "):
            return 0
        n = want
    return end if 15 <= n <= 34 and (not want or n == want) and mod97(match[:end].replace(" ", "")) else 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """A match has exactly one ``@``: the run of local characters before it, and a dotted domain after it.

    The local part is found by scanning back from the sign, so a long run without one costs nothing.
    """
    free, at = 0, text.find("@")
    while at >= 0:
        domain = _DOMAIN.match(text, at + 1)
        if domain:
            start = at
            while start > free and text[start - 1] in _LOCAL:
                start -= 1
            if start < at:
                yield start, domain.end()
                free = domain.end()
        at = text.find("@", max(at + 1, free))


def _proposals(text: str) -> Iterator[tuple[str, int, int]]:
    for m in _KEY.finditer(text):
        yield "key", *m.span()
    if "@" in text:
        for a, b in emails(text):
            yield "email", a, b
    if _DIGITS.search(text) is None:
        return
    if "." in text:
        for m in _IP.finditer(text):
            if all(int(p[-4:]) <= 255 and (len(p) < 4 or not p[:-3].strip("0")) for p in m.group().split(".")):
                yield "ip", *m.span()
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = m.group().replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                yield "card", *m.span()
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(_DIGITS.findall(m.group())) <= 15:
                yield "phone", *m.span()
    for m in _IBAN.finditer(text):
        if n := iban_end(m.group()):
            yield "iban", m.start(), m.start() + n
    if "<" in text:
        for m in _PASSPORT.finditer(text):
            if passport_line(m.group()):
                yield "passport", *m.span()
    if "-" in text:
        for m in _SSN.finditer(text):
            area, group, serial = m.group().split("-")
            if area not in ("000", "666") and area < "900" and group != "00" and serial != "0000":
                yield "ssn", *m.span()


def find(text: str, threshold: float = THRESHOLD) -> list[Span]:
    """All spans by start, then kind as listed in ``KINDS``."""
    out = []
    for kind, a, b in _proposals(text):
        near = f"{text[max(0, a - REACH) : a]} {text[b : b + REACH]}"
        score = _PRIOR[kind] + WEIGHT * bool(_SUPPORT[kind].search(near)) - WEIGHT * bool(_AGAINST.search(near))
        if kind in KINDS[:BASE] or score >= threshold:
            out.append(Span(kind, a, b, round(min(1.0, max(0.0, score)), 4)))
    return sorted(out, key=lambda s: (s.start, KINDS.index(s.kind), s.end))


def redact(text: str, spans: list[Span]) -> str:
    """The text with every span replaced by ``[KIND]``; of overlapping spans the first and longest names the gap."""
    out, at = [], 0
    for s in sorted(spans, key=lambda s: (s.start, -s.end)):
        if s.end <= at:
            continue
        if s.start >= at:
            out += [text[at : s.start], f"[{s.kind.upper()}]"]
        at = s.end
    return "".join([*out, text[at:]])


SPANS = "array<struct<kind:string,start:int,end:int,score:double>>"


def pii_spans(df: DataFrame, text: str = "text", out: str = "pii", threshold: float = THRESHOLD) -> DataFrame:
    """``df`` with its spans in column ``out``."""

    @F.pandas_udf(SPANS)
    def spans(texts):
        import pandas as pd

        return pd.Series([[tuple(s) for s in find(t, threshold)] for t in texts])

    return df.withColumn(out, spans(text_of(df, text)))


def redact_pii(df: DataFrame, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``df`` with every span of its texts replaced; a null text stays null."""

    @F.pandas_udf("string")
    def clean(texts):
        import pandas as pd

        return pd.Series([redact(t, s) if t is not None and (s := find(t, threshold)) else t for t in texts])

    return df.withColumn(text, clean(df[text].cast("string")))


def pii_digest(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts and digests of the spans per document; ``scores`` lists the spans' scores in their order."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: list[list[int]] = [[] for _ in range(BASE)]
            sha, listed, scores = [], [], []
            for t in batch.column(1).to_pylist():
                found = find(t)
                names = [s.kind for s in found]
                for kind, n in zip(KINDS, counts, strict=False):
                    n.append(names.count(kind))
                scores.append(",".join(f"{s.score:.2f}" for s in found))
                listed.append(",".join(f"{s.kind}:{s.start}:{s.end}" for s in found))
                base = listed[-1] if len(found) == sum(n[-1] for n in counts) else ",".join(f"{s.kind}:{s.start}:{s.end}" for s in found if s.kind in KINDS[:BASE])
                sha.append(hashlib.sha256(base.encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(n, pa.int64()) for n in counts), pa.array(sha, pa.string()), pa.array(listed, pa.string()), pa.array(scores, pa.string())], names=["doc_id", *(f"n_{k}" for k in KINDS[:BASE]), "base_sha256", "spans", "scores"])

    rows = df.select(df[doc_id].cast("long").alias("doc_id"), text_of(df, text).alias("text"))
    return rows.mapInArrow(digest, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, scores string")
