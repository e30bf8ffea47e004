"""Many texts as one flat numpy array: character classes, token boundaries and 64-bit span hashes.

The texts of a batch are laid end to end with one separator position after each text. Separators are
known by position, not by value, so any character may occur in the texts.
"""

from __future__ import annotations

import unicodedata
from functools import cache

import numpy as np

OTHER, LETTER, NUMBER, SPACE, BREAK = range(5)
_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


@cache
def kinds() -> np.ndarray:
    """Class of every code point: letter, number, white space or other."""
    import regex

    table = np.zeros(0x110000, np.uint8)
    for i in range(0x110000):
        c = unicodedata.category(chr(i))[0]
        if c == "L":
            table[i] = LETTER
        elif c == "N":
            table[i] = NUMBER
    for m in regex.finditer(r"\p{White_Space}", "".join(map(chr, range(0x3001)))):
        table[ord(m.group())] = SPACE
    return table


_tables: dict[str, np.ndarray] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64, at least ``n`` of each."""
    if len(_tables.get("up", ())) < n:
        inverse = np.uint64(pow(int(_M1), -1, 1 << 64))
        with np.errstate(over="ignore"):
            for name, base in (("up", _M1), ("down", inverse)):
                steps = np.full(n, base, np.uint64)
                steps[0] = 1
                _tables[name] = np.multiply.accumulate(steps)
    return _tables["up"], _tables["down"]


@cache
def _code_values() -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(np.arange(1, 0x110001, dtype=np.uint64) * _M1)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(30))
    h *= _M2
    h ^= h >> np.uint64(27)
    h *= _M3
    h ^= h >> np.uint64(31)
    return h


class Flat:
    """``text`` holds the batch with separators; ``codes``, ``kind`` its code points and classes."""

    def __init__(self, texts: list[str]) -> None:
        self.text = "\n".join([*texts, ""])
        self.codes = np.frombuffer(self.text.encode("utf-32-le", "surrogatepass"), np.uint32)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        self.breaks = np.cumsum(lengths + 1) - 1
        self.kind = kinds()[self.codes]
        self.kind[self.breaks] = BREAK

    def _contractions(self, start: np.ndarray) -> None:
        """'s 't 'm 'd 're 've 'll are tokens of their own where the apostrophe starts a token."""
        c, k = self.codes, self.kind
        at = np.flatnonzero(c == 39)
        at = at[start[at] & (k[at] == OTHER)]
        at = at[k[at + 1] == LETTER]
        if len(at):
            c1, c2 = c[at + 1], c[np.minimum(at + 2, len(c) - 1)]
            two = ((c1 == 114) & (c2 == 101)) | ((c1 == 118) & (c2 == 101)) | ((c1 == 108) & (c2 == 108))
            two &= k[np.minimum(at + 2, len(c) - 1)] == LETTER
            one = (c1 == 115) | (c1 == 116) | (c1 == 109) | (c1 == 100)
            for hit, size in ((one, 2), (two, 3)):
                start[at[hit] + 1] = False
                start[at[hit] + size] = True

    def byte_level_tokens(self) -> np.ndarray:
        """Starts of the tokens of the byte-level pattern; separators are tokens of their own."""
        k = self.kind
        start = np.empty(len(k), bool)
        start[0] = True
        np.not_equal(k[1:], k[:-1], out=start[1:])
        last = np.flatnonzero((k[:-1] == SPACE) & (k[1:] != SPACE) & (k[1:] != BREAK))
        start[last] = True
        start[last[self.codes[last] == 32] + 1] = False
        start[self.breaks] = True
        start[self.breaks[:-1] + 1] = True
        self._contractions(start)
        return np.flatnonzero(start)

    def word_tokens(self) -> np.ndarray:
        """Starts of letter runs, single numbers and runs of other signs; white space and separators stand between."""
        k = self.kind
        start = np.empty(len(k), bool)
        start[0] = True
        np.not_equal(k[1:], k[:-1], out=start[1:])
        start |= k == NUMBER
        start[self.breaks] = True
        start[self.breaks[:-1] + 1] = True
        self._contractions(start)
        return np.flatnonzero(start)

    def hashes(self, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Length and 64-bit hash of the span that begins at each start and ends at the next."""
        lengths = np.diff(starts, append=len(self.codes))
        return lengths, span_hashes(self.codes, starts, lengths)


def span_hashes(codes: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """A polynomial over random values of the code points, from differences of its running sum."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = _power_tables(1 << max(18, (len(codes) - 1).bit_length()))
    with np.errstate(over="ignore"):
        total = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum(_code_values()[codes] * up[: len(codes)], out=total[1:])
        h = (total[starts + lengths] - total[starts]) * down[starts]
        return mix(h ^ (lengths.astype(np.uint64) * _M3))


def gather(flat: np.ndarray, offsets: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """flat[offset : offset + length] of every pair, end to end."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.repeat(offsets - (ends - lengths), lengths) + np.arange(total)]


def deletion_hashes(codes: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(item, place, hash) of each of the items that stand end to end in ``codes``: whole (place -1) and without each of its code points.

    A prefix sum and a suffix sum, the latter moved back by one place, make the hash of a deletion.
    """
    up, down = _power_tables(1 << max(18, len(codes).bit_length()))
    starts = np.cumsum(lengths) - lengths
    item = np.repeat(np.arange(len(lengths)), lengths)
    at = np.arange(len(codes))
    with np.errstate(over="ignore"):
        total = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum(_code_values()[codes] * up[: len(codes)], out=total[1:])
        whole = (total[starts + lengths] - total[starts]) * down[starts]
        begin, end = starts[item], (starts + lengths)[item]
        less = ((total[at] - total[begin]) + (total[end] - total[at + 1]) * down[1]) * down[begin]
        hashes = np.concatenate([mix(whole ^ (lengths.astype(np.uint64) * _M3)), mix(less ^ ((lengths[item] - 1).astype(np.uint64) * _M3))])
    return np.concatenate([np.arange(len(lengths)), item]), np.concatenate([np.full(len(lengths), -1), at - starts[item]]), hashes
