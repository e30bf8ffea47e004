"""Word shingles of many texts at once, as 64-bit hashes, and MinHash signatures of the sets.

Words are ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z lower-cased, taken on UTF-8 bytes. A set holds
the distinct shingles of ``width`` words; a text with fewer words has its whole word sequence as one
shingle, a text without words has none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from tessera.llm.flat import mix, span_hashes

_C = np.uint64(0x9E3779B97F4A7C15)
_WHITE = np.zeros(256, bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def shingle_sets(texts: list[str | None], width: int = 3, chunk_bytes: int = 400_000) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text, in order."""
    begin = size = 0
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    for i, t in enumerate(raw):
        if size and size + len(t) > chunk_bytes:
            yield from _sets(raw[begin:i], width)
            begin, size = i, 0
        size += len(t) + 1
    if begin < len(raw):
        yield from _sets(raw[begin:], width)


def _sets(raw: list[bytes], width: int) -> Iterator[np.ndarray]:
    data = _LOWER[np.frombuffer(b"\n".join([*raw, b""]), np.uint8)]
    ends = np.cumsum(np.fromiter((len(t) + 1 for t in raw), np.int64, len(raw)))
    white = _WHITE[data]
    inside = ~white
    starts = np.flatnonzero(inside & np.concatenate([[True], white[:-1]]))
    stops = np.flatnonzero(inside & np.concatenate([white[1:], [True]])) + 1
    words = span_hashes(data, starts, stops - starts)
    upto = np.searchsorted(starts, ends)
    first = 0
    with np.errstate(over="ignore"):
        if len(words) >= width:
            rolled = words[: len(words) - width + 1].copy()
            for k in range(1, width):
                rolled = rolled * _C + words[k : len(words) - width + 1 + k]
            rolled = mix(rolled)
    for last in upto.tolist():
        n = last - first
        if n >= width:
            yield np.unique(rolled[first : last - width + 1])
        elif n:
            h = np.uint64(n)
            with np.errstate(over="ignore"):
                for w in words[first:last]:
                    h = h * _C + w
            yield mix(np.array([h], np.uint64))
        else:
            yield np.zeros(0, np.uint64)
        first = last


def hash_family(n: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(1, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, n, dtype=np.uint64)


def signatures(sets: list[np.ndarray], n: int) -> np.ndarray:
    """MinHash signatures (uint32, one row per non-empty set) by multiply-add hashing of the shingle hashes."""
    a, b = hash_family(n)
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    begins = np.cumsum(sizes) - sizes
    out = np.empty((len(sets), n), np.uint32)
    with np.errstate(over="ignore"):
        for i in range(n):
            out[:, i] = np.minimum.reduceat(((flat * a[i] + b[i]) >> np.uint64(32)).astype(np.uint32), begins)
    return out


def overlap(left: np.ndarray, right: np.ndarray) -> int:
    """Size of the intersection of two sorted distinct arrays."""
    if len(left) > len(right):
        left, right = right, left
    at = np.searchsorted(right, left)
    at[at == len(right)] = 0
    return int((right[at] == left).sum()) if len(right) else 0
