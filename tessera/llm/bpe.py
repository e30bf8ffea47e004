"""BPE encoding and decoding by batched numpy merge rounds.

The symbols of many words lie in one flat array. In each round the adjacent pairs of all unfinished
words are looked up by binary search over sorted pair keys, every word takes its pair of lowest rank,
all occurrences of that pair in the word merge at once (left to right where they overlap), and words
without a known pair leave the array.

Nulls, empty and long texts: a null or empty text has no ids and decodes to the empty text; a text of any length is encoded
whole, in a run by itself. Each row is encoded by itself, so repeated rows and ids, null ids among them, come back as
they are. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.llm.common import text_of
from tessera.llm.encode import Store, chunks, vocabulary_path
from tessera.llm.flat import BREAK, SPACE, Flat, gather

_NONE = np.int64(1 << 60)


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies (fixed by that format)."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class MergeTable:
    """Vocabulary and merges of a BPE file as arrays."""

    def __init__(self, model: dict) -> None:
        self.vocabulary: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        size = max(self.vocabulary.values()) + 1
        self.shift = np.int64(size)
        left, right, made = [], [], []
        for pair in model["merges"]:
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            left.append(self.vocabulary[a])
            right.append(self.vocabulary[b])
            made.append(self.vocabulary[a + b])
        keys = np.array(left, np.int64) * self.shift + np.array(right, np.int64)
        # of a pair listed twice the later rank holds, as in a map
        order = np.lexsort((-np.arange(len(keys)), keys))
        order = order[np.diff(keys[order], prepend=-1) != 0]
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.made = np.array(made, np.int64)
        symbols = byte_symbols()
        self.inner = np.array([self.vocabulary.get(s, 0) for s in symbols], np.int64)
        self.last = np.array([self.vocabulary.get(s + self.suffix, 0) for s in symbols], np.int64)

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, or a number above all ranks; binary search over the sorted pair keys."""
        want = left * self.shift + right
        at = np.searchsorted(self.keys, want)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == want, self.ranks[at], _NONE)

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words end to end, and ids per word. Words are not empty."""
        raw = "".join(words).encode("utf-8", "surrogatepass")
        if len(raw) == sum(map(len, words)):
            sizes = np.fromiter(map(len, words), np.int64, len(words))
        else:
            sizes = np.fromiter((len(w.encode("utf-8", "surrogatepass")) for w in words), np.int64, len(words))
        data = np.frombuffer(raw, np.uint8)
        symbols = self.inner[data]
        ends = np.cumsum(sizes)
        symbols[ends - 1] = self.last[data[ends - 1]]
        word = np.repeat(np.arange(len(words)), sizes)
        ranks = self._ranks(symbols, word)
        done_symbols, done_word = [], []
        while len(symbols):
            begins = np.flatnonzero(np.diff(word, prepend=-1))
            lowest = np.minimum.reduceat(ranks, begins)
            counts = np.diff(begins, append=len(word))
            low = np.repeat(lowest, counts)
            open_ = low < _NONE
            if not open_.all():
                done_symbols.append(symbols[~open_])
                done_word.append(word[~open_])
                symbols, word, ranks, low = symbols[open_], word[open_], ranks[open_], low[open_]
                if not len(symbols):
                    break
            hit = np.flatnonzero(ranks == low)
            if len(hit) > 1:
                # a pair of equal symbols may overlap itself: of a run of hits side by side take every other
                new_run = np.diff(hit, prepend=-2) != 1
                first = np.maximum.accumulate(np.where(new_run, np.arange(len(hit)), 0))
                hit = hit[(np.arange(len(hit)) - first) % 2 == 0]
            symbols[hit] = self.made[low[hit]]
            keep = np.ones(len(symbols), bool)
            keep[hit + 1] = False
            place = np.cumsum(keep) - 1
            symbols, word, ranks = symbols[keep], word[keep], ranks[keep]
            # only pairs beside a merged symbol have a new rank
            touched = place[hit]
            touched = np.unique(np.concatenate([touched, touched[touched > 0] - 1]))
            after = np.minimum(touched + 1, len(symbols) - 1)
            fresh = self.pair_ranks(symbols[touched], symbols[after])
            fresh[(after == touched) | (word[after] != word[touched])] = _NONE
            ranks[touched] = fresh
        if not done_symbols:
            return np.zeros(0, np.uint32), np.zeros(len(words), np.int64)
        symbols, word = np.concatenate(done_symbols), np.concatenate(done_word)
        order = np.argsort(word, kind="stable")
        return symbols[order].astype(np.uint32), np.bincount(word, minlength=len(words))

    def _ranks(self, symbols: np.ndarray, word: np.ndarray) -> np.ndarray:
        ranks = np.full(len(symbols), _NONE)
        inside = np.flatnonzero(word[1:] == word[:-1])
        ranks[inside] = self.pair_ranks(symbols[inside], symbols[inside + 1])
        return ranks


@cache
def load_file(name: str) -> dict:
    with open(vocabulary_path(name), encoding="utf-8") as f:
        return json.load(f)


@cache
def merge_table(name: str) -> MergeTable:
    return MergeTable(load_file(name)["model"])


class WordEncoder:
    """Lower-cased word-level BPE with word-end symbols: ids, and the text decoded from the ids.

    Normalisation is NFC, runs of white space to one space, lower case per character. Tokens of the
    vocabulary's special strings are found in the raw text first. Decoding joins the vocabulary's
    strings by one space, as the library does for a file without a decoder.
    """

    def __init__(self, vocabulary: str) -> None:
        import regex

        file = load_file(vocabulary)
        self.table = merge_table(vocabulary)
        self.special = {t["content"]: t["id"] for t in file["added_tokens"]}
        self.split = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        names = {i: s for s, i in self.table.vocabulary.items()} | {i: s for s, i in self.special.items()}
        self.names = [names.get(i, "").encode() for i in range(max(names) + 1)]
        self.store = Store(self.table.encode, self._decoded)

    @staticmethod
    def normalise(text: str) -> str:
        text = unicodedata.normalize("NFC", text)
        # str.lower() looks at the neighbours of a capital sigma, lower-casing per character doesn't
        return (text.replace("Σ", "σ") if "Σ" in text else text).lower()

    def encode(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, list[bytes]]]:
        """(ids end to end, ids per text, decoded texts in UTF-8), for runs of the texts in turn."""
        for i, j in chunks(texts):
            yield self._encode(texts[i:j])

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        pieces: list[str] = []
        closing: list[int] = []  # special id after each piece; -1 at the end of a text
        for t in texts:
            begin = 0
            if self.split and "<" in t:
                for m in self.split.finditer(t):
                    pieces.append(t[begin : m.start()])
                    closing.append(self.special[m.group()])
                    begin = m.end()
            pieces.append(t[begin:] if begin else t)
            closing.append(-1)
        flat = Flat([self.normalise(p) for p in pieces])
        starts = flat.word_tokens()
        lengths, hashes = flat.hashes(starts)
        kind = flat.kind[starts]
        word = np.flatnonzero((kind != SPACE) & (kind != BREAK))
        slots = self.store.slots(flat.text, starts[word], lengths[word], hashes[word])
        # one entry per word, special token or end of text, in order
        close = np.array(closing, np.int64)
        at_break = np.flatnonzero(kind == BREAK)
        place = np.concatenate([word, at_break])
        order = np.argsort(place, kind="stable")
        specials = np.unique(close[close >= 0])
        pool = np.concatenate([specials.astype(np.uint32), self.store.ids])
        offset = np.concatenate([self.store.offsets[slots] + len(specials), np.searchsorted(specials, close)])[order]
        size = np.concatenate([self.store.lengths[slots], (close >= 0).astype(np.int64)])[order]
        ids = gather(pool, offset, size)
        ends = np.flatnonzero(np.concatenate([np.zeros(len(word), bool), close < 0])[order])
        counts = np.diff(np.cumsum(size)[ends], prepend=0)
        # decoded: slot of each entry; specials count down from -2, ends of texts are -1
        entry = np.concatenate([slots, np.where(close >= 0, -2 - close, -1)])[order].tolist()
        decoded, begin = [], 0
        store, names = self.store.described, self.names
        for e in ends.tolist():
            decoded.append(b" ".join([store[s] if s >= 0 else names[-2 - s] for s in entry[begin:e]]))
            begin = e + 1
        return ids, counts, decoded

    def _decoded(self, ids: np.ndarray, sizes: np.ndarray) -> list[bytes]:
        """Decoded bytes of each of the words whose ids these are."""
        names, ids, ends = self.names, ids.tolist(), np.cumsum(sizes).tolist()
        return [b" ".join([names[i] for i in ids[a:b]]) for a, b in zip([0, *ends], ends, strict=False)]


@cache
def word_encoder(vocabulary: str) -> WordEncoder:
    """One encoder, with its store, per worker process."""
    return WordEncoder(vocabulary)


def word_bpe(df: DataFrame, vocabulary: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_encoder(vocabulary)
        for batch in batches:
            begin = 0
            for ids, counts, decoded in encoder.encode(batch.column(1).to_pylist()):
                data = memoryview(ids.astype("<u4").tobytes())
                ends = (counts.cumsum() * 4).tolist()
                hashes = [hashlib.sha256(data[a:b]).hexdigest() for a, b in zip([0, *ends], ends, strict=False)]
                texts = [hashlib.sha256(d).hexdigest() for d in decoded]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(begin, len(counts)), pa.array(counts, pa.int64()), pa.array(hashes, pa.string()), pa.array(texts, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
                begin += len(counts)

    rows = df.select(df[doc_id].cast("long").alias("doc_id"), text_of(df, text).alias("text"))
    return rows.mapInArrow(digest, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
