"""Token ids of many texts at once.

Texts are cut into tokens of the pre-tokeniser in numpy, each distinct token is encoded once per
worker by a model (the tokenizers library, or the merge rounds in ``bpe``), and ids are gathered from
that store. The store is a speed-up only: it is emptied at a fixed size and results never depend on it.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pandas as pd

from tessera.llm.flat import BREAK, Flat, gather

#: Distinct tokens that a worker keeps before it starts anew (about 50 bytes each).
STORE_TOKENS = 300_000
#: Characters encoded at once.
BATCH_CHARS = 250_000
#: Distinct tokens given to the library as one text.
JOIN = 64


def vocabulary_path(name_or_path: str) -> str:
    """A file's path as given, or the place of a public vocabulary of that name."""
    if os.path.isabs(name_or_path):
        return name_or_path
    import public_tokenizers

    return str(public_tokenizers.path(name_or_path))


@cache
def load_tokenizer(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(vocabulary_path(path))
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


class Store:
    """Ids of distinct tokens by 64-bit hash, with what ``describe`` makes of the ids of each, if given.

    Tokens are told apart by their hash alone: that any two of a full store share one has a chance of about 2e-9.
    """

    def __init__(self, model: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], describe: Callable[[np.ndarray, np.ndarray], list] | None = None) -> None:
        self.model, self.describe = model, describe
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.slot = np.zeros(0, np.int64)
        self.offsets = np.zeros(0, np.int64)
        self.lengths = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)
        self.described: list = []

    def slots(self, text: str, starts: np.ndarray, lengths: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """The slot of every token; unknown ones are encoded first."""
        if len(self.keys) > STORE_TOKENS:
            self.clear()
        inverse, keys = pd.factorize(hashes)
        first = np.empty(len(keys), np.int64)
        first[inverse[::-1]] = np.arange(len(hashes) - 1, -1, -1)
        order = np.argsort(keys)
        keys, first = keys[order], first[order]
        rank = np.empty(len(keys), np.int64)
        rank[order] = np.arange(len(keys))
        at = np.searchsorted(self.keys, keys)
        known = np.zeros(len(keys), bool)
        if len(self.keys):
            known = self.keys[np.minimum(at, len(self.keys) - 1)] == keys
        new = np.flatnonzero(~known)
        if len(new):
            where = first[new]
            a, b = starts[where].tolist(), (starts[where] + lengths[where]).tolist()
            ids, sizes = self.model([text[i:j] for i, j in zip(a, b, strict=True)])
            slot = len(self.offsets) + np.arange(len(new))
            self.offsets = np.concatenate([self.offsets, len(self.ids) + np.cumsum(sizes) - sizes])
            self.lengths = np.concatenate([self.lengths, sizes])
            self.ids = np.concatenate([self.ids, ids])
            if self.describe:
                self.described += self.describe(ids, sizes)
            self.slot = np.insert(self.slot, at[new], slot)
            self.keys = np.insert(self.keys, at[new], keys[new])
            at = np.searchsorted(self.keys, keys)
        return self.slot[at][rank][inverse]


def chunks(texts: list[str], most: int = BATCH_CHARS) -> Iterator[tuple[int, int]]:
    """Runs of whole texts of about ``most`` characters; a longer text is a run by itself."""
    begin = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield begin, i
            begin, size = i, 0
        size += len(t) + 1
    if begin < len(texts):
        yield begin, len(texts)


def library_model(tokenizer) -> Callable[[list[str]], tuple[np.ndarray, np.ndarray]]:
    """Encode distinct tokens, many in one text: a line feed between two tokens is a token of its own.

    Tokens with white space at an end, and runs that don't come back as they were joined, are
    encoded one by one.
    """

    feed = tokenizer.encode("\n", add_special_tokens=False).ids[0]

    def alone(words: list[str]) -> tuple[list[int], list[int]]:
        found = [e.ids for e in tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        return [i for x in found for i in x], [len(x) for x in found]

    def joined(words: list[str]) -> tuple[list, list]:
        runs = [words[i : i + JOIN] for i in range(0, len(words), JOIN)]
        ids, sizes = [], []
        for run, e in zip(runs, tokenizer.encode_batch_fast(["\n".join(r) for r in runs], add_special_tokens=False), strict=True):
            got = np.array(e.ids, np.uint32)
            between = np.flatnonzero(got == feed)
            if len(between) == len(run) - 1:
                ids.append(got[got != feed])
                sizes.append(np.diff(between, prepend=-1, append=len(got)) - 1)
            else:
                one = alone(run)
                ids.append(np.array(one[0], np.uint32))
                sizes.append(np.array(one[1], np.int64))
        return ids, sizes

    def run(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        simple = np.fromiter((not w.lstrip(" ")[:1].isspace() and bool(w.strip()) for w in words), bool, len(words))
        sizes = np.zeros(len(words), np.int64)
        a_ids, a_sizes = joined([w for w, s in zip(words, simple, strict=True) if s])
        b_ids, b_sizes = alone([w for w, s in zip(words, simple, strict=True) if not s])
        sizes[simple] = np.concatenate([*a_sizes, np.zeros(0, np.int64)])
        sizes[~simple] = b_sizes
        flat = np.concatenate([*a_ids, np.array(b_ids, np.uint32)]).astype(np.uint32)
        stored = np.concatenate([np.flatnonzero(simple), np.flatnonzero(~simple)])
        ends = np.cumsum(sizes[stored])
        offsets = np.empty(len(words), np.int64)
        offsets[stored] = ends - sizes[stored]
        return gather(flat, offsets, sizes), sizes

    return run


class ByteLevelEncoder:
    """Byte-level BPE ids with an end id after each text, equal to the tokenizers library's."""

    def __init__(self, vocabulary: str, end_id: int = 0) -> None:
        self.tokenizer = load_tokenizer(vocabulary)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.store = Store(library_model(self.tokenizer))
        self.end_id = end_id
        self.vocabulary_size = self.tokenizer.get_vocab_size(with_added_tokens=True)

    def encode(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(ids end to end, ids per text), for runs of the texts in turn."""
        for i, j in chunks(texts):
            yield self._encode(texts[i:j])

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        direct = {i for i, t in enumerate(texts) if any(s in t for s in self.special)}
        flat = Flat(["" if i in direct else t for i, t in enumerate(texts)] if direct else texts)
        starts = flat.byte_level_tokens()
        lengths, hashes = flat.hashes(starts)
        ends = flat.kind[starts] == BREAK
        real = ~ends
        slots = self.store.slots(flat.text, starts[real], lengths[real], hashes[real])
        sizes = np.ones(len(starts), np.int64)
        sizes[real] = self.store.lengths[slots]
        offsets = np.zeros(len(starts), np.int64)
        offsets[real] = self.store.offsets[slots] + 1
        ids = gather(np.concatenate([np.array([self.end_id], np.uint32), self.store.ids]), offsets, sizes)
        upto = np.cumsum(sizes)[np.flatnonzero(ends)]
        counts = np.diff(upto, prepend=0)
        if direct:
            parts, begin = [], 0
            for i, n in enumerate(counts.tolist()):
                if i in direct:
                    own = self.tokenizer.encode(texts[i], add_special_tokens=False).ids
                    parts.append(np.array([*own, self.end_id], np.uint32))
                    counts[i] = len(own) + 1
                else:
                    parts.append(ids[begin : begin + n])
                begin += n
            ids = np.concatenate(parts)
        return ids, counts


@cache
def byte_level_encoder(vocabulary: str, end_id: int = 0) -> ByteLevelEncoder:
    """One encoder, with its store, per worker process."""
    return ByteLevelEncoder(vocabulary, end_id)
