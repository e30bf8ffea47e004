"""Toxicity scores from restored texts.

Noisy channel: writers hide words by look-alike signs, spacing and repetition. A hidden word is decoded
by Viterbi over the lattice of what each sign may stand for, weighed by a character trigram model of
the whole corpus. Scores come from the restored text.

Scorer: distinct words and word beginnings of labelled documents, with the number of toxic and clean
documents that have them. Documents that share their least shingle hash count once, so groups of copies
don't make evidence. A beginning is evidence when so many toxic documents would be improbable by chance
among all beginnings tried. A document's score is that of its strongest evidence, and rises with more.

The fit uses at most ``FIT_TOXIC`` toxic and ``FIT_CLEAN`` clean labelled rows (those of least hash);
everything else covers all documents and their whole texts. Each sampled row stands for the labelled rows
of its class per sampled one, so shares are those of all labelled rows whatever the limits cut.

Nulls, ties and repeated rows: a null or empty text has the base score. Labels with nulls are left out;
a document with several labels counts as toxic if one says so. Without labels, all have the base score.
An empty table gives no rows. Other columns are ignored, or kept by ``drop_toxic``.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Scratch, give_back, text_of

FIT_TOXIC, FIT_CLEAN = 6_000, 12_000
THRESHOLD = 0.7
BASE = 0.03
#: Share of toxic documents among those with a beginning from which it can condemn a document by itself. Chosen on training rows
#: alone: fitted on one half of them, 0.90 to 0.98 condemn the other half alike, below that precision falls.
SURE = 0.95
SHORTEST, LONGEST = 4, 7
#: Whole words from this length on are evidence, though they have no beginning of their own.
WHOLE = 2
#: Signs that stand for letters in disguised words (fixed values of the channel model).
LOOKS_LIKE = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i", "*": "aeiou"}
#: Letters of other scripts that look like a Latin one (fixed values); they count as disguise only beside Latin letters.
OTHER_SCRIPTS = {"а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "һ": "h", "в": "b", "к": "k", "м": "m", "н": "h", "т": "t", "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x"}
#: Log-probabilities of the channel.
KEEP, CHANGE, DROP_REPEAT, DROP_SIGN = 0.0, -1.0, -0.7, -0.5
_LETTERS = "abcdefghijklmnopqrstuvwxyz"
_SIZE = len(_LETTERS) + 1  # and the word edge, 0

_WORD = re.compile(r"[^\W\d_]+")
_SPELLED = re.compile(r"(?<![^\W_])[^\W_](?:([ .\-_*])[^\W_])(?:\1[^\W_])+(?![^\W_])")
_INSIDE, _BEFORE, _AFTER = re.compile(r"[0-9@$!|+(€£¡*._\-]"), re.compile(r"[0-9@$!|+€£¡*]"), re.compile(r"[0-9@$]")
_THRICE = re.compile(r"([^\W\d_])\1\1")
_TWICE, _LETTER, _SIGN = re.compile(r"([^\W\d_])\1"), re.compile(r"[^\W\d_]"), re.compile(f"[{re.escape(''.join(LOOKS_LIKE))}]")
_RUN, _STANDS_FOR = re.compile(r"(.)\1+"), re.compile(f"[{re.escape(''.join(LOOKS_LIKE))}{''.join(OTHER_SCRIPTS)}]")
_LATIN, _OTHER = re.compile("[a-z]"), re.compile(f"[{''.join(OTHER_SCRIPTS)}]")
#: Pieces remembered by a worker, and the longest of them.
REMEMBERED, REMEMBERED_CHARS = 200_000, 40


@cache
def _plain() -> dict[int, str]:
    """Letters with marks as the bare letter."""
    out = {}
    for i in range(0xC0, 0x250):
        base = unicodedata.normalize("NFD", chr(i).lower())[0]
        if base in _LETTERS:
            out[i] = base
    return out


@cache
def _codes() -> np.ndarray:
    table = np.zeros(0x250, np.int64)
    for i, c in enumerate(_LETTERS):
        table[ord(c)] = table[ord(c.upper())] = i + 1
    for i, c in _plain().items():
        table[i] = _LETTERS.index(c) + 1
    return table


def count_trigrams(texts: list[str]) -> np.ndarray:
    """Counts of letter trigrams; anything that is no letter is a word edge."""
    codes = np.frombuffer("  ".join(["", *texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    at = np.where(codes < 0x250, _codes()[np.minimum(codes, 0x24F)], 0)
    if len(at) < 3:
        return np.zeros(_SIZE**3, np.int64)
    return np.bincount((at[:-2] * _SIZE + at[1:-1]) * _SIZE + at[2:], minlength=_SIZE**3)


class CharModel:
    """Interpolated trigram log-probabilities of letters and the word edge."""

    def __init__(self, counts: np.ndarray) -> None:
        three = counts.reshape(_SIZE, _SIZE, _SIZE).astype(float)
        three[0, 0, 0] = 0
        two, one = three.sum(0), three.sum((0, 1))
        p1 = (one + 1) / (one.sum() + _SIZE)
        p2 = (two + 5 * p1) / (two.sum(1, keepdims=True) + 5)
        p3 = (three + 5 * p2[None]) / (three.sum(2, keepdims=True) + 5)
        self.table = np.log(p3).tolist()
        self.memo: dict[str, str] = {}

    def forget(self) -> None:
        """Give back what a task remembered; workers live on for other stages."""
        self.memo.clear()

    def decode(self, word: str) -> str:
        """The likeliest letters behind a disguised word: Viterbi over the last two letters."""
        if word in self.memo:
            return self.memo[word]
        states: dict[tuple[int, int], tuple[float, object]] = {(0, 0): (0.0, None)}
        before = ""
        for c in word:
            c = chr(o) if (o := ord(c)) not in _plain() else _plain()[o]
            options = [(_LETTERS.index(c) + 1, KEEP)] if c in _LETTERS else [(_LETTERS.index(x) + 1, CHANGE) for x in LOOKS_LIKE.get(c) or OTHER_SCRIPTS.get(c, "")]
            drop = DROP_REPEAT if c == before and options else None if options and c not in "!|+(*" else DROP_SIGN
            after: dict[tuple[int, int], tuple[float, object]] = {}
            for (a, b), (score, path) in states.items():
                if drop is not None:
                    s = score + drop
                    if (a, b) not in after or after[a, b][0] < s:
                        after[a, b] = (s, path)
                row = self.table[a][b]
                for letter, cost in options:
                    s = score + row[letter] + cost
                    if (b, letter) not in after or after[b, letter][0] < s:
                        after[b, letter] = (s, (letter, path))
            states, before = after, c
        _, path = max(((s + self.table[a][b][0], p) for (a, b), (s, p) in states.items()), key=lambda x: x[0])
        letters = []
        while path is not None:
            letters.append(_LETTERS[path[0] - 1])
            path = path[1]
        out = "".join(reversed(letters))
        if len(word) <= REMEMBERED_CHARS:
            if len(self.memo) >= REMEMBERED // 4:
                self.memo.clear()
            self.memo[word] = out
        return out


def looks_odd(piece: str) -> bool:
    """Whether a lower-cased piece without spaces may hide a word; time is linear in its length.

    Odd are: a sign between letters, a sign before or a digit after two letters, a letter three times.
    """
    runs = [m.span() for m in _WORD.finditer(piece)]
    if not runs:
        return False
    if _INSIDE.search(piece, runs[0][0] + 1, runs[-1][1] - 1) or _THRICE.search(piece):
        return True
    pairs = [r for r in runs if r[1] - r[0] > 1]
    return bool(pairs) and bool(_BEFORE.search(piece, 0, pairs[-1][1] - 2) or _AFTER.search(piece, pairs[0][0] + 2))


def may_hide(piece: str) -> bool:
    """Whether a piece goes through the lattice: odd ones, a doubled letter, a look-alike sign with a letter, scripts mixed."""
    return bool(_TWICE.search(piece) or (_LATIN.search(piece) and _OTHER.search(piece)) or (_SIGN.search(piece) and _LETTER.search(piece))) or looks_odd(piece)


def squeezed(word: str) -> str:
    """A word with each run of one letter as a single one."""
    return _RUN.sub(r"\1", word)


def may_reach(piece: str, reach: set[str]) -> bool:
    """Whether any decoding of a piece may give evidence; ``reach`` has the evidence squeezed.

    Without signs or letters that stand for others, decoding only drops signs and repeats, so what it gives squeezes to the same letters as the piece.
    """
    if _STANDS_FOR.search(piece):
        return True
    bare = squeezed("".join(c for c in piece.translate(_plain()) if c in _LETTERS))
    return bare in reach or any(bare[:n] in reach for n in range(1, LONGEST + 1))


def piece_words(piece: str, model: CharModel, reach: set[str] | None = None) -> list[str]:
    """Words of at least WHOLE letters in a piece without spaces, and the one that it may hide (of interest only if ``reach`` may be met)."""
    words = [w for w in _WORD.findall(piece) if len(w) >= WHOLE]
    if may_hide(piece) and (reach is None or may_reach(piece, reach)):
        found = model.decode(piece.strip(".,;:?\"')[]{}«»"))
        if len(found) >= WHOLE:
            words.append(found)
    return words


def _cleaned(text: str) -> str:
    return unicodedata.normalize("NFKC", text).lower().replace("\u200b", "").replace("\u00ad", "")


def spelled_words(text: str, model: CharModel) -> Iterator[str]:
    """Words spelled letter by letter in a cleaned text: word edges are lost, so every beginning counts."""
    for m in _SPELLED.finditer(text):
        found = model.decode(m.group().replace(m.group(1), ""))
        yield from (found[i : i + LONGEST] for i in range(max(1, len(found) - SHORTEST + 1)))


def restored_words(text: str, model: CharModel) -> set[str]:
    """Distinct words of at least WHOLE letters, with those decoded from disguises."""
    text = _cleaned(text)
    words = {w for piece in set(text.split()) for w in piece_words(piece, model)}
    words.update(spelled_words(text, model))
    return words


def beginnings(words: set[str]) -> set[str]:
    return {w[:n] for w in words for n in range(SHORTEST, LONGEST + 1) if len(w) >= n} | words


def corpus_model(docs: DataFrame) -> CharModel:
    """Trigram counts over all texts: one row per trigram and task, summed in Spark to at most 27**3 rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tessera.llm.encode import chunks

        total = np.zeros(_SIZE**3, np.int64)
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for i, j in chunks(texts, 200_000):
                total += count_trigrams(texts[i:j])
        give_back()
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["gram", "n"])

    rows = docs.select("text").mapInArrow(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(_SIZE**3, np.int64)
    counts[rows["gram"].to_numpy()] = rows["n"].to_numpy()
    return CharModel(counts)


def _tail(t: int, n: int, p: float) -> float:
    """log10 of the chance of at least t successes in n trials."""
    logs = [math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p) for k in range(t, min(n, t + 60) + 1)]
    top = max(logs)
    return (top + math.log(sum(math.exp(x - top) for x in logs))) / math.log(10)


def fit(docs: DataFrame, labels: DataFrame, model: CharModel) -> dict[str, float]:
    """Evidence of beginnings: the chance that a document with it is toxic. ``docs`` has doc_id and text."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "toxicity")
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter("toxic in (0, 1) and doc_id is not null")
    rows = rows.filter((F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3) != 1).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    eligible = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    of_toxic, of_clean = (max(1.0, eligible.get(y, 0) / n) for y, n in ((1, FIT_TOXIC), (0, FIT_CLEAN)))
    some = [rows.filter(f"toxic = {y}").orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for y, n in ((1, FIT_TOXIC), (0, FIT_CLEAN))]
    some = scratch.table(some[0].unionByName(some[1]), "chosen")
    shared = spark.sparkContext.broadcast(model)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tessera.llm.shingles import shingle_sets

        for batch in batches:
            toxic, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            least = [int(s[0].astype(np.int64)) if len(s) else 0 for s in shingle_sets(texts)]
            words = [sorted(beginnings(restored_words(t, shared.value))) for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array(toxic, pa.int32()), pa.array(least, pa.int64()), pa.array(words, pa.list_(pa.string()))], names=["toxic", "least", "words"])
        shared.value.forget()

    # the chosen rows are few (see the two limits), so they are sent to the documents
    chosen = docs.join(F.broadcast(some), "doc_id").select("toxic", "text").mapInArrow(features, "toxic int, least long, words array<string>")
    chosen = scratch.table(chosen.dropDuplicates(["toxic", "least"]), "features")
    totals = {r["toxic"]: r["n"] for r in chosen.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n_toxic, n_clean = totals.get(1, 0), totals.get(0, 0)
    if not n_toxic or not n_clean:
        return {}
    counts = chosen.select("toxic", F.explode("words").alias("word")).groupBy("word").agg(F.sum("toxic").alias("t"), F.count("*").alias("n")).filter("n >= 3")
    tried = counts.count()
    share = n_toxic / (n_toxic + n_clean)
    true_share = of_toxic * n_toxic / (of_toxic * n_toxic + of_clean * n_clean)
    evidence = {}
    # a subset of the bounded sample's words: those that are mostly in toxic documents
    for r in counts.filter(f"t >= 3 and t * {of_toxic} > (t * {of_toxic} + (n - t) * {of_clean}) * {0.5 + true_share / 2}").collect():
        # chance is judged on the rows as drawn, shares on what they stand for
        doubt = _tail(r["t"], r["n"], share) + math.log10(tried)
        toxic, clean = of_toxic * r["t"], of_clean * (r["n"] - r["t"])
        p = (toxic + of_toxic / 2) / (toxic + clean + (of_toxic + of_clean) / 2)
        if doubt > -1.5:
            p = min(p, 0.2 + 0.1 * max(0.0, min(4.0, 2.5 - doubt)))
        elif toxic < SURE * (toxic + clean):
            p = min(p, 0.6)
        evidence[r["word"]] = p
    return evidence


def word_evidence(word: str, evidence: dict[str, float]) -> float:
    """The strongest evidence of a word's beginnings and of the word itself; 0 if none."""
    best = evidence.get(word, 0.0)
    for n in range(SHORTEST, min(LONGEST, len(word)) + 1):
        best = max(best, evidence.get(word[:n], 0.0))
    return best


def combined(hits: list[float]) -> float:
    """The score of a document with this evidence: its strongest, raised by further strong ones."""
    if not hits:
        return BASE
    top = max(hits)
    strong = sum(h > 0.6 for h in hits)
    return min(1.0, max(BASE, top + (1 - top) * (1 - 0.8 ** max(0, strong - 1))))


def score_text(text: str, model: CharModel, evidence: dict[str, float], memo: dict[str, tuple], reach: set[str] | None = None) -> float:
    """The score of a text; ``reach`` (the evidence squeezed) spares decodings that can't give any, ``memo`` keeps the evidence found in each piece (mostly none), so a piece is decoded once a task."""
    text = _cleaned(text)
    hits: dict[str, float] = {}
    for piece in set(text.split()):
        found = memo.get(piece)
        if found is None:
            found = tuple((w, best) for w in piece_words(piece, model, reach) if (best := word_evidence(w, evidence)))
            if len(piece) <= REMEMBERED_CHARS:
                if len(memo) >= REMEMBERED:
                    memo.clear()
                memo[piece] = found
        hits.update(found)
    for w in spelled_words(text, model):
        if best := word_evidence(w, evidence):
            hits[w] = best
    return combined(list(hits.values()))


class Scorer:
    """A fitted scorer; small enough to broadcast: its size is bounded by the sample and the trigram table."""

    def __init__(self, docs: DataFrame, labels: DataFrame) -> None:
        model = corpus_model(docs)
        self.shared = docs.sparkSession.sparkContext.broadcast((model, fit(docs, labels, model)))

    def column(self, text):
        shared = self.shared

        @F.pandas_udf("double")
        def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            model, evidence = shared.value
            memo: dict[str, tuple] = {}
            reach = {squeezed(w) for w in evidence}
            for texts in batches:
                yield pd.Series([score_text(t, model, evidence, memo, reach) if t else BASE for t in texts], dtype=float)
            model.forget()
            memo.clear()
            give_back()

        return score(text)


def toxicity_scores(df: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted of every row; learns from the rows of ``labels`` that aren't held out."""
    docs = df.select(df[doc_id].cast("long").alias("doc_id"), text_of(df, text).alias("text"))
    scorer = Scorer(docs, labels)
    held = F.coalesce((F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3) == 1, F.lit(False))
    return docs.select("doc_id", held.alias("held_out"), scorer.column(F.col("text")).alias("score")).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def drop_toxic(df: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``df`` that score below ``threshold``, with their columns."""
    scorer = Scorer(df.select(df[doc_id].cast("long").alias("doc_id"), text_of(df, text).alias("text")), labels)
    return df.filter(scorer.column(text_of(df, text)) < threshold)
