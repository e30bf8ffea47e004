"""Column functions shared by the graph operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fold_key(s: Column) -> Column:
    """Lower case, Unicode white space collapsed to one space, trimmed."""
    return F.lower(F.trim(F.regexp_replace(s, r"(?U)\s+", " ")))


def fold(s: Column) -> Column:
    """Lower case, trimmed; inner white space stays."""
    return F.lower(F.regexp_replace(s, r"(?U)^\s+|\s+$", ""))


def same_text(a: Column, b: Column) -> Column:
    return fold(a) == fold(b)


def holds(haystack: Column, needle: str) -> Column:
    """Case-insensitive substring."""
    return F.lower(haystack).contains(needle.lower())


def framed(s: Column) -> Column:
    """Bytes of a text behind their length in eight bytes, big-endian."""
    return F.concat(F.unhex(F.lpad(F.hex(F.octet_length(s)), 16, "0")), s.cast("binary"))


def identity(from_id: Column, rel_type: Column, to_id: Column, key: Column) -> Column:
    """Name of a relation: SHA-256 over its framed ends, type and key."""
    return F.sha2(F.concat(*(framed(x) for x in (F.lit("relation"), from_id, rel_type, to_id, key))), 256)


def token_quarters(s: Column) -> Column:
    """Estimated tokens in quarters: an ASCII sign is one, any other is four."""
    wide = F.char_length(F.regexp_replace(s, r"[\x00-\x7F]", ""))
    return F.char_length(s) + 3 * wide


def token_estimate(s: Column) -> Column:
    return F.ceil(token_quarters(s) / 4).cast("long")


def affixes(name: Column) -> Column:
    """Proper word prefixes of a folded name, longest first, then proper word suffixes, longest first."""
    words = F.split(name, " ")
    n = F.size(words)
    lengths = F.when(n > 1, F.sequence(n - 1, F.lit(1), F.lit(-1))).otherwise(F.array().cast("array<int>"))
    heads = F.transform(lengths, lambda k: F.array_join(F.slice(words, F.lit(1), k), " "))
    tails = F.transform(lengths, lambda k: F.array_join(F.slice(words, n - k + 1, k), " "))
    return F.concat(heads, tails)


def cosine(a: str, b: str) -> Column:
    return F.expr(f"aggregate(zip_with({a}, {b}, (x, y) -> double(x) * double(y)), 0D, (s, x) -> s + x) / sqrt(aggregate({a}, 0D, (s, x) -> s + double(x) * double(x)) * aggregate({b}, 0D, (s, x) -> s + double(x) * double(x)))")


def inner(a: str, b: str) -> Column:
    return F.expr(f"aggregate(zip_with({a}, {b}, (x, y) -> double(x) * double(y)), 0D, (s, x) -> s + x)")


def euclid(a: str, b: str) -> Column:
    return F.expr(f"sqrt(aggregate(zip_with({a}, {b}, (x, y) -> (double(x) - double(y)) * (double(x) - double(y))), 0D, (s, x) -> s + x))")
