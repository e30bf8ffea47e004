"""Delimited text files: delimiter, header and ragged rows; every cell stays a string.

The delimiter and the header are read from the first lines on the driver; the rows themselves by Spark's
CSV reader, which splits large files. Only files whose quoted cells hold line ends need ``multiline``.
"""

from __future__ import annotations

import csv
from dataclasses import dataclass
from itertools import islice

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DELIMITERS = (",", "\t", ";", "|")
SNIFF_BYTES, SNIFF_RECORDS = 64 * 1024, 10
MALFORMED = "_malformed"


class DelimiterError(ValueError):
    """Several delimiters fit, or one splits the records into different numbers of cells."""


class HeaderError(ValueError):
    """No header, or a column name occurs twice."""


@dataclass
class Delimited:
    columns: list[str]
    rows: DataFrame
    violations: DataFrame


def sniff(lines: list[str]) -> str:
    """The one delimiter that splits every record into the same number (two or more) of cells; ``,`` if none splits any."""
    fits, uneven = [], []
    for sep in DELIMITERS:
        sizes = {len(r) for r in islice((r for r in csv.reader(lines, delimiter=sep) if r), SNIFF_RECORDS)}
        if len(sizes) == 1 and max(sizes) > 1:
            fits.append(sep)
        elif len(sizes) > 1:
            uneven.append(sep)
    if len(fits) > 1:
        raise DelimiterError(f"several delimiters fit: {fits}")
    if not fits and uneven:
        raise DelimiterError(f"records differ in their number of cells: {uneven}")
    return fits[0] if fits else ","


def _head(spark: SparkSession, path: str | list[str]) -> list[str]:
    lines, size = [], 0
    for row in spark.read.text(path).limit(SNIFF_RECORDS * 10).collect():
        size += len(row.value.encode()) + 1
        if lines and size > SNIFF_BYTES:
            break
        lines.append(row.value + "\n")
    if lines:
        lines[0] = lines[0].removeprefix("﻿")
    return lines


def header(cells: list[str]) -> list[str]:
    """Trimmed names; a blank one is empty here and its column is ignored."""
    names = [c.strip() for c in cells]
    twice = sorted({n for n in names if n and names.count(n) > 1})
    if twice:
        raise HeaderError(f"column names occur twice: {twice}")
    return names


def scan(spark: SparkSession, path: str | list[str], sep: str | None = None, multiline: bool = False) -> Delimited:
    """Rows of the file at ``path``, or of several files with one header (named columns, and ``ord``), and its violations (kind, subject, detail).

    ``malformed_row``: another number of cells than the header has; the row is left out.
    ``unnamed_column``: a blank name in the header; the column is left out. ``ord`` follows the order in the file.
    """
    lines = _head(spark, path if isinstance(path, str) else path[:1])
    if not any(line.strip() for line in lines):
        raise HeaderError("the file has no header")
    sep = sniff(lines) if sep is None else sep
    names = header(next(r for r in csv.reader(lines, delimiter=sep) if r))
    schema = ", ".join([*(f"_c{i} string" for i in range(len(names))), f"{MALFORMED} string"])
    reader = spark.read.schema(schema).option("sep", sep).option("header", True).option("enforceSchema", True).option("quote", '"').option("escape", '"')
    read = reader.option("multiLine", multiline).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", MALFORMED).csv(path)
    # all columns are asked for at once: with fewer, the reader would not notice ragged rows
    cells = F.array(*(F.coalesce(f"_c{i}", F.lit("")) for i in range(len(names))))
    where = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    rows = read.select(cells.alias("cells"), F.col(MALFORMED).alias("bad"), where.alias("ord"))
    named = [(i, n) for i, n in enumerate(names) if n]
    fine = rows.filter("bad is null").select(*(F.col("cells")[i].alias(n) for i, n in named), "ord")
    ragged = rows.filter("bad is not null and size(cells) > 0").select(F.lit("malformed_row").alias("kind"), F.lit("").alias("subject"), F.col("bad").alias("detail"))
    blank = [("unnamed_column", "", str(i + 1)) for i, n in enumerate(names) if not n]
    found = spark.createDataFrame(blank, "kind string, subject string, detail string")
    return Delimited([n for _, n in named], fine, found.unionByName(ragged))
