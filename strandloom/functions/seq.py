"""Column functions on sequence text; all are built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

K = 31


def plain(seq: str | Column) -> Column:
    """Bases in upper case without white space; null counts as empty."""
    col = F.col(seq) if isinstance(seq, str) else seq
    return F.upper(F.regexp_replace(F.coalesce(col, F.lit("")), r"\s", ""))


def revcomp(bases: Column) -> Column:
    return F.reverse(F.translate(bases, "ACGT", "TGCA"))


def kmers(bases: Column, k: int = K, block: int = 128) -> Column:
    """All k-base words (k <= block) of a sequence, in order; an empty array if it is shorter.

    A substring costs as much as its position, so that long sequences are first cut into blocks, in one pass.
    """
    parts = F.regexp_extract_all(bases, F.lit("(.{1,%d})" % block), F.lit(1))
    after = F.concat(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), F.array(F.lit("")))
    wide = F.zip_with(parts, after, lambda x, y: F.concat(x, F.coalesce(F.substring(y, 1, k - 1), F.lit(""))))
    windows = lambda x: F.when(F.length(x) >= k, F.transform(F.sequence(F.lit(1), F.length(x) - (k - 1)), lambda i: F.substring(x, i, F.lit(k)))).otherwise(F.array().cast("array<string>"))
    return F.when(F.length(bases) >= k, F.flatten(F.transform(wide, windows))).otherwise(F.array().cast("array<string>"))


def wrapped(bases: Column, width: int = 80) -> Column:
    """Line wraps after every `width` bases, none at the end."""
    return F.regexp_replace(bases, "(.{%d})(?=.)" % width, "$1\n")
