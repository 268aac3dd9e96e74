"""Arithmetic of search displays, as Columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def channel_bias(dense_rank: Column, sparse_rank: Column, rrf_k: int = 60) -> Column:
    """Share of the dense channel in a hit's weight, 0..1; null if neither found it."""
    d, s = (F.coalesce(1 / (rrf_k + r), F.lit(0.0)) for r in (dense_rank, sparse_rank))
    return F.when(d + s > 0, d / (d + s))


def bar_width(score: Column) -> Column:
    """A BM25 score as a bar of at most 100."""
    return F.least(F.lit(100.0), score / (score + 4) * 100 + 12)


def found_by_both(dense_rank: Column, sparse_rank: Column) -> Column:
    return dense_rank.isNotNull() & sparse_rank.isNotNull()


def file_size(n: Column) -> Column:
    """Bytes as text."""
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1 << 20, F.format_string("%.1f KB", n / 1024)).otherwise(F.format_string("%.1f MB", n / (1 << 20)))


def slug(text: Column) -> Column:
    """Lower-case letters and digits with single hyphens between."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")
