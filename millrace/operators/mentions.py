"""Exhaustive literal mentions of a string, with places, counts and snippets."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, functions as F

from millrace.functions.access import contains, kind_rank
from millrace.operators.index import Index


def find_mentions(chunks: DataFrame, needle: str, sees: Column, source_ids: list | None = None) -> DataFrame:
    """Every visible chunk that contains the needle, in any case; the needle is literal text of 2 to 200 characters.

    Adds ``match_offset`` (0-based, of the first hit), ``occurrences`` (that do
    not overlap), ``snippet`` (120 characters around the first hit, white space
    collapsed) and ``kind_order``, for sorting by kind of source.
    """
    if not 2 <= len(needle.strip()) <= 200:
        raise ValueError("a needle has 2 to 200 characters")
    low, find = F.lower("content"), F.lower(F.lit(needle))
    found = chunks.where(sees).where(F.contains(low, find))
    if source_ids is not None:
        found = found.where(F.col("source_id").isin(source_ids))
    at = F.expr("instr(lower(content), needle)")
    return (
        found.withColumn("needle", find)
        .withColumn("match_offset", (at - 1).cast("int"))
        .withColumn("occurrences", ((F.length(low) - F.length(F.replace(low, F.col("needle"), F.lit("")))) / F.length("needle")).cast("int"))
        .withColumn("snippet", F.regexp_replace(F.substring("content", F.greatest(F.lit(1), F.col("match_offset") - 119), F.lit(len(needle) + 240)), r"\s+", " "))
        .withColumn("kind_order", kind_rank(F.col("source_kind")))
        .drop("needle")
    )


#: Chunks that may hold a needle up to which they are named in the scan's filter.
NAMED_CHUNKS = 1_000


def indexed_mentions(index: Index, needle: str, sees: Column, source_ids: list | None = None) -> DataFrame:
    """As :func:`find_mentions` on the index's chunks, reading those only that hold the needle's rarest trigrams.

    Where the index cannot tell (needles below three characters), all chunks
    are read. A few chunks are named in the scan's filter, which skips files
    and row groups of a table in order of chunk_id; more are joined.
    """
    return find_mentions(_among(index, index.may_hold(needle)), needle, sees, source_ids)


def _among(index: Index, held: DataFrame | None) -> DataFrame:
    if held is None:
        return index.chunks
    some = [r["chunk_id"] for r in held.distinct().limit(NAMED_CHUNKS + 1).collect()]
    return index.chunks.where(F.col("chunk_id").isin(some)) if len(some) <= NAMED_CHUNKS else index.chunks.join(held, "chunk_id", "left_semi")


def with_metadata(index: Index, wanted: Any, sees: Column) -> DataFrame:
    """Visible chunks whose JSON ``metadata`` contains the wanted value; JSON is parsed for those only that the lists of its rarest values leave."""
    rows = _among(index, index.may_contain(wanted))
    return rows.where(sees).where(contains(F.try_parse_json("metadata"), wanted))


def titled(index: Index, part: str, sees: Column) -> DataFrame:
    """Visible chunks whose title contains the part, in any case; through the trigrams of titles where the index has them."""
    rows = _among(index, index.may_hold(part, "title"))
    return rows.where(sees).where(F.contains(F.lower("title"), F.lower(F.lit(part))))


def ordered(found: DataFrame, limit: int = 200) -> DataFrame:
    """The first mentions by kind of source, title and place in the document."""
    return found.orderBy("kind_order", "title", "ordinal", "chunk_id").limit(limit)


def by_source(found: DataFrame) -> DataFrame:
    """Chunks and occurrences for each kind of source."""
    return found.groupBy("source_kind", "kind_order").agg(F.count("*").alias("chunks"), F.sum("occurrences").cast("long").alias("occurrences"))
