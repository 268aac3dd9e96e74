"""Evaluation datasets: titles of expected documents as ids, and traces of a search as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from millrace.operators.state import latest_by_title


def resolve_titles(expected: DataFrame, documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``expected(question_id, title)`` and ``documents(tenant_id, title, document_id, created_at)`` of one tenant.

    Returns ``(question_id, document_id)``, with the newest document of each
    title, and warnings ``(title, problem)`` about titles that no document or
    several documents have.
    """
    newest = latest_by_title(documents).select("title", "document_id")
    wanted = expected.select("title").distinct()
    unknown = wanted.join(newest, "title", "left_anti").withColumn("problem", F.lit("no such document"))
    several = documents.join(wanted, "title", "left_semi").groupBy("title").agg(F.count("*").alias("n")).where("n > 1").select("title", F.lit("several documents").alias("problem"))
    return expected.join(newest, "title").select("question_id", "document_id"), unknown.unionByName(several)


def trace_chunks(traced: DataFrame) -> DataFrame:
    """A traced search as rows of ``(query_id, chunk_id, stage, rank, score)``, one for each stage that ranked the chunk."""
    stages = F.array(
        F.struct(F.lit("dense").alias("stage"), F.col("dense_rank").cast("long").alias("rank"), F.col("dense_score").alias("score")),
        F.struct(F.lit("sparse").alias("stage"), F.col("sparse_rank").cast("long").alias("rank"), F.col("sparse_score").alias("score")),
        F.struct(F.lit("fused").alias("stage"), F.col("fused_rank").cast("long").alias("rank"), F.col("normalised").alias("score")),
    )
    return traced.select("query_id", "chunk_id", F.inline(stages)).where("rank is not null")
