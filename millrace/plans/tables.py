"""The driver's tables as tables of a retrieval corpus, by fixed conventions.

A document is one chunk (``chunk_id = document_id = doc_id``); tenant, access
rules, source kind and title follow from ``doc_id`` and ``source``; a chunk's
embedding is the one with ``vec_id = doc_id``. Every convention is written once
more, independently, in the SQL of :mod:`millrace.plans.registry`.
"""

from __future__ import annotations

import math
import tempfile
import uuid
from collections.abc import Callable, Sequence
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from millrace.functions.access import SOURCE_KINDS
from millrace.operators.index import Index, read_index, write_index
from millrace.operators.search import Principal, Query
from millrace.operators.vectors import MOST_CELLS, VectorIndex, read_vectors, write_vectors

MEMBER = Principal("acme", ("engineering",))
ADMIN = Principal("acme", (), True)
STRANGER = Principal("acme")
NOW = "timestamp_ntz'2024-01-20 12:00:00'"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chunks(spark: SparkSession, sf_dir: str, embedded: bool = False) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    groups = F.when(F.col("doc_id") % 4 == 0, F.array(F.lit("engineering"))).when(F.col("doc_id") % 4 == 1, F.array(F.lit("hr"))).when(F.col("doc_id") % 4 == 2, F.array(F.lit("engineering"), F.lit("hr"))).otherwise(F.array().cast("array<string>"))
    kinds = F.array(*map(F.lit, SOURCE_KINDS))
    out = d.select(
        F.col("doc_id").alias("chunk_id"),
        F.col("doc_id").alias("document_id"),
        F.when(F.col("doc_id") % 10 == 9, "other").otherwise("acme").alias("tenant_id"),
        F.col("source").alias("source_id"),
        F.get(kinds, F.substring("source", 4, 9).cast("int") % 7).alias("source_kind"),
        F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("title"),
        F.lit(0).alias("ordinal"),
        F.col("text").alias("content"),
        "lang",
        (F.col("doc_id") % 3 == 0).alias("acl_public"),
        groups.alias("acl_groups"),
    )
    if embedded:
        out = out.join(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding"), "chunk_id", "left")
    return out


_stored: dict[tuple, str] = {}
_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one where that is unset and Spark runs in one process (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.conf.get("spark.master", "").startswith("local"):
        raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
    app = spark.conf.get("spark.app.id", "")
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return _own[app]


def _kept(spark: SparkSession, sf_dir: str, tables: Sequence[str], tag: str, write: Callable[[str], None], read: Callable[[str], Any]) -> Any:
    """What ``write(path)`` stores of these tables in the shared folder, written when first asked for and again once their files change or the folder is cleared."""
    files = [tuple(table(spark, sf_dir, t).agg(F.count("*"), F.max("_metadata.file_modification_time").cast("string")).first()) for t in tables]
    key = (spark.conf.get("spark.app.id", ""), sf_dir, tag, *files)
    if key in _stored:
        try:
            return read(_stored[key])
        except AnalysisException:  # the folder has been cleared
            pass
    _stored[key] = f"{shared_folder(spark)}/millrace-{tag}-{uuid.uuid4().hex}"
    write(_stored[key])
    return read(_stored[key])


def stored_index(spark: SparkSession, sf_dir: str, english: bool = False) -> Index:
    """The stored text index of the documents."""
    rows = chunks(spark, sf_dir)
    return _kept(spark, sf_dir, ["documents"], f"index-{'english' if english else 'simple'}", lambda path: write_index(rows, path, english), lambda path: read_index(rows, path))


def described(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks with ``metadata``, a JSON document of their language and labels."""
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("chunk_id"), F.struct("toxic", "quality").alias("labels"))
    rows = chunks(spark, sf_dir).join(labels, "chunk_id", "left")
    return rows.withColumn("metadata", F.to_json(F.struct("lang", "labels"))).drop("labels")


def stored_lists(spark: SparkSession, sf_dir: str) -> Index:
    """The stored text index of the documents with lists for parts of contents and titles and for metadata."""
    rows = described(spark, sf_dir)
    return _kept(spark, sf_dir, ["documents", "labels"], "lists", lambda path: write_index(rows, path, fields=("content", "title", "metadata@json")), lambda path: read_index(rows, path))


def stored_vectors(spark: SparkSession, sf_dir: str) -> VectorIndex:
    """The stored vector index of the documents' embeddings, in about the square root of their number of cells."""
    rows = chunks(spark, sf_dir, embedded=True)
    cells = max(2, min(MOST_CELLS, math.isqrt(table(spark, sf_dir, "embeddings").count())))
    return _kept(spark, sf_dir, ["documents", "embeddings"], "vectors", lambda path: write_vectors(rows, path, cells), lambda path: read_vectors(rows, path))


def questions(spark: SparkSession, sf_dir: str) -> list[Query]:
    """The batch of requests: benchmark items whose id is divisible by 20, with the embedding of the same id."""
    items = table(spark, sf_dir, "benchmark").where("item_id % 20 = 0")
    joined = items.join(table(spark, sf_dir, "embeddings"), F.col("item_id") == F.col("vec_id"), "left").select("item_id", "text", "embedding").orderBy("item_id")
    return [Query(r["item_id"], r["text"], None if r["embedding"] is None else tuple(r["embedding"])) for r in joined.collect()]


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    status = F.when(F.col("event_id") % 4 < 2, "queued").when(F.col("event_id") % 4 == 2, "running").otherwise("succeeded")
    running = status == "running"
    nothing = F.lit(None)
    return e.select(
        F.col("event_id").alias("id"),
        F.col("event_type").alias("kind"),
        status.alias("status"),
        (F.col("user_id") % 5).cast("int").alias("priority"),
        (F.col("event_id") % 6).cast("int").alias("attempts"),
        F.lit(5).alias("max_attempts"),
        F.col("ts").alias("run_after"),
        F.col("ts").alias("created_at"),
        F.when(running, F.col("ts")).alias("started_at"),
        nothing.cast("timestamp_ntz").alias("finished_at"),
        F.when(running, F.concat(F.lit("w"), (F.col("user_id") % 3).cast("string"))).alias("locked_by"),
        F.when(running, F.expr("ts + interval 5 minutes")).alias("lease_expires_at"),
        nothing.cast("string").alias("last_error"),
        F.concat_ws("/", "event_type", F.col("user_id").cast("string")).alias("dedupe_key"),
    )
