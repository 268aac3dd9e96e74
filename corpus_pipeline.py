"""The corpus pipeline: toxicity, near-duplicates, repeated passages, benchmark passages, packing.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; all but the
last return the columns of ``documents``, extra ones and clashing names too. The
driver writes what a stage returns and gives it to the next one. Every stage
takes nulls in any column, repeated rows and empty tables (which stay empty).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from millrace.llm import decontaminate, jaccard_join, packing, substring_dedup, toxicity
from millrace.llm.scratch import written
from millrace.llm.tokens import public_path

#: Rows of an Arrow batch at most: texts are long, and each task's buffers for them lie outside the executor's heap.
ARROW_ROWS = 1_000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def _sized(spark: SparkSession) -> None:
    """Smaller Arrow batches for the session; results do not depend on them."""
    if not 0 < int(spark.conf.get(_BATCH)) <= ARROW_ROWS:
        spark.conf.set(_BATCH, str(ARROW_ROWS))


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: documents scored 0.5 or more go; null and empty texts, having no words, are scored by the bias alone and stay."""
    _sized(spark)
    return toxicity.without_toxic(docs, toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7, five words and 0.8: of each group the document with the smallest doc_id stays.

    Of rows that repeat a doc_id and its set one stays; rows without words, and
    those without a doc_id, stay.
    """
    _sized(spark)
    return jaccard_join.one_of_each(docs, n=5, num=80, den=100)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: passages of 50 words that an earlier document holds go; so do documents of which nothing is left.

    Rows that lose nothing, null and empty texts among them, stay as they are.
    """
    _sized(spark)
    return substring_dedup.without_repeats(docs, window=50)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: documents that hold ten consecutive words of a benchmark item (or a whole shorter item) go; null and empty texts stay."""
    _sized(spark)
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), window=10)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: the pieces of sequences of at most 1024 ids; null and empty texts are the end id alone."""
    _sized(spark)
    pieces = packing.pack(docs, public_path("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "tier", "step_group")


STAGES = [
    ("toxicity", without_toxic),
    ("near_copies", without_near_copies),
    ("repeats", without_repeats),
    ("benchmark", without_benchmark),
    ("packing", packed),
]

#: SQL can express neither the classifier nor the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied in turn to ``documents``, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
