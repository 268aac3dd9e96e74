"""The ingest of fetched documents as one batch: extract, decide what to redo, chunk, embed, replace, and record stages."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from millrace.operators import ingest, state
from millrace.operators.buckets import Buckets
from millrace.operators.chunking import chunk_documents, totals
from millrace.operators.index import update_index


@dataclass(frozen=True)
class Versions:
    extractor: int = 1
    chunker: int = 1
    embedding: str = "none"


def planned(requests: DataFrame, stored: DataFrame, versions: Versions, force: bool = False) -> DataFrame:
    """``requests(document_id, kind, text, ...)`` with ``body``, ``problem``, ``content_hash`` and ``scope`` (full, embed, none; null with a problem).

    ``stored`` has ``document_id, content_hash, extractor_version,
    chunker_version, embedding_version``; ``force`` asks for everything.
    """
    rows = requests.withColumn("body", ingest.extracted(F.col("kind"), F.col("text")))
    rows = rows.withColumn("problem", ingest.extraction_problem(F.col("kind"), F.col("body"))).withColumn("content_hash", F.when(F.col("problem").isNull(), ingest.content_hash(F.array("body"))))
    now = rows.select("document_id", "content_hash", F.lit(versions.extractor).alias("extractor_version"), F.lit(versions.chunker).alias("chunker_version"), F.lit(versions.embedding).alias("embedding_version"))
    scope = F.lit("full") if force else F.col("scope")
    decided = ingest.reindex_scope(now, stored).select("document_id", scope.alias("scope"))
    return rows.join(decided, "document_id").withColumn("scope", F.when(F.col("problem").isNull(), F.col("scope")))


def ingest_batch(requests: DataFrame, documents: DataFrame, chunks: DataFrame, versions: Versions, embed: Callable[[DataFrame], DataFrame], now: Column, force: bool = False) -> tuple[DataFrame, DataFrame]:
    """The documents and chunks after ``requests(document_id, tenant_id, kind, title, path, text, acl_public, acl_groups)``.

    ``documents`` are the stored ones with their stages, hashes and versions;
    ``embed`` gives ``(document_id, ordinal, embedding)`` of ``(document_id,
    ordinal, context_text)``. A document whose text and versions are the same
    is ready as it is; with another embedding version only its vectors change;
    otherwise its chunks are replaced. One that cannot be read, or gives no
    chunks, has failed and keeps its chunks.
    """
    plan = planned(requests, documents, versions, force)
    again = plan.where("scope = 'full'")
    cut = chunk_documents(again.select("document_id", "kind", "title", F.when(F.col("kind") == "code", ingest.language_of(F.col("path"))).alias("language"), "path", F.array("body").alias("pages")))
    old = chunks.join(plan.where("scope = 'embed'").select("document_id"), "document_id", "left_semi")
    vectors = embed(cut.select("document_id", "ordinal", "context_text").unionByName(old.select("document_id", "ordinal", "context_text")))

    access = again.select("document_id", "tenant_id", "acl_public", "acl_groups")
    fresh = cut.join(access, "document_id").join(vectors, ["document_id", "ordinal"], "left").withColumn("embedding_version", F.lit(versions.embedding))
    kept = state.update_vectors(chunks, vectors.join(old.select("document_id").distinct(), "document_id", "left_semi"))
    kept = kept.join(plan.where("scope = 'embed'").select("document_id", F.lit(versions.embedding).alias("_v")), "document_id", "left").withColumn("embedding_version", F.coalesce("_v", "embedding_version")).select(chunks.columns)
    after = state.replace_chunks(kept, fresh)

    sizes = totals(cut).unionByName(totals(old))
    done = plan.join(sizes, "document_id", "left")
    empty = F.col("problem").isNull() & (F.col("scope") == "full") & F.col("chunks").isNull()
    problem = F.when(empty, "Extraction produced no chunks").otherwise(F.col("problem"))
    ready = problem.isNull()
    changes = done.select(
        "document_id",
        F.when(ready, "ready").otherwise("failed").alias("stage"),
        F.when(ready, 1.0).otherwise(0.0).alias("progress"),
        problem.alias("error"),
        F.when(ready & (F.col("scope") != "none"), F.col("content_hash")).alias("content_hash"),
        F.when(ready & (F.col("scope") == "full"), F.lit(versions.extractor)).alias("extractor_version"),
        F.when(ready & (F.col("scope") == "full"), F.lit(versions.chunker)).alias("chunker_version"),
        F.when(ready & (F.col("scope") != "none"), F.lit(versions.embedding)).alias("embedding_version"),
        F.when(ready, F.col("chunks")).alias("chunk_count"),
        F.when(ready, F.col("tokens")).alias("token_count"),
    )
    return state.set_stage(documents, changes, now), after


def indexed_rows(chunks: DataFrame) -> DataFrame:
    """Chunks as the text index takes them: the id follows from the document and the place in it."""
    return chunks.withColumn("chunk_id", F.xxhash64("document_id", "ordinal"))


def whole(spark: SparkSession, path: str) -> bool:
    """Whether a folder was written to its end."""
    context = spark.sparkContext
    at = context._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return at.getFileSystem(context._jsc.hadoopConfiguration()).exists(at)


def ingest_stored(requests: DataFrame, documents: Buckets, chunks: Buckets, index: str, staging: str, versions: Versions, embed: Callable[[DataFrame], DataFrame], now: Column, batch: str, force: bool = False) -> None:
    """:func:`ingest_batch` on stored tables and their text index (of :func:`indexed_rows`).

    Only the buckets of the requested documents are read and written, and the
    index gets one segment of the chunks that differ. What is computed (texts,
    vectors) is staged in the folder ``staging`` first; a batch that was cut
    off is repeated under its name and leaves the same tables and index. A
    document whose chunks are not as many as counted stops the batch before
    anything is written.
    """
    spark, keys = requests.sparkSession, requests.select("document_id").distinct()
    place = f"{staging}/{batch}"
    after = ingest_batch(requests, documents.of(keys), chunks.of(keys), versions, embed, now, force)
    for name, rows in zip(("documents", "chunks"), after):
        if not whole(spark, f"{place}/{name}"):  # a staged batch is not computed again
            rows.write.mode("overwrite").parquet(f"{place}/{name}")
    new_documents, new_chunks = (spark.read.schema(t.schema).parquet(f"{place}/{n}") for n, t in (("documents", documents), ("chunks", chunks)))
    if not new_chunks.where((F.col("embedding_version") == versions.embedding) & F.col("embedding").isNull()).isEmpty():
        raise ValueError("refusing to write: chunks without a vector")

    expected = new_documents.where("stage = 'ready' and chunk_count is not null").select("document_id", F.col("chunk_count").alias("n"))
    counted = new_chunks.join(expected.select("document_id"), "document_id", "left_semi")
    chunks.check(counted, expected)

    old, new = (indexed_rows(c) for c in (chunks.of(keys), new_chunks))
    same = ["chunk_id", *(c for c in ("tenant_id", "heading", "content", "acl_public", "acl_groups") if c in chunks.schema.names)]
    gone, fresh = (a.join(b.select(F.struct(*same).alias("_same")), F.struct(*(F.col(c) for c in same)).eqNullSafe(F.col("_same")), "left_anti") for a, b in ((old, new), (new, old)))
    update_index(index, gone, fresh, batch=batch)
    chunks.replace(expected.select("document_id"), counted)
    documents.replace(keys, new_documents)
