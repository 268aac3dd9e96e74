"""Batched hybrid search: exact cosine, BM25 with per-caller document frequencies, weighted reciprocal rank fusion.

Texts are analyzed once, into an :class:`~millrace.operators.index.Index`; a
search reads the postings of its terms, and what the caller sees comes from the
access classes. Phrases and negations are settled by positions.

Chunks: ``chunk_id, document_id, tenant_id, content, embedding, acl_public,
acl_groups`` and whatever filters use. Queries are a list on the driver (a
batch of requests), and so are the document frequencies of their terms;
everything that touches chunks is a DataFrame. Access and filters apply below
every ranking step. Ranks order by the score rounded to nine digits, then by
chunk_id.
"""

from __future__ import annotations

import math
import time
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from millrace.functions.access import visible
from millrace.functions.text import Clause, bag_of_words, parse_websearch, query_terms
from millrace.operators.index import Index
from millrace.operators.vectors import VectorIndex, matrix_of, near, unit

K1, B = 1.2, 0.75
#: Queries scored in one pass over the chunks.
QUERY_BLOCK = 256
#: Weight of a cover of a query's terms, and how many times the candidates a prefilter by cover density keeps.
COVER, PREFILTER = 0.1, 5


@dataclass(frozen=True)
class Query:
    query_id: int
    text: str | None
    embedding: tuple[float, ...] | None = None


@dataclass(frozen=True)
class Params:
    """Search settings; ``clamped`` forces them into their ranges."""

    top_k: int = 8
    candidates: int = 60
    alpha: float = 0.5
    rrf_k: int = 60
    min_score: float = 0.0

    def clamped(self) -> Params:
        top = min(50, max(1, self.top_k))
        return replace(
            self, top_k=top, candidates=min(400, max(top, self.candidates, 10)), alpha=min(1.0, max(0.0, self.alpha)), rrf_k=min(1000, max(1, self.rrf_k)), min_score=min(1.0, max(0.0, self.min_score))
        )


@dataclass(frozen=True)
class Principal:
    tenant_id: str
    groups: tuple[str, ...] = ()
    is_admin: bool = False

    def sees(self) -> Column:
        return (F.col("tenant_id") == self.tenant_id) & visible(self.groups, self.is_admin)


def ranked(scored: DataFrame, k: int, score: str = "score") -> DataFrame:
    """The k best rows of each query with their rank."""
    order = Window.partitionBy("query_id").orderBy(F.round(score, 9).desc(), "chunk_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def dense(chunks: DataFrame, queries: Sequence[Query], k: int) -> DataFrame:
    """``(query_id, chunk_id, score, rank)``: the k nearest chunks by cosine; chunks without an embedding are left out.

    Each batch of rows meets all queries of a block as one matrix product and
    passes on its k best, so what is shuffled does not grow with the chunks'
    number times the queries'.
    """
    wanted = [q for q in queries if q.embedding is not None]
    found = None
    for at in range(0, len(wanted), QUERY_BLOCK):
        block = wanted[at : at + QUERY_BLOCK]
        matrix = unit(np.array([q.embedding for q in block], np.float64))
        ids = np.array([q.query_id for q in block], np.int64)

        def score(batches: Iterator[pa.RecordBatch], matrix=matrix, ids=ids) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                s = matrix @ unit(matrix_of(batch.column(1), matrix.shape[1])).T
                keys = batch.column(0).to_numpy()
                most = min(k, s.shape[1])
                cut = -np.partition(-s, most - 1, axis=1)[:, most - 1 : most] - 2e-9
                q, c = np.nonzero(s >= cut)
                yield pa.RecordBatch.from_arrays([pa.array(ids[q]), pa.array(keys[c]), pa.array(s[q, c])], ["query_id", "chunk_id", "score"])

        rows = chunks.where("embedding is not null").select(F.col("chunk_id").cast("long").alias("chunk_id"), "embedding").mapInArrow(score, "query_id long, chunk_id long, score double")
        found = rows if found is None else found.unionByName(rows)
    if found is None:
        found = chunks.sparkSession.createDataFrame([], "query_id long, chunk_id long, score double")
    return ranked(found, k)


def dense_of_cells(vectors: VectorIndex, queries: Sequence[Query], principal: Principal, k: int, probes: int | None = None, where: Column | None = None) -> DataFrame:
    """As :func:`dense`, from the cells of a stored vector index that are nearest to the queries; with all cells, the same rows."""
    wanted = [q for q in queries if q.embedding is not None]
    found = None
    for at in range(0, len(wanted), QUERY_BLOCK):
        block = wanted[at : at + QUERY_BLOCK]
        rows = near(vectors, [q.query_id for q in block], [q.embedding for q in block], principal.sees(), k, probes, where)
        found = rows if found is None else found.unionByName(rows)
    if found is None:
        found = vectors.rows.sparkSession.createDataFrame([], "query_id long, chunk_id long, score double")
    return ranked(found, k)


def idf(index: Index, terms: Sequence[str], principal: Principal) -> DataFrame:
    """``(term, df, idf)``: document frequencies among the chunks the caller sees, N of the whole tenant. Terms without a chunk stay.

    A frequency is the sum of those of the classes that the caller sees; no
    chunk and no posting is read.
    """
    spark = index.classes.sparkSession
    seen = index.classes.where(principal.sees()).select("class_id")
    counts = index.of_terms(index.frequencies, terms).join(seen, "class_id", "left_semi").groupBy("term").agg(F.sum("df").alias("df"))
    one = index.stats.where(F.col("tenant_id") == principal.tenant_id).first()
    n, df = F.lit(max(1, one["chunk_count"]) if one else 1), F.coalesce("df", F.lit(0)).cast("long")
    all_terms = spark.createDataFrame([(t,) for t in terms], "term string")
    return all_terms.join(counts, "term", "left").select("term", df.alias("df"), F.log(1 + (n - df + 0.5) / (df + 0.5)).alias("idf"))


def _occurrences(clause: Clause, places: dict[str, np.ndarray]) -> np.ndarray:
    """First positions of a clause's occurrences in a chunk, given the positions of each of its terms."""
    found = None
    for shift, term in enumerate(clause.terms):
        if term is None:  # a stop word stood here
            continue
        at = places.get(term)
        if at is None:
            return np.zeros(0, np.int64)
        found = at - shift if found is None else np.intersect1d(found, at - shift, assume_unique=True)
    return np.zeros(0, np.int64) if found is None else found


def satisfied(groups: Sequence[Sequence[Clause]], places: dict[str, np.ndarray]) -> bool:
    """Whether a chunk with these positions of terms satisfies a parsed query."""
    return any(all((len(_occurrences(c, places)) > 0) != c.negated for c in g) for g in groups)


def cover_density(groups: Sequence[Sequence[Clause]], places: dict[str, np.ndarray]) -> float:
    """Sum over the query's covers of COVER / (1 + words within that belong to no clause).

    A cover is a shortest stretch of text that satisfies an alternative whose
    negated clauses find nothing in the chunk.
    """
    covers: dict[tuple[int, int], int] = {}
    for g in groups:
        wanted = [c for c in g if not c.negated]
        found = [_occurrences(c, places) for c in wanted]
        if not wanted or not all(map(len, found)) or any(len(_occurrences(c, places)) for c in g if c.negated):
            continue
        events = sorted((p + len(c.terms) - 1, p, k) for k, (c, at) in enumerate(zip(wanted, found)) for p in at.tolist())
        of_clauses = np.unique(np.concatenate([at + i for c, at in zip(wanted, found) for i in range(len(c.terms))]))
        newest, last = [-1] * len(wanted), -1
        for end, start, k in events:
            newest[k] = max(newest[k], start)
            first = min(newest)
            if first > last:
                last = first
                inside = int(np.searchsorted(of_clauses, end, "right") - np.searchsorted(of_clauses, first))
                covers[first, end] = max(covers.get((first, end), 0), inside)
    return sum(COVER / (1 + end - first + 1 - inside) for (first, end), inside in sorted(covers.items()))


def _part(idf: float, tf: int, n_terms: int, average: float) -> float:
    """What a term adds to a chunk's BM25."""
    return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * n_terms / average))


def lexical(index: Index, queries: Sequence[Query], principal: Principal, k: int, where: Column | None = None, any_term: bool = False, prefilter: int | None = None) -> DataFrame:
    """``(query_id, chunk_id, score, rank)``: the k best chunks by BM25 that satisfy the query and the filter.

    ``any_term`` takes a query as a bag of words; else the web-search language
    holds (all terms, ``or``, ``-``, phrases), settled by the positions of the
    terms in a chunk. With ``prefilter``, only the ``prefilter * k`` chunks
    first by cover density (and then by chunk_id) are scored. Frequencies are
    those of the caller's chunks, whatever the filter.
    """
    parsed = {q.query_id: bag_of_words(q.text, index.english) if any_term else parse_websearch(q.text, index.english) for q in queries}
    of: dict[str, list[int]] = {}
    for i, g in parsed.items():
        for t in query_terms(g):
            of.setdefault(t, []).append(i)
    spark = index.classes.sparkSession
    if not of:
        return spark.createDataFrame([], "query_id long, chunk_id long, score double, rank int")
    terms = sorted(of)
    found = index.postings_of(terms).join(index.classes.where(principal.sees()).select("class_id"), "class_id", "left_semi")
    if where is not None:
        found = found.join(index.chunks.where(where).select("chunk_id"), "chunk_id", "left_semi")
    weights = {r["term"]: r["idf"] for r in idf(index, terms, principal).collect()}  # the terms of a batch of requests
    one = index.stats.where(F.col("tenant_id") == principal.tenant_id).first()
    average = one["avg_len"] if one else 1.0
    if any_term and prefilter is None:
        of_query = spark.createDataFrame([(i, t, weights[t]) for t in terms for i in of[t]], "query_id long, term string, idf double")
        pairs = found.join(F.broadcast(of_query), "term")  # no more rows than the batch has terms
        part = _part(F.col("idf"), F.col("tf"), F.col("n_terms"), average)
        return ranked(pairs.groupBy("query_id", F.col("chunk_id").cast("long").alias("chunk_id")).agg(F.sum(part).alias("score")), k)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for chunk, n_terms, held in zip(*(c.to_pylist() for c in batch.columns)):
                tf = {h["term"]: h["tf"] for h in held}
                places = {h["term"]: np.cumsum(h["gaps"], dtype=np.int64) for h in held}
                for i in sorted({i for t in tf for i in of[t]}):
                    if not satisfied(parsed[i], places):
                        continue
                    score = math.fsum(_part(weights[t], tf[t], n_terms, average) for t in query_terms(parsed[i]) if t in tf)
                    out.append((i, chunk, score, cover_density(parsed[i], places) if prefilter else 0.0))
            columns = list(zip(*out)) or [(), (), (), ()]
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["query_id", "chunk_id", "score", "density"])

    held = found.groupBy(F.col("chunk_id").cast("long").alias("chunk_id")).agg(F.first("n_terms").alias("n_terms"), F.collect_list(F.struct("term", "tf", "gaps")).alias("held"))
    rows = held.mapInArrow(scored, "query_id long, chunk_id long, score double, density double")
    if prefilter:
        rows = ranked(rows, prefilter * k, "density").drop("rank")
    return ranked(rows.drop("density"), k)


def fuse(dense_hits: DataFrame, lexical_hits: DataFrame, alpha: float, rrf_k: int) -> DataFrame:
    """Weighted reciprocal rank fusion of two ranked lists; a missing side adds nothing."""
    d = dense_hits.select("query_id", "chunk_id", F.col("score").alias("dense_score"), F.col("rank").alias("dense_rank"))
    s = lexical_hits.select("query_id", "chunk_id", F.col("score").alias("sparse_score"), F.col("rank").alias("sparse_rank"))
    both = d.join(s, ["query_id", "chunk_id"], "full_outer")
    return both.withColumn("fused", F.coalesce(F.lit(alpha) / (rrf_k + F.col("dense_rank")), F.lit(0.0)) + F.coalesce(F.lit(1 - alpha) / (rrf_k + F.col("sparse_rank")), F.lit(0.0)))


def trace(fused: DataFrame) -> DataFrame:
    """Fused rows with ``normalised``, the share of the query's best, and their fused rank."""
    per = Window.partitionBy("query_id")
    out = fused.withColumn("normalised", F.col("fused") / F.greatest(F.max("fused").over(per), F.lit(1e-12)))
    return out.withColumn("fused_rank", F.row_number().over(per.orderBy(F.round("fused", 9).desc(), "chunk_id")))


def hybrid_search(
    index: Index, queries: Sequence[Query], principal: Principal, params: Params = Params(), where: Column | None = None, any_term: bool = False, vectors: DataFrame | VectorIndex | None = None, embed: Callable[[Sequence[str]], Sequence[Sequence[float]]] | None = None
) -> DataFrame:
    """The traced union of both channels for each query; blank queries give nothing.

    ``vectors`` are the chunks with embeddings, if those of the index have none,
    or a stored vector index, of which the nearest cells are read; ``embed`` gives the embeddings of queries that come without. Rows within the
    answer are those with ``fused_rank <= top_k`` and ``normalised >=
    min_score``; the others are what a debugger shows.
    """
    p = params.clamped()
    asked = [replace(q, text=q.text.strip()) for q in queries if q.text and q.text.strip()]
    if embed and (bare := [q for q in asked if q.embedding is None]):
        found = dict(zip((q.query_id for q in bare), map(tuple, embed([q.text for q in bare]))))
        asked = [replace(q, embedding=found.get(q.query_id, q.embedding)) for q in asked]
    if isinstance(vectors, VectorIndex):
        close = dense_of_cells(vectors, asked, principal, p.candidates, where=where)
    else:
        rows = index.chunks if vectors is None else vectors
        close = dense(rows.where(principal.sees() if where is None else principal.sees() & where), asked, p.candidates)
    return trace(fuse(close, lexical(index, asked, principal, p.candidates, where, any_term=any_term), p.alpha, p.rrf_k))


def trace_lists(traced: DataFrame, params: Params = Params()) -> DataFrame:
    """``(query_id, chunk_id, stage, rank, score)``: each channel's first max(top_k, 10) rows, and the answer as stage ``fused``."""
    p = params.clamped()
    depth = max(p.top_k, 10)
    lists = traced.where(f"dense_rank <= {depth}").select("query_id", "chunk_id", F.lit("dense").alias("stage"), F.col("dense_rank").cast("long").alias("rank"), F.col("dense_score").alias("score"))
    lists = lists.unionByName(traced.where(f"sparse_rank <= {depth}").select("query_id", "chunk_id", F.lit("sparse").alias("stage"), F.col("sparse_rank").cast("long").alias("rank"), F.col("sparse_score").alias("score")))
    return lists.unionByName(answers(traced, p).select("query_id", "chunk_id", F.lit("fused").alias("stage"), F.col("fused_rank").cast("long").alias("rank"), F.col("normalised").alias("score")))


def timed(stages: dict[str, DataFrame]) -> tuple[dict[str, DataFrame], dict[str, float]]:
    """Each stage computed and held by the executors, and the milliseconds it took: for a debugger, never a compared result."""
    held, took = {}, {}
    for name, rows in stages.items():
        began = time.perf_counter()
        held[name] = rows.persist()
        held[name].count()
        took[name] = 1000 * (time.perf_counter() - began)
    return held, took


def answers(traced: DataFrame, params: Params = Params()) -> DataFrame:
    p = params.clamped()
    return traced.where((F.col("normalised") >= p.min_score) & (F.col("fused_rank") <= p.top_k))


def enriched(hits: DataFrame, chunks: DataFrame, documents: DataFrame, sources: DataFrame) -> DataFrame:
    """Hits with the columns of their chunk, document and source (inner joins; the few hits are the small side)."""
    return hits.join(chunks, "chunk_id").join(documents, "document_id").join(sources, "source_id")


def reranked(hits: DataFrame, scores: DataFrame) -> DataFrame:
    """Order by ``scores(query_id, chunk_id, rating)`` of 0..10, then by fusion; a query with a missing rating or one hit keeps its order."""
    per = Window.partitionBy("query_id")
    joined = hits.join(scores, ["query_id", "chunk_id"], "left")
    usable = (F.count("rating").over(per) == F.count("*").over(per)) & (F.count("*").over(per) > 1)
    joined = joined.withColumn("rerank", F.when(usable, F.least(F.greatest(F.col("rating") / 10, F.lit(0.0)), F.lit(1.0))))
    order = per.orderBy(F.col("rerank").desc_nulls_last(), F.round("fused", 9).desc(), "chunk_id")
    return joined.withColumn("final_rank", F.row_number().over(order))


def in_documents(ids: Sequence[int] | None) -> Column:
    """The filter by documents; no list is no filter."""
    return F.lit(True) if ids is None else F.col("document_id").isin(list(ids))


def rewrite_accepted(query: Column, rewritten: Column) -> Column:
    """A rewritten query counts if it is not blank and no longer than six times the original plus 120 characters."""
    clean = F.trim(rewritten)
    return F.when((F.length(clean) > 0) & (F.length(clean) <= 6 * F.length(query) + 120), clean).otherwise(query)
