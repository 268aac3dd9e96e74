"""A stored vector index: trained coarse cells, and the vectors of each cell as a partition.

Cells are trained on a bounded sample; every vector is stored in the partition
of its nearest cell, with its chunk's access class. A search reads only the
cells nearest to its queries (``probes`` each), so that number is the knob
between time and recall: all cells give the exact answer, and
:func:`probes_for` measures how many reach a wanted recall.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, functions as F, types as T

from millrace.operators.index import with_class

#: Vectors of a cell on average in a new index, and its most cells (their centres are sent to all tasks).
CELL_VECTORS, MOST_CELLS = 4_000, 4_096
#: Vectors that the cells are trained on, for each cell and at most.
SAMPLE_A_CELL, MOST_SAMPLE = 200, 400_000


@dataclass(frozen=True)
class VectorIndex:
    """``rows(chunk_id, class_id, embedding, cell)`` partitioned by cell, the centres by cell, and the access classes."""

    chunks: DataFrame
    rows: DataFrame
    centres: np.ndarray
    classes: DataFrame
    probes: int = 8


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; a row of zeros stays."""
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def matrix_of(column: pa.Array, width: int) -> np.ndarray:
    """The vectors of an Arrow column; ValueError if they have another length."""
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    if x.shape[1] != width:
        raise ValueError(f"embeddings of {x.shape[1]} and {width} numbers")
    return x


def trained(chunks: DataFrame, cells: int, seed: int = 7, steps: int = 12) -> np.ndarray:
    """Unit centres of at most ``cells`` cells, by cosine k-means on a sample drawn by hashes of the ids."""
    held = chunks.where(F.col("embedding").isNotNull() & F.exists("embedding", lambda v: v != 0))
    n = held.count()
    if not n:
        return np.zeros((0, 0))
    most, scale = min(MOST_SAMPLE, SAMPLE_A_CELL * cells), 1 << 40
    drawn = held.where(F.pmod(F.xxhash64("chunk_id", F.lit(seed)), F.lit(scale)) < min(scale, scale * most // n)) if n > most else held
    model = KMeans(k=max(2, cells), maxIter=steps, seed=seed, distanceMeasure="cosine", initMode="random").fit(drawn.select(array_to_vector(F.col("embedding")).alias("features")))
    return unit(np.array(model.clusterCenters()))


def write_vectors(chunks: DataFrame, path: str, cells: int | None = None, seed: int = 7) -> None:
    """Store ``chunks(chunk_id, tenant_id, acl_public, acl_groups, embedding)`` by cells; those without an embedding are left out."""
    spark = chunks.sparkSession
    held = with_class(chunks.where("embedding is not null"))
    cells = cells or min(MOST_CELLS, 1 + held.count() // CELL_VECTORS)
    centres = trained(chunks, cells, seed)
    if not len(centres):
        centres = np.zeros((1, len((held.select("embedding").first() or [[0.0]])[0])))
    rows = held.select("chunk_id", "class_id", "embedding")
    kind = T.StructType([*rows.schema, T.StructField("cell", T.IntegerType())])

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            cell = np.argmax(unit(matrix_of(batch.column(2), centres.shape[1])) @ centres.T, axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32))], kind.names)

    rows.mapInArrow(dealt, kind).hint("rebalance", "cell").sortWithinPartitions("cell", "class_id").write.partitionBy("cell").parquet(f"{path}/vectors")
    rule = (F.first(c).alias(c) for c in ("tenant_id", "acl_public", "acl_groups"))
    held.groupBy("class_id").agg(*rule).coalesce(1).write.parquet(f"{path}/classes")
    spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "cell int, centre array<double>").coalesce(1).write.parquet(f"{path}/centres")


def read_vectors(chunks: DataFrame, path: str, probes: int = 8) -> VectorIndex:
    """The stored vectors of these chunks."""
    spark = chunks.sparkSession
    centres = np.array([r["centre"] for r in spark.read.parquet(f"{path}/centres").orderBy("cell").collect()])  # MOST_CELLS rows at most
    kind, numbers = (chunks.schema[c].dataType.simpleString() for c in ("chunk_id", "embedding"))
    rows = spark.read.schema(f"chunk_id {kind}, class_id long, embedding {numbers}, cell int").parquet(f"{path}/vectors")
    classes = spark.read.schema("class_id long, tenant_id string, acl_public boolean, acl_groups array<string>").parquet(f"{path}/classes")
    return VectorIndex(chunks, rows, centres, classes, probes)


def nearest_cells(centres: np.ndarray, matrix: np.ndarray, probes: int) -> np.ndarray:
    """For each query, whether each cell is among the ``probes`` nearest to it."""
    s = unit(matrix) @ centres.T
    out = np.zeros(s.shape, bool)
    np.put_along_axis(out, np.argsort(-s, axis=1, kind="stable")[:, :probes], True, axis=1)
    return out


def near(index: VectorIndex, ids: Sequence[int], vectors: Sequence[Sequence[float]], sees: Column, k: int, probes: int | None = None, where: Column | None = None) -> DataFrame:
    """``(query_id, chunk_id, score)``: a few rows more than the k best by cosine of each query, from its ``probes`` nearest cells.

    Each Arrow batch meets all queries as one matrix product and passes on the
    k best rows of each query that reads the row's cell.
    """
    matrix = unit(np.array(vectors, np.float64))
    if matrix.shape[1] != index.centres.shape[1]:
        raise ValueError(f"embeddings of {matrix.shape[1]} and {index.centres.shape[1]} numbers")
    reads = nearest_cells(index.centres, matrix, index.probes if probes is None else probes)
    names = np.array(ids, np.int64)
    wanted = np.flatnonzero(reads.any(axis=0)).tolist()
    rows = index.rows
    if len(wanted) < len(index.centres):
        rows = rows.where(F.col("cell").isin(wanted))
    rows = rows.join(index.classes.where(sees).select("class_id"), "class_id", "left_semi")
    if where is not None:
        rows = rows.join(index.chunks.where(where).select("chunk_id"), "chunk_id", "left_semi")

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            s = matrix @ unit(matrix_of(batch.column(1), matrix.shape[1])).T
            s[~reads[:, batch.column(2).to_numpy()]] = -np.inf
            most = min(k, s.shape[1])
            cut = -np.partition(-s, most - 1, axis=1)[:, most - 1 : most] - 2e-9
            q, c = np.nonzero((s >= cut) & (s > -np.inf))
            yield pa.RecordBatch.from_arrays([pa.array(names[q]), pa.array(batch.column(0).to_numpy()[c]), pa.array(s[q, c])], ["query_id", "chunk_id", "score"])

    return rows.select(F.col("chunk_id").cast("long").alias("chunk_id"), "embedding", "cell").mapInArrow(scored, "query_id long, chunk_id long, score double")


def probes_for(index: VectorIndex, recall: float = 0.95, k: int = 60, queries: int = 64, seed: int = 7) -> int:
    """The fewest probes that find this share of the k nearest neighbours, measured on ``queries`` stored vectors against all cells."""
    some = index.rows.orderBy(F.xxhash64("chunk_id", F.lit(seed))).limit(queries).select("chunk_id", "embedding").collect()
    if not some:
        return 1
    ids, vectors = [r["chunk_id"] for r in some], np.array([r["embedding"] for r in some], np.float64)
    found = near(index, range(len(ids)), vectors, F.lit(True), k, len(index.centres)).join(index.rows.select(F.col("chunk_id").cast("long").alias("chunk_id"), "cell"), "chunk_id")
    best = found.groupBy("query_id").agg(F.slice(F.sort_array(F.collect_list(F.struct("score", "chunk_id", "cell")), asc=False), 1, k).alias("best"))  # some more than k a batch
    order = np.argsort(-(unit(vectors) @ index.centres.T), axis=1, kind="stable")
    place = np.argsort(order, axis=1)
    needed = np.sort([place[r["query_id"], b["cell"]] + 1 for r in best.collect() for b in r["best"]])
    return int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))) - 1)])
