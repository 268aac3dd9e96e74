"""Connected components of a link table by contraction inside partitions and alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from millrace.llm.scratch import dropped, written

#: Nodes that a task holds while it contracts links.
HELD = 1 << 18
#: Links for each task that contracts them; so many have at most half of HELD nodes.
LINKS = 1 << 16


def _contracted(edges: DataFrame) -> DataFrame:
    """Links (a > b) with the same components: those of a run of HELD nodes of a partition as stars about their smallest nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict[int, int] = {}

        def find(x: int) -> int:
            while parent[x] != x:
                parent[x] = x = parent[parent[x]]
            return x

        def stars() -> pa.RecordBatch:
            found = [(x, r) for x in parent if (r := find(x)) != x]
            return pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([r for _, r in found], pa.int64())], ["a", "b"])

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                parent.setdefault(a, a)
                parent.setdefault(b, b)
                a, b = find(a), find(b)
                parent[max(a, b)] = min(a, b)
                if len(parent) >= HELD:
                    yield stars()
                    parent.clear()
        if parent:
            yield stars()

    return edges.select("a", "b").mapInArrow(run, "a long, b long")


def _tasks(links: int) -> int:
    return max(1, -(-links // LINKS))


def connected_components(links: DataFrame) -> DataFrame:
    """``links(a long, b long)`` -> ``(node, component)``, component being the smallest node reachable.

    Every step is a partially aggregated minimum and a join, so no node's
    neighbours meet in one place; each round is written to the shared folder.
    Null ends and self-links are ignored. Nodes without links are not returned.
    The rounds needed grow with the logarithm of the longest path between
    partitions. Tasks that contract links are dealt LINKS of them, whatever the
    session's shuffle partitions; up to LINKS links in all are one such task,
    whose stars are the components. ``links`` is read twice.
    """
    some = links.count()
    oriented = links.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges, before = written(_contracted(oriented.coalesce(_tasks(some))), "links"), None
    while some > LINKS:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before or not now[0]:
            break
        before = now
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).distinct()
        after = written(_contracted(small.coalesce(_tasks(now[0]))), "links")
        dropped(edges)
        edges = after
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
