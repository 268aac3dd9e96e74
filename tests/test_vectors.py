"""The stored vector index against exact search: recall, all cells, access, odd rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators import search, vectors


def _chunks(spark, x, rule=lambda i: (True, ())):
    rows = [(i, "t" if i % 7 else "u", *rule(i), None if v is None else [float(a) for a in v]) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "chunk_id long, tenant_id string, acl_public boolean, acl_groups array<string>, embedding array<float>")


@pytest.fixture(scope="module")
def clustered():
    rng = np.random.default_rng(1)
    return np.repeat(rng.normal(size=(40, 16)), 60, axis=0) + 0.4 * rng.normal(size=(2400, 16))


@pytest.fixture(scope="module")
def stored(spark, clustered, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("v") / "v")
    chunks = _chunks(spark, clustered, lambda i: (i % 3 == 0, ("a",) if i % 2 else ()))
    vectors.write_vectors(chunks, path, cells=40)
    return vectors.read_vectors(chunks, path)


def _hits(rows):
    return {(r.query_id, r.chunk_id) for r in rows.collect()}


def test_recall_with_few_cells(spark, clustered, stored):
    rng = np.random.default_rng(2)
    queries = [search.Query(i, None, tuple(clustered[j] + 0.1 * rng.normal(size=16))) for i, j in enumerate(rng.integers(0, 2400, 30))]
    who = search.Principal("t", (), True)
    exact = _hits(search.dense(stored.chunks.where(who.sees()), queries, 60))
    probes = vectors.probes_for(stored, recall=0.95, k=60)
    found = _hits(search.dense_of_cells(stored, queries, who, 60, probes))
    assert probes <= 16 and len(exact & found) >= 0.9 * len(exact)
    assert _hits(search.dense_of_cells(stored, queries, who, 60, len(stored.centres))) == exact


def test_a_search_reads_its_cells_only(stored, clustered):
    rows = vectors.near(stored, [1], [clustered[0]], F.lit(True), 5, probes=1)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [cell" in plan.replace("isnotnull(cell#", "") or "cell" in plan.split("PartitionFilters: [")[1].split("]")[0]
    best = vectors.nearest_cells(stored.centres, np.array([clustered[0]]), 1)[0].argmax()
    cells = {r.chunk_id: r.cell for r in stored.rows.select("chunk_id", "cell").collect()}
    assert {cells[r.chunk_id] for r in rows.collect()} == {int(best)}


def test_access_and_filter(stored, clustered):
    queries = [search.Query(1, None, tuple(clustered[5]))]
    who, every = search.Principal("t", ("a",)), len(stored.centres)
    seen = stored.chunks.where(who.sees())
    assert _hits(search.dense_of_cells(stored, queries, who, 50, every)) == _hits(search.dense(seen, queries, 50))
    where = F.col("chunk_id") % 5 == 1
    assert _hits(search.dense_of_cells(stored, queries, who, 50, every, where)) == _hits(search.dense(seen.where(where), queries, 50))
    assert search.dense_of_cells(stored, [search.Query(1, "x")], who, 5).count() == 0
    with pytest.raises(ValueError):
        search.dense_of_cells(stored, [search.Query(1, None, (1.0,))], who, 5)


def test_odd_vectors(spark, tmp_path):
    x = [None, [0.0, 0.0], [1.0, 0.0], [1.0, 0.0], [0.0, 2.0], None]
    chunks = _chunks(spark, x)
    vectors.write_vectors(chunks, str(tmp_path / "v"), cells=3)
    index = vectors.read_vectors(chunks, str(tmp_path / "v"))
    got = search.dense_of_cells(index, [search.Query(1, None, (3.0, 0.1))], search.Principal("t", (), True), 9, 99).orderBy("rank").collect()
    assert [r.chunk_id for r in got] == [2, 3, 4, 1]
    nothing = chunks.where("false")
    vectors.write_vectors(nothing, str(tmp_path / "n"))
    empty = vectors.read_vectors(nothing, str(tmp_path / "n"))
    assert empty.rows.count() == 0 and vectors.probes_for(empty) == 1
