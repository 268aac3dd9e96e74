"""Tables in buckets, and the ingest of batches into them and into the text index."""

import os
import random

import pytest
from pyspark.sql import functions as F

from millrace.operators import buckets, index, pipeline
from tests.test_index import _files
from tests.test_operators import _same_index


def _table(spark, path, rows, count=8):
    return buckets.write_buckets(spark.createDataFrame(rows, "document_id long, n int, text string"), path, count=count)


def _read(table):
    return sorted(map(tuple, table.rows().collect()), key=repr)


def test_only_touched_buckets_are_written(spark, tmp_path):
    rows = [(i, k, f"t{i}") for i in range(300) for k in range(2)]
    table = _table(spark, str(tmp_path / "t"), rows, 32)
    assert _read(table) == sorted(rows, key=repr)
    before = _files(tmp_path / "t")
    keys, new = spark.createDataFrame([(5,), (6,), (7,)], "document_id long"), spark.createDataFrame([(5, 9, "new"), (1000, 1, "added")], table.schema)
    for _ in range(2):  # the second time changes nothing
        table.replace(keys, new)
        assert _read(table) == sorted([r for r in rows if r[0] not in (5, 6, 7)] + [(5, 9, "new"), (1000, 1, "added")], key=repr)
    folders = lambda files: {os.path.basename(os.path.dirname(f)) for f in files if f.endswith(".parquet")}
    changed = {f for f in before if f.endswith(".parquet")} - {f for f, t in _files(tmp_path / "t").items() if before.get(f) == t}
    assert 1 <= len(folders(changed)) <= 4
    table.upsert(spark.createDataFrame([(5, 1, "x"), (2000, 2, "y")], table.schema), ["text"])
    assert {r for r in _read(table) if r[0] in (5, 2000)} == {(5, 9, "x"), (2000, 2, "y")}
    assert sorted(map(tuple, table.of(keys).collect())) == [(5, 9, "x")]


def test_emptied_buckets_and_counts(spark, tmp_path):
    table = _table(spark, str(tmp_path / "t"), [(1, 0, "a"), (2, 0, "b"), (None, 0, "c")], 1000)
    keys = spark.createDataFrame([(1,)], "document_id long")
    with pytest.raises(ValueError):
        table.replace(keys, table.rows().where("document_id = 2"), spark.createDataFrame([(2, 2)], "document_id long, n long"))
    assert len(_read(table)) == 3
    table.replace(keys, table.rows().where("false"))
    assert _read(table) == sorted([(2, 0, "b"), (None, 0, "c")], key=repr)
    table.replace(table.rows().select("document_id"), table.rows().where("false"))
    assert [r for r in _read(table) if r[0] is not None] == []


DOCUMENTS = "document_id long, stage string, progress double, error string, content_hash string, extractor_version int, chunker_version int, embedding_version string, chunk_count long, token_count long"
CHUNKS = "document_id long, tenant_id string, ordinal int, heading string, content string, context_text string, token_count long, embedding array<double>, embedding_version string, acl_public boolean, acl_groups array<string>"


def test_batches_into_tables_and_index(spark, tmp_path):
    rng = random.Random(1)
    text = lambda: " ".join(f"w{rng.randrange(50)}" for _ in range(rng.randrange(20, 400))) + "."
    docs = buckets.write_buckets(spark.createDataFrame([(i, "queued", 0.0, None, None, None, None, None, None, None) for i in range(20)], DOCUMENTS), str(tmp_path / "d"), count=4)
    chunks = buckets.write_buckets(spark.createDataFrame([], CHUNKS), str(tmp_path / "c"), count=4)
    path, staging = str(tmp_path / "i"), str(tmp_path / "s")
    index.write_index(pipeline.indexed_rows(chunks.rows()), path, buckets=2)
    embed = lambda rows: rows.select("document_id", "ordinal", F.array(F.length("context_text").cast("double")).alias("embedding"))
    now = F.expr("timestamp_ntz'2024-01-01 00:00:00'")

    def ask(ids, batch, group="a", how=embed):
        rows = [(i, "t", "txt", f"T{i}", "f.txt", texts[i], False, [group]) for i in ids]
        requests = spark.createDataFrame(rows, "document_id long, tenant_id string, kind string, title string, path string, text string, acl_public boolean, acl_groups array<string>")
        pipeline.ingest_stored(requests, docs, chunks, path, staging, pipeline.Versions(1, 1, "e"), how, now, batch)

    texts = {i: text() for i in range(20)}
    texts[3] = ""
    ask(range(20), "b0")
    state = {r.document_id: r.stage for r in docs.rows().collect()}
    assert state == {i: "failed" if i == 3 else "ready" for i in range(20)}
    texts[4], texts[5] = text(), texts[5]
    for _ in range(2):  # the same batch again
        ask((4, 5), "b1", "b")
    held = pipeline.indexed_rows(chunks.rows())
    _same_index(index.read_index(held, path), index.index_of(held))
    assert {tuple(r.acl_groups) for r in chunks.rows().where("document_id = 4").collect()} == {("b",)}
    with pytest.raises(ValueError):
        texts[6] = text()
        ask((6,), "b2", how=lambda rows: embed(rows).where("false"))
    _same_index(index.read_index(held, path), index.index_of(pipeline.indexed_rows(chunks.rows())))
