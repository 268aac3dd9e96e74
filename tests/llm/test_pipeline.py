"""The pipeline's stages against brute force, each on its own input, and the queries against their SQL."""

import hashlib
import zlib

import numpy as np
import pytest
from tests.conftest import SF, same_rows
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from millrace.llm import decontaminate, license_scan, queries, sharding, toxicity
from millrace.llm.tokens import public_path
from tests.llm.test_dedup import brute_components, brute_repeats
from tests.llm.test_other import plain_shard


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, duck, name):
    got = queries.QUERIES[name](spark, SF).toPandas()
    if name in queries.ORACLE_SQL:
        same_rows(got, duck.execute(queries.ORACLE_SQL[name]).df())
    else:
        table = "pages" if name.startswith("op4") else "documents"
        n = duck.execute(f"select count(*) from {table}").fetchall()[0][0]
        assert len(got) >= n and got.iloc[:, 0].notna().all()


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, names = docs.columns, [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "near_copies", "repeats", "benchmark", "packing"]
    rows = lambda df: [(r.doc_id, r.text) for r in df.orderBy("doc_id").collect()]
    stages = dict(corpus_pipeline.STAGES)

    model = toxicity.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    clean = stages["toxicity"](spark, docs, SF).cache()
    assert clean.columns == columns
    assert rows(clean) == [(d, t) for d, t in rows(docs) if model.scores([t])[0] < 0.5]

    single = stages["near_copies"](spark, clean, SF).cache()
    want = sorted(d for d, _, c in brute_components(rows(clean), 5, 80, 100) if d == c)
    assert single.columns == columns and [d for d, _ in rows(single)] == want

    cut = stages["repeats"](spark, single, SF).cache()
    before = dict(rows(single))
    want = {d: (t if gone else before[d]) for d, n, gone, t in brute_repeats(rows(single), 50) if not gone or gone < n}
    assert cut.columns == columns and dict(rows(cut)) == want
    assert cut.where("n_chars <> length(text)").count() == 0

    fair = stages["benchmark"](spark, cut, SF).cache()
    strings = set()
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        words = decontaminate.words_of(r.text)
        m = min(10, len(words))
        strings |= {tuple(words[i : i + m]) for i in range(len(words) - m + 1) if words}
    holds = lambda words: any(tuple(words[i : i + m]) in strings for m in {len(s) for s in strings} for i in range(len(words) - m + 1))
    bad = {d for d, t in rows(cut) if holds(decontaminate.words_of(t))}
    assert fair.columns == columns and [d for d, _ in rows(fair)] == [d for d, _ in rows(cut) if d not in bad] and bad

    pieces = stages["packing"](spark, fair, SF).toPandas()
    tokenizer = Tokenizer.from_file(public_path("byte_bpe_50k.json"))
    sizes = {d: len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1 for d, t in rows(fair)}
    assert pieces.groupby("doc_id")["length"].sum().to_dict() == sizes
    assert pieces.groupby("sequence_id")["length"].sum().max() <= 1024
    assert np.array_equal(np.sort(corpus_pipeline.run(spark, SF).toPandas()["doc_id"].unique()), np.sort(pieces["doc_id"].unique()))


def test_stages_take_odd_rows(spark, docs, nothing):
    """Nulls, empty texts, repeated rows, clashing names and empty tables, stage by stage."""
    names = ["n_removed", "kept_text", "k_0", "Text_key", "start", "ids", "c_0", "doc.id", "id", "bits"]
    odd = docs.selectExpr("*", "cast(null as array<int>) as n_chars", *(f"named_struct('a b', 1) as `{n}`" for n in names))
    empty = nothing.selectExpr(*(f"`{c}`" for c in nothing.columns))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        frame = odd.drop("n_chars") if name == "repeats" else odd  # n_chars follows the text there
        got = stage(spark, frame, SF)
        assert got.columns == frame.columns and [t for _, t in got.dtypes] == [t for _, t in frame.dtypes], name
        rows = got.select("doc_id", "text").collect()
        assert {(400, None), (401, ""), (402, "  \n\t ")} <= {tuple(r) for r in rows} and any(r.doc_id is None for r in rows), name
        assert stage(spark, empty, SF).count() == 0, name
    assert corpus_pipeline.packed(spark, odd, SF).select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
    assert corpus_pipeline.packed(spark, empty, SF).count() == 0


def test_queries_against_plain_versions(spark):
    """Queries that SQL cannot express, on the smallest tables."""
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()]
    raw = {d: (t or "").encode() for d, t in docs}

    byte, word = (Tokenizer.from_file(public_path(f)) for f in ("byte_bpe_50k.json", "word_bpe_49k.json"))
    crc = lambda ids: zlib.crc32(np.array(ids, "<u4").tobytes())
    ids = {d: byte.encode(t or "", add_special_tokens=False).ids + [0] for d, t in docs}
    pieces = queries.op1_hierarchical_packing(spark, SF).toPandas()
    assert pieces.groupby("doc_id")["length"].sum().to_dict() == {d: len(x) for d, x in ids.items()}
    assert all(p.ids_crc32 == crc(ids[p.doc_id][p.start : p.start + p.length]) and p.doc_tokens == len(ids[p.doc_id]) for p in pieces.itertuples())

    padded = {d: b + b" " * (-len(b) % 192 if b else 192) for d, b in raw.items()}
    for r in queries.op2_matroska_media(spark, SF).collect():
        p = padded[r.doc_id]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw[r.doc_id]), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]))

    start = 0
    for r in queries.op5_elias_fano_ids(spark, SF).orderBy("doc_id").collect():
        mine = word.encode(dict(docs)[r.doc_id] or "", add_special_tokens=False).ids + [2]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(mine), crc(mine))
        start += len(mine)

    scored = queries.op6_toxicity_pu(spark, SF).collect()
    assert len(scored) == len(docs) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in scored)

    placed = queries.op9_external_shuffle(spark, SF).collect()
    assert len(placed) == len(docs)
    for r in placed:
        assert (r.size, r.text_crc32) == (len(raw[r.doc_id]) + 8, zlib.crc32(raw[r.doc_id]))
        assert (r.shard, r.grown_shard) == (plain_shard(r.doc_id, 24, sharding.SEED), plain_shard(r.doc_id, 25, sharding.SEED))
    for s in range(24):
        own = sorted(r.slot for r in placed if r.shard == s)
        assert own == list(range(len(own)))

    shingled = lambda text: (lambda w: [tuple(w[i : i + 3]) for i in range(len(w) - 2)])(license_scan.plain(text).split())
    named = {r.doc_id: r.licenses for r in queries.op10_license_scan(spark, SF).collect()}
    assert set(named) == {d for d, _ in docs}
    for d, t in docs:  # templates without gaps: every license whose statement stands whole in a text is named
        line = " ".join(license_scan.plain(t).split())
        whole = {n for n, x in license_scan.TEMPLATES if " ".join(license_scan.plain(x).split()) in line}
        assert whole - {"BSD"} <= set(named[d].split(",")), d
        held = set(shingled(t))
        for name in filter(None, named[d].split(",")):
            assert any(len(set(shingled(x)) & held) >= 0.8 * len(set(shingled(x))) for n, x in license_scan.TEMPLATES if n == name), d
