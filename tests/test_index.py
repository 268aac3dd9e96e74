"""Segments, positions and access classes of the stored index against an index of the same chunks and plain versions."""

import math
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.functions.access import contains
from millrace.functions.text import matches, parse_websearch, simple_tokens
from millrace.operators import index, mentions, search
from tests.test_operators import _same_index

RULES = [(True, ()), (False, ("a",)), (False, ("b", "a")), (False, ("a", "b", "b")), (None, None), (False, ())]


def _rows(rng, ids, words=30):
    return [(i, rng.choice(["t", "t", "u"]), *rng.choice(RULES), None if rng.random() < 0.05 else " ".join(f"w{int(rng.random() ** 2 * words)}" for _ in range(rng.randrange(25)))) for i in ids]


def _chunks(spark, rows):
    return spark.createDataFrame(rows, "chunk_id long, tenant_id string, acl_public boolean, acl_groups array<string>, content string")


@pytest.fixture(scope="module")
def rows():
    return _rows(random.Random(1), range(200))


def _files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names}


def test_segments_equal_a_fresh_index(spark, rows, tmp_path):
    path = str(tmp_path / "i")
    index.write_index(_chunks(spark, rows), path, buckets=4)
    rng, now = random.Random(2), {r[0]: r for r in rows}
    for step in range(3):
        changed = rng.sample(sorted(now), 6)
        new = {r[0]: r for r in _rows(rng, [*changed[:4], 1000 + step])}
        before, after = [now[i] for i in changed], list(new.values())
        for i in changed:
            del now[i]
        now.update(new)
        kept = _files(path)
        index.update_index(path, _chunks(spark, before), _chunks(spark, after), merge=step == 2)
        assert kept.items() <= _files(path).items()  # what was there is neither changed nor written again
        written = sum(os.path.getsize(f) for f in _files(path).keys() - kept.keys() if "/segments/" in f and f.endswith(".parquet") and "postings" in f)
        assert step == 2 or written < sum(os.path.getsize(f) for f in kept if "postings" in f and f.endswith(".parquet"))
        stored, fresh = index.read_index(_chunks(spark, list(now.values())), path), index.index_of(_chunks(spark, list(now.values())))
        _same_index(stored, fresh)
    m = index.manifest(spark, path)
    assert len(m.segments) == 2 and m.version == 4  # three small segments became one
    for who in (search.Principal("t", ("a",)), search.Principal("t"), search.Principal("u", (), True)):
        queries = [search.Query(1, "w1 or w2"), search.Query(2, "w3 -w0"), search.Query(3, '"w1 w2"')]
        a, b = (sorted((r.query_id, r.chunk_id, round(r.score, 9), r.rank) for r in search.lexical(i, queries, who, 9).collect()) for i in (stored, fresh))
        assert a == b and a


def test_files_grow_with_rows_and_not_with_their_square(spark, tmp_path):
    """A large partition that is split writes a bucket's rows, not those of many buckets in each part."""
    text = " ".join(f"w{i}" for i in range(300))
    chunks = spark.range(0, 400, 1, 8).select(F.col("id").alias("chunk_id"), F.lit("t").alias("tenant_id"), F.lit(True).alias("acl_public"), F.array().cast("array<string>").alias("acl_groups"), F.lit(text).alias("content"))
    key = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, "16k")
        index.write_index(chunks, str(tmp_path), buckets=60)
    finally:
        spark.conf.set(key, before)
    assert sum("/postings/" in f and f.endswith(".parquet") for f in _files(tmp_path)) <= 61 * 4
    found = index.read_index(chunks, str(tmp_path))
    assert found.postings.count() == 400 * 300 and found.lengths.count() == 400


def test_rows_stored_are_terms_of_runs_and_not_postings(spark, tmp_path):
    """A term of many chunks is a row for each run of chunks, also after a merge."""
    path = str(tmp_path / "i")
    text = F.concat(F.lit("all of them "), F.col("id").cast("string"))
    made = lambda a, b: spark.range(a, b, 1, 2).select(F.col("id").alias("chunk_id"), F.lit("t").alias("tenant_id"), F.lit(True).alias("acl_public"), F.array().cast("array<string>").alias("acl_groups"), text.alias("content"))
    index.write_index(made(0, 300), path, buckets=2)
    index.update_index(path, made(0, 10), made(300, 700))
    assert len(index.manifest(spark, path).segments) == 1
    stored = spark.read.parquet(f"{index.manifest(spark, path).segments[0][0]}/postings")
    assert stored.where("term in ('all', 'of', 'them')").count() == 3 and stored.where("term is null").count() == 1 and stored.where("term > '' and term < 'a'").count() == 690
    _same_index(index.read_index(made(10, 700), path), index.index_of(made(10, 700)))


def test_merge_by_size(spark, tmp_path):
    path, rng = str(tmp_path / "i"), random.Random(3)
    chunks = {r[0]: r for r in _rows(rng, range(4))}
    index.write_index(_chunks(spark, list(chunks.values())), path)
    for k in range(3):
        new = _rows(rng, range(10 * (k + 1), 10 * (k + 1) + 4))
        chunks |= {r[0]: r for r in new}
        index.update_index(path, _chunks(spark, new).where("false"), _chunks(spark, new))
    assert [n for _, n in index.manifest(spark, path).segments] in ([16], [12, 4])
    gone = list(chunks.values())
    index.update_index(path, _chunks(spark, gone), _chunks(spark, gone).where("false"))
    left = index.read_index(_chunks(spark, gone).where("false"), path)
    assert left.postings.count() == left.frequencies.count() == left.classes.count() == left.lengths.count() == 0


def test_search_of_positions_equals_search_of_texts(spark, rows):
    chunks = _chunks(spark, rows)
    plain = index.index_of(chunks)
    asked = ["w1 w2", "w1 -w2", '"w1 w2"', 'w0 -"w1 w0"', "w1 or w9 w3", '"w0 w1 w0"', "-w0", "w77", '"w2 w77"', "w5 w5"]
    queries = [search.Query(i, q) for i, q in enumerate(asked)]
    got = {(r.query_id, r.chunk_id) for r in search.lexical(plain, queries, search.Principal("t", (), True), 1000).collect()}
    tokens = chunks.where("tenant_id = 't'").withColumn("k", simple_tokens(F.col("content")))
    want = set()
    for q in queries:
        groups = parse_websearch(q.text)
        some = F.arrays_overlap("k", F.array(*(F.lit(t) for g in groups for c in g for t in c.terms)))
        want |= {(q.query_id, r.chunk_id) for r in tokens.where(matches(F.col("k"), groups) & some).collect()}
    assert got == want


def test_frequencies_are_those_of_the_callers_chunks(spark, rows):
    plain = index.index_of(_chunks(spark, rows))
    for who in (search.Principal("t"), search.Principal("t", ("a",)), search.Principal("t", ("b", "c")), search.Principal("t", (), True), search.Principal("nobody", (), True)):
        seen = [set((r[4] or "").split()) for r in rows if r[1] == who.tenant_id and (who.is_admin or r[2] or set(r[3] or ()) & set(who.groups))]
        n = max(1, sum(r[1] == who.tenant_id for r in rows))
        for r in search.idf(plain, ["w0", "w1", "w29", "none"], who).collect():
            df = sum(r.term in s for s in seen)
            assert r.df == df and math.isclose(r.idf, math.log(1 + (n - df + 0.5) / (df + 0.5)))


def test_a_filter_leaves_frequencies(spark, rows):
    plain = index.index_of(_chunks(spark, rows))
    who, queries = search.Principal("t", (), True), [search.Query(1, "w1 or w4")]
    everything = {r.chunk_id: r.score for r in search.lexical(plain, queries, who, 1000).collect()}
    some = {r.chunk_id: r.score for r in search.lexical(plain, queries, who, 1000, F.col("chunk_id") % 3 == 0).collect()}
    assert some == {c: s for c, s in everything.items() if c % 3 == 0}


def _plain_density(words, wanted):
    """Shortest stretches that hold all wanted words, by trying all."""
    fits = lambda a, b: set(wanted) <= set(words[a : b + 1])
    total = 0.0
    for a in range(len(words)):
        for b in range(a, len(words)):
            if fits(a, b) and not fits(a + 1, b) and not fits(a, b - 1):
                total += search.COVER / (1 + sum(w not in wanted for w in words[a : b + 1]))
    return total


def test_cover_density():
    rng = random.Random(4)
    for _ in range(300):
        words = [rng.choice("abcdef") for _ in range(rng.randrange(20))]
        places = {w: np.flatnonzero([x == w for x in words]) for w in set(words)}
        wanted = rng.sample("abcd", rng.randrange(1, 4))
        assert math.isclose(search.cover_density(parse_websearch(" ".join(wanted)), places), _plain_density(words, wanted), abs_tol=1e-12)
    places = {"a": np.array([0, 5]), "b": np.array([1, 9])}
    assert math.isclose(search.cover_density(parse_websearch('"a b" or b'), places), search.COVER * (1 + 1 + 1))
    assert search.cover_density(parse_websearch("a -b"), places) == 0


def test_prefilter_keeps_the_closest(spark):
    far = [(i, "t", True, None, "x " + "z " * i + "y") for i in range(20)] + [(99, "t", True, None, "x")]
    plain = index.index_of(_chunks(spark, far))
    got = search.lexical(plain, [search.Query(1, "x y")], search.Principal("t"), 2, prefilter=3).collect()
    assert len(got) == 2 and {r.chunk_id for r in got} <= {0, 1, 2}
    bag = search.lexical(plain, [search.Query(1, "x y")], search.Principal("t"), 2, any_term=True, prefilter=3).collect()
    assert len(bag) == 2


# ---- trigrams


def test_trigrams_find_what_a_scan_finds(spark, tmp_path):
    rng = random.Random(6)
    letters = ["a", "b", "B", "é", "É", "日", "🙂", " ", "%", "İ"]
    rows = [(i, "t", True, None, None if i == 7 else "".join(rng.choice(letters) for _ in range(rng.choice([0, 2, 3, 40])))) for i in range(120)]
    shaped = lambda r: _chunks(spark, r).selectExpr("*", "concat('T ', chunk_id) as title", "'web' as source_kind", "'s' as source_id", "0 as ordinal")
    path = str(tmp_path / "i")
    index.write_index(shaped(rows), path, buckets=3, fields=("content", "title"))
    changed = [(i, "t", True, None, "aBé" * (i % 3)) for i in range(10, 14)]
    index.update_index(path, shaped(rows[10:14]), shaped(changed), merge=False)
    now = [changed[r[0] - 10] if 10 <= r[0] < 14 else r for r in rows]
    for _ in range(2):
        stored = index.read_index(shaped(now), path)
        for needle in ("abé", "aB", "🙂 b", "a%b", "İ é", "abéabé"):
            got = sorted(map(tuple, mentions.indexed_mentions(stored, needle, F.lit(True)).select("chunk_id", "match_offset", "occurrences").collect()))
            want = sorted(map(tuple, mentions.find_mentions(stored.chunks, needle, F.lit(True)).select("chunk_id", "match_offset", "occurrences").collect()))
            assert got == want, needle
        assert stored.may_hold("ab") is None and stored.may_hold("zzz").count() == 0
        assert {r.chunk_id for r in mentions.titled(stored, "t 11", F.lit(True)).collect()} == {11, *range(110, 120)}
        assert {r.chunk_id for r in mentions.titled(stored, "9", F.lit(True)).collect()} == {i for i in range(120) if "9" in str(i)}
        index.merge_segments(spark, path, factor=10_000)
    assert len(index.manifest(spark, path).segments) == 1


def test_metadata_by_values_at_paths(spark, tmp_path):
    documents = ['{"a": 1, "b": {"c": ["x", {"d": true}], "e": null}}', '{"a": 1.0, "b": {"c": "x"}}', '{"a": "1"}', '{"b": {"e": null, "c": ["y"]}}', "[1, 2]", "not json", None, '{"a": [1]}', "{}"]
    rows = _chunks(spark, [(i, "t", True, None, "w") for i in range(len(documents))])
    rows = rows.join(spark.createDataFrame(list(enumerate(documents)), "chunk_id long, metadata string"), "chunk_id")
    index.write_index(rows, str(tmp_path / "i"), buckets=3, fields=("metadata@json",))
    stored = index.read_index(rows, str(tmp_path / "i"))
    for wanted in ({"a": 1}, {"b": {"c": ["x"]}}, {"b": {"c": [{"d": True}]}}, {"b": {"e": None}}, {"a": 1, "b": {"c": "x"}}, [1], {"a": "2"}, {}, {"b": {}}):
        got = {r.chunk_id for r in mentions.with_metadata(stored, wanted, F.lit(True)).collect()}
        want = {r.chunk_id for r in rows.where(contains(F.try_parse_json("metadata"), wanted)).collect()}
        assert got == want, wanted
    held = stored.may_contain({"a": 1})
    assert {r.chunk_id for r in held.collect()} == {0, 1} and stored.may_contain({}) is None
    assert "In(gram" in held._jdf.queryExecution().toString() or "EqualTo(gram" in held._jdf.queryExecution().toString()


def test_positions_are_one_flat_list_of_a_run(spark):
    """A row of a run holds plain lists only: a list for each posting would be shuffled and written with a header of its own."""
    chunks = _chunks(spark, [(1, "t", True, (), "b a b"), (2, "t", True, (), None), (3, "t", True, (), "a c a a")]).coalesce(1)
    got = {r.term: (r.chunks, r.ends, r.gaps) for r in index.analyzed(chunks).collect()}
    assert got == {None: ([1, 2, 3], [0, 0, 0], []), "a": ([1, 3], [1, 4], [1, 0, 2, 1]), "b": ([1], [2], [0, 2]), "c": ([3], [1], [1])}
    spread = {(r.term, r.chunk_id): (r.tf, r.n_terms, r.gaps) for r in index.index_of(chunks).postings.collect()}
    assert spread == {("a", 1): (1, 2, [1]), ("a", 3): (3, 2, [0, 2, 1]), ("b", 1): (2, 2, [0, 2]), ("c", 3): (1, 2, [1])}
    again = {r.term: (sorted(r.chunks), r.ends[-1], len(r.gaps)) for r in index._gathered(index.index_of(chunks).postings, 1).collect()}
    assert again == {"a": ([1, 3], 4, 4), "b": ([1], 2, 2), "c": ([3], 1, 1)}
