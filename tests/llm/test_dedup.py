import itertools
import re
import time
from collections import Counter
from pathlib import Path

import numpy as np
import pytest

from millrace.llm import components, jaccard_join, substring_dedup, textnum


def lowered(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def shingle_set(text, n):
    w = lowered(text)
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def brute_components(rows, n, num, den):
    sets, parent = [shingle_set(t, n) for _, t in rows], list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in itertools.combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if sets[i] and sets[j] and den * both >= num * (len(sets[i]) + len(sets[j]) - both):
            parent[find(i)] = find(j)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(rows[i][0])
    least = {g: min((d for d in ids if d is not None), default=None) for g, ids in groups.items()}
    return Counter((rows[i][0], len(sets[i]), least[find(i)]) for i in range(len(rows)))


@pytest.mark.parametrize("n, num, den", [(4, 85, 100), (5, 80, 100), (2, 60, 100), (3, 40, 100)])
def test_similarity_classes(docs, corpus, n, num, den):
    got = Counter(tuple(r) for r in jaccard_join.similarity_classes(docs, n, num, den).collect())
    assert got == brute_components(corpus, n, num, den)


def test_large_groups(spark, monkeypatch):
    """Groups of many blocks, and frequent members in every prefix."""
    monkeypatch.setattr(jaccard_join, "COUNT_FLOOR", 2)
    monkeypatch.setattr(jaccard_join, "BLOCK", 5)
    rng = np.random.default_rng(1)
    base = [f"v{i}" for i in range(90)]
    rows = []
    for i in range(60):
        words = list(base)
        for k in rng.choice(90, rng.integers(0, 5), replace=False):
            words[k] = f"z{rng.integers(4)}"
        rows.append((i, " ".join(words)))
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    assert Counter(tuple(r) for r in jaccard_join.similarity_classes(frame, 3, 80, 100).collect()) == brute_components(rows, 3, 80, 100)


def test_hot_member_of_unlike_sets(spark, monkeypatch):
    """Short sets that share one member and little else, in groups beyond a block."""
    monkeypatch.setattr(jaccard_join, "BLOCK", 4)
    rng = np.random.default_rng(2)
    rows = [(i, f"a b c d {' '.join(f'w{rng.integers(6)}' for _ in range(rng.integers(0, 4)))}".strip()) for i in range(50)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    assert Counter(tuple(r) for r in jaccard_join.similarity_classes(frame, 2, 60, 100).collect()) == brute_components(rows, 2, 60, 100)


def test_rows_without_an_id_link_others(spark):
    words = [f"u{i}" for i in range(200)]
    middle, left, right = list(words), list(words), list(words)
    left[10:14], right[100:104] = ["x"] * 4, ["y"] * 4
    rows = [(1, " ".join(left)), (None, " ".join(middle)), (2, " ".join(right)), (None, "q r s"), (None, " ".join(middle))]
    want = brute_components(rows, 4, 93, 100)
    assert {c for d, _, c in want if d} == {1}
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert Counter(tuple(r) for r in jaccard_join.similarity_classes(frame, 4, 93, 100).collect()) == want


def classes_of(links, n):
    label = list(range(n))
    for a, b in links:
        label = [label[a] if x == label[b] else x for x in label]
    return [label.index(x) for x in label]


def test_prefix_tree_joins_all_similar_sets():
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 60, rng.integers(1, 50)).astype(np.uint64)) for _ in range(80)]
    sets += [np.delete(s, [len(s) // 2]) for s in sets[:20] if len(s) > 9]
    sets = list({s.tobytes(): s for s in sets}.values())
    both = lambda i, j: len(np.intersect1d(sets[i], sets[j]))
    order = jaccard_join.Order(np.arange(5, 30, dtype=np.uint64))
    for num in (50, 70, 85):
        similar = [(i, j) for i, j in itertools.combinations(range(len(sets)), 2) if 100 * both(i, j) >= num * (len(sets[i]) + len(sets[j]) - both(i, j))]
        found = list(jaccard_join.PrefixTree(sets, order).links(num, 100))
        assert {tuple(sorted(x[:2])) for x in found} <= set(similar) and all(o == both(i, j) for i, j, o in found)
        assert classes_of([x[:2] for x in found], len(sets)) == classes_of(similar, len(sets))
        labels = [i % 7 for i in range(len(sets))]
        joined = [(i, labels.index(labels[i])) for i in range(len(sets))]
        found = [x[:2] for x in jaccard_join.PrefixTree(sets).links(num, 100, labels)]
        assert classes_of(found + joined, len(sets)) == classes_of(similar + joined, len(sets))
    assert list(jaccard_join.PrefixTree([]).links(1, 2)) == []


def test_prefixes_miss_no_pair():
    rng = np.random.default_rng(6)
    for _ in range(400):
        a = np.unique(rng.integers(0, 1 << 62, int(rng.integers(2, 60))).astype(np.uint64))
        b = np.unique(np.concatenate((a[rng.random(len(a)) > 0.08], rng.integers(0, 1 << 62, int(rng.integers(0, 4))).astype(np.uint64))))
        both = len(np.intersect1d(a, b))
        if 100 * both >= 85 * (len(a) + len(b) - both):
            for order in (jaccard_join.Order(a[:0]), jaccard_join.Order(rng.permutation(a)[: len(a) // 2])):
                assert set(order.prefix(a, 85, 100).tolist()) & set(order.prefix(b, 85, 100).tolist())


def test_one_of_each(docs, corpus):
    kept = jaccard_join.one_of_each(docs)
    assert kept.columns == docs.columns
    want = {d for d, _, c in brute_components(corpus, 5, 80, 100) if d is not None and d == c}
    got = [r.doc_id for r in kept.collect()]
    assert sorted(d for d in got if d is not None) == sorted(want) and got.count(None) == 2


def test_nothing(nothing):
    assert jaccard_join.similarity_classes(nothing).count() == 0
    assert substring_dedup.remove_repeats(nothing).count() == 0


def test_components(spark):
    pairs = [(i, i + 1) for i in range(0, 40)] + [(100, 90), (90, 95), (7, 7), (None, 3)]
    got = dict(map(tuple, components.connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()))
    assert got == {i: 0 for i in range(41)} | {100: 90, 95: 90, 90: 90}


def brute_repeats(rows, window):
    split = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t or "")
    least = {}
    for d, t in rows:
        w = split(t)
        for i in range(len(w) - window + 1) if d is not None else ():
            key = tuple(w[i : i + window])
            least[key] = min(least.get(key, d), d)
    out = Counter()
    for d, t in rows:
        w, gone = split(t), set()
        for i in range(len(w) - window + 1) if d is not None else ():
            if least[tuple(w[i : i + window])] < d:
                gone |= set(range(i, i + window))
        out[(d, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone))] += 1
    return out


@pytest.mark.parametrize("window", [50, 20, 7, 2, 1])
def test_remove_repeats(docs, corpus, window):
    got = Counter(tuple(r) for r in substring_dedup.remove_repeats(docs, window).collect())
    assert got == brute_repeats(corpus, window)


def test_keep_and_clash(docs):
    kept = substring_dedup.remove_repeats(docs, keep=("label",), joined=False)
    assert kept.where("label = 'x'").count() == docs.count()
    assert kept.where("doc_id = 402").first().kept_text == "  \n\t " and kept.where("doc_id = 400").first().kept_text is None
    with pytest.raises(ValueError):
        substring_dedup.remove_repeats(docs, keep=("n_words",))


def test_pack():
    v = np.sort(np.random.default_rng(0).integers(0, 1 << 63, 999, dtype=np.uint64))
    assert (substring_dedup.unpack(substring_dedup.pack(v)) == v).all() and len(substring_dedup.unpack(b"")) == 0


def test_hashes_depend_on_content_only():
    texts = ["a b c d", None, "x  a\tb\nc d y", "", "é日 b"]
    one = [s.tolist() for s in textnum.shingle_sets(texts, 2)]
    many = [next(textnum.shingle_sets([t], 2)).tolist() for t in texts]
    assert one == many and set(one[0]) <= set(one[2]) and [len(s) for s in one] == [3, 0, 5, 0, 1]


def test_equal_rows_are_spread_over_cells(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "COPIES", 500)
    text = " ".join(f"w{k}" for k in range(60))
    rows = spark.range(100_000).selectExpr("7L as doc_id", f"'{text}' as text").unionByName(spark.range(20_000).selectExpr("cast(null as long) as doc_id", "cast(null as string) as text"))
    sizes = [r["count"] for r in substring_dedup._dealt(rows, 1000).groupBy("cell").count().collect()]
    assert sum(sizes) == 120_000 and max(sizes) <= 3000
    few = spark.range(3000).selectExpr("7L as doc_id", f"'{text}' as text").unionByName(spark.createDataFrame([(8, "x " + text), (6, "y")], "doc_id long, text string"))
    for most in (20_000, 0):
        monkeypatch.setattr(substring_dedup, "SENT_COPIED", most)
        got = Counter(map(tuple, substring_dedup.remove_repeats(few, 50).select("doc_id", "n_words", "n_removed").collect()))
        assert got == Counter({(7, 60, 0): 3000, (8, 61, 60): 1, (6, 1, 0): 1})


def test_members_are_shuffled_once(spark):
    """Rows of prefixes are counted and chosen behind one exchange, however few are chosen."""
    rows = [(1, 10, [7, 8]), (2, 10, [7, 9]), (3, 10, [5, 6]), (3, 10, [5, 6]), (4, 40, [11, 12, 7]), (5, 10, None)]
    nodes = spark.createDataFrame(rows, "set_id long, n_shingles long, keys array<long>")
    found = jaccard_join._members(nodes, 85, 100)
    assert sorted(map(tuple, found.collect())) == [(7, 1), (7, 2), (7, 4)]
    plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("Exchange hashpartitioning(h") == 2 and plan.count("ReusedExchange") == 1 and "Broadcast" not in plan


def test_tasks_follow_the_rows(spark, docs, corpus, monkeypatch):
    """A session with many more shuffle partitions than the rows need runs few tasks in a step, and few links need no rounds."""
    names = ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")
    before, files = [spark.conf.get(k) for k in names], []

    def seen(write):
        def run(df, tag, *tasks):
            out = write(df, tag, *tasks)
            files.append((tag, len(out.inputFiles())))
            return out

        return run

    monkeypatch.setattr(jaccard_join, "written", seen(jaccard_join.written))
    monkeypatch.setattr(components, "written", seen(components.written))
    try:
        for k, v in zip(names, ("50", "false")):
            spark.conf.set(k, v)
        got = Counter(tuple(r) for r in jaccard_join.similarity_classes(docs, 4, 85, 100).collect())
    finally:
        for k, v in zip(names, before):
            spark.conf.set(k, v)
    assert got == brute_components(corpus, 4, 85, 100)
    assert max(n for _, n in files) <= spark.sparkContext.defaultParallelism
    assert [tag for tag, _ in files].count("links") <= 4  # a table of links and one of components, at two places at most


def test_components_of_several_tasks(spark, monkeypatch):
    monkeypatch.setattr(components, "LINKS", 6)
    monkeypatch.setattr(components, "HELD", 12)
    rng = np.random.default_rng(3)
    pairs = [tuple(map(int, rng.integers(0, 70, 2))) for _ in range(50)] + [(100 + i, 101 + i) for i in range(25)]
    nodes = sorted({x for a, b in pairs if a != b for x in (a, b)})
    label = classes_of([(nodes.index(a), nodes.index(b)) for a, b in pairs if a != b], len(nodes))
    got = dict(map(tuple, components.connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()))
    assert got == {x: nodes[k] for x, k in zip(nodes, label)}


def written_tables(monkeypatch):
    """The tables that a call of the operator writes, by tag."""
    found, write = {}, jaccard_join.written

    def run(df, tag, *tasks):
        out = write(df, tag, *tasks)
        found.setdefault(tag, []).append([r.asDict() for r in out.collect()] if tag in ("groups", "blocks") else None)
        return out

    monkeypatch.setattr(jaccard_join, "written", run)
    return found


def unlike_texts(rng, n, shared, own):
    """Texts of random words that hold one passage."""
    passage = " ".join(f"p{i}" for i in range(shared))
    return [(i, f"{passage} {' '.join(f'w{k}' for k in rng.integers(0, 1 << 40, own))}") for i in range(n)]


def test_frequent_members_are_counted_over_all_parts(spark, monkeypatch):
    """A passage that few texts of each partition hold, but many of all, brings no large group together."""
    rows = unlike_texts(np.random.default_rng(8), 120, 60, 100)
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(24)
    found = written_tables(monkeypatch)
    got = Counter(tuple(r) for r in jaccard_join.similarity_classes(frame, 5, 80, 100).collect())
    assert got == brute_components(rows, 5, 80, 100)
    assert max([0, *(r["size"] for r in found["groups"][0])]) < jaccard_join.COUNT_FLOOR

    counts = Counter(h for s in textnum.shingle_sets([t for _, t in rows], 5) for h in s[: 2 * jaccard_join.prefix_length(len(s), 80, 100)].tolist())
    often = jaccard_join._frequent(frame, 5, 80, 100).tolist()
    assert often and set(often) == {h for h, c in counts.items() if c >= jaccard_join.COUNT_FLOOR}
    assert [counts[h] for h in often] == sorted(counts[h] for h in often)


def test_bitmaps_rule_out_unlike_sets_of_any_size(spark, monkeypatch):
    """Sets that fill the small bitmap are told apart by the wide one, so their texts are not read."""
    rng = np.random.default_rng(9)
    rows = [(100 * k + i, f"{k} {t}") for k, own in enumerate((1400, 1700, 2300, 2900, 3500)) for i, t in unlike_texts(rng, 6, 80, own)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    found = written_tables(monkeypatch)
    got = jaccard_join.similarity_classes(frame, 5, 80, 100).collect()
    assert all(r.doc_id == r.component_id for r in got) and len(got) == 30
    assert found["groups"][0] and found["blocks"][0] == []


def test_shuffle_files_go_with_their_step(spark, docs, monkeypatch):
    top = Path(spark.sparkContext._temp_dir).parent.parent
    files = lambda: set(top.rglob("shuffle_*.data"))
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    kept = docs.groupBy("doc_id").count()
    kept.collect()
    before, setting = files(), spark.conf.get(name)
    assert before  # those of a step outside stay
    values, write = [], jaccard_join.written
    monkeypatch.setattr(jaccard_join, "written", lambda df, *a: values.append(spark.conf.get(name)) or write(df, *a))
    jaccard_join.similarity_classes(docs, 4, 85, 100)
    assert set(values) == {"true"}
    end = time.time() + 20
    while files() - before and time.time() < end:  # they go in the background
        time.sleep(0.2)
    assert not files() - before and spark.conf.get(name) == setting
