"""Divergence of word use between the sources of a language.

Terms are counted inside the input's partitions, then by (language, source,
term). A language keeps the terms of enough of its documents; they get ids in
blocks of a bounded number. A group (language, source) is one sorted array of
(term id, count) for each block, and every unordered pair of groups is a task
for each block: a galloping intersection prices the terms of both, and the
others of either side, with the price of an absent term for the other side;
terms absent from both cost the same each, so their number is enough. All
arithmetic is on integers.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from millrace.llm.scratch import dropped, written
from millrace.llm.textnum import release_memory

#: Three steps of long division by STEP give a price its scale of 10**9.
STEP = 1_000
#: Terms of a block on average, and so entries of an array; distinct entries that a task counts before it hands them on.
BLOCK_TERMS, HELD = 1 << 15, 200_000
#: Parts in which the terms of a block get their ids.
PARTS = 64
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def term_counts(docs: DataFrame) -> DataFrame:
    """``docs`` -> ``(lang, source, term, n, df)``: occurrences and documents of each term in each group; each group has a row with a null term, its n the documents.

    Null texts, languages and sources count as empty; repeated rows are
    documents of their own.
    """
    rows = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        documents: Counter = Counter()
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, df) in groups.items():
                terms = pa.array(list(n), pa.binary()).cast(pa.string())
                size = len(terms)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * size, pa.string()), pa.array([source] * size, pa.string()), terms, pa.array(n.values(), pa.int64()), pa.array([df[t] for t in n], pa.int64())], ["lang", "source", "term", "n", "df"]
                )
            groups.clear()

        for batch in batches:
            for lang, source, text in zip(*(c.to_pylist() for c in batch.columns)):
                documents[lang, source] += 1
                own = Counter(text.encode().translate(_LOWER).split())
                n, df = groups.setdefault((lang, source), (Counter(), Counter()))
                before = len(n)
                n.update(own)
                df.update(own.keys())
                held += len(n) - before
                if held > HELD:
                    yield from flush()
                    held = 0
        yield from flush()
        if documents:
            size = len(documents)
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in documents], pa.string()), pa.array([k[1] for k in documents], pa.string()), pa.nulls(size, pa.string()), pa.array(documents.values(), pa.int64()), pa.array([0] * size, pa.int64())], ["lang", "source", "term", "n", "df"]
            )
        release_memory()

    parts = rows.mapInArrow(counted, "lang string, source string, term string, n long, df long")
    return parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))


def price(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(10**9 * (count + 2) / (total + 2 * terms)), by long division in three steps, so that no product leaves 64 bits."""
    low = total + 2 * terms
    rest, out = count + 2, F.lit(0).cast("long")
    for _ in range(3):
        out = out * STEP + _floor(rest * STEP, low)
        rest = (rest * STEP) % low
    return out + 1


def _floor(a: Column, b: Column) -> Column:
    """Integer division of longs."""
    return F.call_function("div", a, b)


def prices(counts: np.ndarray, total: int, terms: int) -> np.ndarray:
    """:func:`price` of an array."""
    low = total + 2 * terms
    rest, out = np.asarray(counts, np.int64) + 2, np.zeros(len(counts), np.int64)
    for _ in range(3):
        out = out * STEP + rest * STEP // low
        rest = rest * STEP % low
    return out + 1


def gap(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)**2 / (p + q)); prices are at most 10**9 + 1, so squares fit."""
    return (p - q) * (p - q) // (p + q)


def intersection(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the common entries of two sorted arrays without repeats.

    The entries of the shorter array gallop through the longer one, all at
    once: steps of doubling width bracket each entry from where the merge would
    be if both were spread evenly, then each bracket is halved until it is one place.
    """
    if len(a) > len(b):
        j, i = intersection(b, a)
        return i, j
    if not len(a):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    n = len(b)
    low = np.arange(len(a)) * n // len(a)
    high, step = low + 1, 1
    while True:  # widen: b[low] <= entry, or low is 0; b[high] > entry, or high is n
        up, down = (high < n) & (b[np.minimum(high, n - 1)] <= a), (low > 0) & (b[low] > a)
        if not (up.any() or down.any()):
            break
        high, low = np.where(up, np.minimum(high + step, n), high), np.where(down, np.maximum(low - step, 0), low)
        step *= 2
    while True:
        open_ = high - low > 1
        if not open_.any():
            break
        middle = low + high >> 1
        right = b[np.minimum(middle, n - 1)] <= a
        low, high = np.where(open_ & right, middle, low), np.where(open_ & ~right, middle, high)
    found = b[low] == a
    return np.flatnonzero(found), low[found]


def _sums(left: tuple[np.ndarray, np.ndarray], right: tuple[np.ndarray, np.ndarray], n_left: int, n_right: int, terms: int) -> tuple[int, int]:
    """Sum of gaps over the terms that either side holds, and their number."""
    (ids, counts), (other, others) = left, right
    i, j = intersection(ids, other)
    p, q = prices(counts, n_left, terms), prices(others, n_right, terms)
    none_p, none_q = (int(prices(np.zeros(1, np.int64), n, terms)[0]) for n in (n_left, n_right))
    only_p, only_q = np.delete(p, i), np.delete(q, j)
    return int(gap(p[i], q[j]).sum()) + int(gap(only_p, none_q).sum()) + int(gap(none_p, only_q).sum()), len(ids) + len(other) - len(i)


def _side(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """(ids, counts) of the array of a pair's side; empty if the group has no term in the block."""
    if not table.num_rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    terms = table.column(table.num_columns - 1).combine_chunks().flatten()
    ids, counts = (terms.field(k).to_numpy(zero_copy_only=False) for k in (0, 1))
    return ids.astype(np.int64), counts.astype(np.int64)


def _priced(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
    lang, a, b, _, n_a, n_b, terms = (k.as_py() for k in key)
    value, held = _sums(_side(left), _side(right), n_a, n_b, terms)
    return pa.table({"lang": [lang], "a": [a], "b": [b], "value": pa.array([value], pa.int64()), "held": pa.array([held], pa.int64())})


def audit(docs: DataFrame, min_documents: int = 10, top: int = 10) -> DataFrame:
    """``docs(lang, source, text)`` -> ``(lang, source, part, item, value, rank)``.

    A term is a run of ASCII letters and characters beyond ASCII, A-Z counted
    as a-z; a language keeps those of at least ``min_documents`` of its
    documents. Every group and every language gives each kept term a price (see
    :func:`price`). Part ``pair``: every other source of the language with the
    sum of :func:`gap` over all kept terms (0 if there are none). Part
    ``term``: the ``top`` kept terms that the group holds and prices higher
    than its language does, by that gap. Ranks go by falling value, then by item.

    Nulls count as empty; a group without terms, or with empty names, is a group
    like others; repeated rows are documents of their own; other columns are not
    read; an empty table gives no rows. The result has a row for each ordered
    pair of sources, so it grows with their number's square, as does the work
    on pairs; arrays are bounded by blocks, and no task holds a whole group.
    """
    counts = written(term_counts(docs), "terms")
    groups = counts.where("term is null").select("lang", "source")
    by_term = Window.partitionBy("lang", "term")
    known = counts.where("term is not null").withColumns({"all_df": F.sum("df").over(by_term), "all_n": F.sum("n").over(by_term), "first": F.row_number().over(by_term.orderBy("source")) == 1})
    kept = written(known.where(F.col("all_df") >= min_documents).select("lang", "source", "term", "n", "all_n", "first"), "kept")

    by_lang = kept.groupBy("lang").agg(F.count_if("first").alias("terms"), F.sum("n").alias("n_lang"))
    by_group = kept.groupBy("lang", "source").agg(F.sum("n").alias("n_group"))
    zero = F.lit(0).cast("long")
    totals = groups.join(by_group, ["lang", "source"], "left").join(by_lang, "lang", "left")
    totals = written(totals.select("lang", "source", *(F.coalesce(c, zero).alias(c) for c in ("n_group", "n_lang", "terms"))), "totals")
    dropped(counts)

    # part term
    p, q = price(F.col("n"), F.col("n_group"), F.col("terms")), price(F.col("all_n"), F.col("n_lang"), F.col("terms"))
    priced = kept.select("lang", "source", "term", "n", "all_n").join(totals, ["lang", "source"]).withColumns({"p": p, "q": q}).where("p > q")
    best = priced.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), _floor((F.col("p") - F.col("q")) * (F.col("p") - F.col("q")), F.col("p") + F.col("q")).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    terms = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)

    # part pair
    most = totals.agg(F.max("terms")).first()[0] or 0
    blocks = max(1, -(-most // BLOCK_TERMS))
    # ids: the place in one of a block's PARTS parts, which are numbered apart
    part = F.pmod(F.xxhash64("term"), F.lit(blocks * PARTS))
    numbered = kept.where("first").select("lang", "term", part.alias("part"))
    place = F.row_number().over(Window.partitionBy("lang", "part").orderBy("term"))
    numbered = numbered.select("lang", "term", (F.col("part") % blocks).cast("int").alias("block"), (F.col("part") * (1 << 32) + place).alias("id"))
    held = kept.select("lang", "source", "term", "n").join(numbered, ["lang", "term"])
    arrays = written(held.groupBy("lang", "source", "block").agg(F.array_sort(F.collect_list(F.struct("id", "n"))).alias("terms")), "arrays")

    one = totals.select("lang", F.col("source").alias("a"), F.col("n_group").alias("n_a"), "terms")
    other = totals.select("lang", F.col("source").alias("b"), F.col("n_group").alias("n_b"))
    pairs = one.join(other, "lang").where("a < b")
    key = ["lang", "a", "b", "block", "n_a", "n_b", "n_terms"]
    named = pairs.withColumnRenamed("terms", "n_terms")
    left = arrays.withColumnRenamed("source", "a").join(named, ["lang", "a"]).select(*key, "terms")
    right = arrays.withColumnRenamed("source", "b").join(named, ["lang", "b"]).select(*(F.col(c).alias(f"other_{c}") for c in (*key, "terms")))
    sums = left.groupBy(*key).cogroup(right.groupBy(*(f"other_{c}" for c in key))).applyInArrow(_priced, "lang string, a string, b string, value long, held long")
    sums = sums.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"), F.sum("held").alias("held"))
    none_a, none_b = (price(zero, F.col(n), F.col("terms")) for n in ("n_a", "n_b"))
    absent = F.col("terms") - F.coalesce("held", zero)
    neither = _floor((none_a - none_b) * (none_a - none_b), none_a + none_b) * absent
    valued = pairs.join(sums, ["lang", "a", "b"], "left").withColumn("total", F.when(F.col("terms") > 0, F.coalesce("value", zero) + neither).otherwise(zero))
    valued = written(valued.select("lang", "a", "b", "total"), "pairs")
    dropped(arrays)
    both = valued.select("lang", F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))).alias("x"), "total")
    both = both.select("lang", "x.source", F.lit("pair").alias("part"), "x.item", F.col("total").alias("value")).withColumn("rank", F.row_number().over(order))
    return both.unionByName(terms)
