"""Ranking quality per question, run summaries and paired comparisons.

``ranked(question_id, label, rank)`` are results by some label (chunk, document
or source), ``truth(question_id, label)`` the relevant ones. Metrics that do not
apply are null.
"""

from __future__ import annotations

import functools
import random
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

# Phrases that mean an answer was not found.
ABSTENTIONS = (
    "nothing in the corpus",
    "could not find",
    "couldn't find",
    "i don't have",
    "i do not have",
    "not in these documents",
    "no passage",
    "does not appear in",
    "is not covered",
    "not grounded in",
)
RESAMPLES, SEED = 10_000, 20260821


def truth_level(chunks: Column, documents: Column, sources: Column) -> Column:
    """The strictest level that has labels."""
    has = lambda c: F.coalesce(F.size(c), F.lit(0)) > 0
    return F.when(has(chunks), "chunk").when(has(documents), "document").when(has(sources), "source").otherwise("none")


#: Words of a passage below which it is looked for in every text, and such passages of one pass.
KEYED_WORDS, SCANNED = 4, 200


def passage_truth(passages: DataFrame, documents: DataFrame) -> DataFrame:
    """``passages(question_id, passage)`` and ``documents(label, text)`` -> ``(question_id, label)`` of the texts that hold a passage.

    A passage of four words at least is keyed by its longest two neighbouring
    inner words, which stand whole in every text that holds it; shorter ones
    (a few of the questions) are looked for in every text. Null passages and
    texts hold nothing; the empty passage is in every text.
    """
    words = lambda c: F.split(c, r"\s+")
    pairs = lambda w: F.when(F.size(w) > 1, F.zip_with(F.slice(w, 1, F.size(w) - 1), F.slice(w, 2, F.size(w) - 1), lambda a, b: F.concat_ws(" ", a, b)))
    longest = lambda p: F.array_max(F.transform(p, lambda x: F.struct(F.length(x).alias("n"), x.alias("pair"))))["pair"]
    split = passages.where("passage is not null").withColumn("w", words("passage"))
    long_ones = split.where(F.size("w") >= KEYED_WORDS).select("question_id", "passage", longest(pairs(F.slice("w", 2, F.size("w") - 2))).alias("pair"))
    rows = documents.where("text is not null").select("label", "text")
    candidates = rows.select("label", F.explode(F.array_distinct(pairs(words("text")))).alias("pair")).join(long_ones.select("question_id", "pair"), "pair").select("question_id", "label")
    found = candidates.join(long_ones.select("question_id", "passage"), "question_id").join(rows, "label").where(F.contains("text", "passage")).select("question_id", "label")
    short = [(r["question_id"], r["passage"]) for r in split.where(F.size("w") < KEYED_WORDS).select("question_id", "passage").collect()]  # questions of one evaluation
    for at in range(0, len(short), SCANNED):
        held = F.array_compact(F.array(*(F.when(F.contains("text", F.lit(p)), F.lit(q)) for q, p in short[at : at + SCANNED])))
        found = found.unionByName(rows.select(F.explode(held).alias("question_id"), "label").withColumn("question_id", F.col("question_id").cast(passages.schema["question_id"].dataType)))
    return found


def first_ranks(ranked: DataFrame) -> DataFrame:
    """Each label once, at its first rank, ranks closed up."""
    firsts = ranked.groupBy("question_id", "label").agg(F.min("rank").alias("rank"))
    return firsts.withColumn("rank", F.row_number().over(Window.partitionBy("question_id").orderBy("rank", "label")))


def question_metrics(questions: DataFrame, ranked: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """recall, precision, reciprocal rank, nDCG and hit at k for each question (null where it has no labels)."""
    labels = truth.select("question_id", "label").distinct()
    relevant = labels.groupBy("question_id").agg(F.count("*").alias("n_relevant"))
    results = first_ranks(ranked)
    returned = results.groupBy("question_id").agg(F.count("*").alias("n_returned"))
    good = results.join(labels, ["question_id", "label"])
    top = F.col("rank") <= k
    hits = good.groupBy("question_id").agg(F.count_if(top).alias("n_hits"), F.min("rank").alias("best"), F.sum(F.when(top, 1 / F.log2(F.col("rank") + 1))).alias("gain"))
    joined = questions.select("question_id").join(relevant, "question_id", "left").join(returned, "question_id", "left").join(hits, "question_id", "left")
    labelled = F.coalesce(F.col("n_relevant"), F.lit(0)) > 0
    found, got = F.coalesce("n_hits", F.lit(0)), F.least(F.coalesce("n_returned", F.lit(0)), F.lit(k))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least("n_relevant", F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    return joined.select(
        "question_id",
        labelled.alias("labelled"),
        F.when(labelled, found / F.col("n_relevant")).alias("recall"),
        F.when(labelled, F.when(got > 0, found / got).otherwise(0.0)).alias("precision"),
        F.when(labelled, F.coalesce(1 / F.col("best"), F.lit(0.0))).alias("reciprocal_rank"),
        F.when(labelled, F.coalesce(F.col("gain"), F.lit(0.0)) / ideal).alias("ndcg"),
        F.when(labelled, found > 0).alias("hit"),
    )


def ranks_of(ranked: DataFrame, truth: DataFrame) -> DataFrame:
    """The rank of every relevant label; null if it was not found."""
    return truth.select("question_id", "label").distinct().join(first_ranks(ranked), ["question_id", "label"], "left")


def missing_phrases(answer: Column, wanted: Column) -> Column:
    """Phrases that must occur in the answer and do not, in any case."""
    return F.filter(wanted, lambda w: ~F.contains(F.lower(answer), F.lower(w)))


def forbidden_phrases(answer: Column, unwanted: Column) -> Column:
    return F.filter(unwanted, lambda w: F.contains(F.lower(answer), F.lower(w)))


def abstained(answer: Column) -> Column:
    return F.exists(F.array(*map(F.lit, ABSTENTIONS)), lambda m: F.contains(F.lower(answer), m))


def citation_accuracy(cited: Column, retrieved: Column, relevant: Column) -> Column:
    """Share of citations that are relevant (or retrieved, where nothing is labelled); null without citations."""
    allowed = F.when(F.size(relevant) > 0, relevant).otherwise(retrieved)
    return F.when(F.size(cited) > 0, F.size(F.filter(cited, lambda c: F.array_contains(allowed, c))) / F.size(cited))


def _number(column: str) -> Column:
    return F.when(~F.isnan(F.col(column).cast("double")), F.col(column).cast("double"))


def _share(flag: str) -> Column:
    """Share of the rows that assert something for which it holds."""
    return F.round(F.avg(F.col(flag).cast("double")), 6)


MEASURES = ("recall", "precision", "reciprocal_rank", "ndcg", "citation_accuracy", "faithfulness")
RATES = {"includes_ok": "must_include_rate", "excludes_ok": "must_not_include_rate", "abstention_ok": "abstention_accuracy"}


def summary(results: DataFrame) -> DataFrame:
    """One row for each run: means over the questions a metric applies to, rates over those that assert something, latencies, costs, errors.

    Columns of MEASURES, RATES and ``cost_usd`` that the results lack count as null throughout.
    """
    optional = {**dict.fromkeys(MEASURES, "double"), **dict.fromkeys(RATES, "boolean"), "cost_usd": "double"}
    results = results.withColumns({c: F.lit(None).cast(kind) for c, kind in optional.items() if c not in results.columns})
    return results.groupBy("run_id").agg(
        F.count("*").alias("questions"),
        F.count_if("labelled").alias("labelled"),
        *(F.round(F.avg(_number(m)), 6).alias(f"mean_{m}") for m in MEASURES),
        F.round(F.avg(F.when(F.col("labelled"), F.col("hit").cast("double"))), 6).alias("hit_rate"),
        *(_share(flag).alias(name) for flag, name in RATES.items()),
        F.percentile("latency_ms", 0.5).alias("p50_ms"),
        F.expr("percentile_disc(0.95) within group (order by latency_ms)").alias("p95_ms"),
        F.round(F.coalesce(F.sum("cost_usd"), F.lit(0.0)), 6).alias("total_cost_usd"),
        F.round(F.coalesce(F.avg("cost_usd"), F.lit(0.0)), 6).alias("cost_per_query"),
        F.count_if(F.col("error").isNotNull()).alias("errors"),
    )


# Numbers of a run's metrics that its view shows.
SHOWN = ("recall_at_k", "mrr", "ndcg", "faithfulness", "citation_accuracy", "p50_ms", "p95_ms", "cost_per_query")


def run_view(runs: DataFrame, datasets: DataFrame) -> DataFrame:
    """``runs(run_id, dataset_id, label, git_sha, status, question_count, metrics json, started_at, finished_at)`` with the dataset's name and the numbers of ``metrics``."""
    numbers = [F.try_variant_get(F.try_parse_json("metrics"), f"$.{m}", "double").alias(m) for m in SHOWN]
    named = runs.join(datasets.select("dataset_id", F.col("name").alias("dataset")), "dataset_id")
    return named.select("run_id", "dataset_id", "dataset", "label", "git_sha", "status", "question_count", *numbers, "started_at", "finished_at")


def newest_first(runs: DataFrame) -> DataFrame:
    return runs.orderBy(F.desc("started_at"), "run_id")


def tagged(questions: DataFrame, tags: list[str] | None) -> DataFrame:
    """Questions that have one of the tags; all without a list."""
    return questions if tags is None else questions.where(F.arrays_overlap("tags", F.array(*map(F.lit, tags)).cast("array<string>")))


def flat_distinct(lists: Column) -> Column:
    """The items of lists in order, each at its first place."""
    return F.array_distinct(F.flatten(lists))


def paired(before: DataFrame, after: DataFrame, metric: str) -> DataFrame:
    """``(question_id, before, after, delta)`` of the questions that both runs scored."""
    b = before.select("question_id", _number(metric).alias("before"))
    a = after.select("question_id", _number(metric).alias("after"))
    return b.join(a, "question_id").where("before is not null and after is not null").withColumn("delta", F.col("after") - F.col("before"))


def comparison(pairs: DataFrame) -> DataFrame:
    """Means and the number of questions that improved, regressed and stayed."""
    return pairs.agg(
        F.count("*").alias("n"),
        F.round(F.avg("before"), 6).alias("mean_before"),
        F.round(F.avg("after"), 6).alias("mean_after"),
        F.count_if(F.col("delta") > 0).alias("improved"),
        F.count_if(F.col("delta") < 0).alias("regressed"),
        F.count_if(F.col("delta") == 0).alias("unchanged"),
    )


#: Draws made at once.
DRAWS = 4_000_000


def _draws(n: int, resamples: int, seed: int) -> Iterator[np.ndarray]:
    """Places of the resampled questions, a row for each resample, in blocks of rows.

    They are those of ``random.Random(seed).randrange(n)``: the same generator,
    whose words are cut to the bits of n and passed by where they reach n.
    """
    *key, at = random.Random(seed).getstate()[1]
    source = np.random.MT19937()
    source.state = {"bit_generator": "MT19937", "state": {"key": np.array(key, np.uint32), "pos": at}}
    shift, rows, held = np.uint64(32 - n.bit_length()), max(1, DRAWS // n), np.zeros(0, np.int64)
    for first in range(0, resamples, rows):
        size = min(rows, resamples - first) * n
        while len(held) < size:
            words = source.random_raw(2 * size) >> shift
            held = np.concatenate([held, words[words < n].astype(np.int64)])
        yield held[:size].reshape(-1, n)
        held = held[size:]


@functools.lru_cache(maxsize=2)
def _all_draws(n: int, resamples: int, seed: int) -> np.ndarray:
    """All draws of a small size at once; groups of one size share them."""
    return np.concatenate([d.astype(np.int32) for d in _draws(n, resamples, seed)])


def _means(deltas: np.ndarray, first: int, last: int, resamples: int, seed: int) -> np.ndarray:
    """Means of the resamples first .. last - 1."""
    n, at, out = len(deltas), 0, []
    if n * resamples <= DRAWS:
        return deltas[_all_draws(n, resamples, seed)[first:last]].mean(axis=1)
    for draw in _draws(n, last, seed):
        if at + len(draw) > first:
            out.append(deltas[draw[max(0, first - at) :]].mean(axis=1))
        at += len(draw)
    return np.concatenate(out)


#: Draws of one task; a larger comparison is cut into blocks of its resamples.
BLOCK_DRAWS = 50_000_000


def bootstrap(pairs: DataFrame, by: str = "metric", resamples: int = RESAMPLES, seed: int = SEED) -> DataFrame:
    """``pairs(by, question_id, delta)`` -> a paired bootstrap for each value of ``by``: interval, disagreement, verdict.

    The draws are those of Python's generator with the seed, over the questions
    in order, so groups of one size share them. A group is the list of one
    run's questions, which an evaluation answered one by one; its resamples are
    spread over tasks in blocks of about BLOCK_DRAWS draws, each of which runs
    the generator up to its first draw.
    """
    asked = F.array_sort(F.collect_list(F.struct("question_id", "delta")))
    runs = pairs.groupBy(F.col(by).cast("string").alias("run")).agg(F.transform(asked, lambda x: x["delta"].cast("double")).alias("deltas"))
    blocks = F.least(F.lit(resamples), F.greatest(F.lit(1), F.ceil(F.size("deltas") * F.lit(float(resamples)) / BLOCK_DRAWS))).cast("int")
    parts = runs.withColumn("blocks", blocks).select("run", "deltas", "blocks", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")).repartition("run", "block")

    def resampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for run, deltas, of, block in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                x = deltas.values.to_numpy(zero_copy_only=False).astype(float)
                means = _means(x, block * resamples // of, (block + 1) * resamples // of, resamples, seed)
                yield pa.RecordBatch.from_arrays([pa.array([run], pa.string()), pa.array([len(x)], pa.int64()), pa.array([float(x.mean())]), pa.array([means], pa.list_(pa.float64()))], ["run", "n", "observed", "means"])

    def judged(group: pd.DataFrame) -> pd.DataFrame:
        n, observed = int(group["n"].iloc[0]), float(group["observed"].iloc[0])
        means = np.sort(np.concatenate(list(group["means"])))
        low, high = float(means[int(0.025 * resamples)]), float(means[min(resamples - 1, int(0.975 * resamples))])
        against = int((means <= 0).sum()) if observed > 0 else int((means >= 0).sum()) if observed < 0 else resamples
        decisive = low > 0 or high < 0
        word = "inconclusive" if not decisive else "better" if observed > 0 else "worse"
        return pd.DataFrame([(group["run"].iloc[0], n, observed, low, high, against / resamples, decisive, word)], columns=[by, "n", "delta", "ci_low", "ci_high", "disagreement", "decisive", "verdict"])

    means = parts.mapInArrow(resampled, "run string, n long, observed double, means array<double>")
    return means.groupBy("run").applyInPandas(judged, f"{by} string, n long, delta double, ci_low double, ci_high double, disagreement double, decisive boolean, verdict string")


def verdict_text(n: Column, delta: Column, low: Column, high: Column) -> Column:
    """What a comparison says, in words; whether it is decisive is whether its interval clears 0."""
    decisive = (low > 0) | (high < 0)
    plural = F.when(n == 1, "").otherwise("s")
    spans = F.concat(F.lit("inconclusive on "), n.cast("string"), F.lit(" question"), plural, F.lit(" — the interval spans zero"))
    said = F.concat(F.when(delta > 0, "better").otherwise("worse"), F.lit(" by "), F.format_string("%.3f (%+.3f to %+.3f)", F.abs(delta), low, high))
    return F.when(n == 0, "no questions in common").when(decisive, said).otherwise(spans)


def extremes(pairs: DataFrame, n: int = 3) -> DataFrame:
    """The n largest gains and losses."""
    gains = pairs.where("delta > 0").orderBy(F.desc("delta"), "question_id").limit(n)
    return gains.withColumn("side", F.lit("gain")).unionByName(pairs.where("delta < 0").orderBy("delta", "question_id").limit(n).withColumn("side", F.lit("loss")))


def worst(results: DataFrame, n: int = 10) -> DataFrame:
    """Errors first, then the lowest recall."""
    return results.orderBy(F.col("error").isNull(), F.col("recall").asc_nulls_first(), "question_id").limit(n)


def faithfulness(supported: Column, total: Column) -> Column:
    return F.when(total > 0, F.least(F.greatest(supported / total, F.lit(0.0)), F.lit(1.0)))


def config_changes(a: Column, b: Column) -> Column:
    """Sorted names of settings (maps of strings) that differ."""
    return F.array_sort(F.filter(F.array_union(F.map_keys(a), F.map_keys(b)), lambda k: ~F.element_at(a, k).eqNullSafe(F.element_at(b, k))))


DIFFICULTIES = ("multi-hop", "identifier-lookup", "temporal", "unanswerable")  # fixed values
_UUID = r"^[0-9a-fA-F]{8}-?([0-9a-fA-F]{4}-?){3}[0-9a-fA-F]{12}$"


def invalid_questions(questions: DataFrame, fields: Column | None = None) -> DataFrame:
    """Everything wrong with a dataset's questions: ``(question_id, problem)``.

    ``questions(question_id, question, difficulty, expected_chunk_ids,
    expected_document_ids, expected_documents, must_include,
    must_not_include)``; columns that are absent are not checked. ``fields``
    are the names that a question came with.
    """
    have = set(questions.columns)
    text = F.trim(F.coalesce("question", F.lit("")))
    questions = questions.withColumn("_nth", F.row_number().over(Window.partitionBy(F.md5(text)).orderBy("question_id")))
    found = [F.when(text == "", F.lit("no question")), F.when((text != "") & (F.col("_nth") > 1), F.lit("duplicates an earlier question"))]
    if {"must_include", "must_not_include"} <= have:
        found.append(F.when(F.size(F.array_intersect(F.transform("must_include", F.lower), F.transform("must_not_include", F.lower))) > 0, F.lit("a phrase is wanted and forbidden")))
    if "difficulty" in have:
        found.append(F.when(~F.col("difficulty").isin(*DIFFICULTIES) & (F.col("difficulty") != ""), F.concat(F.lit("unknown difficulty "), "difficulty")))
    for c in ("expected_chunk_ids", "expected_document_ids"):
        if c in have:
            wrong = F.filter(c, lambda x: ~x.rlike(_UUID))
            found.append(F.when(F.size(wrong) > 0, F.concat(F.lit(f"{c} contains no UUID: "), F.array_join(wrong, ", "))))
    named = [F.size(c) > 0 for c in ("expected_chunk_ids", "expected_document_ids", "expected_documents") if c in have]
    if named and "difficulty" in have:
        some = F.lit(False)
        for n in named:
            some = some | F.coalesce(n, F.lit(False))
        found.append(F.when((F.col("difficulty") == "unanswerable") & some, F.lit("unanswerable, but names expected documents")))
    if fields is not None:
        known = ("question", "expected_answer", "expected_chunk_ids", "expected_document_ids", "expected_documents", "expected_sources", "must_include", "must_not_include", "tags", "difficulty", "metadata")
        unknown = F.array_sort(F.filter(fields, lambda f: ~f.isin(*known)))
        found.append(F.when(F.size(unknown) > 0, F.concat(F.lit("unknown fields: "), F.array_join(unknown, ", "))))
    return questions.select("question_id", F.explode(F.array_compact(F.array(*found))).alias("problem"))
