"""Rollups of query traces and of the corpus."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Most that a value between two others of its bucket may be off, as a share of it.
ERROR = 0.01

def query_stats_daily(traces: DataFrame) -> DataFrame:
    """``traces(tenant_id, created_at, total_ms, cost_usd, error)`` by tenant and UTC day."""
    day = F.date_trunc("day", "created_at").cast("timestamp_ntz")
    at = lambda p: F.expr(f"percentile_cont({p}) within group (order by total_ms)")
    return traces.groupBy("tenant_id", day.alias("day")).agg(
        F.count("*").alias("queries"),
        *(F.round(at(p), 6).alias(n) for p, n in ((0.5, "p50_ms"), (0.95, "p95_ms"), (0.99, "p99_ms"))),
        F.round(F.sum("cost_usd"), 6).alias("cost_usd"),
        F.round(F.avg("cost_usd"), 9).alias("cost_per_query"),
        F.count_if(F.col("error").isNotNull()).alias("errors"),
    )


def latency_sketches(traces: DataFrame, unit: str = "hour", error: float = ERROR) -> DataFrame:
    """``traces(tenant_id, created_at, total_ms, cost_usd, error)`` -> ``(tenant_id, at, bucket, n, low, high, cost_usd, errors)``.

    Latencies of a tenant and unit of UTC time are counted in buckets whose
    bounds grow by a factor; each keeps its smallest and largest value. Sums,
    minima and maxima are all there is, so sketches of parts merge into the one
    of the whole (:func:`merged_sketches`), whatever the parts. Latencies of 0
    or less share a bucket; rows without one count, but are not timed.
    """
    factor = math.log1p(2 * error / (1 - error))
    ms = F.col("total_ms")
    bucket = F.when(ms > 0, F.ceil(F.round(F.ln(ms) / factor, 9))).when(ms <= 0, -(1 << 40))
    rows = traces.select("tenant_id", F.date_trunc(unit, "created_at").cast("timestamp_ntz").alias("at"), bucket.cast("long").alias("bucket"), F.lit(1).alias("n"), ms.alias("low"), ms.alias("high"), "cost_usd", F.col("error").isNotNull().cast("long").alias("errors"))
    return merged_sketches(rows, unit)


def merged_sketches(sketches: DataFrame, unit: str = "day") -> DataFrame:
    """Sketches of parts or of smaller units of time as those of ``unit``."""
    at = F.date_trunc(unit, "at").cast("timestamp_ntz").alias("at")
    sums = (F.sum("n").cast("long").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"), F.sum("cost_usd").alias("cost_usd"), F.sum("errors").cast("long").alias("errors"))
    return sketches.groupBy("tenant_id", at, "bucket").agg(*sums)


def sketched_stats(sketches: DataFrame, unit: str = "day") -> DataFrame:
    """The columns of :func:`query_stats_daily` from sketches.

    Percentiles interpolate between two ranks; the value at a rank is exact
    where its bucket has two values at most, or the rank is the bucket's first
    or last; between, it lies in the bucket, so it is off by about 2 * ERROR at most.
    """
    rows = merged_sketches(sketches, unit)
    per = Window.partitionBy("tenant_id", "at")
    timed = F.when(F.col("bucket").isNotNull(), F.col("n")).otherwise(0)
    upto = F.sum(timed).over(per.orderBy(F.col("bucket").asc_nulls_last()))
    rows = rows.withColumns({"upto": upto, "total": F.sum(timed).over(per), "timed": timed})

    def at_rank(rank: Column) -> Column:
        k = rank - (F.col("upto") - F.col("timed"))
        value = F.when(k <= 0, F.col("low")).when(k >= F.col("n") - 1, F.col("high")).otherwise(F.col("low") + (F.col("high") - F.col("low")) * k / (F.col("n") - 1))
        return F.max(F.when((rank >= F.col("upto") - F.col("timed")) & (rank < F.col("upto")), value))

    def percentile(p: float) -> Column:
        place = F.lit(p) * (F.col("total") - 1)
        first, last = at_rank(F.floor(place)), at_rank(F.ceil(place))
        return F.round(first + (last - first) * (F.max(place) - F.floor(F.max(place))), 6)

    return rows.groupBy("tenant_id", F.col("at").alias("day")).agg(
        F.sum("n").alias("queries"),
        *(percentile(p).alias(n) for p, n in ((0.5, "p50_ms"), (0.95, "p95_ms"), (0.99, "p99_ms"))),
        F.round(F.sum("cost_usd"), 6).alias("cost_usd"),
        F.round(F.sum("cost_usd") / F.sum("n"), 9).alias("cost_per_query"),
        F.sum("errors").alias("errors"),
    )


def low_groundedness(traces: DataFrame, below: float = 0.8) -> DataFrame:
    """Traces whose answers rest on their sources too little; those without a measure are not among them."""
    return traces.where(F.col("groundedness") < below)


def usage(calls: DataFrame, *by: str) -> DataFrame:
    """Tokens and cost added up over calls: ``calls, input_tokens, cached_tokens, output_tokens, cost_usd``."""
    tokens = [F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("input_tokens", "cached_tokens", "output_tokens")]
    return calls.groupBy(*by).agg(F.count("*").alias("calls"), *tokens, F.round(F.coalesce(F.sum("cost_usd"), F.lit(0.0)), 6).alias("cost_usd"))


def corpus_counts(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """Documents, ready ones, failed ones and chunks of each tenant."""
    d = documents.groupBy("tenant_id").agg(F.count("*").alias("documents"), F.count_if(F.col("stage") == "ready").alias("ready"), F.count_if(F.col("stage") == "failed").alias("failed"))
    return d.join(chunks.groupBy("tenant_id").agg(F.count("*").alias("chunks")), "tenant_id", "left").withColumn("chunks", F.coalesce("chunks", F.lit(0)).cast("long"))
