"""A durable work queue as transformations of a table of jobs; ``now`` is always a parameter.

Jobs: ``id, kind, status, priority, attempts, max_attempts, run_after,
created_at, started_at, finished_at, locked_by, lease_expires_at, last_error,
dedupe_key``. Each function returns the table after the step.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

LIVE = ("queued", "running")


def _set(jobs: DataFrame, condition: Column, **values: Column) -> DataFrame:
    hit = F.coalesce(condition, F.lit(False))
    return jobs.select(*(F.when(hit, values[c]).otherwise(F.col(c)).cast(jobs.schema[c].dataType).alias(c) if c in values else F.col(c) for c in jobs.columns))


def _later(now: Column, seconds: Column | float) -> Column:
    seconds = seconds if isinstance(seconds, Column) else F.lit(seconds)
    return (now + F.make_dt_interval(secs=seconds.cast("decimal(18,6)"))).cast("timestamp_ntz")


def enqueue(jobs: DataFrame, new: DataFrame) -> DataFrame:
    """The new jobs of the same columns that no live job, and no earlier new one, has the dedupe_key of; without a key all enter."""
    live = jobs.where(F.col("status").isin(*LIVE) & F.col("dedupe_key").isNotNull()).select("dedupe_key").distinct()
    first = F.row_number().over(Window.partitionBy("dedupe_key").orderBy("id"))
    keyed = new.where("dedupe_key is not null").withColumn("_n", first).where("_n = 1").drop("_n").join(live, "dedupe_key", "left_anti")
    return jobs.unionByName(new.where("dedupe_key is null")).unionByName(keyed.select(new.columns))


def claim(jobs: DataFrame, worker: str, now: Column, batch: int = 1, lease_s: int = 300, kinds: list[str] | None = None) -> DataFrame:
    """The first runnable jobs by priority, time and id become the worker's, for the time of a lease."""
    ready = jobs.where((F.col("status") == "queued") & (F.col("run_after") <= now))
    ready = ready.where(F.col("kind").isin(kinds)) if kinds is not None else ready
    taken = F.broadcast(ready.orderBy("priority", "run_after", "id").limit(batch).select("id", F.lit(True).alias("_taken")))
    hit = F.col("_taken")
    changed = _set(
        jobs.join(taken, "id", "left"), hit, status=F.lit("running"), attempts=F.col("attempts") + 1, locked_by=F.lit(worker), lease_expires_at=_later(now, lease_s), started_at=F.coalesce("started_at", now)
    )
    return changed.select(jobs.columns)


def heartbeat(jobs: DataFrame, job_id: int, worker: str, now: Column, lease_s: int = 300) -> DataFrame:
    """A running job's lease, renewed for its owner only."""
    return _set(jobs, (F.col("id") == job_id) & (F.col("locked_by") == worker) & (F.col("status") == "running"), lease_expires_at=_later(now, lease_s))


def complete(jobs: DataFrame, job_id: int, worker: str, now: Column) -> DataFrame:
    """A running job, done by its owner."""
    nothing = F.lit(None)
    return _set(jobs, (F.col("id") == job_id) & (F.col("locked_by") == worker) & (F.col("status") == "running"), status=F.lit("succeeded"), finished_at=now, locked_by=nothing, lease_expires_at=nothing, last_error=nothing)


def jitter() -> Column:
    """A factor of 0.75 to 1.25 that depends on the job and its attempt only."""
    return 0.75 + 0.5 * (F.conv(F.substring(F.md5(F.concat_ws("/", F.col("id").cast("string"), F.col("attempts").cast("string"))), 1, 8), 16, 10).cast("double") / float(1 << 32))


def fail(jobs: DataFrame, condition: Column, error: Column, now: Column, retryable: bool = True) -> DataFrame:
    """Failed jobs go back to the queue after an exponential delay of an hour at most, or are dead after their last attempt (or if no retry can help)."""
    dead = (F.col("attempts") >= F.col("max_attempts")) if retryable else F.lit(True)
    delay = F.least(F.lit(3600.0), 5 * F.pow(F.lit(2.0), F.col("attempts"))) * jitter()
    nothing = F.lit(None)
    return _set(
        jobs,
        condition & (F.col("status") == "running"),
        status=F.when(dead, "dead").otherwise("queued"),
        finished_at=F.when(dead, now).otherwise(F.col("finished_at")),
        run_after=F.when(dead, F.col("run_after")).otherwise(_later(now, F.floor(delay * 1000) / 1000)),
        last_error=error,
        locked_by=nothing,
        lease_expires_at=nothing,
    )


def reclaim(jobs: DataFrame, now: Column) -> DataFrame:
    """Running jobs whose lease is over return to the queue; their attempts stay."""
    nothing = F.lit(None)
    return _set(
        jobs, (F.col("status") == "running") & (F.col("lease_expires_at") < now), status=F.lit("queued"), run_after=now, locked_by=nothing, lease_expires_at=nothing, last_error=F.coalesce("last_error", F.lit("lease expired"))
    )


def changed(before: DataFrame, after: DataFrame) -> DataFrame:
    """``(n)``: how many jobs a step changed or added."""
    return after.exceptAll(before).agg(F.count("*").alias("n"))


def live(jobs: DataFrame) -> DataFrame:
    """Jobs that hold their dedupe key: queued or running ones that have a key."""
    return jobs.where(F.col("status").isin(*LIVE) & F.col("dedupe_key").isNotNull())


def reindex_jobs(documents: DataFrame, target_version: str, first_id: int, now: Column) -> DataFrame:
    """A job of priority 500 for each ``documents(document_id, embedding_version)`` with another embedding version, keyed by document."""
    stale = documents.where(~F.col("embedding_version").eqNullSafe(F.lit(target_version))).select("document_id").distinct()
    none = lambda kind: F.lit(None).cast(kind)
    return stale.select(
        (F.lit(first_id) + F.col("document_id")).cast("long").alias("id"),
        F.lit("reindex").alias("kind"),
        F.lit("queued").alias("status"),
        F.lit(500).alias("priority"),
        F.lit(0).alias("attempts"),
        F.lit(5).alias("max_attempts"),
        now.alias("run_after"),
        now.alias("created_at"),
        none("timestamp_ntz").alias("started_at"),
        none("timestamp_ntz").alias("finished_at"),
        none("string").alias("locked_by"),
        none("timestamp_ntz").alias("lease_expires_at"),
        none("string").alias("last_error"),
        F.concat_ws("/", F.lit("reindex"), F.col("document_id").cast("string")).alias("dedupe_key"),
    )


def queue_health(jobs: DataFrame, now: Column) -> DataFrame:
    """Number, oldest and most tried jobs by kind and status."""
    age = F.floor(F.unix_micros(now.cast("timestamp")) / 1e6 - F.unix_micros(F.min("created_at").cast("timestamp")) / 1e6)
    return jobs.groupBy("kind", "status").agg(F.count("*").alias("n"), F.min("run_after").alias("oldest_runnable"), F.max("attempts").alias("max_attempts_seen"), age.cast("long").alias("oldest_age_s"))
