"""The incremental side as Structured Streaming: channel-days, live-job dedupe, and idempotent upserts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

from millrace.operators.ingest import content_hash


def watermarked(events: DataFrame, lateness: str) -> DataFrame:
    """Events by a UTC time that a stream may forget after ``lateness``."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return timed.withWatermark("ts", lateness) if events.isStreaming else timed


def daily_documents(events: DataFrame, lateness: str = "26 hours") -> DataFrame:
    """Events by type and UTC day, for batches and streams alike.

    A stream drops rows that come later than ``lateness``; such days are
    rebuilt by a batch run over their partition.
    """
    rows = watermarked(events, lateness)
    return rows.groupBy(F.window("ts", "1 day"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("value")).select(F.col("window.start").cast("timestamp_ntz").alias("day"), "event_type", "n", "value")


def live_jobs(events: DataFrame, keys: list[str], lateness: str = "26 hours") -> DataFrame:
    """One row for each key within the lateness, for batches and streams alike."""
    if events.isStreaming:
        return watermarked(events, lateness).dropDuplicatesWithinWatermark(keys)
    return events.dropDuplicates(keys)


class LiveKeys(StatefulProcessor):
    """A key's last event, for as long as its job may be live: one small state a live job, none for the others."""

    def __init__(self, expiry_ms: int):
        self.expiry_ms = expiry_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "at long")

    def _release(self) -> None:
        if self.last.exists():
            self.handle.deleteTimer(self.last.get()[0] + self.expiry_ms)
            self.last.clear()

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows)).sort_values(["ts", "event_id"])
        at, accepted = self.last.get()[0] if self.last.exists() else None, []
        for when, what in zip((frame["ts"].astype("datetime64[us]").astype("int64") // 1000).tolist(), frame["what"].tolist()):
            accepted.append(what == "ask" and (at is None or when - at > self.expiry_ms))
            at = when if what == "ask" else None
        self._release()
        if at is not None:
            self.last.update((at,))
            self.handle.registerTimer(at + self.expiry_ms)
        kept = frame[accepted]
        yield pd.DataFrame({"job_key": key[0], "event_id": kept["event_id"], "ts": kept["ts"]})

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.last.exists() and self.last.get()[0] + self.expiry_ms <= expiredTimerInfo.getExpiryTimeInMs():
            self.last.clear()
        return iter(())

    def close(self) -> None:
        pass


def accepted_requests(events: DataFrame, expiry_seconds: int = 86_400, lateness: str = "1 hour") -> DataFrame:
    """``events(job_key, ts, event_id, what)`` -> ``(job_key, event_id, ts)`` of the requests that start a job, for batches and streams alike.

    ``what`` is ``ask`` or ``done``. A request is taken in unless a job of its
    key is live: one that was asked for (again) less than ``expiry_seconds`` ago
    and is not done. So a key is free again when its job ends, not after some
    time, and a job that is lost frees it in the end. A stream keeps one state
    for each live job, released by its end or by a timer, drops events later
    than ``lateness``, and takes a key's events in the order of its batches
    (state store: RocksDB). Null keys ask for nothing.
    """
    rows = events.where("job_key is not null and what in ('ask', 'done')").select(F.col("job_key").cast("string").alias("job_key"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").cast("long").alias("event_id"), "what")
    if rows.isStreaming:
        return watermarked(rows, lateness).groupBy("job_key").transformWithStateInPandas(LiveKeys(expiry_seconds * 1000), "job_key string, event_id long, ts timestamp", "Append", "EventTime")
    before = Window.partitionBy("job_key").orderBy("ts", "event_id")
    was, at = F.lag("what").over(before), F.lag("ts").over(before)
    free = was.isNull() | (was == "done") | (F.unix_millis("ts") - F.unix_millis(at) > expiry_seconds * 1000)
    return rows.withColumn("free", free).where("what = 'ask' and free").select("job_key", "event_id", "ts")


class Attempts:
    """A user's failures since the last success or the end of a lockout, and when a lockout ends."""

    def __init__(self, failures: int, seconds: int, hits: int = 0, until: float = 0.0):
        self.failures, self.seconds, self.hits, self.until = failures, seconds, hits, until

    def outcome(self, at: float, ok: bool) -> str:
        """What becomes of an attempt: ``locked`` (refused unseen), ``ok``, ``failed``, or ``failed`` that locks: ``lockout``."""
        if self.until > at:
            return "locked"
        if self.until:
            self.hits, self.until = 0, 0.0
        if ok:
            self.hits = 0
            return "ok"
        self.hits += 1
        if self.hits >= self.failures:
            self.until = at + self.seconds
            return "lockout"
        return "failed"


def login_outcomes(attempts: DataFrame, failures: int = 8, seconds: int = 300) -> DataFrame:
    """``attempts(user_id, ts, attempt_id, ok)`` -> ``(user_id, ts, attempt_id, outcome)``, for batches and streams alike.

    After ``failures`` failures without a success between, a user's attempts
    are refused for ``seconds``; they do not count. State is kept by user: two
    numbers in a stream; a batch reads each user's attempts in order, a part at
    a time. A stream takes the attempts of a user in the order of its batches.
    """
    rows = attempts.select("user_id", F.col("ts").cast("timestamp").alias("ts"), F.col("attempt_id").cast("long").alias("attempt_id"), "ok")
    schema = "user_id long, ts timestamp, attempt_id long, outcome string"

    def said(frame: pd.DataFrame, user: int, state: Attempts) -> pd.DataFrame:
        frame = frame.sort_values(["ts", "attempt_id"])
        seconds_of = frame["ts"].astype("datetime64[us]").astype("int64") / 1e6
        outcomes = [state.outcome(at, ok) for at, ok in zip(seconds_of.tolist(), frame["ok"].tolist())]
        return pd.DataFrame({"user_id": user, "ts": frame["ts"], "attempt_id": frame["attempt_id"], "outcome": outcomes})

    if rows.isStreaming:

        def keyed(key: tuple, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
            state = Attempts(failures, seconds, *(held.get if held.exists else (0, 0.0)))
            frame = pd.concat(list(frames))
            yield said(frame, key[0], state)
            if state.hits or state.until:
                held.update((state.hits, state.until))
            elif held.exists:
                held.remove()  # only users with failures behind them keep a state

        return rows.groupBy("user_id").applyInPandasWithState(keyed, schema, "hits int, until double", "append", GroupStateTimeout.NoTimeout)

    def ordered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        user, state = None, Attempts(failures, seconds)
        for batch in batches:
            for key, frame in batch.groupby("user_id", sort=False):
                if key != user:
                    user, state = key, Attempts(failures, seconds)
                yield said(frame, key, state)

    return rows.where("user_id is not null").repartition("user_id").sortWithinPartitions("user_id", "ts", "attempt_id").mapInPandas(ordered, schema)


def skip_unchanged(fetched: DataFrame, stored: DataFrame) -> DataFrame:
    """Rows ``(document_id, text)`` of an overlapping read whose text is new: what ``stored(document_id, content_hash)`` has is skipped."""
    rows = fetched.withColumn("content_hash", content_hash(F.array("text")))
    return rows.join(stored.select("document_id", "content_hash").distinct(), ["document_id", "content_hash"], "left_anti").select(*fetched.columns, "content_hash")


def run_available(stream: DataFrame, checkpoint: str, step: Callable[[DataFrame, int], None], mode: str = "append") -> None:
    """Everything that is there now, through ``step`` in batches; a step must bear to see a batch twice."""
    stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(step).start().awaitTermination()
