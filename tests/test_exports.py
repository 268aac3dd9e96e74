"""Channel exports as batch and stream, and live jobs as keyed state."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from millrace.sources import exports
from millrace.streaming import streams


def _write(root, channel, day, messages):
    (root / channel).mkdir(parents=True, exist_ok=True)
    start = dt.datetime.fromisoformat(day).replace(tzinfo=dt.timezone.utc).timestamp()
    with open(root / channel / f"{day}.jsonl", "a") as f:
        f.writelines(json.dumps({"ts": str(start + i), "user": "u", "text": t}) + "\n" for i, t in messages)


def test_stream_of_exports_equals_the_batch(spark, tmp_path):
    exports.register(spark)
    root, seen = tmp_path / "export", []
    for channel in ("general", "random"):
        for day in ("2024-01-01", "2024-01-02", "2024-01-05"):
            _write(root, channel, day, [(i, f"{channel} {day} {i}") for i in range(3)])
    (root / "general" / "notes.txt").write_text("no messages")
    with open(root / "random" / "2024-01-02.jsonl", "a") as f:
        f.write("no json\n\n")

    def run():
        stream = spark.readStream.format("channel_export").option("path", f"file://{root}").option("rewind_days", "2").load()
        batches = []
        streams.run_available(stream, str(tmp_path / "checkpoint"), lambda rows, i: batches.append([tuple(r) for r in rows.select("channel", F.col("day").cast("string"), "text").collect()]))
        seen.extend(batches)
        return [r for b in batches for r in b]

    batch = lambda: {tuple(r) for r in spark.read.format("channel_export").option("path", f"file://{root}").load().select("channel", F.col("day").cast("string"), "text").collect()}
    first = run()
    assert len(first) == len(set(first)) == 18 and set(first) == batch()
    assert run() == []  # nothing has changed
    _write(root, "general", "2024-01-05", [(9, "late")])
    _write(root, "general", "2024-01-07", [(1, "new")])
    again = run()
    assert {(c, d) for c, d, _ in again} == {("general", "2024-01-05"), ("general", "2024-01-07")}  # not the days before the rewind, nor the other channel
    assert set(first) | set(again) == batch()
    assert spark.read.format("channel_export").option("path", f"file://{tmp_path}/none").load().count() == 0


def test_live_jobs_as_state(spark, tmp_path):
    kind = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    setting, before = "spark.sql.streaming.stateStore.providerClass", spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set(setting, kind)
    schema = "job_key string, ts timestamp, event_id long, what string"
    minute = lambda m: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m)
    batches = [
        [("a", 0, 1, "ask"), ("a", 1, 2, "ask"), ("b", 0, 3, "ask"), ("c", 0, 4, "done"), (None, 0, 5, "ask")],
        [("a", 10, 6, "done"), ("a", 11, 7, "ask"), ("b", 20, 8, "ask"), ("a", 12, 9, "ask")],
        [("a", 200, 10, "done"), ("b", 200, 11, "ask"), ("c", 201, 12, "ask")],
        [("a", 205, 13, "ask"), ("a", 206, 14, "done"), ("a", 206, 15, "ask"), ("b", 210, 16, "ask")],
        [("d", 900, 17, "ask")],
    ]
    try:
        got, states = [], []
        for i, rows in enumerate(batches):
            spark.createDataFrame([(k, minute(m), e, w) for k, m, e, w in rows], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
            query = streams.accepted_requests(stream, expiry_seconds=3600, lateness="5 minutes").writeStream.option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True)
            query = query.foreachBatch(lambda out, _: got.extend((r.job_key, r.event_id) for r in out.collect())).start()
            query.awaitTermination()
            if query.lastProgress and query.lastProgress["stateOperators"]:
                states.append(query.lastProgress["stateOperators"][0]["numRowsTotal"])
    finally:
        spark.conf.set(setting, before)
    every = spark.createDataFrame([(k, minute(m), e, w) for rows in batches for k, m, e, w in rows], schema)
    want = sorted((r.job_key, r.event_id) for r in streams.accepted_requests(every, 3600).collect())
    assert sorted(got) == want == [("a", 1), ("a", 7), ("a", 13), ("a", 15), ("b", 3), ("b", 11), ("c", 12), ("d", 17)]
    assert states[-1] <= 4  # the keys of earlier batches have gone
