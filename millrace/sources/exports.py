"""Exported channel files as a Spark data source, for batches and streams.

An export is a folder with a folder for each channel and a file of JSON lines
for each UTC day in it (``general/2024-01-31.jsonl``), in any store that Arrow
opens by its URI. A stream's offset is a cursor for each channel: its newest
day and that file's size. A batch of the stream reads, for each channel that
has moved on, the days from its cursor less the rewind, so that late edits come
in; the rows of such days come again, and what follows must bear that (see
:func:`millrace.streaming.streams.skip_unchanged`).
"""

from __future__ import annotations

import datetime as dt
import json
import re
from collections.abc import Iterator, Sequence

from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "channel string, day date, ts timestamp, thread_ts timestamp, user string, text string, subtype string"
_FILE = re.compile(r"(?:^|/)([^/]+)/(\d{4}-\d{2}-\d{2})\.jsonl$")


class DayFile(InputPartition):
    """One channel's file of one day, as long as it was when it was listed."""

    def __init__(self, path: str, channel: str, day: str, size: int):
        self.path, self.channel, self.day, self.size = path, channel, day, size


class Export:
    """The files of an export."""

    def __init__(self, options: dict[str, str]):
        self.uri, self.rewind = options["path"], int(options.get("rewind_days", "1"))

    def files(self) -> list[DayFile]:
        """All files, by channel and day."""
        store, root = fs.FileSystem.from_uri(self.uri)
        found = store.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
        named = [(m, f) for f in found if f.type == fs.FileType.File and (m := _FILE.search(f.path))]
        return sorted((DayFile(f.path, m[1], m[2], f.size) for m, f in named), key=lambda f: (f.channel, f.day))

    def rows(self, file: DayFile | None) -> Iterator[tuple]:
        """The messages of a file, up to the size it had; a line that is no JSON object is passed by. No file, which Spark asks for where there is none, has none."""
        if file is None:
            return
        store, _ = fs.FileSystem.from_uri(self.uri)
        with store.open_input_stream(file.path) as f:
            data = f.read(file.size)
        at = lambda x: None if x is None else dt.datetime.fromtimestamp(float(x), dt.timezone.utc)
        for line in data.split(b"\n"):
            try:
                m = json.loads(line) if line.strip() else None
            except ValueError:
                continue
            if isinstance(m, dict):
                yield file.channel, dt.date.fromisoformat(file.day), at(m.get("ts")), at(m.get("thread_ts")), m.get("user"), m.get("text"), m.get("subtype")


class BatchReader(DataSourceReader):
    def __init__(self, export: Export):
        self.export = export

    def partitions(self) -> Sequence[InputPartition]:
        return self.export.files()

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        return self.export.rows(partition)


class StreamReader(DataSourceStreamReader):
    def __init__(self, export: Export):
        self.export = export

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return {f.channel: [f.day, f.size] for f in self.export.files()}  # by day: the last one stays

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        wanted = []
        for f in self.export.files():
            cursor, last = start.get(f.channel), end.get(f.channel)
            if last is None or cursor == last or f.day > last[0]:
                continue
            since = "" if cursor is None else str(dt.date.fromisoformat(cursor[0]) - dt.timedelta(days=self.export.rewind))
            if f.day >= since:
                wanted.append(DayFile(f.path, f.channel, f.day, last[1] if f.day == last[0] else f.size))
        return wanted

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        return self.export.rows(partition)


class ChannelExport(DataSource):
    """``spark.read`` and ``spark.readStream`` of ``format("channel_export")`` with a ``path``; ``rewind_days`` is 1."""

    @classmethod
    def name(cls) -> str:
        return "channel_export"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> BatchReader:
        return BatchReader(Export(self.options))

    def streamReader(self, schema) -> StreamReader:
        return StreamReader(Export(self.options))


def register(spark: SparkSession) -> None:
    """Make the format known to a session."""
    spark.dataSource.register(ChannelExport)
