"""A binary format of token ids with Elias-Fano coded document boundaries.

A shard is one run of documents in ascending doc_id order: their ids, joined,
as 16-bit integers where the vocabulary allows (else 32-bit), and two monotone
sequences in Elias-Fano code, the documents' ends in the id array and their
doc_ids. Each takes about 2 + log2(universe / n) bits an entry; sampled
positions of the set bits answer select, so a document's offsets come from a
few bytes and no table of 64-bit offsets exists.

Shards are rows of a Parquet table (``part``, ``seq``, ``n_docs``, ``n_ids``,
``blob``), so that any store Spark writes to will do, and a lost task leaves
no half-written file.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from millrace.llm.tokens import encoder

MAGIC = b"MRTB"
_HEAD = struct.Struct("<4sBBHQQQq")  # magic, version, bytes of an id, unused, documents, ids, rows without a doc_id (first), smallest doc_id
_EF = struct.Struct("<QQBxxxxxxx")  # entries, bytes of the upper bits, lower bits of an entry
#: Set bits between the sampled positions of select.
SAMPLE = 256
#: Ids of a shard, and bytes of text of a partition, on average.
SHARD_IDS, PARTITION_BYTES = 1 << 20, 64 << 20
#: Shards whose offsets may be sent to all tasks; beyond that they are joined by a shuffle.
SENT_SHARDS = 1_000_000


class EliasFano:
    """A non-decreasing sequence of non-negative integers."""

    def __init__(self, n: int, width: int, lower: np.ndarray, upper: np.ndarray, samples: np.ndarray):
        """``samples`` are positions of every SAMPLE-th set bit of ``upper``, 32 bits each where they fit."""
        self.n, self.width, self.lower, self.upper, self.samples = n, width, lower, upper, samples

    @staticmethod
    def _kind(bits: int) -> str:
        return "<u4" if bits < 1 << 32 else "<u8"

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        v = np.asarray(values, np.uint64)
        n = len(v)
        width = max(0, (int(v[-1]) // n).bit_length() - 1) if n else 0
        ones = (v >> np.uint64(width)).astype(np.int64) + np.arange(n)
        bits = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        bits[ones] = 1
        low = (v[:, None] >> np.arange(width, dtype=np.uint64) & np.uint64(1)).astype(np.uint8)
        return cls(n, width, np.packbits(low.ravel(), bitorder="little"), np.packbits(bits, bitorder="little"), ones[::SAMPLE].astype(cls._kind(8 * (-(-len(bits) // 8)))))

    def tobytes(self) -> bytes:
        return _EF.pack(self.n, len(self.upper), self.width) + self.lower.tobytes() + self.upper.tobytes() + self.samples.tobytes()

    @classmethod
    def read(cls, blob: memoryview, at: int) -> tuple[EliasFano, int]:
        n, size, width = _EF.unpack_from(blob, at)
        at += _EF.size
        parts = []
        for count, kind in (((n * width + 7) // 8, np.uint8), (size, np.uint8), (-(-n // SAMPLE), np.dtype(cls._kind(8 * size)))):
            parts.append(np.frombuffer(blob, kind, count, at))
            at += parts[-1].nbytes
        return cls(n, width, *parts), at

    def select(self, i: int) -> int:
        """Entry i, from the sampled position before it and the bytes between."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        position = int(self.samples[i // SAMPLE])
        rest = i % SAMPLE
        if rest:
            byte = position // 8
            word = int(self.upper[byte]) >> (position % 8 + 1) << (position % 8 + 1)
            while (c := word.bit_count()) < rest:
                rest -= c
                byte += 1
                word = int(self.upper[byte])
            for _ in range(rest - 1):
                word &= word - 1
            position = 8 * byte + (word & -word).bit_length() - 1
        first = i * self.width
        chunk = int.from_bytes(self.lower[first // 8 : (first + self.width + 7) // 8].tobytes(), "little")
        return (position - i) << self.width | chunk >> first % 8 & (1 << self.width) - 1

    def all(self) -> np.ndarray:
        """All entries at once."""
        ones = np.flatnonzero(np.unpackbits(self.upper, bitorder="little"))[: self.n]
        low = np.unpackbits(self.lower, count=self.n * self.width, bitorder="little").reshape(self.n, self.width).astype(np.uint64)
        return ((ones - np.arange(self.n)).astype(np.uint64) << np.uint64(self.width)) + (low << np.arange(self.width, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)


def shard(doc_ids: list[int | None], documents: list[bytes], width: int) -> bytes:
    """The shard of these documents (ids as little-endian unsigned 32-bit integers), doc_ids ascending and nulls first."""
    lengths = np.array([len(d) // 4 for d in documents], np.int64)
    nulls = sum(d is None for d in doc_ids)
    known = [d for d in doc_ids[nulls:]]
    least = known[0] if known else 0
    ids = np.frombuffer(b"".join(documents), "<u4").astype(f"<u{width}")
    head = _HEAD.pack(MAGIC, 1, width, 0, len(documents), len(ids), nulls, least)
    return b"".join((head, EliasFano.of(np.cumsum(lengths)).tobytes(), EliasFano.of(np.array([d - least for d in known], np.uint64)).tobytes(), ids.tobytes()))


class Shard:
    """Random access to a shard's documents."""

    def __init__(self, blob: bytes):
        self.blob = memoryview(blob)
        magic, version, self.width, _, self.n_docs, self.n_ids, self.nulls, self.least = _HEAD.unpack_from(self.blob, 0)
        if magic != MAGIC or version != 1:
            raise ValueError("not a shard of token ids")
        self.ends, at = EliasFano.read(self.blob, _HEAD.size)
        self.doc_ids, at = EliasFano.read(self.blob, at)
        self.ids = np.frombuffer(self.blob, f"<u{self.width}", self.n_ids, at)

    def document(self, i: int) -> tuple[int | None, int, np.ndarray]:
        """doc_id, ids of the shard before it, and the ids of document i."""
        start = self.ends.select(i - 1) if i else 0
        return (None if i < self.nulls else self.least + self.doc_ids.select(i - self.nulls)), start, self.ids[start : self.ends.select(i)]


def write_ids(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2) -> None:
    """Write ``docs(doc_id, text)`` as shards in ascending doc_id order (rows of one doc_id by text) to ``path``.

    Null and empty texts are the end id alone; rows without a doc_id come
    first; an empty table gives a table without shards; other columns are
    ignored.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // PARTITION_BYTES))
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        model = encoder(tokenizer)
        width = 2 if max(model.size, end_id + 1) <= 1 << 16 else 4
        doc_ids: list = []
        documents: list[bytes] = []
        held = 0

        def full() -> pa.RecordBatch:
            nonlocal doc_ids, documents, held, seq
            columns = [[part], [seq], [len(documents)], [held], [shard(doc_ids, documents, width)]]
            doc_ids, documents, held, seq = [], [], 0, seq + 1
            return pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if i == 4 else pa.int64()) for i, c in enumerate(columns)], ["part", "seq", "n_docs", "n_ids", "blob"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = model.ids(text) + end
                doc_ids.append(doc_id)
                documents.append(ids)
                held += len(ids) // 4
                if held >= SHARD_IDS:
                    yield full()
        if documents:
            yield full()

    ordered = rows.repartitionByRange(parts, F.asc_nulls_first("doc_id"), F.xxhash64("text")).sortWithinPartitions(F.asc_nulls_first("doc_id"), F.xxhash64("text"), "text")
    ordered.mapInArrow(run, "part long, seq long, n_docs long, n_ids long, blob binary").write.option("compression", "zstd").parquet(path)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """``(doc_id, start, n_tokens, ids)`` of the shards at ``path``; ids are little-endian unsigned 32-bit, start counts all ids before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, seq, blob in zip(*(batch.column(i).to_pylist() for i in range(3))):
                s = Shard(blob)
                rows = [(part, seq, doc_id, start, len(ids), ids.astype("<u4").tobytes()) for doc_id, start, ids in map(s.document, range(s.n_docs))]
                kinds = [pa.int64()] * 5 + [pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["part", "seq", "doc_id", "within", "n_tokens", "ids"])

    shards = spark.read.schema("part long, seq long, n_docs long, n_ids long, blob binary").parquet(path)
    sizes = shards.select("part", "seq", "n_ids")
    of_parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("n")).withColumn("before", F.sum("n").over(Window.orderBy("part")) - F.col("n"))
    inside = sizes.withColumn("ahead", F.sum("n_ids").over(Window.partitionBy("part").orderBy("seq")) - F.col("n_ids"))
    base = inside.join(of_parts, "part").select("part", "seq", (F.col("before") + F.col("ahead")).alias("base"))
    base = F.broadcast(base) if sizes.count() <= SENT_SHARDS else base
    documents = shards.select("part", "seq", "blob").mapInArrow(run, "part long, seq long, doc_id long, within long, n_tokens long, ids binary")
    return documents.join(base, ["part", "seq"]).select("doc_id", (F.col("base") + F.col("within")).alias("start"), "n_tokens", "ids")
