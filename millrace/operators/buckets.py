"""Stored tables in hash buckets of a key: a change reads and rewrites the buckets of its keys only.

A table is a folder partitioned by ``bucket``; buckets are replaced by Spark's
dynamic partition overwrite, so a task that is lost leaves nothing half
written, and a change that is applied twice leaves the same rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from millrace.operators import state


@dataclass(frozen=True)
class Buckets:
    """A stored table: its folder, its columns, the key, and the number of buckets."""

    spark: SparkSession
    path: str
    schema: T.StructType
    key: str = "document_id"
    count: int = 64

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.count)).cast("int")

    def _stored(self) -> DataFrame:
        fields = [T.StructField(f.name, f.dataType) for f in self.schema]
        return self.spark.read.schema(T.StructType([*fields, T.StructField("bucket", T.IntegerType())])).parquet(self.path)

    def rows(self) -> DataFrame:
        return self._stored().drop("bucket")

    def of(self, keys: DataFrame) -> DataFrame:
        """The rows of the keys, from their buckets."""
        return self._stored().where(F.col("bucket").isin(self.touched(keys))).drop("bucket").join(keys.select(self.key).distinct(), self.key, "left_semi").select(self.schema.names)

    def touched(self, keys: DataFrame) -> list[int]:
        """The keys' buckets, of which there are ``count`` at most."""
        return sorted(r[0] for r in keys.select(self.bucket().alias("b")).distinct().collect())

    def check(self, new: DataFrame, expected: DataFrame) -> None:
        """ValueError for a key whose rows in ``new`` are not the n of ``expected(key, n)``."""
        given = new.groupBy(self.key).agg(F.count("*").alias("given"))
        odd = expected.join(given, self.key, "full_outer").where(F.coalesce("n", F.lit(0)) != F.coalesce("given", F.lit(0))).select(self.key, "n", "given").limit(3).collect()
        if odd:
            raise ValueError(f"refusing to write: rows are missing or too many, such as {[tuple(r) for r in odd]}")

    def replace(self, keys: DataFrame, new: DataFrame, expected: DataFrame | None = None) -> None:
        """All rows of ``keys`` replaced by ``new``; a key without new rows is gone, a new row's key counts as one of them.

        ``expected(key, n)`` is checked before anything is written, see :meth:`check`.
        """
        if expected is not None:
            self.check(new, expected)
        asked = keys.select(self.key).unionByName(new.select(self.key)).distinct()
        touched = self.touched(asked)
        old = self._stored().where(F.col("bucket").isin(touched))
        folders = {f"bucket={b}" for b in touched}
        files = set(old.inputFiles())
        kept = old.join(asked, self.key, "left_anti").select(*self.schema.names, "bucket")
        self._write(kept.unionByName(new.select(*self.schema.names, self.bucket().alias("bucket"))))
        # a bucket that has no rows any more is not among the written ones
        left = {f for f in self._stored().inputFiles() if f in files and f.split("/")[-2] in folders}
        for folder in sorted({f.rpartition("/")[0] for f in left}):
            context = self.spark.sparkContext
            at = context._jvm.org.apache.hadoop.fs.Path(folder)
            at.getFileSystem(context._jsc.hadoopConfiguration()).delete(at, True)

    def upsert(self, new: DataFrame, update: Sequence[str]) -> None:
        """``new`` by the key: known rows change in the ``update`` columns, others are added."""
        self.replace(new, state.upsert(self.of(new), new, [self.key], update))

    def _write(self, rows: DataFrame) -> None:
        dealt = rows.repartition("bucket").sortWithinPartitions("bucket", self.key)
        dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(self.path)


def write_buckets(rows: DataFrame, path: str, key: str = "document_id", count: int = 64) -> Buckets:
    """A new stored table of these rows; rows without a key share a bucket."""
    table = Buckets(rows.sparkSession, path, rows.schema, key, count)
    table._write(rows.withColumn("bucket", table.bucket()))
    return table
