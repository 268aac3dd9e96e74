"""Two-pass external shuffle into shards, with DataFrame functions only.

Pass one scatters the records, texts included: the shard is the one with the
highest seeded hash of (key, shard), so one more shard takes records only into
itself; inside a shard, seeded hashes scatter them uniformly into buckets of
about ``bucket_bytes``. Pass two gathers one bucket at a time in memory, puts it
in a fixed order, gives it a seeded Fisher-Yates shuffle (Spark's ``shuffle``)
and writes it. A record's slot is its place in the bucket plus the sizes of the
buckets before. Which partition a bucket is in, and so the seed of its shuffle,
depends on the bucket alone: slots are a function of the records and the seed,
not of the session's number of partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

#: Shards and seed of the registered query; bytes of records in a bucket.
SHARDS, SEED, BUCKET_BYTES = 24, 20240, 8 << 20
#: Partitions of the second pass at most; beyond that each has several buckets.
PARTITIONS = 100_000
#: Rows equal in all they are scattered by, beyond which they are scattered by their place in the input as well.
EQUAL_ROWS = 4096
#: Rows of a table that may be sent to all tasks.
SENT_ROWS = 1_000_000


def shard_of(key: Column, shards: int, seed: int = SEED) -> Column:
    """The shard with the highest hash; it changes only to the new shard when one is added."""
    return F.greatest(*(F.struct(F.xxhash64(key, F.lit(s), F.lit(seed)).alias("h"), F.lit(s).alias("shard")) for s in range(shards)))["shard"] if shards > 1 else F.lit(0)


def external_shuffle(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES, payload: tuple[str, ...] = ("text",)) -> DataFrame:
    """``docs(doc_id, text)`` -> ``(doc_id, size, shard, slot, grown_shard, *payload)``, a row for each row.

    The law is ``key``: doc_id and the number of shards decide the shard, so
    equal texts of different doc_ids are unrelated records, and rows of one
    doc_id share a shard. ``size`` is the UTF-8 bytes of the text (null: none)
    plus 8. ``slot`` counts from 0 in each shard without gaps; ``grown_shard``
    is the shard with one more shard. ``payload`` columns of docs travel with
    the record; other columns are ignored, whatever their names. Null doc_ids
    hash like a value of their own. Equal rows are records of their own; where
    more than EQUAL_ROWS are equal, their place in the input takes part in the
    choice of the bucket, so that no bucket has them all. An empty table gives
    no rows.
    """
    text = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    records = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("crc"), *(F.col(c).alias(f"p_{i}") for i, c in enumerate(payload)))
    by = ["doc_id", "size", "crc"]
    equal = records.groupBy(*by).agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))
    total, often = equal.agg(F.sum("bytes"), F.count_if(F.col("n") > EQUAL_ROWS)).first()
    if often:
        hot = equal.where(F.col("n") > EQUAL_ROWS).select(*(F.col(c).alias(f"h_{c}") for c in by))
        same = F.lit(True)
        for c in by:
            same = same & F.col(c).eqNullSafe(F.col(f"h_{c}"))
        records = records.withColumn("place", F.monotonically_increasing_id()).join(F.broadcast(hot) if often <= SENT_ROWS else hot, same, "left")
        records = records.withColumn("place", F.when(F.col("h_crc").isNotNull(), F.col("place")).otherwise(0)).drop(*(f"h_{c}" for c in by))
    else:
        records = records.withColumn("place", F.lit(0).cast("long"))

    buckets = max(1, -(-(total or 0) // (shards * bucket_bytes)))
    every = shards * buckets
    bucket = shard_of(F.col("doc_id"), shards, seed) * F.lit(buckets) + F.pmod(F.xxhash64(*by, "place", F.lit(seed + 1)), F.lit(buckets))
    dealt = records.withColumn("bucket", bucket.cast("long"))
    width = min(every, PARTITIONS)
    at = F.expr(f"cast(bucket * {width} div {every} as int)")
    held = [c for c in dealt.columns if c not in ("bucket", "place", "crc")]
    record = F.struct("doc_id", "size", "crc", *(c for c in held if c not in by))
    rows = dealt.select("bucket", at.alias("at"), record.alias("record"), F.lit(None).cast("long").alias("before"))
    # each bucket's first slot goes where its records go, so that the texts are shuffled once at any size
    shard = F.expr(f"cast(bucket div {buckets} as int)")
    sizes = dealt.groupBy("bucket").agg(F.count("*").alias("n")).withColumn("shard", shard)
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("bucket")) - F.col("n")
    firsts = sizes.select("bucket", at.alias("at"), F.lit(None).cast(rows.schema["record"].dataType).alias("record"), before.alias("before"))
    gathered = rows.unionByName(firsts).repartitionById(width, F.col("at")).groupBy("at", "bucket").agg(F.sort_array(F.collect_list("record")).alias("records"), F.max("before").alias("before"))
    mixed = gathered.sortWithinPartitions("bucket").select(shard.alias("shard"), "before", F.shuffle("records", seed + 2).alias("records"))
    placed = mixed.select("shard", "before", F.posexplode("records").alias("place", "record"))
    return placed.select(
        "record.doc_id",
        "record.size",
        "shard",
        (F.col("before") + F.col("place")).alias("slot"),
        shard_of(F.col("record.doc_id"), shards + 1, seed).alias("grown_shard"),
        *(F.col(f"record.p_{i}").alias(c) for i, c in enumerate(payload)),
    )


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES) -> None:
    """The shuffled records with their texts as Parquet, a folder for each shard; each bucket is one run of slots in order."""
    external_shuffle(docs, shards, seed, bucket_bytes).write.partitionBy("shard").parquet(path)


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """``(doc_id, size, slot, grown_shard, text, shard)`` of written shards."""
    return spark.read.schema("doc_id long, size long, slot long, grown_shard int, text string, shard int").parquet(path)
