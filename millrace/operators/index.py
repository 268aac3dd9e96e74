"""A stored text index in segments: postings with positions, document frequencies and statistics by access class.

Chunks that the same principals see form an access class (tenant, public,
groups). A posting carries its chunk's class, and frequencies and statistics
are kept for each class, so what a caller sees is a sum over the classes that
the access rules let through, and no search reads the chunks.

An index is a list of segments. Each holds the chunks added with it and the ids
of chunks that it takes out of earlier segments; its frequencies and statistics
are differences (added minus taken out), so those of an index are plain sums. A
change writes its own segment only; segments are merged by size.

Postings are stored in runs: a row lists the chunks that hold a term among some
thousands, so what is shuffled, sorted and written are terms of runs. Positions
of a row are one flat list, with the place where each chunk's end.

Layout of a segment: ``postings/bucket=i`` (buckets of terms, sorted by term;
bucket -1 lists all chunks), ``frequencies``, ``classes``, ``gone``,
and ``grams`` (lists of chunks by trigrams or values, if the index has any).
``manifest/version=n`` names the segments of each version of the index.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, replace
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from millrace.functions.text import Stems
from millrace.operators.keylists import JSON, holders, key_lists, path_values, trigrams

#: Chunks for each bucket of a new index, and its most buckets.
BUCKET_CHUNKS, MOST_BUCKETS = 1_000, 4096
#: Terms up to which a search names them in the scan's filter; more are joined.
NAMED_TERMS = 400
#: Tables of a segment; {kind} is the type of chunk ids.
_TABLES = {
    "postings": "term string, chunks array<{kind}>, classes array<long>, ends array<int>, n_terms array<int>, gaps array<int>, bucket int",
    "frequencies": "term string, class_id long, df long, occurrences long, bucket int",
    "classes": "class_id long, tenant_id string, acl_public boolean, acl_groups array<string>, chunks long, terms long",
    "gone": "chunk_id {kind}",
    "grams": "field string, gram long, n int, chunks array<{kind}>, bucket int",
}
#: Chunks of a run, and characters of their texts, at most.
RUN_CHUNKS, RUN_CHARS = 4096, 8_000_000
#: Partitions in which buckets are dealt, at most: beyond 2000 Spark keeps no sizes of a partition's parts.
MOST_DEALT = 2000
_TOKEN, _ASCII = regex.compile(r"[\p{L}\p{N}]+"), re.compile("[a-z0-9]+")


@dataclass(frozen=True)
class Index:
    """Chunks, and what is known of their terms.

    ``runs(term, chunks, classes, ends, n_terms, gaps, bucket, number)``, the
    postings as :func:`analyzed` gives them; ``number`` is their segment's;
    ``postings(term, chunk_id, class_id, tf, n_terms, gaps, bucket)``, a row for
    each; gaps are the first position and the distances to the next ones;
    ``frequencies(term, class_id, df, occurrences, bucket)``;
    ``classes(class_id, tenant_id, acl_public, acl_groups, chunks, terms)``;
    ``lengths(chunk_id, class_id, n_terms)``, one row for each chunk. A stored
    index may have ``grams(field, gram, n, chunks, bucket, number)``, which also
    list chunks that ``gone(_gone, until)`` takes out.
    """

    chunks: DataFrame
    runs: DataFrame
    frequencies: DataFrame
    classes: DataFrame
    english: bool = False
    buckets: int = 1
    grams: DataFrame | None = None
    gone: DataFrame | None = None
    fields: tuple[str, ...] = ()

    @property
    def postings(self) -> DataFrame:
        return self._each(self.runs.where("bucket >= 0"))

    @property
    def lengths(self) -> DataFrame:
        return self._each(self.runs.where("bucket = -1")).select("chunk_id", "class_id", "n_terms")

    def postings_of(self, terms: Sequence[str]) -> DataFrame:
        """The postings of the terms; other runs are left before they are spread."""
        return self._each(self.of_terms(self.runs, terms))

    def _each(self, runs: DataFrame) -> DataFrame:
        rows = _spread(runs)
        return (rows if self.gone is None else _left(rows, self.gone)).drop("number")

    @property
    def stats(self) -> DataFrame:
        """``(tenant_id, chunk_count, avg_len)``; the average number of terms is 1 at least."""
        sums = self.classes.groupBy("tenant_id").agg(F.sum("chunks").alias("chunk_count"), F.sum("terms").alias("n"))
        return sums.select("tenant_id", "chunk_count", F.greatest(F.col("n") / F.col("chunk_count"), F.lit(1.0)).alias("avg_len"))

    def of_terms(self, rows: DataFrame, terms: Sequence[str]) -> DataFrame:
        """The rows of runs or frequencies that belong to the terms, from their buckets only."""
        if self.buckets > 1:
            rows = rows.where(F.col("bucket").isin(sorted({zlib.crc32(t.encode()) % self.buckets for t in terms})))
        if len(terms) <= NAMED_TERMS:
            return rows.where(F.col("term").isin(list(terms)))
        wanted = rows.sparkSession.createDataFrame([(t,) for t in terms], "term string")
        return rows.join(F.broadcast(wanted), "term", "left_semi")  # the terms of a batch of requests

    def may_hold(self, needle: str, field: str = "content") -> DataFrame | None:
        """``(chunk_id)`` of a few chunks among which are all whose field holds the needle in any case; null where the index cannot tell.

        It cannot without trigrams, and for needles below three characters.
        """
        spark = self.classes.sparkSession
        low = spark.range(1).select(F.lower(F.lit(needle)).alias("low")).first()["low"]
        return None if len(low) < 3 else self._holders(field, trigrams(low).tolist())

    def may_contain(self, wanted: Any, field: str = "metadata") -> DataFrame | None:
        """``(chunk_id)`` of a few chunks among which are all whose JSON field contains the value; null where the index cannot tell.

        It cannot without lists of the field, and for a value without scalars.
        """
        return self._holders(field + JSON, path_values(wanted).tolist())

    def _holders(self, field: str, keys: list[int]) -> DataFrame | None:
        if self.grams is None or field not in self.fields or not keys:
            return None
        found = holders(self.grams, field, keys, self.buckets)
        return (found if self.gone is None else _left(found, self.gone)).select("chunk_id")


def _left(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """Rows of segments but for what later segments take out."""
    return rows.join(gone, (F.col("chunk_id") == F.col("_gone")) & (F.col("number") < F.col("until")), "left_anti")


def _bucket(term: Column, buckets: int) -> Column:
    return F.when(term.isNull(), -1).otherwise(F.pmod(F.crc32(term.cast("binary")), F.lit(buckets))).cast("int")


def with_class(chunks: DataFrame) -> DataFrame:
    """Chunks with ``class_id``, and their access rule in one form: no nulls, groups sorted and without repeats."""
    rules = chunks.withColumns({"tenant_id": F.col("tenant_id").cast("string"), "acl_public": F.coalesce("acl_public", F.lit(False)), "acl_groups": F.array_sort(F.array_distinct(F.array_compact(F.coalesce("acl_groups", F.array().cast("array<string>")))))})
    return rules.withColumn("class_id", F.xxhash64("tenant_id", "acl_public", "acl_groups"))


def _of_run(part: pa.RecordBatch, stems: Stems | None) -> list[pa.Array]:
    """Postings of the texts of ``part(chunk_id, class_id, text)`` by term; the first row is that of no term."""
    words, counts, n = [], [], part.num_rows
    for text in part.column(2).to_pylist():
        low = (text or "").lower()
        found = _ASCII.findall(low) if low.isascii() else _TOKEN.findall(low)
        words += found
        counts.append(len(found))
    encoded = pa.array(words, pa.string()).dictionary_encode()
    names, codes = encoded.dictionary, encoded.indices.to_numpy()
    if stems is not None:  # words of one stem are one term, stop words none
        stemmed = [stems[w] for w in names.to_pylist()]
        numbers = {w: i for i, w in enumerate(dict.fromkeys(w for w in stemmed if w is not None))}
        names = pa.array(list(numbers), pa.string())
        codes = np.array([-1 if w is None else numbers[w] for w in stemmed], np.int32)[codes]
    rows_of, counts = np.repeat(np.arange(n), counts), np.array(counts)
    places = np.arange(len(words)) - np.repeat(np.cumsum(counts) - counts, counts)
    order = np.argsort(codes, kind="stable")
    order = order[codes[order] >= 0]
    places, key = places[order], codes[order] * np.int64(n) + rows_of[order]
    # a stretch of equal keys is a posting, postings of one term are a row; before them all is the row of all chunks
    starts = np.flatnonzero(np.diff(key, prepend=-1))
    gaps = np.diff(places, prepend=0)
    gaps[starts] = places[starts]
    term, chunk = np.divmod(key[starts], n)
    firsts = np.flatnonzero(np.diff(term, prepend=-1))
    offsets = pa.array(np.concatenate(([0], n + firsts, [n + len(term)])).astype(np.int32)[: len(firsts) + 2])
    owner = np.concatenate((np.arange(n), chunk))
    n_terms = np.bincount(chunk, minlength=n).astype(np.int32)[owner]
    # where a posting's gaps end among those of its row
    ends = np.append(starts, len(key))[1:] - np.repeat(starts[firsts], np.diff(firsts, append=len(term)))
    lists = (part.column(0).take(pa.array(owner)), part.column(1).take(pa.array(owner)), pa.array(np.concatenate((np.zeros(n), ends)).astype(np.int32)), pa.array(n_terms))
    terms = names.take(pa.array(np.concatenate(([0], term[firsts])), mask=np.arange(len(firsts) + 1) == 0))
    places_of = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], starts[firsts], [len(key)])).astype(np.int32)), pa.array(gaps.astype(np.int32)))
    return [terms, *(pa.ListArray.from_arrays(offsets, values) for values in lists), places_of]


def analyzed(chunks: DataFrame, english: bool = False) -> DataFrame:
    """``(term, chunks, classes, ends, n_terms, gaps)``: for runs of chunks, those whose headings and contents hold a term, and a row with a null term of all.

    Lists of a row go together: the chunk, its class, where its gaps end, the
    chunk's number of terms. Gaps are the first position in a chunk and the
    distances to the next, of all chunks of the row in one list.
    Texts are tokenised once, run by run. In English a stop word takes its
    position and is no term. Null texts have no terms.
    """
    text = F.concat_ws(" ", *(F.col(c) for c in ("heading", "content") if c in chunks.columns))
    rows = with_class(chunks).select("chunk_id", "class_id", text.alias("text"))
    kind = rows.schema["chunk_id"].dataType.simpleString()
    out = f"term string, chunks array<{kind}>, classes array<long>, ends array<int>, n_terms array<int>, gaps array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stems = Stems() if english else None
        for batch in batches:
            ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(2)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            first = 0
            while first < batch.num_rows:
                before = ends[first - 1] if first else 0
                size = min(RUN_CHUNKS, max(1, int(np.searchsorted(ends, before + RUN_CHARS, "right")) - first))
                yield pa.RecordBatch.from_arrays(_of_run(batch.slice(first, size), stems), ["term", "chunks", "classes", "ends", "n_terms", "gaps"])
                first += size

    return rows.mapInArrow(run, out)


def _spread(runs: DataFrame) -> DataFrame:
    """A row for each posting, and for each chunk in the rows without a term."""
    rows = runs.select("*", F.posexplode("chunks").alias("_at", "chunk_id"))
    before = F.coalesce(F.get("ends", F.col("_at") - 1), F.lit(0))
    tf = F.get("ends", F.col("_at")) - before
    return rows.select(
        "term", "chunk_id", F.get("classes", F.col("_at")).alias("class_id"), tf.alias("tf"), F.get("n_terms", F.col("_at")).alias("n_terms"), F.slice("gaps", before + 1, tf).alias("gaps"), *(c for c in ("bucket", "number") if c in runs.columns)
    )


def _gathered(postings: DataFrame, cells: int) -> DataFrame:
    """Runs of postings: those of a term, dealt to cells by chunk."""
    cell = F.pmod(F.xxhash64("chunk_id"), F.lit(cells))
    held = postings.groupBy("term", cell.alias("_cell")).agg(F.collect_list(F.struct("chunk_id", "class_id", "tf", "n_terms", "gaps")).alias("held"))
    rows = held.select("term", F.col("held.chunk_id").alias("chunks"), F.col("held.class_id").alias("classes"), F.col("held.tf").alias("ends"), "held.n_terms", F.flatten("held.gaps").alias("gaps"))

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tfs = batch.column(3)
            bounds, total = tfs.offsets.to_numpy(), np.cumsum(np.concatenate(([0], tfs.flatten().to_numpy())))
            bounds = bounds - bounds[0]
            ends = total[1:] - np.repeat(total[bounds[:-1]], np.diff(bounds))
            yield batch.set_column(3, "ends", pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ends.astype(np.int32))))

    return rows.mapInArrow(summed, rows.schema)


def _frequencies(postings: DataFrame, buckets: int, sign: int = 1) -> DataFrame:
    sums = postings.groupBy("term", "class_id").agg((F.lit(sign) * F.count("*")).alias("df"), (F.lit(sign) * F.sum("tf")).alias("occurrences"))
    return sums.withColumn("bucket", _bucket(F.col("term"), buckets))


def _classes(chunks: DataFrame, lengths: DataFrame, sign: int = 1) -> DataFrame:
    """Statistics of the classes, and their rules."""
    rules = with_class(chunks).groupBy("class_id").agg(F.first("tenant_id").alias("tenant_id"), F.first("acl_public").alias("acl_public"), F.first("acl_groups").alias("acl_groups"))
    sums = lengths.groupBy("class_id").agg((F.lit(sign) * F.count("*")).alias("chunks"), (F.lit(sign) * F.sum("n_terms")).alias("terms"))
    return rules.join(sums, "class_id")


def _summed_classes(rows: DataFrame) -> DataFrame:
    rule = (F.first(c).alias(c) for c in ("tenant_id", "acl_public", "acl_groups"))
    return rows.groupBy("class_id").agg(*rule, F.sum("chunks").alias("chunks"), F.sum("terms").alias("terms")).where("chunks <> 0 or terms <> 0")


def _summed(frequencies: DataFrame, left: str) -> DataFrame:
    return frequencies.groupBy("bucket", "term", "class_id").agg(F.sum("df").alias("df"), F.sum("occurrences").alias("occurrences")).where(left)


def index_of(chunks: DataFrame, english: bool = False) -> Index:
    """An index that is not stored: every search analyzes the chunks again."""
    runs = analyzed(chunks, english).withColumns({"bucket": F.when(F.col("term").isNull(), -1).otherwise(0), "number": F.lit(0)})
    rows = _spread(runs)
    return Index(chunks, runs, _frequencies(rows.where("bucket >= 0"), 1), _classes(chunks, rows.where("bucket = -1")), english)


# ---- stored segments


def _new_segment(path: str) -> str:
    return f"{path}/segments/{uuid.uuid4().hex}"


def _dealt(rows: DataFrame, buckets: int) -> DataFrame:
    """Rows by bucket, in about as many partitions as buckets; Spark joins small ones and splits large ones by their size.

    With several buckets in a partition each part of it would write a file for
    each of them: as many files as the square of the rows.
    """
    return rows.hint("rebalance", max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(MOST_DEALT, buckets + 1)), "bucket")


def _store_postings(rows: DataFrame, segment: str, buckets: int) -> DataFrame:
    """Write runs dealt to buckets in one exchange, which splits and joins buckets by their size, and read them back."""
    dealt = _dealt(rows.withColumn("bucket", _bucket(F.col("term"), buckets)), buckets).sortWithinPartitions("bucket", "term")
    dealt.write.partitionBy("bucket").parquet(f"{segment}/postings")
    return rows.sparkSession.read.schema(T.StructType([*rows.schema, T.StructField("bucket", T.IntegerType())])).parquet(f"{segment}/postings")


def _store_sums(frequencies: DataFrame, classes: DataFrame, gone: DataFrame, segment: str, buckets: int) -> None:
    _dealt(frequencies, buckets).sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(f"{segment}/frequencies")
    classes.coalesce(1).write.parquet(f"{segment}/classes")
    gone.write.parquet(f"{segment}/gone")


@dataclass(frozen=True)
class Manifest:
    """A version of a stored index: its segments with the chunks that each added, the analyzer, the buckets, the type of chunk ids, the columns with lists of keys, and the last change's name."""

    version: int
    segments: tuple[tuple[str, int], ...]
    english: bool
    buckets: int
    kind: str
    fields: tuple[str, ...] = ()
    batch: str | None = None


_MANIFEST = "number int, segment string, chunks long, english boolean, buckets int, kind string, fields array<string>, batch string"


def _publish(spark: SparkSession, path: str, m: Manifest) -> None:
    rows = [(i, s, n, m.english, m.buckets, m.kind, list(m.fields), m.batch) for i, (s, n) in enumerate(m.segments)]
    spark.createDataFrame(rows, _MANIFEST).coalesce(1).write.parquet(f"{path}/manifest/version={m.version}")


def manifest(spark: SparkSession, path: str) -> Manifest:
    """The newest version of a stored index."""
    rows = spark.read.schema(f"{_MANIFEST}, version int").parquet(f"{path}/manifest").collect()  # a few rows a change
    newest = max(r["version"] for r in rows)
    rows = sorted((r for r in rows if r["version"] == newest), key=lambda r: r["number"])
    return Manifest(newest, tuple((r["segment"], r["chunks"]) for r in rows), rows[0]["english"], rows[0]["buckets"], rows[0]["kind"], tuple(rows[0]["fields"]), rows[0]["batch"])


def _store_grams(chunks: DataFrame, fields: Sequence[str], segment: str, buckets: int) -> None:
    if fields:
        _store_lists(key_lists(chunks, fields).withColumn("bucket", F.pmod("gram", F.lit(buckets)).cast("int")), segment, buckets)


def _store_lists(lists: DataFrame, segment: str, buckets: int) -> None:
    _dealt(lists, buckets).sortWithinPartitions("bucket", "field", "gram").write.partitionBy("bucket").parquet(f"{segment}/grams")


def write_index(chunks: DataFrame, path: str, english: bool = False, buckets: int | None = None, fields: Sequence[str] = ()) -> None:
    """Store a new index of the chunks as one segment: one analysis of the texts, one exchange of the postings.

    ``fields`` names columns whose parts are searched for (:meth:`Index.may_hold`),
    or, with ``@json`` behind the name, whose JSON is (:meth:`Index.may_contain`).
    """
    spark = chunks.sparkSession
    buckets = buckets or min(MOST_BUCKETS, 1 + chunks.count() // BUCKET_CHUNKS)
    segment = _new_segment(path)
    stored = _spread(_store_postings(analyzed(chunks, english), segment, buckets))
    postings, lengths = stored.where("bucket >= 0"), stored.where("bucket = -1")
    _store_sums(_frequencies(postings, buckets), _classes(chunks, lengths), chunks.select("chunk_id").where("false"), segment, buckets)
    _store_grams(chunks, fields, segment, buckets)
    _publish(spark, path, Manifest(0, ((segment, lengths.count()),), english, buckets, chunks.schema["chunk_id"].dataType.simpleString(), tuple(fields)))


def update_index(path: str, before: DataFrame, after: DataFrame, merge: bool = True, batch: str | None = None) -> None:
    """Take the chunks ``before`` out of a stored index and put the chunks ``after`` in, as one new segment.

    ``before`` holds the rows as they were indexed (texts and access rules), so
    that their frequencies can be taken off; a chunk in both is replaced. The
    work and what is written grow with the two tables, not with the index, but
    for merges: see :func:`merge_segments`. A change with the name of the last
    one is that change once more, and is left out.
    """
    spark = before.sparkSession
    m = manifest(spark, path)
    if batch is not None and batch == m.batch:
        return
    segment = _new_segment(path)
    stored = _spread(_store_postings(analyzed(after, m.english), segment, m.buckets))
    postings, lengths = stored.where("bucket >= 0"), stored.where("bucket = -1")
    old = _spread(analyzed(before, m.english))
    freq = _frequencies(postings, m.buckets).unionByName(_frequencies(old.where("term is not null"), m.buckets, -1))
    classes = _classes(after, lengths).unionByName(_classes(before, old.where("term is null"), -1))
    _store_sums(_summed(freq, "df <> 0 or occurrences <> 0"), classes, before.select("chunk_id").distinct(), segment, m.buckets)
    _store_grams(after, m.fields, segment, m.buckets)
    _publish(spark, path, replace(m, version=m.version + 1, segments=(*m.segments, (segment, lengths.count())), batch=batch))
    if merge:
        merge_segments(spark, path)


def merge_segments(spark: SparkSession, path: str, factor: int = 2) -> None:
    """Merge the last segments as long as the one before has at most ``factor`` times the chunks of those behind it.

    So the segments' sizes grow by more than ``factor`` from the last to the
    first, there are about log(chunks) of them, and a chunk is rewritten about
    log(chunks) times.
    """
    m = manifest(spark, path)
    first, size = len(m.segments) - 1, m.segments[-1][1]
    while first > 0 and m.segments[first - 1][1] <= factor * size:
        first -= 1
        size += m.segments[first][1]
    if first == len(m.segments) - 1:
        return
    parts = replace(m, segments=m.segments[first:])
    segment = _new_segment(path)
    live = _left(_spread(_read(spark, parts, "postings")), _gone(spark, parts))
    stored = _spread(_store_postings(_gathered(live, 1 + size // RUN_CHUNKS), segment, m.buckets))
    freq = _summed(_read(spark, parts, "frequencies"), "df <> 0 or occurrences <> 0")
    _store_sums(freq, _summed_classes(_read(spark, parts, "classes")), _read(spark, parts, "gone").select("chunk_id").distinct(), segment, m.buckets)
    if m.fields:  # an entry goes with its chunk, a list that is left empty goes too
        entries = _read(spark, parts, "grams").select("field", "gram", "bucket", "number", F.spark_partition_id().alias("part"), F.explode("chunks").alias("chunk_id"))
        lists = _left(entries, _gone(spark, parts)).groupBy("field", "gram", "bucket", "number", "part").agg(F.count("*").cast("int").alias("n"), F.collect_list("chunk_id").alias("chunks"))
        _store_lists(lists.select("field", "gram", "n", "chunks", "bucket"), segment, m.buckets)
    _publish(spark, path, replace(m, version=m.version + 1, segments=(*m.segments[:first], (segment, stored.where("bucket = -1").count()))))


def _read(spark: SparkSession, m: Manifest, name: str) -> DataFrame:
    """One table of all segments, with the segment's ``number``."""
    found = None
    for i, (segment, _) in enumerate(m.segments):
        rows = spark.read.schema(_TABLES[name].format(kind=m.kind)).parquet(f"{segment}/{name}").withColumn("number", F.lit(i))
        found = rows if found is None else found.unionByName(rows)
    return found


def _gone(spark: SparkSession, m: Manifest) -> DataFrame:
    """``(_gone, until)``: chunks taken out, and the segment below whose number they are dead."""
    return _read(spark, m, "gone").groupBy(F.col("chunk_id").alias("_gone")).agg(F.max("number").alias("until"))


def read_index(chunks: DataFrame, path: str) -> Index:
    """The stored index of these chunks at its newest version."""
    spark = chunks.sparkSession
    m = manifest(spark, path)
    runs, freq, classes = _read(spark, m, "postings"), _read(spark, m, "frequencies"), _read(spark, m, "classes")
    if len(m.segments) > 1:
        freq, classes = _summed(freq, "df > 0"), _summed_classes(classes)
    grams, gone = _read(spark, m, "grams") if m.fields else None, _gone(spark, m) if len(m.segments) > 1 else None
    return Index(chunks, runs, freq.drop("number"), classes.where("chunks > 0").drop("number"), m.english, m.buckets, grams, gone, m.fields)
