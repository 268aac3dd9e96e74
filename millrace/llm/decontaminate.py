"""Benchmark passages in documents, by Wu-Manber search over words.

The test strings are all windows of ``window`` consecutive words of the items
(a shorter item is one string). For each length of string, a shift table by
pairs of neighbouring words says how far the search may jump; a pair that ends
a string has a bucket of the strings with that ending, by their first pair, and
these are compared word by word. The tables are sorted arrays, about 40 bytes
for each word of the items; the items' texts are broadcast, PASS_BYTES at most
at a time, and every process builds the tables from them once. Segments of many
documents are searched in step, each jumping by its own shifts.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from millrace.llm import columns
from millrace.llm.scratch import dropped, written
from millrace.llm.textnum import mix, release_memory, window_hashes, word_batches

#: Bytes of item texts searched for at once; further items take another pass over the documents.
PASS_BYTES = 8 << 20
#: Positions that a segment covers, and bytes of text searched in step.
SEGMENT, RUN_BYTES = 256, 1 << 18
_U = np.uint64
_WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

RESULTS = ["n_words", "spans", "items"]
SCHEMA = "doc_id long, text string, n_words long, spans array<long>, items array<string>"


def words_of(text: str | None) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after A-Z became a-z; none for a null."""
    return [] if text is None else text.encode("utf-8", "surrogatepass").translate(_WORD_BYTES).split()


def _both(last: np.ndarray, first: np.ndarray) -> np.ndarray:
    return mix(last * _U(0xD1342543DE82EF95) + first)


class WuManber:
    """Search for the windows of ``length`` words of texts, each with an owner."""

    def __init__(self, length: int, texts: Sequence[tuple[str | None, list[bytes]]]):
        self.length, self.pair = length, min(2, length)
        self.owners = [owner for owner, _ in texts]
        words = [w for _, ws in texts for w in ws]
        self.buffer = b" ".join(words)
        sizes = np.array([len(w) + 1 for w in words], np.int64)
        #: First byte of each word, and one beyond the last word's.
        self.byte = np.concatenate(([0], np.cumsum(sizes)))
        h = np.concatenate([x for _, x, _ in word_batches([self.buffer.decode("utf-8", "surrogatepass")])] or [np.zeros(0, _U)])
        pairs = window_hashes(h, self.pair)
        counts = np.array([len(ws) for _, ws in texts], np.int64)
        first = np.cumsum(counts) - counts
        # shift of the pair at each place: how far it is from the end of the first window of its text, 0 from there on
        held = np.maximum(counts - self.pair + 1, 0)
        place = np.arange(held.sum()) - np.repeat(np.cumsum(held) - held, held)
        keys, shift = pairs[place + np.repeat(first, held)], np.maximum(length - self.pair - place, 0)
        order = np.lexsort((shift, keys))
        new = np.concatenate((np.ones(min(1, len(keys)), bool), keys[order][1:] != keys[order][:-1]))
        self.keys, self.shift = keys[order][new], shift[order][new].astype(np.int32)
        # buckets: windows by their last pair and their first
        n = np.maximum(counts - length + 1, 0)
        starts = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)
        owner = np.repeat(np.arange(len(texts)), n)
        bucket = _both(pairs[starts + length - self.pair], pairs[starts])
        # each distinct window once, with the run of its owners
        whole = window_hashes(h, length)[starts]
        order = np.lexsort((owner, whole, bucket))
        bucket, whole, starts, self.owner = bucket[order], whole[order], starts[order], owner[order].astype(np.int32)
        same = np.zeros(len(order), bool)
        same[1:] = (bucket[1:] == bucket[:-1]) & (whole[1:] == whole[:-1])
        for i in np.flatnonzero(same).tolist():  # a window is the one before it if its words are
            same[i] = self.window(starts[i]) == self.window(starts[i - 1])
        firsts = np.flatnonzero(~same)
        self.bucket, self.starts, self.runs = bucket[firsts], starts[firsts], np.append(firsts, len(order))

    def window(self, start: int) -> bytes:
        return self.buffer[self.byte[start] : self.byte[start + self.length] - 1]

    def owners_of(self, windows: set[int]) -> set[str]:
        """The owners of some distinct windows (those that have a name)."""
        found = {k for w in windows for k in self.owner[self.runs[w] : self.runs[w + 1]].tolist()}
        return {o for k in found if (o := self.owners[k]) is not None}

    def search(self, h: np.ndarray, offsets: np.ndarray, words: Callable[[int], list[bytes]]) -> Iterator[tuple[int, int, int]]:
        """(text, first word, distinct window) of every occurrence in texts of words with hashes ``h[offsets[i]:offsets[i + 1]]``."""
        m, jump = self.length, self.length - self.pair + 1
        pairs = window_hashes(h, self.pair)
        begin, size = offsets[:-1] + m - self.pair, np.diff(offsets) - m + 1
        if not len(self.keys) or not (size > 0).any():
            return
        segments = np.maximum(-(-size // SEGMENT), 0)
        text = np.repeat(np.arange(len(size)), segments)
        at = begin[text] + SEGMENT * (np.arange(len(text)) - np.repeat(np.cumsum(segments) - segments, segments))
        stop = np.minimum(at + SEGMENT, (begin + size)[text])
        found = []
        while len(at):
            key = pairs[at]
            near = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            step = np.where(self.keys[near] == key, self.shift[near], jump)
            found.append(np.stack((text[step == 0], at[step == 0])))
            at = at + np.maximum(step, 1)
            on = at < stop
            at, stop, text = at[on], stop[on], text[on]
        text, at = np.concatenate(found, axis=1)
        start = at - (m - self.pair)
        key = _both(pairs[at], pairs[start])
        low = np.searchsorted(self.bucket, key)
        hit = self.bucket[np.minimum(low, len(self.bucket) - 1)] == key
        for i, k, first in sorted(zip(text[hit].tolist(), (start[hit] - offsets[text[hit]]).tolist(), low[hit].tolist())):
            here = b" ".join(words(i)[k : k + m])
            last = first
            while last < len(self.bucket) and self.bucket[last] == self.bucket[first]:
                if self.window(self.starts[last]) == here:
                    yield i, k, last
                    break
                last += 1


def searchers(items: Sequence[tuple[str | None, str | None]], window: int) -> list[WuManber]:
    """A search for each length of test string of ``(item_id, text)``."""
    by_length: dict[int, list[tuple[str | None, list[bytes]]]] = {}
    for item_id, text in items:
        if words := words_of(text):
            by_length.setdefault(min(window, len(words)), []).append((item_id, words))
    return [WuManber(m, texts) for m, texts in sorted(by_length.items())]


_built: dict[str, list[WuManber]] = {}


def _searchers(key: str, items: Sequence[tuple[str | None, str | None]], window: int) -> list[WuManber]:
    """The searches of one pass, built once by a process."""
    if key not in _built:
        _built.clear()
        _built[key] = searchers(items, window)
    return _built[key]


def merged(spans: list[tuple[int, int]]) -> list[int]:
    """first, end, first, end ... of the union of half-open spans."""
    out: list[int] = []
    for a, b in sorted(spans):
        if out and a <= out[-1]:
            out[-1] = max(out[-1], b)
        else:
            out += [a, b]
    return out


def _scan(items, key: str, window: int, n_keep: int) -> Callable:
    names = ["doc_id", "text", *RESULTS, *(f"k_{i}" for i in range(n_keep))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found_by = _searchers(key, items.value, window)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            n_words = [0] * len(texts)
            hits: dict[int, list[tuple[int, int]]] = {}
            windows: dict[tuple[int, int], set[int]] = {}
            for first, h, offsets in word_batches(texts, size=RUN_BYTES, table=_WORD_BYTES):
                n_words[first : first + len(offsets) - 1] = np.diff(offsets).tolist()
                split: dict[int, list[bytes]] = {}

                def words(i: int, first=first, split=split) -> list[bytes]:
                    if i not in split:
                        split.clear()
                        split[i] = words_of(texts[first + i])
                    return split[i]

                for at, w in enumerate(found_by):
                    for i, start, window_at in w.search(h, offsets, words):
                        spans = hits.setdefault(first + i, [])
                        if spans and spans[-1][0] <= start <= spans[-1][1]:
                            spans[-1] = (spans[-1][0], max(spans[-1][1], start + w.length))
                        else:
                            spans.append((start, start + w.length))
                        windows.setdefault((first + i, at), set()).add(window_at)
            owners: dict[int, set[str]] = {}
            for (i, at), those in windows.items():
                owners.setdefault(i, set()).update(found_by[at].owners_of(those))
            spans, known = [], []
            for i, (before, those) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())):
                spans.append(merged([*zip((before or [])[0::2], (before or [])[1::2]), *hits.get(i, ())]))
                known.append(sorted({*(those or ()), *owners.get(i, ())}))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n_words, pa.int64()), pa.array(spans, pa.list_(pa.int64())), pa.array(known, pa.list_(pa.string())), *batch.columns[4:]], names)
        release_memory()

    return run


def _marked(docs: DataFrame, tests: DataFrame, window: int, names: Sequence[str]) -> DataFrame:
    """Columns of SCHEMA, and ``names`` as k_0, k_1 ..."""
    spark = docs.sparkSession
    rows, fields = columns.carried(docs, names)
    schema = columns.schema(SCHEMA, fields)
    tests = tests.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").alias("text")).where("text is not null").distinct()
    passes = max(1, -(-(tests.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // PASS_BYTES))
    kept = [f.name for f in fields]
    out = rows.select("doc_id", "text", F.lit(None).cast("array<long>").alias("spans"), F.lit(None).cast("array<string>").alias("items"), *kept)
    before = None
    for k in range(passes):
        part = [tuple(r) for r in tests.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == k).collect()]  # PASS_BYTES on average
        out = out.mapInArrow(_scan(spark.sparkContext.broadcast(part), uuid.uuid4().hex, window, len(kept)), schema)
        if k < passes - 1:
            now = written(out, "marked")
            out = now.select("doc_id", "text", "spans", "items", *kept)
            if before is not None:
                dropped(before)
            before = now
    return out


def mark(docs: DataFrame, tests: DataFrame, window: int = 10, keep: tuple[str, ...] = ()) -> DataFrame:
    """``docs(doc_id, text)``, ``tests(item_id, text)`` -> columns of SCHEMA and ``keep``, a row for each row of docs.

    ``spans`` are the merged runs of words, as first and end, that lie in an
    occurrence of a test string; ``items`` the sorted item_ids (as strings)
    with one. Null and empty texts have no words and hold nothing; items
    without words, or an empty table of items, match nothing; an item without
    an item_id marks words but is not listed; repeated items count once. Columns
    of docs other than those of ``keep`` are ignored; ``keep`` may not hold
    names of the result. Items beyond PASS_BYTES are searched for in further
    passes, PASS_BYTES at a time.
    """
    columns.clash(["doc_id", "text", *RESULTS], keep)
    return columns.returned(_marked(docs, tests, window, keep), ["doc_id", "text", *RESULTS], keep)


def hits(marked: DataFrame) -> DataFrame:
    """The counts of a marked table: ``doc_id, n_words, n_hit, n_items, items_sha256, contaminated``."""
    n_hit = F.expr("aggregate(transform(spans, (x, i) -> if(i % 2 = 0, -x, x)), 0L, (a, x) -> a + x)")
    return marked.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort("items")), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def clean(docs: DataFrame, tests: DataFrame, window: int = 10) -> DataFrame:
    """The rows of ``docs`` that hold no test string, all columns as they are, whatever their names."""
    return columns.returned(_marked(docs, tests, window, docs.columns).where("size(spans) = 0"), [], docs.columns)
