"""Lists of the chunks that hold a key: three characters in a row of a text, or a value at a path of a JSON document.

A needle, or a JSON containment, needs the chunks that hold all of its keys;
the lists of its rarest keys are intersected, and what they leave is verified.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator, Sequence
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Texts whose lists are joined before they are written.
RUN_TEXTS = 512
#: Lists of a needle that are intersected, rarest first.
RAREST = 4
#: What the name of a field of JSON documents ends in, as the index writes it.
JSON = "@json"


def trigrams(text: str) -> np.ndarray:
    """The distinct trigrams of a text in order, 21 bits a character; none below three characters."""
    a = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    return np.unique(a[:-2] << 42 | a[1:-1] << 21 | a[2:])


def _leaves(value: Any, path: tuple[str, ...] = ()) -> Iterator[tuple[tuple[str, ...], str]]:
    """(path, value) of the scalars of a JSON value; a place in an array is no part of a path, and numbers are equal by value."""
    if isinstance(value, dict):
        for k, v in value.items():
            yield from _leaves(v, (*path, k))
    elif isinstance(value, list):
        for v in value:
            yield from _leaves(v, (*path, "[]"))
    elif isinstance(value, (int, float)) and not isinstance(value, bool):
        yield path, repr(float(value))
    else:
        yield path, json.dumps(value)


def path_values(document: Any) -> np.ndarray:
    """The distinct hashes of the scalars of a JSON value with their paths, 63 bits each."""
    found = {int.from_bytes(hashlib.blake2b(repr(leaf).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little") >> 1 for leaf in _leaves(document)}
    return np.array(sorted(found), np.int64)


def _of_json(text: str) -> np.ndarray:
    try:
        return path_values(json.loads(text)) if text else np.zeros(0, np.int64)
    except ValueError:
        return np.zeros(0, np.int64)


def key_lists(chunks: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(field, gram, n, chunks)``: for runs of texts, the chunks that hold each key of a column; nulls hold none.

    Keys are the trigrams of the lower-cased text, or, for a column named with
    ``@json`` behind it, the values at the paths of the JSON document in it
    (one that cannot be read holds none).
    """
    kind = chunks.schema["chunk_id"].dataType.simpleString()
    rows = chunks.select("chunk_id", *(F.col(c.removesuffix(JSON)).alias(c) if c.endswith(JSON) else F.lower(c).alias(c) for c in columns))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, RUN_TEXTS):
                part = batch.slice(first, RUN_TEXTS)
                for k, field in enumerate(columns):
                    keys = _of_json if field.endswith(JSON) else trigrams
                    found = [keys(t or "") for t in part.column(k + 1).to_pylist()]
                    grams = np.concatenate(found)
                    order = np.argsort(grams, kind="stable")
                    owner = np.repeat(np.arange(len(found)), [len(f) for f in found])[order]
                    grams = grams[order]
                    starts = np.flatnonzero(np.concatenate((np.ones(min(1, len(grams)), bool), grams[1:] != grams[:-1])))
                    offsets = np.append(starts, len(grams)).astype(np.int32)
                    lists = pa.ListArray.from_arrays(pa.array(offsets), part.column(0).take(pa.array(owner)))
                    yield pa.RecordBatch.from_arrays([pa.array([field] * len(starts), pa.string()), pa.array(grams[starts]), pa.array(np.diff(offsets)), lists], ["field", "gram", "n", "chunks"])

    return rows.mapInArrow(run, f"field string, gram long, n int, chunks array<{kind}>")


def holders(lists: DataFrame, field: str, wanted: Sequence[int], buckets: int) -> DataFrame:
    """``(chunk_id, number)`` of the chunks that hold the rarest of the wanted keys of a field (there is one at least).

    Every chunk that holds them all is among them. ``lists`` are those of an
    index's segments, with the ``number`` of the segment.
    """
    mine = lists.where((F.col("field") == field) & F.col("bucket").isin(sorted({g % buckets for g in wanted})) & F.col("gram").isin(list(wanted)))
    sizes = {r["gram"]: r["n"] for r in mine.groupBy("gram").agg(F.sum("n").alias("n")).collect()}  # a request's keys
    rarest = sorted(wanted, key=lambda g: (sizes.get(g, 0), g))[:RAREST]
    entries = mine.where(F.col("gram").isin(rarest)).select("number", F.explode("chunks").alias("chunk_id"))
    return entries.groupBy("chunk_id", "number").agg(F.count("*").alias("n")).where(F.col("n") == len(rarest)).select("chunk_id", "number")
