"""Fill-in-the-middle texts by rotations of blocks inside one byte buffer.

A text is cut into prefix, middle and suffix. The sentinels go into a copy of
its bytes where the cuts are, which gives ``<P>prefix<M>middle<S>suffix``; two
neighbouring blocks are then exchanged in place by three reversals (each block,
then both together). The same rotation with the blocks' sizes exchanged takes
the output back, and without its sentinels it is the text again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from millrace.llm import columns
from millrace.llm.textnum import release_memory

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
#: Shares of a hundred: texts that stay plain, and cut texts whose suffix comes first.
PLAIN_PERCENT, SPM_PERCENT = 10, 20
_LETTER = np.array([65 <= b <= 90 or 97 <= b <= 122 for b in range(256)])
_INSIDE = np.array([0x80 <= b < 0xC0 for b in range(256)])


def unit_starts(raw: np.ndarray) -> np.ndarray:
    """First byte of each unit: a run of ASCII letters, or any other character."""
    letter = _LETTER[raw]
    start = ~(letter | _INSIDE[raw])
    start[:1] |= letter[:1]
    start[1:] |= letter[1:] & ~letter[:-1]
    return np.flatnonzero(start)


def draws(doc_id: int | None, seed: int = 1) -> tuple[int, int, int, int]:
    """Four numbers below 2**32 that the seed and the document's id decide."""
    digits = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    a, b, c, d = (int(digits[i : i + 8], 16) for i in (0, 8, 16, 24))
    return a, b, c, d


def rotate(buffer: np.ndarray, first: int, cut: int, last: int) -> None:
    """Exchange buffer[first:cut] and buffer[cut:last] in place by three reversals."""
    for a, b in ((first, cut), (cut, last), (first, last)):
        buffer[a:b] = buffer[a:b][::-1]


def transform(raw: bytes, doc_id: int | None, seed: int = 1) -> tuple[int, str, int | None, int | None, bytearray]:
    """(units, form, characters of the prefix, characters of the middle, output) of one text in UTF-8."""
    text = np.frombuffer(raw, np.uint8)
    starts = unit_starts(text)
    n = len(starts)
    h1, h2, h3, h4 = draws(doc_id, seed)
    if not raw or any(s in raw for s in (PREFIX, SUFFIX, MIDDLE)) or h3 % 100 >= 100 - PLAIN_PERCENT:
        return n, "plain", None, None, bytearray(raw)
    edges = np.append(starts, len(raw))
    a, b = (int(edges[k]) for k in sorted((h1 % (n + 1), h2 % (n + 1))))
    out = bytearray(raw)
    out[b:b] = SUFFIX
    out[a:a] = MIDDLE
    out[0:0] = PREFIX
    middle, suffix = len(PREFIX) + a, len(PREFIX) + len(MIDDLE) + b
    spm = h4 % 100 < SPM_PERCENT
    rotate(np.frombuffer(out, np.uint8), 0 if spm else middle, suffix, len(out))
    whole = ~_INSIDE[text]
    return n, "spm" if spm else "psm", int(whole[:a].sum()), int(whole[a:b].sum()), out


def restore(output: bytes, form: str) -> bytes:
    """The text of an output, from it and its form alone; ValueError if the form's sentinels are not in place."""
    if form == "plain":
        return bytes(output)
    if form not in ("psm", "spm"):
        raise ValueError(f"unknown form {form}")
    buffer = bytearray(output)
    ahead, behind = (PREFIX, SUFFIX) if form == "psm" else (SUFFIX, PREFIX)
    at, middle = buffer.find(behind), buffer.find(MIDDLE)
    if not buffer.startswith(ahead) or at < 0 or middle < at:
        raise ValueError(f"sentinels of {form} are not in place")
    # the block that the rotation brought to the front goes back behind the other one
    first, cut = (at, middle) if form == "psm" else (0, at)
    moved = cut - first
    rotate(np.frombuffer(buffer, np.uint8), first, cut, len(buffer))
    suffix = len(buffer) - moved
    del buffer[suffix : suffix + len(SUFFIX)]
    middle = buffer.find(MIDDLE)
    del buffer[middle : middle + len(MIDDLE)]
    del buffer[: len(PREFIX)]
    return bytes(buffer)


def transformed(docs: DataFrame, seed: int = 1, keep: Sequence[str] = ()) -> DataFrame:
    """``docs(doc_id, text)`` -> ``(doc_id, n, form, prefix_chars, middle_chars, output, *keep)``.

    ``form`` is plain for empty texts, texts that hold a sentinel, and
    PLAIN_PERCENT of the rest; else spm for SPM_PERCENT, or psm. A null text
    counts as empty, a null doc_id as no digits; the counts of characters are
    null for plain; repeated rows stay and give equal outputs; ``keep`` may not
    hold a result's name. One pass over the input, without a shuffle.
    """
    results = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    columns.clash(results, keep)
    rows, fields = columns.carried(docs, keep)
    kept = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 1024):
                part = batch.slice(first, 1024)
                found = [transform((t or "").encode(), d, seed) for d, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist())]
                n, form, before, inside, out = map(list, zip(*found))
                arrays = [pa.array(n, pa.int64()), pa.array(form), pa.array(before, pa.int64()), pa.array(inside, pa.int64()), pa.array(map(bytes, out), pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays([part.column(0), *arrays, *part.columns[2:]], [*results, *kept])
        release_memory()

    out = rows.mapInArrow(run, columns.schema("doc_id long, n long, form string, prefix_chars long, middle_chars long, output string", fields))
    return columns.returned(out, results, keep)


def restored(outputs: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """``outputs`` with ``output`` and ``form`` -> ``(text, *keep)``, the exact texts; a null output gives the empty text."""
    columns.clash(["text"], keep)
    at = {c: f"c_{i}" for i, c in enumerate(outputs.columns)}
    plain = outputs.toDF(*at.values())
    rows = plain.select(F.col(at["output"]).alias("output"), F.col(at["form"]).alias("form"), *(F.col(at[c]).alias(f"k_{i}") for i, c in enumerate(keep)))
    kept = rows.columns[2:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 1024):
                part = batch.slice(first, 1024)
                texts = [restore((o or "").encode(), f).decode() for o, f in zip(part.column(0).to_pylist(), part.column(1).to_pylist())]
                yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), *part.columns[2:]], ["text", *kept])
        release_memory()

    out = rows.mapInArrow(run, columns.schema("text string", rows.schema.fields[2:]))
    return columns.returned(out, ["text"], keep)
