"""Removal of passages that an earlier document holds, by fixed-block anchors.

Each document's words are cut into reference blocks of ``(window + 1) // 2``
words that do not overlap; any window of ``window`` words holds one of them
whole. Every rolling window of a block's length probes the blocks of all
documents; around the hits, the full windows are compared, and runs of windows
that an earlier document holds are the maximal exact repeats to remove.

Rows are dealt to cells by a hash, and all hashes travel as sorted, packed
arrays from cells to hash ranges and back: a window that many documents of a
cell share is one entry there, so a passage in a third of all rows costs one
entry for each cell and never brings its documents together. The texts are
shuffled once; the three passes over them reuse that shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from millrace.llm import columns
from millrace.llm.textnum import release_memory, window_hashes, word_batches

_U = np.uint64
#: Bytes of text in a cell, and probe windows in a hash range, on average.
CELL_BYTES, RANGE_WINDOWS = 4 << 20, 1 << 20
#: Equal rows of a cell at most (on average), and so many texts with more as are sent to all tasks; beyond that they are joined.
COPIES, SENT_COPIED = 2_000, 20_000
#: Bits of a block's hash that are compared; the windows themselves are compared by 64 bits.
PROBE_BITS = 40


def pack(values: np.ndarray) -> bytes:
    """Sorted unsigned values as byte planes of their differences (the planes of zeros cost nothing once compressed)."""
    d = np.diff(values.astype("<u8"), prepend=_U(0))
    return d.view(np.uint8).reshape(-1, 8).T.tobytes()


def unpack(blob: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(blob, np.uint8).reshape(8, -1).T).view("<u8").ravel(), dtype=_U)


def _planes(values: np.ndarray) -> bytes:
    return values.astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes()


def _unplanes(blob: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(blob, np.uint8).reshape(8, -1).T).view("<i8").ravel()


def _member(values: np.ndarray, ordered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which values are in the ordered array, and where."""
    if not len(ordered):
        return np.zeros(len(values), bool), np.zeros(len(values), np.int64)
    at = np.searchsorted(ordered, values)
    at[at == len(ordered)] = 0
    return ordered[at] == values, at


def _by_range(values: np.ndarray, shift: int) -> list[tuple[int, int, int]]:
    """(range, first, end) of the sorted values."""
    if not len(values):
        return []
    ranges = (values >> _U(shift)).astype(np.int64)
    cuts = np.concatenate(([0], np.flatnonzero(np.diff(ranges)) + 1, [len(values)]))
    return [(int(ranges[a]), int(a), int(b)) for a, b in zip(cuts[:-1], cuts[1:])]


def _documents(table: pa.Table, window: int):
    """(row, word hashes) of the rows that have a window."""
    for first, words, offsets in word_batches(table.column("text").to_pylist()):
        for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
            if b - a >= window:
                yield first + i, words[a:b]


def _probes(window: int, block: int, bits: int) -> Callable:
    """Cell -> for each hash range the hashes of its rolling block windows, marked if two rows hold them and if one has them as a block."""
    cut = _U(64 - PROBE_BITS)

    def run(key: tuple, table: pa.Table) -> pa.Table:
        release_memory()
        rolling, blocks = [], []
        for _, words in _documents(table, window):
            h = window_hashes(words, block) >> cut
            rolling.append(np.unique(h))
            blocks.append(h[::block])
        out: list = []
        if rolling:
            h, counts = np.unique(np.concatenate(rolling), return_counts=True)
            marked, _ = _member(h, np.unique(np.concatenate(blocks)))
            v = h << _U(2) | (counts > 1).astype(_U) << _U(1) | marked.astype(_U)
            out = [(r, key[0].as_py(), pack(v[a:b])) for r, a, b in _by_range(v, PROBE_BITS + 2 - bits)]
        return _table(out, ["part", "cell", "blob"])

    return run


def _table(rows: list[tuple], names: list[str]) -> pa.Table:
    kinds = {"blob": pa.binary(), "docs": pa.binary(), "many": pa.binary()}
    columns = list(zip(*rows)) if rows else [[] for _ in names]
    return pa.table({n: pa.array(c, kinds.get(n, pa.int64())) for n, c in zip(names, columns)})


def _groups(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorting order, starts of equal values, and the group of each value."""
    order = np.argsort(h, kind="stable")
    s = h[order]
    first = np.concatenate(([True], s[1:] != s[:-1]))
    group = np.empty(len(h), np.int64)
    group[order] = np.cumsum(first) - 1
    return order, np.flatnonzero(first), group


def _matched(key: tuple, table: pa.Table) -> pa.Table:
    """Hash range -> for each cell its hashes that are a block somewhere and occur in two documents at least."""
    release_memory()
    parts = [unpack(b) for b in table.column("blob").to_pylist()]
    v = np.concatenate(parts)
    order, starts, group = _groups(v >> _U(2))
    w = v[order]
    count = np.add.reduceat(1 + (w >> _U(1) & _U(1)).astype(np.int64), starts)
    block = np.maximum.reduceat((w & _U(1)).astype(np.int64), starts)
    hit = ((count > 1) & (block > 0))[group]
    out, at = [], 0
    for cell, p in zip(table.column("cell").to_pylist(), parts):
        if (mine := hit[at : at + len(p)]).any():
            out.append((cell, pack(p[mine] >> _U(2))))
        at += len(p)
    return _table(out, ["cell", "blob"])


def _candidates(window: int, block: int, bits: int) -> Callable:
    """Cell and its matched blocks -> for each hash range the full windows around them, with the smallest doc_id of the cell."""
    cut = _U(64 - PROBE_BITS)

    def run(key: tuple, table: pa.Table, matched: pa.Table) -> pa.Table:
        release_memory()
        blobs = [unpack(b) for b in matched.column("blob").to_pylist()]
        known = np.sort(np.concatenate(blobs)) if blobs else np.zeros(0, _U)
        doc_ids, hashes, docs = table.column("doc_id").to_pylist(), [], []
        for i, words in _documents(table, window) if len(known) else ():
            if doc_ids[i] is None:
                continue
            hit, _ = _member(window_hashes(words, block) >> cut, known)
            sums = np.concatenate(([0], np.cumsum(hit)))
            reach = window - block + 1
            near = sums[reach:] > sums[:-reach]
            if near.any():
                h = np.unique(window_hashes(words, window)[near])
                hashes.append(h)
                docs.append(np.full(len(h), doc_ids[i], np.int64))
        out: list = []
        if hashes:
            h, d = np.concatenate(hashes), np.concatenate(docs)
            order, starts, _ = _groups(h)
            d = d[order]
            least = np.minimum.reduceat(d, starts)
            many = (least != np.maximum.reduceat(d, starts)).astype(np.uint8)
            h = h[order][starts]
            out = [(r, key[0].as_py(), pack(h[a:b]), _planes(least[a:b]), many[a:b].tobytes()) for r, a, b in _by_range(h, 64 - bits)]
        return _table(out, ["part", "cell", "blob", "docs", "many"])

    return run


def _earliest(key: tuple, table: pa.Table) -> pa.Table:
    """Hash range -> for each cell its windows that two documents hold, with the smallest doc_id of all."""
    release_memory()
    parts = [unpack(b) for b in table.column("blob").to_pylist()]
    h, d = np.concatenate(parts), np.concatenate([_unplanes(b) for b in table.column("docs").to_pylist()])
    many = np.frombuffer(b"".join(table.column("many").to_pylist()), np.uint8)
    order, starts, group = _groups(h)
    least, most = np.minimum.reduceat(d[order], starts), np.maximum.reduceat(d[order], starts)
    hit = ((np.maximum.reduceat(many[order], starts) > 0) | (least != most))[group]
    least = least[group]
    out, at = [], 0
    for cell, p in zip(table.column("cell").to_pylist(), parts):
        mine = slice(at, at + len(p))
        if (m := hit[mine]).any():
            out.append((cell, pack(p[m]), _planes(least[mine][m])))
        at += len(p)
    return _table(out, ["cell", "blob", "docs"])


def covered(starts: np.ndarray, n: int, window: int) -> np.ndarray:
    """Which of n words lie in a window that begins at one of the marked positions."""
    change = np.zeros(n + 1, np.int64)
    at = np.flatnonzero(starts)
    np.add.at(change, at, 1)
    np.add.at(change, at + window, -1)
    return np.cumsum(change[:-1]) > 0


def _removed(window: int, keep: Sequence[str], joined: bool) -> Callable:
    def run(key: tuple, table: pa.Table, found: pa.Table) -> pa.Table:
        release_memory()
        blobs = [unpack(b) for b in found.column("blob").to_pylist()]
        known = np.concatenate(blobs) if blobs else np.zeros(0, _U)
        least = np.concatenate([_unplanes(b) for b in found.column("docs").to_pylist()]) if blobs else np.zeros(0, np.int64)
        order = np.argsort(known)
        known, least = known[order], least[order]
        doc_ids, texts = table.column("doc_id").to_pylist(), table.column("text").to_pylist()
        gone: dict[int, np.ndarray] = {}
        for i, words in _documents(table, window) if len(known) else ():
            if doc_ids[i] is not None:
                hit, at = _member(window_hashes(words, window), known)
                hit &= least[at] < doc_ids[i]
                if hit.any():
                    gone[i] = covered(hit, len(words), window)
        n_words, n_removed, kept = [], [], []
        for i, text in enumerate(texts):
            raw = b"" if text is None else text.encode("utf-8", "surrogatepass")
            words = raw.split()
            n_words.append(len(words))
            if i in gone:
                words = [w for w, g in zip(words, gone[i].tolist()) if not g]
            n_removed.append(n_words[-1] - len(words))
            kept.append(b" ".join(words) if joined or i in gone else None if text is None else raw)
        columns = {"doc_id": table.column("doc_id"), "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "kept_text": pa.array(kept, pa.binary()).cast(pa.string())}
        return pa.table(columns | {c: table.column(c) for c in keep})

    return run


RESULTS = ["doc_id", "n_words", "n_removed", "kept_text"]


def _dealt(rows: DataFrame, cells: int) -> DataFrame:
    """Rows with their ``cell``: a hash of doc_id and text; of more than COPIES equal rows, each COPIES have one of their own.

    Which of the equal rows go to which cell makes no difference: equal rows
    with one doc_id do not count as earlier than each other, and each of their
    cells holds what the others do.
    """
    name = F.xxhash64("doc_id", "text")
    copied = rows.groupBy(name.alias("name")).agg(F.count("*").alias("copies")).where(F.col("copies") > COPIES)
    known = copied.limit(SENT_COPIED + 1).collect()
    if not known:
        return rows.withColumn("cell", F.pmod(name, F.lit(cells)))
    table = F.broadcast(rows.sparkSession.createDataFrame(known, copied.schema)) if len(known) <= SENT_COPIED else copied
    part = F.pmod(F.monotonically_increasing_id(), F.ceil(F.coalesce("copies", F.lit(1)) / COPIES))
    named = rows.withColumn("name", name).join(table, "name", "left")
    return named.withColumn("cell", F.pmod(F.when(part > 0, F.xxhash64("name", part)).otherwise(F.col("name")), F.lit(cells))).drop("name", "copies")


def _kept(docs: DataFrame, window: int, names: Sequence[str], joined: bool) -> DataFrame:
    """RESULTS, and ``names`` as k_0, k_1 ..."""
    spark = docs.sparkSession
    rows, fields = columns.carried(docs, names)
    block = (window + 1) // 2
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    cells = max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // CELL_BYTES))
    bits = max(6, (size // 6 // RANGE_WINDOWS).bit_length())
    base = _dealt(rows, cells)

    probes = base.groupBy("cell").applyInArrow(_probes(window, block, bits), "part long, cell long, blob binary")
    matched = probes.groupBy("part").applyInArrow(_matched, "cell long, blob binary")
    windows = base.groupBy("cell").cogroup(matched.groupBy("cell")).applyInArrow(_candidates(window, block, bits), "part long, cell long, blob binary, docs binary, many binary")
    found = windows.groupBy("part").applyInArrow(_earliest, "cell long, blob binary, docs binary")
    schema = columns.schema("doc_id long, n_words long, n_removed long, kept_text string", fields)
    return base.groupBy("cell").cogroup(found.groupBy("cell")).applyInArrow(_removed(window, [f.name for f in fields], joined), schema)


def remove_repeats(docs: DataFrame, window: int = 50, keep: tuple[str, ...] = (), joined: bool = True) -> DataFrame:
    """``docs(doc_id, text)`` -> ``(doc_id, n_words, n_removed, kept_text, *keep)``, one row for each row.

    Words are ``[^\\x20\\x09-\\x0D]+``, unchanged. A word goes when it lies in a
    run of ``window`` words that also begins in a document with a smaller
    doc_id; windows are judged on the input. ``kept_text`` joins the other
    words by one space (without ``joined``, the text of a row that loses
    nothing stays as it is). Null texts have no words; rows with a null doc_id lose
    nothing and make no others lose; rows with the same doc_id do not count as
    earlier than each other; an empty table gives no rows. Columns other than
    those of ``keep`` are ignored; ``keep`` may not hold names of the result.
    """
    columns.clash(RESULTS, keep)
    return columns.returned(_kept(docs, window, keep, joined), RESULTS, keep)


def without_repeats(docs: DataFrame, window: int = 50) -> DataFrame:
    """``docs`` with the texts that are left, and ``n_chars`` (if there is such a column) their characters.

    Rows of which nothing is left go; the other columns stay, whatever their names.
    """
    names = docs.columns
    at = {c: f"k_{i}" for i, c in enumerate(names)}
    kept = _kept(docs, window, names, False).where("n_removed = 0 or n_removed < n_words").withColumn(at["text"], F.col("kept_text"))
    if "n_chars" in at:
        kept = kept.withColumn(at["n_chars"], F.length("kept_text").cast("long"))
    return columns.returned(kept, [], names)
