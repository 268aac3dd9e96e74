"""Hierarchical multi-length packing of token ids into training sequences.

A document's whole windows of the longest context are sequences of their own;
what remains is routed to the shortest context size (tier) that holds it. Tiers
are packed from the longest to the shortest: a piece opens a window of its
tier, the gap is filled by whole pieces, longest fitting first, and closed by a
cut through one more, the shortest that is long enough. Pieces of the window's
own tier are cut too where shorter ones run out, so a window stays open only
when no piece is left at all, and a round of packing carries less than one
sequence over. Sequences of a tier are dealt to step groups of
equal tokens so that their attention costs are balanced.

Packing runs on each partition by itself and needs no shuffle; it holds at most
POOL_TOKENS ids at a time (and one document), and at most one sequence of a
partition is not full.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from millrace.llm.textnum import release_memory
from millrace.llm.tokens import encoder

#: Ids held before a round of packing.
POOL_TOKENS = 4_000_000

SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, tier int, step_group long"


class _Piece:
    __slots__ = ("doc_id", "start", "ids", "doc_tokens")

    def __init__(self, doc_id, start: int, ids: bytes, doc_tokens: int):
        self.doc_id, self.start, self.ids, self.doc_tokens = doc_id, start, ids, doc_tokens

    def __len__(self) -> int:
        return len(self.ids) // 4

    def cut(self, n: int) -> tuple[_Piece, _Piece]:
        return _Piece(self.doc_id, self.start, self.ids[: 4 * n], self.doc_tokens), _Piece(self.doc_id, self.start + n, self.ids[4 * n :], self.doc_tokens)


class _Shelf:
    """Pieces by length; the longest that fits and the shortest that does not are found by bits of one integer."""

    def __init__(self):
        self.by: dict[int, list[_Piece]] = {}
        self.bits = 0

    def put(self, p: _Piece) -> None:
        self.by.setdefault(len(p), []).append(p)
        self.bits |= 1 << len(p)

    def take(self, n: int) -> _Piece:
        p = self.by[n].pop()
        if not self.by[n]:
            self.bits ^= 1 << n
        return p

    def fitting(self, gap: int) -> int:
        return (self.bits & ((2 << gap) - 1)).bit_length() - 1

    def beyond(self, gap: int, most: int) -> int:
        found = (self.bits & ((2 << most) - 1)) >> (gap + 1)
        return gap + 1 + (found & -found).bit_length() - 1 if found else -1


def pack_pieces(pieces: list[_Piece], tiers: tuple[int, ...], last: bool) -> tuple[list[tuple[int, list[_Piece]]], list[_Piece]]:
    """(tier, pieces) of each sequence, and the pieces left for the next round: fewer ids than a sequence, none in the last."""
    out: list[tuple[int, list[_Piece]]] = []
    shelf = _Shelf()
    for p in pieces:
        while len(p) >= tiers[0]:
            head, p = p.cut(tiers[0])
            out.append((tiers[0], [head]))
        if len(p):
            shelf.put(p)
    left: list[_Piece] = []
    for tier, shorter in zip(tiers, [*tiers[1:], 0]):  # a window stays open only once the shelf is empty
        while (n := shelf.fitting(tier)) > shorter:
            window = [shelf.take(n)]
            gap = tier - n
            while gap and (n := shelf.fitting(gap)) > 0:
                window.append(shelf.take(n))
                gap -= n
            if gap and (n := shelf.beyond(gap, tier)) > 0:
                head, rest = shelf.take(n).cut(gap)
                window.append(head)
                shelf.put(rest)
                gap = 0
            if gap:
                left += window
            else:
                out.append((tier, window))
    if not last:
        return out, left
    todo = left[::-1]
    total = sum(map(len, todo))
    while total:
        tier = next((t for t in tiers if t <= total), tiers[0])
        gap, window = min(tier, total), []
        total -= gap
        while gap:
            p = todo.pop()
            if len(p) > gap:
                p, rest = p.cut(gap)
                todo.append(rest)
            window.append(p)
            gap -= len(p)
        out.append((tier, window))
    return out, []


def step_groups(sequences: list[tuple[int, list[_Piece]]], tokens: int) -> list[int]:
    """For each sequence its step group: groups of one tier, of ``tokens`` ids, dealt in turns by falling attention cost."""
    groups, first = [0] * len(sequences), 0
    for tier in sorted({t for t, _ in sequences}, reverse=True):
        own = [i for i, (t, _) in enumerate(sequences) if t == tier]
        cost = {i: sum(len(p) ** 2 for p in sequences[i][1]) for i in own}
        n = -(-len(own) * tier // tokens)
        for k, i in enumerate(sorted(own, key=lambda i: (-cost[i], i))):
            turn, place = divmod(k, n)
            groups[i] = first + (n - 1 - place if turn % 2 else place)
        first += n
    return groups


def pack(docs: DataFrame, tokenizer: str, end_id: int = 0, tiers: tuple[int, ...] = (1024, 512, 256, 128), step_tokens: int = 16_384) -> DataFrame:
    """``docs(doc_id, text)`` -> a row for each piece of a sequence (columns of SCHEMA).

    ``tokenizer`` is the path of a tokenizers file; each document is its ids and
    ``end_id``. ``tiers`` are falling powers of two. Every id is in exactly one
    piece; ``start`` counts the ids of the document before the piece, ``offset``
    those of the sequence. A sequence is full except the last of a partition.
    Null and empty texts are the end id alone; null and repeated doc_ids are
    packed like others; an empty table gives no rows; other columns are ignored.
    """
    if any(t & (t - 1) or t <= s for t, s in zip(tiers, [*tiers[1:], 0])):
        raise ValueError(f"tiers must be falling powers of two: {tiers}")
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 40
        done_sequences = done_groups = held = 0
        pool: list[_Piece] = []

        def packed(last: bool) -> pa.RecordBatch:
            nonlocal pool, held, done_sequences, done_groups
            sequences, pool = pack_pieces(pool, tiers, last)
            held = sum(map(len, pool))
            groups, rows = step_groups(sequences, step_tokens), []
            for k, (tier, window) in enumerate(sequences):
                offset = 0
                for p in window:
                    rows.append((p.doc_id, p.start, len(p), p.ids, p.doc_tokens, first + done_sequences + k, offset, tier, first + done_groups + groups[k]))
                    offset += len(p)
            done_sequences += len(sequences)
            done_groups += 1 + max(groups, default=-1)
            columns = list(zip(*rows)) if rows else [()] * 9
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], [c.split()[0] for c in SCHEMA.split(", ")])

        model = encoder(tokenizer)
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = model.ids(text) + end
                pool.append(_Piece(doc_id, 0, ids, len(ids) // 4))
                held += len(pool[-1])
                if held >= POOL_TOKENS:
                    yield packed(False)
        yield packed(True)
        release_memory(drop=False)

    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").sortWithinPartitions("doc_id", "text")
    return ordered.mapInArrow(run, SCHEMA)
