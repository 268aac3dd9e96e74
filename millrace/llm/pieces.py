"""SentencePiece BPE over whole texts: vectorised merge rounds, and decoding from ids.

The words that a process has not met yet are laid out as one flat array of
symbols. In each round every word merges its leftmost pair of the smallest
rank, all words at once: the segmented minimum of (rank, place) finds the pairs,
merged symbols take their first place, the second one is dropped, and words
without a pair leave the arrays. One merge a word and round is the order in
which the library's agenda works, so the ids are the library's, ties included.

A word ends where no piece holds the two characters side by side, as no merge
can cross such a place. One of more than LONG_WORD characters would take as many
rounds as it has merges; its merges are taken from a heap, in the same order.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterable, Iterator, Sequence
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from millrace.llm import columns
from millrace.llm.textnum import on_release, release_memory

SPACE = "▁"
#: Characters of a word beyond which a heap takes the place of rounds.
LONG_WORD = 512
#: Characters and words of a run of texts whose new words are merged together.
RUN_CHARS, RUN_WORDS = 1 << 18, 1 << 16
#: Bytes that a process keeps of words and their ids (with ENTRY for the dictionary's share); words beyond KEPT characters are not kept.
TABLE_BYTES, ENTRY, KEPT = 96 << 20, 170, 48
_NONE = np.int64(1) << 62
_CHAR = 1 << 21
# Kinds of pieces in a model file.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


class Model:
    """A BPE model file: pieces, ranks of the pairs that make them, and surfaces of ids.

    Taken are models with byte fallback that change nothing in a text but
    spaces; others raise ValueError.
    """

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        norm, train = proto.normalizer_spec, proto.trainer_spec
        kinds = [p.type for p in proto.pieces]
        if (
            train.model_type != train.BPE
            or train.treat_whitespace_as_suffix
            or not train.byte_fallback
            or norm.precompiled_charsmap
            or proto.denormalizer_spec.precompiled_charsmap
            or norm.remove_extra_whitespaces
            or not norm.escape_whitespaces
            or {USER_DEFINED, UNUSED} & set(kinds)
            or kinds.count(BYTE) != 256
        ):
            raise ValueError(f"{path}: not a BPE model with byte fallback, without a normalizer and user-defined pieces")
        self.bos, self.eos, self.prefix = train.bos_id, train.eos_id, norm.add_dummy_prefix
        self.size = len(proto.pieces)
        normal = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == NORMAL}
        byte_ids = {int(p.piece[3:-1], 16): i for i, p in enumerate(proto.pieces) if p.type == BYTE}
        self.byte_ids = np.array([byte_ids[b] for b in range(256)], "<u4")

        # symbols: the ids of pieces; characters that are none, behind them
        self.symbol_of = np.arange(self.size, self.size + 0x110000, dtype=np.int64)
        for piece, i in normal.items():
            if len(piece) == 1:
                self.symbol_of[ord(piece)] = i

        def symbol(part: str) -> int | None:
            return int(self.symbol_of[ord(part)]) if len(part) == 1 else normal.get(part)

        best = {s: r for r, s in enumerate(sorted({proto.pieces[i].score for i in normal.values()}, reverse=True))}
        pairs, inside = [], set()
        for piece, i in normal.items():
            inside.update(zip(piece, piece[1:]))
            for k in range(1, len(piece)):
                a, b = symbol(piece[:k]), symbol(piece[k:])
                if a is not None and b is not None:
                    pairs.append((a * _CHAR + b, best[proto.pieces[i].score], i))
        pairs.sort()
        self.pair_keys = np.array([p[0] for p in pairs], np.int64)
        self.pair_ranks = np.array([p[1] for p in pairs] + [_NONE], np.int64)
        self.pair_made = np.array([p[2] for p in pairs] + [-1], np.int64)
        self.inside = np.sort(np.array([ord(a) * _CHAR + ord(b) for a, b in inside] or [0], np.int64))

        together = {c for pair in inside for c in pair}
        alone = "".join(c for c in map(chr, range(128)) if c not in together)
        if any(b == SPACE != a for a, b in inside):
            self.words = re.compile("(?s).+")  # pieces go on behind a space: texts are not split beforehand
        else:
            self.words = re.compile(f"{SPACE}*[^{SPACE}{re.escape(alone)}]+|{SPACE}+" + (f"|[{re.escape(alone)}]" if alone else ""))

        surfaces = []
        for p in proto.pieces:
            if p.type == BYTE:
                surfaces.append(bytes([int(p.piece[3:-1], 16)]))
            else:
                surfaces.append({CONTROL: "", UNKNOWN: train.unk_surface}.get(p.type, p.piece.replace(SPACE, " ")).encode())
        self.surfaces = np.frombuffer(b"".join(surfaces), np.uint8)
        self.surface_sizes = np.array([len(s) for s in surfaces], np.int64)
        self.surface_starts = np.cumsum(self.surface_sizes) - self.surface_sizes
        self.is_byte = np.array([k == BYTE for k in kinds])
        self.is_control = np.array([k == CONTROL for k in kinds])
        self.opens = np.array([p.type == NORMAL and p.piece.startswith(SPACE) for p in proto.pieces])
        self._made: dict[int, tuple[int, int]] = {}
        self.kept: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.held = 0

    # ---- encoding

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of each pair (_NONE if no piece comes of it) and the piece."""
        key = left * _CHAR + right
        at = np.searchsorted(self.pair_keys, key)
        at[at == len(self.pair_keys)] = 0
        at[self.pair_keys[at] != key] = len(self.pair_keys)
        return self.pair_ranks[at], self.pair_made[at]

    def _from_heap(self, symbols: list[int]) -> list[tuple[int, int]]:
        """(place, symbol) after all merges of one word, by a heap of (rank, place)."""
        if not self._made:
            self._made = dict(zip(self.pair_keys.tolist(), zip(self.pair_ranks.tolist(), self.pair_made.tolist())))
        n = len(symbols)
        behind, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap: list[tuple[int, int, int, int, int]] = []

        def offer(i: int, j: int) -> None:
            found = self._made.get(symbols[i] * _CHAR + symbols[j])
            if found:
                heapq.heappush(heap, (found[0], i, symbols[i], symbols[j], found[1]))

        for i in range(n - 1):
            offer(i, i + 1)
        while heap:
            _, i, a, b, made = heapq.heappop(heap)
            j = behind[i]
            if symbols[i] != a or j >= n or symbols[j] != b:
                continue
            symbols[i], symbols[j] = made, -1
            behind[i] = behind[j]
            if behind[i] < n:
                before[behind[i]] = i
                offer(i, behind[i])
            if before[i] >= 0:
                offer(before[i], i)
        return [(i, s) for i, s in enumerate(symbols) if s >= 0]

    def merged(self, words: Sequence[str]) -> list[bytes]:
        """Ids of each word (little-endian unsigned 32-bit integers) by rounds over all of them."""
        if not words:
            return []
        points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        ends = np.cumsum([len(w) for w in words])
        symbols = self.symbol_of[points]
        # a new segment at a word's start and between characters that no piece holds side by side
        starts = np.ones(len(points), bool)
        pair = points[:-1] * _CHAR + points[1:]
        at = np.searchsorted(self.inside, pair)
        at[at == len(self.inside)] = 0
        starts[1:] = self.inside[at] != pair
        starts[ends[:-1]] = True
        out = symbols.copy()  # by the place of a symbol's first character; -1 where none begins any more
        first = np.flatnonzero(starts)
        lengths = np.diff(np.append(first, len(points)))
        for i in np.flatnonzero(lengths > LONG_WORD).tolist():
            a, b = int(first[i]), int(first[i] + lengths[i])
            out[a:b] = -1
            for k, s in self._from_heap(symbols[a:b].tolist()):
                out[a + k] = s
        active = np.repeat((lengths > 1) & (lengths <= LONG_WORD), lengths)
        place = np.flatnonzero(active)
        segment = (np.cumsum(starts) - 1)[place]
        symbols = symbols[place]
        rank, made = self._pair_ranks(symbols, segment)
        while len(place):
            # the leftmost pair of the smallest rank of each segment
            begin = np.flatnonzero(np.concatenate(([True], segment[1:] != segment[:-1])))
            size = np.diff(np.append(begin, len(place)))
            least = np.minimum.reduceat(rank, begin)
            live = least < _NONE
            hit = np.flatnonzero(rank == np.repeat(np.where(live, least, -1), size))
            hit = hit[np.concatenate(([True], segment[hit[1:]] != segment[hit[:-1]]))] if len(hit) else hit
            # merge them; places[hit + 1] go
            symbols[hit] = made[hit]
            out[place[hit]] = symbols[hit]
            out[place[hit + 1]] = -1
            keep = np.repeat(live, size)
            keep[hit + 1] = False
            new = np.cumsum(keep) - 1
            hit = new[hit]
            symbols, segment, place, rank, made = symbols[keep], segment[keep], place[keep], rank[keep], made[keep]
            # only the pairs around a merged symbol are new
            changed = np.concatenate((hit, hit[hit > 0] - 1))
            self._renew(changed, symbols, segment, rank, made)
        return self._bytes_of(out, points, ends)

    def _pair_ranks(self, symbols: np.ndarray, segment: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rank, made = np.full(len(symbols), _NONE), np.full(len(symbols), -1, np.int64)
        self._renew(np.arange(len(symbols)), symbols, segment, rank, made)
        return rank, made

    def _renew(self, at: np.ndarray, symbols: np.ndarray, segment: np.ndarray, rank: np.ndarray, made: np.ndarray) -> None:
        rank[at] = _NONE
        at = at[at + 1 < len(symbols)]
        at = at[segment[at] == segment[at + 1]]
        rank[at], made[at] = self._ranks(symbols[at], symbols[at + 1])

    def _bytes_of(self, out: np.ndarray, points: np.ndarray, ends: np.ndarray) -> list[bytes]:
        """The ids between the words' ends; characters that are no piece as the ids of their bytes."""
        left = out >= 0
        bounds = np.concatenate(([0], np.cumsum(left)[ends - 1])).tolist()
        ids = out[left]
        if not len(ids) or ids.max() < self.size:
            flat = ids.astype("<u4")
            return [flat[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:])]
        as_bytes = {s: self.byte_ids[list(chr(s - self.size).encode("utf-8", "surrogatepass"))].tobytes() for s in np.unique(ids[ids >= self.size]).tolist()}
        flat, unknown = ids.astype("<u4"), np.flatnonzero(ids >= self.size)
        found = []
        for a, b in zip(bounds[:-1], bounds[1:]):
            i, j = np.searchsorted(unknown, (a, b))
            parts, last = [], a
            for k in unknown[i:j].tolist():
                parts += flat[last:k].tobytes(), as_bytes[int(ids[k])]
                last = k + 1
            found.append(b"".join((*parts, flat[last:b].tobytes())))
        return found

    def forget(self) -> None:
        """Keep no words."""
        self.kept, self.older, self.held = {}, {}, 0

    def _known(self, words: Iterable[str]) -> dict[str, bytes]:
        """Ids of the distinct words, those not met before merged together."""
        found, new = {}, []
        for w in dict.fromkeys(words):
            ids = self.kept.get(w)
            if ids is None and (ids := self.older.get(w)) is not None:
                self._keep(w, ids)
            if ids is None:
                new.append(w)
            else:
                found[w] = ids
        at, used = 0, 0
        for i, w in enumerate(new):
            used += len(w)
            if used >= RUN_CHARS or i + 1 == len(new):
                for word, ids in zip(new[at : i + 1], self.merged(new[at : i + 1])):
                    found[word] = ids
                    self._keep(word, ids)
                at, used = i + 1, 0
        return found

    def _keep(self, word: str, ids: bytes) -> None:
        if len(word) <= KEPT:
            self.kept[word] = ids
            self.held += ENTRY + 2 * len(word) + len(ids)
            if self.held > TABLE_BYTES // 2:  # words not met lately go, which changes no result
                self.older, self.kept, self.held = self.kept, {}, 0

    def encode(self, texts: Sequence[str | None], bos: bool = True, eos: bool = True) -> Iterator[bytes]:
        """Ids of each whole text, begin and end ids around them if asked; a null counts as empty."""
        head, tail = (np.array([i], "<u4").tobytes() if on else b"" for i, on in ((self.bos, bos), (self.eos, eos)))
        at = 0
        while at < len(texts):
            run, used = [], 0
            while at < len(texts) and (not run or used + len(texts[at] or "") <= RUN_CHARS):
                run.append(self._spaced(texts[at]))
                used += len(run[-1])
                at += 1
            if used <= 2 * RUN_CHARS:
                words = [self.words.findall(t) for t in run]
                known = self._known(w for ws in words for w in ws)
                for ws in words:
                    yield b"".join((head, *map(known.__getitem__, ws), tail))
            else:  # one long text, RUN_WORDS words at a time
                found, parts = self.words.finditer(run[0]), [head]
                while ws := [m.group() for m in islice(found, RUN_WORDS)]:
                    parts += map(self._known(ws).__getitem__, ws)
                yield b"".join((*parts, tail))

    def _spaced(self, text: str | None) -> str:
        return "" if not text else (SPACE if self.prefix else "") + text.replace(" ", SPACE)

    # ---- decoding

    def decode(self, ids: bytes) -> str:
        """The library's decode(ids): surfaces joined, the space that encoding put before the text gone, broken bytes as U+FFFD."""
        i = np.frombuffer(ids, "<u4").astype(np.int64)
        read = np.flatnonzero(~self.is_control[i])
        if not len(read):
            return ""
        # runs of bytes end at control ids, which have no surface
        gaps = np.flatnonzero(np.diff(read) > 1) + 1
        parts = [self._joined(i[run]) for run in np.split(read, gaps)]
        if self.prefix and self.opens[i[read[0]]]:
            parts[0] = parts[0][1:]
        return "".join(parts)

    def _joined(self, i: np.ndarray) -> str:
        """The surfaces of ids without control ids among them."""
        size = self.surface_sizes[i]
        ends = np.cumsum(size)
        raw = self.surfaces[np.repeat(self.surface_starts[i] - (ends - size), size) + np.arange(ends[-1])].tobytes()
        try:
            return raw.decode()
        except UnicodeDecodeError:
            return "".join(_lenient(raw))


def _lenient(raw: bytes) -> Iterator[str]:
    """Characters of raw, each byte that begins none as U+FFFD."""
    at = 0
    while at < len(raw):
        size = 1 if raw[at] < 0xC0 else 2 if raw[at] < 0xE0 else 3 if raw[at] < 0xF0 else 4
        try:
            c = raw[at : at + size].decode()
        except UnicodeDecodeError:
            c, size = "�", 1
        yield c
        at += size


_models: dict[str, Model] = {}


def model(path: str) -> Model:
    """The model of a file, one for each process."""
    if path not in _models:
        _models[path] = Model(path)
    return _models[path]


@on_release.append
def forget() -> None:
    """Keep no words of any model; tasks of other operators in this process call it by release_memory."""
    for m in _models.values():
        m.forget()


def encode(docs: DataFrame, path: str, keep: Sequence[str] = ("doc_id",), bos: bool = True, eos: bool = True) -> DataFrame:
    """``docs`` -> ``(ids binary, n_tokens long, *keep)``: ids of each whole text as little-endian unsigned 32-bit integers.

    Null and empty texts have the begin and end ids alone; equal texts have
    equal ids, repeated rows stay, an empty table gives no rows; ``keep`` may
    not hold a result's name. No shuffle: one pass over the input.
    """
    columns.clash(["ids", "n_tokens"], keep)
    rows, fields = columns.carried(docs, keep)
    kept = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for batch in batches:
            for first in range(0, batch.num_rows, 1024):
                part = batch.slice(first, 1024)
                ids = list(m.encode(part.column(0).to_pylist(), bos, eos))
                counts = pa.array([len(b) // 4 for b in ids], pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.binary()), counts, *part.columns[1:]], ["ids", "n_tokens", *kept])
        release_memory(drop=False)

    out = rows.select("text", *kept).mapInArrow(run, columns.schema("ids binary, n_tokens long", fields))
    return columns.returned(out, ["ids", "n_tokens"], keep)


def decode(encoded: DataFrame, path: str, keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """``encoded`` with ``ids`` -> ``(text, *keep)``; null ids give the empty text, an id outside the vocabulary raises IndexError."""
    columns.clash(["text"], keep)
    at = {c: f"c_{i}" for i, c in enumerate(encoded.columns)}
    plain = encoded.toDF(*at.values())
    rows = plain.select(F.col(at["ids"]).alias("ids"), *(F.col(at[c]).alias(f"k_{i}") for i, c in enumerate(keep)))
    kept = rows.columns[1:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for batch in batches:
            for first in range(0, batch.num_rows, 1024):
                part = batch.slice(first, 1024)
                texts = [m.decode(b or b"") for b in part.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), *part.columns[1:]], ["text", *kept])
        release_memory(drop=False)

    out = rows.mapInArrow(run, columns.schema("text string", rows.schema.fields[1:]))
    return columns.returned(out, ["text"], keep)
