"""Matroska media columns: files in a binary column, written and parsed element by element.

The writer stores 8-bit samples as one PCM track: frames of FRAME bytes, laced
into SimpleBlocks, blocks into clusters, and a cue for each cluster. The parser
walks any Matroska bytes: variable-length ids and sizes (unknown sizes too),
SimpleBlocks and BlockGroups, the three lacings, and cues. It gives a packet
table: track, timestamp, cluster and byte range of every frame. Times are
nanoseconds: a block's ticks times the segment's TimestampScale, and for the
frames of a lace the track's DefaultDuration more each, where it is known. A
file that breaks the rules gives a problem instead of packets.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Samples of a frame (and bytes, at 8 bits), frames of a block, blocks of a cluster, samples a second.
FRAME, LACED, BLOCKS, RATE = 192, 8, 20, 8000

# Element ids of the Matroska specification.
EBML, VERSION, READ_VERSION, MAX_ID, MAX_SIZE, DOC_TYPE, DOC_VERSION, DOC_READ_VERSION = 0x1A45DFA3, 0x4286, 0x42F7, 0x42F2, 0x42F3, 0x4282, 0x4287, 0x4285
SEGMENT, INFO, SCALE, DURATION, MUXER, WRITER = 0x18538067, 0x1549A966, 0x2AD7B1, 0x4489, 0x4D80, 0x5741
TRACKS, ENTRY, NUMBER, UID, KIND, CODEC, AUDIO, FREQUENCY, CHANNELS, DEPTH, FRAME_TIME = 0x1654AE6B, 0xAE, 0xD7, 0x73C5, 0x83, 0x86, 0xE1, 0xB5, 0x9F, 0x6264, 0x23E383
CLUSTER, TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1
CUES, CUE_POINT, CUE_TIME, CUE_POSITIONS, CUE_TRACK, CUE_CLUSTER = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
NO_LACING, XIPH, FIXED, EBML_LACING = 0, 1, 2, 3
_TOP = {CLUSTER, CUES, INFO, TRACKS, 0x114D9B74, 0x1941A469, 0x1043A770, 0x1254C367}


class Packet(NamedTuple):
    track: int
    timestamp: int
    cluster: int
    first_byte: int
    n_bytes: int
    keyframe: bool
    lacing: int


def vint(value: int, width: int = 0) -> bytes:
    """A variable-length size of the least (or the given) number of bytes."""
    width = width or next(w for w in range(1, 9) if value < (1 << 7 * w) - 1)
    return (value | 1 << 7 * width).to_bytes(width, "big")


def _uint(value: int) -> bytes:
    return value.to_bytes(max(1, (value.bit_length() + 7) // 8), "big")


def element(key: int, content: bytes) -> bytes:
    return _uint(key) + vint(len(content)) + content


def write_pcm(payload: bytes) -> bytes:
    """A Matroska file with the payload, whole frames of 8-bit samples, as its only track."""
    if not payload or len(payload) % FRAME:
        raise ValueError(f"the payload is no positive multiple of {FRAME} bytes")
    n = len(payload) // FRAME
    ms = FRAME * 1000 // RATE
    head = element(EBML, b"".join(element(k, v) for k, v in ((VERSION, b"\1"), (READ_VERSION, b"\1"), (MAX_ID, b"\4"), (MAX_SIZE, b"\x08"), (DOC_TYPE, b"matroska"), (DOC_VERSION, b"\4"), (DOC_READ_VERSION, b"\2"))))
    audio = element(FREQUENCY, struct.pack(">d", RATE)) + element(CHANNELS, b"\1") + element(DEPTH, b"\x08")
    entry = b"".join(element(k, v) for k, v in ((NUMBER, b"\1"), (UID, b"\1"), (KIND, b"\2"), (FRAME_TIME, _uint(ms * 1_000_000)), (CODEC, b"A_PCM/INT/LIT"), (AUDIO, audio)))
    body = [element(INFO, element(SCALE, _uint(1_000_000)) + element(DURATION, struct.pack(">d", n * ms)) + element(MUXER, b"millrace") + element(WRITER, b"millrace")), element(TRACKS, element(ENTRY, entry))]
    at, cues = sum(map(len, body)), []
    for first in range(0, n, LACED * BLOCKS):
        content = [element(TIMESTAMP, _uint(first * ms))]
        for k in range(first, min(n, first + LACED * BLOCKS), LACED):
            frames = min(LACED, n - k)
            flags, laced = (0x80, b"") if frames == 1 else (0x80 | FIXED << 1, bytes([frames - 1]))
            content.append(element(SIMPLE_BLOCK, b"\x81" + struct.pack(">hB", (k - first) * ms, flags) + laced + payload[k * FRAME : (k + frames) * FRAME]))
        body.append(element(CLUSTER, b"".join(content)))
        cues.append(element(CUE_POINT, element(CUE_TIME, _uint(first * ms)) + element(CUE_POSITIONS, element(CUE_TRACK, b"\1") + element(CUE_CLUSTER, _uint(at)))))
        at += len(body[-1])
    return head + element(SEGMENT, b"".join(body) + element(CUES, b"".join(cues)))


def _vint(data: bytes, at: int, end: int, marker: bool = False) -> tuple[int, int, int]:
    """(value, its bytes, the first byte after) of a variable-length integer; with ``marker``, the marking bit stays in the value."""
    if at >= end or not data[at]:
        raise ValueError(f"no variable-length integer at byte {at}")
    width = 9 - data[at].bit_length()
    if at + width > end:
        raise ValueError(f"a variable-length integer at byte {at} ends beyond its parent")
    value = int.from_bytes(data[at : at + width], "big")
    return value if marker else value & (1 << 7 * width) - 1, width, at + width


def _head(data: bytes, at: int, end: int) -> tuple[int, int, int]:
    """(id, first byte, end) of the element's content; an unknown size reaches to ``end``."""
    key, _, at = _vint(data, at, end, True)
    size, width, at = _vint(data, at, end)
    last = end if size == (1 << 7 * width) - 1 else at + size
    if last > end:
        raise ValueError(f"an element at byte {at} ends beyond its parent")
    return key, at, last


def _children(data: bytes, at: int, end: int, stop: frozenset | set = frozenset()) -> Iterator[tuple[int, int, int]]:
    while at < end:
        key, first, last = _head(data, at, end)
        if key in stop:
            return
        yield key, first, last
        at = last


def _number(data: bytes, at: int, end: int) -> int:
    return int.from_bytes(data[at:end], "big")


def _block(data: bytes, at: int, end: int, base: int, cluster: int, simple: bool, scale: int, durations: dict[int, int]) -> Iterator[Packet]:
    track, _, at = _vint(data, at, end)
    if at + 3 > end:
        raise ValueError(f"a block at byte {at} has no head")
    relative, flags = struct.unpack_from(">hB", data, at)
    at += 3
    lacing, sizes = flags >> 1 & 3, []
    if lacing != NO_LACING:
        if at >= end:
            raise ValueError(f"a lace at byte {at} has no frames")
        frames = data[at] + 1
        at += 1
        if lacing == FIXED:
            if (end - at) % frames:
                raise ValueError(f"a lace at byte {at} does not divide into {frames} frames")
            sizes = [(end - at) // frames] * frames
        elif lacing == XIPH:
            for _ in range(frames - 1):
                size, more = 0, True
                while more:
                    if at >= end:
                        raise ValueError(f"a lace at byte {at} has no sizes")
                    size, more, at = size + data[at], data[at] == 255, at + 1
                sizes.append(size)
        else:
            for i in range(frames - 1):
                value, width, at = _vint(data, at, end)
                sizes.append(value if i == 0 else sizes[-1] + value - ((1 << 7 * width - 1) - 1))
        if lacing != FIXED:
            sizes.append(end - at - sum(sizes))
    else:
        sizes = [end - at]
    for i, size in enumerate(sizes):
        if size < 0 or at + size > end:
            raise ValueError(f"a frame at byte {at} ends beyond its block")
        yield Packet(track, (base + relative) * scale + i * durations.get(track, 0), cluster, at, size, bool(flags & 0x80) if simple else True, lacing)
        at += size


def parse(data: bytes) -> tuple[list[Packet], list[tuple[int, int, int]]]:
    """Packets, and cues as (time, track, byte of the cluster); times in nanoseconds. A ValueError tells what breaks the rules."""
    packets: list[Packet] = []
    cues: list[tuple[int, int, int]] = []
    for key, first, last in _children(data, 0, len(data)):
        if key != SEGMENT:
            continue
        at, n, scale, durations = first, 0, 1_000_000, {}
        while at < last:
            top, a, b = _head(data, at, last)
            if top == INFO:
                scale = next((_number(data, c, d) for kid, c, d in _children(data, a, b) if kid == SCALE), scale)
            elif top == TRACKS:
                for entry, c, d in _children(data, a, b):
                    held = {kid: _number(data, e, f) for kid, e, f in _children(data, c, d) if kid in (NUMBER, FRAME_TIME)} if entry == ENTRY else {}
                    if FRAME_TIME in held:
                        durations[held.get(NUMBER, 0)] = held[FRAME_TIME]
            elif top == CLUSTER:
                base, reached = 0, a
                for kid, c, d in _children(data, a, b, _TOP):
                    reached = d
                    if kid == TIMESTAMP:
                        base = _number(data, c, d)
                    elif kid == SIMPLE_BLOCK:
                        packets.extend(_block(data, c, d, base, n, True, scale, durations))
                    elif kid == BLOCK_GROUP:
                        for inner, e, f in _children(data, c, d):
                            if inner == BLOCK:
                                packets.extend(_block(data, e, f, base, n, False, scale, durations))
                n, b = n + 1, reached
            elif top == CUES:
                for point, c, d in _children(data, a, b):
                    if point == CUE_POINT:
                        time, places = 0, []
                        for kid, e, f in _children(data, c, d):
                            if kid == CUE_TIME:
                                time = _number(data, e, f)
                            elif kid == CUE_POSITIONS:
                                places.append({k: _number(data, x, y) for k, x, y in _children(data, e, f)})
                        cues += [(time * scale, p.get(CUE_TRACK, 0), first + p.get(CUE_CLUSTER, 0)) for p in places]
            at = max(b, at + 1)
    return packets, cues


def seek(data: bytes, time: int) -> int:
    """Byte of the last cluster that a cue places at or before the time in nanoseconds (the first cue's, if none is before)."""
    cues = sorted(parse(data)[1])
    if not cues:
        raise ValueError("the file has no cues")
    return next((at for t, _, at in reversed(cues) if t <= time), cues[0][2])


def payload_of(text: str | None) -> tuple[int, bytes]:
    """UTF-8 length, and the bytes followed by spaces up to a positive multiple of FRAME."""
    raw = b"" if text is None else text.encode("utf-8", "surrogatepass")
    return len(raw), raw + b" " * (-len(raw) % FRAME if raw else FRAME)


def to_media(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text)`` -> ``(doc_id, n_bytes, media)``: each whole text as samples in a Matroska file, a row for each row.

    A null text is empty; an empty table gives no rows; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                done = [payload_of(t) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([n for n, _ in done], pa.int64()), pa.array([write_pcm(p) for _, p in done], pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_bytes long, media binary")


def packets(media: DataFrame) -> DataFrame:
    """``media(doc_id, media)`` -> a row for each packet: ``doc_id, packet``, the fields of Packet and ``problem``.

    Null media and files without packets have no rows; a file that breaks the
    rules has one, with nulls and the problem. Repeated rows give their packets
    each; other columns are ignored.
    """
    fields = "track int, timestamp long, cluster int, first_byte long, n_bytes long, keyframe boolean, lacing int"

    def rows_of(doc_id: int | None, data: bytes) -> list[tuple]:
        try:
            return [(doc_id, i, *p, None) for i, p in enumerate(parse(data)[0])]
        except ValueError as e:
            return [(doc_id, *[None] * 8, str(e))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                rows = [r for d, m in zip(part.column(0).to_pylist(), part.column(1).to_pylist()) if m is not None for r in rows_of(d, m)]
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.string()]
                names = list(zip(*rows)) if rows else [()] * len(kinds)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(names, kinds)], ["doc_id", "packet", *Packet._fields, "problem"])

    return media.select(F.col("doc_id").cast("long").alias("doc_id"), "media").mapInArrow(run, f"doc_id long, packet long, {fields}, problem string")


def features(data: bytes) -> tuple[bytes, str]:
    """The samples read back through the packet table, and a description of packets and samples."""
    found, cues = parse(data)
    samples = b"".join(data[p.first_byte : p.first_byte + p.n_bytes] for p in found)
    x = np.frombuffer(samples, np.uint8).astype(np.int64)
    up = int(np.count_nonzero(np.diff(x >= 128)))
    laced = sum(p.lacing != NO_LACING for p in found)
    last = found[-1].timestamp // 1_000_000 if found else -1
    return samples, f"packets={len(found)};laced={laced};clusters={1 + max((p.cluster for p in found), default=-1)};cues={len(cues)};last_ms={last};sum={int(x.sum())};energy={int((x * x).sum())};crossings={up}"


def digests(media: DataFrame) -> DataFrame:
    """``(doc_id, n_bytes, media)`` -> what the parser reads back from each file, as digests and features, and a ``problem``.

    Of a file that breaks the rules nothing is read: its payload columns and
    feature are null; of a null file all but doc_id and n_bytes are.
    """
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "problem"]

    def row(doc_id: int | None, n_bytes: int | None, data: bytes | None) -> tuple:
        if data is None:
            return (doc_id, n_bytes, *[None] * 6, "no file")
        stored = len(data), hashlib.sha256(data).hexdigest()
        try:
            samples, feature = features(data)
        except ValueError as e:
            return (doc_id, n_bytes, None, None, None, *stored, None, str(e))
        return (doc_id, n_bytes, len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-16:]), *stored, feature, None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                rows = [row(*r) for r in zip(*(c.to_pylist() for c in batch.slice(at, 512).columns))]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if "sha256" in n or n in ("feature", "problem") else pa.int64()) for n, c in zip(names, zip(*rows))], names)

    return media.select(F.col("doc_id").cast("long").alias("doc_id"), "n_bytes", "media").mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, problem string")
