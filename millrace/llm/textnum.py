"""Vectorised word and n-gram hashes of whole texts.

A batch of texts is laid out as one byte buffer; word borders, word hashes and
rolling n-gram hashes are then array expressions over the buffer, so the cost
per word does not include a Python step. All hashes are 64 bits wide and depend
on the content only (not on the batch, the partition or the process).
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa

_U = np.uint64
_BYTE = 0x9E3779B97F4A7C15 | 1
_WORD = 0xD6E8FEB86659FD93 | 1
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_BLANK = np.array([b == 32 or 9 <= b <= 13 for b in range(256)])
#: Powers of a base that are kept for the next texts.
KEPT_POWERS = 1 << 19
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


#: What a process keeps for the next task of one operator, to be dropped before those of others.
on_release: list[Callable[[], None]] = []


def release_memory(drop: bool = True) -> None:
    """Give back what earlier tasks of this worker have freed, as the allocators would keep it; with ``drop``, what other operators keep too."""
    for f in on_release if drop else ():
        f()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # the C library has no such call
        ctypes.CDLL(None).malloc_trim(0)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def _power(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n (at least)."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size = 1 << max(12, (n - 1).bit_length())
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            a = np.full(size, b, dtype=_U)
            a[0] = 1
            out.append(np.cumprod(a, dtype=_U))
        have = out[0], out[1]
        if size <= KEPT_POWERS:
            _powers[base] = have
    return have


def _hash_buffer(buffer: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first byte of each word of the buffer."""
    a = np.frombuffer(buffer, np.uint8)
    blank = np.ones(len(a) + 2, np.int8)
    blank[1:-1] = _BLANK[a]
    edge = np.flatnonzero(np.diff(blank))
    start, end = edge[0::2], edge[1::2]
    power, inverse = _power(_BYTE, len(a) + 1)
    sums = np.zeros(len(a) + 1, _U)
    np.cumsum((a.astype(_U) + _U(1)) * power[: len(a)], dtype=_U, out=sums[1:])
    h = (sums[end] - sums[start]) * inverse[start]
    return mix(h + (end - start).astype(_U) * _U(_WORD)), start


def word_batches(texts: Sequence[str | None], lower: bool = False, size: int = 1 << 18, table: bytes | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(index of the first text, word hashes, offsets) for runs of texts of about ``size`` bytes.

    Words are ``[^\\x20\\x09-\\x0D]+``; with ``lower``, A-Z count as a-z; ``table``
    is applied to the bytes before. Text
    ``first + i`` owns ``hashes[offsets[i]:offsets[i + 1]]``. A null text has no
    words. A text is never cut, so one longer than ``size`` is a run of its own.
    """
    table = _LOWER if lower else table
    first, run, used = 0, [], 0
    for i, text in enumerate(texts):
        raw = b"" if text is None else text.encode("utf-8", "surrogatepass")
        if run and used + len(raw) > size:
            yield first, *_batch(run, table)
            first, run, used = i, [], 0
        run.append(raw)
        used += len(raw) + 1
    if run:
        yield first, *_batch(run, table)


def _batch(run: list[bytes], table: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    buffer = b"\n".join(run)
    h, start = _hash_buffer(buffer if table is None else buffer.translate(table))
    begins = np.zeros(len(run) + 1, np.int64)
    np.cumsum([len(r) + 1 for r in run], out=begins[1:])
    return h, np.searchsorted(start, begins)


def window_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n consecutive words (empty if there are fewer)."""
    m = len(words) - n + 1
    if m <= 0:
        return np.zeros(0, _U)
    power, inverse = _power(_WORD, len(words) + 1)
    sums = np.zeros(len(words) + 1, _U)
    np.cumsum(words * power[: len(words)], dtype=_U, out=sums[1:])
    return mix((sums[n:] - sums[:-n]) * inverse[:m] + _U(n))


def shingle_sets(texts: Sequence[str | None], n: int, lower: bool = True) -> Iterator[np.ndarray]:
    """The sorted distinct n-word shingle hashes of each text; with fewer words, the whole sequence as one."""
    for _, words, offsets in word_batches(texts, lower):
        windows = window_hashes(words, n)
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
            if b - a >= n:
                s = np.sort(windows[a : b - n + 1])
                yield s[np.concatenate(([True], s[1:] != s[:-1]))]
            elif b > a:
                yield window_hashes(words[a:b], b - a)
            else:
                yield np.zeros(0, _U)
