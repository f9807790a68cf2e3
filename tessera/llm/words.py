"""Vectorised word hashing over Arrow string buffers (numpy only).

A word is a maximal run of characters other than ASCII control, punctuation and white space, with
A-Z lower-cased: every byte of a multi-byte UTF-8 character belongs to a word, so the scan works
on bytes. Each word gets a 64-bit hash made of a polynomial modulo 2**64, one modulo a prime (the first alone
has words that collide by construction, such as the Thue-Morse word and its complement) and the length.
"""

from __future__ import annotations

import ctypes
from functools import lru_cache

import numpy as np
import pyarrow as pa

SEGMENT = 1 << 18
_B = 0x9E3779B97F4A7C15 | 1
_M1 = np.uint64(0xBF58476D1CE4E5B9)
_M2 = np.uint64(0x94D049BB133111EB)
_STEP = np.uint64(0xD6E8FEB86659FD93)
#: The prime field's size and base; sums of a segment's terms stay below 2**64.
_PRIME, _G = (1 << 31) - 1, 1_173_914_813


def _lut() -> np.ndarray:
    lut = np.zeros(256, np.uint8)
    lut[0x80:] = np.arange(0x80, 0x100)
    lut[0x30:0x3A] = np.arange(0x30, 0x3A)
    lut[0x61:0x7B] = np.arange(0x61, 0x7B)
    lut[0x41:0x5B] = np.arange(0x61, 0x7B)
    return lut


LUT = _lut()


@lru_cache(maxsize=1)
def _libc():
    try:
        return ctypes.CDLL("libc.so.6")
    except OSError:
        return None


def release_memory() -> None:
    """Give freed memory back to the machine: idle Python workers would hold it beside the next stage's heap."""
    pa.default_memory_pool().release_unused()
    if (libc := _libc()) is not None:
        libc.malloc_trim(0)


@lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Powers of both bases and of their inverses."""
    out = []
    for base in (_B, pow(_B, -1, 1 << 64)):
        p = np.full(SEGMENT, base, np.uint64)
        p[0] = 1
        with np.errstate(over="ignore"):
            out.append(np.multiply.accumulate(p))
    for base in (_G, pow(_G, -1, _PRIME)):
        p, n = np.ones(SEGMENT, np.uint64), 1
        while n < SEGMENT:
            p[n : 2 * n] = p[:n] * np.uint64(pow(base, n, _PRIME)) % np.uint64(_PRIME)
            n *= 2
        out.append(p)
    return tuple(out)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * _M1
        h = (h ^ (h >> np.uint64(27))) * _M2
    return h ^ (h >> np.uint64(31))


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and int64 offsets (n + 1) of a string column; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def _joined(wide: np.ndarray, field: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """One hash of both polynomials and the length."""
    with np.errstate(over="ignore"):
        return mix(wide + mix(field | (lengths.astype(np.uint64) << np.uint64(32))))


def _long_span(symbols: np.ndarray) -> tuple[np.uint64, np.uint64]:
    """Both polynomials of a span longer than a segment, piece by piece."""
    power, _, field_power, _ = _powers()
    prime = np.uint64(_PRIME)
    wide, field, scale, field_scale = np.uint64(0), np.uint64(0), np.uint64(1), np.uint64(1)
    step = np.uint64(pow(_G, SEGMENT, _PRIME))
    with np.errstate(over="ignore"):
        for i in range(0, len(symbols), SEGMENT):
            part = symbols[i : i + SEGMENT].astype(np.uint64)
            wide = wide + scale * np.sum(part * power[: len(part)], dtype=np.uint64)
            scale = scale * power[-1] * np.uint64(_B)
            field = (field + field_scale * (np.sum(part * field_power[: len(part)], dtype=np.uint64) % prime)) % prime
            field_scale = field_scale * step % prime
    return wide, field


def span_hashes(symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of every span of symbols (below 2**12), segment by segment; spans are in order and apart."""
    power, inverse, field_power, field_inverse = _powers()
    prime = np.uint64(_PRIME)
    wide, field = np.empty(len(starts), np.uint64), np.empty(len(starts), np.uint64)
    i = 0
    with np.errstate(over="ignore"):
        while i < len(starts):
            a = starts[i]
            j = int(np.searchsorted(ends, a + SEGMENT, side="right"))
            if j <= i:
                wide[i], field[i] = _long_span(symbols[a : ends[i]])
                i += 1
                continue
            b = ends[j - 1]
            part = symbols[a:b].astype(np.uint64)
            total = np.zeros(b - a + 1, np.uint64)
            s, e = starts[i:j] - a, ends[i:j] - a
            np.cumsum(part * power[: b - a], out=total[1:])
            wide[i:j] = (total[e] - total[s]) * inverse[s]
            np.cumsum(part * field_power[: b - a], out=total[1:])
            field[i:j] = (total[e] - total[s]) % prime * field_inverse[s] % prime
            i = j
    return _joined(wide, field, ends - starts)


def hash_words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes, start bytes, end bytes, and word offsets per text (n + 1), of concatenated texts.

    Works through the buffer in segments cut at word borders, so memory stays a small multiple of
    the segment however long a text is.
    """
    low = LUT[raw]
    inside = low != 0
    first = np.ones(len(raw) + 1, bool)
    if len(raw):
        first[1:-1] = False
        first[offsets[(offsets > 0) & (offsets < len(raw))]] = True
        before = np.concatenate(([False], inside[:-1]))
        starts = np.flatnonzero(inside & (~before | first[:-1]))
        after = np.concatenate((inside[1:], [False]))
        ends = np.flatnonzero(inside & (~after | first[1:])) + 1
    else:
        starts = ends = np.zeros(0, np.int64)
    return span_hashes(low, starts, ends), starts, ends, np.searchsorted(starts, offsets)


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of ``k`` consecutive words (fewer words: one hash of them all, none: none)."""
    n = len(words)
    if n == 0:
        return words
    k = min(k, n)
    with np.errstate(over="ignore"):
        acc = words[: n - k + 1].copy()
        for j in range(1, k):
            acc = acc * _STEP + words[j : n - k + 1 + j]
    return mix(acc + np.uint64(k))


def shingle_sets(column: pa.Array, k: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of every text."""
    raw, offsets = string_buffers(column)
    words, _, _, at = hash_words(raw, offsets)
    return [np.unique(shingle_hashes(words[at[i] : at[i + 1]], k)) for i in range(len(offsets) - 1)]


def slices(column: pa.Array, most_bytes: int = 1 << 19) -> list[tuple[int, int]]:
    """Row ranges of at most ``most_bytes`` of text each (a longer text alone)."""
    n = len(column)
    if n == 0:
        return []
    _, offsets = string_buffers(column)
    out, a = [], 0
    while a < n:
        b = int(np.searchsorted(offsets, offsets[a] + most_bytes, side="right")) - 1
        b = max(b, a + 1)
        out.append((a, min(b, n)))
        a = b
    return out
