"""Vectorised helpers on Arrow string columns: every function works on one
bounded run of bytes, so a task's memory follows the run and not the table."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15
_BASE_INV = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}

SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[list(SPACES)] = True
NOT_WORD = np.array([c < 128 and not chr(c).isalnum() for c in range(256)])


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** n modulo 2 ** 64, kept between calls."""
    have = _powers.get(base)
    if have is None or len(have) <= n:
        size = max(n + 1, 1 << 16)
        have = np.full(size, base, dtype=U64)
        have[0] = 1
        np.cumprod(have, out=have)
        _powers[base] = have
    return have


def mix(h: np.ndarray) -> np.ndarray:
    """A finaliser that spreads the bits of 64-bit values."""
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> U64(27))
    h = h * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Running polynomial sums: entry i covers data[:i]."""
    out = np.zeros(len(data) + 1, dtype=U64)
    np.cumsum((data.astype(U64) + U64(1)) * powers(_BASE, len(data))[: len(data)], out=out[1:])
    return out


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of data[start:end] for many spans, independent of where they lie."""
    inv = powers(_BASE_INV, len(sums))
    return mix((sums[end] - sums[start]) * inv[start] + (end - start).astype(U64))


LONG_WORD = 512
_LANE = np.array([(1 << (8 * i)) - 1 for i in range(9)], dtype=U64)


def word_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the words data[start:end]. Each eight bytes go through a finaliser before the
    next ones come in, so that no structure of the letters (as the Thue-Morse word has for sums
    of powers) makes two words meet; words of over LONG_WORD bytes are digested one by one."""
    size = end - start
    h = size.astype(U64) * U64(_BASE)
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    lanes = np.ndarray(len(data) + 1, dtype="<u8", buffer=padded.data, strides=(1,))
    live = np.flatnonzero(size <= LONG_WORD)
    at, left = start[live], size[live]
    while len(live):
        h[live] = mix(h[live] ^ (lanes[at] & _LANE[np.minimum(left, 8)])) + U64(_BASE)
        more = left > 8
        live, at, left = live[more], at[more] + 8, left[more] - 8
    for i in np.flatnonzero(size > LONG_WORD).tolist():
        h[i] = int.from_bytes(hashlib.blake2b(data[start[i] : end[i]].tobytes(), digest_size=8).digest(), "little")
    return h


def string_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null is an empty run of bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    kind, size = (np.int64, 8) if wide else (np.int32, 4)
    offs = np.frombuffer(column.buffers()[1], dtype=kind, count=len(column) + 1, offset=column.offset * size).astype(np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8)[offs[0] : offs[-1]] if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data, offs - offs[0]


def runs(offs: np.ndarray, limit: int):
    """Ranges (i, j) of rows whose bytes sum to about limit; a row longer than that stands alone."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = int(np.searchsorted(offs, offs[i] + limit, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def words(data: np.ndarray, offs: np.ndarray, space: np.ndarray = IS_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, row, first word of each row): words are runs of bytes outside `space`
    (space, tab and line breaks; or NOT_WORD), A-Z lower-cased; they never cross rows."""
    n = len(data)
    rows = len(offs) - 1
    if n == 0:
        return np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(rows + 1, np.int64)
    low = LOWER[data]
    solid = ~space[data]
    begin = np.empty(n, dtype=bool)
    begin[0] = True
    begin[1:] = ~solid[:-1]
    begin[offs[:-1][offs[:-1] < n]] = True
    begin &= solid
    stop = np.empty(n, dtype=bool)
    stop[-1] = True
    stop[:-1] = ~solid[1:]
    stop[offs[1:][offs[1:] > 0] - 1] = True
    stop &= solid
    ws, we = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    h = word_hash(low, ws, we)
    first = np.searchsorted(ws, offs)
    row = np.repeat(np.arange(rows), np.diff(first))
    return h, row, first


def shingles(h: np.ndarray, first: np.ndarray, k: int) -> list[np.ndarray]:
    """Sorted distinct hashes of k-word shingles per row; with fewer words the
    whole sequence is one shingle; without words there is none."""
    out = []
    n = len(h)
    if n >= k:
        rolled = h[: n - k + 1].copy()
        for j in range(1, k):
            rolled = rolled * U64(_BASE) + h[j : n - k + 1 + j]
        rolled = mix(rolled)
    for i in range(len(first) - 1):
        a, b = int(first[i]), int(first[i + 1])
        if a == b:
            out.append(np.zeros(0, U64))
        elif b - a < k:
            acc = 7 + b - a
            for x in h[a:b].tolist():
                acc = (acc * _BASE + x) & 0xFFFFFFFFFFFFFFFF
            out.append(mix(np.array([acc], dtype=U64)))
        else:
            s = np.sort(rolled[a : b - k + 1])
            keep = np.empty(len(s), dtype=bool)
            keep[0] = True
            np.not_equal(s[1:], s[:-1], out=keep[1:])
            out.append(s[keep])
    return out
