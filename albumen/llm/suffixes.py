"""Byte-level helpers of suffix-array dedup: anchors, contexts and the
common-prefix interval tree of one bucket."""

from __future__ import annotations

import numpy as np

from .bytesops import U64, mix, prefix_hash, span_hash

K = 32
_ARG_BITS = 26
_B = 0x9E3779B97F4A7C15


def anchors(data: np.ndarray, offs: np.ndarray, width: int = 100, k: int = K):
    """Minimiser anchors: each window of `width` bytes inside a row belongs to
    the smallest (leftmost on ties) of its k-byte hashes, so that equal windows
    have the same anchor at the same place. Returns for each run of windows with
    one anchor: row, anchor, first window, last window, hash of the k bytes,
    hash of the run's whole context data[first : last + width]."""
    n, w = len(data), width - k + 1
    none = np.zeros(0, np.int64)
    if n < width:
        return none, none, none, none, none.astype(U64), none.astype(U64)
    h = data.astype(U64) + U64(1)
    step = 1
    while step < k:
        h = h[:-step] * U64(pow(_B, step, 1 << 64)) + h[step:]
        step *= 2
    h = mix(h)
    m = (h & ~U64((1 << _ARG_BITS) - 1)) | np.arange(len(h), dtype=U64)
    step = 1
    while step * 2 <= w:
        m = np.minimum(m[:-step], m[step:])
        step *= 2
    if step < w:
        m = np.minimum(m[: len(m) - (w - step)], m[w - step :])
    arg = (m & U64((1 << _ARG_BITS) - 1)).astype(np.int64)
    crossing = np.zeros(n + 1, dtype=np.int32)
    lo = np.maximum(offs[:-1], offs[1:] - (width - 1))
    np.add.at(crossing, lo, 1)
    np.add.at(crossing, offs[1:], -1)
    at = np.flatnonzero(np.cumsum(crossing)[: len(arg)] == 0)
    if not len(at):
        return none, none, none, none, none.astype(U64), none.astype(U64)
    a = arg[at]
    brk = np.flatnonzero((a[1:] != a[:-1]) | (at[1:] != at[:-1] + 1))
    first = at[np.concatenate(([0], brk + 1))]
    last = at[np.concatenate((brk, [len(at) - 1]))]
    anchor = arg[first]
    row = np.searchsorted(offs, first, side="right") - 1
    sums = prefix_hash(data)
    ctx = mix(span_hash(sums, first, last + width) + (anchor - first).astype(U64))
    return row, anchor, first, last, h[anchor], ctx


def suffix_order(contexts: list[bytes], begin: np.ndarray, per: np.ndarray, depth: int):
    """Enhanced suffix array over `per` suffixes of each context, from place `begin` on,
    compared by at most `depth` bytes. Returns (context of each suffix, start in it, common
    prefix with the suffix before, byte to its left or -1), in suffix order."""
    size = np.array([len(c) for c in contexts], dtype=np.int64)
    grid = np.zeros((len(contexts), int(size.max()) + depth), dtype=np.uint8)
    for i, c in enumerate(contexts):
        grid[i, : len(c)] = np.frombuffer(c, dtype=np.uint8)
    ctx = np.repeat(np.arange(len(contexts)), per)
    at = begin[ctx] + np.arange(len(ctx)) - np.repeat(np.cumsum(per) - per, per)
    rows = np.lib.stride_tricks.sliding_window_view(grid, depth, axis=1)[ctx, at]
    rest = np.minimum(size[ctx] - at, depth)
    # bytes past a context's end count as zeros; of suffixes that are equal so, the shorter
    # one comes first, which puts every prefix next to what it begins
    order = np.argsort(rest, kind="stable")
    order = order[np.argsort(np.ascontiguousarray(rows[order]).view(f"S{depth}").ravel(), kind="stable")]
    ctx, at, rows, rest = ctx[order], at[order], rows[order], rest[order]
    lcp = np.zeros(len(ctx), dtype=np.int64)
    same = rows[1:] == rows[:-1]
    common = np.where(same.all(axis=1), depth, np.argmin(same, axis=1))
    lcp[1:] = np.minimum(np.minimum(common, rest[1:]), rest[:-1])
    left = np.where(at > 0, grid[ctx, np.maximum(at - 1, 0)].astype(np.int64), -1)
    return ctx, at, lcp, left


def interval_tree(lcp: np.ndarray, left: np.ndarray, rank: np.ndarray, least: int):
    """Stack-scan of the common-prefix intervals of length >= least. Yields for each
    left-diverse one (lo, hi, length, first, others): positions lo..hi in suffix order
    share `length` bytes, first is the position of least rank, and others are the
    positions that are first in no interval below (each once, by its longest). An
    interval whose suffixes all continue to the left with one byte lies within the
    longer one that starts there, and is left out. Left -1 counts as diverse."""
    n = len(lcp)
    long = np.flatnonzero(lcp >= least)
    if not len(long):
        return
    begins = long[np.concatenate(([True], long[1:] != long[:-1] + 1))] - 1
    stops = long[np.concatenate((long[1:] != long[:-1] + 1, [True]))] + 1
    for b, e in zip(begins.tolist(), stops.tolist(), strict=True):
        ls = lcp[b + 1 : e].tolist() + [0]
        lefts, ranks = left[b:e].tolist(), rank[b:e].tolist()
        stack: list[list] = []  # [length, lo, first, left or -1, others]
        for i, l in enumerate(ls):
            lo, first, side = i, i, lefts[i]
            while stack and stack[-1][0] > l:
                top = stack.pop()
                if ranks[first] < ranks[top[2]]:
                    first, lost = first, top[2]
                else:
                    first, lost = top[2], first
                top[4].append(lost)
                side = side if side == top[3] else -1
                lo = top[1]
                if side == -1:
                    yield b + lo, b + i, top[0], b + first, [b + x for x in top[4]]
            if l < least:
                continue
            if stack and stack[-1][0] == l:
                top = stack[-1]
                if ranks[first] < ranks[top[2]]:
                    top[4].append(top[2])
                    top[2] = first
                else:
                    top[4].append(first)
                if side != top[3]:
                    top[3] = -1
            else:
                stack.append([l, lo, first, side, []])
    assert n


def _ranks(d: np.ndarray, s: np.ndarray) -> np.ndarray:
    rank = np.empty(len(d), dtype=np.int64)
    rank[np.lexsort((s, d))] = np.arange(len(d))
    return rank


def bucket_repeats(contexts: list[bytes], doc: np.ndarray, start: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of contexts that begin at byte `start` of document `doc`: (doc, begin, end) of every
    occurrence that is not the first of its repeat, the longest for each suffix."""
    size = np.array([len(c) for c in contexts], dtype=np.int64)
    ctx, at, lcp, left = suffix_order(contexts, np.zeros(len(size), np.int64), size - width + 1, int(size.max()))
    d, s = doc[ctx], start[ctx] + at
    lost, length = [], []
    for _, _, n, _, others in interval_tree(lcp, left, _ranks(d, s), width):
        lost += others
        length += [n] * len(others)
    at = np.array(lost, dtype=np.int64)
    return d[at], s[at], s[at] + np.array(length, dtype=np.int64)


def tree_groups(contexts: list[bytes], skip: np.ndarray, span: np.ndarray, n: np.ndarray, doc: np.ndarray, start: np.ndarray, least: int, most: int):
    """The left-diverse intervals of one part, of lengths from least to most (which stands
    for all longer ones): (length, contexts, shifts, doc and start of the first occurrence).
    A context's suffixes are those at its byte `skip` and the next `span`; the first of them
    is byte `start` of document `doc`. One that occurs n > 1 times is taken twice."""
    twice = np.repeat(np.arange(len(contexts)), np.minimum(n, 2))
    ctx, at, lcp, left = suffix_order([contexts[i] for i in twice], skip[twice].astype(np.int64), span[twice].astype(np.int64) + 1, most)
    row = twice[ctx]
    shift = at - skip[row]
    d, s = doc[row], start[row] + shift
    for lo, hi, length, first, _ in interval_tree(lcp, left, _ranks(d, s), least):
        pairs = np.unique(np.stack([row[lo : hi + 1], shift[lo : hi + 1]], axis=1), axis=0)
        yield length, pairs[:, 0], pairs[:, 1], int(d[first]), int(s[first])


def fingerprints(contexts: list[bytes], skip: np.ndarray, span: np.ndarray, least: int, most: int) -> dict[str, np.ndarray]:
    """Of every suffix of tree_groups' kind and every length from least to most that it
    has: row, shift, length, two hashes of its bytes (g1, g2), and the bytes to its left and
    right, -1 at a document's edge."""
    out: dict[str, list[np.ndarray]] = {c: [] for c in ("row", "shift", "length", "g1", "g2", "left", "right")}
    for i, c in enumerate(contexts):
        data = np.frombuffer(c, dtype=np.uint8)
        one, two = prefix_hash(data), prefix_hash(data ^ np.uint8(0xA5))
        padded = np.concatenate(([-1], data.astype(np.int32), [-1]))  # place p of data is p + 1 here
        for j in range(int(span[i]) + 1):
            a = int(skip[i]) + j
            length = np.arange(least, min(most, len(data) - a) + 1)
            begin = np.full(len(length), a)
            out["row"].append(np.full(len(length), i))
            out["shift"].append(np.full(len(length), j))
            out["length"].append(length)
            out["g1"].append(span_hash(one, begin, begin + length).view(np.int64))
            out["g2"].append(span_hash(two, begin, begin + length).view(np.int64))
            out["left"].append(np.full(len(length), padded[a], dtype=np.int32))
            out["right"].append(padded[a + length + 1].astype(np.int32))
    return {k: np.concatenate(v) if v else np.zeros(0, np.int64) for k, v in out.items()}
