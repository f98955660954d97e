"""License scan by patience alignment: words unique to both text and template are
anchors, their longest increasing subsequence is kept, and the gaps are aligned in the
same way, so that the share of a template that a text holds in order is its coverage."""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytesops import NOT_WORD, U64, mix, runs, string_bytes, words
from .license_texts import NOTICES, VARIANTS

COVERAGE = 0.9
STRETCH = 1.5  # a match may lie in at most so many template lengths of text
SHORT = 40  # words of a template up to which every place of its first words is tried
RUN = 1 << 20


def increasing(values: list[int]) -> list[int]:
    """Places of a longest strictly increasing subsequence (patience sorting)."""
    tops: list[int] = []
    at: list[int] = []
    back: list[int] = []
    for i, v in enumerate(values):
        k = bisect_left(tops, v)
        back.append(at[k - 1] if k else -1)
        if k == len(tops):
            tops.append(v)
            at.append(i)
        else:
            tops[k], at[k] = v, i
    out = []
    i = at[-1] if at else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def _grams(x: list[int], size: int) -> list[tuple[int, ...]]:
    return [tuple(x[i : i + size]) for i in range(len(x) - size + 1)]


def _anchors(text: list[int], notice: list[int]) -> list[tuple[int, int]]:
    """Longest increasing sequence of places of words that occur once in both; where no
    word does, of runs of two or three words; in a gap without those either, the longest common
    subsequence."""
    for size in (1, 2, 3):
        t, n = _grams(text, size), _grams(notice, size)
        once, mine = Counter(t), Counter(n)
        place = {w: i for i, w in enumerate(t) if once[w] == 1}
        pairs = [(place[w], j) for j, w in enumerate(n) if mine[w] == 1 and w in place]
        if pairs:
            kept = [pairs[i] for i in increasing([p for p, _ in pairs])]
            out = [kept[0]]
            for p, q in ((p + k, q + k) for p, q in kept for k in range(size)):
                if p > out[-1][0] and q > out[-1][1]:
                    out.append((p, q))
            return out
    return _common(text, notice)


def _common(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """A longest common subsequence. A row of the table is one integer, whose bit j is 0 where
    b[j] makes the subsequence of a's words so far one longer: a row costs a few operations
    on all bits at once, so gaps of thousands of words need no bound."""
    where: dict[int, int] = {}
    for j, w in enumerate(b):
        where[w] = where.get(w, 0) | 1 << j
    full = (1 << len(b)) - 1
    rows, row = [], full
    for w in a:
        hit = row & where.get(w, 0)
        row = ((row + hit) | (row - hit)) & full
        rows.append(row)
    out, i, j = [], len(a), len(b)
    while i and j:
        if rows[i - 1] >> (j - 1) & 1:
            j -= 1
        else:
            i -= 1
            if not (i and not rows[i - 1] >> (j - 1) & 1):
                j -= 1
                out.append((i, j))
    return out[::-1]


def align(text: list[int], notice: list[int]) -> list[tuple[int, int]]:
    """Pairs (place in text, place in notice) of equal words, increasing in both."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(text), 0, len(notice))]
    while todo:
        a, b, c, d = todo.pop()
        while a < b and c < d and text[a] == notice[c]:
            out.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and text[b - 1] == notice[d - 1]:
            b, d = b - 1, d - 1
            out.append((b, d))
        if a >= b or c >= d:
            continue
        kept = [(a + p, c + q) for p, q in _anchors(text[a:b], notice[c:d])]
        if not kept:
            continue
        out += kept
        edges = [(a - 1, c - 1), *kept, (b, d)]
        for (p, q), (r, s) in zip(edges, edges[1:], strict=False):
            if r - p > 1 and s - q > 1:
                todo.append((p + 1, r, q + 1, s))
    return sorted(out)


class Template:
    """A notice as word hashes, and where in a text a match of it may begin."""

    def __init__(self, name: str, text: str, coverage: float):
        data = np.frombuffer(text.encode(), dtype=np.uint8)
        self.name = name
        self.words = words(data, np.array([0, len(data)]), NOT_WORD)[0]
        self.list = self.words.tolist()
        n = len(self.list)
        self.need = max(1, int(np.ceil(coverage * n - 1e-9)))
        self.reach = int(n * STRETCH) + 1
        self.least = max(1, self.need - (n - len(np.unique(self.words))))  # distinct words
        self.firsts = np.unique(self.words[: n - self.need + 1])
        self.pairs = mix(self.words[:-1] * U64(31) + self.words[1:]) if n > 1 else self.words[:0]
        tokens = "".join(c if c.isascii() and c.isalnum() or not c.isascii() else " " for c in text.lower()).split()
        fixed = [any(c.isdigit() for c in t) or t in VARIANTS for t in tokens]
        self.fixed = {q for q, x in enumerate(fixed) if x}
        self.foreign = {_hash(v) for v in VARIANTS if v not in tokens}

    def starts(self, h: np.ndarray, places: np.ndarray) -> list[int]:
        """Places where a match can begin. A match holds `need` words in order within
        `reach`, so it begins with one of the first words, and enough distinct words of
        the notice follow. A long notice's matches share runs of two words with it,
        which tell its place: those whose places agree are followed."""
        at = places[np.isin(h[places], self.words)]
        if len(self.list) > SHORT:
            mine = mix(h[:-1] * U64(31) + h[1:])
            order = np.argsort(self.pairs, kind="stable")
            lo, hi = (np.searchsorted(self.pairs[order], mine, side) for side in ("left", "right"))
            p = np.repeat(np.arange(len(mine)), hi - lo)
            q = order[np.repeat(lo, hi - lo) + np.arange(len(p)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo)]
            shift, votes = np.unique(p - q, return_counts=True)
            sums = np.concatenate(([0], np.cumsum(votes)))
            end = np.searchsorted(shift, shift + len(self.list) // 2, side="right")
            ok = np.flatnonzero(sums[end] - sums[:-1] >= len(self.list) // 4)
            best: dict[int, int] = {}
            for i in ok.tolist():
                g = int(shift[i]) // max(1, len(self.list) // 8)
                if g not in best or votes[i] > votes[best[g]]:
                    best[g] = i
            return sorted({max(0, int(shift[i])) for i in best.values()})
        out, held, j = [], Counter(), 0
        w = h[at].tolist()
        first = np.isin(h[at], self.firsts).tolist()
        spots = at.tolist()
        for i, p in enumerate(spots):
            while j < len(spots) and spots[j] - p < self.reach:
                held[w[j]] += 1
                j += 1
            if first[i] and len(held) >= self.least:
                out.append(p)
            held[w[i]] -= 1
            if not held[w[i]]:
                del held[w[i]]
        return out

    def best(self, h: np.ndarray, places: np.ndarray) -> tuple[int, int, int] | None:
        """(matched words, first place, end) of the best match, the first of equal ones."""
        best = None
        for a in self.starts(h, places):
            text = h[a : a + self.reach].tolist()
            pairs = align(text, self.list)
            if len(pairs) < self.need or best and len(pairs) <= best[0] or not self.fixed <= {q for _, q in pairs}:
                continue
            begin, end = pairs[0][0], pairs[-1][0] + 1
            if not self.foreign.isdisjoint(text[begin:end]):
                continue
            best = (len(pairs), a + begin, a + end)
            if len(pairs) == len(self.list):
                break
        return best


def _hash(word: str) -> int:
    data = np.frombuffer(word.encode(), dtype=np.uint8)
    return int(words(data, np.array([0, len(data)]), NOT_WORD)[0][0])


def scan(df: DataFrame, doc_id: str = "doc_id", text: str = "text", notices: tuple[tuple[str, str], ...] = NOTICES, coverage: float = COVERAGE) -> DataFrame:
    """One row per document row: doc_id, license (best covered notice, ties to the longer and
    then the first by name; null where none reaches `coverage`), coverage (share of its words found in order,
    0 where none does), begin_word and end_word of the place, n_licenses (by name).

    Words are ASCII letters and digits and all else beyond ASCII, in lower case. Whole texts
    are read. Each place where a notice may begin is aligned on its own (for notices of up to SHORT
    words, every place of their first words; a match lies in at most STRETCH times a notice's words), so a notice that is
    repeated, or lies in a long text, is found as in a short one. A notice's numbers and the
    words that tell its variants apart must all be found, and none of another variant may
    lie between. Null and empty texts have no license; a null doc_id stays null; rows that
    repeat each get their row. Other columns are not read. No shuffle."""
    schema = "doc_id long, license string, coverage double, begin_word long, end_word long, n_licenses int"
    templates = [t for name, x in notices if len((t := Template(name, x, coverage)).list)]
    hashes = [t.words for t in templates]

    def judge(h: np.ndarray, places: np.ndarray) -> tuple:
        found = []
        held = np.bincount(np.searchsorted(known, h[places]), minlength=len(known)) > 0
        for t, have in zip(templates, (member @ held).tolist(), strict=True):
            if have >= t.least and (best := t.best(h, places)):
                found.append((-best[0] / len(t.list), -len(t.list), t.name, best))
        if not found:
            return None, 0.0, None, None, 0
        share, _, name, best = min(found)
        return name, -share, best[1], best[2], len({x[2] for x in found})

    known = np.unique(np.concatenate(hashes)) if hashes else np.zeros(0, U64)
    member = np.array([np.isin(known, x) for x in hashes], dtype=np.int64).reshape(len(hashes), len(known))
    rare = np.zeros(1 << 16, dtype=bool)
    rare[(known >> U64(48)).astype(np.int64)] = True

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offs = string_bytes(b.column(1))
            rows: list[tuple] = [(None, 0.0, None, None, 0)] * b.num_rows
            for i, j in runs(offs, RUN):
                h, _, first = words(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], NOT_WORD)
                maybe = np.flatnonzero(rare[(h >> U64(48)).astype(np.int64)])
                maybe = maybe[np.isin(h[maybe], known)]
                cut = np.searchsorted(maybe, first)
                for r in np.flatnonzero(np.diff(cut)).tolist():
                    mine = h[first[r] : first[r + 1]]
                    rows[i + r] = judge(mine, maybe[cut[r] : cut[r + 1]] - first[r])
            kinds = (pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.int32())
            cols = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], names=["doc_id", "license", "coverage", "begin_word", "end_word", "n_licenses"])

    return df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(work, schema)


def op4_license_scans(spark, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
