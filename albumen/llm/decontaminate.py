"""Benchmark decontamination by spaced-seed hashing: fixed masks ignore some token
positions, equal seeds of test items and documents are joined, and the overlap
around each hit is verified with substitutions allowed."""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from .bytesops import NOT_WORD, U64, mix, runs, string_bytes, words
from .scratch import written

# Positions that a seed reads (1) or ignores (0). Together they hit every
# stretch of 13 to 25 tokens of which MATCH are equal, wherever its substitutions are (a
# test tries them all), and so every longer one: cut into parts of 13 tokens or more, one
# of them has that share too.
MASKS = ("1101111", "11101000011", "1010010101001")
OVERLAP = 13  # tokens of an overlap that counts; all of them where the item has fewer
MATCH = 0.8  # of them that are equal
SEEDS = 4_000_000  # of test seeds that one pass over the documents carries
RUN = 1 << 18
PAIRS = 1 << 12  # of equal seeds that are paired one by one


def tokens(column: pa.Array):
    """(first row, hashes, first token of each row) per run: ASCII letters and digits and
    all other characters beyond ASCII form tokens, A-Z lower-cased."""
    data, offs = string_bytes(column)
    for i, j in runs(offs, RUN):
        h, _, first = words(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], NOT_WORD)
        yield i, h, first


def seeds(h: np.ndarray, mask: str) -> np.ndarray:
    """Hash of every place's seed under a mask (places may cross rows)."""
    n = len(h) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, U64)
    acc = np.full(n, len(mask), dtype=U64)
    for j, bit in enumerate(mask):
        if bit == "1":
            acc = acc * U64(0x9E3779B97F4A7C15) + h[j : j + n]
    return mix(acc)


def spare(n: int, match: float) -> int:
    """Substitutions that a stretch of n tokens may have."""
    return n - ceil(match * n - 1e-9)


def masks_of(n: int, overlap: int = OVERLAP, match: float = MATCH) -> tuple[str, ...]:
    """Masks that together hit every stretch by which an item of n tokens may count.

    An item under `overlap` tokens counts as a whole, with equal ends: its inner places are
    dealt to two groups more than it may have substitutions, and each mask ignores as many
    groups as those. Of values below the fixed ones, all that is sure is a run of tokens."""
    if n >= overlap:
        if overlap >= OVERLAP and match >= MATCH:
            return MASKS
        sizes = range(overlap, 2 * overlap)
    elif (k := max(0, min(spare(n, match), n - 2))) <= 3:
        groups = np.array_split(np.arange(1, n - 1), k + 2) if n > 2 else [[]] * (k + 2)
        gone = [{int(x) for g in some for x in g} for some in itertools.combinations(groups, k)]
        return tuple(sorted({"".join("01"[i not in g] for i in range(n)) for g in gone}))
    else:
        sizes = range(n, n + 1)
    return ("1" * max(1, min(ceil((m - spare(m, match)) / (spare(m, match) + 1)) for m in sizes)),)


class TestSet:
    """Test items' tokens and their sorted seeds, small enough to send to every task."""

    def __init__(self, ids: list[int], items: list[np.ndarray], overlap: int = OVERLAP, match: float = MATCH):
        self.ids = np.array(ids, dtype=np.int64)
        self.size = np.array([len(x) for x in items], dtype=np.int64)
        self.at = np.cumsum(self.size) - self.size
        self.flat = np.concatenate(items) if items else np.zeros(0, U64)
        self.seeds = []
        users: dict[str, list[int]] = {}
        for i, x in enumerate(items):
            for mask in masks_of(len(x), overlap, match):
                users.setdefault(mask, []).append(i)
        for mask, some in sorted(users.items()):
            found = [(s, np.full(len(s), i), np.arange(len(s))) for i in some if len(s := seeds(items[i], mask))]
            if found:
                s, i, q = (np.concatenate(z) for z in zip(*found, strict=True))
                order = np.argsort(s, kind="stable")
                self.seeds.append((mask, s[order], i[order], q[order]))
        self.filters = []
        for _, s, _, _ in self.seeds:
            bits = np.zeros(1 << min(22, max(12, 4 + len(s).bit_length())), dtype=bool)
            bits[(s >> U64(64 - len(bits).bit_length() + 1)).astype(np.int64)] = True
            self.filters.append(bits)


def aligned(doc: np.ndarray, item: np.ndarray, diagonal: int, overlap: int, match: float, floor: int = 0) -> tuple[int, int] | None:
    """(length, equal tokens) of the longest stretch on a diagonal (place in doc minus
    place in item) that begins and ends with equal tokens, of which the share `match`
    are equal; None where none has min(overlap, tokens of the item) and `floor` tokens."""
    lo, hi = max(0, -diagonal), min(len(item), len(doc) - diagonal)
    least = max(min(overlap, len(item)), floor, 1)
    if hi - lo < least:
        return None
    same = doc[lo + diagonal : hi + diagonal] == item[lo:hi]
    sums = np.concatenate(([0], np.cumsum(same)))
    if sums[-1] < match * least - 1e-9:
        return None
    gain = sums - match * np.arange(len(sums))
    # the longest i < j with gain[j] >= gain[i]: for each end j of an equal token, the
    # first i whose prefix minimum, of places where an equal token begins, is low enough
    low = np.minimum.accumulate(np.where(same, gain[:-1], np.inf))
    ends = np.flatnonzero(same) + 1
    begins = np.searchsorted(-low, -(gain[ends] + 1e-9), side="left")
    size = int((ends - begins).max())
    if size < least:
        return None
    held = sums[size:] - sums[:-size]
    fits = same[: len(held)] & same[size - 1 :] & (held >= match * size - 1e-9)
    return size, int(held[fits].max())


def _differences(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The distinct values of x - y for x in p, y in q, without holding all pairs."""
    if len(p) * len(q) <= PAIRS:
        return np.unique(p[:, None] - q[None, :])
    few, many = (p, -q) if len(p) <= len(q) else (-q, p)
    base = int(many.min())
    there = np.zeros(int(many.max()) - base + 1, dtype=bool)
    there[many - base] = True
    mark = np.zeros(len(there) + int(few.max() - few.min()), dtype=bool)
    for x in np.unique(few - few.min()).tolist():
        mark[x : x + len(there)] |= there
    return np.flatnonzero(mark) + base + int(few.min())


def _diagonals(test: TestSet, h: np.ndarray, first: np.ndarray) -> dict[tuple[int, int], np.ndarray]:
    """(row, item) -> the distinct diagonals on which some seed of theirs is equal."""
    found: dict[tuple[int, int], list[np.ndarray]] = {}
    for (mask, s, item, q), bits in zip(test.seeds, test.filters, strict=True):
        mine = seeds(h, mask)
        if not len(mine):
            continue
        at = np.flatnonzero(bits[(mine >> U64(64 - len(bits).bit_length() + 1)).astype(np.int64)])
        lo = np.searchsorted(s, mine[at], "left")
        hi = np.searchsorted(s, mine[at], "right")
        row = np.searchsorted(first, at, side="right") - 1
        ok = (hi > lo) & (at + len(mask) <= first[row + 1])
        at, lo, hi, row = at[ok], lo[ok], hi[ok], row[ok]
        # one group a row and seed: its places there against its places in each item
        order = np.lexsort((at, lo, row))
        at, lo, hi, row = at[order], lo[order], hi[order], row[order]
        cut = np.flatnonzero(np.concatenate(([True], (row[1:] != row[:-1]) | (lo[1:] != lo[:-1]), [True]))) if len(at) else np.zeros(1, np.int64)
        for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            r, places = int(row[a]), at[a:b] - first[row[a]]
            mine_q, mine_i = q[lo[a] : hi[a]], item[lo[a] : hi[a]]
            edge = np.flatnonzero(np.concatenate(([True], mine_i[1:] != mine_i[:-1], [True])))
            for x, y in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                found.setdefault((r, int(mine_i[x])), []).append(_differences(places, mine_q[x:y]))
    return {k: np.unique(np.concatenate(v)) for k, v in found.items()}


def overlaps(test: TestSet, h: np.ndarray, first: np.ndarray, overlap: int, match: float) -> dict[int, tuple[int, int, int]]:
    """row -> (item id, length, equal tokens) of each row's longest verified overlap (ties:
    more equal tokens, then the smaller item id). Diagonals are verified longest first;
    those that can't hold a stretch as long as the row's best are passed over."""
    out: dict[int, tuple[int, int, int]] = {}
    for (row, item), diagonals in _diagonals(test, h, first).items():
        doc = h[first[row] : first[row + 1]]
        mine = test.flat[test.at[item] : test.at[item] + test.size[item]]
        room = np.minimum(len(mine), len(doc) - diagonals) - np.maximum(0, -diagonals)
        for i in np.argsort(-room, kind="stable").tolist():
            old = out.get(row)
            if old and room[i] < old[1]:
                break
            hit = aligned(doc, mine, int(diagonals[i]), overlap, match, old[1] if old else 0)
            if hit:
                new = (int(test.ids[item]), *hit)
                if old is None or (-new[1], -new[2], new[0]) < (-old[1], -old[2], old[0]):
                    out[row] = new
    return out


def test_sets(benchmark: DataFrame, item_id: str, text: str, limit: int, overlap: int, match: float) -> Iterator[TestSet]:
    """The test items in parts whose seeds number at most `limit`, read part by part."""
    ids: list[int] = []
    items: list[np.ndarray] = []
    n = 0
    rows = benchmark.select(F.col(item_id).cast("long").alias("i"), F.col(text).alias("t")).where("t is not null")
    for r in rows.orderBy(F.col("i").asc_nulls_last(), "t").toLocalIterator():
        h = next(tokens(pa.array([r["t"]], pa.string())))[1]
        if not len(h):
            continue
        ids.append(-1 if r["i"] is None else r["i"])
        items.append(h)
        n += sum(max(0, len(h) - len(m) + 1) for m in masks_of(len(h), overlap, match))
        if n >= limit:
            yield TestSet(ids, items, overlap, match)
            ids, items, n = [], [], 0
    if ids:
        yield TestSet(ids, items, overlap, match)


def contamination(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", overlap: int = OVERLAP, match: float = MATCH, limit: int = SEEDS) -> DataFrame:
    """One row per document row: doc_id, contaminated, item_id, overlap (tokens), equal.

    A document is contaminated where it and a test item have, without insertions, a common
    stretch of `overlap` tokens or more (the whole item where that is shorter) of which
    `match` are equal. Its longest one is told; ties go to more equal tokens, then the
    smaller item_id. Whole texts are read; null or empty texts on either side match
    nothing; a test item without an id is told as -1. Repeated rows each get their row.
    Documents are not shuffled."""
    plain = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return flagged(plain, benchmark, ("doc_id",), "text", item_id, item_text, overlap, match, limit)


def flagged(docs: DataFrame, benchmark: DataFrame, keep: tuple[str, ...], text: str = "text", item_id: str = "item_id", item_text: str = "text", overlap: int = OVERLAP, match: float = MATCH, limit: int = SEEDS) -> DataFrame:
    """The columns `keep` of each row with contaminated, item_id, overlap and equal beside
    them (in place of columns so named), judged row by row. Test sets beyond `limit` seeds go in several passes over the
    documents, numbered by row for that, so what is sent to the tasks has a fixed bound."""
    found = ("item_id", "overlap", "equal")
    keep = tuple(c for c in keep if c not in (*found, "contaminated"))

    def one(base: DataFrame, test: TestSet, keep: tuple[str, ...]) -> tuple[DataFrame, object]:
        shared = docs.sparkSession.sparkContext.broadcast(test)

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                rows: list[tuple] = [(None, None, None)] * b.num_rows
                for i, h, first in tokens(b.column(b.schema.get_field_index(text))):
                    for row, hit in overlaps(shared.value, h, first, overlap, match).items():
                        rows[i + row] = hit
                cols = [b.column(b.schema.get_field_index(c)) for c in keep]
                cols += [pa.array([r[k] for r in rows], pa.int64()) for k in range(3)]
                yield pa.RecordBatch.from_arrays(cols, names=[*keep, *found])

        sent = base.select(*dict.fromkeys((*keep, text)))
        schema = StructType([sent.schema[c] for c in keep])
        for c in found:
            schema = schema.add(c, LongType())
        return sent.mapInArrow(work, schema), shared

    sets = test_sets(benchmark, item_id, item_text, limit, overlap, match)
    parts = list(itertools.islice(sets, 2))
    if not parts:
        out = docs.select(*keep, *(F.lit(None).cast("long").alias(c) for c in found))
    elif len(parts) == 1:
        out = one(docs, parts[0], keep)[0]
    else:
        base = written(docs.select(*dict.fromkeys((*keep, text))).withColumn("__row", F.monotonically_increasing_id()), "rows")
        hits = None
        for t in itertools.chain(parts, sets):  # one test set is held at a time
            mine, shared = one(base, t, ("__row",))
            mine = written(mine.where("overlap is not null"), "hits")
            shared.destroy()
            hits = mine if hits is None else hits.unionByName(mine)
        best = F.max(F.struct("overlap", "equal", (-F.col("item_id")).alias("less"))).alias("b")
        out = base.join(hits.groupBy("__row").agg(best), "__row", "left").select(*keep, (-F.col("b.less")).alias("item_id"), "b.overlap", "b.equal")
    return out.select(*keep, F.col("overlap").isNotNull().alias("contaminated"), *found)


def op2_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
