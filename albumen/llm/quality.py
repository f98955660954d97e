"""Quality classifier: cumulative-link (ordinal logistic) regression on graded ratings,
with shared weights over hashed text and ordered thresholds between grades."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytesops import LOWER, NOT_WORD, U64, mix, prefix_hash, runs, span_hash, string_bytes, words

BITS = 17  # of hashed features
PER_GRADE = 4000  # training documents a grade at most
RUN = 1 << 20
_SHAPE = 1 << BITS  # shape features come after the hashed words
_BUCKETS, _SHAPES = 12, 7
OPENINGS = (5, 7)  # bytes of a longer word that are a feature too


@dataclass
class Ordinal:
    weights: np.ndarray
    thresholds: np.ndarray  # ascending, one fewer than grades

    def tails(self, scores: np.ndarray) -> np.ndarray:
        """P(grade > k) for each threshold k, as columns."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - scores[:, None], -60, 60)))


def _bucket(x: np.ndarray) -> np.ndarray:
    return np.clip((x * _BUCKETS).astype(np.int64), 0, _BUCKETS - 1)


def _openings(part: np.ndarray, o: np.ndarray) -> np.ndarray:
    """(row << BITS | feature) of the hashed first bytes of longer words, which related words
    share."""
    solid = ~NOT_WORD[part]
    begin = solid.copy()
    begin[1:] &= ~solid[:-1]
    inner = o[1:-1][o[1:-1] < len(part)]
    begin[inner] = solid[inner]
    start = np.flatnonzero(begin)
    sums = prefix_hash(LOWER[part])
    ends = np.concatenate(([0], np.cumsum(~solid)))
    row = np.searchsorted(o, start, side="right") - 1
    out = []
    for k in OPENINGS:
        stop = start + k
        ok = stop < o[row + 1]
        ok[ok] = ends[stop[ok] + 1] == ends[start[ok]]  # the word goes on
        h = mix(span_hash(sums, start[ok], stop[ok]))
        out.append((row[ok] << BITS) | (h >> U64(64 - BITS)).astype(np.int64))
    return np.concatenate(out)


def features(column: pa.Array):
    """(first row, row, feature) per run: the distinct hashed words of each text and their
    openings, and its shape: shares of repeated words, of repeated word pairs, of words that
    follow themselves, of marks, of capitals and of line breaks, and the length."""
    data, offs = string_bytes(column)
    for i, j in runs(offs, RUN):
        o = offs[i : j + 1] - offs[i]
        part = data[offs[i] : offs[j]]
        h, row, first = words(part, o, NOT_WORD)
        n = np.diff(first)
        key = np.unique(np.concatenate(((row.astype(np.int64) << BITS) | (h >> U64(64 - BITS)).astype(np.int64), _openings(part, o))))
        r, f = key >> BITS, key & ((1 << BITS) - 1)
        own = np.unique((row.astype(np.int64) << 30) | (h >> U64(34)).astype(np.int64)) >> 30
        distinct = np.bincount(own, minlength=j - i)
        pair = mix(h[:-1] * U64(31) + h[1:]) if len(h) > 1 else np.zeros(0, U64)
        same = row[:-1] == row[1:] if len(h) > 1 else np.zeros(0, bool)
        pairs = np.unique((row[:-1][same].astype(np.int64) << 30) | (pair[same] >> U64(34)).astype(np.int64)) >> 30 if same.any() else np.zeros(0, np.int64)
        twice = row[:-1][same & (h[:-1] == h[1:])] if len(h) > 1 else np.zeros(0, np.int64)
        n_pairs = np.maximum(1, n - 1)
        size = np.maximum(1, np.diff(o))

        def share(hits: np.ndarray) -> np.ndarray:
            sums = np.concatenate(([0], np.cumsum(hits)))
            return (sums[o[1:]] - sums[o[:-1]]) / size  # noqa: B023

        shape = [
            _bucket(distinct / np.maximum(1, n)),
            _bucket(np.bincount(pairs, minlength=j - i) / n_pairs),
            _bucket(np.sqrt(share(NOT_WORD[part] & (part > 32) & (part != 46) & (part != 44)))),
            np.clip(np.log2(n + 1).astype(np.int64), 0, _BUCKETS - 1),
            _bucket(np.sqrt(np.bincount(twice, minlength=j - i) / n_pairs)),
            _bucket(np.sqrt(share((part >= 65) & (part <= 90)))),
            _bucket(np.sqrt(2 * share(part == 10))),
        ]
        rows = np.concatenate([r, *[np.arange(j - i)] * len(shape)])
        feats = np.concatenate([f, *[_SHAPE + k * _BUCKETS + s for k, s in enumerate(shape)]])
        order = np.argsort(rows, kind="stable")
        yield i, j - i, rows[order], feats[order]


def fit(docs: list[np.ndarray], grades: np.ndarray, weight: np.ndarray, n_grades: int, rounds: int = 400, l2: float = 1.0, least_docs: int = 8) -> Ordinal:
    """Full-batch Adam on the weighted log-likelihood of the cumulative-link model. Grades
    without documents leave their threshold at its prior place; without documents at all
    the model gives every text the same score. Words of fewer than least_docs documents
    have no weight, at every size of the sample. Every text has its shape features."""
    size = _SHAPE + _SHAPES * _BUCKETS
    w = np.zeros(size)
    step = np.full(n_grades - 1, 1.0)  # gaps of the thresholds, kept positive through exp
    step[0] = -(n_grades - 1) / 2
    step[1:] = 0.0
    if not len(docs):
        return Ordinal(w, np.concatenate(([step[0]], step[0] + np.cumsum(np.exp(step[1:])))))
    common = np.bincount(np.concatenate(docs), minlength=size) >= least_docs
    docs = [np.append(d[common[d] & (d < _SHAPE)], d[d >= _SHAPE]) for d in docs]
    flat = np.concatenate(docs)
    at = np.concatenate(([0], np.cumsum([len(d) for d in docs])))
    row = np.repeat(np.arange(len(docs)), np.diff(at))
    weight = weight / weight.sum()
    used, flat = np.unique(flat, return_inverse=True)
    n = len(used)
    x = np.concatenate((np.zeros(n), step))  # weights of the used features, then the steps
    m, v = np.zeros(len(x)), np.zeros(len(x))
    for t in range(1, rounds + 1):
        step = x[n:]
        theta = np.concatenate(([step[0]], step[0] + np.cumsum(np.exp(step[1:]))))
        score = np.add.reduceat(x[flat], at[:-1])
        wide = np.concatenate(([-1e9], theta, [1e9]))
        hi = 1 / (1 + np.exp(np.clip(score - wide[grades + 1], -60, 60)))
        lo = 1 / (1 + np.exp(np.clip(score - wide[grades], -60, 60)))
        p = np.maximum(hi - lo, 1e-12)
        d_hi, d_lo = hi * (1 - hi) / p, lo * (1 - lo) / p
        g_score = weight * (d_hi - d_lo)  # of the negative log-likelihood
        g = np.zeros(len(x))
        g[:n] = np.bincount(flat, weights=g_score[row], minlength=n) + l2 * x[:n] / len(docs)
        g_theta = np.zeros(n_grades + 1)
        np.add.at(g_theta, grades + 1, -weight * d_hi)
        np.add.at(g_theta, grades, weight * d_lo)
        g_theta = g_theta[1:-1]
        g[n] = g_theta.sum()
        for k in range(1, n_grades - 1):
            g[n + k] = g_theta[k:].sum() * np.exp(step[k])
        m = 0.9 * m + 0.1 * g
        v = 0.99 * v + 0.01 * g * g
        x -= 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
    w[used], step = x[:n], x[n:]
    return Ordinal(w, np.concatenate(([step[0]], step[0] + np.cumsum(np.exp(step[1:])))))


def train(docs: DataFrame, ratings: DataFrame, n_grades: int, doc_id: str = "doc_id", text: str = "text", grade: str = "grade", per_grade: int = PER_GRADE) -> Ordinal:
    """Fit on a bounded sample: per_grade slots by the hash of doc_id hold the least id each,
    of every grade; each grade weighs as it does among all ratings. ratings: doc_id and a
    grade from 0; null ids or grades take no part."""
    rated = ratings.where(F.col(doc_id).isNotNull() & F.col(grade).isNotNull()).select(F.col(doc_id).alias("i"), F.col(grade).cast("int").alias("g"))
    count = {r["g"]: r["c"] for r in rated.groupBy("g").agg(F.count("*").alias("c")).collect()}
    some = rated.groupBy("g", F.pmod(F.xxhash64("i"), F.lit(per_grade)).alias("slot")).agg(F.min("i").alias("i")).select("i", "g")
    texts = docs.join(F.broadcast(some), docs[doc_id] == some["i"]).select("i", "g", F.col(text).alias("t"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, n, row, feat in features(b.column(2)):
                cut = np.searchsorted(row, np.arange(n + 1))
                yield pa.RecordBatch.from_pydict({"i": b.column(0).slice(i, n), "g": b.column(1).slice(i, n), "f": pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(feat.astype(np.int32)))})

    found = texts.mapInArrow(work, "i long, g int, f array<int>").orderBy("i", "g").toArrow()
    if not found.num_rows:
        return fit([], np.zeros(0, np.int64), np.zeros(0), n_grades)
    grades = found.column("g").to_numpy().astype(np.int64)
    held = np.bincount(grades, minlength=n_grades)
    weight = np.array([count[int(g)] / held[g] for g in grades])
    return fit([np.array(x, dtype=np.int64) for x in found.column("f").to_pylist()], grades, weight, n_grades)


def grade(df: DataFrame, model: Ordinal, doc_id: str = "doc_id", text: str = "text", least: int = 1, odds: float = 0.5) -> DataFrame:
    """One row per document row: doc_id, expected_grade, tail (probability of a grade of
    `least` or more) and selected (tail >= odds). The whole text counts; a null or empty
    text has only its shape. Repeated rows each get their row. No shuffle."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            for i, n, row, feat in features(b.column(1)):
                tails = m.tails(np.bincount(row, weights=m.weights[feat], minlength=n))
                yield pa.RecordBatch.from_pydict({"doc_id": b.column(0).slice(i, n), "expected_grade": pa.array(tails.sum(axis=1)), "tail": pa.array(tails[:, least - 1])})

    out = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(work, "doc_id long, expected_grade double, tail double")
    return out.withColumn("selected", F.col("tail") >= odds)


def ratings_of(labels: DataFrame) -> DataFrame:
    """Grade 0: toxic; 1: not toxic, poor quality; 2: neither. Repeated labels: the worst."""
    worst = labels.where("doc_id is not null and quality is not null and toxic is not null").groupBy("doc_id").agg(F.min("quality").alias("q"), F.max("toxic").alias("t"))
    return worst.select("doc_id", F.when(F.col("t") == 1, 0).when(F.col("q") == 0, 1).otherwise(2).alias("grade"))


def op8_quality_classifier(spark, sf_dir: str) -> DataFrame:
    from .langid import held_out

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    ratings = ratings_of(spark.read.parquet(f"{sf_dir}/labels.parquet")).where(~held_out("doc_id"))
    model = train(docs, ratings, 3)
    out = grade(docs, model, least=2)
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "expected_grade", "tail", "selected")
