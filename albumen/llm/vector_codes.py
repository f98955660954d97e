"""Vector code compression: product codes whose nearest entries are found in a GNAT (a
tree of split points that keeps, for each pair, the range of distances from one split
point to the other one's subtree)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from . import scratch

#: Distances are widened by this share before a subtree is ruled out: far above the rounding
#: of a square root and a sum of doubles.
SLACK = 2.0**-48
#: Components beyond this (after scaling) are refused: squared distances must fit 64 bits.
LARGEST = 1 << 26
#: Labels with more than this share of all rows are joined by a broadcast of at most 1 / HOT rows.
HOT = 1 / 2000


@dataclass
class _Node:
    splits: np.ndarray
    low: np.ndarray  # low[i, j] .. high[i, j]: distances from split i to all below split j
    high: np.ndarray
    children: list[_Node | None] = field(default_factory=list)


class Gnat:
    """Exact nearest neighbours among integer points, ties to the lower index. A subtree is
    left out only where the stored ranges prove, rounding included, that all in it is
    strictly farther than the best so far; what is compared are integer distances."""

    def __init__(self, points: np.ndarray, arity: int = 4):
        self.points = np.asarray(points, dtype=np.int64)
        self.arity = arity
        self.computed = 0  # distances of all calls
        self.root = self._build(np.arange(len(self.points))) if len(self.points) else None

    def _squared(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        d = a - b
        return np.einsum("...i,...i->...", d, d)

    def _build(self, ids: np.ndarray) -> _Node:
        pts = self.points[ids]
        m = min(self.arity, len(ids))
        chosen = [0]
        to_split = [self._squared(pts, pts[0])]
        while len(chosen) < m:  # the point farthest from all split points so far
            near = np.minimum.reduce(to_split).copy()
            near[chosen] = -1
            chosen.append(int(near.argmax()))
            to_split.append(self._squared(pts, pts[chosen[-1]]))
        squared = np.stack(to_split)
        owner = squared.argmin(axis=0)
        owner[chosen] = np.arange(m)
        dist = np.sqrt(squared.astype(np.float64))
        low, high, children = np.empty((m, m)), np.empty((m, m)), []
        for j in range(m):
            below = owner == j
            low[:, j] = dist[:, below].min(axis=1) * (1 - SLACK)
            high[:, j] = dist[:, below].max(axis=1) * (1 + SLACK)
            below[chosen[j]] = False
            children.append(self._build(ids[below]) if below.any() else None)
        return _Node(ids[chosen], low, high, children)

    def nearest(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index, squared distance) of each row of queries."""
        queries = np.asarray(queries, dtype=np.int64)
        best = np.full(len(queries), np.iinfo(np.int64).max)
        at = np.zeros(len(queries), dtype=np.int64)
        if self.root is not None and len(queries):
            self._visit(self.root, queries, np.arange(len(queries)), best, at)
        return at, best

    def _visit(self, node: _Node, queries: np.ndarray, rows: np.ndarray, best: np.ndarray, at: np.ndarray) -> None:
        m = len(node.splits)
        alive = np.ones((m, len(rows)), dtype=bool)
        for i in range(m):
            here = np.flatnonzero(alive[i])
            if not len(here):
                continue
            who = rows[here]
            squared = self._squared(queries[who], self.points[node.splits[i]])
            self.computed += len(who)
            better = (squared < best[who]) | ((squared == best[who]) & (node.splits[i] < at[who]))
            best[who[better]], at[who[better]] = squared[better], node.splits[i]
            d = np.sqrt(squared.astype(np.float64))
            reach = np.sqrt(best[who].astype(np.float64)) * (1 + SLACK)
            inner, outer = d * (1 - SLACK) - reach, d * (1 + SLACK) + reach
            for j in range(m):
                if j == i or (j < i and node.children[j] is None):
                    continue
                alive[j, here[(inner > node.high[i, j]) | (outer < node.low[i, j])]] = False
        for j, child in enumerate(node.children):
            if child is not None and alive[j].any():
                self._visit(child, queries, rows[alive[j]], best, at)


@dataclass
class Codebooks:
    entries: list[np.ndarray]  # one (entries, width) array of integers for each part

    def digest(self) -> str:
        return hashlib.sha256(",".join(str(x) for book in self.entries for x in book.reshape(-1).tolist()).encode()).hexdigest()


def _matrix(column: pa.Array, kind=np.int64) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    width = len(flat) // max(1, len(column))
    if (np.diff(column.offsets.to_numpy()) != width).any():
        raise ValueError("vectors must have one length")
    return flat.astype(kind).reshape(len(column), width)


def integer_vectors(df: DataFrame, vec_id: str, vector: str, label: str | None, scale: int, parts: int) -> DataFrame:
    """(vec_id, label, v): the rows that take part, with components floor(scale * x)."""
    kind = df.schema[label].dataType if label else IntegerType()
    schema = StructType([StructField("vec_id", LongType()), StructField("label", kind)])
    rows = df.select(F.col(vec_id).cast("long").alias("vec_id"), (F.col(label) if label else F.lit(None).cast("int")).alias("label"), F.col(vector).cast("array<double>").alias("v"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(batch.column(2).is_valid())
            column = batch.column(2)
            sizes = np.diff(column.offsets.to_numpy())
            flat = column.flatten().to_numpy(zero_copy_only=False)
            bad = np.concatenate(([0], np.cumsum(~np.isfinite(flat))))
            ends = np.concatenate(([0], np.cumsum(sizes)))
            fine = bad[ends[1:]] == bad[ends[:-1]]
            batch, sizes = batch.filter(pa.array(fine)), sizes[fine]
            if not batch.num_rows:
                continue
            width = int(sizes[0])
            if width % parts or (sizes != width).any():
                raise ValueError(f"vectors must have one length that {parts} parts divide; here {sorted(set(sizes.tolist()))[:5]}")
            scaled = np.floor(float(scale) * _matrix(batch.column(2), np.float64))
            if scaled.size and np.abs(scaled).max() > LARGEST:
                raise ValueError(f"a component of more than {LARGEST} / {scale} leaves no room for squared distances in 64 bits")
            v = pa.ListArray.from_arrays(pa.array(np.arange(len(scaled) + 1, dtype=np.int32) * width), pa.array(scaled.reshape(-1).astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), v], names=["vec_id", "label", "v"])

    return rows.mapInArrow(work, schema.add("v", ArrayType(IntegerType())))


def _search(books: list[np.ndarray]):
    """For one task: rows of integers -> (codes, squared distances), both rows x parts."""
    trees = [Gnat(b) for b in books]
    width = books[0].shape[1]

    def assign(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if v.shape[1] != width * len(books):
            raise ValueError("vectors must have one length")
        found = [t.nearest(v[:, p * width : (p + 1) * width]) for p, t in enumerate(trees)]
        return np.stack([f[0] for f in found], axis=1), np.stack([f[1] for f in found], axis=1)

    return assign


def train(rows: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6) -> Codebooks | None:
    """Codebooks of the written rows of integer_vectors; None without rows. Each round is one
    pass: tasks assign and add up, Spark sums, and only entries x width sums a part come
    to the driver."""
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).collect()
    if not first:
        return None
    if len({len(r["v"]) for r in first}) > 1:
        raise ValueError("vectors must have one length")
    seeds = np.array([r["v"] for r in first], dtype=np.int64)
    width = seeds.shape[1] // parts
    books = [seeds[:, p * width : (p + 1) * width].copy() for p in range(parts)]
    if not width:
        return Codebooks(books)

    for _ in range(rounds):

        def sums(batches: Iterator[pa.RecordBatch], books=books) -> Iterator[pa.RecordBatch]:
            assign = _search(books)
            total = [np.zeros(b.shape, np.int64) for b in books]
            count = [np.zeros(len(b), np.int64) for b in books]
            for batch in batches:
                if not batch.num_rows:
                    continue
                v = _matrix(batch.column(0))
                codes, _ = assign(v)
                for p in range(len(books)):
                    count[p] += np.bincount(codes[:, p], minlength=len(count[p]))
                    for x in range(width):
                        # a batch's sums are below 2 ** 53, so that doubles hold them exactly
                        total[p][:, x] += np.bincount(codes[:, p], weights=v[:, p * width + x], minlength=len(count[p])).astype(np.int64)
            p, e = (g.reshape(-1) for g in np.meshgrid(np.arange(len(books)), np.arange(len(books[0])), indexing="ij"))
            used = np.concatenate(count) > 0
            names = ["part", "entry", "n", "place", "total"]
            for x in range(width):
                cols = [p[used].astype(np.int32), e[used].astype(np.int32), np.concatenate(count)[used], np.full(used.sum(), x, np.int32), np.concatenate([t[:, x] for t in total])[used]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=names)

        partial = rows.select("v").mapInArrow(sums, "part int, entry int, n long, place int, total long")
        books = [b.copy() for b in books]
        for r in partial.groupBy("part", "entry", "place").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect():
            books[r["part"]][r["entry"], r["place"]] = r["total"] // r["n"]
    return Codebooks(books)


def encode(rows: DataFrame, books: Codebooks) -> DataFrame:
    """(vec_id, label, code, error): the index of each part's nearest entry as hex digits, two
    a part (more where a codebook has over 256 entries), and the squared distances' sum."""
    entries = books.entries
    digits = max(2, len(f"{len(entries[0]) - 1:x}"))
    schema = StructType([rows.schema["vec_id"], rows.schema["label"]]).add("code", StringType()).add("error", LongType())

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        assign = _search(entries)
        text = np.array([f"{i:0{digits}x}" for i in range(len(entries[0]))], dtype=object)
        for batch in batches:
            if not batch.num_rows:
                continue
            v = _matrix(batch.column(2))
            codes, squared = assign(v)
            code = pa.array(["".join(r) for r in text[codes].tolist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), code, pa.array(squared.sum(axis=1))], names=schema.names)

    return rows.select("vec_id", "label", "v").mapInArrow(work, schema)


def decode(codes: DataFrame, books: Codebooks, scale: int = 4096, code: str = "code", to: str = "vector") -> DataFrame:
    """codes with a column of the approximate vectors (entries / scale)."""
    entries = books.entries
    digits = max(2, len(f"{len(entries[0]) - 1:x}"))

    @F.pandas_udf("array<double>")
    def approx(column):
        return column.map(lambda c: None if c is None else np.concatenate([b[int(c[i * digits : (i + 1) * digits], 16)] for i, b in enumerate(entries)]) / scale)

    return codes.withColumn(to, approx(code))


def with_label_errors(coded: DataFrame) -> DataFrame:
    """coded (written) with label_error: the sum of error over rows of an equal label, nulls
    together. Labels that hold over HOT of all rows are at most 1 / HOT and are broadcast;
    the others are joined, and no key of that join is hot."""
    spark = coded.sparkSession
    totals = scratch.written(coded.groupBy("label").agg(F.sum("error").alias("label_error"), F.count("*").alias("n")), "label-errors")
    least = (totals.agg(F.sum("n")).first()[0] or 0) * HOT
    hot, rest = totals.where(F.col("n") > least).drop("n"), totals.where(F.col("n") <= least).drop("n")
    few = F.broadcast(hot.withColumnRenamed("label", "hot_label"))
    joined = coded.join(few, coded["label"].eqNullSafe(F.col("hot_label")), "left")
    done = joined.where("label_error is not null").drop("hot_label")
    if rest.isEmpty():
        return done
    other = rest.withColumnRenamed("label", "rest_label")
    left = joined.where("label_error is null").drop("hot_label", "label_error")
    return done.unionByName(left.join(other.hint("merge"), left["label"].eqNullSafe(other["rest_label"])).drop("rest_label"))


def compress(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str | None = "label", parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> tuple[DataFrame, Codebooks | None]:
    """(vec_id, label, code, error, label_error of each kept row; the codebooks).

    Rows whose vector is null or holds null, NaN or an infinity are left out. Components become
    floor(scale * x); each part's codebook starts with the parts of the rows of least
    vec_id (equal ids by vector, null ids last); with fewer rows than entries it is
    smaller. A round replaces each entry by the floor of its parts' mean; entries without
    parts stay. Rows with a null or a repeated vec_id, and repeated rows, are rows like all
    others; null labels are one label. Other columns are not read. No rows give none, and
    no codebooks. Vectors of several lengths, of a length that parts don't divide, and
    components too large for 64-bit distances are refused with a ValueError.

    The integers are written once; each round reads them, and shuffles entries x width sums a
    task. Tasks hold one Arrow batch."""
    rows = scratch.written(integer_vectors(df, vec_id, vector, label, scale, parts), "vectors")
    books = train(rows, parts, entries, rounds)
    if books is None:
        empty = rows.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"))
        return empty, None
    if not books.entries[0].shape[1]:  # vectors without components: every entry is at distance 0
        coded = rows.select("vec_id", "label", F.lit("00" * parts).alias("code"), F.lit(0).cast("long").alias("error"))
    else:
        coded = encode(rows, books)
    return with_label_errors(scratch.written(coded, "codes")), books


def op13_vector_codes(spark, sf_dir: str) -> DataFrame:
    with scratch.tidy(spark):
        out, books = compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return out.select("vec_id", "code", "error", "label_error", F.lit(books.digest() if books else "").alias("codebooks_sha256"))


def oracle() -> str:
    """The rounds as one common table expression each."""
    nearest = """near{k} AS MATERIALIZED (SELECT vec_id, row, j, x, min({{'d': d, 'e': e}}) AS b FROM (
  SELECT vec_id, row, p.j, x, e, CAST(list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d
  FROM part p JOIN book{k} b ON p.j = b.j) GROUP BY vec_id, row, j, x)"""
    update = """sum{k} AS (SELECT j, b.e AS e, i, CAST(sum(x[i]) AS BIGINT) AS s, count(*) AS n FROM near{k}, range(1, 1 + (SELECT any_value(w) FROM kept)) t(i) GROUP BY j, b.e, i),
mean{k} AS (SELECT j, e, list((s - ((s % n) + n) % n) // n ORDER BY i) AS c FROM sum{k} GROUP BY j, e),
book{next} AS MATERIALIZED (SELECT o.j, o.e, coalesce(m.c, o.c) AS c FROM book{k} o LEFT JOIN mean{k} m ON o.j = m.j AND o.e = m.e)"""
    steps = ",\n".join(nearest.format(k=k) + (",\n" + update.format(k=k, next=k + 1) if k < 6 else "") for k in range(7))
    return f"""WITH kept AS MATERIALIZED (SELECT vec_id, label, v, len(v) // 8 AS w, row_number() OVER (ORDER BY vec_id, v) AS row FROM (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)),
part AS MATERIALIZED (SELECT vec_id, row, j, v[j * w + 1:(j + 1) * w] AS x FROM kept, range(8) t(j)),
book0 AS MATERIALIZED (SELECT j, row - 1 AS e, x AS c FROM part WHERE row <= 16),
{steps},
code AS (SELECT row, string_agg(printf('%02x', b.e), '' ORDER BY j) AS code, CAST(sum(b.d) AS BIGINT) AS error FROM near6 GROUP BY row),
whole AS (SELECT sha256(string_agg(y, ',' ORDER BY j, e)) AS h FROM (SELECT j, e, array_to_string(c, ',') AS y FROM book6))
SELECT k.vec_id, c.code, c.error, CAST(sum(c.error) OVER (PARTITION BY k.label) AS BIGINT) AS label_error, (SELECT h FROM whole) AS codebooks_sha256
FROM kept k JOIN code c ON k.row = c.row"""
