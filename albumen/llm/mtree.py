"""Exact top-k by inner product with M-trees: paged metric nodes with covering radii
and parent distances, searched best first.

Vectors are placed in a metric space where a nearer point has a larger inner product:
x becomes (x, sqrt(M - |x|^2)) with M the largest squared length, a query (q, 0); the
squared distance is |q|^2 + M - 2 q.x."""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import tidy, written

PIVOTS = 16  # routing objects of the top level, sent to every task
SUBTREE = 8192  # vectors that one subtree aims at
PAGE = 1024  # entries of a node
BLOCK = 2048  # queries that one row carries to a subtree
EXACT = 2.0**53  # squared lengths below which products of floats are exact
SLACK = 1e-6


@dataclass
class Node:
    """Entries: children (routing objects with radii), or the vectors of a page: `at` is
    where they begin in the tree's arrays."""

    pivot: np.ndarray
    radius: float
    to_parent: float
    rows: np.ndarray | None = None  # of the vectors as given, while the tree is built
    at: int = -1
    to_pivot: np.ndarray | None = None  # of the vectors, ascending
    children: list[Node] = field(default_factory=list)
    pivots: np.ndarray | None = None
    radii: np.ndarray | None = None
    parent_distances: np.ndarray | None = None


def lifted(x: np.ndarray, most: float) -> np.ndarray:
    x = x.astype(np.float64)
    return np.concatenate([x, np.sqrt(np.maximum(0.0, most - (x * x).sum(axis=1)))[:, None]], axis=1)


def build(points: np.ndarray, rows: np.ndarray, pivot: np.ndarray, to_parent: float) -> Node:
    """Bulk load: a node's routing objects are chosen farthest first, every point goes to
    the nearest, and equal points fill pages by number."""
    d = np.sqrt(((points[rows] - pivot) ** 2).sum(axis=1))
    node = Node(pivot, float(d.max()) if len(d) else 0.0, to_parent)
    if len(rows) <= PAGE:
        order = np.argsort(d, kind="stable")
        node.rows, node.to_pivot = rows[order], d[order]
        return node
    chosen = [int(np.argmin(d))]
    near = np.sqrt(((points[rows] - points[rows[chosen[0]]]) ** 2).sum(axis=1))
    nearest = np.zeros(len(rows), dtype=np.int64)
    for k in range(1, min(PAGE, max(2, len(rows) // PAGE + 1))):
        far = int(np.argmax(near))
        if near[far] == 0:
            break
        chosen.append(far)
        other = np.sqrt(((points[rows] - points[rows[far]]) ** 2).sum(axis=1))
        closer = other < near
        nearest[closer], near[closer] = k, other[closer]
    if len(chosen) == 1:
        groups = [rows[i : i + max(PAGE, -(-len(rows) // PAGE))] for i in range(0, len(rows), max(PAGE, -(-len(rows) // PAGE)))]
        centres = [points[rows[chosen[0]]]] * len(groups)
    else:
        groups = [rows[nearest == k] for k in range(len(chosen))]
        centres = [points[rows[c]] for c in chosen]
    for g, c in zip(groups, centres, strict=True):
        node.children.append(build(points, g, c, float(np.sqrt(((c - pivot) ** 2).sum()))))
    node.pivots = np.stack([c.pivot for c in node.children])
    node.radii = np.array([c.radius for c in node.children])
    node.parent_distances = np.array([c.to_parent for c in node.children])
    return node


@dataclass
class Tree:
    """A subtree whose vectors lie page by page, so that a page is one slice."""

    root: Node
    ids: np.ndarray
    vectors: np.ndarray


def planted(ids: np.ndarray, vectors: np.ndarray, most: float) -> Tree:
    points = lifted(vectors, most)
    root = build(points, np.arange(len(ids)), points[0], 0.0)
    order, at, todo = [], 0, [root]
    while todo:
        node = todo.pop()
        if node.rows is not None:
            node.at, at = at, at + len(node.rows)
            order.append(node.rows)
            node.rows = None
        todo += node.children
    rows = np.concatenate(order)
    return Tree(root, ids[rows], vectors[rows])


def search(tree: Tree, q: np.ndarray, own: int, k: int, most: float, floor: float) -> tuple[list[tuple[int, int]], int]:
    """(the k best (score, -id) of a subtree for an integer query, distances computed);
    floor: a score that k rows elsewhere are known to reach. Nodes are taken nearest
    bound first; a node or row is skipped, without its distance, where the stored
    distances to the parent already put it beyond the k-th best."""
    q2 = float((q.astype(np.float64) ** 2).sum())
    lift = np.append(q.astype(np.float64), 0.0)
    q = q.astype(tree.vectors.dtype)
    best: list[tuple[int, int]] = []
    limit = np.sqrt(max(0.0, q2 + most - 2 * floor)) * (1 + SLACK) + SLACK if np.isfinite(floor) else np.inf
    d0 = float(np.sqrt(((lift - tree.root.pivot) ** 2).sum()))
    heap = [(max(0.0, d0 - tree.root.radius), 0, d0, tree.root)]
    count, done = 1, 1
    while heap:
        bound, _, d, node = heapq.heappop(heap)
        if bound > limit:
            break
        if node.children:
            maybe = np.flatnonzero(np.abs(d - node.parent_distances) - node.radii <= limit)
            if not len(maybe):
                continue
            ds = np.sqrt(((node.pivots[maybe] - lift) ** 2).sum(axis=1))
            done += len(maybe)
            low = np.maximum(0.0, ds - node.radii[maybe])
            for i, x, y in zip(maybe.tolist(), ds.tolist(), low.tolist(), strict=True):
                if y <= limit:
                    heapq.heappush(heap, (y, count, x, node.children[i]))
                    count += 1
            continue
        a = int(np.searchsorted(node.to_pivot, d - limit))
        b = int(np.searchsorted(node.to_pivot, d + limit, side="right"))
        if a == b:
            continue
        done += b - a
        scores = tree.vectors[node.at + a : node.at + b] @ q
        least = best[0][0] if len(best) == k else floor
        if len(scores) > k + 1:  # one of them may be the query's own
            least = max(least, float(np.partition(scores, -k - 1)[-k - 1]))
        good = np.flatnonzero(scores >= least)
        for s, i in zip(scores[good].tolist(), tree.ids[node.at + a + good].tolist(), strict=True):
            if i == own:
                continue
            if len(best) < k:
                heapq.heappush(best, (int(s), -i))
            elif (s, -i) > best[0]:
                heapq.heapreplace(best, (int(s), -i))
        if len(best) == k:
            kth = q2 + most - 2 * max(best[0][0], floor)
            limit = min(limit, np.sqrt(max(0.0, kth)) * (1 + SLACK) + SLACK)
    return best, done


def quantised(df: DataFrame, id: str, vector: str, scale: int) -> DataFrame:
    """(id, v): floor(scale * x) of each component; rows with a null id or vector, or with
    a component that is null or not finite, are left out."""
    v = F.col(vector)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x.cast("double")) | x.cast("double").isin(float("inf"), float("-inf")))
    ints = F.transform(v, lambda x: F.floor(x.cast("double") * F.lit(float(scale))).cast("long"))
    return df.where(F.col(id).isNotNull() & v.isNotNull() & ~bad).select(F.col(id).cast("long").alias("id"), ints.alias("v"))


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """vectors, queries: (id long, v array<long>). Returns query_id, rank, vec_id, score:
    for each query row the k rows of other ids with the largest inner product (all of them,
    if fewer), ties to the smaller id. Vectors of another length than the query's take no
    part; repeated rows are candidates of their own, and a repeated query row has its own
    result. Empty inputs give no rows.

    Vectors are dealt to subtrees by their nearest of a fixed number of routing objects
    and, within those, by number, so that a hot one is split. Each subtree is built once,
    one M-tree of bounded size, and written. Queries travel in blocks: first to the subtrees
    of their nearest routing object; their k-th score so far then decides by the covering
    radii which other subtrees are opened. A task holds one subtree and one block."""
    spark = vectors.sparkSession
    vectors = vectors.withColumn("dim", F.size("v"))
    queries = queries.withColumn("dim", F.size("v"))
    norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    size = vectors.agg(F.count("*").alias("n"), F.max(norm).alias("most")).first()
    if not size["n"]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    most = float(size["most"])
    exact = max(most, float(queries.agg(F.max(norm)).first()[0] or 0)) < EXACT
    picked = vectors.orderBy(F.xxhash64("id", "v"), "id").limit(PIVOTS).select("v").collect()
    by_dim: dict[int, list] = {}
    for r in picked:
        by_dim.setdefault(len(r["v"]), []).append(r["v"])
    by_dim = {d: lifted(np.unique(np.array(v, dtype=np.int64).reshape(len(v), d), axis=0), most) for d, v in by_dim.items()}
    routing = spark.sparkContext.broadcast(by_dim)
    parts = max(1, -(-size["n"] // (PIVOTS * SUBTREE)))

    def nearest(v: pd.Series, query: bool) -> tuple[np.ndarray, np.ndarray]:
        out, far = np.zeros(len(v), np.int64), np.zeros(len(v))
        dims = v.map(len).to_numpy()
        for d in np.unique(dims):
            at = np.flatnonzero(dims == d)
            if d not in routing.value:
                continue
            x = np.array(v.iloc[at].tolist(), dtype=np.int64).reshape(len(at), d)
            x = np.concatenate([x.astype(np.float64), np.zeros((len(x), 1))], axis=1) if query else lifted(x, most)
            p = routing.value[d]
            d2 = (x * x).sum(axis=1)[:, None] + (p * p).sum(axis=1)[None, :] - 2 * x @ p.T
            out[at] = d2.argmin(axis=1)
            far[at] = np.sqrt(np.maximum(0, d2.min(axis=1)))
        return out, far

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pivot, far = nearest(pdf["v"], False)
            yield pdf.assign(pivot=pivot, far=far)

    def plant(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.array(pdf["v"].tolist(), dtype=np.int64).reshape(len(pdf), -1)
        tree = planted(pdf["id"].to_numpy(), x.astype(np.float64) if exact else x, most)
        if exact and np.abs(x).max(initial=0) < 1 << 31:
            tree.vectors = tree.vectors.astype(np.int32)
        return pdf.iloc[:1][["dim", "pivot", "part"]].assign(radius=pdf["far"].max(), data=pickle.dumps(tree))

    def routed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pivot, _ = nearest(pdf["v"], True)
            yield pdf.assign(pivot=pivot)

    def blocks(asks: pd.DataFrame) -> pd.DataFrame:
        """Queries (dim, pivot, row, id, v, floor) as one row a routing object and BLOCK."""
        rows = []
        for (dim, pivot), some in asks.groupby(["dim", "pivot"]):
            for lo in range(0, len(some), BLOCK):
                c = some.iloc[lo : lo + BLOCK]
                q = np.array(c["v"].tolist(), dtype=np.int64).reshape(len(c), dim)
                rows.append((dim, pivot, pickle.dumps((c["row"].to_numpy(), c["id"].to_numpy(), q, c["floor"].to_numpy(dtype=float)))))
        return pd.DataFrame(rows, columns=["dim", "pivot", "data"])

    def searched(asks: DataFrame) -> DataFrame:
        """Every block against each subtree of its routing object: the subtree comes first
        in its task, then its blocks one after the other."""
        sent = asks.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).withColumn("kind", F.lit(1))
        both = trees.select("dim", "pivot", "part", "data", F.lit(0).alias("kind")).unionByName(sent)
        key = ["dim", "pivot", "part"]

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            place, tree = None, None
            for pdf in batches:
                for r in pdf.itertuples(index=False):
                    here = (r.dim, r.pivot, r.part)
                    if r.kind == 0:
                        place, tree = here, pickle.loads(r.data)
                        if exact:
                            tree.vectors = tree.vectors.astype(np.float64)
                    elif here == place:
                        rows: list[tuple] = []
                        for row, own, q, floor in zip(*pickle.loads(r.data), strict=True):
                            found, _ = search(tree, q, own, k, most, float("-inf") if np.isnan(floor) else floor)
                            rows += [(row, own, -i, s) for s, i in found]
                        yield pd.DataFrame(rows, columns=["row", "query_id", "vec_id", "score"], dtype="int64")

        return both.repartition(*key).sortWithinPartitions(*key, "kind").mapInPandas(run, "row long, query_id long, vec_id long, score long")

    with tidy(spark):
        salt = F.pmod(F.xxhash64("id", "v"), F.lit(parts)).cast("int")
        dealt = vectors.mapInPandas(deal, "id long, v array<long>, dim int, pivot long, far double").withColumn("part", salt)
        trees = written(dealt.groupBy("dim", "pivot", "part").applyInPandas(plant, "dim int, pivot long, part int, radius double, data binary"), "trees")
        near = written(queries.mapInPandas(routed, "id long, v array<long>, dim int, pivot long").withColumn("row", F.monotonically_increasing_id()), "queries")

        def home(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                yield blocks(pdf.assign(floor=np.nan))

        first = written(searched(near.mapInPandas(home, "dim int, pivot long, data binary")), "first")
        kth = first.groupBy("row").agg(F.slice(F.sort_array(F.collect_list("score"), False), 1, k).alias("s"))
        floors = kth.where(F.size("s") == k).select("row", F.element_at("s", k).cast("double").alias("floor"))
        radii = trees.groupBy("dim", "pivot").agg(F.max("radius").alias("radius"))
        radii = radii.groupBy("dim").agg(F.collect_list(F.struct("pivot", "radius")).alias("radii"))  # at most PIVOTS a length

        def opened(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                rows = []
                for r in pdf.itertuples(index=False):
                    q = np.append(np.array(r.v, dtype=np.float64), 0.0)
                    p = routing.value.get(int(r.dim))
                    d = np.sqrt(((p - q) ** 2).sum(axis=1)) if p is not None else np.zeros(1)
                    limit = np.inf if pd.isna(r.floor) else np.sqrt(max(0.0, (q * q).sum() + most - 2 * r.floor)) * (1 + SLACK) + SLACK
                    for t in r.radii:
                        if t["pivot"] != r.pivot and d[t["pivot"]] - t["radius"] <= limit:
                            rows.append((r.dim, t["pivot"], r.row, r.id, r.v, r.floor))
                yield blocks(pd.DataFrame(rows, columns=["dim", "pivot", "row", "id", "v", "floor"]))

        rest = near.join(floors, "row", "left").join(radii, "dim").mapInPandas(opened, "dim int, pivot long, data binary")
        found = written(first.unionByName(searched(rest)), "found")
    order = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op5_exact_top_k(spark, sf_dir: str) -> DataFrame:
    vectors = quantised(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding", 256)
    return top_k(vectors, vectors.where("id % 50 = 0"), 5)


def oracle() -> str:
    return """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(CAST(q.e AS DOUBLE[]), CAST(c.e AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5"""
