"""Ranked lexical search by pipelined term partitioning: bundles of items carry sparse
accumulators of documents through the owners of the terms, one after the other."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from . import scratch

#: Letters and digits make terms, all bytes over 127 too; only A-Z are lower-cased.
_FOLD = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256)).lower()
_GAP = re.compile(rb"[^0-9A-Za-z\x80-\xff]")
WINDOW = 1 << 20  # bytes of a text that are split at once
CHUNK_DOCS, CHUNK_PAIRS = 8192, 1 << 21  # a chunk of documents is closed at either
BUNDLE = 256  # items that travel together
BLOCK_ITEMS, BLOCK_TERMS = 2048, 1 << 18  # items answered by one pass over the documents
UNIT = 1_000_000  # an occurrence's contribution is below weight * UNIT

_ACCUMULATORS = "chunk long, bundle int, item int, idx array<int>, score array<long>"
_POSTINGS = "chunk long, term int, ids array<long>, idx array<int>, tf array<long>, n array<long>, docs long, terms long"


def terms_of(raw: bytes) -> Iterator[list[bytes]]:
    """The terms of a whole text, in lists of about WINDOW bytes that end between terms."""
    at = 0
    while at < len(raw):
        end = len(raw)
        if at + WINDOW < end:
            cut = _GAP.search(raw, at + WINDOW)
            end = cut.start() if cut else end
        yield raw[at:end].translate(_FOLD).split()
        at = end


@dataclass
class Block:
    """Items that one pass answers: their ids and terms (numbers in vocab, with counts)."""

    ids: list
    counts: list[dict[int, int]]
    vocab: dict[bytes, int]


def blocks(items: DataFrame, item_id: str, text: str) -> Iterator[Block]:
    """The items in blocks of bounded size; the driver holds one block at a time."""
    block = Block([], [], {})
    for key, value in items.select(item_id, text).toLocalIterator():
        counts: Counter = Counter()
        for part in terms_of((value or "").encode()):
            counts.update(part)
        if not counts:
            continue
        if block.ids and (len(block.ids) >= BLOCK_ITEMS or len(block.vocab) + len(counts) > BLOCK_TERMS):
            yield block
            block = Block([], [], {})
        block.ids.append(key)
        block.counts.append({block.vocab.setdefault(t, len(block.vocab)): c for t, c in counts.items()})
    if block.ids:
        yield block


def postings(docs: DataFrame, doc_id: str, text: str, vocab: dict[bytes, int]) -> DataFrame:
    """Postings of the terms of vocab by chunk of documents. For each chunk: a row a term with
    the places (idx), occurrences (tf) and lengths (n) of the documents that hold it, and a row
    with term -1 that has the doc_ids by place, and how many documents and terms there are."""
    shared = docs.sparkSession.sparkContext.broadcast(vocab)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        get = shared.value.get
        chunk = TaskContext.get().partitionId() << 32
        names = ["chunk", "term", "ids", "idx", "tf", "n", "docs", "terms"]
        ids: list = []
        hits: list[tuple[int, int, int]] = []
        sizes: list[int] = []
        found = total = 0

        def flush():
            nonlocal chunk, ids, hits, sizes, found, total
            table = np.array(hits, dtype=np.int64).reshape(-1, 3)
            order = np.argsort(table[:, 0], kind="stable")
            term, idx, tf = table[order].T
            n = np.array(sizes, dtype=np.int64)[idx] if len(idx) else idx
            starts = np.flatnonzero(np.concatenate(([True], term[1:] != term[:-1]))) if len(term) else np.zeros(0, np.int64)
            k = len(starts)
            offsets = np.append(starts, len(term)).astype(np.int32)
            nothing = np.zeros(k + 1, np.int32)
            head = lambda x: pa.concat_arrays([pa.array([x], type=pa.list_(pa.int64()))] + ([pa.ListArray.from_arrays(pa.array(nothing), pa.array([], pa.int64()))] if k else []))
            lists = lambda values, kind: pa.concat_arrays([pa.array([[]], type=pa.list_(kind))] + ([pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))] if k else []))
            one = lambda x: pa.array([x] + [0] * k, pa.int64())
            out = pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(k + 1, chunk)),
                    pa.array(np.append(-1, term[starts]).astype(np.int32)),
                    head(ids),
                    lists(idx.astype(np.int32), pa.int32()),
                    lists(tf, pa.int64()),
                    lists(n, pa.int64()),
                    one(found),
                    one(total),
                ],
                names=names,
            )
            chunk += 1
            ids, hits, sizes, found, total = [], [], [], 0, 0
            return out

        for batch in batches:
            for key, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = raw.as_buffer()
                if raw is None:
                    continue
                n, counts = 0, Counter()
                for part in terms_of(raw.to_pybytes()):
                    n += len(part)
                    counts.update(map(get, part))
                counts.pop(None, None)
                found, total = found + (n > 0), total + n
                if counts:
                    place = len(ids)
                    ids.append(key)
                    sizes.append(n)
                    hits += [(t, place, c) for t, c in counts.items()]
                    if len(ids) >= CHUNK_DOCS or len(hits) >= CHUNK_PAIRS:
                        yield flush()
        if found:
            yield flush()

    return docs.select(F.col(doc_id).cast("long"), F.col(text).cast("binary")).mapInArrow(work, _POSTINGS)


def weight(docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * docs + 2) / (2 * df + 1)))


def owners_of(df: np.ndarray, owners: int) -> np.ndarray:
    """The owner of each term: rare terms first, each owner with about as many postings."""
    order = np.argsort(df, kind="stable")
    before = np.cumsum(df[order]) - df[order]
    out = np.empty(len(df), dtype=np.int32)
    out[order] = np.minimum(before * owners // max(1, int(df.sum())), owners - 1)
    return out


def _largest(scores: np.ndarray, k: int) -> int:
    return int(np.partition(scores, len(scores) - k)[len(scores) - k]) if len(scores) >= k else 0


def _numbers(column, i: int) -> np.ndarray:
    return column[i].values.to_numpy(zero_copy_only=False)


def _stage(block: Block, weights: np.ndarray, owner: np.ndarray, s: int, last: bool, docs: int, terms: int, k: int):
    """What owner s does with a bundle and its own postings of one chunk: it adds its terms'
    contributions to the bundle's accumulators. A document that can't reach the k-th best of
    its chunk by all that later owners may add is left out: k documents of the chunk will
    end strictly above it. The last owner gives each item's k best of the chunk."""
    rest = [sum(c * int(weights[t]) * UNIT for t, c in counts.items() if owner[t] > s) for counts in block.counts]

    def work(key, left: pa.Table, right: pa.Table) -> pa.Table:
        chunk, bundle = key[0].as_py(), key[1].as_py()
        left, right = left.combine_chunks(), right.combine_chunks()
        given: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        size, ids = 0, None
        add: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        cols = {c: right.column(c) for c in ("term", "ids", "idx", "tf", "n")}
        for i, t in enumerate(cols["term"].to_pylist()):
            if t < 0:
                ids = cols["ids"][i].as_py()
                continue
            idx, tf, n = (_numbers(cols[c], i) for c in ("idx", "tf", "n"))
            m = 75 + (25 * n * docs) // terms
            add[t] = (idx, int(weights[t]) * ((1_000_000_000 * tf) // (1000 * tf + 12 * m)))
            size = max(size, int(idx[-1]) + 1)
        for i, item in enumerate(left.column("item").to_pylist()):
            given[item] = (_numbers(left.column("idx"), i), _numbers(left.column("score"), i))
            if len(given[item][0]):
                size = max(size, int(given[item][0][-1]) + 1)
        out: list = []
        total = np.zeros(size, dtype=np.int64)
        for item in range(bundle * BUNDLE, min((bundle + 1) * BUNDLE, len(block.ids))):
            mine = [(t, c) for t, c in block.counts[item].items() if t in add]
            if not mine and item not in given:
                continue
            total[:] = 0
            if item in given:
                total[given[item][0]] = given[item][1]
            for t, c in mine:
                idx, score = add[t]
                total[idx] += c * score
            at = np.flatnonzero(total)
            score = total[at]
            if not len(at):
                continue
            floor = _largest(score, k)
            keep = score + rest[item] >= floor
            out.append((item, at[keep].astype(np.int32), score[keep]))
        if not last:
            return pa.table(
                {
                    "chunk": pa.array([chunk] * len(out), pa.int64()),
                    "bundle": pa.array([bundle] * len(out), pa.int32()),
                    "item": pa.array([o[0] for o in out], pa.int32()),
                    "idx": pa.array([o[1] for o in out], pa.list_(pa.int32())),
                    "score": pa.array([o[2] for o in out], pa.list_(pa.int64())),
                }
            )
        best = []
        for item, at, score in out:
            rows = sorted(((-x, ids[a] is None, ids[a] or 0, a) for a, x in zip(at.tolist(), score.tolist(), strict=True)))[:k]
            best += [(item, None if none else doc, -x, chunk, a) for x, none, doc, a in rows]
        columns = list(zip(*best, strict=True)) if best else [()] * 5
        kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32())
        return pa.table([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["item", "doc_id", "score", "chunk", "place"])

    return work


def _answer(spark: SparkSession, block: Block, docs: DataFrame, doc_id: str, text: str, k: int, owners: int, id_field: StructField) -> DataFrame | None:
    table = scratch.written(postings(docs, doc_id, text, block.vocab), "postings")
    have = table.where("term < 0").agg(F.sum("docs").alias("docs"), F.sum("terms").alias("terms")).first()
    if not have["docs"]:
        return None
    df = np.zeros(len(block.vocab), dtype=np.int64)
    for r in table.where("term >= 0").groupBy("term").agg(F.sum(F.size("idx")).alias("df")).collect():
        df[r["term"]] = r["df"]
    weights = np.array([weight(have["docs"], d) for d in df.tolist()], dtype=np.int64)
    owner = owners_of(df, owners)
    needs: dict[int, set[int]] = {}
    for item, counts in enumerate(block.counts):
        for t in counts:
            needs.setdefault(t, set()).add(item // BUNDLE)
    bundles = range(0, (len(block.ids) - 1) // BUNDLE + 1)
    # at most BLOCK_TERMS rows: which owner a term has, and which bundles ask for it
    plan = [(t, int(owner[t]), sorted(b)) for t, b in needs.items()]
    plan += [(-1, owners - 1, list(bundles))]
    asked = F.broadcast(spark.createDataFrame(pd.DataFrame(plan, columns=["t", "owner", "bundles"]), "t int, owner int, bundles array<int>"))

    carried = spark.createDataFrame([], _ACCUMULATORS)
    for s in range(owners):
        last = s == owners - 1
        own = table.join(asked.where(F.col("owner") == s), F.col("term") == F.col("t")).select("chunk", F.explode("bundles").alias("bundle"), "term", "ids", "idx", "tf", "n")
        step = _stage(block, weights, owner, s, last, have["docs"], have["terms"], k)
        schema = "item int, doc_id long, score long, chunk long, place int" if last else _ACCUMULATORS
        carried = carried.groupBy("chunk", "bundle").cogroup(own.groupBy("chunk", "bundle")).applyInArrow(step, schema)
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last(), "chunk", "place")
    best = carried.where("score > 0").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    names = spark.createDataFrame(list(enumerate(block.ids)), StructType([StructField("at", LongType()), StructField("item_id", id_field.dataType)]))
    return best.join(F.broadcast(names), F.col("item") == F.col("at")).select("item_id", "rank", "doc_id", "score")


def search(items: DataFrame, docs: DataFrame, item_id: str = "item_id", item_text: str = "text", doc_id: str = "doc_id", text: str = "text", k: int = 20, owners: int = 4) -> DataFrame:
    """item_id, rank, doc_id, score: the k documents of highest score above 0 of each item, equal
    scores by ascending doc_id (null ids last, of equal ids any order).

    Terms are runs of letters, digits and all characters beyond ASCII, A-Z lower-cased. With N
    documents that have terms and L terms in all, a term in df documents weighs
    w = floor(1000 ln((2N + 2) / (2df + 1))), a document of n terms has m = 75 + 25nN div L,
    and its score sums w ((10^9 tf) div (1000 tf + 12 m)) over the item's terms with
    repeats, in 64-bit integers. Null and empty texts have no terms: such items have no rows, such documents don't count. Repeated
    rows are documents, or items, of their own. Other columns are not read. Without
    documents or items there are no rows.

    Items are answered in blocks of at most BLOCK_ITEMS, each by one pass over the documents'
    whole texts, which writes the postings of the block's terms in chunks of at most CHUNK_DOCS
    documents. The terms are dealt to owners, rare ones first; an owner's stage is a
    cogroup of the bundles' accumulators with its postings by (chunk, bundle), so that a
    group is bounded, and a term that all documents hold is spread over all chunks. No
    document is left out but by bounds that prove k better ones."""
    spark = docs.sparkSession
    field = items.schema[item_id]
    out: DataFrame | None = None
    for block in blocks(items, item_id, item_text):
        found = _answer(spark, block, docs, doc_id, text, k, owners, field)
        if found is None:
            break
        if out is not None or len(block.ids) >= BLOCK_ITEMS:
            found = scratch.written(found, "ranked")  # later blocks don't hold this one's plan
        out = found if out is None else out.unionByName(found)
    if out is None:
        return spark.createDataFrame([], StructType([StructField("item_id", field.dataType)]).add("rank", IntegerType()).add("doc_id", LongType()).add("score", LongType()))
    return out


def op12_ranked_search(spark, sf_dir: str) -> DataFrame:
    with scratch.tidy(spark):
        return search(spark.read.parquet(f"{sf_dir}/benchmark.parquet"), spark.read.parquet(f"{sf_dir}/documents.parquet"))


def oracle() -> str:
    words = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
    return f"""WITH tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({words}) AS term FROM documents) GROUP BY doc_id, term),
size AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM tf GROUP BY doc_id),
whole AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM size),
weight AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, whole GROUP BY term, docs),
asked AS (SELECT item_id, unnest({words}) AS term FROM benchmark),
scored AS (SELECT a.item_id, t.doc_id, CAST(sum(w.w * ((1000000000 * t.tf) // (1000 * t.tf + 12 * (75 + (25 * s.n * whole.docs) // whole.terms)))) AS BIGINT) AS score
  FROM asked a JOIN tf t ON a.term = t.term JOIN weight w ON w.term = a.term JOIN size s ON s.doc_id = t.doc_id, whole GROUP BY a.item_id, t.doc_id)
SELECT item_id, CAST(r AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS r FROM scored WHERE score > 0) WHERE r <= 20"""
