"""MinHash near-duplicates: minima of many universal hashes, banding, signature
verification, confirmation on the full shingle sets, and connected components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bytesops import U64, mix, runs, shingles, string_bytes, words
from .components import connected_components
from .scratch import numbered, tidy, written

BANDS, ROWS = 32, 4  # a pair at similarity 0.8 misses all bands with odds of 5e-8
SLACK = 0.2  # of the signature's estimate below the threshold: over 5 standard errors
PIVOTS = 4
SALTS = 8
RUN = 1 << 18


def universal_hashes(n: int) -> tuple[np.ndarray, np.ndarray]:
    """n multiply-add hashes of 64-bit keys (odd multipliers), fixed by a seed."""
    rng = np.random.default_rng(20240229)
    a = rng.integers(0, 1 << 63, n, dtype=np.uint64) * U64(2) + U64(1)
    b = rng.integers(0, 1 << 63, n, dtype=np.uint64)
    return a, b


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """Minima under every hash, one row per set; sets must not be empty."""
    a, b = universal_hashes(BANDS * ROWS)
    flat = np.concatenate(sets)
    at = np.concatenate(([0], np.cumsum([len(s) for s in sets])[:-1]))
    out = np.empty((len(sets), len(a)), dtype=np.uint32)
    for j in range(len(a)):
        out[:, j] = np.minimum.reduceat(((flat * a[j] + b[j]) >> U64(32)).astype(np.uint32), at)
    return out


def _sets(column: pa.Array, k: int):
    """(rows from, sets) per run of a batch."""
    data, offs = string_bytes(column)
    for i, j in runs(offs, RUN):
        o = offs[i : j + 1] - offs[i]
        h, _, first = words(data[offs[i] : offs[j]], o)
        yield i, shingles(h, first, k)


def sketch(docs: DataFrame, k: int) -> DataFrame:
    """(doc, n, k1, k2, sig): size of the shingle set, a 128-bit key of the set, and
    the signature's bytes (null for an empty set)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, sets in _sets(b.column(1), k):
                size = np.array([len(s) for s in sets], dtype=np.int64)
                full = np.flatnonzero(size)
                sig: list[bytes | None] = [None] * len(sets)
                k1, k2 = np.zeros(len(sets), U64), np.zeros(len(sets), U64)
                if len(full):
                    some = [sets[x] for x in full]
                    at = np.concatenate(([0], np.cumsum(size[full])[:-1]))
                    flat = np.concatenate(some)
                    k1[full] = np.add.reduceat(mix(flat), at)
                    k2[full] = np.add.reduceat(mix(flat ^ U64(0x5851F42D4C957F2D)), at)
                    for x, row in zip(full.tolist(), signatures(some), strict=True):
                        sig[x] = row.tobytes()
                yield pa.RecordBatch.from_pydict({"doc": b.column(0).slice(i, len(sets)), "n": pa.array(size), "k1": pa.array(k1.view(np.int64)), "k2": pa.array(k2.view(np.int64)), "sig": pa.array(sig, pa.binary())})

    return docs.mapInArrow(work, "doc long, n long, k1 long, k2 long, sig binary")


def shingle_sets(docs: DataFrame, k: int) -> DataFrame:
    """(doc, grams): the sorted distinct 64-bit shingles, as bytes."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, sets in _sets(b.column(1), k):
                yield pa.RecordBatch.from_pydict({"doc": b.column(0).slice(i, len(sets)), "grams": pa.array([s.tobytes() for s in sets], pa.binary())})

    return docs.mapInArrow(work, "doc long, grams binary")


def bands(sketches: DataFrame) -> DataFrame:
    """(bucket, doc): one row per band of each signature."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sigs = np.frombuffer(b"".join(b.column(1).to_pylist()), dtype=np.uint32).reshape(-1, BANDS, ROWS).astype(np.uint64)
            h = np.full(sigs.shape[:2], 1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64)
            for r in range(ROWS):
                h = mix(h * U64(0x9E3779B97F4A7C15) + sigs[:, :, r])
            yield pa.RecordBatch.from_pydict({"bucket": pa.array(h.view(np.int64).ravel()), "doc": pa.array(np.repeat(b.column(0).to_numpy(), BANDS))})

    return sketches.select("doc", "sig").mapInArrow(work, "bucket long, doc long")


def _agree(pairs: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b, sa, sb) whose signatures allow the similarity."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 2000):
                c = batch.slice(lo, 2000)
                x, y = (np.frombuffer(b"".join(c.column(i).to_pylist()), dtype=np.uint32).reshape(c.num_rows, -1) for i in (2, 3))
                ok = pa.array((x == y).mean(axis=1) >= least)
                yield pa.RecordBatch.from_arrays([c.column(0), c.column(1)], names=["a", "b"]).filter(ok)

    return pairs.select("a", "b", "sa", "sb").mapInArrow(work, "a long, b long")


def _grams(docs: DataFrame, k: int) -> DataFrame:
    """(g, doc): every shingle of every document as a row."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, sets in _sets(b.column(1), k):
                doc = np.repeat(b.column(0).slice(i, len(sets)).to_numpy(), [len(x) for x in sets])
                yield pa.RecordBatch.from_pydict({"g": pa.array(np.concatenate(sets).view(np.int64)), "doc": pa.array(doc)})

    return docs.mapInArrow(work, "g long, doc long")


def _across(apart: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Pairs of documents in different parts, one of them outside some bucket's largest
    part, that may reach the similarity. apart: doc, n, part, few.

    By prefix filtering: with the shingles of each set in one order, rarest first, a pair
    whose sets need an intersection of `need` has one in common among the first
    n - need + 1 of each. What a large group of near copies shares comes last in that
    order, so its outliers meet only where they share rare shingles."""
    grams = _grams(texts.join(apart.select("doc"), "doc", "left_semi"), k)
    grams = written(grams, "grams")
    freq = grams.groupBy("g").agg(F.count("*").alias("f"))
    first = Window.partitionBy("doc").orderBy("f", "g")
    ranked = grams.join(freq, "g").join(apart, "doc").withColumn("r", F.row_number().over(first))
    prefix = written(ranked.where("f > 1").where(100 * (F.col("n") - F.col("r") + 1) >= percent * F.col("n")).drop("f"), "prefix")
    side = lambda x: prefix.select("g", *[F.col(c).alias(f"{c}{x}") for c in ("doc", "n", "r", "part", "few")])
    need = F.ceil(percent * (F.col("na") + F.col("nb")) / F.lit(100 + percent))
    met = side("a").where("fewa").join(side("b"), "g").where("parta != partb and (not fewb or doca < docb)")
    met = met.where((F.col("ra") <= F.col("na") - need + 1) & (F.col("rb") <= F.col("nb") - need + 1))
    return met.select(F.least("doca", "docb").alias("a"), F.greatest("doca", "docb").alias("b")).distinct()


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs whose full sets have 100 * intersection >= percent * union."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                p, q = (np.frombuffer(z.as_buffer(), dtype=np.uint64) for z in (x, y))
                at = np.searchsorted(p, q)
                at[at == len(p)] = 0
                both = int((p[at] == q).sum())
                ok.append(100 * both >= percent * (len(p) + len(q) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    left = pairs.join(sets.select(F.col("doc").alias("a"), F.col("grams").alias("ga")), "a")
    both = left.join(sets.select(F.col("doc").alias("b"), F.col("grams").alias("gb")), "b")
    return both.select("a", "b", "ga", "gb").mapInArrow(work, "a long, b long")


def _verified(pairs: DataFrame, reps: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Signature verification first, then the full sets of the documents that are left."""
    side = lambda x: reps.select(F.col("doc").alias(x), F.col("n").alias(f"n{x}"), F.col("sig").alias(f"s{x}"))
    sized = pairs.join(side("a"), "a").join(side("b"), "b")
    sized = sized.where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
    likely = written(_agree(sized, percent / 100 - SLACK), "likely")
    wanted = likely.select(F.col("a").alias("doc")).union(likely.select("b")).distinct()
    sets = written(shingle_sets(docs.join(wanted, "doc", "left_semi"), k), "sets")
    return written(_confirm(likely, sets, percent), "links")


def _salted(rows: DataFrame, told: DataFrame, key: list[str], how: str) -> DataFrame:
    """rows joined with what is told of each key, SALTS copies of which go round, so that the
    rows of a hot key (equal sets, a common band) are spread. rows: doc and key."""
    salt = F.pmod(F.xxhash64("doc"), F.lit(SALTS)).cast("int")
    copies = told.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).hint("merge")  # they compress well, and would be taken for small
    return rows.withColumn("salt", salt).join(copies, [*key, "salt"], how).drop("salt")


def link(docs: DataFrame, k: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """docs: (doc long unique not null, text). Returns (sketches of all documents,
    (node, component) of every document that is linked to another)."""
    sketches = written(sketch(docs, k), "sketches")
    full = sketches.where("sig is not null")
    same = full.groupBy("k1", "k2").agg(F.min("doc").alias("rep"), F.count("*").alias("c")).where("c > 1")
    same = written(_salted(full.select("doc", "k1", "k2"), same.select("k1", "k2", "rep"), ["k1", "k2"], "left").select("doc", F.coalesce("rep", "doc").alias("rep")), "same")
    reps = full.join(same.where("doc = rep").select("doc"), "doc", "left_semi").select("doc", "n", "sig")
    reps = written(reps, "reps")
    texts = docs.join(reps.select("doc"), "doc", "left_semi")

    # Every bucket's members are tried against a few pivots, never against each other.
    members = bands(reps)
    orders = [F.min(F.struct(F.xxhash64("doc", F.lit(i)).alias("h"), F.col("doc"))).alias(f"p{i}") for i in range(PIVOTS - 1)]
    pivots = members.groupBy("bucket").agg(F.count("*").alias("size"), F.min("doc").alias("least"), *orders).where("size > 1")
    pivots = pivots.select("bucket", "size", F.array("least", *[f"p{i}.doc" for i in range(PIVOTS - 1)]).alias("pivots"))
    met = written(_salted(members, pivots, ["bucket"], "inner"), "buckets")
    tried = met.select("doc", F.explode(F.array_distinct("pivots")).alias("p")).where("doc != p")
    tried = written(tried.select(F.least("doc", "p").alias("a"), F.greatest("doc", "p").alias("b")).distinct(), "tried")
    links = _verified(tried, reps, texts, k, percent)
    parts = written(connected_components(links, "a", "b"), "parts")

    # Members that are still apart in a bucket are compared across its parts, but for pairs
    # within its largest part and those tried above.
    where = met.where("size > 2").select("bucket", "doc").join(parts, F.col("doc") == F.col("node"), "left")
    where = where.select("bucket", "doc", F.coalesce("component", "doc").alias("part"))
    sized = where.groupBy("bucket", "part").agg(F.count("*").alias("c"))
    main = sized.groupBy("bucket").agg(F.count("*").alias("parts"), F.max_by("part", "c").alias("main")).where("parts > 1").drop("parts")
    apart = _salted(where, main, ["bucket"], "inner").groupBy("doc", "part").agg(F.max(F.col("part") != F.col("main")).alias("few"))
    apart = written(apart.join(reps.select("doc", "n"), "doc"), "apart")
    more = _across(apart, texts, k, percent)
    more = written(more.join(tried, ["a", "b"], "left_anti"), "more")
    if more.limit(1).count():
        links = links.unionByName(_verified(more, reps, texts, k, percent))
        parts = written(connected_components(links, "a", "b"), "parts")
    copies = same.where("doc != rep").select("doc", F.col("rep").alias("node"))
    whole = copies.join(parts, "node", "left").select(F.col("doc").alias("node"), F.coalesce("component", "node").alias("component"))
    own = copies.join(parts, "node", "left_anti").select("node", F.col("node").alias("component")).distinct()
    return sketches, parts.unionByName(whole).unionByName(own)


def near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Words are runs of bytes other than space, tab and line breaks, with A-Z in lower
    case; a document's set has its distinct k-word shingles, or its whole sequence
    with fewer words; without text or words it is empty and linked with nothing. Two
    documents are linked where 100 * intersection >= percent * union, confirmed on
    full sets (of 64-bit shingle hashes). component_id is the least doc_id reachable;
    kept where that is the document itself. Equal sets are one candidate; buckets of
    any size are tried against pivots and then only across the parts still apart.

    doc_id is a long; rows whose doc_id is null are left out, and rows that share one
    are taken as the one with the least text."""
    plain = df.select(F.col(doc_id).cast("long").alias("doc"), F.col(text).alias("text")).where("doc is not null")
    if plain.groupBy("doc").agg(F.count("*").alias("n")).where("n > 1").limit(1).count():
        plain = written(plain.groupBy("doc").agg(F.min("text").alias("text")), "unique")
    return _decided(plain, k, percent).withColumnsRenamed({"doc": "doc_id", "component": "component_id"})


def _decided(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """(doc, n_shingles, component, kept) of docs: (doc long unique not null, text)."""
    with tidy(docs.sparkSession):
        sketches, parts = link(docs, k, percent)
        parts = written(parts, "components")
    out = sketches.select("doc", "n").join(parts, F.col("doc") == F.col("node"), "left")
    component = F.coalesce("component", "doc")
    return out.select("doc", F.col("n").alias("n_shingles"), component.alias("component"), (component == F.col("doc")).alias("kept"))


def near_duplicate_rows(df: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """near_duplicates for any table: one row per row of df. Rows that share a doc_id, or
    have none, are documents of their own, in the order of doc_id (none last) and text;
    the first of each group is kept, and its doc_id is the component_id (null where no
    row of the group has one)."""
    base, odd = numbered(df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")), "doc_id", "text", nulls_last=True)
    out = _decided(base.select(F.col("__doc").alias("doc"), "text"), k, percent)
    if not odd:
        return out.withColumnsRenamed({"doc": "doc_id", "component": "component_id"})
    mine = base.select(F.col("__doc").alias("doc"), "doc_id")
    head = base.select(F.col("__doc").alias("component"), F.col("doc_id").alias("component_id"))
    return out.join(mine, "doc").join(head, "component").select("doc_id", "n_shingles", "component_id", "kept")


def without_near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of df that near_duplicate_rows keeps, as they are."""
    base, _ = numbered(df, doc_id, text, nulls_last=True)
    out = _decided(base.select(F.col("__doc").alias("doc"), F.col(text).alias("text")), k, percent)
    return base.join(out.where("kept").select(F.col("doc").alias("__doc")), "__doc", "left_semi").select(*df.columns)


def op3_minhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_duplicate_rows(docs, k=2, percent=80)
