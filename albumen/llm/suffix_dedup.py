"""Suffix-array dedup: every byte covered by a string of `width` bytes that also
starts earlier in the corpus is removed; and the maximal repeats themselves.

Equal strings of `width` bytes share a minimiser anchor at the same place, so only
anchors that occur twice can matter. Around each, the bytes of the windows that it
stands for are its context. Equal contexts are one class, whose first occurrence goes
into a sparse suffix array dealt by anchor; the common-prefix interval tree of each
part gives the repeats, and the occurrences of a class share what is found for it.

An anchor with many classes is split by the bytes beside it: windows that begin far
before it agree on the bytes to its left, others on those to its right. Each half is
reduced to its classes again, until the parts are small. No part is left to one key."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .bytesops import runs, string_bytes
from .scratch import numbered, tidy, written
from .suffixes import K, anchors, bucket_repeats, fingerprints, tree_groups

WIDTH = 100
RUN = 192 << 10  # bytes handled at once, so that a run stays in the processor's cache
BUCKET = 2048  # classes of one anchor beyond which it is split
KEYS = 1 << 25  # repeated anchors that a sketch may hold (64 MB); more of them are joined


class Sketch:
    """A set of bits, 16 for each key, on which misses are certain; a false hit costs a
    row, since later steps group the rows by key."""

    def __init__(self, keys: DataFrame, key: str, n: int):
        self.bits = max(16, 3 + max(1, n).bit_length())
        mask = F.lit((1 << self.bits) - 1).cast("long")
        low, high = F.col(key).bitwiseAND(mask), F.shiftright(key, 32).bitwiseAND(mask)
        at = keys.select(F.explode(F.array(low, high)).alias("p"))
        packed = at.groupBy(F.shiftright("p", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("bits")).toArrow()
        self.words = np.zeros(1 << (self.bits - 6), dtype=np.int64)
        self.words[packed.column("word").to_numpy()] = packed.column("bits").to_numpy()

    def maybe(self, key: np.ndarray) -> np.ndarray:
        return self._has(key) & self._has(key >> 32)

    def _has(self, key: np.ndarray) -> np.ndarray:
        p = key & np.int64((1 << self.bits) - 1)
        return (self.words[p >> 6] >> (p & 63)) & 1 == 1


def _pieces(offs: np.ndarray, width: int):
    """Row ranges of one run each; a row longer than a run goes in blocks that overlap
    by width - 1 bytes. Yields (first row, offsets into data, base of the block)."""
    for i, j in runs(offs, RUN):
        if j == i + 1 and offs[j] - offs[i] > 4 * RUN:
            a = int(offs[i])
            while True:
                b = min(a + 2 * RUN + width - 1, int(offs[j]))
                yield i, np.array([a, b]), a - int(offs[i])
                if b == offs[j]:
                    break
                a += 2 * RUN
        else:
            yield i, offs[i : j + 1], 0


def anchor_rows(column: pa.Array, ids: np.ndarray, width: int):
    """Columns of one row per anchor, block by block: kh (its hash), ch (its context's),
    doc, s (first window), off (anchor - s), span (last window - s)."""
    data, offs = string_bytes(column)
    for i, o, base in _pieces(offs, width):
        part = data[o[0] : o[-1]]
        o = o - o[0]
        row, anchor, first, last, kh, ch = anchors(part, o, width)
        yield {"kh": kh.view(np.int64), "ch": ch.view(np.int64), "doc": ids[i + row], "s": first - o[row] + base, "off": (anchor - first).astype(np.int32), "span": (last - first).astype(np.int32)}


def _scan(docs: DataFrame, width: int, sketches=None) -> DataFrame:
    """Rows of all anchors, or of those that a sketch may hold; `several` says whether the
    second sketch may hold them."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False)
            for cols in anchor_rows(b.column(1), ids, width):
                if sketches:
                    at = np.flatnonzero(sketches.value[0].maybe(cols["kh"]))
                    cols = {k: v[at] for k, v in cols.items()}
                    cols["several"] = sketches.value[1].maybe(cols["kh"])
                if len(cols["kh"]):
                    yield pa.RecordBatch.from_pydict({k: pa.array(v) for k, v in cols.items()})

    schema = "kh long, ch long, doc long, s long, off int, span int"
    return docs.mapInArrow(work, schema + (", several boolean" if sketches else ""))


def _classes(docs: DataFrame, width: int) -> tuple[DataFrame, DataFrame]:
    """(occurrences, classes) of the anchors that occur twice. A class has the columns of
    its first occurrence, n of them, and several: may its anchor have other classes."""
    seen = _scan(docs, width).groupBy("kh").agg(F.count("*").alias("n"), F.min("ch").alias("lo"), F.max("ch").alias("hi"))
    again = written(seen.where("n > 1").select("kh", (F.col("lo") != F.col("hi")).alias("several")), "anchors")
    n = again.count()
    if n <= KEYS:
        both = (Sketch(again, "kh", n), Sketch(again.where("several"), "kh", n))
        rows = _scan(docs, width, docs.sparkSession.sparkContext.broadcast(both))
    else:
        rows = _scan(docs, width).join(again, "kh")
    shared = written(rows, "shared")
    first = shared.groupBy("kh", "ch").agg(F.count("*").alias("n"), F.max("several").alias("several"), F.min(F.struct("doc", "s", "off", "span")).alias("f"))
    return shared, written(first.select("kh", "ch", "n", "several", "f.*"), "classes")


def _sliced(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (doc, a, b and more columns) with `bytes`: the document's bytes from a to b.
    Documents meet their list of places, which their length bounds."""
    more = [f for f in wanted.schema.fields if f.name != "doc"]
    lists = wanted.groupBy("doc").agg(F.collect_list(F.struct(*(f.name for f in more))).alias("w"))
    schema = StructType([wanted.schema["doc"], *more]).add("bytes", "binary")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                c = batch.slice(lo, 64)
                data, offs = string_bytes(c.column(c.schema.get_field_index("text")))
                w = c.column(c.schema.get_field_index("w"))
                size = np.diff(w.offsets.to_numpy())
                row = np.repeat(np.arange(c.num_rows), size)
                flat = w.flatten()
                fields = {f.name: flat.field(i) for i, f in enumerate(more)}
                a, b = (offs[row] + fields[x].to_numpy() for x in "ab")
                doc = np.repeat(c.column(c.schema.get_field_index("doc")).to_numpy(), size)
                raw = data.tobytes()
                for i in range(0, len(row), 20_000):
                    j = slice(i, i + 20_000)
                    found = [raw[x:y] for x, y in zip(a[j].tolist(), b[j].tolist(), strict=True)]
                    cols = [pa.array(doc[j]), *(fields[f.name].slice(i, 20_000) for f in more), pa.array(found, pa.binary())]
                    yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    return docs.join(lists, "doc").select("doc", "text", "w").mapInArrow(work, schema)


def _keyed(rows: DataFrame) -> DataFrame:
    return rows.repartition("key").sortWithinPartitions("key")


def _buckets(batches: Iterator[pa.RecordBatch], size: int = 512) -> Iterator[pa.Table]:
    """Rows sorted by key, in tables that hold whole keys: one of them, or `size` rows."""
    held: list[pa.RecordBatch] = []
    rows, last = 0, None
    for b in batches:
        key = b.column(0).to_numpy()
        cut = np.flatnonzero(np.concatenate(([last is None or key[0] != last], key[1:] != key[:-1]))) if len(key) else ()
        at = 0
        for c in (int(x) for x in cut):
            if rows + c - at >= size and rows + c - at > 0:
                yield pa.Table.from_batches([*held, b.slice(at, c - at)])
                held, rows, at = [], 0, c
        held.append(b.slice(at))
        rows += b.num_rows - at
        last = key[-1] if len(key) else last
    if rows:
        yield pa.Table.from_batches(held)


def _column(t: pa.Table, name: str) -> np.ndarray:
    return t.column(name).to_numpy()


def _large(rows: DataFrame) -> DataFrame | None:
    """The keys with too many classes for one part, or None."""
    large = written(rows.groupBy("key").agg(F.count("*").alias("c")).where(F.col("c") > BUCKET).select("key"), "large")
    n = large.count()
    return (F.broadcast(large) if n <= 1 << 20 else large) if n else None


_PART = "key long, kh long, doc long, s long, off int, lo int, hi int, bytes binary"


def _halved(rows: DataFrame, width: int) -> DataFrame:
    """Each row's windows as two rows: those that begin at most m bytes before the anchor,
    and the others, m being half of the row's range. Windows of a half agree on the bytes
    that all of them cover, which become its key; ch is the hash of the half's context."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kh, doc, s, off, lo, hi = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("kh", "doc", "s", "off", "lo", "hi"))
            ctx = batch.column(batch.schema.get_field_index("bytes")).to_pylist()
            mid = (lo + hi) // 2
            least = off - (np.array([len(x) for x in ctx], dtype=np.int64) - width)
            out: dict[str, list] = {c: [] for c in ("key", "ch", "kh", "doc", "s", "off", "lo", "hi", "bytes")}
            for low, high in ((lo, mid), (mid + 1, hi)):
                top, end = np.minimum(high, off), np.maximum(low, least)
                for i in np.flatnonzero((low <= high) & (top >= end)).tolist():
                    o, x = int(off[i]), ctx[i]
                    mine = x[o - top[i] : o - end[i] + width]
                    common = x[o - min(int(low[i]), o) : o + width - int(high[i])] if low[i] <= o else b""
                    name = f"{kh[i]} {low[i]} {high[i]} ".encode()
                    out["key"].append(int.from_bytes(hashlib.blake2b(name + common, digest_size=8).digest(), "little", signed=True))
                    out["ch"].append(int.from_bytes(hashlib.blake2b(name + bytes([int(top[i]) & 255, int(top[i]) >> 8]) + mine, digest_size=8).digest(), "little", signed=True))
                    for c, v in (("kh", kh[i]), ("doc", doc[i]), ("s", s[i] + o - top[i]), ("off", top[i]), ("lo", low[i]), ("hi", high[i]), ("bytes", mine)):
                        out[c].append(v)
            kinds = {"off": pa.int32(), "lo": pa.int32(), "hi": pa.int32(), "bytes": pa.binary()}
            yield pa.RecordBatch.from_pydict({c: pa.array(v, kinds.get(c, pa.int64())) for c, v in out.items()})

    return rows.mapInArrow(work, "key long, ch long, " + _PART[len("key long, ") :])


def repeated_spans(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc, s, e): spans that together cover all bytes of windows that also start earlier.
    docs: (doc long, text), doc unique and not null."""
    shared, classes = _classes(docs, width)
    # A class's other occurrences, whole. The join is by place, so no key is a hot one.
    spans = shared.join(classes.select("doc", "s"), ["doc", "s"], "left_anti").select("doc", "s", (F.col("s") + F.col("span") + width).alias("e"))
    several = classes.where("several").select("doc", F.col("s").alias("a"), (F.col("s") + F.col("span") + width).alias("b"), "kh", "off")
    whole = _sliced(docs, several).select(F.col("kh").alias("key"), "kh", "doc", F.col("a").alias("s"), "off", F.lit(0).alias("lo"), F.lit(width - K).alias("hi"), "bytes")
    rows = written(whole, "contexts")
    parts = []
    while (large := _large(rows)) is not None:
        parts.append(rows.join(large, "key", "left_anti"))
        halves = written(_halved(rows.join(large, "key"), width), "halves")
        first = halves.groupBy("key", "ch").agg(F.min(F.struct("doc", "s", "kh", "off", "lo", "hi", "bytes")).alias("f"))
        rows = written(first.select("key", "f.kh", "f.doc", "f.s", "f.off", "f.lo", "f.hi", "f.bytes"), "halves-first")
        more = halves.join(rows.select("doc", "s", "kh", "lo"), ["doc", "s", "kh", "lo"], "left_anti")
        spans = spans.unionByName(more.select("doc", "s", (F.col("s") + F.length("bytes")).alias("e")))
    parts.append(rows)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _buckets(batches):
            if t.num_rows > 1:
                d, s, e = bucket_repeats(t.column("bytes").to_pylist(), _column(t, "doc"), _column(t, "s"), width)
                if len(d):
                    yield pa.RecordBatch.from_pydict({"doc": pa.array(d), "s": pa.array(s), "e": pa.array(e)})

    for p in parts:
        spans = spans.unionByName(_keyed(p.select("key", "doc", "s", "bytes")).mapInArrow(work, "doc long, s long, e long"))
    return spans


def merged_spans(spans: DataFrame) -> DataFrame:
    """(doc, __s, __e): the maximal runs of each document's spans, as lists. A task reads
    spans in order and holds the runs of one document."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc, s, e = None, np.zeros(0, np.int64), np.zeros(0, np.int64)
        for b in batches:
            docs, starts, ends = (b.column(i).to_numpy() for i in range(3))
            cut = np.concatenate((np.flatnonzero(np.concatenate(([True], docs[1:] != docs[:-1]))), [len(docs)])) if len(docs) else np.zeros(1, np.int64)
            out: list[tuple] = []
            for x, y in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                if doc is not None and docs[x] != doc:
                    out.append((doc, s, e))
                    s, e = s[:0], e[:0]
                doc = int(docs[x])
                s, e = merged(np.concatenate((s, starts[x:y])), np.concatenate((e, ends[x:y])))
            if out:
                yield _lists(out)
        if doc is not None:
            yield _lists([(doc, s, e)])

    ordered = spans.select("doc", "s", "e").repartition("doc").sortWithinPartitions("doc", "s")
    return ordered.mapInArrow(work, "doc long, __s array<long>, __e array<long>")


def _lists(rows: list[tuple]) -> pa.RecordBatch:
    kind = pa.list_(pa.int64())
    return pa.RecordBatch.from_pydict({"doc": pa.array([r[0] for r in rows], pa.int64()), "__s": pa.array([r[1] for r in rows], kind), "__e": pa.array([r[2] for r in rows], kind)})


def repeat_groups(df: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """The maximal repeats of at least `width` bytes, one row per occurrence: length,
    first_doc and first_start (the first occurrence, which with the length names the
    repeat), doc and start.

    A repeat is maximal where its occurrences are followed by different bytes and preceded
    by different ones; a document's edge differs from every byte and every other edge.
    doc_id must be unique and not null; a null text is empty. Anchors give the repeats under
    2 * width bytes. One that goes on is taken up at its starts, in rounds for lengths up to
    4, 8, 16 .. times width, each over the starts that are left; so documents that are equal
    cost one start each and not one a byte. Note that the occurrences of all maximal
    repeats can be far more than the bytes of the texts."""
    spark = df.sparkSession
    with tidy(spark):
        docs = df.select(F.col(doc_id).cast("long").alias("doc"), F.col(text).alias("text"))
        shared, classes = _classes(docs, width)
        size = F.octet_length("text")
        edges = docs.select("doc", F.coalesce(size, F.lit(0)).cast("long").alias("size"))
        # Classes here must agree on what surrounds the windows too: their bytes up to 2 * width.
        wanted = shared.join(edges, "doc").select("doc", F.greatest(F.col("s") - 1, F.lit(0)).alias("a"), F.least(F.col("s") + F.col("span") + 2 * width + 1, F.col("size")).alias("b"), "kh", "s", "span", "size")
        near = _sliced(docs, wanted).select(F.col("kh").alias("key"), "doc", "s", "span", "a", "b", "size", "bytes")
        found, opened = _level(near, width, 2 * width, spark)
        out = [found]
        reach = 2 * width
        while not opened.isEmpty():
            found, opened = _level(_extended(docs, edges, opened, reach, 2 * reach), reach, 2 * reach, spark)
            out.append(found)
            reach *= 2
        groups = out[0]
        for g in out[1:]:
            groups = groups.unionByName(g)
    return groups


def _extended(docs: DataFrame, edges: DataFrame, starts: DataFrame, least: int, most: int) -> DataFrame:
    """Starts (doc, s) with the bytes from one before to one after `most`; the key is the
    hash of the first `least` of them."""
    wanted = starts.join(edges, "doc").where(F.col("s") + least <= F.col("size"))
    wanted = wanted.select("doc", F.greatest(F.col("s") - 1, F.lit(0)).alias("a"), F.least(F.col("s") + most + 1, F.col("size")).alias("b"), "s", F.lit(0).alias("span"), "size")
    key = F.xxhash64(F.lit(least), F.substring(F.col("bytes"), (F.col("s") - F.col("a") + 1).cast("int"), F.lit(least)))
    return _sliced(docs, wanted).select(key.alias("key"), "doc", "s", "span", "a", "b", "size", "bytes")


def _level(rows: DataFrame, least: int, most: int, spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """(groups of lengths from least to below most; starts of those that are longer) of
    rows (key, doc, s, span, a, b, size, bytes): starts s to s + span of a document, and
    its bytes from a to b. Rows of equal bytes are one class."""
    ended = F.col("b") == F.col("size")
    rows = rows.withColumn("skip", (F.col("s") - F.col("a")).cast("int")).withColumn("ch", F.xxhash64("bytes", "skip", "span", ended))
    occurrences = written(rows.select("key", "ch", "doc", "s"), "occurrences")
    first = rows.groupBy("key", "ch").agg(F.count("*").alias("n"), F.min(F.struct("doc", "s", "span", "skip", "bytes")).alias("f"))
    classes = written(first.select("key", "ch", "n", "f.*"), "classes")
    large = _large(classes)
    narrow = classes if large is None else classes.join(large, "key", "left_anti")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _buckets(batches):
            if t.num_rows > 1 or t.column("n")[0].as_py() > 1:
                got = tree_groups(t.column("bytes").to_pylist(), _column(t, "skip"), _column(t, "span"), _column(t, "n"), _column(t, "doc"), _column(t, "s"), least, most)
                for length, row, shift, fd, fs in got:
                    cols = {"length": [length] * len(row), "first_doc": [fd] * len(row), "first_start": [fs] * len(row)}
                    yield pa.RecordBatch.from_pydict({**{c: pa.array(v, pa.int64()) for c, v in cols.items()}, "key": t.column("key").combine_chunks().take(pa.array(row)), "ch": t.column("ch").combine_chunks().take(pa.array(row)), "shift": pa.array(shift, pa.int64())})

    members = "length long, first_doc long, first_start long, key long, ch long, shift long"
    in_tree = written(_keyed(narrow).mapInArrow(work, members), "members")
    if large is not None:
        in_tree = in_tree.unionByName(written(_by_length(classes.join(large, "key"), least, most), "members"))
    found = written(in_tree.join(occurrences, ["key", "ch"]).select("length", "first_doc", "first_start", "doc", (F.col("s") + F.col("shift")).alias("start")), "groups")
    return found.where(F.col("length") < most), found.where(F.col("length") >= most).select("doc", F.col("start").alias("s")).distinct()


def _by_length(classes: DataFrame, least: int, most: int) -> DataFrame:
    """Members of the maximal repeats of keys with too many classes for one part: each start
    and length by its hash, whose groups are told by the bytes on either side. Grouped
    counts combine before they are shuffled."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 16):
                c = batch.slice(lo, 16)
                col = lambda n: c.column(c.schema.get_field_index(n))  # noqa: E731, B023
                rows = fingerprints(col("bytes").to_pylist(), col("skip").to_numpy(), col("span").to_numpy(), least, most)
                row = rows.pop("row")
                take = {n: col(n).to_numpy()[row] for n in ("key", "ch", "n", "doc", "s")}
                yield pa.RecordBatch.from_pydict({n: pa.array(v) for n, v in (take | rows).items()})

    schema = "key long, ch long, n long, doc long, s long, shift long, length long, g1 long, g2 long, left int, right int"
    each = written(classes.select("key", "ch", "n", "doc", "s", "skip", "span", "bytes").mapInArrow(work, schema), "fingerprints")
    diverse = lambda c: (F.min(c) != F.max(c)) | ((F.min(c) < 0) & (F.sum("n") > 1))
    group = each.groupBy("g1", "g2", "length").agg(F.sum("n").alias("m"), diverse("left").alias("l"), diverse("right").alias("r"), F.min(F.struct("doc", (F.col("s") + F.col("shift")).alias("at"))).alias("f"))
    whole = group.where(F.col("m") > 1).where(F.col("l") & (F.col("r") | (F.col("length") >= most)))
    whole = whole.select("g1", "g2", "length", F.col("f.doc").alias("first_doc"), F.col("f.at").alias("first_start"))
    return each.join(whole, ["g1", "g2", "length"]).select("length", "first_doc", "first_start", "key", "ch", "shift")


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of spans as maximal runs (touching spans are one)."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    s, e = starts[order], np.maximum.accumulate(ends[order])
    new = np.concatenate(([True], s[1:] > e[:-1]))
    return s[new], e[np.concatenate((np.flatnonzero(new)[1:] - 1, [len(s) - 1]))]


def remove_repeats(df: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH, kept: str = "kept", repair: bool = False) -> DataFrame:
    """df with n_bytes, n_removed, n_spans (maximal removed runs) and, as binary
    column `kept`, the remaining bytes of each text, joined.

    Texts are UTF-8 bytes; a byte goes if a string of `width` bytes that covers it
    also starts earlier: in a smaller doc_id, or earlier in the same document. All is
    judged on the input. A null text is empty; texts shorter than width lose nothing.
    Rows that share a doc_id (or have none) are taken in the order of their texts, so
    a repeated row is removed but for its first copy. With repair, a removed run that
    would cut a character in two leaves that character whole. Columns named like the
    added ones are replaced. Contexts are equal where two 64-bit hashes of theirs are;
    within a part of the suffix array bytes are compared."""
    spark = df.sparkSession
    added = ("n_bytes", "n_removed", "n_spans", kept)
    with tidy(spark):
        base, _ = numbered(df.drop(*(c for c in added if c != text)), doc_id, text)
        docs = base.select(F.col("__doc").alias("doc"), F.col(text).alias("text"))
        by_doc = written(merged_spans(repeated_spans(docs, width)), "spans")
    joined = base.join(by_doc.withColumnRenamed("doc", "__doc"), "__doc", "left").drop("__doc")
    schema = StructType([f for f in base.schema.fields if f.name != "__doc"])
    carried = list(schema.names)
    schema = schema.add("n_bytes", "long").add("n_removed", "long").add("n_spans", "long").add(kept, "binary")
    names = list(schema.names)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                c = b.slice(lo, 256)
                rows: list[tuple] = []
                texts = c.column(c.schema.get_field_index(text)).to_pylist()
                for t, s, e in zip(texts, c.column(c.schema.get_field_index("__s")).to_pylist(), c.column(c.schema.get_field_index("__e")).to_pylist(), strict=True):
                    rows.append(cut((t or "").encode(), s, e, repair))
                cols = [c.column(c.schema.get_field_index(name)) for name in carried]
                cols += [pa.array([r[k] for r in rows], pa.int64()) for k in range(3)] + [pa.array([r[3] for r in rows], pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return joined.mapInArrow(work, schema)


def cut(raw: bytes, starts: list[int] | None, ends: list[int] | None, repair: bool) -> tuple[int, int, int, bytes]:
    if not starts:
        return len(raw), 0, 0, raw
    s, e = merged(np.array(starts, np.int64), np.array(ends, np.int64))
    if repair:
        lead = np.append((np.frombuffer(raw, dtype=np.uint8) & 0xC0) != 0x80, True)
        at = np.flatnonzero(lead)
        s = at[np.searchsorted(at, s, side="left")]
        e = at[np.searchsorted(at, e, side="right") - 1]
        s, e = s[s < e], e[s < e]
    parts, at = [], 0
    for a, b in zip(s.tolist(), e.tolist(), strict=True):
        parts.append(raw[at:a])
        at = b
    parts.append(raw[at:])
    return len(raw), int((e - s).sum()), len(s), b"".join(parts)


def op7_suffix_array_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = remove_repeats(docs)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def brute_force(rows: list[tuple[int, str | None]], width: int = WIDTH) -> dict[int, tuple[int, int, int, str]]:
    """The same by a set of all strings of `width` bytes; for tests."""
    seen: set[bytes] = set()
    out = {}
    for doc, text in sorted(rows):
        raw = (text or "").encode()
        gone = np.zeros(len(raw) + 1, dtype=bool)
        for i in range(len(raw) - width + 1):
            w = raw[i : i + width]
            if w in seen:
                gone[i : i + width] = True
            seen.add(w)
        n = int(gone.sum())
        spans = int((gone[:-1] & ~np.concatenate(([False], gone[:-2]))).sum()) if len(raw) else 0
        left = bytes(np.frombuffer(raw, np.uint8)[~gone[:-1]]) if raw else b""
        out[doc] = (len(raw), n, spans, hashlib.sha256(left).hexdigest())
    return out
