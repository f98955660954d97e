"""A kept text index: immutable segments of postings with the keys that each one replaces,
compaction, ranked pages that skip blocks which can't reach them, and substrings by grams."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import search
from .snapshots import _fs

LENGTH_CLASSES = 16
_POSTINGS = "term string, col string, block int, n int, most int, least int, keys array<{kind}>, lens array<int>, places array<array<int>>"


def _starts(columns: list[pa.Array]) -> np.ndarray:
    """Rows at which one of the columns differs from the row before."""
    new = np.zeros(len(columns[0]), dtype=bool)
    new[:1] = True
    for c in columns:
        a, b = c.slice(1), c.slice(0, len(c) - 1)
        differ = pc.fill_null(pc.not_equal(a, b), False).to_numpy(zero_copy_only=False)
        new[1:] |= differ | (a.is_null().to_numpy(zero_copy_only=False) != b.is_null().to_numpy(zero_copy_only=False))
    return np.flatnonzero(new)


def _posting_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tokens in the order of (bucket, term, col, block, key, pos) as rows of one block each. The last
    block of a batch waits for the next one; a block is bounded, so this holds little."""

    def lists(starts: np.ndarray, values: pa.Array) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.append(starts, len(values)), pa.int32()), values)

    def rows(t: dict[str, pa.Array], groups: np.ndarray) -> pa.RecordBatch:
        ones = np.union1d(_starts([t["key"]]), groups)
        first = np.searchsorted(ones, groups)
        tf = np.diff(np.append(ones, len(t["key"]))).astype(np.int32)
        keys, lens = t["key"].take(pa.array(ones)), t["len"].take(pa.array(ones))
        heads = {c: t[c].take(pa.array(groups)) for c in ("term", "col", "block", "bucket")}
        out = {
            "term": heads["term"], "col": heads["col"], "block": heads["block"],
            "n": pa.array(np.diff(np.append(first, len(ones))), pa.int32()),
            "most": pa.array(np.maximum.reduceat(tf, first)),
            "least": pa.array(np.minimum.reduceat(lens.to_numpy(), first)),
            "keys": lists(first, keys), "lens": lists(first, lens), "places": lists(first, lists(ones, t["pos"])),
            "bucket": heads["bucket"],
        }
        return pa.RecordBatch.from_pydict(out)

    held: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        table = (table if held is None else pa.concat_tables([held, table])).combine_chunks()
        columns = {c: table.column(c).chunk(0) for c in table.column_names}
        groups = _starts([columns[c] for c in ("bucket", "term", "col", "block")])
        end = int(groups[-1])
        if end:
            yield rows({c: x.slice(0, end) for c, x in columns.items()}, groups[:-1])
        held = table.slice(end)
    if held is not None:
        yield rows({c: x.chunk(0) if x.num_chunks == 1 else x.combine_chunks() for c, x in zip(held.column_names, held.columns, strict=True)}, np.zeros(1, np.int64))


Split = tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]


def _words(lists: pa.ListArray) -> Split:
    """Of lists of terms: each term's row, its place there, its code, and the terms by code."""
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
    row = np.repeat(np.arange(len(lists)), sizes)
    place = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    coded = lists.flatten().dictionary_encode()
    return row, place.astype(np.int32), coded.indices.to_numpy(), coded.dictionary


def _grams(texts: pa.Array) -> Split:
    """The distinct grams of three characters of each text, in the same form; they have no places."""
    each = []
    for text in texts.to_pylist():
        c = np.frombuffer((text or "").encode("utf-32-le"), np.uint32).astype(np.int64)
        each.append(np.unique(c[:-2] << 42 | c[1:-1] << 21 | c[2:]))
    row = np.repeat(np.arange(len(each)), [len(g) for g in each])
    found, code = np.unique(np.concatenate(each), return_inverse=True)
    terms = ["".join(map(chr, (g >> 42, g >> 21 & 0x1FFFFF, g & 0x1FFFFF))) for g in found.tolist()]
    return row, np.zeros(len(row), np.int32), code, pa.array(terms, pa.string())


def _block_rows(batches: Iterator[pa.RecordBatch], cols: Sequence[str], split: Callable[[pa.Array], Split]) -> Iterator[pa.RecordBatch]:
    """Documents (key, len, block, t0, t1, ...) in the order of (block, key) as posting rows. A block that
    lies in two batches has two rows a term; all that is read of them is added up."""
    for batch in batches:
        if not batch.num_rows:
            continue
        block, lens = batch.column("block").to_numpy(), batch.column("len").to_numpy()
        for i, col in enumerate(cols):
            row, place, code, terms = split(batch.column(f"t{i}"))
            if not len(row):
                continue
            order = np.argsort(code, kind="stable")
            row, place, code = row[order], place[order], code[order]
            change = np.ones(len(row), dtype=bool)
            change[1:] = (code[1:] != code[:-1]) | (block[row[1:]] != block[row[:-1]])
            groups = np.flatnonzero(change)
            change[1:] |= row[1:] != row[:-1]
            ones = np.flatnonzero(change)
            first = np.searchsorted(ones, groups)
            tf, held = np.diff(np.append(ones, len(row))).astype(np.int32), lens[row[ones]]
            ends = pa.array(np.append(first, len(ones)), pa.int32())
            places = pa.ListArray.from_arrays(pa.array(np.append(ones, len(row)), pa.int32()), pa.array(place))
            out = {
                "term": terms.take(pa.array(code[groups])), "col": pa.array([col]).take(pa.array(np.zeros(len(groups), np.int32))), "block": pa.array(block[row[groups]]),
                "n": pa.array(np.diff(np.append(first, len(ones))), pa.int32()),
                "most": pa.array(np.maximum.reduceat(tf, first)), "least": pa.array(np.minimum.reduceat(held, first)),
                "keys": pa.ListArray.from_arrays(ends, batch.column("key").take(pa.array(row[ones]))),
                "lens": pa.ListArray.from_arrays(ends, pa.array(held)), "places": pa.ListArray.from_arrays(ends, places),
            }
            yield pa.RecordBatch.from_pydict(out)


class TextIndex:
    """An index below a folder that all executors share.

    A segment has three tables: docs (key, len), gone (keys whose rows in earlier segments
    no longer count) and postings, one row for each column, term and block of documents, with
    the sorted keys, their lengths and places. Postings lie in folders by a hash of the term,
    so that a query reads the buckets of its words alone. A block holds documents of like length
    and about `block` of them, the same ones for every term; beside the lists each
    row has the most occurrences and the least length, which bound what the block can score.

    segments/<name> are written first and never changed; a commit is one small file that
    lists the live segments with their counts of live documents and tokens. Readers see the
    last commit; a writer that loses a race, or dies before it, leaves no trace in it."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64, shards: int = 4, block: int = 128):
        self.spark, self.path, self.buckets, self.shards, self.block = spark, path.rstrip("/"), buckets, shards, block

    TOKENS_A_TASK = 4_000_000
    _split = staticmethod(_words)

    def _terms(self, c: Column) -> Column:
        """What _split takes."""
        return search.terms(c)

    def _size(self, terms: Column) -> Column:
        """How much of a document's length _terms of one column are."""
        return F.size(terms)

    # --- commits

    def _commits(self) -> list[int]:
        fs, p, _ = _fs(self.spark, f"{self.path}/commits")
        return sorted(int(s.getPath().getName()) for s in fs.listStatus(p) if s.getPath().getName().isdigit()) if fs.exists(p) else []

    def segments(self) -> list[dict]:
        """The live segments, oldest first: name, docs, tokens, blocks, type (of
        the key), key, cols, replaces."""
        have = self._commits()
        return json.loads(self.spark.read.text(f"{self.path}/commits/{have[-1]}", wholetext=True).first()[0])["segments"] if have else []

    def _commit(self, segments: list[dict]) -> None:
        n = max(self._commits(), default=0) + 1
        fs, p, make = _fs(self.spark, f"{self.path}/commits/.{uuid.uuid4().hex}")
        out = fs.create(p, False)
        out.write(bytearray(json.dumps({"segments": segments}).encode()))
        out.close()
        if not fs.rename(p, make(f"{self.path}/commits/{n}")):
            raise RuntimeError(f"commit {n} was made by another writer")

    def _read(self, segment: dict, table: str) -> DataFrame:
        kind = segment["type"]
        schema = {"docs": f"key {kind}, len int", "gone": f"key {kind}", "postings": _POSTINGS.format(kind=kind) + ", bucket int"}[table]
        rows = self.spark.read.schema(schema).parquet(f"{self.path}/segments/{segment['name']}/{table}")
        return rows.where("len > 0") if table == "docs" else rows

    # --- writing

    def add(self, changed: DataFrame | None, key: str, cols: Sequence[str], deleted: DataFrame | None = None) -> None:
        """Commit a segment: the rows of changed (new ones, and new versions of old ones) and
        the keys that are deleted. What was committed before isn't rewritten. Rows of changed
        have one row per key; null columns have no tokens, rows with none aren't in the index."""
        before = self.segments()
        name = uuid.uuid4().hex
        keys = [d.select(F.col(key).alias("key")) for d in (changed, deleted) if d is not None]
        gone = reduce(DataFrame.unionByName, keys).distinct() if before else keys[0].limit(0)
        gone.write.parquet(f"{self.path}/segments/{name}/gone")
        gone = self.spark.read.parquet(f"{self.path}/segments/{name}/gone")
        if changed is None:
            changed = deleted.limit(0).select(F.col(key), *[F.lit("").alias(c) for c in cols])
        names, split, kind = list(cols), self._split, dict(changed.dtypes)[key]
        cells = changed.select(F.col(key).alias("key"), *[self._terms(F.col(c)).alias(f"t{i}") for i, c in enumerate(names)])
        length = reduce(lambda a, b: a + b, [F.coalesce(self._size(F.col(f"t{i}")), F.lit(0)) for i in range(len(names))]).cast("int")
        cells = cells.withColumn("len", length)

        def rows(block, parts: int) -> DataFrame:
            blocks = cells.withColumn("block", block(F.col("key"), F.col("len"))).repartition(parts, "block").sortWithinPartitions("block", "key")
            return blocks.mapInArrow(lambda batches: _block_rows(batches, names, split), _POSTINGS.format(kind=kind))

        segment = self._segment(name, cells.select("key", "len"), rows)
        segment |= {"key": key, "cols": list(cols), "replaces": not gone.isEmpty()}
        if segment["replaces"]:
            before = self._without(before, gone)
        self._commit([*before, segment])

    def _without(self, segments: list[dict], gone: DataFrame) -> list[dict]:
        """The segments with their live counts after one more set of keys is gone."""
        live = self._docs(segments)
        lost = {r["segment"]: r for r in live.join(gone, "key", "left_semi").groupBy("segment").agg(F.count("*").alias("docs"), F.sum("len").alias("tokens")).collect()}
        return [s | {c: s[c] - (lost[i][c] if i in lost else 0) for c in ("docs", "tokens")} for i, s in enumerate(segments)]

    def _segment(self, name: str, docs: DataFrame, rows) -> dict:
        """Write docs and postings; rows(block, parts) gives the posting rows from that many tasks, where
        block(key, len) is the column of a document's block. Documents, not their tokens, are dealt
        to the tasks, by blocks; the tasks grow in number with the tokens."""
        at = f"{self.path}/segments/{name}"
        docs.write.parquet(f"{at}/docs")
        kept = self.spark.read.parquet(f"{at}/docs").where("len > 0")
        size = kept.agg(F.count("*").alias("docs"), F.coalesce(F.sum("len"), F.lit(0)).alias("tokens")).first()
        cuts = kept.approxQuantile("len", [i / LENGTH_CLASSES for i in range(1, LENGTH_CLASSES)], 0.01) if size["docs"] else []
        each = -(-size["docs"] // (self.block * LENGTH_CLASSES)) or 1

        def block(key: Column, length: Column) -> Column:
            above = reduce(lambda a, b: a + b, [(length > c).cast("int") for c in cuts], F.lit(0))
            return above * each + F.pmod(F.xxhash64(key), F.lit(each)).cast("int")

        blocks = each * LENGTH_CLASSES
        parts = min(blocks, max(self.shards, -(-size["tokens"] // self.TOKENS_A_TASK)))
        out = rows(block, parts).withColumn("bucket", self._bucket(F.col("term"))).sortWithinPartitions("bucket", "term", "col", "block")
        out.write.partitionBy("bucket").parquet(f"{at}/postings")
        return {"name": name, "docs": size["docs"], "tokens": size["tokens"], "blocks": blocks, "type": dict(kept.dtypes)["key"]}

    def compact(self) -> None:
        """Commit one segment of what is live, from the postings themselves: texts aren't read."""
        old = self.segments()
        if not old:
            return
        docs, words = self._docs(old), self._live(old, None, ("keys", "lens", "places"))
        order = ["bucket", "term", "col", "block", "key", "pos"]
        kind = _POSTINGS.format(kind=dict(docs.dtypes)["key"]) + ", bucket int"

        def rows(block, parts: int) -> DataFrame:
            lists = words.withColumn("block", block(F.col("key"), F.col("len"))).repartition(parts, "block")
            tokens = lists.select(self._bucket(F.col("term")).alias("bucket"), "term", "col", "block", "key", F.explode("places").alias("pos"), "len")
            return tokens.sortWithinPartitions(*order).mapInArrow(_posting_rows, kind).drop("bucket")

        name = uuid.uuid4().hex
        segment = self._segment(name, docs.select("key", "len"), rows)
        docs.select("key").limit(0).write.parquet(f"{self.path}/segments/{name}/gone")
        self._commit([segment | {"key": old[-1]["key"], "cols": old[-1]["cols"], "replaces": False}])

    def vacuum(self) -> int:
        """Remove what the last commit doesn't list: earlier commits and their segments, and
        segments of writers that died. Not beside a writer or a reader of an earlier commit.
        Returns how many segments went."""
        live = {s["name"] for s in self.segments()}
        fs, p, _ = _fs(self.spark, f"{self.path}/segments")
        old = [s.getPath() for s in fs.listStatus(p) if s.getPath().getName() not in live] if fs.exists(p) else []
        for n in self._commits()[:-1]:
            fs.delete(_fs(self.spark, f"{self.path}/commits/{n}")[1], False)
        for path in old:
            fs.delete(path, True)
        return len(old)

    # --- reading

    def _bucket(self, term: Column) -> Column:
        return F.pmod(F.xxhash64(term), F.lit(self.buckets)).cast("int")

    def _gone_after(self, segments: list[dict], i: int) -> DataFrame | None:
        later = [self._read(s, "gone") for s in segments[i + 1 :] if s["replaces"]]
        return reduce(DataFrame.unionByName, later).distinct() if later else None

    def _docs(self, segments: list[dict]) -> DataFrame:
        """(segment, key, len) of what is live."""
        parts = []
        for i, s in enumerate(segments):
            part, gone = self._read(s, "docs"), self._gone_after(segments, i)
            part = part if gone is None else part.join(gone, "key", "left_anti")
            parts.append(part.select(F.lit(i).alias("segment"), "key", "len"))
        return reduce(DataFrame.unionByName, parts)

    def _rows(self, segment: dict, words: Sequence[str] | None) -> DataFrame:
        """A segment's posting rows; of words: from their buckets, by the files' statistics."""
        rows = self._read(segment, "postings")
        if words is None:
            return rows
        wanted = self.spark.range(1).select(*[self._bucket(F.lit(w)).alias(f"b{i}") for i, w in enumerate(words)]).first() if words else []
        return rows.where(F.col("bucket").isin(*set(wanted)) & F.col("term").isin(*words))

    def _live(self, segments: list[dict], words: Sequence[str] | None, lists: Sequence[str], blocks: DataFrame | None = None) -> DataFrame:
        """(segment, term, col, key and what else lists has, one row each), of live documents."""
        parts = []
        for i, s in enumerate(segments):
            rows = self._rows(s, words).withColumn("segment", F.lit(i))
            if blocks is not None:
                rows = rows.join(blocks, ["segment", "block"], "left_semi")
            rows = rows.select("segment", "term", "col", F.inline(F.arrays_zip(*lists))).withColumnsRenamed({"keys": "key", "lens": "len"})
            gone = self._gone_after(segments, i)
            parts.append(rows if gone is None else rows.join(gone, "key", "left_anti"))
        return reduce(DataFrame.unionByName, parts)

    def postings(self, words: Sequence[str] | None = None) -> DataFrame:
        """(key, col, pos, term) of live documents, as search.match and search.phrase take them; for
        words: of their buckets alone."""
        rows = self._live(self.segments(), words, ("keys", "places"))
        return rows.select("key", "col", F.explode("places").alias("pos"), "term")

    def match(self, q: str, expand: Sequence[str] = (), aliases=None) -> DataFrame | None:
        """search.match over the words' own buckets."""
        segments = self.segments()
        words = sorted({w for t in (q.split(), expand) for x in t for w in search._tokens(x) + search._tokens(x.partition(":")[2])})
        texts = [t for _, t in search.parse_query(q, segments[-1]["cols"], aliases)] + list(expand)
        phrases = any(len(search._tokens(t)) > 1 for t in texts)
        rows = self.postings(words) if phrases else self._live(segments, words, ("keys",)).select("key", "col", "term")
        return search.match(rows, q, expand, segments[-1]["cols"], aliases)

    def _statistics(self, segments: list[dict], words: list[str]) -> tuple[int, float, dict[str, int]]:
        """Documents, their average length, and documents by word. Where nothing was replaced and
        there is one column, block counts tell the last; else the words' keys are read."""
        docs, tokens = sum(s["docs"] for s in segments), sum(s["tokens"] for s in segments)
        if len(segments[-1]["cols"]) == 1 and not any(s["replaces"] for s in segments):
            counts = reduce(DataFrame.unionByName, [self._rows(s, words).select("term", "n") for s in segments]).groupBy("term").agg(F.sum("n").alias("n"))
        else:
            counts = self._live(segments, words, ("keys",)).groupBy("term").agg(F.count_distinct("segment", "key").alias("n"))
        have = {r["term"]: r["n"] for r in counts.collect()}
        return docs, tokens / docs if docs else 0.0, {w: have.get(w, 0) for w in words}

    def _score(self, tf: dict[str, Column], length: Column, docs: int, average: float, df: dict[str, int]) -> Column:
        norm = 1 - search.B + search.B * length / F.lit(average)
        idf = {w: F.log((F.lit(float(docs)) - F.lit(float(n)) + 0.5) / (F.lit(float(n)) + 0.5) + 1.0) for w, n in df.items()}
        parts = [idf[w] * c * (search.K1 + 1) / (c + search.K1 * norm) for w, c in tf.items()]
        return reduce(lambda a, b: a + b, parts, F.lit(0.0))

    def ranked(self, q: str) -> DataFrame:
        """(key, score) of all live documents that hold every word of q; lower is better."""
        return self._ranked(self.segments(), list(dict.fromkeys(search._tokens(q))))

    def _ranked(self, segments: list[dict], words: list[str], blocks: DataFrame | None = None, known=None) -> DataFrame:
        docs, average, df = known or self._statistics(segments, words)
        counts = {w: F.coalesce(F.sum(F.when(F.col("term") == w, F.col("tf"))), F.lit(0)) for w in words}
        rows = self._live(segments, words, ("keys", "lens", "places"), blocks).select("segment", "key", "len", "term", F.size("places").alias("tf"))
        per = rows.groupBy("segment", "key").agg(F.first("len").alias("len"), *[c.alias(f"tf{i}") for i, c in enumerate(counts.values())])
        tf = {w: F.col(f"tf{i}") for i, w in enumerate(words)}
        hits = reduce(lambda a, b: a & b, [c > 0 for c in tf.values()], F.lit(bool(words)))
        return per.where(hits).select("key", (-self._score(tf, F.col("len"), docs, average, df)).alias("score"))

    def top(self, q: str, size: int = 48, first: int = 64) -> tuple[DataFrame, dict[str, int]]:
        """(key, score) of the best documents, ties by key, and how many of the words' blocks were
        read. Block rows without their lists give each block's bound; the `first` best ones
        are scored, and then only those whose bound reaches the score of place `size`. At most
        `first` blocks' names and `size` scores come to the driver."""
        segments, words = self.segments(), list(dict.fromkeys(search._tokens(q)))
        known = self._statistics(segments, words)
        parts = [self._rows(s, words).select(F.lit(i).alias("segment"), "block", "term", "most", "least") for i, s in enumerate(segments)]
        held = reduce(DataFrame.unionByName, parts).groupBy("segment", "block").agg(F.min("least").alias("least"), *[F.coalesce(F.sum(F.when(F.col("term") == w, F.col("most"))), F.lit(0)).alias(f"m{i}") for i, w in enumerate(words)])
        most = {w: F.col(f"m{i}") for i, w in enumerate(words)}
        some = reduce(lambda a, b: a & b, [c > 0 for c in most.values()], F.lit(bool(words)))
        bounds = held.where(some).select("segment", "block", (self._score(most, F.col("least"), *known) * (1 + 1e-9)).alias("bound"))
        order = [F.desc("bound"), F.col("segment"), F.col("block")]
        lead = bounds.orderBy(*order).limit(first).collect()
        if not lead:
            return self._ranked(segments, words, known=known).limit(0), {"blocks": 0, "read": 0}
        named = lambda rows: self.spark.createDataFrame([(r["segment"], r["block"]) for r in rows], "segment int, block int")
        best = self._ranked(segments, words, F.broadcast(named(lead)), known).orderBy("score", "key").limit(size)
        least = [r["score"] for r in best.collect()]
        floor = -least[-1] if len(least) == size else 0.0
        rest = bounds.where(F.col("bound") >= floor).join(F.broadcast(named(lead)), ["segment", "block"], "left_anti").select("segment", "block")
        count, reach = bounds.agg(F.count("*"), F.count_if(F.col("bound") >= floor)).first()
        more = reach - sum(r["bound"] >= floor for r in lead)
        if more:
            best = best.unionByName(self._ranked(segments, words, rest, known)).orderBy("score", "key").limit(size)
        return best, {"blocks": count, "read": len(lead) + more}


class GramIndex(TextIndex):
    """The same over the distinct three-character grams of lower-cased texts: a substring search
    reads the keys of its rarest grams and compares the texts of those rows alone."""

    GRAM, RAREST = 3, 4

    _split = staticmethod(_grams)

    def _terms(self, c: Column) -> Column:
        return F.lower(c)

    def _size(self, terms: Column) -> Column:
        return F.greatest(F.length(terms) - (self.GRAM - 1), F.lit(0))

    def grams_of(self, text: str) -> list[str]:
        """The grams that a row must hold: those of the parts between wildcards and escapes."""
        low = self.spark.range(1).select(F.lower(F.lit(text))).first()[0]
        parts = re.split(r"[%_\\]", low)
        return sorted({p[i : i + self.GRAM] for p in parts for i in range(len(p) - self.GRAM + 1)})

    def candidates(self, text: str) -> DataFrame | None:
        """Keys of the rows in which some column holds the rarest grams of text; None where text
        is too short to have any."""
        segments, grams = self.segments(), self.grams_of(text)
        if not grams:
            return None
        sizes = reduce(DataFrame.unionByName, [self._rows(s, grams).select("term", "n") for s in segments]).groupBy("term").agg(F.sum("n").alias("n"))
        counts = {r["term"]: r["n"] for r in sizes.collect()}  # no more than the grams of one text
        rare = sorted(grams, key=lambda g: (counts.get(g, 0), g))[: self.RAREST]
        hits = self._live(segments, rare, ("keys",)).groupBy("key", "col").agg(F.count_distinct("term").alias("c"))
        return hits.where(F.col("c") == len(rare)).select("key").distinct()

    def substring(self, df: DataFrame, key: str, cols: Sequence[str], text: str) -> DataFrame:
        """The rows of df (as indexed, by key) in which one of cols holds text, as
        search.any_contains has it; a text without grams is looked for in all rows."""
        found = self.candidates(text)
        if found is not None:
            df = df.join(found.withColumnRenamed("key", key), key, "left_semi")
        return df.where(search.any_contains(cols, text))
