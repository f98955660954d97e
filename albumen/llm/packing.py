"""Packing documents into sequences of one window: length combinations that fill it, their
repeat counts by non-negative least squares against the histogram of lengths, rounded, and
what is left packed greedily."""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import scratch

_WS = "\t-\r \x85\xa0  -     　"
#: Full windows get ids from here on: FULL + (chunk << 36) + number in the chunk.
FULL = 1 << 61
#: Start ranks are broadcast up to so many rows (24 bytes each), and joined beyond.
FEW = 1_000_000
GREEDY_PARTS = 16


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This process's encoder, so that tasks which Spark runs in one worker share its table."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


class Encoder:
    """Ids of a byte-level tokenizers file, equal to encode(text, add_special_tokens=False)
    with special strings as ordinary text. The library never joins a word to white space
    after it, so texts are cut before word spaces, and each distinct part is encoded by the
    library once; the table of parts is emptied when it has over KEEP.

    Where the file's merges are in the order of their ids and every token is reached by merging
    its own letters, merging any two neighbours that form a token, least id first, gives the
    same ids (whatever it merged first that the file's pairs don't would be a token that its
    own letters don't reach). tiktoken does that at a fraction of the time, and is used
    for texts of letters whose classes have long been settled, without endless white space."""

    KEEP = 1_000_000
    WINDOW = 1 << 20  # characters of a text that are cut at once

    def __init__(self, path: str, quick: bool = True):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark has a task for each core
        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        self.model = self.library.model
        # plain words and what closes them are parts of their own: no token joins the two
        mark = r"!-/:-@\[-`{-~"
        self.part = re.compile(f" ?[A-Za-z]+(?=[{_WS}{mark}]|$)|[{mark}]+(?=[{_WS}]|$)| ?[^{_WS}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+")
        self.break_ = re.compile(f"(?<=[^{_WS}]) (?=[^{_WS}])")
        self.odd = re.compile(f"[^\x00-\u052f]|[{_WS}]{{1000}}")
        self.quick = self._equal_ranks(path) if quick else None
        self._clear()

    def _equal_ranks(self, path: str):
        """The quick encoder, where the file proves that it is equal; else None."""
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        before, model = spec["pre_tokenizer"], spec["model"]
        plain = (before or {}).get("type") == "ByteLevel" and before.get("use_regex", True) and not before["add_prefix_space"] and spec["normalizer"] is None
        if not plain or model["type"] != "BPE" or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")):
            return None
        added = {a["content"] for a in spec["added_tokens"]}
        vocab = {w: i for w, i in model["vocab"].items() if w not in added}
        merged = [vocab["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
        if merged != sorted(set(merged)) or len(vocab) != len(merged) + 256:
            return None
        if any([t.id for t in self.model.tokenize(w)] != [i] for w, i in vocab.items()):
            return None
        # the byte-level alphabet: printable bytes stand for themselves, the others follow from 256 on
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        letter = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        return tiktoken.Encoding("same", pat_str=pattern, mergeable_ranks={bytes(letter[c] for c in w): i for w, i in vocab.items()}, special_tokens={})

    def _clear(self) -> None:
        self.table: dict[str, int] = {}
        self.starts, self.sizes = np.zeros(1024, np.int64), np.zeros(1024, np.int64)
        self.flat, self.used = np.zeros(4096, np.int32), 0

    def _learn(self, parts: list[str]) -> None:
        plain = [p.lstrip(" ").isalpha() and p.isascii() for p in parts]
        other = iter(self.library.encode_batch_fast([p for p, easy in zip(parts, plain, strict=True) if not easy], add_special_tokens=False))
        # plain words are one piece of the model, whose letter for the space is Ġ: no need of the library's other steps
        codes = [[t.id for t in self.model.tokenize(p.replace(" ", "Ġ"))] if easy else next(other).ids for p, easy in zip(parts, plain, strict=True)]
        sizes = np.fromiter(map(len, codes), np.int64, len(codes))
        first, total = len(self.table), int(sizes.sum())
        while first + len(parts) > len(self.starts):
            self.starts, self.sizes = np.resize(self.starts, 2 * len(self.starts)), np.resize(self.sizes, 2 * len(self.sizes))
        while self.used + total > len(self.flat):
            self.flat = np.resize(self.flat, 2 * len(self.flat))
        self.sizes[first : first + len(parts)] = sizes
        self.starts[first : first + len(parts)] = self.used + np.cumsum(sizes) - sizes
        self.flat[self.used : self.used + total] = [i for c in codes for i in c]
        self.used += total
        self.table.update(zip(parts, range(first, first + len(parts)), strict=True))

    def _window(self, text: str) -> np.ndarray:
        parts = self.part.findall(text)
        if len(self.table) > self.KEEP:
            self._clear()
        at = list(map(self.table.get, parts))
        if None in at:
            self._learn(list({p for p, i in zip(parts, at, strict=True) if i is None}))
            at = list(map(self.table.get, parts))
        at = np.array(at, dtype=np.int64)
        sizes = self.sizes[at]
        ends = np.cumsum(sizes)
        return self.flat[np.repeat(self.starts[at] - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)]

    def __call__(self, text: str) -> np.ndarray:
        out, at = [], 0
        while at < len(text):
            end = len(text)
            if at + self.WINDOW < end:
                cut = self.break_.search(text, at + self.WINDOW)
                end = cut.start() if cut else end
            window = text[at:end]
            if self.quick is not None and not self.odd.search(window):
                out.append(np.array(self.quick.encode_ordinary(window), dtype=np.int32))
            else:
                out.append(self._window(window))
            at = end
        return np.concatenate(out) if out else np.zeros(0, np.int32)


def encoded(df: DataFrame, tokenizer: str, doc_id: str, text: str, window: int, end_id: int, whole: bool = True) -> DataFrame:
    """(chunk, rest, rank, fulls, doc_id, n, crcs of its whole windows, ids: all, or those of the
    rest alone) of each document: a chunk is what one task
    read, rest is n modulo the window, rank the number of earlier documents of the chunk with
    an equal rest, fulls the number of whole windows of its earlier documents."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        chunk = TaskContext.get().partitionId()
        encode = encoder(tokenizer)
        seen = np.zeros(window, np.int64)
        fulls = 0
        for batch in batches:
            rests, ranks, before, sizes, crcs, ids = [], [], [], [], [], []
            for t in batch.column(1).to_pylist():
                one = np.append(encode(t), np.int32(end_id)) if t else np.array([end_id], np.int32)
                rest = len(one) % window
                rests.append(rest)
                ranks.append(int(seen[rest]))
                before.append(fulls)
                seen[rest] += 1
                fulls += len(one) // window
                sizes.append(len(one))
                crcs.append([zlib.crc32(one[a : a + window].astype("<u4").tobytes()) for a in range(0, len(one) - window + 1, window)])
                ids.append(one if whole else one[len(one) - rest :])
            offsets = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int32)
            flat = pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32))
            cols = [pa.array([chunk] * len(sizes), pa.int32()), pa.array(rests, pa.int32()), *(pa.array(x, pa.int64()) for x in (ranks, before)), batch.column(0), pa.array(sizes, pa.int64()), pa.array(crcs, pa.list_(pa.int64())), pa.ListArray.from_arrays(pa.array(offsets), flat)]
            yield pa.RecordBatch.from_arrays(cols, names=["chunk", "rest", "rank", "fulls", "doc_id", "n", "crcs", "ids"])

    rows = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(work, "chunk int, rest int, rank long, fulls long, doc_id long, n long, crcs array<long>, ids array<int>")


def combinations(present: np.ndarray, window: int, depth: int) -> np.ndarray:
    """All ascending combinations of 2 to depth lengths, all present, whose sum is the window:
    one row each, filled up with 0."""
    have = np.flatnonzero(present)
    have = have[have > 0]
    found = []

    def grow(head: list[int], least: int, left: int, parts: int) -> None:
        if parts == 2:
            a = have[(have >= least) & (have <= left // 2)]
            a = a[present[left - a]]
            rows = np.zeros((len(a), depth), np.int64)
            rows[:, : len(head)] = head
            rows[:, len(head)], rows[:, len(head) + 1] = a, left - a
            found.append(rows)
            return
        for a in have[(have >= least) & (have <= left // parts)].tolist():
            grow([*head, a], a, left - a, parts - 1)

    for parts in range(2, depth + 1):
        grow([], 1, window, parts)
    return np.concatenate(found) if found else np.zeros((0, depth), np.int64)


def _solve(columns: np.ndarray, goal: np.ndarray, x: np.ndarray, steps: int = 300) -> np.ndarray:
    """Least squares without bounds by conjugate gradients, from x on: column j holds a one at
    each of columns[j] (twice where a length is there twice; place 0 doesn't count)."""
    depth = columns.shape[1]

    def product(v: np.ndarray) -> np.ndarray:
        out = np.bincount(columns.reshape(-1), weights=np.repeat(v, depth), minlength=len(goal))
        out[0] = 0
        return out

    short = goal - product(x)
    slope = short[columns].sum(axis=1)
    way, size = slope.copy(), float(slope @ slope)
    for _ in range(steps):
        if size < 1e-12:
            break
        q = product(way)
        step = size / float(q @ q)
        x = x + step * way
        short = short - step * q
        slope = short[columns].sum(axis=1)
        new = float(slope @ slope)
        way, size = slope + new / size * way, new
    return x


def nnls(combos: np.ndarray, target: np.ndarray, rounds: int = 80, block: int = 128) -> np.ndarray:
    """Repeat counts x >= 0 that make the combinations' lengths meet the histogram best in least
    squares: an active-set method that lets in a block of combinations without a common
    length at a time, those with the steepest descent first, as long as that brings a
    thousandth; those that would be negative leave. Lengths number at most a window, so this
    work doesn't grow with the documents."""
    x = np.zeros(len(combos))
    scale = float(target.max()) if len(target) else 0.0
    if not len(combos) or scale <= 0:
        return x
    goal = target / scale
    goal[0] = 0
    passive = np.zeros(0, np.int64)
    best, last = float(goal @ goal), np.inf
    short = goal.copy()
    while rounds and best > 1e-9 and best < last * (1 - 1e-3):
        rounds, last = rounds - 1, best
        slope = short[combos].sum(axis=1)  # place 0 is 0
        slope[passive] = 0
        taken, new = np.zeros(len(goal), bool), []
        for c in np.argsort(-slope, kind="stable")[: 16 * block].tolist():
            if slope[c] <= 1e-9 or len(new) == block:
                break
            lengths = combos[c][combos[c] > 0]
            if not taken[lengths].any():
                taken[lengths] = True
                new.append(c)
        passive = np.concatenate((passive, np.array(new, np.int64)))
        z = x[passive]
        while len(passive):
            z = _solve(combos[passive], goal, z)
            if (z > 0).all():
                break
            passive, z = passive[z > 0], z[z > 0]
        trial = np.zeros(len(combos))
        trial[passive] = z
        made = np.bincount(combos[passive].reshape(-1), weights=np.repeat(z, combos.shape[1]), minlength=len(goal))
        made[0] = 0
        if float((goal - made) @ (goal - made)) >= best:
            break
        x, short = trial, goal - made
        best = float(short @ short)
    return x * scale


@dataclass
class Plan:
    """Where each rank of each length lies. Slots of a length are runs of ranks: those from
    first[i] on lie in sequences base[i], base[i] + 1, ... at offset[i]. Ranks from used[length] on
    lie one after the other in a stream that is cut every window; the end of the stream is
    cut into powers of two."""

    window: int
    slots: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]
    used: np.ndarray
    stream: np.ndarray  # place in the stream of a length's first such rank
    cuts: np.ndarray  # the last cuts of the stream, after whole windows
    planned: int  # sequences by combinations
    left: int  # documents in the stream

    def place(self, length: int, rank: int) -> list[tuple[int, int, int, int]]:
        """(start in the rest, length, sequence, offset) of each piece."""
        if rank < self.used[length]:
            first, base, offset = self.slots[length]
            i = int(np.searchsorted(first, rank, side="right")) - 1
            return [(0, length, int(base[i] + rank - first[i]), int(offset[i]))]
        out, at = [], int(self.stream[length]) + (rank - int(self.used[length])) * length
        begin, end, whole = at, at + length, int(self.cuts[0])
        while at < end:
            if at < whole:
                number = at // self.window
                origin, stop = number * self.window, (number + 1) * self.window
            else:
                i = int(np.searchsorted(self.cuts, at, side="right")) - 1
                number, origin, stop = whole // self.window + i, int(self.cuts[i]), int(self.cuts[i + 1])
            stop = min(stop, end)
            out.append((at - begin, stop - at, self.planned + number, at - origin))
            at = stop
        return out


def plan(histogram: np.ndarray, window: int, depth: int = 3) -> Plan:
    """histogram[l]: how many documents have a rest of l tokens (0 counts none)."""
    left = histogram.astype(np.int64).copy()
    left[0] = 0
    combos = combinations(left > 0, window, depth)
    x = nnls(combos, left.astype(np.float64))
    chosen: list[tuple[tuple[int, ...], int]] = []

    def take(lengths: tuple[int, ...], most: int) -> int:
        kinds, times = np.unique(lengths, return_counts=True)
        n = min(most, int((left[kinds] // times).min()))
        if n > 0:
            left[kinds] -= n * times
            chosen.append((lengths, n))
        return n

    for c in np.argsort(-x, kind="stable").tolist():
        if x[c] < 0.5:
            break
        take(tuple(combos[c][combos[c] > 0].tolist()), int(x[c] + 0.5))
    for length in range(window - 1, 0, -1):  # the longest first, filled up by the longest that fit
        while left[length] > 0:
            parts, room, spare = [length], window - length, left.copy()
            spare[length] -= 1
            while room and len(parts) < GREEDY_PARTS:
                fit = np.flatnonzero(spare[1 : room + 1])
                if not len(fit):
                    break
                parts.append(int(fit[-1]) + 1)
                spare[parts[-1]] -= 1
                room -= parts[-1]
            if room or not take(tuple(parts), int(left[length])):
                break  # it would not be full: cut as part of the stream
    slots: dict[int, list[tuple[int, int, int]]] = {}
    used = np.zeros(window, np.int64)
    base = 0
    for lengths, n in chosen:
        at = 0
        for length in lengths:
            slots.setdefault(length, []).append((int(used[length]), base, at))
            used[length] += n
            at += length
        base += n
    sizes = left * np.arange(window)
    stream = np.cumsum(sizes[::-1])[::-1] - sizes  # longer lengths lie before
    total = int(sizes.sum())
    cuts = [total - total % window]
    for bit in range(window.bit_length(), -1, -1):
        if (total % window) >> bit & 1:
            cuts.append(cuts[-1] + (1 << bit))
    arrays = {k: tuple(np.array(c, np.int64) for c in zip(*v, strict=True)) for k, v in slots.items()}
    return Plan(window, arrays, used, stream, np.array(cuts, np.int64), base, int(left.sum()))


def pack(df: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", window: int = 1024, end_id: int = 0, depth: int = 3, ids: bool = True) -> DataFrame:
    """One row per piece: doc_id, start (the document's ids before it), length, ids (where asked
    for), ids_crc32 (of little-endian 32-bit ids), doc_tokens, sequence_id, offset.

    A document's ids are the tokenizer's and end_id; a null text is empty and gives end_id
    alone. Whole windows from its start are sequences of their own; the rest of fewer tokens
    is packed by combinations of 2 to depth rests that fill the window, as often as the
    rounded least-squares solution says. What is left joins the longest rests that fit, where
    that fills a window; the others follow each other, the longest first, and are cut where a
    window is full. The last, unfilled window is cut into powers of two. So every sequence
    has a full window but those few, and nothing is padded.

    Repeated rows and rows with null or equal ids are packed like others; other columns are not
    read; no documents give no rows. Texts are encoded once, whole, and written; tasks hold
    one Arrow batch. Only the histogram (a window of counts) comes to the driver; ranks are
    counts by chunk and length, added up by a window over the chunks of each length."""
    chunks = scratch.written(encoded(df, tokenizer, doc_id, text, window, end_id, ids), "encoded")
    counts = scratch.written(chunks.groupBy("chunk", "rest").agg(F.count("*").alias("n")), "lengths")
    histogram = np.zeros(window, np.int64)
    for r in counts.groupBy("rest").agg(F.sum("n").alias("n"), F.count("*").alias("c")).collect():
        histogram[r["rest"]] = r["n"]
    layout = plan(histogram, window, depth)
    earlier = Window.partitionBy("rest").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("chunk", "rest", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("first"))
    starts = F.broadcast(starts) if counts.count() <= FEW else starts.hint("merge")
    rows = chunks.join(starts, ["chunk", "rest"]).select("chunk", "rest", (F.col("first") + F.col("rank")).alias("rank"), "fulls", "doc_id", "n", "crcs", "ids")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "start", "length", "ids", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        for batch in batches:
            chunk, rest, rank, fulls, doc, n, crcs = (batch.column(i).to_pylist() for i in range(7))
            tokens = batch.column(7)
            out, flat = [], []
            for i in range(batch.num_rows):
                mine = tokens[i].values.to_numpy().astype("<u4")
                done = n[i] - rest[i]
                first = FULL + (chunk[i] << 36) + fulls[i]
                for w, crc in enumerate(crcs[i]):
                    out.append((doc[i], w * window, window, crc, n[i], first + w, 0))
                    if ids:
                        flat.append(mine[w * window : (w + 1) * window])
                for a, size, seq, at in layout.place(rest[i], rank[i]) if rest[i] else ():
                    a += len(mine) - rest[i]
                    part = mine[a : a + size]
                    out.append((doc[i], done + a - (len(mine) - rest[i]), size, zlib.crc32(part.tobytes()), n[i], seq, at))
                    if ids:
                        flat.append(part)
            cols = list(zip(*out, strict=True)) if out else [()] * 7
            cols = [pa.array(c, pa.int64()) for c in cols]
            if ids:
                offsets = np.concatenate(([0], np.cumsum([len(p) for p in flat]))).astype(np.int32)
                values = np.concatenate(flat).astype(np.int32) if flat else np.zeros(0, np.int32)
                cols.insert(3, pa.ListArray.from_arrays(pa.array(offsets), pa.array(values)))
            yield pa.RecordBatch.from_arrays(cols, names=names if ids else [c for c in names if c != "ids"])

    schema = f"doc_id long, start long, length long, {'ids array<int>, ' if ids else ''}ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return rows.mapInArrow(work, schema)


def sequences(pieces: DataFrame, window: int = 1024, pad_id: int = 0) -> DataFrame:
    """sequence_id, ids, n_ids, starts (offsets at which pieces begin) from pieces with ids: one row per
    sequence of at most a window, padded to it unless n_ids is a power of two."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids", "length")))
    whole = pieces.groupBy("sequence_id").agg(parts.alias("p")).select(
        "sequence_id",
        F.flatten(F.transform("p", lambda x: x["ids"])).alias("ids"),
        F.transform("p", lambda x: x["offset"]).alias("starts"),
    )
    n = F.size("ids")
    power = n.bitwiseAND(n - 1) == 0
    return whole.select("sequence_id", F.when(power, F.col("ids")).otherwise(F.concat("ids", F.array_repeat(F.lit(pad_id), F.lit(window) - n))).alias("ids"), n.alias("n_ids"), "starts")


def op11_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    with scratch.tidy(spark):
        return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"), ids=False)
