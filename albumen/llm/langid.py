"""Language identification by cross-parsing entropy: the text is cut into the
fewest phrases that occur in a language's labelled text, walking that text's
suffix automaton; the language with the fewest normalised phrases wins."""

from __future__ import annotations

import math
import random
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructType

from .bytesops import runs, string_bytes

BLOCK = 512  # symbols of a text that are parsed beside other blocks; results don't depend on it
CHARS = 24_000  # characters of training text a language
SLOTS = 64  # texts that they are taken from
BROADCAST = 1 << 17  # chosen texts, by hash, that are sent to every task
UNKNOWN = 20.0  # bits of a letter that a language's training text lacks: one of all code points
_GAP = 1  # symbol of everything that isn't a letter
_OTHER = 0  # letters that no training text has
_PLACE = np.int64((1 << 32) - 1)


def automaton(symbols: list[int]) -> list[dict[int, int]]:
    """Transitions of each state of a sequence's suffix automaton; state 0 is the root."""
    nxt: list[dict[int, int]] = [{}]
    link, length = [-1], [0]
    last = 0
    for c in symbols:
        cur = len(nxt)
        nxt.append({})
        link.append(-1)
        length.append(length[last] + 1)
        p = last
        while p != -1 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p == -1:
            link[cur] = 0
        else:
            q = nxt[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                twin = len(nxt)
                nxt.append(dict(nxt[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p != -1 and nxt[p].get(c) == q:
                    nxt[p][c] = twin
                    p = link[p]
                link[q] = link[cur] = twin
        last = cur
    return nxt


def comb(nxt: list[dict[int, int]], size: int) -> tuple[np.ndarray, int]:
    """Sparse transitions as one row of cells that all states share: a state is a place b,
    and its transition on c is cell b + c, which holds b and the place to go to. Places are
    tried at random, those of states with most transitions first, until all of a state's
    fall on free cells; so memory follows the transitions and not the alphabet. Returns
    (cells, root)."""
    room = max(2 * sum(map(len, nxt)), 2 * len(nxt)) + 64
    rng = random.Random(1)
    used, taken, place = bytearray(room + size), set(), [0] * len(nxt)
    for state in sorted(range(len(nxt)), key=lambda i: -len(nxt[i])):
        while True:
            b = int(rng.random() * room)
            if b not in taken and not any(used[b + c] for c in nxt[state]):
                break
        taken.add(b)
        place[state] = b
        for c in nxt[state]:
            used[b + c] = 1
    cells = np.full(room + size, -1, dtype=np.int64)
    for b, out in zip(place, nxt, strict=True):
        for c, state in out.items():
            cells[b + c] = (b << 32) | place[state]
    return cells, place[0]


@dataclass
class Model:
    langs: list[str]
    letters: str  # known letters of any language; symbol of letters[i] is i + 2
    cells: np.ndarray  # all languages' combs, one after the other
    roots: np.ndarray  # the root's place, per language
    first: np.ndarray  # per language and symbol: the place that the root goes to, or the root's
    known: np.ndarray  # per language and symbol: has the root a transition
    bits: np.ndarray  # per phrase: log2 of the training length


def symbols_of(text: str, letters: dict[str, int]) -> list[int]:
    """Letters by their number (others 0), any run of the rest one gap."""
    out = [_GAP]
    for ch in text.lower():
        s = letters.get(ch, _OTHER) if ch.isalpha() else _GAP
        if s != _GAP or out[-1] != _GAP:
            out.append(s)
    return out


def fit(samples: dict[str, list[str]]) -> Model:
    """One automaton per language over all of its texts; no letter is left out."""
    langs = sorted(samples)
    joined = {lang: "\n".join(samples[lang]) for lang in langs}
    letters = "".join(sorted({ch for t in joined.values() for ch in t.lower() if ch.isalpha()}))
    number = {ch: i + 2 for i, ch in enumerate(letters)}
    size = len(letters) + 2
    combs, roots, bits, at = [], [], [], 0
    first, known = np.zeros((len(langs), size), np.int64), np.zeros((len(langs), size), bool)
    for k, lang in enumerate(langs):
        seq = symbols_of(joined[lang], number)
        nxt = automaton(seq)
        cells, root = comb(nxt, size)
        first[k] = root + at
        for c in nxt[0]:
            first[k, c], known[k, c] = (cells[root + c] & _PLACE) + at, True
        combs.append(np.where(cells < 0, -1, cells + (at << 32) + at))
        roots.append(root + at)
        bits.append(math.log2(max(2, len(seq))))
        at += len(cells)
    return Model(langs, letters, np.concatenate(combs) if combs else np.zeros(0, np.int64), np.array(roots, np.int64), first, known, np.array(bits))


class _Alphabet:
    """Symbol of every code point after folding, and is it a letter."""

    def __init__(self, model: Model):
        self.number = {ch: i + 2 for i, ch in enumerate(model.letters)}
        self.symbol = np.full(0x10000, _GAP, dtype=np.int64)
        self.letter = np.zeros(0x10000, dtype=bool)
        for cp in range(0x10000):
            if unicodedata.category(chr(cp))[0] == "L":
                self.letter[cp] = True
                self.symbol[cp] = self._of(chr(cp))

    def _of(self, ch: str) -> int:
        return self.number.get(ch.lower()[0], _OTHER)

    def read(self, cps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        plain = np.where(cps < 0x10000, cps, 0).astype(np.int64)
        symbol, letter = self.symbol[plain], self.letter[plain]
        for cp in np.unique(cps[cps >= 0x10000]).tolist():
            if chr(cp).isalpha():
                symbol[cps == cp], letter[cps == cp] = self._of(chr(cp)), True
        return symbol, letter


def _step(model: Model, lang: np.ndarray, state: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(next state, does a phrase end before c), of flat arrays."""
    cell = model.cells.take(state + c)
    over = (cell >> 32) != state
    cell &= _PLACE
    at = np.flatnonzero(over)
    cell[at] = model.first[lang[at], c[at]]
    return cell, over


def _blocks(model: Model, sym: np.ndarray, starts: np.ndarray, lengths: np.ndarray, keep: bool):
    """Parse blocks side by side, each from the root, longest first so that those at their
    end drop off. Returns (last state, phrase ends) per language and block and, with keep,
    both after every symbol, and the place of each block in those."""
    order = np.argsort(-lengths, kind="stable")
    starts, lengths = starts[order], lengths[order]
    n, k = len(starts), len(model.langs)
    state = np.repeat(model.roots[:, None], n, axis=1)
    ends = np.zeros((k, n), dtype=np.int32)
    most, live = int(lengths[0]) if n else 0, n
    path = (np.empty((most, k, n), np.int32), np.empty((most, k, n), np.int16)) if keep else None
    for t in range(most):
        while live and lengths[live - 1] <= t:
            live -= 1
        lang = np.repeat(np.arange(k), live)
        step, over = _step(model, lang, state[:, :live].ravel(), np.tile(sym[starts[:live] + t], k))
        state[:, :live] = step.reshape(k, live)
        ends[:, :live] += over.reshape(k, live)
        if path:
            path[0][t, :, :live], path[1][t, :, :live] = state[:, :live], ends[:, :live]
    back = np.empty(n, dtype=np.int64)
    back[order] = np.arange(n)
    return state[:, back], ends[:, back], path and (*path, back)


def phrases(model: Model, sym: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Phrases of the greedy parse of each text and language; texts are [start, start +
    length) of sym.

    A long text's blocks are parsed side by side as if each began a phrase. Then each is
    parsed again from the state in which the block before it ended, until both parses are
    in one state: from there on they agree. A block whose parses never meet ends in
    another state, and the next one is parsed once more from that."""
    k, n = len(model.langs), len(starts)
    head = np.minimum(lengths, BLOCK)
    last, ends, _ = _blocks(model, sym, starts, head, False)
    total = ends + (lengths > 0)
    more = np.maximum(0, -(-lengths // BLOCK) - 1)
    if not more.sum():
        return total
    row = np.repeat(np.arange(n), more)
    nth = 1 + np.arange(len(row)) - np.repeat(np.cumsum(more) - more, more)
    begin = starts[row] + nth * BLOCK
    size = np.minimum(BLOCK, starts[row] + lengths[row] - begin)
    out, own, (states, counts, spot) = _blocks(model, sym, begin, size, True)
    plain_out, plain_own = out.copy(), own.copy()
    into = np.where(nth == 1, last[:, row], np.concatenate((last[:, :1], out[:, :-1]), axis=1))
    lang, block = (x.ravel() for x in np.indices(into.shape))
    while len(lang):
        s, c, t = into[lang, block], np.zeros(len(lang), np.int32), 0
        before = out[lang, block]
        out[lang, block], own[lang, block] = plain_out[lang, block], plain_own[lang, block]
        g, b = lang, block
        while len(g):
            s, over = _step(model, g, s, sym[begin[b] + t])
            c = c + over
            met, done = s == states[t][g, spot[b]], size[b] == t + 1
            own[g[met], b[met]] = c[met] + plain_own[g[met], b[met]] - counts[t][g[met], spot[b[met]]]
            end = done & ~met
            own[g[end], b[end]], out[g[end], b[end]] = c[end], s[end]
            on = ~(met | done)
            g, b, s, c, t = g[on], b[on], s[on], c[on], t + 1
        moved = (out[lang, block] != before) & (block + 1 < len(row))
        lang, block = lang[moved], block[moved] + 1
        same = row[block] == row[block - 1]
        lang, block = lang[same], block[same]
        into[lang, block] = out[lang, block - 1]
    for g in range(k):
        total[g] += np.bincount(row, weights=own[g], minlength=n).astype(total.dtype)
    return total


def predict_column(model: Model, alphabet: _Alphabet, column: pa.Array) -> tuple[list[str], np.ndarray]:
    data, offs = string_bytes(column)
    langs, scores = [], []
    k = len(model.langs)
    for i, j in runs(offs, (1 << 21) // max(4, k)):
        raw = bytes(data[offs[i] : offs[j]])
        cps = np.frombuffer(raw.decode("utf-8", "replace").encode("utf-32-le"), dtype=np.uint32)
        lead = (np.frombuffer(raw, dtype=np.uint8) & 0xC0) != 0x80
        edges = np.concatenate(([0], np.cumsum(lead)))[offs[i : j + 1] - offs[i]]
        sym, letter = alphabet.read(cps)
        has = np.concatenate(([0], np.cumsum(letter)))
        has = has[edges[1:]] - has[edges[:-1]]
        keep = np.ones(len(sym), dtype=bool)
        keep[1:] = (sym[1:] != _GAP) | (sym[:-1] != _GAP)
        keep[edges[:-1][edges[:-1] < len(sym)]] = True
        kept = np.concatenate(([0], np.cumsum(keep)))[edges]
        sym = sym[keep]
        cost = phrases(model, sym, kept[:-1], np.diff(kept)) * model.bits[:, None]
        for g in range(k):
            missing = np.concatenate(([0], np.cumsum(~model.known[g][sym])))[kept]
            cost[g] += UNKNOWN * np.diff(missing)
        for r in range(j - i):
            if not has[r] or not k:
                langs.append("und")
                scores.append(0.0)
                continue
            c = cost[:, r]
            best = int(np.argmin(c))
            langs.append(model.langs[best])
            scores.append(float(1.0 / np.exp2(-(c - c[best])).sum()))
    return langs, np.array(scores)


def sample(df: DataFrame, text: str, lang: str, chars: int, slots: int) -> dict[str, list[str]]:
    """At most about `chars` characters of each label, in equal shares of at most `slots`
    texts: those of the least hash in each slot of hashes. A share begins at a place that
    the text's hash gives, so neither a text's beginning nor its letters are favoured."""
    rows = df.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).alias("l"), F.col(text).alias("t"), F.xxhash64(F.col(text)).alias("h"))
    picked = rows.groupBy("l", F.pmod("h", F.lit(slots)).alias("slot")).agg(F.min("h").alias("h"))
    share = picked.groupBy("l").agg(F.ceil(F.lit(chars) / F.count("*")).cast("int").alias("share"))
    chosen = picked.join(share, "l").select("l", "h", "share")
    if chosen.count() <= BROADCAST:  # no text is shuffled then; copies of one are reduced first
        chosen = F.broadcast(chosen)
    found = rows.join(chosen, ["l", "h"])
    spare = F.greatest(F.length("t") - F.col("share"), F.lit(0))
    piece = F.col("t").substr((F.pmod(F.xxhash64("h"), spare + 1) + 1).cast("int"), F.col("share"))
    out: dict[str, list[str]] = {}
    for r in found.groupBy("l", "h").agg(F.min(piece).alias("t")).orderBy("l", "h").toLocalIterator():
        out.setdefault(r["l"], []).append(r["t"])
    return out


def train(df: DataFrame, text: str = "text", lang: str = "lang", chars: int = CHARS, slots: int = SLOTS) -> Model:
    """Fit on a bounded sample of labelled rows: `chars` characters a language out of
    `slots` texts, an equal share of each. Rows without a text or label take no part; with
    no rows the model has no language."""
    return fit(sample(df, text, lang, chars, slots))


def identify(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Add lang_pred and score to every row; other columns of those names are replaced.

    The whole text is one parse. A language's cost is its phrases times the log2 of its
    training length, and UNKNOWN bits for each letter that its training text lacks; the
    least cost wins, ties go to the first language by name. score is the winner's share of
    2 ** -cost, from 0 to 1. A null text, or one without a letter, is `und` with score 0,
    as is everything under a model without languages. Letters are folded to lower case;
    all else is a gap. Repeated rows each get their row. No shuffle."""
    plain = df.drop("lang_pred", "score")
    schema = StructType(list(plain.schema.fields)).add("lang_pred", StringType()).add("score", DoubleType())
    shared = plain.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        alphabet = _Alphabet(m)
        for b in batches:
            langs, scores = predict_column(m, alphabet, b.column(b.schema.get_field_index(text)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*b.schema.names, "lang_pred", "score"])

    return plain.mapInArrow(work, schema)


def held_out(doc_id) -> object:
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def op9_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs.where(~held_out("doc_id")))
    out = identify(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")
