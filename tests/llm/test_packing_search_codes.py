"""Packing, ranked search and vector codes against brute force, with nulls, empty and long
texts, ties, repeated rows, empty tables and clashing columns."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from albumen.llm import packing, ranked_search, vector_codes

P = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t


# --- packing -------------------------------------------------------------------


def test_encoder_equals_the_library(tokenizer):
    rng = random.Random(5)
    texts = ["", "a  b\n c", "don't, won't. (x) 's 't", "<|endoftext|> a", "x" * 3000, "日本 語 text 12 34  \r\n", "a\x00b \x00", " ", "\n\n x", "a, b. c! d?e f?"]
    texts += ["".join(rng.choice(" \n\t\x1c\x1f\x85　aé'sB1,.(日​\r") for _ in range(rng.randint(1, 30))) for _ in range(4000)]
    encode = packing.Encoder(P.path("byte_bpe_50k.json"))
    want = [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [encode(t).tolist() for t in texts] == want
    assert encode.quick is not None
    texts += [" " * 2500 + "x" + "\n\t" * 3000, "plain words, don't stop. " * 40]
    want += [e.ids for e in tokenizer.encode_batch(texts[-2:], add_special_tokens=False)]
    assert [encode(t).tolist() for t in texts[-2:]] == want[-2:]
    slow = packing.Encoder(P.path("byte_bpe_50k.json"), quick=False)
    assert [slow(t).tolist() for t in texts] == want
    small = packing.Encoder(P.path("byte_bpe_50k.json"), quick=False)
    small.KEEP, small.WINDOW = 5, 7  # an emptied table, and texts in many windows
    assert [small(t).tolist() for t in texts[:1500]] == want[:1500]


def check_pieces(got, want, window):
    """got: piece rows; want: [(doc_id, ids)] of every row, in any order."""
    held: Counter = Counter()
    for r in got:
        part = np.array(r["ids"], "<u4")
        assert len(part) == r["length"] > 0 and zlib.crc32(part.tobytes()) == r["ids_crc32"]
        held[r["doc_id"]] += len(part)
    total: Counter = Counter()
    for doc, ids in want:
        total[doc] += len(ids)
    assert held == total
    whole = {}
    for r in got:
        whole.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    padding = 0
    for parts in whole.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= window
        padding += 0 if at & (at - 1) == 0 else window - at
    return padding


def test_packing(spark, tokenizer):
    rng = random.Random(2)
    words = "alpha beta gamma delta the of and x1 y, z.".split()
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 90)))) for i in range(300)]
    rows += [(900, None), (901, ""), (None, "no id"), (902, "long " * 5000)]
    rows += [(1000 + i, "same text again and again " * 9) for i in range(200)]  # a hot length that nothing completes
    rows += [(1, "the same id"), (5, rows[5][1]), (5, rows[5][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").select("*", F.lit("x").alias("ids"), F.lit(1).alias("chunk"), F.lit(2).alias("rest")).repartition(5)
    want = [(d, [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]) for d, t in rows]
    pieces = packing.pack(df, P.path("byte_bpe_50k.json"), window=128).collect()
    assert check_pieces(pieces, want, 128) == 0
    once = {d: ids for d, ids in want if d not in (1, 5)}
    bare = packing.pack(df, P.path("byte_bpe_50k.json"), window=128, ids=False)
    assert sorted(map(str, bare.collect())) == sorted(map(str, spark.createDataFrame(pieces).drop("ids").collect()))
    by_doc = {}
    for r in pieces:
        if r["doc_id"] in once:
            by_doc.setdefault(r["doc_id"], []).append(r)
    for d, parts in by_doc.items():
        parts.sort(key=lambda r: r["start"])
        assert [i for r in parts for i in r["ids"]] == once[d]
        assert all(r["doc_tokens"] == len(once[d]) for r in parts)
        at = 0
        for r in parts:
            assert r["start"] == at
            at += r["length"]
    seqs = packing.sequences(spark.createDataFrame(pieces), 128).collect()
    assert sum(r["n_ids"] for r in seqs) == sum(len(i) for _, i in want)
    assert all(len(r["ids"]) == 128 or len(r["ids"]) & (len(r["ids"]) - 1) == 0 for r in seqs)


def test_packing_of_nothing(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack(df, P.path("byte_bpe_50k.json")).count() == 0


def test_least_squares_meets_an_exact_histogram():
    window = 24
    present = np.ones(window, bool)
    combos = packing.combinations(present, window, 3)
    listed = {tuple(x for x in c if x) for c in combos.tolist()}
    brute = {(a, window - a) for a in range(1, window // 2 + 1)} | {(a, b, window - a - b) for a in range(1, window) for b in range(a, window) if b <= window - a - b}
    assert listed == brute and len(combos) == len(brute)
    rng = np.random.default_rng(4)
    counts = rng.integers(0, 50, len(combos)) * (rng.random(len(combos)) < 0.3)
    target = np.bincount(combos.reshape(-1), weights=np.repeat(counts, 3), minlength=window)
    x = packing.nnls(combos, target)
    made = np.bincount(combos.reshape(-1), weights=np.repeat(x, 3), minlength=window)
    assert (x >= 0).all() and np.linalg.norm((made - target)[1:]) < 0.05 * np.linalg.norm(target[1:])
    layout = packing.plan(target.astype(np.int64), window)
    assert layout.left <= 3 * window  # rounding leaves a few of each length


@pytest.mark.parametrize("histogram", [[0, 500], [3, 0, 0, 0, 0, 7, 0, 0, 0, 0, 0, 900], [0] * 16, [0, 1, 1, 1, 1, 1]])
def test_plan_places_each_rank_once(histogram):
    window = 16
    counts = np.zeros(window, np.int64)
    counts[: len(histogram)] = histogram
    layout = packing.plan(counts, window)
    filled = {}
    for length in range(1, window):
        for rank in range(counts[length]):
            parts = layout.place(length, rank)
            assert sum(p[1] for p in parts) == length and [p[0] for p in parts] == [sum(q[1] for q in parts[:i]) for i in range(len(parts))]
            for _, size, seq, offset in parts:
                filled.setdefault(seq, []).extend(range(offset, offset + size))
    assert all(sorted(v) == list(range(len(v))) and len(v) <= window for v in filled.values())
    assert all(len(v) == window or len(v) & (len(v) - 1) == 0 for v in filled.values())


# --- ranked search -------------------------------------------------------------


def brute_search(items, docs, k):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    bags = [(d, Counter(words(t))) for d, t in docs]
    bags = [(d, b, sum(b.values())) for d, b in bags if b]
    n_docs, terms = len(bags), sum(n for _, _, n in bags)
    df = Counter(t for _, b, _ in bags for t in b)
    out = []
    for item, text in items:
        scored = []
        for d, bag, n in bags:
            m = 75 + (25 * n * n_docs) // terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * bag[t]) // (1000 * bag[t] + 12 * m)) for t in words(text) if bag[t])
            if s > 0:
                scored.append((-s, d is None, d or 0))
        out += [(item, r, None if none else d, -s) for r, (s, none, d) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


def searched(df):
    return sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(9)
    vocab = [f"w{i}" for i in range(120)] + ["Élan", "ÉLAN", "naïve", "日本"]
    text = lambda n: " ".join(vocab[min(int(rng.expovariate(0.06)), len(vocab) - 1)] for _ in range(n))
    docs = [(i, text(rng.randint(1, 60))) for i in range(400)]
    docs += [(500 + i, "tie tie W1") for i in range(30)] + [(600, None), (601, ""), (602, " ,.!"), (None, "w1 w2 null id"), (7, "w3 the same id"), (8, docs[8][1])]
    docs += [(700, "w1 " * 3000 + "x" * 5000)]
    items = [(i, text(rng.randint(3, 25))) for i in range(40)] + [(50, None), (51, ""), (52, "tie W1 w1"), (53, "absent"), (None, "w5 w6 w7"), (54, "x" * 5000), (3, "w9 w9 w10")]
    return items, docs


@pytest.mark.parametrize("owners", [1, 4])
def test_ranked_search(spark, corpus, owners):
    items, docs = corpus
    a = spark.createDataFrame(items, "item_id long, text string").withColumn("term", F.lit(1))
    b = spark.createDataFrame(docs, "doc_id long, text string").select("*", F.lit("en").alias("item"), F.lit(0).alias("chunk"), F.lit(1).alias("score")).repartition(5)
    assert searched(ranked_search.search(a, b, k=20, owners=owners)) == brute_search(items, docs, 20)


def test_ranked_search_in_small_pieces(spark, corpus, monkeypatch):
    """Many chunks, bundles, blocks of items and windows of a text give the same rows."""
    items, docs = corpus
    for name, value in (("CHUNK_DOCS", 16), ("BUNDLE", 3), ("BLOCK_ITEMS", 17), ("WINDOW", 50)):
        monkeypatch.setattr(ranked_search, name, value)
    a = spark.createDataFrame(items, "item_id long, text string")
    b = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    assert searched(ranked_search.search(a, b, k=5, owners=3)) == brute_search(items, docs, 5)


def test_windows_of_a_text():
    raw = b"ab cd-ef " + b"g" * 100 + " é日b\x00c".encode()
    want = re.findall(rb"[0-9a-z\x80-\xff]+", raw)
    for size in (1, 2, 5, 40):
        ranked_search.WINDOW, before = size, ranked_search.WINDOW
        try:
            assert [t for part in ranked_search.terms_of(raw) for t in part] == want
        finally:
            ranked_search.WINDOW = before


def test_ranked_search_of_nothing(spark, corpus):
    items, docs = corpus
    none_d, none_i = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    some_d, some_i = spark.createDataFrame(docs[:3], "doc_id long, text string"), spark.createDataFrame(items[:3], "item_id long, text string")
    assert ranked_search.search(some_i, none_d).count() == 0 == ranked_search.search(none_i, some_d).count()
    blank = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert ranked_search.search(some_i, blank).count() == 0


# --- vector codes --------------------------------------------------------------


def test_gnat_equals_brute_force():
    rng = np.random.default_rng(3)
    for points in (rng.integers(-50, 50, (16, 8)), rng.integers(0, 2, (40, 3)), rng.integers(-4000, 4000, (256, 8)), np.zeros((9, 4), int), rng.integers(0, 9, (1, 2))):
        tree = vector_codes.Gnat(points)
        queries = np.concatenate([points, points + rng.integers(-1, 2, points.shape), rng.integers(-60, 60, (300, points.shape[1]))])
        at, squared = tree.nearest(queries)
        d = ((queries[:, None, :] - points[None]) ** 2).sum(axis=2)
        assert (at == d.argmin(axis=1)).all() and (squared == d.min(axis=1)).all()  # argmin: ties to the lower index


def test_gnat_rules_subtrees_out():
    rng = np.random.default_rng(8)
    centres = rng.integers(-4000, 4000, (32, 8))
    points = np.repeat(centres, 8, axis=0) + rng.integers(-40, 40, (256, 8))
    tree = vector_codes.Gnat(points)
    tree.nearest(points + rng.integers(-10, 10, points.shape))
    assert tree.computed < 0.35 * 256 * 256


def brute_codes(rows, parts, entries, rounds, scale):
    kept = [(i, label, [math.floor(scale * x) for x in v]) for i, label, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    w = len(kept[0][2]) // parts
    cut = lambda v: [v[p * w : (p + 1) * w] for p in range(parts)]
    seeds = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[2]))[:entries]
    books = [[cut(v)[p] for _, _, v in seeds] for p in range(parts)]
    near = lambda p, x: min((sum((a - b) ** 2 for a, b in zip(x, c)), e) for e, c in enumerate(books[p]))
    for _ in range(rounds):
        new = []
        for p in range(parts):
            groups = {}
            for _, _, v in kept:
                groups.setdefault(near(p, cut(v)[p])[1], []).append(cut(v)[p])
            new.append([[sum(c) // len(groups[e]) for c in zip(*groups[e])] if e in groups else old for e, old in enumerate(books[p])])
        books = new
    coded = []
    for i, label, v in kept:
        found = [near(p, cut(v)[p]) for p in range(parts)]
        coded.append((i, label, "".join(f"{e:02x}" for _, e in found), sum(d for d, _ in found)))
    totals = Counter()
    for _, label, _, e in coded:
        totals[label] += e
    return sorted(((i, code, e, totals[label]) for i, label, code, e in coded), key=str), books


@pytest.mark.parametrize("hot", [vector_codes.HOT, 0.2, 2.0])
def test_vector_codes(spark, monkeypatch, hot):
    monkeypatch.setattr(vector_codes, "HOT", hot)  # labels all broadcast, some, none
    rng = random.Random(1)
    vec = lambda: [rng.uniform(-1, 1) for _ in range(16)]
    rows = [(i, rng.choice([1, 1, 1, 2, 3, None]), vec()) for i in range(40, 160)]
    rows += [(5, 1, None), (6, 1, [*vec()[:15], None]), (7, 2, [*vec()[:15], float("nan")]), (8, None, [*vec()[:15], float("-inf")])]
    rows += [(50, 9, rows[3][2]), (50, 9, rows[3][2]), (None, 2, vec())] + [(500 + i, 1, [0.25] * 16) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").select("*", F.lit(3).alias("v"), F.lit("c").alias("code"), F.lit(1).alias("error")).repartition(3)
    out, books = vector_codes.compress(df, parts=4, entries=6, rounds=3, scale=64)
    want, entries = brute_codes(rows, 4, 6, 3, 64)
    assert sorted(((r["vec_id"], r["code"], r["error"], r["label_error"]) for r in out.collect()), key=str) == want
    assert [b.tolist() for b in books.entries] == entries
    back = vector_codes.decode(out, books, 64).where("vec_id = 500").first()
    assert back["vector"] == [x / 64 for p in range(4) for x in entries[p][int(back["code"][2 * p : 2 * p + 2], 16)]]


def test_vector_codes_of_few_rows(spark):
    schema = "vec_id long, label int, embedding array<float>"
    out, books = vector_codes.compress(spark.createDataFrame([], schema))
    assert books is None and out.count() == 0
    two = spark.createDataFrame([(1, 1, [0.5] * 8), (2, None, [0.25] * 8)], schema)
    out, books = vector_codes.compress(two)
    assert {(r["vec_id"], r["code"], r["error"], r["label_error"]) for r in out.collect()} == {(1, "00" * 8, 0, 0), (2, "01" * 8, 0, 0)}
    empty = spark.createDataFrame([(1, 1, []), (2, 1, [])], schema)
    assert [r["code"] for r in vector_codes.compress(empty)[0].collect()] == ["00" * 8] * 2
    with pytest.raises(Exception, match="one length"):
        vector_codes.compress(spark.createDataFrame([(1, 1, [0.5] * 8), (2, 1, [0.5] * 7)], schema))
    with pytest.raises(Exception, match="one length"):  # each in a batch of its own
        vector_codes.compress(spark.createDataFrame([(1, 1, [0.5] * 8), (2, 1, [0.5] * 16)], schema).repartition(2, "vec_id"))[0].count()


# --- the registered queries ------------------------------------------------------


@pytest.mark.parametrize("name", ["op12_ranked_search", "op13_vector_codes"])
def test_query_equals_sql(spark, data, name):
    import os

    import duckdb

    from albumen.llm import queries

    c = duckdb.connect()
    for f in os.listdir(data):
        c.sql(f"create view {f.removesuffix('.parquet')} as select * from '{data}/{f}'")
    got = queries.queries()[name](spark, data)
    want = c.sql(queries.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(want.fetchall())


def test_packing_query(spark, data, tokenizer):
    docs = {r["doc_id"]: [*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 0] for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()}
    rows = packing.op11_packing(spark, data).collect()
    sized = [r.asDict() | {"ids": docs[r["doc_id"]][r["start"] : r["start"] + r["length"]]} for r in rows]
    assert check_pieces(sized, list(docs.items()), 1024) == 0
    assert all(r["doc_tokens"] == len(docs[r["doc_id"]]) for r in rows)
    covered = Counter()
    for r in sorted(rows, key=lambda r: r["start"]):
        assert r["start"] == covered[r["doc_id"]]
        covered[r["doc_id"]] += r["length"]
