"""Dealt operators against brute force, exact round trips and held-out accuracy, with
nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from albumen.llm import chat, components, decontaminate, langid, license_scan, mtree, near_dedup, pieces, quality, suffix_dedup, url_filter

P = pytest.importorskip("public_tokenizers")
LONG = "lorem ipsum dolor " * 4000


def docs(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema)


def sha(s):
    return hashlib.sha256(s if isinstance(s, bytes) else s.encode()).hexdigest()


# --- 1 -------------------------------------------------------------------------


def test_url_filter(spark):
    rows = [(1, "http://EXAMPLE.com/en/7?x"), (2, "https://a.example.com/en/1"), (3, "no scheme"), (4, None), (5, "http://x.org/a/my-porn/"), (6, "http://x.org/importn/sporny"), (7, "http://x.net/casino-poker"), (8, "http://x.net/casino/casino"), (9, "http://e.net/de/1"), (10, "http://a.example.net/de/8#f"), (11, "http://badcom/en/"), (12, "http://b.com?u=http://c.org/es/"), (12, "http://b.com?u=http://c.org/es/")]
    df = docs(spark, rows, "page_id long, url string").withColumn("rule", F.lit("mine"))
    got = {r["page_id"]: r for r in url_filter.filter_urls(df).collect()}
    v = {k: (r["host"], r["path"], r["rule"], r["verdict"]) for k, r in got.items()}
    assert v[1] == ("example.com", "/en/7", "example.com/en/7", "allow")
    assert v[2] == ("a.example.com", "/en/1", "com/en/", "block")
    assert v[3] == ("", "", None, "allow") == v[4]
    assert [v[k][3] for k in (5, 6, 7, 8, 9, 10, 11)] == ["block", "allow", "block", "allow", "allow", "block", "allow"]
    assert v[12][:2] == ("b.com", "")
    assert url_filter.filter_urls(df).count() == 13 and url_filter.filter_urls(df.limit(0)).count() == 0


def test_url_weights(spark):
    """Two terms of little weight don't reject, nor does one of much; escapes don't hide."""
    urls = ["http://a.b/click/promo", "http://a.b/casino", "http://a.b/casino/casino", "http://a.b/casino/promo", "http://a.b/%63%61sino-%70oker", "http://a.b/my%70orn", "http://a.b/my%2Dporn", "http://a.b/%zzporn%", "http://a.b/click/promo/free"]
    got = {r["page_id"]: (r["verdict"], r["soft_terms"], r["soft_weight"]) for r in url_filter.filter_urls(docs(spark, list(enumerate(urls)), "page_id long, url string")).collect()}
    assert [got[i][0] for i in range(9)] == ["allow", "allow", "allow", "block", "block", "allow", "block", "allow", "block"]
    assert got[0][1:] == (2, 2) and got[2][1:] == (1, 2) and got[4][1:] == (2, 4)
    assert url_filter.filter_urls(docs(spark, [(1, urls[3])], "page_id long, url string"), soft_limit=4).first()["verdict"] == "allow"


def test_url_oracle(spark, data, tmp_path):
    import duckdb

    odd = [(1, "http://x.org/%70orn/A"), (2, "x%2"), (3, "%61ds.ads/track%ff"), (4, None), (5, ""), (6, "http://a.example.com/en/%43asino-win?FREE"), (7, "%%41dult x")]
    docs(spark, odd, "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    for path, files in ((data, f"{data}/pages.parquet"), (str(tmp_path), f"{tmp_path}/pages.parquet/*.parquet")):
        c = duckdb.connect()
        c.sql(f"create view pages as select * from '{files}'")
        want = sorted(map(tuple, c.sql(url_filter.oracle()).fetchall()), key=str)
        assert sorted(map(tuple, url_filter.op1_url_filters(spark, path).collect()), key=str) == want


# --- 2 -------------------------------------------------------------------------


def test_masks_hit_all_two_substitutions():
    for gone in itertools.combinations(range(13), 2):
        assert any(not any(m[i] == "1" and s + i in gone for i in range(len(m))) for m in decontaminate.MASKS for s in range(14 - len(m)))


def brute_overlap(doc, item, overlap=13, match=0.8):
    least = min(overlap, len(item))
    best = None
    for d in range(-len(item), len(doc)):
        lo, hi = max(0, -d), min(len(item), len(doc) - d)
        for i in range(lo, hi):
            for j in range(i + least, hi + 1):
                same = [doc[x + d] == item[x] for x in range(i, j)]
                if same[0] and same[-1] and sum(same) >= match * (j - i) - 1e-9 and (best is None or (j - i, sum(same)) > best):
                    best = (j - i, sum(same))
    return best


def test_decontamination(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    items = [[rng.choice(words) for _ in range(n)] for n in (5, 12, 20, 40)]
    texts = []
    for k in range(60):
        t = [rng.choice(words) for _ in range(rng.randrange(0, 40))]
        if k % 3:
            it = list(items[k % 4])
            if k % 5 == 0:
                for x in rng.sample(range(1, len(it) - 1), 1 if len(it) < 13 else 2):
                    it[x] = "zz"
            cut = rng.randrange(0, len(t) + 1)
            t[cut:cut] = it if k % 2 else it[: max(3, len(it) // 2)]
        texts.append(t)
    rows = [(i, " ".join(t).upper() + "!") for i, t in enumerate(texts)] + [(100, None), (101, ""), (102, LONG), (1, " ".join(texts[1]))]
    bench = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)] + [(7, None), (8, ""), (None, "one two three")], "item_id long, text string")
    for limit in (decontaminate.SEEDS, 10):
        got = decontaminate.contamination(docs(spark, rows), bench, limit=limit).collect()
        assert len(got) == len(rows)
        by = {r["doc_id"]: r for r in got}
        for i, t in enumerate(texts):
            want = max((b for it in items if (b := brute_overlap(t, it))), default=None)
            assert (want is not None) == by[i]["contaminated"], (i, want, by[i])
            if want:
                assert (by[i]["overlap"], by[i]["equal"]) == want
        assert not any(by[k]["contaminated"] for k in (100, 101, 102))
    assert not any(r["contaminated"] for r in decontaminate.contamination(docs(spark, rows), bench.limit(0)).collect())
    assert decontaminate.contamination(docs(spark, []), bench).count() == 0


# --- 3 -------------------------------------------------------------------------


def shingle_set(text, k):
    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    w = re.findall("[^\x20\x09-\x0d]+", low)
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def brute_groups(rows, k):
    sets = {i: shingle_set(t, k) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= 80 * len(x | y):
            p, q = sorted((find(a), find(b)))
            root[q] = p
    return {i: (len(sets[i]), find(i), find(i) == i) for i in sets}


@pytest.mark.parametrize("k", [2, 5])
def test_near_duplicates(spark, k):
    rng = random.Random(k)
    vocab = [f"v{i}" for i in range(500)]
    base = [rng.choice(vocab) for _ in range(120)]
    rows = []
    for i in range(90):  # a large group with edits, partly linked only through others
        t = list(base)
        for x in rng.sample(range(120), rng.choice([0, 1, 2, 4, 6, 8])):
            t[x] = rng.choice(vocab)
        rows.append((1000 - i, " ".join(t)))
    rows += [(i, " ".join(rng.choice(vocab) for _ in range(rng.randrange(1, 60)))) for i in range(2000, 2040)]
    rows += [(5, "One two"), (6, "one  TWO"), (7, None), (8, ""), (9, " \t "), (10, "é É"), (11, "é É"), (12, LONG), (13, LONG)]
    got = {r["doc_id"]: tuple(r)[1:] for r in near_dedup.near_duplicates(docs(spark, rows), k=k).collect()}
    assert got == brute_groups(rows, k)


def test_near_duplicates_odd_tables(spark):
    assert near_dedup.near_duplicates(docs(spark, []), k=2).count() == 0
    rows = [(1, "a b c"), (1, "a b c"), (None, "a b c"), (2, "a b c")]
    df = docs(spark, rows).withColumn("component_id", F.lit("x"))
    assert sorted(map(tuple, near_dedup.near_duplicates(df, k=2).collect())) == [(1, 2, 1, True), (2, 2, 1, False)]


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(40)] + [(100, x) for x in range(101, 140)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(50)] + [(7, 7), (None, 3)]
    root = {x: x for e in edges for x in e if x is not None}
    for _ in range(300):
        for a, b in edges:
            if a is not None:
                root[a] = root[b] = min(root[a], root[b])
    want = {k: v for k, v in root.items() if any(k in e and None not in e and e[0] != e[1] for e in edges)}
    got = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == want


# --- 4 -------------------------------------------------------------------------


def test_license_scan(spark):
    rng = random.Random(4)
    noise = " ".join(rng.choice(["the", "under", "version", "sea", "this", "work"]) for _ in range(3000))
    rows = [(1, f"{noise} Licensed under the\nApache License, version 2.0. {noise}"), (2, "released UNDER the MIT license"), (3, noise), (4, None), (5, ""), (6, "License MIT the under Released"), (7, "This work is licensed under the GNU General Public License version 3 or so"), (2, "released UNDER the MIT license"), (None, "released under the MIT license")]
    got = license_scan.scan(docs(spark, rows).withColumn("license", F.lit("x"))).collect()
    assert len(got) == 9
    assert {r["doc_id"]: r["license"] for r in got} == {1: "Apache-2.0", 2: "MIT", 3: None, 4: None, 5: None, 6: None, 7: "GPL-3.0", None: "MIT"}
    assert license_scan.scan(docs(spark, [])).count() == 0


def licenses(spark, texts):
    return {r["doc_id"]: (r["license"], r["coverage"]) for r in license_scan.scan(docs(spark, list(enumerate(texts)))).collect()}


def test_license_repeats_and_variants(spark):
    gpl = "This work is licensed under the GNU {} License, version {}"
    texts = {
        "the under Released under the MIT License Released under the MIT License under the": "MIT",
        "the file is Released under the MIT License and Released under the MIT License see the file": "MIT",
        "x of the code. Licensed under the Apache License, Version 2.0 Licensed under the Apache License, Version 2.0 See the notes": "Apache-2.0",
        f"the work {gpl.format('General Public', 3)} {gpl.format('General Public', 3)} this public work": "GPL-3.0",
        gpl.format("General Public", 2): "GPL-2.0",
        gpl.format("Lesser General Public", 3): "LGPL-3.0",
        gpl.format("General Public", 7): None,
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License": "CC-BY-NC-4.0",
    }
    assert {t: v[0] for t, v in zip(texts, licenses(spark, texts).values(), strict=True)} == texts


def test_license_texts_stand_out(spark):
    """Every notice whole, doubled and between stray words of its own, is found whole."""
    texts = [f"the of {t} under the {t} of a {t}" for _, t in license_scan.NOTICES]
    got = licenses(spark, texts)
    for i, (name, t) in enumerate(license_scan.NOTICES):
        longer = {n for n, x in license_scan.NOTICES if len(x) > len(t) and t in x}
        assert got[i][1] == 1.0 and got[i][0] in {name, *longer}, (name, got[i])


def common(a, b):
    """Length of the longest common subsequence."""
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def test_license_coverage_against_brute_force():
    """Never more than the longest common subsequence of any stretch; found wherever words
    are put between or some are lost, up to the coverage."""
    rng = random.Random(6)
    for n in (5, 12, 30, 60):
        notice = [f"w{chr(97 + x // 26)}{chr(97 + x % 26)}" for x in (rng.randrange(4 * n) for _ in range(n))]  # a digit would be needed
        t = license_scan.Template("x", " ".join(notice), 0.8)
        for _ in range(40):
            body = [w for w in notice if rng.random() > 0.08]
            for _ in range(rng.randrange(n // 5 + 1)):
                body.insert(rng.randrange(len(body) + 1), rng.choice(("za", "zb", "zc")))
            text = [rng.choice(notice) for _ in range(rng.randrange(20))] + body * rng.randrange(1, 3) + [rng.choice(notice) for _ in range(20)]
            raw = np.frombuffer(" ".join(text).encode(), dtype=np.uint8)
            h = license_scan.words(raw, np.array([0, len(raw)]), license_scan.NOT_WORD)[0]
            got = t.best(h, np.flatnonzero(np.isin(h, t.words)))
            bound = max(common(text[a : a + t.reach], notice) for a in range(len(text)))
            assert (got[0] if got else 0) <= bound
            if body == notice:
                assert got and got[0] == n
            elif bound >= 0.95 * n:
                assert got, (notice, text)


def test_patience_alignment():
    assert license_scan.increasing([5, 1, 2, 9, 3]) == [1, 2, 4]
    rng = random.Random(9)
    for _ in range(200):
        a, b = ([rng.randrange(12) for _ in range(rng.randrange(12))] for _ in range(2))
        got = license_scan.align(a, b)
        assert all(a[i] == b[j] for i, j in got)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in itertools.pairwise(got))


# --- 5 -------------------------------------------------------------------------


def test_top_k(spark):
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(size=8).astype(float).tolist()) for i in range(700)]
    rows += [(i, [0.5] * 8) for i in range(700, 900)]  # a hot vector, all ties
    rows += [(900, None), (901, [1.0, None] + [0.0] * 6), (902, [float("nan")] * 8), (903, [float("inf")] * 8), (None, [0.1] * 8), (950, [1.0, 2.0]), (951, [2.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    v = mtree.quantised(df, "vec_id", "embedding", 256)
    got = {}
    for r in mtree.top_k(v, v.where("id % 50 = 0"), 5).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    ints = {i: [int(np.floor(256 * x)) for x in e] for i, e in rows if i is not None and e and all(x is not None and np.isfinite(x) for x in e)}
    want = {}
    for q in ints:
        if q % 50 == 0:
            scored = sorted((-sum(a * b for a, b in zip(ints[q], e, strict=True)), i) for i, e in ints.items() if i != q and len(e) == len(ints[q]))
            want[q] = [(n + 1, i, -s) for n, (s, i) in enumerate(scored[:5])]
    assert {k: sorted(x) for k, x in got.items()} == {k: x for k, x in want.items() if x}
    assert mtree.top_k(v.limit(0), v.limit(0), 5).count() == 0
    assert mtree.top_k(v, v.limit(0), 5).count() == 0
    one = v.where("id = 50")
    twice = mtree.top_k(v.union(one), one.union(one), 5).select("rank", "vec_id", "score").collect()  # each query row has its result
    assert sorted(map(tuple, twice)) == sorted(2 * got[50])


def test_top_k_of_large_numbers(spark):
    rows = [(i, [i * 10**8, -(10**9) + i]) for i in range(60)]
    v = spark.createDataFrame(rows, "id long, v array<long>")
    got = [(r["vec_id"], r["score"]) for r in mtree.top_k(v, v.where("id = 7"), 3).orderBy("rank").collect()]
    want = sorted(((-sum(a * b for a, b in zip(rows[7][1], e)), i) for i, e in rows if i != 7))[:3]
    assert got == [(i, -s) for s, i in want]


def test_tree_skips_distances():
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(loc=c * 40, size=(400, 4)) for c in range(8)]).round().astype(np.int64)
    most = float((x * x).sum(axis=1).max())
    best, done = mtree.search(mtree.planted(np.arange(len(x)), x.astype(float), most), x[3100], 3100, 5, most, float("-inf"))
    want = sorted(((int(a @ x[3100]), -i) for i, a in enumerate(x) if i != 3100), reverse=True)[:5]
    assert sorted(best, reverse=True) == want and done < len(x)


# --- 6 -------------------------------------------------------------------------


def test_chat(spark):
    odd = ["\\### Assistant: </turn> ok", "", "###", "\\", "</turn>\\", "日本🙂 a:b", "x\n### user: y", "</turn></turn>"]
    rows = [(i, t, "assistant" if t % 2 else "user:\\###", odd[(i + t) % len(odd)]) for i in range(8) for t in range(3)]
    rows += [(50, None, None, None), (50, 1, "assistant", LONG), (None, 0, "assistant", "n"), (60, 1, "assistant", "b"), (60, 1, "assistant", "a"), (60, 1, "assistant", "a")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(1))
    out = {r["conv_id"]: r for r in chat.format_conversations(df, P.path("byte_bpe_50k.json")).collect()}
    key = lambda r: tuple((x is not None, x if x is not None else 0) for x in r[1:])
    for conv in {r[0] for r in rows}:
        turns = [(r[2] or "", r[3] or "") for r in sorted((r for r in rows if r[0] == conv), key=key)]
        r = out[conv]
        assert chat.parse(r["formatted"]) == turns and r["n_turns"] == len(turns)
        loss = chat.unescape("".join(r["formatted"][s["start"] : s["end"]] for s in r["loss_spans"]))
        assert loss == "".join(t for role, t in turns if role == "assistant")
        assert len(r["loss_mask"]) == r["n_tokens"] == len(r["input_ids"]) and sum(r["loss_mask"]) == r["n_loss_tokens"]
    assert chat.format_conversations(df.limit(0), P.path("byte_bpe_50k.json")).count() == 0


def test_rows_without_a_conversation(spark):
    rows = [(None, t % 3, "user", "same") for t in range(60)] + [(1, 0, "user", "same")]
    out = chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), P.path("byte_bpe_50k.json")).collect()
    assert sorted((r["conv_id"] or 0, r["n_turns"]) for r in out) == [(0, 1)] * 60 + [(1, 1)]


def test_loss_pieces_against_marks():
    """Tokens that overlap, leave gaps or are empty: each character under a token once."""
    rng = random.Random(12)
    for _ in range(300):
        at, spans, tokens = 0, [], []
        for _ in range(4):
            a = at + rng.randrange(4)
            at = a + rng.randrange(5)
            spans.append((a, at))
        t = 0
        while t < at + 3:
            b = t + rng.randrange(4)
            tokens += [(t, b)] * rng.randrange(1, 3)
            t = max(t, b - rng.randrange(2)) + (rng.random() < 0.2) + (b == t)
        (s, e), (t0, t1) = (np.array(x, dtype=np.int64).T for x in (spans, tokens))
        mask, pieces = chat.loss_pieces(s, e, t0, t1)
        inside = {c for a, b in spans for c in range(a, b)} & {c for a, b in tokens for c in range(a, b)}
        assert [c for a, b in pieces for c in range(a, b)] == sorted(inside)
        assert mask.tolist() == [any(max(a, x) < min(b, y) for x, y in spans) for a, b in tokens]


def test_chat_query(spark, data):
    q = chat.op6_chat_formatting(spark, data).where("conv_id = -7").first()
    text = "\\### Assistant: </turn> ok"
    assert (q["n_turns"], q["turns_sha256"], q["loss_chars"], q["loss_sha256"]) == (2, sha(f"user\n{text}\nassistant\n{text}\n"), len(text), sha(text))


# --- 7 -------------------------------------------------------------------------


def removal_rows():
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdé") for _ in range(rng.randrange(2, 6)))
    passage, hot = " ".join(word() for _ in range(60)), " ".join(word() for _ in range(40))
    rows = []
    for i in range(150):
        t = [word() for _ in range(rng.randrange(5, 60))]
        if i % 3 == 0:
            t.insert(rng.randrange(len(t)), hot)
        if i % 7 == 0:
            p = list(passage)
            p[rng.randrange(len(p))] = "Z"
            t.insert(rng.randrange(len(t)), "".join(p))
        rows.append((rng.randrange(10**9), " ".join(t)))
    rows += [(3, "ab" * 400), (4, None), (5, ""), (6, "x" * 99), (7, "x" * 100), (8, "x" * 250), (9, "\0" * 220), (10, LONG)]
    rows += [(10**12 + i, rows[i][1]) for i in range(20)]
    return rows


@pytest.mark.parametrize(("bucket", "run"), [(2048, 192 << 10), (2, 700)])
def test_suffix_dedup(spark, monkeypatch, bucket, run):
    monkeypatch.setattr(suffix_dedup, "BUCKET", bucket)
    monkeypatch.setattr(suffix_dedup, "RUN", run)
    rows = removal_rows()
    want = suffix_dedup.brute_force(rows)
    out = suffix_dedup.remove_repeats(docs(spark, rows).withColumn("n_spans", F.lit("x")))
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], sha(bytes(r["kept"]))) for r in out.collect()}
    assert {k: v for k, v in got.items() if v != want[k]} == {} and set(got) == set(want)


def test_suffix_dedup_odd_tables(spark):
    t = "".join(chr(97 + i * 7 % 26) + str(i) for i in range(60))
    out = suffix_dedup.remove_repeats(docs(spark, [(1, t), (1, t), (None, t), (2, t)])).collect()
    assert sorted(((r["doc_id"] or 0), r["n_removed"] > 0) for r in out) == [(0, False), (1, True), (1, True), (2, True)]
    assert suffix_dedup.remove_repeats(docs(spark, [])).count() == 0


def test_suffix_dedup_repair(spark):
    t = "é" * 80
    r = {x["doc_id"]: bytes(x["kept"]).decode() for x in suffix_dedup.remove_repeats(docs(spark, [(1, "a" + t), (2, "b" + t)]), repair=True).collect()}
    assert set(r[2]) <= {"b", "é"} and len(r[2]) < 5


def brute_groups_of_bytes(rows, width):
    """(length, doc, start) sets of all maximal repeats, by growing every repeated string."""
    texts = {d: (t or "").encode() for d, t in rows}
    found = {}
    todo = {}
    for d, raw in texts.items():
        for i in range(len(raw) - width + 1):
            todo.setdefault(raw[i : i + width], []).append((d, i))
    todo = {w: o for w, o in todo.items() if len(o) > 1}
    while todo:
        longer = {}
        for w, occ in todo.items():
            n = len(w)
            edge = lambda d, i: texts[d][i] if 0 <= i < len(texts[d]) else (d, i)
            left, right = ({edge(d, i + k) for d, i in occ} for k in (-1, n))
            if len(left) > 1 and len(right) > 1:
                found[(n, *min(occ))] = sorted(occ)
            for d, i in occ:
                if i + n < len(texts[d]):
                    longer.setdefault(w + texts[d][i + n : i + n + 1], []).append((d, i))
        todo = {w: o for w, o in longer.items() if len(o) > 1}
    return found


def group_rows(kind):
    rng = random.Random(5)
    letters = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    if kind == "equal":
        t = letters(600)
        return [(i, t) for i in range(4)] + [(9, letters(100)), (10, None), (11, "")]
    if kind == "passage":
        p = letters(600)
        return [(i, letters(rng.randrange(40)) + p + letters(rng.randrange(40))) for i in range(4)] + [(8, p[:300]), (9, "x" + p[100:])]
    if kind == "hot":
        p = letters(130)
        return [(i, letters(3) + p[: rng.randrange(90, 131)] + letters(rng.randrange(30))) for i in range(40)]
    return [(0, "ab" * 130), (1, "\0" * 140 + "a"), (2, "\0" * 130), (3, "x" * 99), (4, "xyz" * 70 + "q"), (5, "é" * 70)]


@pytest.mark.parametrize("bucket", [2, 2048])
@pytest.mark.parametrize("kind", ["equal", "passage", "hot", "periods"])
def test_repeat_groups(spark, monkeypatch, bucket, kind):
    monkeypatch.setattr(suffix_dedup, "BUCKET", bucket)
    rows = group_rows(kind)
    got = {}
    for r in suffix_dedup.repeat_groups(docs(spark, rows)).collect():
        got.setdefault((r["length"], r["first_doc"], r["first_start"]), []).append((r["doc"], r["start"]))
    assert {k: sorted(v) for k, v in got.items()} == brute_groups_of_bytes(rows, 100)


def test_repeats_without_a_sketch(spark, monkeypatch):
    """More repeated anchors than a sketch may hold are joined, to the same result."""
    monkeypatch.setattr(suffix_dedup, "KEYS", 0)
    rows = removal_rows()
    want = suffix_dedup.brute_force(rows)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], sha(bytes(r["kept"]))) for r in suffix_dedup.remove_repeats(docs(spark, rows)).collect()}
    assert got == want


# --- 8 -------------------------------------------------------------------------


def test_quality(spark):
    rng = random.Random(8)
    rows, rated = [], []
    for i in range(600):
        g = i % 3
        w = [f"w{rng.randrange(200)}" for _ in range(30)]
        if g == 0:
            w[rng.randrange(30)] = "vile"
        if g == 1:
            w = [x for x in w[:6] for _ in range(5)]
        rows.append((i, " ".join(w)))
        rated.append((i, g))
    rows += [(1000, None), (1001, ""), (1002, LONG), (0, rows[0][1])]
    df = docs(spark, rows)
    ratings = spark.createDataFrame([r for r in rated if r[0] % 4] + [(None, 1), (5, None)], "doc_id long, grade int")
    m = quality.train(df, ratings, 3)
    assert list(m.thresholds) == sorted(m.thresholds)
    got = quality.grade(df, m, least=2).collect()
    assert len(got) == len(rows)
    test = [(r["selected"], rated[r["doc_id"]][1] == 2) for r in got if r["doc_id"] < 600 and r["doc_id"] % 4 == 0]
    assert np.mean([a == b for a, b in test]) > 0.85
    assert all(0 <= r["expected_grade"] <= 2 for r in got)
    blank = quality.train(df, ratings.limit(0), 3)
    assert quality.grade(df.limit(0), blank).count() == 0 and quality.grade(df, blank).count() == len(rows)


def loss(docs, grades, weight, w, thresholds, l2):
    """The penalised likelihood of the cumulative-link model, one document at a time."""
    total = 0.0
    for f, g, x in zip(docs, grades, weight / weight.sum(), strict=True):
        below = [0.0, *(1 / (1 + np.exp(w[f].sum() - t)) for t in thresholds), 1.0]
        total -= x * np.log(max(below[g + 1] - below[g], 1e-300))
    return total + l2 * (w**2).sum() / 2 / len(docs)


def test_fit_reaches_the_least_loss():
    """No step from the fitted model, in a weight or a threshold or at random, makes the
    likelihood (worked out apart from the fit) better by more than a trifle."""
    rng = np.random.default_rng(4)
    docs = [np.unique(rng.integers(0, 12, rng.integers(1, 7))) for _ in range(90)]
    truth = rng.normal(size=12)
    grades = np.array([int(np.digitize(truth[d].sum() + rng.normal(), [-1, 1])) for d in docs])
    weight = rng.uniform(0.5, 2, len(docs))
    model = quality.fit(docs, grades, weight, 3, rounds=3000)
    w, th = model.weights[:12], model.thresholds
    best = loss(docs, grades, weight, w, th, 1.0)
    steps = [(e, np.zeros(2)) for e in np.eye(12)] + [(np.zeros(12), e) for e in np.eye(2)] + [(rng.normal(size=12), rng.normal(size=2)) for _ in range(40)]
    for dw, dt in steps:
        for h in (0.05, -0.05, 0.3, -0.3):
            assert loss(docs, grades, weight, w + h * dw, th + h * dt, 1.0) > best - 1e-4
    assert loss(docs, grades, weight, np.zeros(12), th, 1.0) > best + 0.05


def test_openings_and_shape():
    """Words that begin alike share a feature; those of other rows or parts do not mix."""
    def of(*texts):
        import pyarrow as pa

        out = [set() for _ in texts]
        for i, _, row, feat in quality.features(pa.array(texts, pa.string())):
            for r, f in zip(row.tolist(), feat.tolist(), strict=True):
                out[i + r].add(f)
        return [{f for f in x if f < 1 << quality.BITS} for x in out]

    a, b, c, none, empty = of("wonderful", "Wonderfully", "wonde", None, "")
    assert len(a & b) == 2 and len(a) == len(b) == 3 and len(c) == 1 and not c & a and not none | empty
    assert of("ab wonderful", "wonderful ab")[0] == of("ab wonderful", "wonderful ab")[1] and of("abwonder", "ful")[1] == of("ful")[0]


# --- 9 -------------------------------------------------------------------------


def brute_parse(train, seq):
    """Phrases of the greedy parse, by looking into the training text."""
    inside, text = ("".join(chr(256 + s) for s in x) for x in (train, seq))
    n, i = 1, 0
    for j in range(len(text)):
        if text[i : j + 1] not in inside:
            n, i = n + 1, (j if text[j] in inside else j + 1)
    return n


@pytest.mark.parametrize("letters", [3, 3000])
@pytest.mark.parametrize("block", [512, 7, 1])
def test_suffix_automaton_parse(monkeypatch, letters, block):
    """Long texts too: a phrase goes on where a block ends. No alphabet is too large."""
    monkeypatch.setattr(langid, "BLOCK", block)
    rng = random.Random(2)
    known = [chr(0x4E00 + i) for i in range(letters)]
    train = "".join(rng.choice(known) for _ in range(400 if letters == 3 else 6000))
    m = langid.fit({"x": [train], "y": [train[::-1]]})
    number = {ch: i + 2 for i, ch in enumerate(m.letters)}
    texts = []
    for n in (1, 5, 511, 512, 513, 1024, 1025, 3000):
        a = rng.randrange(len(train))
        texts.append([number.get(rng.choice([*known, "q"]) if rng.random() < 0.2 else train[(a + z) % len(train)], 0) for z in range(n)])
    size = np.array([len(t) for t in texts])
    got = langid.phrases(m, np.array(sum(texts, []), dtype=np.int64), np.cumsum(size) - size, size)
    assert got.tolist() == [[brute_parse(langid.symbols_of(t, number), x) for x in texts] for t in (train, train[::-1])]


def test_no_letter_is_left_out(spark):
    """A language of thousands of letters beside one of few; a tiny one does not win by it."""
    rng = random.Random(3)
    han = [chr(0x4E00 + i) for i in range(3000)]
    text = "".join(rng.choice(han) for _ in range(6000))
    rows = [(1, text, "zh"), (2, "the cat sat on the mat and the dog ran", "en"), (3, "12", "xx")]
    m = langid.train(docs(spark, rows, "doc_id long, text string, lang string"))
    asked = [(0, text[2000:2400]), (1, "the dog sat"), (2, text[-100:])]
    assert [r["lang_pred"] for r in langid.identify(docs(spark, asked), m).orderBy("doc_id").collect()] == ["zh", "en", "zh"]


def test_sample_takes_a_share_of_every_slot(spark):
    rows = [(i, f"{i:04d}" + chr(97 + i % 26) * 5000, "en") for i in range(40)] + [(99, None, "en"), (98, "x", None)]
    got = langid.sample(docs(spark, rows, "doc_id long, text string, lang string"), "text", "lang", 900, 16)["en"]
    assert 10 <= len(got) <= 16 and len({len(t) for t in got}) == 1 and 900 <= sum(map(len, got)) < 900 + 16


def test_language_id(spark, data):
    d = spark.read.parquet(f"{data}/documents.parquet")
    out = langid.op9_language_id(spark, data).join(d.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in out if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in out)
    assert np.mean([r["lang"] == r["lang_pred"] for r in held]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in out)


def test_language_id_odd_tables(spark):
    df = docs(spark, [(1, "the cat sat", "en"), (2, "le chat noir", "fr"), (3, None, "en"), (4, "x", None)], "doc_id long, text string, lang string")
    m = langid.train(df)
    asked = docs(spark, [(1, None), (2, ""), (3, "12 !?"), (4, "The CAT"), (5, "日本"), (6, LONG), (4, "The CAT"), (7, "🙂")]).withColumn("score", F.lit("x"))
    got = [(r["doc_id"], r["lang_pred"]) for r in langid.identify(asked, m).collect()]
    assert len(got) == 8 and dict(got)[1] == dict(got)[2] == dict(got)[3] == dict(got)[7] == "und"
    assert dict(got)[4] == "en" and dict(got)[5] == "en"
    none = langid.train(df.limit(0))
    assert {r["lang_pred"] for r in langid.identify(asked, none).collect()} == {"und"} and langid.identify(asked.limit(0), m).count() == 0


# --- 10 ------------------------------------------------------------------------


def test_sentencepiece(spark, data):
    import sentencepiece as sp

    lib = sp.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    odd = ["", "  a  b ", "\n", "▁x ▁ y", "日本 語\t\n\n x", "a\r\nb  ", " ", "🙂🙂 á", "x" * 3000, None, LONG, "a\0b"]
    rows = [(i, t) for i, t in enumerate(odd)] + [(0, odd[0])]
    rows += [(1000 + r["doc_id"], r["text"]) for r in spark.read.parquet(f"{data}/documents.parquet").limit(60).collect()]
    df = docs(spark, rows).withColumn("ids", F.lit("clash"))
    got = pieces.encode(df, P.path("piece_bpe_32k.model"), keep=("doc_id", "text")).collect()
    assert len(got) == len(rows)
    for r in got:
        t = r["text"] or ""
        assert r["ids"] == lib.encode(t, add_eos=True) and r["decoded"] == lib.decode(r["ids"]) and r["n_tokens"] == len(r["ids"])
        raw = t.encode()
        assert b"".join(raw[a:b] for a, b in zip(r["begins"], r["ends"], strict=True)) == raw
    assert pieces.encode(df.limit(0), P.path("piece_bpe_32k.model")).count() == 0
    clash = pieces.encode(df, P.path("piece_bpe_32k.model"), keep=("doc_id", "ids"), outputs=("ids", "n_tokens"))
    assert clash.columns == ["doc_id", "ids", "n_tokens"] and sorted(r["n_tokens"] for r in clash.collect()) == sorted(r["n_tokens"] for r in got)


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc_cf", "identity"])
def test_normaliser_equals_library(rule):
    import sentencepiece as sp
    from sentencepiece import sentencepiece_model_pb2 as pb

    lib = sp.SentencePieceNormalizer(rule_name=rule, add_dummy_prefix=True, escape_whitespaces=True, remove_extra_whitespaces=True)
    m = pb.ModelProto()
    m.ParseFromString(lib.serialized_model_proto())
    mine = pieces.Normalizer(m.normalizer_spec)
    for t in ["ＡＢＣ  ½ ﬁ Straße ", "  a  b ", "㈱ x　y", "é", "", "①②\tz", "ｶﾞ", "plain text"]:
        raw, src = mine(t)
        assert raw.decode() == lib.normalize(t)
        assert len(src) == len(raw) + 1 and list(src) == sorted(src)
