"""The kept index against an index built anew."""

import random

import pytest
from pyspark.sql import functions as F

from albumen.operators import search
from albumen.operators.textindex import GramIndex, TextIndex

WORDS = [f"w{i}" for i in range(40)] + ["Été", "the"]


def texts(n, seed, start=0):
    rng = random.Random(seed)
    line = lambda: " ".join(WORDS[min(int(rng.expovariate(0.12)), 41)] for _ in range(rng.randint(0, 40)))
    return [(start + i, line(), line() if rng.random() < 0.5 else None) for i in range(n)]


@pytest.fixture(scope="module")
def changed_index(spark, tmp_path_factory):
    """Three segments: rows, new ones with changed ones and deletions, and changes of changes."""
    frame = lambda rows: spark.createDataFrame(rows, "id long, title string, body string")
    first, second, third = texts(300, 1), texts(60, 2, 280), texts(20, 3, 300)
    index = TextIndex(spark, str(tmp_path_factory.mktemp("index")), buckets=4, shards=2, block=8)
    index.add(frame(first), "id", ["title", "body"])
    index.add(frame(second), "id", ["title", "body"], frame(first[:30]).select("id"))
    index.add(frame(third), "id", ["title", "body"], frame(first[40:50]).select("id"))
    state = {r[0]: r for r in first} | {r[0]: r for r in second} | {r[0]: r for r in third}
    for r in first[:30] + first[40:50]:
        del state[r[0]]
    return index, frame(list(state.values()))


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_segments_equal_a_rebuild(changed_index):
    index, now = changed_index
    want = rows(search.build_postings(now, "id", ["title", "body"]).select("key", "col", "pos", "term"))
    assert rows(index.postings()) == want
    assert sum(s["docs"] for s in index.segments()) == now.where(F.size(search.terms(F.concat_ws(" ", "title", "body"))) > 0).count()
    assert sum(s["tokens"] for s in index.segments()) == len(want)


@pytest.mark.parametrize("q", ["w0 w3", "w1", "title:w2 w0", "the", "absent", "w0-w1", "été"])
def test_match_and_rank(changed_index, q):
    index, now = changed_index
    built = search.build_postings(now, "id", ["title", "body"])
    assert rows(index.match(q, ["w9"])) == rows(search.match(built, q, ["w9"], ["title", "body"]))
    want = [(k, round(s, 9)) for k, s in rows(search.bm25(built, q))]
    assert [(k, round(s, 9)) for k, s in rows(index.ranked(q))] == want
    best, _ = index.top(q, 7, first=2)
    assert [r["key"] for r in best.collect()] == [k for _, k in sorted((s, k) for k, s in want)[:7]]


def test_compaction_and_a_single_segment(spark, changed_index, tmp_path):
    index, now = changed_index
    alone = TextIndex(spark, str(tmp_path), buckets=4, shards=2, block=8)
    alone.add(now, "id", ["title", "body"])
    before = rows(index.ranked("w0 w1"))
    index.compact()
    assert len(index.segments()) == 1 and not index.segments()[0]["replaces"]
    assert rows(index.postings()) == rows(alone.postings())
    assert [(k, round(s, 9)) for k, s in rows(index.ranked("w0 w1"))] == [(k, round(s, 9)) for k, s in before]
    assert index.vacuum() == 3 and index.vacuum() == 0
    assert rows(index.postings()) == rows(alone.postings())
    keep = {k: index.segments()[0][k] for k in ("docs", "tokens", "blocks")}
    assert keep == {k: alone.segments()[0][k] for k in ("docs", "tokens", "blocks")}


def test_blocks_are_skipped_and_buckets_pruned(spark, tmp_path):
    rng = random.Random(4)
    docs = [(i, " ".join(["common"] * rng.randint(1, 3) + [f"x{rng.randint(0, 30)}" for _ in range(rng.randint(2, 300))])) for i in range(2000)]
    index = TextIndex(spark, str(tmp_path), buckets=16, block=16)
    df = spark.createDataFrame(docs, "id long, body string")
    index.add(df, "id", ["body"])
    best, share = index.top("common", 10, first=4)
    want = sorted((s, k) for k, s in rows(search.bm25(search.build_postings(df, "id", ["body"]), "common")))[:10]
    assert [r["key"] for r in best.collect()] == [k for _, k in want]
    assert share["read"] < share["blocks"] / 3
    plan = index._rows(index.segments()[0], ["common"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan.replace("isnotnull(bucket#", "bucket") or "PartitionFilters: [isnotnull(bucket" in plan


def test_empty_and_lost_races(spark, tmp_path):
    index = TextIndex(spark, str(tmp_path), buckets=2)
    empty = spark.createDataFrame([], "id long, body string")
    assert index.segments() == []
    index.add(empty, "id", ["body"])
    assert rows(index.ranked("a")) == [] and index.top("a")[0].count() == 0
    index.add(spark.createDataFrame([(1, "a b"), (2, None), (3, "")], "id long, body string"), "id", ["body"])
    index.add(None, "id", ["body"], spark.createDataFrame([(2,), (9,)], "id long"))
    assert [r[0] for r in rows(index.ranked("a"))] == [1]
    n = len(index.segments())
    index._commits = lambda: [1]  # another writer has committed since
    with pytest.raises(Exception):
        index._commit([])
    del index._commits
    assert len(index.segments()) == n


@pytest.mark.parametrize("text", ["ation", "ATION", "at", "", "na%ion", "x_y", "été", "b 日", "日本語", "zzz", "🙂🙂🙂"])
def test_substrings_by_grams(grams, text):
    index, df = grams
    want = rows(df.where(search.any_contains(["title", "body"], text)).select("id"))
    assert rows(index.substring(df, "id", ["title", "body"], text).select("id")) == want


@pytest.fixture(scope="module")
def grams(spark, tmp_path_factory):
    rng = random.Random(6)
    bits = ["nation", "Station", "ation", "at", "xzy", "x_y", "ÉTÉ", "b 日", "日本語文", "🙂🙂🙂", "\n", "na ion"]
    data = [(i, " ".join(rng.choice(bits) for _ in range(rng.randint(0, 6))), None if i % 5 == 0 else rng.choice(bits)) for i in range(150)]
    df = spark.createDataFrame(data, "id long, title string, body string")
    index = GramIndex(spark, str(tmp_path_factory.mktemp("grams")), buckets=4, block=16)
    index.add(df.where("id % 2 = 0"), "id", ["title", "body"])
    index.add(df.where("id % 2 = 1 or id < 20"), "id", ["title", "body"])
    return index, df


def test_tasks_grow_with_the_tokens(spark, tmp_path):
    """More tasks than buckets times shards, and blocks that arrive in several batches."""
    df = spark.createDataFrame(texts(400, 9), "id long, title string, body string")
    index = TextIndex(spark, str(tmp_path), buckets=1, shards=2, block=8)
    index.TOKENS_A_TASK = 500
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        index.add(df, "id", ["title", "body"])
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    built = search.build_postings(df, "id", ["title", "body"])
    assert len(list(tmp_path.glob("segments/*/postings/bucket=0/*.parquet"))) > 8
    assert rows(index.postings()) == rows(built.select("key", "col", "pos", "term"))
    want = sorted((round(s, 9), k) for k, s in rows(search.bm25(built, "w0 w1")))[:9]
    assert [(round(r["score"], 9), r["key"]) for r in index.top("w0 w1", 9, first=1)[0].collect()] == want
