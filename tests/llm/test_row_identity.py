"""Rows without an id, repeated rows and rows that share an id are documents of their own."""

import random

import pytest

from albumen.llm import decontaminate, near_dedup

pytest.importorskip("public_tokenizers")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def text(seed, n=60):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(5000)}" for _ in range(n))


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], SCHEMA)


def test_near_duplicates_of_odd_rows(spark, tmp_path):
    import corpus_pipeline

    rows = [(None, text(1)), (None, text(2)), (5, text(1)), (7, text(3)), (7, text(3)), (8, text(4)), (8, text(5)), (9, text(5)), (None, text(2))]
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = near_dedup.op3_minhash_near_dedup(spark, str(tmp_path)).select("doc_id", "component_id", "kept").collect()
    want = [(None, 5, False), (5, 5, True), (None, None, True), (None, None, False), (7, 7, True), (7, 7, False), (8, 8, True), (8, 8, True), (9, 8, False)]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    left = corpus_pipeline.near_duplicates(spark, frame(spark, rows), "").select("doc_id", "text").collect()
    assert sorted(map(tuple, left), key=str) == sorted([(5, text(1)), (None, text(2)), (7, text(3)), (8, text(4)), (8, text(5))], key=str)


@pytest.mark.parametrize("limit", [decontaminate.SEEDS, 10])
def test_leaks_are_flagged_beside_their_rows(spark, tmp_path, monkeypatch, limit):
    import corpus_pipeline

    monkeypatch.setattr(decontaminate.flagged, "__defaults__", (*decontaminate.flagged.__defaults__[:-1], limit))
    item, other = text(10, 20), text(11, 20)
    rows = [(None, f"{text(1)} {item}"), (3, text(2)), (3, f"{text(3)} {other}"), (None, text(4)), (4, f"{item} {text(5)}")]
    spark.createDataFrame([(0, item), (1, other)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    left = corpus_pipeline.benchmark_leaks(spark, frame(spark, rows), str(tmp_path)).collect()
    assert sorted(((r["doc_id"], r["text"]) for r in left), key=str) == sorted([(3, text(2)), (None, text(4))], key=str)
