"""The pipeline's stages against brute force on a small fixture."""

import random

import pytest

from albumen.llm import decontaminate, suffix_dedup
from tests.llm.test_ops import brute_groups, brute_overlap

P = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def fixture(spark, tmp_path_factory):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 8)))
    vocab = [word() for _ in range(2000)]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    passage, item = text(60), text(25)
    rows = []
    for i in range(80):
        t = text(rng.randrange(30, 120))
        if i % 10 == 3:
            t = f"{t} {passage} {text(10)}"
        if i % 16 == 5:
            t = f"{t} {item}"
        rows.append((i, t))
    rows += [(100 + i, rows[i][1]) for i in range(10)]
    rows += [(200 + i, rows[i][1] + " tail") for i in range(20, 26)]
    rows += [(300, None), (301, "12 34 !!"), (302, "")]
    path = str(tmp_path_factory.mktemp("in"))
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, rows, item


def expected(rows, item):
    docs = {i: t for i, t in rows if t and any(c.isalpha() for c in t)}
    groups = brute_groups(list(docs.items()), 5)
    docs = {i: t for i, t in docs.items() if groups[i][2]}
    cut = {}
    seen = set()
    for i in sorted(docs):
        raw = docs[i].encode()
        gone = set()
        for a in range(len(raw) - suffix_dedup.WIDTH + 1):
            w = raw[a : a + suffix_dedup.WIDTH]
            if w in seen:
                gone |= set(range(a, a + suffix_dedup.WIDTH))
            seen.add(w)
        left = bytes(b for a, b in enumerate(raw) if a not in gone).decode()
        if not gone or left.strip():
            cut[i] = left
    return {i: t for i, t in cut.items() if brute_overlap(t.split(), item.split(), decontaminate.OVERLAP) is None}


def test_pipeline_equals_brute_force(spark, fixture):
    import sentencepiece as sp

    import corpus_pipeline

    path, rows, item = fixture
    want = expected(rows, item)
    lib = sp.SentencePieceProcessor(model_file=P.path(corpus_pipeline.TOKENIZER))
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, path).collect()}
    assert set(got) == set(want)
    assert all(got[i]["ids"] == lib.encode(t, add_eos=True) for i, t in want.items())


def test_stages_keep_the_columns(spark, fixture):
    import corpus_pipeline

    path, rows, _ = fixture
    docs = spark.read.parquet(f"{path}/documents.parquet")
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, path)
        assert out.columns == docs.columns, name
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, path).count() == 0
