"""Words that sums of powers modulo 2 ** 64 can't tell apart (Thue-Morse and its complement)."""

import re

import numpy as np
import pyarrow as pa
import pytest

from albumen.llm import bytesops, decontaminate, near_dedup


def thue_morse(n):
    word = "a"
    while len(word) < n:
        word += word.translate(str.maketrans("ab", "ba"))
    return word, word.translate(str.maketrans("ab", "ba"))


def hashes(texts, space=bytesops.IS_SPACE):
    return bytesops.words(*bytesops.string_bytes(pa.array(texts)), space)


@pytest.mark.parametrize("n", [8, 64, 256, 512, 1024, 2048, 4096, 8192])
def test_structured_words_are_apart(n):
    h, _, _ = hashes(list(thue_morse(n)))
    assert h[0] != h[1]


def test_hash_follows_the_letters_alone():
    rng = np.random.default_rng(2)
    texts = ["".join(rng.choice(list("abAB \n,"), rng.integers(0, 60))) for _ in range(500)] + ["x" * k for k in range(500, 530)] + ["", None, "é日本 é日本", "A" * 600 + " " + "a" * 600]
    for space, pattern in ((bytesops.IS_SPACE, r"[^\x20\x09-\x0D]+"), (bytesops.NOT_WORD, r"[^\W_]+")):
        h, row, _ = hashes(texts, space)
        words = [w for t in texts for w in re.findall(pattern, re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))]
        assert len(words) == len(h)
        assert len(set(words)) == len(set(h.tolist())) == len(set(zip(words, h.tolist(), strict=True)))


def test_near_dedup_keeps_them_apart(spark):
    one, two = thue_morse(2048)
    df = spark.createDataFrame([(1, one), (2, two), (3, one)], "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(df, k=2).collect()}
    assert got == {1: 1, 2: 2, 3: 1}


def test_decontamination_keeps_them_apart(spark):
    one, two = thue_morse(1024)
    df = spark.createDataFrame([(1, one), (2, two)], "doc_id long, text string")
    items = spark.createDataFrame([(1, one)], "item_id long, text string")
    got = {r["doc_id"]: r["contaminated"] for r in decontaminate.flagged(df, items, ("doc_id",)).collect()}
    assert got == {1: True, 2: False}
