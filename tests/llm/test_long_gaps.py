"""Gaps without unique words are aligned at any length."""

import random

import pytest

from albumen.llm import license_scan


def longest(a, b):
    best = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b):
            before, best[j + 1] = best[j + 1], before + 1 if x == y else max(best[j + 1], best[j])
    return best[-1]


def test_common_subsequences():
    rng = random.Random(1)
    for _ in range(400):
        a, b = ([rng.randint(0, rng.choice([1, 3, 9])) for _ in range(rng.randint(0, 30))] for _ in range(2))
        pairs = license_scan._common(a, b)
        assert len(pairs) == longest(a, b) and all(a[i] == b[j] for i, j in pairs)
        assert all(p < r and q < s for (p, q), (r, s) in zip(pairs, pairs[1:], strict=False))


@pytest.mark.parametrize("n", [68, 80, 200, 2000])
def test_alternating_template_with_two_changes(n):
    notice = [k % 2 for k in range(n)]
    text = list(notice)
    text[n // 3], text[2 * n // 3] = 7, 8
    assert len(license_scan.align(text, notice)) == n - 2
    assert len(license_scan.align([9, *text[: n // 2], 5, *text[n // 2 :]], notice)) >= n - 3


@pytest.mark.parametrize("n", [80, 200, 2000])
def test_scan_finds_it(spark, n):
    words = ["alpha" if k % 2 else "beta" for k in range(n)]
    text = list(words)
    text[n // 3], text[2 * n // 3] = "other", "words"
    df = spark.createDataFrame([(1, "before " + " ".join(text) + " after"), (2, " ".join(["gamma"] * n))], "doc_id long, text string")
    got = {r["doc_id"]: r["license"] for r in license_scan.scan(df, notices=(("Two", " ".join(words)),)).collect()}
    assert got == {1: "Two", 2: None}
