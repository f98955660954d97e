"""Decontamination finds every stretch that it promises, at every length."""

import itertools
import random

import numpy as np
import pytest

from albumen.llm import decontaminate as d
from tests.llm.test_ops import brute_overlap


def patterns(n, places):
    for k in range(d.spare(n, d.MATCH) + 1):
        for gone in itertools.combinations(places, k):
            yield sum(1 << i for i in range(n) if i not in gone)


def missed(n, masks, places):
    held = np.array(list(patterns(n, places)), dtype=np.int64)
    hit = np.zeros(len(held), dtype=bool)
    for m in masks:
        for s in range(n - len(m) + 1):
            bits = sum(1 << (i + s) for i, c in enumerate(m) if c == "1")
            hit |= held & bits == bits
    return int((~hit).sum())


@pytest.mark.parametrize("n", range(1, 27))
def test_masks_hit_all_patterns(n):
    """With equal ends where the item is short; wherever they are from 13 tokens on, which
    proves the lengths beyond twice that."""
    places = range(n) if n >= d.OVERLAP else range(1, n - 1)
    assert missed(n, d.masks_of(n), places) == 0


def hit(doc, item, overlap=d.OVERLAP, match=d.MATCH):
    test = d.TestSet([0], [np.array(item, dtype=np.uint64)], overlap, match)
    got = d.overlaps(test, np.array(doc, dtype=np.uint64), np.array([0, len(doc)]), overlap, match).get(0)
    return got and got[1:]


@pytest.mark.parametrize(("overlap", "match"), [(13, 0.8), (13, 0.9), (20, 0.8), (5, 0.8), (13, 0.6), (12, 0.5)])
def test_overlaps_equal_brute_force(overlap, match):
    rng = random.Random(1)
    for _ in range(250):
        item = list(range(1, rng.randrange(2, 32)))
        doc = [x if rng.random() > rng.choice([0.1, 0.2, 0.35]) else 99 for x in item]
        doc = [77] * rng.randrange(3) + doc + [78] * rng.randrange(3)
        assert hit(doc, item, overlap, match) == brute_overlap(doc, item, overlap, match)


def test_a_stretch_beside_a_longer_trimmed_one():
    item = list(range(1, 60))
    doc = [99] * 3 + item[3:15] + [99] * 20 + item[35:39] + [99] + item[40:44] + [99] + item[45:48] + [99] * 11
    assert hit(doc, item) == brute_overlap(doc, item) == (13, 11)


@pytest.mark.parametrize("pairs", [4, 1 << 12])
def test_repeated_tokens(monkeypatch, pairs):
    """Few different tokens, so that nearly all diagonals are hit."""
    monkeypatch.setattr(d, "PAIRS", pairs)
    rng = random.Random(5)
    for _ in range(200):
        item, doc = ([rng.randrange(3) for _ in range(rng.randrange(1, 34))] for _ in range(2))
        assert hit(doc, item) == brute_overlap(doc, item)


def test_many_equal_tokens():
    assert hit([5] * 20_000, [5] * 20_000) == (20_000, 20_000)
    assert hit([5] * 20_000, [5] * 9_000 + [6] + [5] * 9_000) == (18_001, 18_000)
