"""The nearest entry by great circle, across 180 degrees, at the poles and far away."""

import math
import random

import numpy as np
import pytest

from albumen.operators import geo
from albumen.operators.spatial import LEAF, KdTree


def arc(a, b):
    (p, q), (r, s) = ([math.radians(x) for x in c] for c in (a, b))
    h = math.sin((r - p) / 2) ** 2 + math.cos(p) * math.cos(r) * math.sin((s - q) / 2) ** 2
    return 2 * math.asin(min(1.0, math.sqrt(h)))


def lookup(spark, spots, towns, entries=geo.ENTRIES):
    points = spark.createDataFrame(spots, "lat double, lon double")
    held = spark.createDataFrame([(*c, i) for i, c in enumerate(towns)], "lat double, lon double, town long")
    out = geo.nearest_lookup(points, held, "lat", "lon", ["town"], entries)
    assert "CartesianProduct" not in (plan := out._jdf.queryExecution().toString()) and "NestedLoop" not in plan
    return {(r["lat"], r["lon"]): r["town"] for r in out.collect()}


def test_nearest_crosses_the_antimeridian(spark):
    assert lookup(spark, [(-17.0, 179.9)], [(-17.3, 179.5), (-17.0, -179.95)]) == {(-17.0, 179.9): 1}


@pytest.mark.parametrize("entries", [geo.ENTRIES, 50])
def test_nearest_equals_brute_force(spark, entries):
    rng = random.Random(2)
    spot = lambda: (math.degrees(math.asin(rng.uniform(-1, 1))), rng.uniform(-180, 180))
    towns = [spot() for _ in range(150)] + [(rng.uniform(-80, 80), rng.choice([-1, 1]) * rng.uniform(179, 180)) for _ in range(40)]
    spots = [spot() for _ in range(60)] + [(rng.uniform(-80, 80), rng.choice([-1, 1]) * rng.uniform(179, 180)) for _ in range(60)] + [(89.9, 10.0), (-90.0, 0.0), (90.0, 0.0)]
    for some in (towns, towns[:1], [(-80.0, 5.0), (-79.0, 5.0)]):
        got = lookup(spark, spots, some, entries)
        assert all(math.isclose(arc(c, some[got[c]]), min(arc(c, t) for t in some), abs_tol=1e-12) for c in spots)


def test_nearest_without_entries(spark):
    points = spark.createDataFrame([(1.0, 2.0)], "lat double, lon double")
    assert geo.nearest_lookup(points, points.limit(0).selectExpr("lat", "lon", "1 as town"), "lat", "lon", ["town"]).first()["town"] is None


def test_ties_and_equal_places(spark):
    points = spark.createDataFrame([(0.0, 0.0), (None, 1.0)], "lat double, lon double")
    held = spark.createDataFrame([(5.0, 0.0, "b"), (5.0, 0.0, "a"), (None, 0.0, "0"), (40.0, 0.0, "A")], "lat double, lon double, town string")
    assert [r["town"] for r in geo.nearest_lookup(points, held, "lat", "lon", ["town"]).orderBy("lat").collect()] == [None, "a"]


@pytest.mark.parametrize("n", [1, LEAF, LEAF + 1, 3000])
def test_tree_equals_brute_force(n):
    rng = np.random.default_rng(n)
    lat, lon = np.degrees(np.arcsin(rng.uniform(-1, 0.2, n))), rng.uniform(-180, 180, n)  # an empty north
    lat[: n // 3], lon[: n // 3] = lat[0], lon[0]  # a third at one place
    a, o = np.degrees(np.arcsin(rng.uniform(-1, 1, 500))), rng.uniform(-180, 180, 500)
    a, o = np.append(a, lat[:50]), np.append(o, lon[:50])
    at, far = KdTree(lat, lon).nearest(a, o)
    r = np.radians
    h = np.sin((r(lat)[None] - r(a)[:, None]) / 2) ** 2 + np.cos(r(a))[:, None] * np.cos(r(lat))[None] * np.sin((r(lon)[None] - r(o)[:, None]) / 2) ** 2
    assert (at == h.argmin(axis=1)).all() and np.array_equal(far, h.min(axis=1))
