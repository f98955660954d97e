"""Clusters by tiles and in one task against a plain loop."""

import math
import random

import pytest

from albumen.operators import clusters


def plain(points, zoom, pixels=40, deepest=18):
    world = lambda lat, lon: ((lon + 180) / 360, 0.5 - math.log((1 + math.sin(math.radians(lat))) / (1 - math.sin(math.radians(lat)))) / (4 * math.pi))
    places = {}
    for k, lat, lon in points:
        if lat is not None and lon is not None:
            places.setdefault((lat, lon), []).append(k)
    items = [(min(v), *world(*p), len(v)) for p, v in places.items()]
    for level in range(deepest, zoom - 1, -1):
        reach = pixels / (256 * 2**level)
        centres, joined = [], []
        for it in sorted(items, key=lambda t: (-t[3], t[0])):
            near = [c for c in centres if math.dist(it[1:3], c[1:3]) <= reach]
            (joined if near else centres).append(it)
        size = {c[0]: c[3] for c in centres}
        for it in joined:  # the nearest of all, once all are known
            at = min(range(len(centres)), key=lambda i: ((it[1] - centres[i][1]) ** 2 + (it[2] - centres[i][2]) ** 2, i))
            size[centres[at][0]] += it[3]
        items = [(c[0], c[1], c[2], size[c[0]]) for c in centres]
    return sorted((i, n) for i, _, _, n in items)


def cloud(seed, n):
    rng = random.Random(seed)
    out = [(i, round(rng.uniform(-60, 60), 5), round(rng.uniform(-170, 170), 5)) for i in range(n // 3)]
    out += [(n + i, round(48 + rng.gauss(0, 0.02), 5), round(2 + rng.gauss(0, 0.03), 5)) for i in range(n // 2)]
    out += [(3 * n + i, 48.00001, 2.00002) for i in range(130)] + [(5 * n, None, 1.0), (5 * n + 1, 1.0, None)]
    return out


@pytest.mark.parametrize(("zoom", "local"), [(4, 10**6), (13, 10**6), (14, 1), (16, 60)])
def test_clusters_equal_a_plain_loop(spark, tmp_path, zoom, local):
    points = cloud(zoom, 400)
    df = spark.createDataFrame(points, "id long, gps_lat double, gps_lon double")
    deepest = 18 if local > 1 else 15
    got = clusters.map_clusters(df, "id", zoom, str(tmp_path), local=local, deepest=deepest).collect()
    want = plain(points, zoom, deepest=deepest)
    assert sorted((r["id"], r["n"]) for r in got) == want
    assert sum(r["n"] for r in got) == len(points) - 2
    assert {r["size"] for r in got if r["n"] > 100} == {"large"} and all((r["n"] > 20) == (r["size"] != "small") for r in got)


def test_a_chain_across_seams(spark, tmp_path, monkeypatch):
    """Each item hangs on the one before it, over many small tiles."""
    monkeypatch.setattr(clusters, "TILE", 80)
    step = 30 / (256 * 2**15) * 360  # 30 pixels apart: every second one is a centre
    points = [(i, 0.0, round(i * step, 5)) for i in range(60)]
    df = spark.createDataFrame(points, "id long, gps_lat double, gps_lon double")
    got = clusters.map_clusters(df, "id", 15, str(tmp_path), local=1, deepest=15).collect()
    assert sorted((r["id"], r["n"]) for r in got) == plain(points, 15, deepest=15)


def test_no_points(spark, tmp_path):
    df = spark.createDataFrame([(1, None, None)], "id long, gps_lat double, gps_lon double")
    assert clusters.map_clusters(df, "id", 3, str(tmp_path)).count() == 0
