"""Clusters of map points as a map draws them: from the deepest zoom up, what lies within some
pixels of a centre joins it."""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEEPEST, PIXELS = 18, 40
TILE = 1024  # pixels of a tile's side; distinct places of five digits keep what one holds bounded
LOCAL = 50_000  # items that one task finishes
UNDECIDED, CENTRE, JOINED = 0, 1, 2
_ITEMS = "id long, x double, y double, n long"


def _world(lat: Column, lon: Column) -> tuple[Column, Column]:
    """Web-Mercator places, as shares of the world's width."""
    s = F.sin(F.radians(F.greatest(F.least(lat, F.lit(85.05112878)), F.lit(-85.05112878))))
    return (lon + 180.0) / 360.0, F.lit(0.5) - F.log((1 + s) / (1 - s)) / (4 * math.pi)


def _near(grid: dict, x: float, y: float, reach: float) -> Iterator[int]:
    cx, cy = int(x // reach), int(y // reach)
    for i in (cx - 1, cx, cx + 1):
        for j in (cy - 1, cy, cy + 1):
            yield from grid.get((i, j), ())


def _decide(x: np.ndarray, y: np.ndarray, status: np.ndarray, mine: np.ndarray, reach: float) -> np.ndarray:
    """Statuses of items in the order of their rank. One of mine with a centre before it within
    reach joins; with an undecided item there it stays undecided; else it is a centre. Others
    keep theirs."""
    out = status.copy()
    grid: dict[tuple[int, int], list[int]] = {}
    for k in range(len(x)):
        if out[k] == UNDECIDED and mine[k]:
            near = [out[m] for m in _near(grid, x[k], y[k], reach) if (x[m] - x[k]) ** 2 + (y[m] - y[k]) ** 2 <= reach * reach]
            out[k] = JOINED if CENTRE in near else UNDECIDED if UNDECIDED in near else CENTRE
        if out[k] != JOINED:
            grid.setdefault((int(x[k] // reach), int(y[k] // reach)), []).append(k)
    return out


def _nearest_centre(x: np.ndarray, y: np.ndarray, status: np.ndarray, reach: float) -> np.ndarray:
    """Of each item its centre's number (its own for a centre): the nearest, ties to the first."""
    grid: dict[tuple[int, int], list[int]] = {}
    for k in np.flatnonzero(status == CENTRE).tolist():
        grid.setdefault((int(x[k] // reach), int(y[k] // reach)), []).append(k)
    out = np.arange(len(x))
    for k in np.flatnonzero(status == JOINED).tolist():
        out[k] = min(((x[m] - x[k]) ** 2 + (y[m] - y[k]) ** 2, m) for m in _near(grid, x[k], y[k], reach))[1]
    return out


def _sorted(pdf: pd.DataFrame) -> pd.DataFrame:
    return pdf.sort_values(["n", "id"], ascending=[False, True], ignore_index=True)


def _levels(pdf: pd.DataFrame, levels: list[int], pixels: int) -> pd.DataFrame:
    """All levels of items that one task holds."""
    for level in levels:
        pdf = _sorted(pdf)
        reach = pixels / (256 * 2**level)
        x, y = pdf["x"].to_numpy(), pdf["y"].to_numpy()
        status = _decide(x, y, np.zeros(len(pdf), np.int64), np.ones(len(pdf), bool), reach)
        own = _nearest_centre(x, y, status, reach)
        n = np.bincount(own, weights=pdf["n"], minlength=len(pdf)).astype(np.int64)
        pdf = pdf.assign(n=n)[status == CENTRE]
    return pdf


def _halo(items: DataFrame, side: float, reach: float) -> DataFrame:
    """Items by tile, with copies (own: false) in the tiles that they are within reach of."""
    tile = lambda c, d: F.floor((F.col(c) + d) / side).cast("long")
    spots = F.array_distinct(F.array(*[F.struct(tile("x", a).alias("tx"), tile("y", b).alias("ty")) for a in (0.0, -reach, reach) for b in (0.0, -reach, reach)]))
    return items.withColumn("t", F.explode(spots)).select("*", "t.tx", "t.ty", ((F.col("t.tx") == tile("x", 0.0)) & (F.col("t.ty") == tile("y", 0.0))).alias("own")).drop("t")


def _one_level(items: DataFrame, level: int, pixels: int, folder: str) -> DataFrame:
    """One level over tiles. A tile decides what its own items and the copies around it tell; what
    hangs on a neighbour's undecided item waits for the next round, in which that is decided."""
    spark = items.sparkSession
    reach = pixels / (256 * 2**level)
    side = reach * TILE / pixels

    def decide(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = _sorted(pdf)
        # a copy's own neighbours aren't all here, so it keeps what its tile has told
        status = _decide(pdf["x"].to_numpy(), pdf["y"].to_numpy(), pdf["status"].to_numpy(), pdf["own"].to_numpy(), reach)
        return pdf.assign(status=status)[pdf["own"]][["id", "x", "y", "n", "status"]]

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = _sorted(pdf)
        status = np.where(pdf["own"] | (pdf["status"] == CENTRE), pdf["status"], -1)
        own = _nearest_centre(pdf["x"].to_numpy(), pdf["y"].to_numpy(), status, reach)
        return pd.DataFrame({"id": pdf["id"].to_numpy()[own], "n": pdf["n"]})[pdf["own"]]

    def kept(df: DataFrame) -> DataFrame:
        path = f"{folder}/{uuid.uuid4().hex}"
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    state = items.withColumn("status", F.lit(UNDECIDED))
    while True:
        state = kept(_halo(state, side, reach).groupBy("tx", "ty").applyInPandas(decide, f"{_ITEMS}, status int"))
        if state.where(F.col("status") == UNDECIDED).isEmpty():
            break
    members = _halo(state, side, reach).groupBy("tx", "ty").applyInPandas(join, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    return kept(state.where(F.col("status") == CENTRE).select("id", "x", "y").join(members, "id").select("id", "x", "y", "n"))


def map_clusters(df: DataFrame, key: str, zoom: int, folder: str, lat: str = "gps_lat", lon: str = "gps_lon", pixels: int = PIXELS, deepest: int = DEEPEST, local: int = LOCAL) -> DataFrame:
    """(id, lat, lon, n, size) of the clusters at a zoom: id is the least key at the centre's place,
    n the points, size small, medium (over 20) or large (over 100). Points without coordinates
    are in none.

    Points at one place of five digits are one item. At each zoom from the deepest to the one
    asked for, items are taken by size (ties: least id): one within `pixels` of a centre joins
    the nearest centre, any other becomes a centre; centres are the items of the next zoom. Many
    items are worked on by tiles with copies along their seams, in rounds until none hangs
    on another tile; once there are at most `local`, one task does the zooms that are left.
    Both give the same clusters. folder: for the tables between rounds, shared by all executors."""
    spots = df.where(F.col(lat).isNotNull() & F.col(lon).isNotNull()).select(F.round(lat, 5).alias("lat"), F.round(lon, 5).alias("lon"), F.col(key).cast("long").alias("k"))
    places = spots.groupBy("lat", "lon").agg(F.min("k").alias("id"), F.count("*").alias("n"))
    x, y = _world(F.col("lat"), F.col("lon"))
    items = places.select("id", x.alias("x"), y.alias("y"), "n")
    levels = list(range(deepest, zoom - 1, -1))
    while levels and items.count() > local:
        items = _one_level(items, levels.pop(0), pixels, folder)
    if levels:
        items = items.repartition(1).mapInPandas(lambda batches: iter([_levels(pd.concat(list(batches)), levels, pixels)]), _ITEMS)
    size = F.when(F.col("n") > 100, "large").when(F.col("n") > 20, "medium").otherwise("small")
    return items.join(places.select("id", "lat", "lon"), "id").select("id", "lat", "lon", "n", size.alias("size"))
