"""Nearest-neighbour and gazetteer place resolution on grids and trees, and location summaries."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import textcols as tc
from .spatial import KdTree

GRID = 0.01
METRES_PER_DEGREE = 111320.0


def _nearby_cells(lat: Column, size: float, radius_m: float) -> Column:
    """Offsets in longitude that a radius needs at a latitude (more towards the poles)."""
    width = F.lit(size * METRES_PER_DEGREE) * F.greatest(F.cos(F.radians(F.abs(lat))), F.lit(0.001))
    return F.ceil(F.lit(radius_m) / width).cast("int")


def nearest_join(points: DataFrame, places: DataFrame, key: str, place_key: str, radius_m: float, carried: list[str]) -> DataFrame:
    """(key, metres, carried...) of each point's nearest place within the radius; ties go to
    the least place_key. Places are reduced to one per coordinate and cell first, so a dense
    cell costs its distinct coordinates; points look into the cells that the radius reaches.
    The antimeridian is not crossed."""
    size = max(GRID, radius_m / METRES_PER_DEGREE)
    reach = _nearby_cells(F.col("gps_lat"), size, radius_m)
    cells = F.explode(F.flatten(F.transform(F.sequence(F.lit(-1), F.lit(1)), lambda dy: F.transform(F.sequence(-F.col("__reach"), F.col("__reach")), lambda dx: F.struct((F.col("__cy") + dy).alias("cy"), (F.col("__cx") + dx).alias("cx"))))))
    near = points.where("gps_lat is not null and gps_lon is not null").select(F.col(key), F.col("gps_lat"), F.col("gps_lon"))
    near = near.withColumns({"__reach": reach, "__cy": tc.cell(F.col("gps_lat"), size), "__cx": tc.cell(F.col("gps_lon"), size)}).withColumn("c", cells)
    held = places.where("gps_lat is not null and gps_lon is not null").groupBy(F.col("gps_lat").alias("plat"), F.col("gps_lon").alias("plon")).agg(F.min(F.struct(F.col(place_key).alias("pk"), *[F.col(c).alias(f"v_{c}") for c in carried])).alias("p"))
    held = held.withColumns({"cy": tc.cell(F.col("plat"), size), "cx": tc.cell(F.col("plon"), size)})
    both = near.select(key, "gps_lat", "gps_lon", "c.cy", "c.cx").join(held, ["cy", "cx"])
    both = both.withColumn("m", tc.metres(F.col("gps_lat"), F.col("gps_lon"), F.col("plat"), F.col("plon"))).where(F.col("m") <= radius_m)
    best = both.groupBy(key).agg(F.min(F.struct("m", "p")).alias("b"))
    return best.select(key, F.col("b.m").alias("metres"), *[F.col(f"b.p.v_{c}").alias(c) for c in carried])


def nearest_fill(df: DataFrame, key: str, radius_m: float = 100.0) -> DataFrame:
    """Rows with coordinates but no place take the name of their nearest placed row, marked
    as borrowed; rows that borrowed before are not lenders."""
    placed = df.where("place_name is not null and coalesce(place_source, '') <> 'nearby'")
    orphans = df.where("place_name is null")
    got = nearest_join(orphans, placed, key, key, radius_m, ["place_name"]).select(key, F.col("place_name").alias("__name"))
    out = df.join(got, key, "left")
    hit = F.col("place_name").isNull() & F.col("__name").isNotNull()
    return out.withColumns({"place_source": F.when(hit, "nearby").otherwise(F.col("place_source")), "place_name": F.coalesce("place_name", "__name")}).drop("__name")


def unresolved(df: DataFrame) -> DataFrame:
    return df.agg(F.count_if(F.col("gps_lat").isNotNull() & F.col("place_name").isNull()).alias("unresolved"))


def revert_nearby(df: DataFrame) -> DataFrame:
    """Undo nearest_fill."""
    borrowed = F.coalesce(F.col("place_source") == "nearby", F.lit(False))
    return df.withColumns({"place_name": F.when(~borrowed, F.col("place_name")), "place_source": F.when(~borrowed, F.col("place_source"))})


#: Gazetteer entries whose tree is broadcast at once; a larger one is looked through in parts.
ENTRIES = 1_000_000


def nearest_lookup(points: DataFrame, gazetteer: DataFrame, lat: str, lon: str, carried: list[str], entries: int = ENTRIES) -> DataFrame:
    """points with the nearest gazetteer entry of each distinct coordinate, by great-circle
    distance, at the poles and across 180 degrees too. gazetteer: lat, lon and the carried
    columns, which break ties in their order; entries without a coordinate are left out.

    The gazetteer becomes a k-d tree of the sphere's points, broadcast to the tasks, which
    search it for a batch of spots at once. One of over `entries` rows is split by a hash, one
    tree after the other, and the nearest of all stands: spots meet no other rows than those
    that a tree can't rule out."""
    spark = points.sparkSession
    spots = points.where(F.col(lat).isNotNull() & F.col(lon).isNotNull()).select(F.col(lat).cast("double").alias("a"), F.col(lon).cast("double").alias("o")).distinct()
    towns = gazetteer.where("lat is not null and lon is not null").select(F.col("lat").cast("double").alias("__lat"), F.col("lon").cast("double").alias("__lon"), *carried)
    parts = max(1, -(-towns.count() // entries))
    found = None
    for i in range(parts):
        part = towns if parts == 1 else towns.where(F.pmod(F.xxhash64("__lat", "__lon", *carried), F.lit(parts)) == i)
        held = part.orderBy(*carried, "__lat", "__lon").toArrow()
        tree = spark.sparkContext.broadcast(KdTree(held.column("__lat").to_numpy(), held.column("__lon").to_numpy()))

        def search(batches: Iterator[pa.RecordBatch], tree=tree) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at, far = tree.value.nearest(batch.column(0).to_numpy(), batch.column(1).to_numpy())
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(at), pa.array(far)], names=["a", "o", "i", "far"])

        numbered = held.drop_columns(["__lat", "__lon"]).append_column("__i", pa.array(range(held.num_rows), pa.int64()))
        names = spark.createDataFrame(numbered).withColumnsRenamed({c: f"v_{c}" for c in carried})
        one = spots.mapInArrow(search, "a double, o double, i long, far double").join(F.broadcast(names), F.col("i") == F.col("__i")).select("a", "o", "far", *[f"v_{c}" for c in carried])
        found = one if found is None else found.unionByName(one)
    if parts > 1:
        best = F.min(F.struct("far", *[f"v_{c}" for c in carried])).alias("b")
        found = found.groupBy("a", "o").agg(best).select("a", "o", "b.*")
    found = found.select(F.col("a").alias(lat), F.col("o").alias(lon), *[F.col(f"v_{c}").alias(c) for c in carried])
    return points.join(found, [lat, lon], "left")


def location_cells(df: DataFrame, least: int = 1, digits: int = 2) -> DataFrame:
    """Rows per year and rounded coordinate, those with at least `least`."""
    out = df.where("gps_lat is not null and gps_lon is not null and date is not null")
    out = out.groupBy(tc.year_of(F.col("date")).alias("yr"), F.round("gps_lat", digits).alias("lat"), F.round("gps_lon", digits).alias("lon")).agg(F.count("*").alias("cnt"))
    return out.where(F.col("cnt") >= least)


def location_summary(cells: DataFrame, gazetteer: DataFrame, names: DataFrame | None = None, cities: int = 5) -> DataFrame:
    """Per year and country: rows, rank by rows, and the top cities. Distinct coordinates are
    looked up once; unknown codes and cities get the fixed words for that."""
    placed = nearest_lookup(cells, gazetteer, "lat", "lon", ["city", "cc"])
    placed = placed.withColumns({"city": F.coalesce("city", F.lit("Unknown")), "cc": F.coalesce("cc", F.lit("??"))})
    city = placed.groupBy("yr", "cc", "city").agg(F.sum("cnt").alias("n"))
    w = Window.partitionBy("yr", "cc").orderBy(F.desc("n"), "city")
    top = city.withColumn("r", F.row_number().over(w)).where(F.col("r") <= cities).groupBy("yr", "cc").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "city"))), lambda x: x["city"]), "|").alias("top_cities"))
    total = city.groupBy("yr", "cc").agg(F.sum("n").alias("n"))
    out = total.join(top, ["yr", "cc"])
    if names is not None:
        out = out.join(names, "cc", "left").withColumn("country", F.coalesce("country", "cc"))
    rank = F.row_number().over(Window.partitionBy("yr").orderBy(F.desc("n"), "cc"))
    return out.withColumn("rank", rank)


def colocate(df: DataFrame, key: str, digits: int = 5, cap: int = 200) -> DataFrame:
    """Points at one rounded place: count, first members and how many more there are."""
    at = df.where("gps_lat is not null and gps_lon is not null").select(key, F.round("gps_lat", digits).alias("lat"), F.round("gps_lon", digits).alias("lon"))
    w = Window.partitionBy("lat", "lon").orderBy(key)
    head = at.withColumn("r", F.row_number().over(w)).where(F.col("r") <= cap).groupBy("lat", "lon").agg(F.array_sort(F.collect_list(key)).alias("members"))
    total = at.groupBy("lat", "lon").agg(F.count("*").alias("n"))
    return total.join(head, ["lat", "lon"]).withColumn("more", F.greatest(F.col("n") - cap, F.lit(0)))


def cluster_points(df: DataFrame, zoom: int, pixels: int = 40) -> DataFrame:
    """Web-Mercator pixel grid at a zoom level: count, centre and size class per cell."""
    world = float(256 * 2**zoom)
    lat = F.greatest(F.least(F.col("gps_lat"), F.lit(85.05112878)), F.lit(-85.05112878))
    px = (F.col("gps_lon") + 180.0) / 360.0 * world
    sin = F.sin(F.radians(lat))
    py = (F.lit(0.5) - F.log((1 + sin) / (1 - sin)) / (4 * math.pi)) * world
    at = df.where("gps_lat is not null and gps_lon is not null").groupBy(F.floor(px / pixels).cast("long").alias("gx"), F.floor(py / pixels).cast("long").alias("gy"))
    out = at.agg(F.count("*").alias("n"), F.avg("gps_lat").alias("lat"), F.avg("gps_lon").alias("lon"))
    return out.withColumn("size", F.when(F.col("n") > 100, "large").when(F.col("n") > 20, "medium").otherwise("small"))
