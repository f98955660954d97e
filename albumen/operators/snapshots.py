"""Snapshot manifests, their differences, and committing new versions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import textcols as tc


def child_counts(df: DataFrame, key: str, name: str) -> DataFrame:
    return df.where(F.col(key).isNotNull()).groupBy(F.col(key)).agg(F.count("*").alias(name))


def build_manifest(assets: DataFrame, key: str, year: Column, signals: Sequence[str], children: Mapping[str, tuple[DataFrame, str]]) -> DataFrame:
    """(key, year, changekey, counts): children, counted before the join, are 0 where absent."""
    out = assets
    for name, (child, fk) in children.items():
        out = out.join(child_counts(child, fk, name).withColumnRenamed(fk, key), key, "left").withColumn(name, F.coalesce(name, F.lit(0).cast("long")))
    return out.select(key, year.alias("year"), tc.change_key(*[F.col(c) for c in signals], *[F.col(c) for c in children]).alias("changekey"), *children)


def diff_snapshots(old: DataFrame, new: DataFrame, key: str, changekey: str = "changekey", deleted: bool = False) -> DataFrame:
    """Keys that are new or whose change key differs (nulls are values), with their kind;
    deletions only where asked for."""
    o = old.select(key, F.col(changekey).alias("__old"), F.lit(True).alias("__had"))
    n = new.select(key, F.col(changekey).alias("__new"), F.lit(True).alias("__has"))
    both = n.join(o, key, "full" if deleted else "left")
    kind = F.when(F.col("__had").isNull(), "new").when(F.col("__has").isNull(), "deleted").when(~F.col("__old").eqNullSafe(F.col("__new")), "changed")
    return both.select(key, kind.alias("kind")).where("kind is not null")


def diff_summary(old: DataFrame, new: DataFrame, changed: DataFrame) -> DataFrame:
    count = lambda d, n: d.agg(F.count("*").alias(n))
    return count(new, "assets").join(F.broadcast(count(old, "prior"))).join(F.broadcast(count(changed, "changed")))


def audit_line(changed: DataFrame, key: str, at: Column, n: int = 50) -> DataFrame:
    """Counts and the first keys of a change set, as one row. Keys beyond n are not gathered."""
    first = changed.select(key).orderBy(key).limit(n).agg(F.array_sort(F.collect_list(F.col(key).cast("string"))).alias("keys"))
    total = changed.agg(F.count("*").alias("n"))
    text = F.concat(F.array_join("keys", ","), F.when(F.col("n") > n, "…").otherwise(""))
    return total.join(F.broadcast(first)).select(at.alias("at"), "n", text.alias("keys"))


def group_changed(changed: DataFrame, key: str, year: Column, windows: Sequence[str]) -> DataFrame:
    """Changed keys with their export window (null: not mapped). Write partitioned by window;
    group_sizes counts them."""
    return changed.withColumn("window", tc.year_window(year, windows))


def group_sizes(grouped: DataFrame) -> DataFrame:
    return grouped.groupBy("window").agg(F.count("*").alias("n"))


# --- versions ----------------------------------------------------------------


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p, jvm.org.apache.hadoop.fs.Path


def versions(spark: SparkSession, path: str) -> list[int]:
    """Committed versions below a path: those whose promotion mark was written."""
    fs, p, make = _fs(spark, path)
    if not fs.exists(p):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(p)]
    return sorted(int(n[2:]) for n in names if n.startswith("v=") and fs.exists(make(f"{path}/{n}/_PROMOTED")))


def write_snapshot(df: DataFrame, path: str, compression: str | None = None) -> int:
    """Write the next version; readers don't see it until promote(). compression: a codec of Parquet
    in place of the session's."""
    fs, p, _ = _fs(df.sparkSession, path)
    names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
    n = max([int(x[2:]) for x in names if x.startswith("v=")], default=0) + 1
    df.write.mode("errorifexists").parquet(f"{path}/v={n}", compression=compression)
    return n


def promote(spark: SparkSession, path: str, version: int) -> None:
    """Make a version the baseline, once the job that used it has succeeded."""
    fs, _, make = _fs(spark, path)
    fs.create(make(f"{path}/v={version}/_PROMOTED"), False).close()


def read_snapshot(spark: SparkSession, path: str, version: int | None = None) -> DataFrame | None:
    """The newest promoted version (or a given one); None where there is none."""
    have = versions(spark, path)
    if not have:
        return None
    return spark.read.parquet(f"{path}/v={have[-1] if version is None else version}")
