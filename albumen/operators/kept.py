"""Tables that are kept in an order that later work can use: snapshots in buckets with a digest
each, so that a diff reads what differs, and ordered tables with a directory of counts, so
that any page is found without sorting."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from .snapshots import diff_snapshots

# --- snapshots in buckets --------------------------------------------------------


def write_bucketed(df: DataFrame, table: str, key: str, changekey: str = "changekey", buckets: int = 64) -> None:
    """df as a table in buckets of its key, one sorted file each, and beside it (<table>_digests) for
    each bucket its rows and a digest of their keys and change keys that doesn't depend on
    their order. Null keys are a key like others."""
    df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key).saveAsTable(table)
    row = F.xxhash64(F.col(key), F.col(changekey), F.col(changekey).isNull())
    again = F.xxhash64(F.lit(7), F.col(changekey), F.col(key), F.col(changekey).isNull())
    spark = df.sparkSession
    each = spark.table(table).groupBy(_bucket(key, buckets).alias("bucket"))
    each.agg(F.count("*").alias("n"), F.sum(row.cast("decimal(38,0)")).alias("one"), F.bit_xor(again).alias("two"), F.lit(buckets).alias("buckets")).write.saveAsTable(f"{table}_digests")


def _bucket(key: str, buckets: int) -> Column:
    return F.pmod(F.hash(F.col(key)), F.lit(buckets))  # as the writer deals rows to buckets


def changed_buckets(spark: SparkSession, old: str, new: str) -> list[int] | None:
    """Buckets whose digests differ; None where the tables have different numbers of buckets. What
    comes to the driver is at most one number a bucket."""
    o, n = (spark.table(f"{t}_digests") for t in (old, new))
    counts = [r[0] for d in (o, n) for r in d.select("buckets").distinct().collect()]
    if len(set(counts)) > 1:
        return None
    both = o.select("bucket", F.struct("n", "one", "two").alias("o")).join(n.select("bucket", F.struct("n", "one", "two").alias("w")), "bucket", "full")
    return sorted(r["bucket"] for r in both.where(~F.col("o").eqNullSafe(F.col("w"))).select("bucket").collect())


def bucket_files(spark: SparkSession, table: str, buckets: Sequence[int] | None) -> DataFrame:
    """A bucketed table's rows of some buckets: the other files aren't opened, and the buckets
    stay usable for joins."""
    df = spark.table(table)
    if buckets is None:
        return df
    ends = "|".join(f"{b:05d}" for b in buckets) or "none"
    return df.where(F.col("_metadata.file_name").rlike(rf"_({ends})\.c\d+"))


def diff_bucketed(spark: SparkSession, old: str, new: str, key: str, changekey: str = "changekey", deleted: bool = False) -> DataFrame:
    """diff_snapshots of two tables of write_bucketed. Equal buckets are never read, and the join
    needs no shuffle: bucket meets bucket. Tables with different numbers of buckets are
    compared whole. Digests are of 128 bits: two different buckets pass for equal once in far
    more diffs than there will be."""
    some = changed_buckets(spark, old, new)
    return diff_snapshots(bucket_files(spark, old, some), bucket_files(spark, new, some), key, changekey, deleted)


# --- ordered tables --------------------------------------------------------------


class OrderedTable:
    """A table below a folder that all executors share, cut into ranges of its order by sampled
    quantiles and sorted within; a directory has the rows of each range. A page is in the one
    or two ranges that its number leads to: nothing else is read, nothing sorted but those."""

    def __init__(self, spark: SparkSession, path: str, order: Sequence[Column]):
        self.spark, self.path, self.order = spark, path.rstrip("/"), list(order)

    def write(self, df: DataFrame, ranges: int = 200) -> None:
        """order: of all rows, ended by a key, so that no two are equal (rows that are lie in one range)."""
        cut = df.repartitionByRange(ranges, *self.order).withColumn("__range", F.spark_partition_id())
        cut.sortWithinPartitions(*self.order).write.partitionBy("__range").parquet(f"{self.path}/rows")
        self.spark.createDataFrame([(df.schema.json(),)], "value string").coalesce(1).write.text(f"{self.path}/schema")
        self._rows().groupBy("__range").agg(F.count("*").alias("n")).coalesce(1).write.parquet(f"{self.path}/directory")

    def _rows(self) -> DataFrame:
        schema = StructType.fromJson(json.loads(self.spark.read.text(f"{self.path}/schema").first()[0]))
        return self.spark.read.schema(StructType([*schema.fields, StructField("__range", IntegerType())])).parquet(f"{self.path}/rows")

    def _directory(self) -> list[tuple[int, int]]:
        return sorted((r["__range"], r["n"]) for r in self.spark.read.schema("__range int, n long").parquet(f"{self.path}/directory").collect())

    def total(self) -> int:
        return sum(n for _, n in self._directory())

    def page(self, number: int, size: int) -> tuple[DataFrame, int]:
        """(rows of page `number`, from 1, in order; how many ranges are read)."""
        first, last = (number - 1) * size, number * size
        picked, before, skip = [], 0, 0
        for which, n in self._directory():
            if before + n > first and before < last:
                if not picked:
                    skip = first - before
                picked.append(which)
            before += n
        rows = self._rows().where(F.col("__range").isin(*picked) if picked else F.lit(False))
        return rows.orderBy(*self.order).offset(max(0, skip)).limit(size).drop("__range"), len(picked)
