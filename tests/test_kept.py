"""Diffs by digests and pages by directories against the plain forms."""

import uuid

import pytest
from pyspark.sql import functions as F

from albumen.operators import kept, snapshots


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture
def tables(spark):
    base = spark.range(2000).select(F.when(F.col("id") > 0, F.col("id")).alias("k"), F.when(F.col("id") % 7 > 0, F.concat(F.lit("c"), F.col("id") % 50)).alias("changekey"))
    made = {
        "base": base,
        "same": base.orderBy(F.desc("k")),
        "one": base.withColumn("changekey", F.when(F.col("k") == 77, F.lit("x")).otherwise(F.col("changekey"))),
        "many": base.where("k % 3 <> 0").unionByName(spark.createDataFrame([(5000, None), (5001, "c")], "k long, changekey string")).withColumn("changekey", F.when(F.col("k") % 2 == 0, F.col("changekey"))),
    }
    tag = f"t{uuid.uuid4().hex}"
    for name, df in made.items():
        kept.write_bucketed(df, f"{tag}_{name}", "k", buckets=16)
    kept.write_bucketed(base, f"{tag}_wide", "k", buckets=8)
    yield tag, made
    for name in (*made, "wide"):
        spark.sql(f"drop table {tag}_{name}")
        spark.sql(f"drop table {tag}_{name}_digests")


def test_diffs_equal_the_plain_form(spark, tables):
    tag, made = tables
    for name in ("same", "one", "many"):
        for deleted in (False, True):
            got = kept.diff_bucketed(spark, f"{tag}_base", f"{tag}_{name}", "k", deleted=deleted)
            assert rows(got.where("k is not null")) == rows(snapshots.diff_snapshots(made["base"], made[name], "k", deleted=deleted).where("k is not null"))
    assert rows(kept.diff_bucketed(spark, f"{tag}_wide", f"{tag}_one", "k").where("k is not null")) == [(77, "changed")]


def test_equal_buckets_are_not_read_and_nothing_is_shuffled(spark, tables):
    tag, _ = tables
    assert kept.changed_buckets(spark, f"{tag}_base", f"{tag}_same") == []
    (one,) = kept.changed_buckets(spark, f"{tag}_base", f"{tag}_one")
    read = kept.bucket_files(spark, f"{tag}_one", [one]).select("_metadata.file_name").distinct().collect()
    assert len(read) == 1 and f"_{one:05d}.c" in read[0][0]
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        diff = kept.diff_bucketed(spark, f"{tag}_base", f"{tag}_one", "k")
        plan = diff._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "SortMergeJoin" in plan
        assert rows(diff) == [(77, "changed")] or rows(diff.where("k is not null")) == [(77, "changed")]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.mark.parametrize("size", [1, 7, 48])
def test_pages_equal_a_full_sort(spark, tmp_path, size):
    df = spark.range(700).select((F.col("id") % 13).alias("a"), F.when(F.col("id") % 11 > 0, F.col("id") * 37 % 101).alias("b"), "id")
    order = [F.col("a").desc(), F.col("b").asc_nulls_last(), F.col("id")]
    table = kept.OrderedTable(spark, str(tmp_path / "t"), order)
    table.write(df, 12)
    whole = [tuple(r) for r in df.orderBy(*order).collect()]
    assert table.total() == 700
    for number in {1, 2, 700 // size // 2 + 1, -(-700 // size), -(-700 // size) + 1}:
        page, read = table.page(number, size)
        assert [tuple(r) for r in page.collect()] == whole[(number - 1) * size : number * size]
        assert read <= 2 + size // 40


def test_pages_of_nothing(spark, tmp_path):
    table = kept.OrderedTable(spark, str(tmp_path / "t"), [F.col("id")])
    table.write(spark.range(0))
    page, read = table.page(1, 10)
    assert page.count() == 0 == read and page.columns == ["id"]
