"""Inputs that the given tables don't have: long lists, many rows without a file, late years."""

import time

import duckdb
import pytest
from pyspark.sql import functions as F

from albumen.functions import textcols as tc
from albumen.queries import ORACLES, QUERIES

from .test_oracles import rows


def test_lists_take_time_by_their_length(spark):
    """What is taken away, and the lower-case list, are worked out once a row, not for each word."""
    text = " ".join(f"Word{i % 5000}" for i in range(60_000))
    a = F.split(F.col("t"), " ")
    df = spark.createDataFrame([(text,)], "t string").select(F.size(tc.minus_ci(a, F.slice(a, 3, 7))).alias("left"), tc.clean_list(a).alias("clean"))
    began = time.time()
    got = df.first()
    assert got["left"] == 60_000 - 7 * 12
    assert got["clean"] == [f"Word{i}" for i in range(60)]
    assert time.time() - began < 20


def test_lists_with_nulls(spark):
    df = spark.createDataFrame([(1, ["B", None, "b", "c"], ["C "]), (2, None, ["x"]), (3, ["x"], None)], "k int, a array<string>, gone array<string>")
    got = {r["k"]: (r["d"], r["m"]) for r in df.select("k", tc.ordered_ci_distinct(F.col("a")).alias("d"), tc.minus_ci(F.col("a"), F.col("gone")).alias("m")).collect()}
    assert got == {1: (["B", "c"], ["B", "b"]), 2: (None, None), 3: (["x"], [])}


def against_sql(spark, folder, name):
    """A query and its SQL on the tables of a folder."""
    duck = duckdb.connect()
    for f in folder.iterdir():
        duck.sql(f"create view {f.name.removesuffix('.parquet')} as select * from '{f}/*.parquet'")
    got, want = QUERIES[name](spark, str(folder)).toPandas(), duck.sql(ORACLES[name]).df()
    assert rows(got) == rows(want)
    return got


@pytest.mark.parametrize(("n", "hidden"), [(50_000, True), (50_200, False)])
def test_rows_without_a_file(spark, tmp_path, n, hidden):
    """Up to 500 are hidden, more are shown."""
    docs = spark.range(n).select(F.col("id").alias("doc_id"), *[F.lit("x").alias(c) for c in ("text", "lang", "source")])
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert len(against_sql(spark, tmp_path, "hide_few_rows_without_file")) == (n - 500 if hidden else n)


def test_years_after_9999(spark, tmp_path):
    events = spark.range(3_000_000, 3_000_020).select(F.col("id").alias("event_id"), F.lit('{"k": 1}').alias("props"))
    events.unionByName(events.withColumn("event_id", F.col("event_id") % 100)).write.parquet(f"{tmp_path}/events.parquet")
    assert set(against_sql(spark, tmp_path, "scalar_json_epoch")["year"]) == {"2001", "10214"}


def test_an_export_is_cut_by_its_files(spark, tmp_path):
    """2,000 small files: not one task, and no process started for each."""
    from albumen import queries

    rows_ = spark.range(2000).select(F.col("id").alias("s_suppkey"), F.concat(F.lit("Größe "), F.col("id").cast("string")).alias("s_name"))
    rows_.write.parquet(f"{tmp_path}/supplier.parquet")
    table = lambda t: spark.read.parquet(f"{tmp_path}/{t}.parquet")
    began = time.time()
    queries._exported(table, f"file:{tmp_path}/a b", "true")
    assert time.time() - began < 30
    found = {f.parent.name: f.read_bytes() for f in (tmp_path / "a b").rglob("*") if f.is_file()}
    assert len(found) == 2000
    assert found["name=00000000-0000-0000-0000-000000000008.mov.json"].decode() == '{"EXIF:DateTimeOriginal":"2008:01:02 03:04:05","XMP:PersonInImage":"Größe 8"}\n'
    got = queries._decoded(queries.ingest.read_sidecars(spark, f"file:{tmp_path}/a b", "*.txt", queries.FOLDERS)).count()
    assert got == 2000


def test_records_take_one_pass(spark, tmp_path):
    """96,000 records in one task, the same rows as the SQL; no list is looked through once for each of its words."""
    spark.range(100_000).coalesce(1).select(F.col("id").alias("event_id")).write.parquet(f"{tmp_path}/events.parquet")
    began = time.time()
    against_sql(spark, tmp_path, "decode_sidecars")
    assert time.time() - began < 55
    long = spark.range(1).select(F.transform(F.sequence(F.lit(0), F.lit(99_999)), lambda i: F.concat(F.lit("Word"), i.cast("string"))).alias("a"))
    began = time.time()
    assert long.select(F.size(tc.ordered_ci_distinct(F.concat("a", F.reverse("a")))).alias("n")).first()["n"] == 100_000
    assert time.time() - began < 20


def test_records_of_odd_shapes(spark):
    """Other JSON than an object or a list of them is no record; a key of another kind than it should be is null, and
    takes no other key with it."""
    from albumen.operators import ingest

    raws = ["[]", "[null]", "[[{}]]", "3", "null", '"{}"', "{", "", None, '[1, {"a": 1}]']
    odd = '{"EXIF:GPSLatitude": "12.5", "EXIF:GPSLatitudeRef": 3, "EXIF:GPSLongitude": {"a": 1}, "XMP:PersonInImage": [null, 5, "Bo"], "IPTC:Keywords": [], "XMP:Subject": 7, "XMP-mwg-rs:RegionInfo": [1], "Keys:GPSCoordinates": ["1 2"], "UserData:GPSCoordinates": " -1 +2.5 "}'
    faces = '[{"XMP-mwg-rs:RegionInfo": {"RegionList": [{"Type": "Face", "Name": 4}, 3, {"Type": "Face", "Name": "A", "Area": {"X": "x", "Y": 2}}]}, "EXIF:CreateDate": "2020:02:30 01:02:03"}, 1]'
    df = spark.createDataFrame([(f"/{i}", "U", "u.jpg.json", r) for i, r in enumerate([*raws, odd, faces, "{}"])], "path string, uuid string, name string, raw string")
    got = {r["sidecar_path"]: r for r in ingest.decode_sidecars(ingest.with_record(df)).collect()}
    assert set(got) == {"/10", "/11", "/12"}
    a, b, c = got["/10"], got["/11"], got["/12"]
    assert (a["gps_lat"], a["gps_lon"], a["gps_lat_ref"], a["gps_lon_ref"]) == (-1, 2.5, "S", "E")
    assert (a["persons"], a["scene_labels"], a["face_regions"]) == (["5", "Bo"], ["7"], [])
    assert [(f["name"], f["area"]) for f in b["face_regions"]] == [("4", None), ("A", {"X": None, "Y": 2.0})]
    assert (b["datetime_original"], c["gps_lat"], c["persons"], c["face_regions"]) == (None, None, [], [])


@pytest.mark.parametrize("low", ["1992", "1997"])
def test_late_companions_in_batches_of_several_files(spark, tmp_path, monkeypatch, low):
    """Batches of 7 files each, also where all orders are of one of the three times; the state is not cut by
    the session's number of partitions, which stays as it was."""
    from albumen import queries

    monkeypatch.setattr(queries, "ROWS_A_BATCH_TASK", 300, raising=False)
    orders = spark.range(2000).select(F.col("id").alias("o_orderkey"), F.expr(f"cast(date_add(date'{low}-01-01', cast(id * 37 % 600 as int)) as timestamp_ntz)").alias("o_orderdate"))
    orders.write.parquet(f"{tmp_path}/orders.parquet")
    spark.range(1).write.parquet(f"{tmp_path}/nation.parquet")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "200")
    try:
        began = time.time()
        got = against_sql(spark, tmp_path, "stream_late_companions")
        assert time.time() - began < 45
        assert spark.conf.get("spark.sql.shuffle.partitions") == "200"
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got["file_day"].notna().any() and got["file_day"].isna().any()


def test_layers_write_few_bytes(spark, tmp_path):
    """Texts are most of a layered table: its base, its deltas and what a compaction writes take less than in the session's codec."""
    from albumen.operators.layers import LayeredTable

    words = F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.lit(60)), lambda i: F.concat(F.lit("word"), ((F.col("k") * 7919 + i * i) % 5003).cast("string"))))
    rows_ = spark.range(3000).coalesce(1).withColumnRenamed("id", "k").withColumn("description", words)
    size = lambda folder: sum(f.stat().st_size for f in folder.rglob("*.parquet"))
    rows_.write.parquet(f"{tmp_path}/plain", compression="snappy")
    table = LayeredTable(spark, str(tmp_path / "t"), "k")
    table.create(rows_)
    assert size(tmp_path / "t" / "base" / "v=1") < 0.8 * size(tmp_path / "plain")
    table.add_edits(rows_.withColumn("at", F.lit("2024-01-01")))
    assert size(tmp_path / "t" / "deltas") < 0.8 * size(tmp_path / "plain")
    table.compact()
    assert size(tmp_path / "t" / "base" / "v=2") < 1.6 * size(tmp_path / "plain")
    assert table.read().exceptAll(rows_).count() == 0 and table.read().count() == 3000
