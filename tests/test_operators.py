"""Incident cases and rules of single operators, with literal rows."""

import json
import os
from datetime import datetime, timedelta

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from albumen.functions import textcols as tc
from albumen.operators import catalog, geo, ingest, merge, names, replies, search, snapshots, stats
from albumen.plans import work
from albumen.sources import tables
from albumen.streaming import ingest as stream_ingest
from albumen.streaming import monitors

U = "0A1B2C3D-0000-4000-8000-00000000000"


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first()["x"]


# --- scalars -------------------------------------------------------------------


@pytest.mark.parametrize(
    ("text", "want"),
    [("12.5 -45.5 9", (12.5, -45.5)), ("+12.5-045.5+021.9/", (12.5, -45.5)), ("0 0", None), ("91 1", None), ("x", None), ("", None)],
)
def test_coordinates(spark, text, want):
    got = one(spark, tc.parse_coord_text(F.lit(text)))
    assert (tuple(got) if got else None) == want


def test_second_coordinate_key_is_tried(spark):
    assert tuple(one(spark, tc.parse_coord_text(F.lit("bad"), F.lit("1 2")))) == (1.0, 2.0)


def test_impossible_date(spark):
    assert tuple(one(spark, tc.parse_exif_ts(F.lit("2023:02:30 01:02:03"), F.lit("+01:00")))) == (None, None, None)
    assert tuple(one(spark, tc.parse_exif_ts(F.lit("2023:02:28 01:02:03"), F.lit(None)))) == ("2023-02-28", "01:02:03", "2023-02-28T01:02:03")


def test_lists(spark):
    a = F.array(F.lit(" Ana "), F.lit("ana"), F.lit("ANA"), F.lit("bo"), F.lit(" "))
    assert one(spark, tc.clean_list(a)) == ["Ana", "bo"]
    assert one(spark, tc.minus_ci(F.array(F.lit("Sea"), F.lit("Ana "), F.lit("Sea")), F.array(F.lit("ana")))) == ["Sea", "Sea"]
    assert one(spark, tc.json_list(F.lit('{"a":1}'))) == [] == one(spark, tc.json_list(F.lit(None).cast("string")))


def test_names_leave_whole_words_only(spark):
    assert one(spark, tc.without_words(F.lit("banana with Ana, Smith -"), F.array(F.lit("Ana Smith")))) == "banana with"


def test_place_and_guess(spark):
    n = F.lit(None).cast("string")
    assert one(spark, tc.display_place(F.lit("Boston"), F.lit("boston "), F.lit("MA"), F.lit("USA"), F.lit("US"), n)) == "Boston, MA"
    assert one(spark, tc.display_place(n, n, n, n, n, F.lit(" raw "))) == "raw"
    assert one(spark, tc.location_guess(F.array(F.lit("Cafe")), F.lit("high"))) == "Cafe"
    assert one(spark, tc.leading_int(F.lit("many"))) == 0


def test_windows_and_names(spark):
    assert one(spark, tc.year_window(F.lit("1975"), ["pre1980"])) == "pre1980"
    assert one(spark, tc.year_window(F.lit("unknown"), ["pre1980"])) is None
    assert one(spark, tc.share_name(F.lit("K/1"), F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit("jpg"))) == "K1.jpg"
    assert one(spark, tc.norm_ext(F.lit(".jpeg"))) == "JPG"
    assert one(spark, tc.uuid_of(F.lit("x.json"))) is None


# --- sidecars --------------------------------------------------------------------


@pytest.fixture()
def folder(tmp_path):
    def put(name, text):
        p = tmp_path / "in" / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)

    rec = {"EXIF:DateTimeOriginal": "2020:01:02 03:04:05", "EXIF:OffsetTime": "+02:00", "EXIF:GPSLatitude": 10.5, "EXIF:GPSLatitudeRef": "S", "EXIF:GPSLongitude": 20.5, "EXIF:GPSLongitudeRef": "E", "XMP:PersonInImage": ["Ana ", "ana", "Bo"], "IPTC:Keywords": ["Sea", "Ana", "Sea"], "XMP-mwg-rs:RegionInfo": {"RegionList": [{"Type": "Face", "Name": "Ana", "Area": {"X": 0.5}}, {"Type": "Pet", "Name": "Rex"}]}}
    put(f"a/{U}1.JPEG.json", json.dumps([rec]))
    put(f"a/{U}1.JPEG", "img")
    put(f"b/{U}2.mov.json", json.dumps({"QuickTime:CreateDate": "bad", "QuickTime:CreationDate": "2019:05:06 07:08:09-05:00", "Keys:GPSCoordinates": "0 0", "UserData:GPSCoordinates": "1.5 2.5", "XMP:PersonInImage": "Cy"}))
    put(f"b/{U}3.jpg.json", "[]")
    put(f"b/{U}4.jpg.json", "{broken")
    put("b/noid.json", "{}")
    put(f"b/.{U}5.jpg.json", "{}")
    return str(tmp_path / "in")


def test_sidecars(spark, folder):
    recs = ingest.with_record(ingest.read_sidecars(spark, folder))
    got = {r["uuid"][-1]: r for r in ingest.decode_sidecars(recs).collect()}
    assert set(got) == {"1", "2"}
    a, v = got["1"], got["2"]
    assert (a["media_type"], a["file_ext"], a["datetime_original"]) == ("image", "JPG", "2020-01-02T03:04:05+02:00")
    assert (a["gps_lat"], a["gps_lat_ref"], a["gps_lon"]) == (-10.5, "S", 20.5)
    assert a["persons"] == ["Ana", "Bo"] and a["scene_labels"] == ["Sea", "Sea"]
    assert [f["name"] for f in a["face_regions"]] == ["Ana"]
    assert (v["media_type"], v["datetime_original"], v["gps_lat"], v["persons"]) == ("video", "2019-05-06T07:08:09-05:00", 1.5, ["Cy"])
    assert sorted(r["reason"] for r in ingest.rejected(recs).collect()) == ["no record", "no record", "no uuid"]
    files = ingest.media_index(spark, folder)
    assert [r["stem"] for r in files.collect()] == [f"{U}1".upper()]
    assert ingest.with_media(recs, files).count() == 1
    assert ingest.exclude_keys(recs.where("uuid is not null"), "uuid", recs.where(F.col("uuid").endswith("1")).select("uuid")).count() == 3


def test_backfill_status(spark, folder):
    recs = ingest.with_record(ingest.read_sidecars(spark, folder))
    rows = spark.createDataFrame([(f"{U}{i}".upper(),) for i in (2, 3, 9)], "uuid string")
    out = ingest.backfill_missing(rows, recs, "uuid", tc.parse_coord_text(*[ingest.key(k) for k in ingest.COORD_KEYS]))
    assert {r["uuid"][-1]: r["status"] for r in out.collect()} == {"2": "found", "3": "unreadable", "9": "missing"}


def test_stream_ingest_reads_each_file_once(spark, folder, tmp_path):
    seen = []

    def apply(batch, _):
        seen.extend(r["uuid"] for r in batch.where("uuid is not null").collect())

    for _ in range(2):
        q = stream_ingest.run_stream(stream_ingest.sidecar_stream(spark, folder), apply, str(tmp_path / "cp"))
        q.awaitTermination(60)
    assert sorted(u[-1] for u in seen) == ["1", "2", "3", "4"]


def test_held_back(spark):
    b = spark.createDataFrame([("a", 1), ("b", 2)], "uuid string, x int")
    ready, held = stream_ingest.held_back(b, None, spark.createDataFrame([("a",)], "uuid string"))
    assert [r["uuid"] for r in ready.collect()] == ["a"] and [r["uuid"] for r in held.collect()] == ["b"]
    ready, held = stream_ingest.held_back(b.where("false"), held, spark.createDataFrame([("b",)], "uuid string"))
    assert ready.count() == 1 and held.count() == 0


# --- replies -------------------------------------------------------------------------


@pytest.mark.parametrize(
    ("reply", "stage", "description"),
    [
        ('{"description":"x"}', "parsed", "x"),
        ('```json\n{"description":"x"}\n```', "carved", "x"),
        ('so: {"description":"x"} and more', "carved", "x"),
        ('{"description":"a "big" dog"}', "requoted", 'a "big" dog'),
        ('{"description":"a\nb"}', "carved", "a\nb"),
        ('{"description":"cut', "failed", None),
        ("", "empty", None),
        (None, "empty", None),
    ],
)
def test_salvage(spark, reply, stage, description):
    df = spark.createDataFrame([(reply,)], "r string")
    got = replies.flatten_reply(replies.salvage_json(df, "r"), "json").first()
    assert (got["stage"], got["description"]) == (stage, description)


def test_flatten_odd_shapes(spark):
    r = {"description": "d", "tags": [{"tag": "beach"}, 3, True, None, ["x", {"name": "y"}], {"odd": 1}, "beach"], "people": None, "mood": "calm", "setting": "indoor", "notable_features": "f"}
    got = replies.flatten_reply(spark.createDataFrame([(json.dumps(r),)], "json string")).first()
    assert got["tags"] == ["beach", "3", "x", "y", "calm", "f"] and got["location_guess"] is None


def test_enrich_isolates_rows(spark):
    def model(texts, attempt):
        if "boom" in texts:
            raise ValueError("boom")
        return ["{}" if t == "ok" or attempt == 2 else "nope" for t in texts]

    df = spark.createDataFrame([(1, "ok"), (2, "boom"), (3, "late")], "k int, c string").coalesce(1)
    got = {r["k"]: r for r in replies.enrich(df, "k", "c", model).collect()}
    assert (got[1]["stage"], got[1]["attempts"]) == ("carved", 1)
    assert got[2]["error"] == "ValueError: boom"
    assert (got[3]["json"], got[3]["attempts"]) == ("{}", 2)


def test_drain_stops_when_empty(spark):
    left = [3]

    def run(_):
        left[0] -= 1

    assert stream_ingest.drain(lambda: spark.range(left[0]), run, 10) == 3


# --- merges --------------------------------------------------------------------------


BASE = "k int, date string, datetime_original string, place_name string, place_source string, edited_fields string"


def test_edits_rules(spark):
    base = spark.createDataFrame([(1, "2000-01-01", "2000-01-01T10:00:00+01:00", "A", "apple", "[]"), (2, None, None, None, None, '["date"]')], BASE)
    edits = spark.createDataFrame([(1, "2001-02-03", " "), (2, "2001-02-30", None), (9, "2001-01-01", None)], "k int, date string, place_name string")
    new, bad = merge.apply_edits(base, edits, "k")
    r = {x["k"]: x for x in new.collect()}
    assert r[1]["datetime_original"] == "2001-02-03T10:00:00+01:00" and r[1]["place_name"] is None and r[1]["place_source"] is None
    assert r[1]["edited_fields"] == '["date","place_name"]' and r[2]["date"] is None
    assert {x["k"]: x["reason"] for x in bad.collect()} == {2: "bad date", 9: "unknown key"}


def test_merges_are_idempotent(spark):
    base = spark.createDataFrame([(1, "A", "manual"), (2, None, None)], "k int, place_name string, place_source string")
    dump = spark.createDataFrame([(1, "X"), (2, "Y"), (3, "Z")], "k int, name string")
    once = merge.merge_places(base, dump, "k")
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, merge.merge_places(once, dump, "k").collect())) == [(1, "A", "manual"), (2, "Y", "apple")]


def test_tombstones_and_vocabulary(spark):
    base = spark.range(4).withColumnRenamed("id", "k")
    stones = spark.createDataFrame([(0, "t", "r")], "k long, at string, reason string")
    new, left = merge.tombstone(base, base.where("k = 2"), "k", stones, F.lit("now"), "gone")
    assert new.count() == 2 and sorted(r["k"] for r in left.collect()) == [1, 3]
    with pytest.raises(ValueError):
        merge.replace_vocabulary(base.where("false"))


def test_snapshots(spark, tmp_path):
    path = str(tmp_path / "snap")
    assert snapshots.read_snapshot(spark, path) is None
    a = spark.createDataFrame([(1, "x"), (2, None)], "k int, changekey string")
    v = snapshots.write_snapshot(a, path)
    assert snapshots.read_snapshot(spark, path) is None
    snapshots.promote(spark, path, v)
    b = spark.createDataFrame([(1, "y"), (2, None), (3, "z")], "k int, changekey string")
    assert snapshots.write_snapshot(b, path) == 2
    old = snapshots.read_snapshot(spark, path)
    assert {r["k"]: r["kind"] for r in snapshots.diff_snapshots(old, b, "k").collect()} == {1: "changed", 3: "new"}
    assert snapshots.diff_snapshots(b, b, "k").count() == 0


# --- names, geo, search ------------------------------------------------------------------


def test_alias_rules(spark):
    df = spark.createDataFrame([(["ana", "Ana"],), (["ana"],), (["BO", "bo"],), (["bo", "BO"],)], "n array<string>")
    vocab = spark.createDataFrame([("ANA",)], "name string")
    got = {r["raw"]: r["canonical"] for r in names.build_aliases(df, F.col("n"), vocab).collect()}
    assert got == {"ana": "ANA", "Ana": "ANA", "bo": "BO"}
    small = spark.createDataFrame([("ana", "ANA")], "raw_lc string, canonical string")
    got = names.canonicalize(df.withColumn("k", F.monotonically_increasing_id()), "k", "n", small).orderBy("k").select("n").collect()
    assert got[0]["n"] == ["ANA"]


def test_query_log(spark):
    vocab = spark.createDataFrame([("Ana Smith",), ("Bob Lee",)], "name string")
    tags = spark.createDataFrame([("beach",)], "name string")
    log = spark.createDataFrame(
        [(1, "x", "ana at sea", "2001", "1999", "2003", ["ana"], [" a "] * 9, "Beach"), (2, "Where was bob?", "bob here", "99", "1999", "", [], [], "hill")],
        "k int, text string, q string, year string, year_from string, year_to string, persons array<string>, terms array<string>, scene string",
    )
    r = {x["k"]: x for x in names.resolve_query_log(log, "k", vocab, tags).collect()}
    assert (r[1]["year"], r[1]["year_from"], r[1]["persons"], r[1]["scene"], len(r[1]["terms"]), r[1]["q"]) == ("2001", "", ["Ana Smith"], "beach", 8, "at sea")
    assert (r[2]["year"], r[2]["year_from"], r[2]["persons"], r[2]["scene"], r[2]["q"]) == ("", "", ["Bob Lee"], "", "here")


def test_nearest_near_the_pole(spark):
    df = spark.createDataFrame([(1, 80.0, 10.0, "P", "apple"), (2, 80.0, 10.004, None, None), (3, 80.0, 11.0, None, None)], "k int, gps_lat double, gps_lon double, place_name string, place_source string")
    got = {r["k"]: r["place_name"] for r in geo.nearest_fill(df, "k", 100.0).collect()}
    assert got == {1: "P", 2: "P", 3: None}
    again = geo.nearest_fill(geo.revert_nearby(geo.nearest_fill(df, "k", 100.0)), "k", 100.0)
    assert {r["k"]: r["place_name"] for r in again.collect()} == got


def test_lookup_far_from_everything(spark):
    pts = spark.createDataFrame([(0.0, 0.0), (70.0, 170.0), (None, 1.0)], "a double, o double")
    gaz = spark.createDataFrame([("near", 0.5, 0.5), ("far", 60.0, 100.0)], "city string, lat double, lon double")
    assert {r["a"]: r["city"] for r in geo.nearest_lookup(pts, gaz, "a", "o", ["city"]).collect()} == {0.0: "near", 70.0: "far", None: None}


def test_full_text_rules(spark):
    df = spark.createDataFrame([(1, "A birthday", "Boston"), (2, "bird; Élan vital", "x"), (3, "vital élan", None)], "k int, text string, place string")
    p = search.build_postings(df, "k", ["text", "place"])
    keys = lambda d: sorted(r["key"] for r in d.collect())
    assert keys(search.match(p, "bird")) == [2]
    assert keys(search.match(p, "place:boston", columns=["text", "place"])) == [1]
    assert keys(search.match(p, "spot:boston", columns=["text"], aliases={"spot": "place"})) == [1]
    assert keys(search.match(p, "elan-vital")) == [2]
    assert search.match(p, " !! ") is None
    assert keys(search.match(p, "nothing", ["birthday"])) == [1]


def test_hide_missing_guard(spark):
    df = spark.range(10).withColumnRenamed("id", "asset_id")
    assert search.hide_missing(df, df.where("asset_id < 8"), "asset_id", 2).count() == 8
    assert search.hide_missing(df, df.where("asset_id < 7"), "asset_id", 2).count() == 10
    assert search.hide_missing(df.limit(1), df.where("false"), "asset_id", 2).count() == 1


def test_page_past_the_end(spark):
    df = spark.range(5)
    assert search.page(df, [F.col("id")], 2, 3).count() == 2
    assert search.page(df, [F.col("id")], 3, 3).count() == 0


# --- sources and plans -------------------------------------------------------------------


def test_readers_and_writers(spark, tmp_path):
    p = lambda n: str(tmp_path / n)
    assert tables.read_manifest(spark, p("none")).count() == 0
    open(p("m.tsv"), "w").write("a\t2001\tk\tf\nshort\tx\nb\t2002\tk2\n")
    assert [tuple(r) for r in tables.read_manifest(spark, p("m.tsv")).orderBy("uuid").collect()] == [("a", "2001", "k", "f"), ("b", "2002", "k2", None)]
    open(p("d.json"), "w").write(json.dumps([{"uuid": "a", "name": " ", "cc": "US"}, {"uuid": "b", "name": "N"}]))
    d = tables.read_place_dump(spark, p("d.json"))
    assert {r["uuid"]: r["name"] for r in d.collect()} == {"a": None, "b": "N"}
    assert tables.merge_place_dump(d, d).count() == 2
    open(p("al.json"), "w").write(json.dumps({"generated": {"ana": "Ana", " ": "x"}, "curated": {"ANA": "Anna"}}))
    assert [tuple(r) for r in tables.read_aliases(spark, p("al.json")).collect()] == [("ana", "Anna")]
    open(p("bad.json"), "w").write("{")
    assert tables.read_aliases(spark, p("bad.json")).count() == 0
    open(p("v.txt"), "w").write('Persons:\n "Ana": 3,\nBo: 1\n_UNKNOWN_: 9\nBo: 2\n')
    assert {tuple(r) for r in tables.read_vocab_text(spark, p("v.txt")).collect()} == {("Ana", 3), ("Bo", 2)}
    vocab = tables.read_vocab_text(spark, p("v.txt"))
    tables.write_vocabulary(vocab, p("vocab"))
    tables.write_report(vocab, p("report"), ["name", "count"], [F.desc("count")])
    assert [r["value"] for r in spark.read.text(p("report")).collect()] == ["| Ana | 3 |", "| Bo | 2 |"]
    tables.write_json(vocab, p("j"), searched=True)
    tables.append_run_log(vocab, p("log"))
    tables.append_run_log(vocab, p("log"))
    assert spark.read.parquet(p("log")).count() == 4
    tables.write_changed(spark.createDataFrame([("a", "2001")], "uuid string, year string"), p("changed"))
    tables.write_keyword_map(spark.createDataFrame([("a", ["x"]), ("b", [])], "k string, w array<string>"), "k", "w", p("kw"))
    assert spark.read.json(p("kw")).count() == 1
    tables.write_aliases(spark.createDataFrame([("ana", "Ana")], "raw string, canonical string"), p("gen"))
    spark.createDataFrame([("a", "f.jpg", 1, "{}"), ("b", "f.JSON", 1, "{}")], "uuid string, filepath string, dest_size long, exifdata string").write.json(p("meta"), compression="gzip")
    assert tables.read_metadata_dump(spark, p("meta")).count() == 1
    with pytest.raises(ValueError):
        tables.write_vocabulary(vocab.where("false"), p("never"))


def test_schema_guards(spark):
    with pytest.raises(ValueError, match="b.z"):
        tables.assert_schema({"a": spark.range(1), "b": spark.range(1)}, {"a": ["id"], "b": ["z"], "c": []})
    assert tables.find_link_table(["Z_9ASSETS", "Z_1X"], {"Z_9ASSETS": ["Z_9ALBUMS", "Z_3ASSETS"], "Z_1X": ["a"]}, r"Z_\d+\w+", ["ALBUM", "ASSET"]) == ("Z_9ASSETS", ["Z_9ALBUMS", "Z_3ASSETS"])
    assert tables.sample_of(spark.range(9)).count() == 3
    spark.range(3).select(F.col("id").alias("album_id"), F.col("id").alias("asset_id")).createOrReplaceTempView("zlink_1")
    assert tables.catalog_links(spark, "zlink*", r"zlink_\d+", ["album", "asset"]) == ("zlink_1", ["album_id", "asset_id"])


def test_plans(spark):
    got = work.sample_offsets(spark.createDataFrame([(1, 10.0), (2, None)], "k int, d double"), "k", "d", 2).orderBy("k", "offset").collect()
    assert [r["offset"] for r in got] == [2.5, 7.5, 0.0, 1.0]
    assert tuple(one(spark, work.rendition_size(F.lit(4000), F.lit(2000), max_pixels=2_000_000))) == (2000, 1000)


def test_sample_is_repeatable(spark):
    few, many = (stats.sample_rows(spark.range(100).repartition(n), 5, 3, "id").collect() for n in (1, 7))
    assert few == many and few != stats.sample_rows(spark.range(100), 5, 4, "id").collect()


def test_files_and_labels(spark):
    a = spark.createDataFrame([(1, "IMG.JPG"), (2, "x.jpg")], "k int, f string")
    f = spark.createDataFrame([("/m/img.jpg",), ("/m/img.mov",)], "path string")
    assert {r["k"]: r["path"] for r in catalog.resolve_files(a, f, "k", "f").collect()} == {1: "/m/img.jpg", 2: None}
    assert catalog.available_first(spark.range(3).withColumn("a", F.col("id") == 2), "a", "id").first()["id"] == 2


# --- streams -------------------------------------------------------------------------------


T0 = datetime(2024, 1, 1)


def _replay(spark, tmp_path, rows, schema, build):
    for i, part in enumerate(rows):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(tmp_path / "s" / f"p{i}"))
    src = spark.readStream.schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "s"))
    q = build(src).writeStream.format("memory").queryName("out").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(120)
    return spark.table("out").collect()


def test_heartbeat_stream_equals_batch(spark, tmp_path):
    at = lambda h: T0 + timedelta(hours=h)
    parts = [[("a", at(0)), ("b", at(0))], [("a", at(1)), ("b", at(9))], [("a", at(10))]]
    got = _replay(spark, tmp_path, parts, "k string, ts timestamp", lambda d: monitors.heartbeat_monitor(d, "k", "ts", 6 * 3600, "1 day"))
    batch = monitors.heartbeat_gaps(spark.createDataFrame([r for p in parts for r in p], "k string, ts timestamp"), "k", "ts", 6 * 3600)
    assert sorted((r["key"], r["seconds"]) for r in got if r["seconds"]) == sorted((r["k"], r["seconds"]) for r in batch.collect()) == [("a", 32400), ("b", 32400)]


def test_alert_stream(spark, tmp_path):
    at = lambda h: T0 + timedelta(hours=h)
    parts = [[("a", at(0), True), ("a", at(1), True)], [("a", at(25), True)], [("a", at(26), False), ("a", at(27), True)]]
    got = _replay(spark, tmp_path, parts, "k string, ts timestamp, f boolean", lambda d: monitors.suppress_alerts(d, "k", "ts", "f", 86400, "2 days"))
    assert sorted(r["ts"] for r in got) == [at(0), at(25), at(27)]
    df = spark.createDataFrame([r for p in parts for r in p], "k string, ts timestamp, f boolean")
    assert sorted(r["ts"] for r in monitors.alert_episodes(df, "k", "ts", F.col("f"), 86400).collect()) == [at(0), at(25), at(27)]


def test_stuck_stream(spark, tmp_path):
    at = lambda h: T0 + timedelta(hours=h)
    parts = [[("a", at(0), True), ("b", at(0), True)], [("b", at(1), False), ("a", at(2), True)], [("a", at(6), False)]]
    got = _replay(spark, tmp_path, parts, "k string, ts timestamp, o boolean", lambda d: monitors.stuck_monitor(d, "k", "ts", "o", 4 * 3600, "1 day"))
    assert [(r["key"], r["since"], r["seconds"]) for r in got] == [("a", at(0), 6 * 3600)]


def test_stale(spark):
    df = spark.createDataFrame([Row(k="a", ts=T0), Row(k="b", ts=T0 + timedelta(hours=5))])
    assert [r["k"] for r in monitors.stale(df, "k", "ts", "2024-01-01 06:30:00", 6 * 3600).collect()] == ["a"]


def test_refresh(spark, tmp_path):
    assert stream_ingest.refresh(spark.range(3), str(tmp_path / "t")) == 1
    assert os.path.exists(tmp_path / "t" / "v=1" / "_PROMOTED")


def test_alerts_go_out_a_full_cadence_after_the_last_one(spark):
    """Firing at 0, 47 and 49 hours: the second alert is at 47, the next may come at 71."""
    t0 = datetime(2024, 1, 1)
    at = lambda h: t0 + timedelta(hours=h)
    rows = [("a", at(h), True) for h in (0, 47, 49)] + [("b", at(h), h != 5) for h in (0, 3, 5, 6, 29, 30)] + [("c", at(0), False), ("c", at(0), True), (None, at(1), True)]
    df = spark.createDataFrame(rows, "k string, ts timestamp, f boolean")
    got = {}
    for r in monitors.alert_episodes(df.repartition(3), "k", "ts", F.col("f"), 86400).collect():
        got.setdefault(r["k"], []).append(r["ts"])
    assert {k: sorted(v) for k, v in got.items()} == {"a": [at(0), at(47)], "b": [at(0), at(6), at(30)], "c": [at(0)], None: [at(1)]}
    assert monitors.alert_episodes(df.limit(0), "k", "ts", F.col("f"), 86400).count() == 0


def test_confidence_rounds_halves_to_even(spark):
    text = lambda c: one(spark, tc.location_guess(F.array(F.lit("x")), F.lit(c)))
    assert [text(c) for c in ("0.125", "0.375", "0.8", "often", None)] == ["x (confidence: 12%)", "x (confidence: 38%)", "x (confidence: 80%)", "x", "x (confidence: 0%)"]


@pytest.mark.parametrize(
    ("text", "want"),
    [("5. 1", None), (".5 1", None), ("1e1 2", None), ("NaN 1", None), ("5-3", None), ("+5-3", (5.0, -3.0)), ("+5-3/", (5.0, -3.0)), ("+5-3//", None), ("+5-3+1+2", None), ("1\t2", (1.0, 2.0)), ("1 2 x", None), ("+5.5 -3", (5.5, -3.0)), ("1 2 3 4", None), ("-", None)],
)
def test_coordinate_forms(spark, text, want):
    got = one(spark, tc.parse_coord_text(F.lit(text)))
    assert (got and tuple(got)) == want


def test_video_date_forms(spark):
    form = lambda t: one(spark, tc.video_date(F.lit(t)))
    assert form("2022:03:04 05:06:07") == Row(text="2022:03:04 05:06:07", offset=None)
    assert form("2022:03:04 05:06:07-08:00") == Row(text="2022:03:04 05:06:07", offset="-08:00")
    assert [form(t) for t in ("2022-03-04 05:06:07", "2022:03:04 05:06:07Z", "2022:03:04", "", None)] == [None] * 5


def test_elements_of_nested_objects(spark):
    """The first known key that is there decides, however deep; null under it tells nothing."""
    cases = {'{"tag": null, "name": "x"}': None, '{"name": {"value": {"text": " y "}}}': "y", '{"other": "x"}': None, '{"label": 3}': "3", '{"tag": true}': None, '{"tag": ""}': None, '"a"': "a", "2.5": "2.5"}
    rows = spark.createDataFrame(list(cases.items()), "j string, want string")
    got = rows.select("want", replies.scalar_text(F.parse_json("j")).alias("got")).collect()
    assert all(r["want"] == r["got"] for r in got), got


def test_match_expressions_that_cannot_be_read(spark):
    assert all(search.accepted(q) for q in ("sea", '"at sea"', "(a OR b) c", "place:sea"))
    assert not any(search.accepted(q) for q in ('"sea', "(sea", "sea)", "sea AND", "OR sea", "...", '""'))
    df = spark.createDataFrame([(1, 'a "sea view'), (2, "sea")], "k int, t string")
    post = search.build_postings(df, "k", ["t"])
    found = lambda q: sorted(r["k"] for r in search.search_text(df, post, q, ["t"], "k").collect())
    assert (found('"sea'), found("sea"), found("")) == ([1], [1, 2], [1, 2])


def test_alias_document_is_read_back(spark, tmp_path):
    rows = lambda *r: spark.createDataFrame(list(r), "raw string, canonical string")
    tables.write_aliases(rows(("ana", "Ana"), ("bo", "Bo")), f"{tmp_path}/doc", rows(("Ana", "ANNA"), ("x", ' "q" ')))
    got = {r["raw_lc"]: r["canonical"] for r in tables.read_aliases(spark, f"{tmp_path}/doc").collect()}
    assert got == {"ana": "ANNA", "bo": "Bo", "x": '"q"'}
    tables.write_aliases(rows(("ana", "Ana")).limit(0), f"{tmp_path}/none")
    assert tables.read_aliases(spark, f"{tmp_path}/none").count() == 0


def test_parts_of_a_long_name(spark):
    """A long text costs its length times the listed lengths, not all its parts."""
    vocab = spark.createDataFrame([("Ana",), ("Bob Lee",)], "name string")
    asked = spark.createDataFrame([(1, "x" * 20_000 + "ana"), (2, "lee")], "k int, name string")
    got = {r["k"]: r["match"] for r in names.resolve_names(asked, "k", "name", vocab).collect()}
    assert got == {1: "Ana", 2: "Bob Lee"}


def test_gaps_over_days(spark):
    """Beats are dealt by day; silences over midnight, over days and within a day are told."""
    t0 = datetime(2024, 1, 1, 22)
    hours = [0, 1, 3, 30, 31, 100, 100]
    df = spark.createDataFrame([("a", t0 + timedelta(hours=h)) for h in hours] + [("b", t0), (None, t0), (None, t0 + timedelta(hours=5))], "k string, ts timestamp")
    got = sorted(((r["k"] or "", r["seconds"] // 3600) for r in monitors.heartbeat_gaps(df, "k", "ts", 3600).collect()))
    assert got == [("", 5), ("a", 2), ("a", 27), ("a", 69)]


def test_kept_postings_serve_queries(spark):
    df = spark.createDataFrame([(1, "sea view"), (2, "sea sea shore"), (3, None), (4, "hill")], "k int, t string")
    search.write_postings(search.build_postings(df, "k", ["t"]), "kept_postings", 4)
    try:
        kept = spark.table("kept_postings")
        assert sorted(r["key"] for r in search.match(kept, "sea").collect()) == [1, 2]
        lengths = search.text_lengths(df, "k", ["t"])
        assert {r["key"]: r["len"] for r in lengths.collect()} == {1: 2, 2: 3, 4: 1}
        one, two = (sorted((r["key"], round(r["score"], 9)) for r in search.bm25(kept, "sea", x).collect()) for x in (None, lengths))
        assert one == two and [k for k, _ in one] == [1, 2]
        assert search.bm25(kept, "nothing", lengths).count() == 0
    finally:
        spark.sql("DROP TABLE IF EXISTS kept_postings")
