"""Sidecar records: scanning, decoding to columns, and what is ingested."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import textcols as tc

# Keys of a sidecar record, in the order in which they are tried.
DATE_KEYS = ("EXIF:DateTimeOriginal", "EXIF:CreateDate")
OFFSET_KEYS = ("EXIF:OffsetTimeOriginal", "EXIF:OffsetTime")
VIDEO_DATE_KEYS = ("QuickTime:CreationDate", "QuickTime:ContentCreateDate", "QuickTime:CreateDate")
COORD_KEYS = ("Keys:GPSCoordinates", "UserData:GPSCoordinates")
KEYWORD_KEYS = ("IPTC:Keywords", "XMP:Subject")
PERSON_KEY, REGION_KEY = "XMP:PersonInImage", "XMP-mwg-rs:RegionInfo"

# What decode_sidecars reads of a record: texts, but for these.
KINDS = {
    "EXIF:GPSLatitude": "double",
    "EXIF:GPSLongitude": "double",
    PERSON_KEY: "variant",
    **dict.fromkeys(KEYWORD_KEYS, "variant"),
    REGION_KEY: "struct<RegionList: array<struct<Type: string, Name: string, Area: map<string,double>>>>",
}
TEXT_KEYS = (*DATE_KEYS, *OFFSET_KEYS, *VIDEO_DATE_KEYS, *COORD_KEYS, "EXIF:GPSLatitudeRef", "EXIF:GPSLongitudeRef")
RECORD = "struct<" + ", ".join(f"`{k}`: {kind}" for k, kind in (dict.fromkeys(TEXT_KEYS, "string") | KINDS).items()) + ">"


#: What a file is called: the last part of its path.
LAST_PART = r"([^/]*)$"


def read_sidecars(spark: SparkSession, path: str, pattern: str = "*.json", called: str = LAST_PART) -> DataFrame:
    """(path, name, uuid, raw) of every JSON file below a folder; names without a UUID have
    a null one. Hidden files are passed over by the reader. called: the part of the path that
    is the name, for folders that hold one record each."""
    raw = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(path, wholetext=True)
    name = F.regexp_extract(F.col("_metadata.file_path"), called, 1)
    return raw.select(F.col("_metadata.file_path").alias("path"), name.alias("name"), tc.uuid_of(name).alias("uuid"), F.col("value").alias("raw"))


def with_record(df: DataFrame, raw: str = "raw") -> DataFrame:
    """Add rec, a variant of the record: the first of a list, or the bare object; null for
    an empty list, other JSON or none."""
    bare = lambda v: F.when(F.try_variant_get(v, "$", "struct<>").isNotNull(), v)
    first = lambda v: tc.once(F.try_variant_get(v, "$[0]", "variant"), bare)
    return df.withColumn("rec", tc.once(F.try_parse_json(F.col(raw)), lambda v: F.coalesce(first(v), bare(v))))


def key(name: str, kind: str = "string", rec: str = "rec") -> Column:
    return F.try_variant_get(F.col(rec), f"$['{name}']", kind)


def decode_sidecars(df: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """Catalogue columns of each record (see with_record). Rows without a record or UUID are
    left out; rejected() has them."""
    # What is read more than once is a column of a step before, so that a row works it out once; all keys
    # are taken in one pass of the record.
    of = lambda k: F.col("keys")[k]
    out = df.where("uuid is not null and rec is not null").select("uuid", "name", "path", F.try_variant_get("rec", "$", RECORD).alias("keys"))
    none = F.array().cast("array<string>")
    many = lambda k: tc.one_or_many(of(k), "$")
    faces = F.transform(F.filter(of(REGION_KEY)["RegionList"], lambda r: r["Type"] == "Face"), lambda r: F.struct(r["Name"].alias("name"), r["Area"].alias("area")))
    out = out.select(
        "uuid",
        "path",
        "keys",
        F.regexp_extract("name", r"\.([^.]+)\.json$", 1).alias("ext"),
        tc.first_truthy(*map(of, DATE_KEYS)).alias("taken"),
        tc.first_truthy(*map(of, OFFSET_KEYS)).alias("offset"),
        tc.video_date(*map(of, VIDEO_DATE_KEYS)).alias("video"),
        tc.signed_by_ref(of("EXIF:GPSLatitude"), of("EXIF:GPSLatitudeRef"), "S").alias("lat"),
        tc.signed_by_ref(of("EXIF:GPSLongitude"), of("EXIF:GPSLongitudeRef"), "W").alias("lon"),
        F.filter(F.transform(many(PERSON_KEY), tc.strip), lambda x: x != "").alias("raw_persons"),
        F.coalesce(*[tc.once(many(k), lambda x: F.when(F.size(x) > 0, x)) for k in KEYWORD_KEYS], none).alias("keywords"),
        F.coalesce(faces, F.array().cast("array<struct<name:string,area:map<string,double>>>")).alias("face_regions"),
    )
    has = F.col("lat").isNotNull() & F.col("lon").isNotNull()
    out = out.withColumn("spot", F.when(has, F.struct("lat", "lon")).otherwise(tc.parse_coord_text(*map(of, COORD_KEYS))))
    offset = F.coalesce("offset", F.when(F.col("taken").isNull(), F.col("video.offset")))
    out = out.withColumn("when", tc.parse_exif_ts(F.coalesce("taken", "video.text"), offset))
    out = out.select(
        "uuid",
        tc.media_class(F.col("ext")).alias("media_type"),
        tc.norm_ext(F.col("ext")).alias("file_ext"),
        F.col("when.iso").alias("datetime_original"),
        F.col("when.date").alias("date"),
        F.col("when.time").alias("time"),
        F.col("spot.lat").alias("gps_lat"),
        F.col("spot.lon").alias("gps_lon"),
        "raw_persons",
        "keywords",
        "face_regions",
        F.col("path").alias("sidecar_path"),
    )
    out = out.withColumns({"gps_lat_ref": tc.ref_letter(F.col("gps_lat"), "N", "S"), "gps_lon_ref": tc.ref_letter(F.col("gps_lon"), "E", "W")})
    if aliases is None:
        out = out.withColumn("persons", tc.ordered_ci_distinct(F.col("raw_persons")))
    else:
        from .names import canonicalize

        out = canonicalize(out.withColumn("persons", F.col("raw_persons")), "uuid", "persons", aliases)
    labels = tc.minus_ci(F.col("keywords"), F.array_union("raw_persons", "persons"))
    return out.withColumn("scene_labels", labels).drop("raw_persons", "keywords")


def rejected(df: DataFrame) -> DataFrame:
    """Files that can't be ingested, and why."""
    why = F.when(F.col("uuid").isNull(), "no uuid").when(F.col("rec").isNull(), "no record")
    return df.withColumn("reason", why).where("reason is not null").select("path", "reason")


def media_index(spark: SparkSession, path: str, keep: str = "*", called: str = LAST_PART) -> DataFrame:
    """(stem, path, length, modificationTime) of media files: JSON and hidden folders out, the
    content never read. called: as in read_sidecars."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", keep).load(path).select("path", "length", "modificationTime")
    files = files.where(~F.lower("path").endswith(".json") & ~F.col("path").rlike(r"/\.[^/]+/"))
    return files.withColumn("stem", F.upper(F.regexp_replace(F.regexp_extract("path", called, 1), r"\.[^.]*$", "")))


def preferred_file(df: DataFrame, stem: str = "stem", path: str = "path") -> DataFrame:
    """One file per stem: images before all else, then the first path."""
    ext = tc.norm_ext(F.regexp_extract(path, r"\.([^./]*)$", 1))
    image = ext.isin("JPG", "PNG", "HEIC", "GIF", "TIFF", "TIF", "WEBP", "BMP")
    return df.groupBy(stem).agg(F.min_by(path, F.struct(~image, F.col(path))).alias(path))


def exclude_keys(df: DataFrame, key: str, *others: DataFrame) -> DataFrame:
    """Rows whose key is in none of the others (tombstones, what is ingested already)."""
    for o in others:
        df = df.join(o.select(key), key, "left_anti")
    return df


def with_media(df: DataFrame, files: DataFrame) -> DataFrame:
    """Records whose media file (their path without .json) is there."""
    return df.join(files.select(F.col("path").alias("__m")), F.regexp_replace("path", r"\.json$", "") == F.col("__m"), "left_semi")


def backfill_missing(rows: DataFrame, sidecars: DataFrame, key_col: str, value: Column) -> DataFrame:
    """For rows that lack a value: what their stored record says, and the outcome (missing:
    no record stored; unreadable; no value; found)."""
    stored = sidecars.select(F.col("uuid").alias(key_col), F.lit(True).alias("__has"), F.col("rec"))
    out = rows.join(stored, key_col, "left").withColumn("found", value)
    status = F.when(F.col("__has").isNull(), "missing").when(F.col("rec").isNull(), "unreadable").when(F.col("found").isNull(), "no value").otherwise("found")
    return out.withColumn("status", status).drop("__has", "rec")
