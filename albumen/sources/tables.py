"""Schemas, readers and writers of the catalogue's files."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import textcols as tc

MANIFEST = "uuid string, year string, changekey string, filename string"
PLACES = "uuid string, name string, aoi string, city string, state string, country string, cc string"


# --- schemas -------------------------------------------------------------------


def ensure_columns(df: DataFrame, required: StructType) -> tuple[DataFrame, list[str]]:
    """df with the required columns that it lacks, as nulls, and their names."""
    new = [f for f in required.fields if f.name not in df.columns]
    return df.withColumns({f.name: F.lit(None).cast(f.dataType) for f in new}) if new else df, [f.name for f in new]


def assert_schema(tables: Mapping[str, DataFrame], required: Mapping[str, Sequence[str]]) -> None:
    """Raise, naming everything that is missing, before any work starts."""
    gone = [t for t in required if t not in tables]
    gone += [f"{t}.{c}" for t, cols in required.items() if t in tables for c in cols if c not in tables[t].columns]
    if gone:
        raise ValueError("missing: " + ", ".join(gone))


def find_link_table(names: Sequence[str], columns: Mapping[str, Sequence[str]], pattern: str, key_parts: Sequence[str]) -> tuple[str, list[str]] | None:
    """First table whose name matches and that has a column with each part in its name."""
    for name in sorted(n for n in names if re.fullmatch(pattern, n)):
        keys = [next((c for c in columns[name] if p.lower() in c.lower()), None) for p in key_parts]
        if all(keys):
            return name, [k for k in keys if k]
    return None


def catalog_links(spark: SparkSession, pattern: str, regex: str, key_parts: Sequence[str]) -> tuple[str, list[str]] | None:
    """The same over the session's catalogue."""
    names = [t.name for t in spark.catalog.listTables(pattern=pattern)]
    return find_link_table(names, {n: spark.table(n).columns for n in names}, regex, key_parts)


def profile_tables(tables: Mapping[str, DataFrame], interesting: str = "(?i)(date|time|name|id|key)") -> DataFrame:
    """One row per table and column: rows, non-null values, type, and an interesting-name flag."""
    out = None
    for name, df in sorted(tables.items()):
        counts = df.agg(F.count("*").alias("rows"), F.struct(*[F.count(c).alias(c) for c in df.columns]).alias("n"))
        cells = F.explode(F.array(*[F.struct(F.lit(f.name).alias("column"), F.lit(f.dataType.simpleString()).alias("type"), F.col(f"n.{f.name}").alias("filled")) for f in df.schema.fields])).alias("c")
        one = counts.select(F.lit(name).alias("table"), "rows", cells).select("table", "rows", "c.*")
        out = one if out is None else out.unionByName(one)
    return out.withColumn("interesting", F.col("column").rlike(interesting))


def sample_of(df: DataFrame, n: int = 3) -> DataFrame:
    """First rows as JSON, with binary columns told by their size."""
    cols = [F.length(f.name).alias(f.name) if f.dataType.simpleString() == "binary" else F.col(f.name) for f in df.schema.fields]
    return df.limit(n).select(F.to_json(F.struct(*cols)).alias("row"))


# --- readers -------------------------------------------------------------------


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def read_live(df: DataFrame, trashed: str) -> DataFrame:
    """Live rows of a relational catalogue (the filter reaches the scan)."""
    return df.where(F.col(trashed) == 0)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """A TSV manifest; lines of fewer than 3 fields are dropped, no file is an empty manifest."""
    if not exists(spark, path):
        return spark.createDataFrame([], MANIFEST)
    lines = spark.read.text(path).select(F.split("value", "\t").alias("f")).where(F.size("f") >= 3)
    return lines.select(*[F.try_element_at("f", F.lit(i + 1)).alias(c) for i, c in enumerate(("uuid", "year", "changekey", "filename"))])


def read_place_dump(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of places; empty texts are null; no file is empty."""
    if not exists(spark, path):
        return spark.createDataFrame([], PLACES)
    raw = spark.read.schema(PLACES).json(path, multiLine=True)
    return raw.select(*[tc.blank_to_null(F.col(c)).alias(c) for c in raw.columns]).where("uuid is not null")


def merge_place_dump(old: DataFrame, new: DataFrame) -> DataFrame:
    """An incremental dump over an older one: rows without a name go, new keys win."""
    new = new.where("name is not null")
    return old.join(new.select("uuid"), "uuid", "left_anti").unionByName(new)


def read_aliases(spark: SparkSession, path: str) -> DataFrame:
    """(raw_lc, canonical) of a two-layer alias document, curated entries before generated
    ones; blank ones dropped; a missing or malformed document is empty."""
    if not exists(spark, path):
        return spark.createDataFrame([], "raw_lc string, canonical string")
    doc = spark.read.text(path, wholetext=True).select(F.try_parse_json("value").alias("v"))
    layers = None
    for rank, layer in enumerate(("generated", "curated")):
        entries = doc.select(F.explode(F.try_variant_get("v", f"$.{layer}", "map<string,string>")).alias("raw", "canonical"), F.lit(rank).alias("rank"))
        layers = entries if layers is None else layers.unionByName(entries)
    return flatten_aliases(layers)


def flatten_aliases(layers: DataFrame) -> DataFrame:
    """layers: raw, canonical, rank. One canonical per lower-cased raw, the highest rank's."""
    rows = layers.select(F.lower(tc.strip(F.col("raw"))).alias("raw_lc"), tc.blank_to_null(F.col("canonical")).alias("canonical"), "rank").where("raw_lc != '' and canonical is not null")
    return rows.groupBy("raw_lc").agg(F.max_by("canonical", F.struct("rank", "canonical")).alias("canonical"))


def parse_vocab_lines(lines: DataFrame, col: str = "value") -> DataFrame:
    """(name, count) of "name: count" lines: quotes and space off, unknown people and lines of
    another form dropped, the largest line number wins where a name repeats. lines: col, line."""
    form = r"^\s*[\"']?(.*?)[\"']?\s*:\s*(\d+)\s*,?\s*$"
    rows = lines.select("line", tc.strip(F.regexp_extract(col, form, 1)).alias("name"), F.regexp_extract(col, form, 2).try_cast("long").alias("count"))
    rows = rows.where("name != '' and name != '_UNKNOWN_' and count is not null")
    return rows.groupBy("name").agg(F.max_by("count", "line").alias("count"))


def read_vocab_text(spark: SparkSession, path: str) -> DataFrame:
    text = spark.read.text(path, wholetext=True)
    lines = text.select(F.posexplode(F.split("value", "\n")).alias("line", "value"))
    return parse_vocab_lines(lines)


def read_metadata_dump(spark: SparkSession, path: str) -> DataFrame:
    """Earlier exports: rows (gzip JSON lines) whose file isn't a JSON file."""
    rows = spark.read.schema("uuid string, filepath string, dest_size long, exifdata string").json(path)
    return rows.where(~F.lower("filepath").endswith(".json"))


# --- writers -------------------------------------------------------------------


def write_changed(df: DataFrame, path: str) -> None:
    df.select("uuid", "year").write.csv(path, sep="\t")


def write_json(df: DataFrame, path: str, searched: bool | None = None, compressed: bool = False) -> None:
    """JSON lines; a query's export has 500 rows with a search and 1000 without."""
    if searched is not None:
        df = df.limit(500 if searched else 1000)
    df.write.json(path, compression="gzip" if compressed else None)


def write_aliases(generated: DataFrame, path: str, curated: DataFrame | None = None) -> None:
    """The document that read_aliases reads: the curated layer as it is and the generated one
    (both raw, canonical; an empty layer where not given), sorted. The document is one JSON
    text, which one row holds."""

    def layer(df: DataFrame | None, name: str) -> DataFrame:
        df = generated.limit(0) if df is None else df
        one = df.where("raw is not null").groupBy("raw").agg(F.max("canonical").alias("canonical"))
        return one.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("raw", "canonical")))).alias(name))

    doc = layer(curated, "curated").join(F.broadcast(layer(generated, "generated")))
    doc.select(F.to_json(F.struct("curated", "generated"))).coalesce(1).write.text(path)


def write_vocabulary(vocab: DataFrame, path: str) -> None:
    """Most photographed first; an empty vocabulary is refused."""
    if vocab.isEmpty():
        raise ValueError("refusing an empty vocabulary")
    vocab.orderBy(F.desc("count"), "name").write.json(path)


def report_lines(df: DataFrame, cols: Sequence[str], order: Sequence) -> DataFrame:
    """Rows of a Markdown table, in order."""
    cells = F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols]), F.lit(" |"))
    return df.orderBy(*order).select(cells.alias("line"))


def write_report(df: DataFrame, path: str, cols: Sequence[str], order: Sequence) -> None:
    """A review sheet: small, so one ordered file."""
    report_lines(df, cols, order).coalesce(1).write.text(path)


def append_run_log(counters: DataFrame, path: str) -> None:
    counters.write.mode("append").parquet(path)


def write_keyword_map(df: DataFrame, key: str, words: str, path: str) -> None:
    df.where(F.size(words) > 0).select(key, words).write.json(path, compression="gzip")


def coverage_dump(df: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """key -> field -> sorted values; rows without a key left out."""
    return df.where(F.col(key).isNotNull()).select(key, *[F.array_sort(F.coalesce(f, F.array().cast("array<string>"))).alias(f) for f in fields])
