"""Library, people, location-free summaries, coverage, queues and run reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import textcols as tc
from .search import has_coordinates, in_vocabulary, media_in, not_empty


def library_summary(df: DataFrame, media: str | None = "media_type") -> DataFrame:
    """All headline counts of the images and videos (of all rows where media is None), in one
    pass."""
    if media:
        df = df.where(media_in(media))
    year = F.nullif(tc.year_of(F.col("date")), F.lit(""))
    return df.agg(
        F.count("*").alias("total"),
        F.count_if(F.col("state") == 1).alias("enriched"),
        F.count_if(has_coordinates()).alias("with_gps"),
        F.count_if(not_empty("persons")).alias("with_people"),
        F.min(year).alias("min_year"),
        F.max(year).alias("max_year"),
    )


def top_values(df: DataFrame, array: str, n: int | None = 12, vocab: Sequence[str] | None = None, drop_blank: bool = True) -> DataFrame:
    """Most frequent list values; repeats within a row count."""
    out = df.select(F.explode(tc.json_list(F.col(array))).alias("value"))
    if drop_blank:
        out = out.where(tc.strip(F.col("value")) != "")
    if vocab is not None:
        out = out.where(F.col("value").isin(*vocab))
    out = out.groupBy("value").agg(F.count("*").alias("n"))
    return out.orderBy(F.desc("n"), "value").limit(n) if n is not None else out


def top_tags(df: DataFrame, vocab: Sequence[str], n: int | None = 12, tags: str = "tags", media: str = "media_type", state: str = "state") -> DataFrame:
    """The most frequent tags of a vocabulary, on images and videos that are enriched."""
    return top_values(df.where(media_in(media) & (F.col(state) == 1)), tags, n, vocab)


def top_counts(df: DataFrame, col: str, n: int | None = 8) -> DataFrame:
    """The most frequent values of a column that are neither null nor empty."""
    out = df.where(F.nullif(F.col(col), F.lit("")).isNotNull()).groupBy(F.col(col).alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value")
    return out.limit(n) if n is not None else out


def legacy_summary(df: DataFrame, video: Column, done: Column, faces: Column, year: Column) -> DataFrame:
    """Headline numbers of the older tables: photos, videos, enriched photos and their share
    in percent, photos with faces, and the span of years."""
    photo = ~video
    out = df.agg(
        F.count_if(photo).alias("photos"),
        F.count_if(video).alias("videos"),
        F.count_if(photo & done).alias("enriched"),
        F.count_if(photo & faces).alias("with_faces"),
        F.min(year).alias("min_year"),
        F.max(year).alias("max_year"),
    )
    return out.withColumn("percent", F.round(F.try_divide(100 * F.col("enriched"), "photos"), 1))


def people_by_faces(people: DataFrame, name: str, faces: str) -> DataFrame:
    """Named people with their stored number of faces, most first."""
    return people.select(F.col(name).alias("name"), F.col(faces).alias("faces")).orderBy(F.desc("faces"), "name")


def face_totals(people: DataFrame, faces: DataFrame, person: str, name: str) -> DataFrame:
    """One row: people, those with a name, faces, and faces of a known person."""
    named = F.nullif(F.col(name), F.lit("")).isNotNull()
    known = faces.join(people.where(named).select(person), person, "left_semi").agg(F.count("*").alias("named_faces"))
    total = faces.agg(F.count("*").alias("faces"))
    return people.agg(F.count("*").alias("people"), F.count_if(named).alias("named")).join(F.broadcast(total)).join(F.broadcast(known))


def by_year(df: DataFrame, date: str = "date") -> DataFrame:
    return df.where(F.nullif(F.col(date), F.lit("")).isNotNull()).groupBy(tc.year_of(F.col(date)).alias("year")).agg(F.count("*").alias("n")).orderBy("year")


def years(df: DataFrame, date: str = "date") -> DataFrame:
    return df.where(F.nullif(F.col(date), F.lit("")).isNotNull()).select(tc.year_of(F.col(date)).alias("year")).distinct().orderBy(F.desc("year"))


def people_ranked(df: DataFrame, persons: str = "persons", vocab: DataFrame | None = None) -> DataFrame:
    """Rows that hold each name (trimmed, once a row), most first."""
    names = F.array_distinct(F.transform(tc.json_list(F.col(persons)), tc.strip))
    out = df.select(F.explode(names).alias("name")).where("name != ''")
    if vocab is not None:
        out = in_vocabulary(out, "name", vocab)
    return out.groupBy("name").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "name")


def people_list(df: DataFrame, persons: str = "persons") -> DataFrame:
    return df.select(F.explode(tc.json_list(F.col(persons))).alias("name")).where("trim(name) != ''").distinct().orderBy("name")


def sanity(df: DataFrame, tests: dict[str, Column]) -> DataFrame:
    """Row count and one counter per condition, in one pass."""
    return df.agg(F.count("*").alias("total"), *[F.count_if(c).alias(n) for n, c in tests.items()])


def field_coverage(df: DataFrame, fields: Sequence[str], filled: Column | None = None) -> DataFrame:
    """(field, rows with a value) as rows."""
    counts = df.agg(*[F.count_if(F.col(f).isNotNull() & (F.col(f).cast("string") != "")).alias(f) for f in fields])
    return counts.unpivot([], list(fields), "field", "filled")


def coverage_stability(baseline: DataFrame, before: DataFrame, now: DataFrame, least: float = 0.95) -> DataFrame:
    """Per field: ratio to the baseline, unchanged since the last run, and stable where both."""
    b, p, n = (d.select("field", F.col("filled").alias(a)) for d, a in ((baseline, "base"), (before, "prior"), (now, "now")))
    out = b.join(p, "field", "left").join(n, "field", "left")
    ratio = F.when(F.col("base") > 0, F.coalesce("now", F.lit(0)) / F.col("base")).otherwise(F.lit(1.0))
    same = F.col("now").eqNullSafe(F.col("prior"))
    return out.withColumns({"ratio": ratio, "unchanged": same, "stable": (ratio >= least) & same})


def queue_status(df: DataFrame, state: str, ts: str, now: Column, done: int = 1, skipped: Sequence[int] = (2, -1), hours: int = 24) -> DataFrame:
    """Totals per state, done in the last hours, and runs left at that pace."""
    counts = df.agg(
        F.count("*").alias("total"),
        F.count_if(F.col(state) == done).alias("done"),
        F.count_if(F.col(state).isin(*skipped)).alias("skipped"),
        F.count_if(F.coalesce(~F.col(state).isin(done, *skipped), F.lit(True))).alias("pending"),
        F.count_if((F.col(state) == done) & (F.col(ts) > now - F.expr(f"INTERVAL {hours} HOURS"))).alias("last_day"),
    )
    return counts.withColumn("days_left", F.when(F.col("last_day") > 0, F.ceil(F.col("pending") / F.col("last_day"))).cast("long"))


def progress(df: DataFrame, state: str, error: str | None = None) -> DataFrame:
    out = [F.count_if(F.col(state) == 1).alias("done"), F.count_if(F.col(state) == 0).alias("pending"), F.count_if(F.col(state) == 2).alias("errored")]
    if error:
        out.append(F.count_if((F.col(state) == 0) & F.col(error).isNotNull()).alias("pending_with_error"))
    return df.agg(*out)


def run_counters(df: DataFrame, status: str) -> DataFrame:
    return df.groupBy(status).agg(F.count("*").alias("n"))


def run_verdict(counters: DataFrame, floor: int = 3) -> DataFrame:
    """counters: work, ok, failed per run. A run fails only where there was work, nothing
    succeeded and at least `floor` failed."""
    bad = (F.col("work") > 0) & (F.col("ok") == 0) & (F.col("failed") >= floor)
    return counters.withColumn("verdict", F.when(bad, "failed").otherwise("ok"))


def throughput(log: DataFrame, items: str, seconds: str, keys: Sequence[str] = ()) -> DataFrame:
    out = log.groupBy(*keys).agg(F.sum(items).alias("items"), F.sum(seconds).alias("seconds"))
    return out.withColumns({"per_second": F.try_divide("items", "seconds"), "seconds_each": F.try_divide("seconds", "items")})


def bar_heights(df: DataFrame, count: str) -> DataFrame:
    """Share of the largest count, as whole percent; the largest by a grouped maximum."""
    top = df.agg(F.greatest(F.max(count), F.lit(1)).alias("__top"))
    return df.join(F.broadcast(top)).withColumn("height", F.round(100 * F.col(count) / F.col("__top")).cast("int")).drop("__top")


def value_histogram(df: DataFrame, col: str) -> DataFrame:
    return df.groupBy(F.col(col).alias("value")).agg(F.count("*").alias("n"))


def sample_rows(df: DataFrame, n: int, seed: int, key: str) -> DataFrame:
    """n rows in the order of a hash of key and seed, whatever the partitioning."""
    return df.orderBy(F.md5(F.concat_ws("|", F.col(key).cast("string"), F.lit(str(seed))).cast("binary")), key).limit(n)


def carry_forward(current: DataFrame, stored: DataFrame, key: str, words: str) -> DataFrame:
    """Each key's words with those stored for it before; unknown keys get nothing more."""
    old = stored.select(key, F.col(words).alias("__old"))
    none = F.array().cast("array<string>")
    return current.join(old, key, "left").withColumn(words, F.array_sort(F.array_union(F.coalesce(words, none), F.coalesce("__old", none)))).drop("__old")


def keywords_without_names(df: DataFrame, key: str, words: str, names: str) -> DataFrame:
    """Per key, the sorted set of its words that are nobody's name anywhere."""
    people = df.select(F.explode(names).alias("w")).distinct()
    kept = df.select(key, F.explode(words).alias("w")).join(people, "w", "left_anti")
    return kept.groupBy(key).agg(F.sort_array(F.collect_set("w")).alias(words))


def compare_metadata(stored: DataFrame, now: DataFrame, key: str, map_col: str, size: str | None = None) -> DataFrame:
    """Per stored row: changed, and which keys of the map differ (null-safe)."""
    a = stored.select(key, F.col(map_col).alias("__a"), *([size] if size else []))
    b = now.select(key, F.col(map_col).alias("__b"))
    keys = F.array_union(F.map_keys("__a"), F.map_keys("__b"))
    diff = F.filter(keys, lambda k: ~F.try_element_at(F.col("__a"), k).eqNullSafe(F.try_element_at(F.col("__b"), k)))
    out = a.join(b, key).withColumn("diff_keys", F.array_sort(diff))
    return out.withColumn("changed", F.size("diff_keys") > 0).drop("__a", "__b")


def predicted_rewrites(compared: DataFrame, key: str, size: str) -> DataFrame:
    """Rows, changed rows, their share and bytes; a key is changed where any record is."""
    per = compared.groupBy(key).agg(F.max("changed").alias("changed"), F.max(size).alias("size"))
    return per.agg(F.count("*").alias("rows"), F.count_if("changed").alias("changed"), F.sum(F.when(F.col("changed"), F.col("size")).otherwise(0)).alias("bytes")).withColumn("ratio", F.try_divide("changed", "rows"))


def differing_keys(compared: DataFrame, n: int = 15) -> DataFrame:
    return compared.select(F.explode("diff_keys").alias("field")).groupBy("field").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "field").limit(n)


def rows_without(df: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """Rows of df without a partner; an empty other side means that nothing is known, so
    no row is told."""
    return df.join(other.select(key), key, "left_anti") if not other.isEmpty() else df.where(F.lit(False))
