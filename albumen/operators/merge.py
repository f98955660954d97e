"""Keyed merges: each takes a base snapshot and a delta and returns the new snapshot."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import textcols as tc


def _paired(base: DataFrame, new: DataFrame, key: str, how: str) -> DataFrame:
    """One row per key with structs __old and __new (null where that side has none)."""
    old = base.select(F.col(key), F.struct(*base.columns).alias("__old"))
    add = new.select(F.col(key), F.struct(*new.columns).alias("__new"))
    return old.join(add, key, how)


def upsert_fill_null(base: DataFrame, new: DataFrame, key: str, fill: Sequence[str], refresh: Sequence[str]) -> DataFrame:
    """Insert new keys; of known ones take the refresh columns from the new row, fill
    columns only where they were null, and leave all else."""

    def value(c: str) -> Column:
        has_new = c in new.columns
        fresh = F.col(f"__new.{c}") if has_new else F.lit(None)
        if c in refresh and has_new:
            known = F.coalesce(fresh, F.col(f"__old.{c}"))
        elif c in fill and has_new:
            known = F.coalesce(F.col(f"__old.{c}"), fresh)
        else:
            known = F.col(f"__old.{c}")
        return F.when(F.col("__old").isNull(), fresh).otherwise(known).alias(c)

    return _paired(base, new, key, "full").select(key, *[value(c) for c in base.columns if c != key])


def upsert_overwrite(base: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Known keys get every column that the new row has, nulls as well."""

    def value(c: str) -> Column:
        if c not in new.columns:
            return F.col(f"__old.{c}").alias(c)
        return F.when(F.col("__new").isNotNull(), F.col(f"__new.{c}")).otherwise(F.col(f"__old.{c}")).alias(c)

    return _paired(base, new, key, "full").select(key, *[value(c) for c in base.columns if c != key])


def latest_wins(dfs: Sequence[DataFrame], key: str, version: str) -> DataFrame:
    """Union by key; the largest version's row stays (ties: the later frame)."""
    parts = [d.withColumn("__at", F.lit(i)) for i, d in enumerate(dfs)]
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p, allowMissingColumns=True)
    cols = [c for c in both.columns if c not in (key, "__at")]
    best = both.groupBy(key).agg(F.max_by(F.struct(*cols), F.struct(F.col(version), F.col("__at"))).alias("r"))
    return best.select(key, "r.*")


def right_wins(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keyed union in which the right side replaces the left."""
    return left.join(right.select(key), key, "left_anti").unionByName(right, allowMissingColumns=True)


def place_status(base: DataFrame, dump: DataFrame, key: str) -> DataFrame:
    """Each dump row with its outcome: unknown key, protected (set by hand), empty or updated."""
    known = base.select(key, F.col("place_source").alias("__src"), F.lit(True).alias("__known"))
    name = tc.blank_to_null(F.col("name"))
    status = F.when(F.col("__known").isNull(), "unknown").when(F.col("__src").eqNullSafe("manual"), "protected").when(name.isNull(), "empty").otherwise("updated")
    return dump.join(known, key, "left").withColumn("status", status).drop("__src", "__known")


# The parts of a place in the catalogue, and their names in a dump.
BREAKDOWN = {"place_aoi": "aoi", "place_city": "city", "place_state": "state", "place_country": "country", "place_country_code": "cc"}
MAX_PLACE, MAX_DESCRIPTION = 240, 4000  # characters of a typed place and description


def merge_places(base: DataFrame, dump: DataFrame, key: str, source: str = "apple", at: Column | None = None) -> DataFrame:
    """Places of the dump on known rows that nobody set by hand; borrowed ones are replaced. The
    whole breakdown that base has is replaced with the name: what the dump lacks or has
    blank becomes null. at: the value of place_updated_at, where base has it."""
    clean = lambda c: tc.blank_to_null(F.col(c))
    parts = {c: (clean(d) if d in dump.columns else F.lit(None).cast("string")).alias(f"__{c}") for c, d in BREAKDOWN.items() if c in base.columns}
    good = place_status(base, dump, key).where("status = 'updated'").select(key, clean("name").alias("__name"), *parts.values())
    out = base.join(good, key, "left")
    hit = F.col("__name").isNotNull()
    values = {"place_name": F.col("__name"), "place_source": F.lit(source)} | {c: F.col(f"__{c}") for c in parts}
    if at is not None and "place_updated_at" in base.columns:
        values["place_updated_at"] = at
    return out.withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in values.items()}).drop("__name", *[f"__{c}" for c in parts])


def merge_enrichment(base: DataFrame, results: DataFrame, key: str, protected: Sequence[str], replaced: Mapping[str, Column], edited: str = "edited_fields") -> DataFrame:
    """Results on known rows; a protected column that is listed in `edited` keeps the edit.
    replaced: columns set on every row that has a result."""
    new = results.select(key, *[F.col(c).alias(f"__{c}") for c in results.columns if c != key], F.lit(True).alias("__hit"))
    out = base.join(new, key, "left")
    hit = F.coalesce(F.col("__hit"), F.lit(False))
    kept = tc.json_list(F.col(edited))
    values = {c: F.when(hit & ~F.array_contains(kept, c), F.col(f"__{c}")).otherwise(F.col(c)) for c in protected}
    values |= {c: F.when(hit, v).otherwise(F.col(c)) for c, v in replaced.items()}
    return out.withColumns(values).drop(*[c for c in new.columns if c != key])


def merge_failures(base: DataFrame, failures: DataFrame, key: str, error: str = "error", reason: str = "reason", into_description: bool = False, state: int | None = None) -> DataFrame:
    """The reason (500 characters) on failed rows; the state stays, so they are tried again,
    unless one is given. into_description: the older form that put it in the description."""
    new = failures.select(key, F.substring(reason, 1, 500).alias("__reason"))
    out = base.join(new, key, "left")
    hit = F.col("__reason").isNotNull()
    target = "description" if into_description else error
    old = F.col(target) if target in base.columns else F.lit(None).cast("string")
    out = out.withColumn(target, F.when(hit, F.col("__reason")).otherwise(old))
    if state is not None:
        out = out.withColumn("state", F.when(hit, F.lit(state)).otherwise(F.col("state")))
    return out.drop("__reason")


def mark_skipped(base: DataFrame, skips: DataFrame, key: str, state: int = 2) -> DataFrame:
    out = base.join(skips.select(key).distinct().withColumn("__s", F.lit(True)), key, "left")
    return out.withColumn("state", F.when(F.col("__s"), F.lit(state)).otherwise(F.col("state"))).drop("__s")


def move_state(df: DataFrame, when: Column, frm: int, to: int, state: str = "state") -> DataFrame:
    """Bulk move of one state; running it again changes nothing."""
    return df.withColumn(state, F.when(when & (F.col(state) == frm), F.lit(to)).otherwise(F.col(state)))


def cleaned_edits(edits: DataFrame, lists: Sequence[str] = ("persons", "tags")) -> DataFrame:
    """Edit rows as they are stored: lists (arrays, or their JSON) through the list rule and as
    JSON, a description trimmed to 4,000 characters, a place with its white space collapsed
    to 240, a date trimmed. What is blank stays given (an empty text)."""

    def stored(c: str) -> Column:
        if c in lists:
            given = F.col(c) if dict(edits.dtypes)[c].startswith("array") else tc.json_list(F.col(c))
            return F.when(F.col(c).isNotNull(), F.to_json(tc.clean_list(given)))
        if c == "description":
            return F.substring(tc.strip(F.col(c)), 1, MAX_DESCRIPTION)
        if c == "place_name":
            return F.substring(F.regexp_replace(tc.strip(F.col(c)), r"\s+", " "), 1, MAX_PLACE)
        return tc.strip(F.col(c)) if c == "date" else F.col(c)

    return edits.select(*[stored(c).alias(c) for c in edits.columns])


def apply_edits(base: DataFrame, edits: DataFrame, key: str, lists: Sequence[str] = ("persons", "tags"), at: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(new snapshot, rejected edits). An edit row has null for what it doesn't touch, and its
    values are cleaned (cleaned_edits); a blank description becomes null. A place edit replaces
    the whole place: the breakdown of the old one becomes null, its source manual (a blank
    place: null, which hands the row back), place_updated_at the value of at. An edit whose
    date isn't a date, or whose key is unknown, is rejected whole. Edited fields add up."""
    edits = cleaned_edits(edits, lists)
    bad = F.col("date").isNotNull() & ~tc.valid_date(F.col("date")) if "date" in edits.columns else F.lit(False)
    known = base.select(key, F.lit(True).alias("__known"))
    judged = edits.join(known, key, "left").withColumn("reason", F.when(F.col("__known").isNull(), "unknown key").when(bad, "bad date"))
    rejected = judged.where("reason is not null").drop("__known")
    good = judged.where("reason is null").select(key, *[F.col(c).alias(f"__{c}") for c in edits.columns if c != key])
    fields = [c for c in edits.columns if c != key]
    out = base.join(good, key, "left")
    touched = F.filter(F.array(*[F.when(F.col(f"__{c}").isNotNull(), F.lit(c)) for c in fields]), lambda x: x.isNotNull())
    values = {c: F.coalesce(f"__{c}", c) for c in fields if c not in ("place_name", "description")}
    if "description" in fields:
        values["description"] = F.when(F.col("__description").isNotNull(), F.nullif("__description", F.lit(""))).otherwise(F.col("description"))
    if "place_name" in fields:
        given = F.col("__place_name").isNotNull()
        name = tc.blank_to_null(F.col("__place_name"))
        place = {"place_name": name, "place_source": F.when(name.isNotNull(), "manual")} | {c: F.lit(None).cast("string") for c in BREAKDOWN if c in base.columns}
        if at is not None and "place_updated_at" in base.columns:
            place["place_updated_at"] = at
        values |= {c: F.when(given, v).otherwise(F.col(c)) for c, v in place.items()}
    if "datetime_original" in base.columns and "date" in fields:
        values["datetime_original"] = F.when(F.col("__date").isNotNull(), F.coalesce(tc.retime_iso(F.col("datetime_original"), F.col("__date")), F.col("datetime_original"))).otherwise(F.col("datetime_original"))
    if "edited_fields" in base.columns:
        listed = F.array_sort(F.array_union(tc.json_list(F.col("edited_fields")), touched))
        values["edited_fields"] = F.when(F.size(touched) > 0, F.to_json(listed)).otherwise(F.col("edited_fields"))
    return out.withColumns(values).select(*base.columns), rejected


def tombstone(base: DataFrame, keys: DataFrame, key: str, stones: DataFrame, at: Column, reason: str) -> tuple[DataFrame, DataFrame]:
    """(tombstones with the new keys, rows that are left): write the first before the second."""
    new = keys.select(key).distinct().join(stones.select(key), key, "left_anti").withColumns({"at": at, "reason": F.lit(reason)})
    all_stones = stones.unionByName(new)
    return all_stones, base.join(all_stones.select(key), key, "left_anti")


def replace_vocabulary(new: DataFrame) -> DataFrame:
    """The new vocabulary, refused where it is empty."""
    if new.isEmpty():
        raise ValueError("refusing an empty vocabulary")
    return new


def changed_fields(base: DataFrame, draft: DataFrame, key: str) -> DataFrame:
    """Only what a draft changes: null where a field is as stored; rows that change nothing
    go. Lists compare in order. The result is what apply_edits takes."""
    cols = [c for c in draft.columns if c != key]
    old = base.select(key, *[F.col(c).alias(f"__{c}") for c in cols])
    out = draft.join(old, key)
    out = out.select(key, *[F.when(~F.col(c).eqNullSafe(F.col(f"__{c}")), F.col(c)).alias(c) for c in cols])
    return out.where(F.greatest(*[F.col(c).isNotNull() for c in cols]) if len(cols) > 1 else F.col(cols[0]).isNotNull())


def fill_coordinates(base: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """Recovered coordinates on rows that have none."""
    new = found.select(key, F.col("gps_lat").alias("__lat"), F.col("gps_lon").alias("__lon"))
    empty = F.col("gps_lat").isNull() | F.col("gps_lon").isNull()
    out = base.join(new, key, "left")
    return out.withColumns({"gps_lat": F.when(empty, F.col("__lat")).otherwise(F.col("gps_lat")), "gps_lon": F.when(empty, F.col("__lon")).otherwise(F.col("gps_lon"))}).drop("__lat", "__lon")
