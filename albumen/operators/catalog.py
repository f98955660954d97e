"""Star joins, labels, memberships and files of a relational asset catalogue."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import textcols as tc
from .search import ranked_within


def star_join(assets: DataFrame, attributes: DataFrame, descriptions: DataFrame, key: str, attribute_key: str, description_key: str) -> DataFrame:
    """Assets with their attributes and description, both optional."""
    return assets.join(attributes.withColumnRenamed(attribute_key, key), key, "left").join(descriptions, description_key, "left")


def top_labels(df: DataFrame, key: str, label: str, confidence: str, n: int = 8, least: float | None = None) -> DataFrame:
    """The n surest labels per key, with confidences rounded to 3 digits, as rank-ordered
    lists; ties go to the smaller label."""
    out = df if least is None else df.where(F.col(confidence) >= least)
    out = ranked_within(out, [key], [F.desc(confidence), F.asc(label)], n)
    lists = out.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("rank", F.col(label).alias("label"), F.round(confidence, 3).alias("confidence")))).alias("t"))
    return lists.select(key, F.transform("t", lambda x: x["label"]).alias("labels"), F.transform("t", lambda x: x["confidence"]).alias("confidences"))


def bridged(labels: DataFrame, bridge: DataFrame, assets: DataFrame, label_key: str, asset_key: str, kind: Column | None = None) -> DataFrame:
    """Labels with the asset that a bridge leads them to (inner on both sides), those of one
    kind where it is given. bridge: label_key and asset_key."""
    kept = labels if kind is None else labels.where(kind)
    return kept.join(bridge.select(label_key, asset_key), label_key).join(assets.select(asset_key), asset_key)


def names_in_order(links: DataFrame, key: str, name: str, order: str) -> DataFrame:
    """Distinct names per key, first seen first."""
    first = links.where(F.col(name).isNotNull()).groupBy(key, name).agg(F.min(order).alias("o"))
    return first.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("o", F.col(name).alias("n")))), lambda x: x["n"]).alias("names"))


def related_names(links: DataFrame, parents: DataFrame, child: str, parent: str, name: str) -> DataFrame:
    """Ordered parent names per child; links to no parent are dropped."""
    both = links.join(parents, parent).select(child, F.col(name).alias("n")).where("n is not null")
    return both.groupBy(child).agg(F.array_sort(F.collect_list("n")).alias("names"))


def membership_counts(links: DataFrame, parents: DataFrame, child: str, parent: str) -> DataFrame:
    """Distinct children per parent, empty parents included."""
    n = links.groupBy(parent).agg(F.count_distinct(child).alias("members"))
    return parents.join(n, parent, "left").withColumn("members", F.coalesce("members", F.lit(0).cast("long")))


def visible_faces(faces: DataFrame, people: DataFrame, person_key: str, name: str) -> DataFrame:
    """Faces that are shown, not thrown away, and of a named person."""
    shown = faces.where("coalesce(hidden, 0) = 0 and coalesce(in_trash, 0) = 0")
    return shown.join(people.where(F.coalesce(F.col(name), F.lit("")) != ""), person_key)


def coded_labels(df: DataFrame, code: str, dim: DataFrame, prefix: str = "scene_") -> DataFrame:
    """Label of a code from a (code, label) dimension, else prefix and code."""
    return df.join(dim.select(code, "label"), code, "left").withColumn("label", tc.label_or_code(F.col("label"), F.col(code), prefix))


def resolve_files(assets: DataFrame, files: DataFrame, key: str, filename: str, path: str = "path") -> DataFrame:
    """Each asset's file: the exact name, else the name in any case, else the same stem with
    any extension; ties go to the first path. files: path."""
    base = F.regexp_extract(F.col(path), r"([^/]*)$", 1)
    listed = files.select(F.col(path).alias("path"), base.alias("file"), F.upper(F.regexp_replace(base, r"\.[^.]*$", "")).alias("stem"))
    asked = assets.select(key, F.col(filename).alias("want"), F.upper(F.regexp_replace(F.col(filename), r"\.[^.]*$", "")).alias("stem"))
    level: Column = F.when(F.col("file") == F.col("want"), 0).when(F.lower("file") == F.lower("want"), 1).otherwise(2)
    best = asked.join(listed, "stem").groupBy(key).agg(F.min(F.struct(level.alias("level"), F.col("path"))).alias("b"))
    return assets.join(best.select(key, F.col("b.path").alias("path"), F.col("b.level").alias("level")), key, "left")


def available_first(df: DataFrame, available: str, key: str) -> DataFrame:
    return df.orderBy(F.desc(available), key)


def legacy_listing(df: DataFrame, chars: int = 200, tags: int = 6) -> DataFrame:
    """What the older listing shows of a row."""
    return df.withColumns({"label": tc.listing_label(F.col("guess"), F.col("city"), F.col("country")), "short": F.substring("description", 1, chars), "tag_list": F.slice(tc.json_list(F.col("tags")), 1, tags)})


def clean_people_tags(df: DataFrame, key: str, tags: str, pattern: str = r"(?i)^people:.+$") -> DataFrame:
    """JSON tag lists without the elements that match, and what became of each row:
    updated, unchanged or unparseable."""
    old = F.from_json(F.col(tags), "array<string>")
    new = tc.without_matching(old, pattern)
    status = F.when(old.isNull() & F.col(tags).isNotNull(), "unparseable").when(F.size(old) != F.size(new), "updated").otherwise("unchanged")
    return df.select(key, F.when(status == "updated", F.to_json(new)).otherwise(F.col(tags)).alias(tags), status.alias("status"))


def status_counts(df: DataFrame, keys: Sequence[str] = ("status",)) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n"))
