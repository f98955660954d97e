"""Sampling plans and rendition queues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sample_offsets(df: DataFrame, key: str, duration: str, n: int) -> DataFrame:
    """(key, k, offset) in the middle of n equal parts; with no known duration one a second."""
    d = F.col(duration)
    known = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: d * (k + F.lit(0.5)) / F.lit(float(n)))
    unknown = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: k.cast("double"))
    return df.select(key, F.posexplode(F.when(d > 0, known).otherwise(unknown)).alias("k", "offset"))


def rendition_size(w: Column, h: Column, bound: int | None = None, max_pixels: int | None = None) -> Column:
    """struct(width, height) bounded by a side or by a pixel budget, never enlarged."""
    if bound is not None:
        scale = F.least(F.lit(float(bound)) / w, F.lit(float(bound)) / h, F.lit(1.0))
    else:
        scale = F.least(F.sqrt(F.lit(float(max_pixels)) / (w * h)), F.lit(1.0))
    fit = lambda x: F.greatest(F.lit(1), F.floor(x * scale)).cast("int")
    return F.struct(fit(w).alias("width"), fit(h).alias("height"))


def rendition_queue(index: DataFrame, cached: DataFrame, key: str, is_video: Column, limit: int | None = None) -> DataFrame:
    """Media without a rendition, the cheap kind first."""
    out = index.join(cached.select(key), key, "left_anti").withColumn("is_video", is_video).orderBy("is_video", key)
    return out.limit(limit) if limit is not None else out
