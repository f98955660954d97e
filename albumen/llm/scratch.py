"""Cutting lineage: tables written to the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL: dict[str, str] = {}


def folder(spark: SparkSession) -> str:
    """The shared folder that spark.checkpoint.dir names. Where that is unset, a session
    on one machine (tests) gets a folder of its process, and a cluster is refused: a folder
    of one machine would lose rows there. Tables written stay until the folder is
    cleared, since a later action may still read them."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return _LOCAL.setdefault("dir", "file://" + tempfile.mkdtemp(prefix="albumen-"))


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df once as Parquet in the shared folder and read it back: the result
    survives lost executors and its lineage starts at those files."""
    spark = df.sparkSession
    path = f"{folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, doc_id: str, text: str, nulls_last: bool = False) -> tuple[DataFrame, bool]:
    """df with a unique column __doc in the order of doc_id (equal ones by text): doc_id
    itself where it is unique and not null, else a written row number; and is it a number."""
    ids = df.select(F.col(doc_id).cast("long").alias("i"))
    odd = ids.groupBy("i").agg(F.count("*").alias("n")).where("n > 1 or i is null").limit(1).count()
    if not odd:
        return df.withColumn("__doc", F.col(doc_id).cast("long")), False
    at = F.col(doc_id).asc_nulls_last() if nulls_last else F.col(doc_id).asc_nulls_first()
    ordered = df.repartitionByRange(at, F.col(text)).sortWithinPartitions(at, F.col(text))
    return written(ordered.withColumn("__doc", F.monotonically_increasing_id()), "numbered"), True


_SETTINGS = {
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    "spark.sql.execution.arrow.maxBytesPerBatch": "8m",
}


@contextmanager
def tidy(spark: SparkSession):
    """Within the block, a finished write's shuffle files are removed at once instead of
    when the driver next collects garbage, and Python gets batches of few rows and bytes,
    since rows may hold whole sets."""
    before = {k: spark.conf.get(k, None) for k in _SETTINGS}
    for k, v in _SETTINGS.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
