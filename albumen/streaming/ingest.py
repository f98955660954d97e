"""Continuous ingest of records and their late media files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import textcols as tc
from ..operators.ingest import LAST_PART
from ..operators.snapshots import _fs


def sidecar_stream(spark: SparkSession, path: str, pattern: str = "*.json", per_batch: int = 10_000, called: str = LAST_PART) -> DataFrame:
    """New sidecar files as they come: (path, name, uuid, raw). A file that was seen is not
    read again, also after a restart from the checkpoint."""
    raw = spark.readStream.format("text").schema("value string").option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", per_batch).load(path)
    name = F.regexp_extract(F.col("_metadata.file_path"), called, 1)
    return raw.select(F.col("_metadata.file_path").alias("path"), name.alias("name"), tc.uuid_of(name).alias("uuid"), F.col("value").alias("raw"))


def run_stream(stream: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True, every: str = "300 seconds"):
    """Feed batches to apply(batch, number), which must be idempotent for a number; once: all
    that is there now, then stop."""
    writer = stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()


class OnceSink:
    """A table below a folder to which each batch of a stream is added once. A batch is written
    to a folder of its number, whatever an attempt before it left there, and counts from
    when its mark in the log is there; a batch that has one is passed over. So a replayed
    batch changes nothing, and one that died half-way is written anew. Give write() to
    run_stream with a checkpoint that is this table's own."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def committed(self) -> list[int]:
        fs, p, _ = _fs(self.spark, f"{self.path}/log")
        return sorted(int(s.getPath().getName()) for s in fs.listStatus(p)) if fs.exists(p) else []

    def write(self, batch: DataFrame, number: int) -> None:
        if number in self.committed():
            return
        batch.write.mode("overwrite").parquet(f"{self.path}/data/batch={number}")
        self._mark(number)

    def _mark(self, number: int) -> None:
        fs, p, _ = _fs(self.spark, f"{self.path}/log/{number}")
        fs.create(p, True).close()

    def read(self, schema) -> DataFrame:
        """The rows of all batches that count."""
        have = self.committed()
        if not have:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/data/batch={n}" for n in have])


def late_companions(records: DataFrame, files: DataFrame, key: str, at: str, file_at: str, wait: str) -> DataFrame:
    """Two streams joined: each record with the time (file_at) of each file of its key that comes
    up to `wait` before or after it, told as soon as both are there; once, with null, where none
    has come when the watermarks of both streams are past that. Both sides are kept in state no
    longer than the wait; a key's rows meet in one task, keys are spread."""
    left = records.withWatermark(at, "0 seconds")
    right = files.select(F.col(key).alias("__key"), F.col(file_at)).withWatermark(file_at, "0 seconds")
    span = F.expr(f"interval {wait}")
    near = (F.col(file_at) >= F.col(at) - span) & (F.col(file_at) <= F.col(at) + span)
    return left.join(right, (F.col(key) == F.col("__key")) & near, "left_outer").drop("__key")


#: Rows of a stream, over all of its time, for a partition of its state.
STATE_ROWS = 1_000_000


def start_sized(writer, spark: SparkSession, rows: int):
    """Start a stream with state, cut by how many rows it will see and at least once a core: each
    partition opens and writes its stores in every batch, however little is in them. A checkpoint
    keeps the number of its first start."""
    name = "spark.sql.shuffle.partitions"
    before = spark.conf.get(name)
    spark.conf.set(name, str(max(spark.sparkContext.defaultParallelism, -(-rows // STATE_ROWS))))
    try:
        return writer.start()  # the stream takes its own copy of the session
    finally:
        spark.conf.set(name, before)


def held_back(batch: DataFrame, held: DataFrame | None, files: DataFrame, key: str = "uuid") -> tuple[DataFrame, DataFrame]:
    """(ready, still held): records, with those held before, whose media file is there, and
    the others, which the next batch gets again."""
    both = batch if held is None else held.unionByName(batch)
    there = files.select(key).distinct()
    return both.join(there, key, "left_semi"), both.join(there, key, "left_anti")


def drain(queue: Callable[[], DataFrame], run: Callable[[DataFrame], None], batch: int = 500) -> int:
    """Read the queue anew in batches until it is empty."""
    from ..operators.replies import enrich_until

    return enrich_until(queue, run, batch, lambda: False)


def refresh(df: DataFrame, path: str) -> int:
    """A derived table made anew and promoted as its next version."""
    from ..operators.snapshots import promote, write_snapshot

    n = write_snapshot(df, path)
    promote(df.sparkSession, path, n)
    return n
