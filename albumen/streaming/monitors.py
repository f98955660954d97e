"""Heartbeats, stuck holders and alert suppression, as streams and as batches."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def _events(df: DataFrame, key: str, ts: str, delay: str) -> DataFrame:
    """Watermarks need a timestamp with a zone."""
    return df.select(F.col(key).cast("string").alias("key"), F.col(ts).cast("timestamp").alias("ts")).withWatermark("ts", delay)


def heartbeat_monitor(df: DataFrame, key: str, ts: str, gap_seconds: int, delay: str = "0 seconds") -> DataFrame:
    """Stream of (key, last, seconds): a key was silent for more than gap_seconds, told when
    its next heartbeat comes or, at the latest, when the watermark passes the gap."""

    def step(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = []
        if state.hasTimedOut:
            last = state.get[0]
            rows.append((group[0], pd.Timestamp(last, unit="us"), None))
            state.remove()
        else:
            last = state.get[0] if state.exists else None
            times = sorted(int(t.value // 1000) for pdf in batches for t in pdf["ts"])
            for t in times:
                if last is not None and t - last > gap_seconds * 1_000_000:
                    rows.append((group[0], pd.Timestamp(last, unit="us"), (t - last) // 1_000_000))
                last = t if last is None else max(last, t)
            if last is not None:
                state.update((last,))
                state.setTimeoutTimestamp(max(last // 1000 + gap_seconds * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(rows, columns=["key", "last", "seconds"]).astype({"seconds": "Int64"})

    return _events(df, key, ts, delay).groupBy("key").applyInPandasWithState(step, "key string, last timestamp, seconds long", "last long", "append", GroupStateTimeout.EventTimeTimeout)


def heartbeat_gaps(df: DataFrame, key: str, ts: str, gap_seconds: int) -> DataFrame:
    """Batch form: every silence that ended. A key's rows are dealt by day, so that one that
    beats without end is split; days meet by their first and last beats."""
    rows = df.select(key, ts).where(F.col(ts).isNotNull()).withColumn("__day", F.to_date(ts))
    within = rows.withColumn("last", F.lag(ts).over(Window.partitionBy(key, "__day").orderBy(ts)))
    days = rows.groupBy(key, "__day").agg(F.min(ts).alias(ts), F.max(ts).alias("__end"))
    across = days.withColumn("last", F.lag("__end").over(Window.partitionBy(key).orderBy("__day")))
    both = within.select(key, "last", ts).unionByName(across.select(key, "last", ts)).where("last is not null")
    at = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    us = at(ts) - at("last")
    return both.where(us > gap_seconds * 1_000_000).select(key, "last", F.floor(us / 1_000_000).cast("long").alias("seconds"))


def stale(df: DataFrame, key: str, ts: str, now, gap_seconds: int) -> DataFrame:
    """Keys whose last heartbeat is longer ago than the gap; a grouped maximum, no window."""
    last = df.groupBy(key).agg(F.max(ts).alias("last"))
    return last.where(F.unix_seconds(F.lit(now).cast("timestamp")) - F.unix_seconds(F.col("last").cast("timestamp")) > gap_seconds)


def stuck_monitor(df: DataFrame, key: str, ts: str, is_open: str, limit_seconds: int, delay: str = "0 seconds") -> DataFrame:
    """Stream of (key, since, seconds): a holder was open for longer than the limit, told when
    it closes (with the time held) or when the watermark passes the limit (without). df: key,
    ts and is_open (boolean); a second open event keeps the first one's time."""
    rows_in = df.select(F.col(key).cast("string").alias("key"), F.col(ts).cast("timestamp").alias("ts"), F.col(is_open).alias("open")).withWatermark("ts", delay)

    def step(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        since = state.get[0] if state.exists else None
        rows = []
        if state.hasTimedOut:
            rows.append((group[0], pd.Timestamp(since, unit="us"), None))
            since = None
        else:
            for t, opened in sorted((int(t.value // 1000), bool(o)) for pdf in batches for t, o in zip(pdf["ts"], pdf["open"], strict=True)):
                if opened:
                    since = t if since is None else since
                elif since is not None:
                    if t - since > limit_seconds * 1_000_000:
                        rows.append((group[0], pd.Timestamp(since, unit="us"), (t - since) // 1_000_000))
                    since = None
        if since is None:
            if state.exists:
                state.remove()
        else:
            state.update((since,))
            state.setTimeoutTimestamp(max(since // 1000 + limit_seconds * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(rows, columns=["key", "since", "seconds"]).astype({"seconds": "Int64"})

    return rows_in.groupBy("key").applyInPandasWithState(step, "key string, since timestamp, seconds long", "since long", "append", GroupStateTimeout.EventTimeTimeout)


def stuck_holders(df: DataFrame, key: str, ts: str, is_open, now, limit_seconds: int) -> DataFrame:
    """Holders whose last event is an open one older than the limit."""
    last = df.groupBy(key).agg(F.max_by(F.struct(F.col(ts).alias("ts"), is_open.alias("open")), ts).alias("e"))
    age = F.unix_seconds(F.lit(now).cast("timestamp")) - F.unix_seconds(F.col("e.ts").cast("timestamp"))
    return last.where(F.col("e.open") & (age > limit_seconds)).select(key, F.col("e.ts").alias("since"), age.alias("seconds"))


def suppress_alerts(df: DataFrame, key: str, ts: str, firing: str, every_seconds: int, delay: str = "0 seconds") -> DataFrame:
    """Stream of alerts that go out: the first of a condition, then one per every_seconds while
    it lasts; a row that isn't firing clears the condition. df: key, ts, firing (boolean)."""
    rows_in = df.select(F.col(key).cast("string").alias("key"), F.col(ts).cast("timestamp").alias("ts"), F.col(firing).alias("firing")).withWatermark("ts", delay)

    def step(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        held = sorted((int(t.value // 1000), bool(f)) for pdf in batches for t, f in zip(pdf["ts"], pdf["firing"], strict=True))
        out, last = sent_alerts(held, last, every_seconds)
        if last is None:
            if state.exists:
                state.remove()
        else:
            state.update((last,))
        yield pd.DataFrame({"key": [group[0]] * len(out), "ts": pd.to_datetime(pd.Series(out, dtype="int64"), unit="us")})

    return rows_in.groupBy("key").applyInPandasWithState(step, "key string, ts timestamp", "last long", "append", GroupStateTimeout.NoTimeout)


def sent_alerts(events: list[tuple[int, bool]], last: int | None, every_seconds: int) -> tuple[list[int], int | None]:
    out = []
    for t, firing in events:
        if not firing:
            last = None
        elif last is None or t - last >= every_seconds * 1_000_000:
            out.append(t)
            last = t
    return out, last


def alert_episodes(df: DataFrame, key: str, ts: str, firing, every_seconds: int) -> DataFrame:
    """Batch form: firing rows that go out, as (key, ts). The first of an episode goes out, and
    then the first that is every_seconds or more after the last one that did; a row that
    isn't firing ends the episode (of rows at one time it comes first). Rows stream through
    their key's task in order; only the last alert is held."""
    rows = df.select(F.col(key), F.col(ts).cast("timestamp").alias(ts), firing.alias("__f")).where(F.col(ts).isNotNull() & F.col("__f").isNotNull())
    rows = rows.withColumn("__us", F.unix_micros(ts)).repartition(key).sortWithinPartitions(key, ts, "__f")

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, last = None, None
        for pdf in batches:
            keys, fires, us = pdf[key].tolist(), pdf["__f"].tolist(), pdf["__us"].tolist()
            sent = []
            for i, (k, fire, t) in enumerate(zip(keys, fires, us, strict=True)):
                if i == 0 and held is None or k != held:
                    held, last = k, None
                out, last = sent_alerts([(t, fire)], last, every_seconds)
                if out:
                    sent.append(i)
            yield pdf.iloc[sent][[key, ts]]

    out = rows.mapInPandas(work, f"{key} {rows.schema[key].dataType.simpleString()}, {ts} timestamp")
    return out.select(key, F.col(ts).cast(df.schema[ts].dataType).alias(ts))
