"""Keyed state over finished event tables: what the streaming operators compute, as batch queries."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bookloom.operators.ranges import running_sum

#: The window in seconds and limits per key, the context limit in bytes, the cost of a message, and
#: how many seconds a user state lives.
WINDOW_SECONDS, PER_ADDRESS, PER_USER, CONTEXT_BYTES, MESSAGE_BYTES, STATE_SECONDS = 60, 10, 5, 4096, 50, 3600


def fixed_windows(events: DataFrame, key: str = "key", seconds: int = WINDOW_SECONDS, limit: int = PER_USER) -> DataFrame:
    """key, ts, window_start, count, allowed, retry_after: a window starts at the first event after the last one ended.

    Events are dealt by key and stream through in order; a key's state is one timestamp and one count.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, start, n = object(), None, 0
        span = pd.Timedelta(seconds=seconds)
        for b in batches:
            starts, counts = [], []
            for k, ts in zip(b["key"], b["ts"]):
                if k != now or ts >= start + span:
                    now, start, n = k, ts, 0
                n += 1
                starts.append(start)
                counts.append(n)
            yield b.assign(window_start=starts, count=counts)

    rows = events.select(F.col(key).alias("key"), "ts").repartition("key").sortWithinPartitions("key", "ts")
    out = rows.mapInPandas(run, f"key {dict(rows.dtypes)['key']}, ts timestamp, window_start timestamp, count long")
    left = F.greatest(F.lit(seconds) - (F.unix_micros("ts") - F.unix_micros("window_start")) / 1e6, F.lit(1.0)).cast("long")
    return out.withColumn("allowed", F.col("count") <= limit).withColumn("retry_after", F.when(~F.col("allowed"), left))


def trim_conversations(messages: DataFrame, limit: int = CONTEXT_BYTES) -> DataFrame:
    """The messages (conv_id, turn, role, text) that stay when the oldest go until the rest fits; the last one always stays."""
    cost = F.octet_length(F.coalesce("text", F.lit(""))) + F.octet_length(F.coalesce("role", F.lit(""))) + MESSAGE_BYTES
    back = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    rows = messages.withColumn("_sum", F.sum(cost).over(back.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_nth", F.row_number().over(back))
    return rows.where((F.col("_sum") <= limit) | (F.col("_nth") == 1)).drop("_sum", "_nth")


def conversation_stats(messages: DataFrame) -> DataFrame:
    size = F.octet_length(F.coalesce("text", F.lit(""))) + F.octet_length(F.coalesce("role", F.lit(""))) + MESSAGE_BYTES
    role = lambda r: F.count_if(F.col("role") == r)
    return messages.groupBy("conv_id").agg(F.count("*").alias("messages"), role("user").alias("user_messages"), role("assistant").alias("bot_messages"), F.sum(size).cast("long").alias("length"))


def progress_snapshots(events: DataFrame, key: str, every: int) -> DataFrame:
    """Of each key's events in order, the running count at every so many and at the last."""
    rows = running_sum(events, [key], ["ts", "event_id"], F.lit(1).cast("long"), "done", "total")
    return rows.where((F.col("done") % every == 0) | (F.col("done") == F.col("total")))


def user_states(events: DataFrame, now, seconds: int = STATE_SECONDS) -> DataFrame:
    """key, state at now: the last one set (events: key, ts, state; ties by state), unless it was empty or is older than seconds."""
    past = events.where(F.col("ts") <= F.lit(now))
    last = past.groupBy("key").agg(F.max(F.struct("ts", "state")).alias("last"))
    live = (F.coalesce("last.state", F.lit("")) != "") & (F.col("last.ts") > F.lit(now) - F.expr(f"INTERVAL {int(seconds)} SECONDS"))
    return last.where(live).select("key", "last.state")


def expired(files: DataFrame, now, seconds: int) -> DataFrame:
    """Files (path, modificationTime) that are older than so many seconds at now."""
    return files.where(F.col("modificationTime") < F.lit(now) - F.expr(f"INTERVAL {int(seconds)} SECONDS"))
