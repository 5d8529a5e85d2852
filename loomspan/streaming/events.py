"""Windowed counts and a bounded ledger over event streams; both also take batch tables."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

EVENTS = T.StructType([
    T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampType()), T.StructField("user_id", T.LongType()),
    T.StructField("event_type", T.StringType()), T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType()),
])


def read_events(spark: SparkSession, path: str, files_per_trigger: int = 16) -> DataFrame:
    """Event files as they arrive."""
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def windowed_counts(events: DataFrame, width: str, late: str = "2 hours") -> DataFrame:
    """Counts and sums for each tumbling window and event type. On a stream, windows close once ``late`` has passed."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    out = rows.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str, late: str = "2 hours") -> DataFrame:
    """Sessions of each user: events with less than ``gap`` between them."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    out = rows.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return out.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def numbered_ledger(events: DataFrame, keep: int = 50) -> DataFrame:
    """A stream's events with a sequence number for each user, and how many of them the bounded ledger holds.

    State is two numbers a user: the last sequence number and the entries held, so that it stays small however long a
    ledger gets. Events of a user are numbered in order of time and id within each trigger.
    """

    def run(key: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        seq, held = state.get if state.exists else (0, 0)
        rows = pd.concat(list(parts)).sort_values(["ts", "event_id"])
        n = len(rows)
        yield pd.DataFrame({"user_id": key[0], "event_id": rows["event_id"].to_numpy(), "seq": range(seq + 1, seq + n + 1), "held": [min(keep, held + k + 1) for k in range(n)]})
        state.update((seq + n, min(keep, held + n)))

    from pyspark.sql.streaming.state import GroupStateTimeout

    out = "user_id long, event_id long, seq long, held long"
    return events.groupBy("user_id").applyInPandasWithState(run, out, "seq long, held long", "append", GroupStateTimeout.NoTimeout)


def silent_streak(steps: DataFrame, run: str, step: str, silent, patience: int) -> DataFrame:
    """The first step of each run at which ``silent`` has held for ``patience`` steps in a row; null if it never has."""
    from pyspark.sql import Window

    w = Window.partitionBy(run).orderBy(step)
    rows = steps.withColumn("__reset", F.sum((~silent).cast("int")).over(w))
    streak = F.sum(silent.cast("int")).over(Window.partitionBy(run, "__reset").orderBy(step))
    return rows.withColumn("__s", streak).groupBy(run).agg(F.min(F.when(F.col("__s") >= patience, F.col(step))).alias("stopped_at"))
