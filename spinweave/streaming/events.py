"""Structured Streaming over event tables: windowed counts with late data, and running moments as state.

These show how series that arrive over time are averaged.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def read_events(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def windowed(events: DataFrame, size: str = "1 day", late: str = "1 hour", slide: str | None = None) -> DataFrame:
    """(start, event_type, n, total): counts and sums by tumbling or sliding windows; rows later than the watermark are dropped."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    return events.withWatermark("ts", late).groupBy(w, "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(user_id, start, end, n) of runs of a user's events without a gap."""
    s = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return s.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def running_moments(events: DataFrame) -> DataFrame:
    """(event_type, n, mean, variance) after each batch; the state merges a batch's moments into those so far."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        n, mean, m2 = state.get if state.exists else (0, 0.0, 0.0)
        for b in batches:
            v = b["value"].dropna()
            if len(v):
                k, m = len(v), float(v.mean())
                d = m - mean
                m2 += float(((v - m) ** 2).sum()) + d * d * n * k / (n + k)
                mean += d * k / (n + k)
                n += k
        state.update((n, mean, m2))
        yield pd.DataFrame({"event_type": [key[0]], "n": [n], "mean": [mean], "variance": [m2 / n if n else None]})

    return events.groupBy("event_type").applyInPandasWithState(step, "event_type string, n long, mean double, variance double", "n long, mean double, m2 double", "update", "NoTimeout")
