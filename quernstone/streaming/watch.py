"""Folders and events as streams."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupStateTimeout

from quernstone.operators.dedup import changed_files, content_hash

TEXT_SCHEMA = "value string"


def watch_texts(spark: SparkSession, folder: str, pattern: str = "*.txt", files_per_batch: int = 10) -> DataFrame:
    """A stream of path, modified, text: one row for each new file, so many a batch. Files
    should appear complete, by renaming them into place."""
    reader = spark.readStream.format("text").option("wholetext", True).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_per_batch)
    return reader.load(folder).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_modification_time").alias("modified"), F.col("value").alias("text"))


def watched(path: Column, patterns: list[str], ignored: list[str]) -> Column:
    """Does a path count? Ignored patterns (*.ext, prefix*, or a whole name) come first."""
    name = F.regexp_extract(path, r"([^/\\]+)$", 1)

    def like(pattern: str) -> Column:
        if pattern.startswith("*"):
            return F.endswith(name, F.lit(pattern[1:]))
        return F.startswith(name, F.lit(pattern[:-1])) if pattern.endswith("*") else name == pattern

    some = lambda every: F.lit(False) if not every else like(every[0]) | some(every[1:])
    return ~some(ignored) & (some(patterns) if patterns else F.lit(True))


def run_available(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Process all that is there in batches, then stop: the loop of a folder is this query,
    scheduled again. A batch that fails is done anew from the checkpoint."""
    return stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def folder_changes(now: DataFrame, before: DataFrame) -> DataFrame:
    """path, change (created, modified, deleted) from two listings with path and
    content_hash, for one folder at a time."""
    return changed_files(now, before, "path")


def first_seen(stream: DataFrame, text_col: str = "text", time_col: str | None = None, delay: str = "1 day") -> DataFrame:
    """The stream without texts seen before. With a time column the state forgets what is
    older than the delay; without one it keeps every hash."""
    hashed = stream.withColumn("content_hash", content_hash(F.col(text_col)))
    if time_col is None:
        return hashed.dropDuplicates(["content_hash"])
    return hashed.withWatermark(time_col, delay).dropDuplicatesWithinWatermark(["content_hash"])


def event_rates(events: DataFrame, time_col: str = "ts", window: str = "1 hour", delay: str = "10 minutes", key: str = "event_type") -> DataFrame:
    """start, key, n, total of each window, late events within the delay included."""
    windows = events.withWatermark(time_col, delay).groupBy(F.window(time_col, window).alias("w"), key).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return windows.select(F.col("w.start").alias("start"), key, "n", "total")


def request_rates(events: DataFrame, time_col: str = "ts", window: str = "60 seconds", slide: str = "10 seconds", delay: str = "1 minute") -> DataFrame:
    """start, n of sliding windows, against which a rate limit is set."""
    windows = events.withWatermark(time_col, delay).groupBy(F.window(time_col, window, slide).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return windows.select(F.col("w.start").alias("start"), "n")


def drift_windows(scores: DataFrame, time_col: str = "ts", score_col: str = "value", span: str = "24 hours", delay: str = "1 hour") -> DataFrame:
    """start, n, mean of each day of scores."""
    windows = scores.withWatermark(time_col, delay).groupBy(F.window(time_col, span).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.avg(score_col).alias("mean"))
    return windows.select(F.col("w.start").alias("start"), "n", "mean")


def budget_watch(spent: DataFrame, daily_limit: float, thresholds: tuple[float, ...] = (0.5, 0.8, 0.9), time_col: str = "ts", cost_col: str = "cost") -> DataFrame:
    """date, threshold, spent: one row when a day's running cost first reaches each level,
    kept in state by day."""
    def step(key, frames, state):
        total, told = state.get if state.exists else (0.0, 0)
        rows = []
        for frame in frames:
            for cost in frame[cost_col]:
                total += float(cost)
                while told < len(thresholds) and total >= thresholds[told] * daily_limit:
                    rows.append((key[0], thresholds[told], total))
                    told += 1
        state.update((total, told))
        yield pd.DataFrame(rows, columns=["date", "threshold", "spent"])

    daily = spent.withColumn("date", F.date_format(time_col, "yyyy-MM-dd")).select("date", cost_col)
    return daily.groupBy("date").applyInPandasWithState(step, "date string, threshold double, spent double", "total double, told int", "append", GroupStateTimeout.NoTimeout)
