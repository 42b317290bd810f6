"""Log counts over ranges, the same in batch and on streams; rows are (ts, service, line)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def select_lines(logs: DataFrame, service: str | None = None, pattern: str | None = None) -> DataFrame:
    """Label matchers are anchored, line filters aren't."""
    if service:
        logs = logs.filter(F.col("service").rlike(f"^(?:{service})$"))
    return logs.filter(F.col("line").rlike(pattern)) if pattern else logs


def count_over_time(logs: DataFrame, length: str, step: str | None = None, by: tuple[str, ...] = (), late: str = "10 minutes") -> DataFrame:
    """Rows per window and label, named by the window's end; windows slide by `step`. On a stream, rows later than
    `late` are left out."""
    if logs.isStreaming:
        logs = logs.withWatermark("ts", late)
    counted = logs.groupBy(F.window("ts", length, step) if step else F.window("ts", length), *by).agg(F.count("*").alias("n"))
    return counted.select(F.col("window.end").alias("at"), *by, "n")


def count_range(logs: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    return logs.groupBy(*by).agg(F.count("*").alias("n"))
