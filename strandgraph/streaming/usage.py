"""Usage as a stream: invocations by command in windows of time, and sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windows(log: DataFrame, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, cmd, runs, failed, ms): invocations in windows; a row stands once no more of its window are awaited."""
    per = log.withWatermark("ts", late).groupBy(F.window("ts", size), "cmd").agg(F.count(F.lit(1)).alias("runs"), F.count_if(F.col("exit") != 0).alias("failed"), F.sum("ms").alias("ms"))
    return per.select(F.col("window.start").alias("start"), "cmd", "runs", "failed", "ms")


def sessions(log: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """(caller, start, end, runs): runs of one caller with less than `gap` between them."""
    per = log.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "caller").agg(F.count(F.lit(1)).alias("runs"))
    return per.select("caller", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "runs")
