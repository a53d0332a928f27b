"""Streaming extension: windowed means of events, and gap filling of each micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.temporal import fill_linear


def windowed_means(events: DataFrame, late: str = "1 hour", size: str = "1 day") -> DataFrame:
    """Mean value by user and tumbling window, closed by a watermark (ts is cast: a watermark needs a zone)."""
    e = events.select("user_id", F.col("ts").cast("timestamp").alias("ts"), "value").withWatermark("ts", late)
    return e.groupBy(F.window("ts", size), "user_id").agg(F.avg("value").alias("v")).select("user_id", F.col("window.start").alias("start"), "v")


def fill_batches(series: DataFrame, sink):
    """Starts a query that fills the gaps within each micro-batch of (user_id, dno, v) and hands the rows to ``sink``."""
    return series.writeStream.foreachBatch(lambda batch, i: sink(fill_linear(batch, ["user_id"], "dno", "v"), i))
