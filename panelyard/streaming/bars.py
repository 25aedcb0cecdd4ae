"""Bars from a stream of ticks, for late data up to a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_bars(ticks: DataFrame, width: str = "1 day", late: str = "10 minutes") -> DataFrame:
    """start, code, OHLC, volume, amount, bars of each window and code; a window is emitted once the watermark passes it.

    ``ticks``: datetime, seq, code, open, high, low, close, vol, amount. Works on a batch frame too.
    """
    at = F.struct("datetime", "seq")
    timed = ticks.withColumn("datetime", F.col("datetime").cast("timestamp")).withWatermark("datetime", late)
    days = timed.groupBy(F.window("datetime", width).alias("w"), "code").agg(
        F.min_by("open", at).alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", at).alias("close"),
        F.sum("vol").alias("volume"), F.sum("amount").alias("amount"), F.count(F.lit(1)).alias("bars"),
    )
    return days.select(F.col("w.start").alias("start"), "code", "open", "high", "low", "close", "volume", "amount", "bars")
