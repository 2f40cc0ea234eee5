"""An extension: the scale summary over a stream of answers, by event-time windows with a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_scale_summary(events: DataFrame, ts: str = "ts", key: str = "event_type", value: str = "value", window: str = "1 day", late: str = "1 day") -> DataFrame:
    """Per window and question: answers, mean and high answers; rows later than the watermark are dropped."""
    return (
        events.withWatermark(ts, late)
        .groupBy(F.window(ts, window).alias("w"), key)
        .agg(F.count("*").alias("n"), F.round(F.avg(value), 2).alias("mean"), F.count_if(F.col(value) >= 100).alias("n_high"))
        .select(F.col("w.start").alias("window_start"), key, "n", "mean", "n_high")
    )
