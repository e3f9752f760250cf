"""The library's grouped summaries over a stream: the same columns, kept up to date behind a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_summary(events: DataFrame, at: str, by: list[str], value: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """n, mean and sample deviation of a value for each time window and group; rows later than `late` are left out, and
    state is dropped once the watermark has passed a window. The frame may be a stream or a table."""
    events = events.withColumn(at, events[at].cast("timestamp"))
    grouped = events.withWatermark(at, late).groupBy(F.window(at, width), *by)
    return grouped.agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std")).select(F.col("window.start").alias("start"), *by, "n", "mean", "std")
