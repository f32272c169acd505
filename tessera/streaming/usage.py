"""The usage roll-up as a stream: late rows within the watermark are still counted."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usage_stream(events: DataFrame, at: str = "ts", by: str = "user_id", late: str = "1 day", window: str = "1 day") -> DataFrame:
    """Requests by scope and window of event time; works on streams and on tables alike."""
    rows = events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)
    return rows.groupBy(F.window(at, window).alias("w"), by).agg(F.count(F.lit(1)).alias("requests")).select(by, F.col("w.start").alias("start"), "requests")
