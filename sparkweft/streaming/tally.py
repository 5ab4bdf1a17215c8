"""Tallies over a stream of events, with a watermark for late rows."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_tally(events: DataFrame, ts: str, kind: str, width: str, late: str) -> DataFrame:
    """Rows and sum of each kind and tumbling window; state older than ``late`` goes.

    A watermark needs an instant, so times without a zone are read in the session's.
    """
    rows = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late) if events.isStreaming else events
    out = rows.groupBy(F.window(ts, width).alias("w"), kind).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("window_start"), kind, "n", "total")
