"""An extension; the dialect itself has no streams: windowed counts over a stream of events.

Late rows are taken until the watermark passes them; state is one row for each open window and key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, time: str, keys: list[str], window: str = "5 minutes", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Rows (window_start, window_end, keys.., n) of tumbling or sliding windows, for streams and tables alike."""
    stamp = F.col(time).cast("timestamp")
    marked = events.withColumn(time, stamp).withWatermark(time, late)
    w = F.window(time, window, slide) if slide else F.window(time, window)
    counted = marked.groupBy(w.alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, "n")
