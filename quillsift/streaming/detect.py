"""Detection on streams. Scoring has no state; the windowed roll-up is an extension of this package."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from quillsift.operators.detector import Detector


def analyze_stream(stream: DataFrame, text: str = "text", detector: Detector | None = None) -> DataFrame:
    """The stream with the result columns; runs in append mode."""
    return (detector or Detector()).analyze(stream, text)


def flagged_by_window(analyzed: DataFrame, time: str, width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """(window, texts, flagged, mean_score) of event-time windows; rows later than ``late`` are dropped by the watermark."""
    by = analyzed.withWatermark(time, late).groupBy(F.window(time, width).alias("window"))
    return by.agg(F.count("*").alias("texts"), F.count_if("flagged").alias("flagged"), F.avg("score").alias("mean_score"))


def write_stream(df: DataFrame, path: str, checkpoint: str, **options) -> StreamingQuery:
    """Appends the stream to Parquet files, exactly once."""
    return df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).options(**options).outputMode("append").trigger(availableNow=True).start()
