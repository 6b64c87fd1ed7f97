"""Detections as a stream: windowed counts per label with late data bounded by a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_stream(spark: SparkSession, folder: str, schema: T.StructType, pattern: str = "*.parquet") -> DataFrame:
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(folder)


def windowed_counts(detections: DataFrame, time: str = "ts", late: str = "10 minutes", width: str = "5 minutes", slide: str | None = None) -> DataFrame:
    """Detections and mean score per window and label; works on streams and on tables."""
    w = F.window(time, width, slide or width)
    marked = detections.withWatermark(time, late) if detections.isStreaming else detections
    grouped = marked.groupBy(w, "label").agg(F.count("*").alias("n"), F.avg("score").alias("mean_score"))
    return grouped.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "label", "n", "mean_score")
