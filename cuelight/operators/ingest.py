"""From chunks of video to frame numbers: offsets, windows and frames, all as relations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuelight.operators.ordering import running_total


def chunk_offsets(chunks: DataFrame, by_video: bool = False) -> DataFrame:
    """start_chunk and end_chunk (global frame numbers) of chunks (chunk, chunk_frames[, uri]), and the last frame number."""
    keys = ["uri"] if by_video else []
    out = running_total(chunks, F.col("chunk_frames").cast("long"), F.floor(F.col("chunk") / 4096), ["chunk"], "_sum", keys)
    out = out.withColumns({"start_chunk": F.col("_sum") - F.col("chunk_frames"), "end_chunk": F.col("_sum") - 1}).drop("_sum")
    last = out.groupBy(*keys).agg(F.max("end_chunk").alias("total_frames"))
    return out.join(last, keys) if keys else out.join(F.broadcast(last))  # one row


def decode_window(chunks: DataFrame, start: float, end: float) -> DataFrame:
    """Frame numbers of the part [start, end] of the video, by chunk; chunks outside of it give no rows."""
    low, high = F.floor(F.col("total_frames") * F.lit(start)), F.floor(F.col("total_frames") * F.lit(end))
    inside = chunks.filter((F.col("end_chunk") >= low) & (F.col("start_chunk") <= high))
    return inside.withColumn("id", F.explode(F.sequence(F.greatest("start_chunk", low), F.least("end_chunk", high))))


def subsample(frames: DataFrame, keep_every: int) -> DataFrame:
    return frames.filter(F.col("id") % keep_every == 0)


def inline_frames(decoded: DataFrame, column: str = "frames") -> DataFrame:
    """Flat frames of an array-of-structs column, without those that could not be decoded."""
    return decoded.select("uri", F.inline(column)).filter(F.col("id").isNotNull())
