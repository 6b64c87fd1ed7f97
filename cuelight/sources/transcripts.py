"""Subtitle files as one row for each frame that a caption covers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuelight.functions.columns import subtitle_frame

TIMES = r"(\d+:\d+:\d+,\d+)\s*-->\s*(\d+:\d+:\d+,\d+)"


def read_srt(spark: SparkSession, path: str, fps: int, compat: bool = False) -> DataFrame:
    """(uri, frame_id, segment) of all ``.srt`` files below ``path``; text is lower-cased and trimmed."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.srt").option("recursiveFileLookup", True).load(path)
    return parse_srt(files.select(F.col("path").alias("uri"), F.decode("content", "UTF-8").alias("text")), fps, compat)


def parse_srt(files: DataFrame, fps: int, compat: bool = False) -> DataFrame:
    """Captions of (uri, text) rows; the frames of a caption are those from its start to its end, both included."""
    text = F.regexp_replace(F.regexp_replace("text", "\r", ""), "^﻿", "")
    blocks = files.select("uri", F.explode(F.split(text, r"\n[ \t]*\n")).alias("block"))
    caption = F.lower(F.trim(F.regexp_replace(F.regexp_extract("block", r"(?s)-->[^\n]*\n(.*)$", 1), r"\s*\n\s*", " ")))
    found = blocks.filter(F.col("block").rlike(TIMES)).select("uri", F.regexp_extract("block", TIMES, 1).alias("start"), F.regexp_extract("block", TIMES, 2).alias("end"), caption.alias("segment"))
    first, last = subtitle_frame(F.col("start"), fps), subtitle_frame(F.col("end"), fps, compat)
    return found.filter(last >= first).select("uri", F.explode(F.sequence(first, last)).alias("frame_id"), "segment")
