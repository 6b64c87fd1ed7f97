"""Sources and sinks of videos and frames."""

from __future__ import annotations

import shutil
import subprocess

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cuelight.schema import FRAME, VIDEO


def video_catalog(spark: SparkSession, path: str, glob: str = "*.mp4") -> DataFrame:
    """(uri, id) of all files below ``path`` on any file system Spark reads; ids follow folders, then names."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)
    return numbered(files.select(F.col("path").alias("uri")))


def numbered(files: DataFrame) -> DataFrame:
    """``files`` (uri) with ids from 0, folder by folder and within a folder by name.

    A file's rank in its folder and the files of the folders before give its number, so that only one small row for
    each folder is put in a global order.
    """
    folder = F.regexp_extract("uri", r"^(.*/)[^/]*$", 1)
    rows = files.withColumn("_folder", folder)
    sizes = rows.groupBy("_folder").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_folder").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select("_folder", before.alias("_before"))
    within = F.row_number().over(Window.partitionBy("_folder").orderBy("uri"))
    return rows.withColumn("_at", within).join(sizes, "_folder").select("uri", (F.col("_before") + F.col("_at") - 1).cast("int").alias("id"))


def single_video(spark: SparkSession, path: str) -> DataFrame:
    """The catalogue of one file."""
    return spark.createDataFrame([(path, 0)], VIDEO)


def segment_command(source: str, seconds: int, pattern: str) -> list[str]:
    """ffmpeg arguments that cut a video into pieces without re-encoding; any length in seconds."""
    time = f"{seconds // 3600:02d}:{seconds // 60 % 60:02d}:{seconds % 60:02d}"
    return ["ffmpeg", "-y", "-i", source, "-c", "copy", "-f", "segment", "-reset_timestamps", "1", "-segment_time", time, pattern]


def encode_command(source: str, width: int, height: int, fps: int, target: str) -> list[str]:
    return ["ffmpeg", "-y", "-i", source, "-vf", f"scale={width}:{height}", "-r", str(fps), "-c:v", "libx264", target]


def run_ffmpeg(command: list[str]) -> None:
    """Run ffmpeg on a worker; it is an optional program and its absence is an error with a clear message."""
    if shutil.which(command[0]) is None:
        raise RuntimeError("ffmpeg is not installed on this worker")
    done = subprocess.run(command, capture_output=True, text=True)
    if done.returncode:
        raise RuntimeError(done.stderr[-2000:])


def synthetic_frames(spark: SparkSession, count: int, width: int = 36, height: int = 24, videos: int = 1, seed: int = 1) -> DataFrame:
    """Frames whose bytes depend on their number alone: a brightness ramp with blocks that move."""

    def make(parts):
        for p in parts:
            out = []
            for n in p["id"]:
                rng = np.random.default_rng([seed, int(n) % 7])
                image = np.full((height, width, 3), (int(n) * 37) % 256, np.uint8)
                for _ in range(4):
                    y, x = rng.integers(0, height - 3), rng.integers(0, width - 3)
                    image[y : y + 3, x : x + 3] = rng.integers(0, 256, 3)
                out.append((f"video{int(n) % videos}", int(n), width, height, image.tobytes()))
            yield pd.DataFrame(out, columns=FRAME.names)

    return spark.range(count).mapInPandas(make, FRAME)


def save_predictions(df: DataFrame, folder: str, op: str, clip: str) -> str:
    """Store an operator's predictions over a reference clip; returns the path."""
    path = f"{folder.rstrip('/')}/{op}_{clip}.parquet"
    df.write.mode("overwrite").parquet(path)
    return path


def result_rows(df: DataFrame) -> DataFrame:
    """The columns and order in which results are shown."""
    return df.select("uri", "id", "label", "score").orderBy("id") if "uri" in df.columns else df.select("id", "label", "score").orderBy("id")
