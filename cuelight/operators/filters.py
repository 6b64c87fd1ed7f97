"""Named detection filters. All are lazy; those that look across frames say so in CROSS_FRAME."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuelight.operators.movement import find_directions, left_turns, movement, remove_stationary
from cuelight.operators.ordering import global_position


def quality_filter(df: DataFrame, score: float = 0.6) -> DataFrame:
    return df.filter(F.col("score") > score)


def object_filter(df: DataFrame, label: str) -> DataFrame:
    return df.filter(F.col("label") == label)


def objects_or(df: DataFrame, labels: Sequence[str]) -> DataFrame:
    return df.filter(F.col("label").isin(*labels))


def age_old_filter(df: DataFrame, above: int = 19) -> DataFrame:
    return df.filter(F.col("cls") > above)


def similarity_filter(df: DataFrame, below: float, column: str = "similarity") -> DataFrame:
    """Similarities are distances: lower is closer."""
    return df.filter(F.col(column) < below)


def transcript_search(df: DataFrame, keyword: str, column: str = "segment") -> DataFrame:
    return df.filter(F.col(column).contains(keyword))


def proxy_split(df: DataFrame, confidence: float) -> tuple[DataFrame, DataFrame]:
    """(rows that need the general model, rows the proxy may answer); a null score needs the general model."""
    sure = F.coalesce(F.col("score") >= confidence, F.lit(False))
    return df.filter(~sure), df.filter(sure)


def two_people(df: DataFrame, count: int = 2, keys: Sequence[str] = ("id",)) -> DataFrame:
    """Detections of frames with exactly ``count`` detections: one window over the frame's few rows."""
    n = F.count("id").over(Window.partitionBy(*keys))
    return df.withColumn("_n", n).filter(F.col("_n") == count).drop("_n")


def faces_and(df: DataFrame, labels: Sequence[str], keys: Sequence[str] = ("id",)) -> DataFrame:
    """Detections of frames that show all of ``labels``."""
    frame = Window.partitionBy(*keys)
    every = F.lit(True)
    for want in labels:
        every = every & (F.max(F.when(F.ltrim("label") == want, 1).otherwise(0)).over(frame) == 1)
    return df.withColumn("_all", every).filter("_all").drop("_all")


def window_expand(df: DataFrame, inside: Column, around: int = 30) -> DataFrame:
    """Detections of frames from ``around`` before the first to ``around`` after the last row where ``inside`` holds."""
    bounds = df.filter(inside).agg((F.min("id") - around).alias("_from"), (F.max("id") + around).alias("_to"))
    # One row of two numbers, whatever the input.
    return df.join(F.broadcast(bounds), F.col("id").between(F.col("_from"), F.col("_to"))).drop("_from", "_to")


def fixed_rate_sample(df: DataFrame, every: int, order: str, bucket: Column | None = None) -> DataFrame:
    """Every ``every``-th row by ``order`` (a number)."""
    cut = F.floor(F.col(order) / 65536) if bucket is None else bucket
    return global_position(df, cut, [order], "_pos").filter(F.col("_pos") % every == 0).drop("_pos")


def drop_frames(df: DataFrame, fraction: float, order: str, random: bool = False, seed: int = 1234) -> DataFrame:
    """Keep 1 - ``fraction`` of the rows: a seeded sample, or every int(1 / (1 - fraction))-th row."""
    return df.sample(False, 1 - fraction, seed) if random else fixed_rate_sample(df, int(1 / (1 - fraction)), order)


#: Filters by the names that queries use; the marked ones depend on more than one frame and may not be reordered.
FILTERS: dict[str, Callable[..., DataFrame]] = {"quality_filter": quality_filter, "object_filter": object_filter, "objects_or": objects_or, "age_old_filter": age_old_filter, "similarity_filter": similarity_filter, "transcript_search": transcript_search, "two_people": two_people, "faces_and": faces_and, "window_expand": window_expand, "drop_frames": drop_frames, "movement": movement, "remove_stationary": remove_stationary, "find_directions": find_directions, "left_turns": left_turns}
CROSS_FRAME = frozenset({"window_expand", "drop_frames", "movement"})
