"""Movement of detections along their tracks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuelight.operators.ordering import global_position, with_earlier


def centroids(df: DataFrame) -> DataFrame:
    return df.withColumns({"xcent": (F.col("xmin") + F.col("xmax")) / 2, "ycent": (F.col("ymin") + F.col("ymax")) / 2})


def movement(df: DataFrame, back: int = 10, per_track: bool = True, order: tuple[str, ...] = ("id", "det_id")) -> DataFrame:
    """dx, dy against the detection ``back`` rows before (0 where there is none), by track or along (track, order).

    Tracks of different videos (column uri, if there is one) are different tracks.
    """
    df = centroids(df)
    if per_track:
        w = Window.partitionBy(*[c for c in ("uri", "track") if c in df.columns]).orderBy(*order)
        earlier = {c: F.lag(c, back, 0.0).over(w) for c in ("xcent", "ycent")}
        return df.withColumns({"dx": F.col("xcent") - earlier["xcent"], "dy": F.col("ycent") - earlier["ycent"]})
    placed = with_earlier(global_position(df, F.col("track"), list(order), "_pos"), "_pos", back, {"_x": "xcent", "_y": "ycent"})
    return placed.withColumns({"dx": F.col("xcent") - F.coalesce("_x", F.lit(0.0)), "dy": F.col("ycent") - F.coalesce("_y", F.lit(0.0))}).drop("_pos", "_x", "_y")


def remove_stationary(df: DataFrame, least: float = 1.0) -> DataFrame:
    return df.filter((F.abs("dx") > least) & (F.abs("dy") > least))


def find_directions(df: DataFrame, least: float = 20.0) -> DataFrame:
    def side(c: str, far: str, near: str) -> Column:
        return F.when(F.col(c) > least, far).otherwise(near)

    return df.withColumns({"xdir": side("dx", "right", "left"), "ydir": side("dy", "up", "down")})


def left_turns(df: DataFrame) -> DataFrame:
    return df.filter((F.col("xdir") == "left") & (F.col("ydir") == "up"))
