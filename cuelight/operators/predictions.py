"""Prediction columns: between structs of arrays, arrays of structs and flat detections."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuelight.schema import FRAME_COLUMNS


def explode_preds(df: DataFrame, column: str, keep: Sequence[str] = FRAME_COLUMNS) -> DataFrame:
    """One row per detection of a struct-of-arrays column; shorter arrays are padded with nulls, empty ones give no row."""
    fields = [f.name for f in df.schema[column].dataType.fields]
    zipped = F.arrays_zip(*[F.col(f"{column}.{f}").alias(f) for f in fields])
    present = [c for c in keep if c in df.columns]
    return df.select(*present, F.inline(zipped).alias(*fields))


def explode_structs(df: DataFrame, column: str, keep: Sequence[str] = FRAME_COLUMNS) -> DataFrame:
    """One row per element of an array-of-structs column."""
    fields = [f.name for f in df.schema[column].dataType.elementType.fields]
    present = [c for c in keep if c in df.columns]
    return df.select(*present, F.inline(column).alias(*fields))


def collect_preds(detections: DataFrame, keys: Sequence[str], fields: Sequence[str], order: str, out: str = "preds") -> DataFrame:
    """Struct of parallel arrays per frame, in the order of ``order``: the inverse of :func:`explode_preds`."""
    rows = F.sort_array(F.collect_list(F.struct(F.col(order).alias("_order"), *[F.col(f) for f in fields if f != order])))
    grouped = detections.groupBy(*keys).agg(rows.alias("_rows"))
    arrays = [F.col(f"_rows.{'_order' if f == order else f}").alias(f) for f in fields]
    return grouped.select(*keys, F.struct(*arrays).alias(out))


def add_field_to_struct(df: DataFrame, column: str, field: str, source: str) -> DataFrame:
    return df.withColumn(column, F.col(column).withField(field, F.col(source)))


def drop_confidence(df: DataFrame, by: float) -> DataFrame:
    return df.withColumn("score", F.col("score") - F.lit(by))


def dedup_frames(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """One row per frame, the one of smallest ``order``: a deterministic survivor by partial aggregation."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("_row"))
    return best.select(*keys, "_row.*").select(df.columns)


def collapse_frames(df: DataFrame, keys: Sequence[str], order: str, fields: Sequence[str]) -> DataFrame:
    """All detections of a frame as one sorted array, as a renderer of boxes reads them."""
    return df.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(order, *fields))).alias("boxes"))
