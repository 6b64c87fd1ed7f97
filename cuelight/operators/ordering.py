"""Positions and running totals in a total order without a window over one partition.

Rows are cut into buckets by the first order key; a row's total is the one in its bucket plus those of the buckets
before. Of the buckets one small row each is ordered, in turn cut into at most LEVELS ranges of equal width, so that
many buckets don't meet in one task either. Rows whose bucket is null come first.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges that bucket numbers are cut into before they are ordered.
LEVELS = 1024


def running_total(df: DataFrame, value: Column, bucket: Column, order: Sequence[str], out: str, keys: Sequence[str] = ()) -> DataFrame:
    """``df`` with the sum of ``value`` over the rows up to each one by (bucket, order), separately by ``keys``.

    ``bucket`` is a number that does not decrease along the wanted order; rows that tie on (bucket, order) are ordered
    anyhow.
    """
    df = df.withColumns({"_ord_bucket": bucket, "_ord_value": value})
    group = [*keys, "_ord_bucket"]
    sizes = df.groupBy(*group).agg(F.sum("_ord_value").alias("_ord_n"))
    ends = sizes.agg(F.min("_ord_bucket").alias("_ord_low"), F.max("_ord_bucket").alias("_ord_high"))  # one row of two numbers
    span = F.greatest((F.col("_ord_high") - F.col("_ord_low")).cast("double"), F.lit(1.0))
    level = F.least(F.floor((F.col("_ord_bucket") - F.col("_ord_low")).cast("double") * LEVELS / span), F.lit(LEVELS - 1))
    sizes = sizes.join(F.broadcast(ends)).withColumn("_ord_level", F.when(F.col("_ord_bucket").isNull(), -1).otherwise(level).cast("int"))
    levels = sizes.groupBy(*keys, "_ord_level").agg(F.sum("_ord_n").alias("_ord_m"))
    earlier = lambda by, at: Window.partitionBy(*by).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    if keys:
        levels = levels.withColumn("_ord_below", F.coalesce(F.sum("_ord_m").over(earlier(keys, "_ord_level")), F.lit(0)))
    else:  # at most LEVELS + 1 rows
        levels = levels.withColumn("_ord_below", F.coalesce(F.sum("_ord_m").over(Window.orderBy("_ord_level").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    levels = levels.drop("_ord_m").toDF(*[f"_ord_l{i}" for i in range(len(keys))], "_ord_level", "_ord_below")
    sizes = sizes.withColumn("_ord_inside", F.coalesce(F.sum("_ord_n").over(earlier([*keys, "_ord_level"], F.col("_ord_bucket").asc_nulls_first())), F.lit(0)))
    match = sizes["_ord_level"] == levels["_ord_level"]
    for i, k in enumerate(keys):
        match = match & sizes[k].eqNullSafe(levels[f"_ord_l{i}"])
    placed = sizes.join(levels, match).select(*[sizes[k].alias(f"_ord_k{i}") for i, k in enumerate(keys)], sizes["_ord_bucket"].alias("_ord_b"), (F.col("_ord_below") + F.col("_ord_inside")).alias("_ord_before"))
    within = F.sum("_ord_value").over(Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = df.withColumn("_ord_within", within)
    here = rows["_ord_bucket"].eqNullSafe(placed["_ord_b"])
    for i, k in enumerate(keys):
        here = here & rows[k].eqNullSafe(placed[f"_ord_k{i}"])
    helpers = ["_ord_bucket", "_ord_value", "_ord_within", "_ord_before", "_ord_b", *[f"_ord_k{i}" for i in range(len(keys))]]
    return rows.join(placed, here).withColumn(out, F.col("_ord_before") + F.col("_ord_within")).drop(*helpers)


def global_position(df: DataFrame, bucket: Column, order: Sequence[str], out: str = "pos", keys: Sequence[str] = ()) -> DataFrame:
    """``df`` with its 1-based position by (bucket, order), separately by ``keys``."""
    return running_total(df, F.lit(1).cast("long"), bucket, order, out, keys)


def with_earlier(df: DataFrame, position: str, back: int, columns: dict[str, str]) -> DataFrame:
    """``df`` with values of the row ``back`` positions before (null at the start): new name -> column."""
    earlier = df.select((F.col(position) + back).alias(position), *[F.col(c).alias(n) for n, c in columns.items()])
    return df.join(earlier, position, "left")
