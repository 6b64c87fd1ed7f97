"""Bounded, deterministic samples of labelled and unlabelled rows for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Denominator of the hash share.
_SPAN = 1 << 30


def crc_remainder(key: Column, by: int) -> Column:
    """crc32 of the key as text, modulo ``by``."""
    return F.crc32(key.cast("string")) % by


def share(key: Column, salt: str) -> Column:
    """A number in [0, 1) that is fixed by the key and the salt."""
    return F.pmod(F.xxhash64(key, F.lit(salt)), F.lit(_SPAN)) / F.lit(float(_SPAN))


def bounded(rows: DataFrame, key: str, at_most: int, salt: str) -> DataFrame:
    """About ``at_most`` of ``rows`` (all, if there are no more), chosen by the hash of their key alone."""
    n = rows.count()
    return rows if n <= at_most else rows.filter(share(F.col(key), salt) < at_most / n)
