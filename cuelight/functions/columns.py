"""Column functions of boxes, class scores, names and subtitle times; all but the conversion of vectors stay in the JVM."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def centre_box(xmin: Column, ymin: Column, xmax: Column, ymax: Column) -> Column:
    """Corner box to centre and size: struct x, y, w, h."""
    return F.struct(((xmin + xmax) / 2).alias("x"), ((ymin + ymax) / 2).alias("y"), (xmax - xmin).alias("w"), (ymax - ymin).alias("h"))


def corner_box(x: Column, y: Column, w: Column, h: Column) -> Column:
    """Top-left corner and size to corners: struct xmin, ymin, xmax, ymax."""
    return F.struct(x.alias("xmin"), y.alias("ymin"), (x + w).alias("xmax"), (y + h).alias("ymax"))


def softmax(scores: Column) -> Column:
    odds = F.transform(scores, lambda s: F.exp(s - F.array_max(scores)))
    return F.transform(odds, lambda o: o / F.aggregate(odds, F.lit(0.0), lambda a, x: a + x))


def top_class(scores: Column) -> Column:
    """0-based position of the largest score (the first of equals)."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def subtitle_frame(time: Column, fps: int, compat: bool = False) -> Column:
    """Frame of an ``HH:MM:SS,mmm`` time; ``compat`` takes hours and minutes as if they were seconds."""
    part = lambda i: F.regexp_extract(time, r"(\d+):(\d+):(\d+),(\d+)", i).cast("long")
    hours, minutes = (1, 1) if compat else (3600, 60)
    return F.floor((part(1) * hours + part(2) * minutes + part(3) + part(4) / 1000) * fps)


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*?)(\.[^./]*)?$", 1)


def extension(path: Column) -> Column:
    return F.regexp_extract(path, r"\.([^./]*)$", 1)


def chunk_number(path: Column) -> Column:
    """The number that a chunk's file name ends in."""
    return F.regexp_extract(path, r"_(\d+)\.[^./]*$", 1).cast("int")


def vector_bytes(vector: Column) -> Column:
    """An array of numbers as the bytes of 32-bit floats, the least significant byte first."""

    @F.pandas_udf("binary")
    def pack(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for v in parts:
            yield pd.Series([None if x is None else np.asarray(x, "<f4").tobytes() for x in v], dtype=object)

    return pack(vector)


def bytes_vector(raw: Column) -> Column:
    """The inverse of :func:`vector_bytes`."""

    @F.pandas_udf("array<float>")
    def unpack(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for v in parts:
            yield pd.Series([None if x is None else np.frombuffer(x, "<f4") for x in v], dtype=object)

    return unpack(raw)
