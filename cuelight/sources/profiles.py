"""Stored statistics of the planner: latencies, selectivities, accuracies."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession

from cuelight.operators.metrics import upsert

NOT_ON_GPU = "NOT_GPU_OP"


def parse_profile(text: str) -> dict[str, float | str]:
    """A JSON object of numbers; a comma before the closing brace is tolerated."""
    return json.loads(re.sub(r",\s*}", "}", text))


def read_profile(spark: SparkSession, path: str) -> dict[str, float | str]:
    return parse_profile("\n".join(r.value for r in spark.read.text(path, wholetext=True).collect()))


def read_stats(spark: SparkSession, path: str, schema: str, key: str | None = None) -> DataFrame:
    """A statistics table stored as CSV, of one data set if ``key`` is given."""
    df = spark.read.schema(schema).csv(path, header=True)
    return df if key is None else df.filter(df["key"] == key)


def merge_stats(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """Fresh rows replace stored ones of the same key, parameters and operator or plan."""
    return upsert(stored, fresh, [c for c in ("key", "params", "op", "plan") if c in fresh.columns])
