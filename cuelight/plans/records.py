"""What a run leaves behind: timings, costs of all plans, one row per run."""

from __future__ import annotations

import json
import time
from collections.abc import Iterable, Mapping
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from cuelight.plans.cost import Stats, plan_cost, price
from cuelight.plans.planner import Plan


@contextmanager
def timed(into: dict[str, float], name: str):
    """Adds the block's seconds to ``into[name]``."""
    start = time.perf_counter()
    try:
        yield
    finally:
        into[name] = into.get(name, 0.0) + time.perf_counter() - start


def costs_as_json(plans: Iterable[Plan], stats: Stats, frames: int, platforms: Iterable[str] = ("cpu",)) -> str:
    """Every plan with its cost and price on each platform."""
    out = []
    for p in plans:
        for on in platforms:
            cost = plan_cost(p, stats, frames, on)
            out.append({"plan": p.key, "platform": on, "cost": round(cost, 6), "price": round(price(cost, on), 9)})
    return json.dumps(out, indent=1)


def run_record(spark: SparkSession, timings: Mapping[str, float], options: Mapping[str, object]) -> DataFrame:
    """One row with the options and the seconds of each part."""
    row = {**{k: str(v) for k, v in options.items()}, **{f"{k}_s": float(v) for k, v in timings.items()}}
    schema = ", ".join(f"`{k}` {'double' if isinstance(v, float) else 'string'}" for k, v in row.items())
    return spark.createDataFrame([tuple(row.values())], schema)


def append_run(spark: SparkSession, timings: Mapping[str, float], options: Mapping[str, object], folder: str) -> None:
    """Add the run's row to a folder of CSV files with a header each."""
    run_record(spark, timings, options).coalesce(1).write.mode("append").option("header", True).csv(folder)
