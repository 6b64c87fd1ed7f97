"""Selectivity, multiset accuracy, sampling keys and regressions over result relations."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def selectivities(df: DataFrame, predicates: Mapping[str, Column], key: str = "id") -> DataFrame:
    """(op, selectivity): distinct frames that pass each predicate over all distinct frames, in one aggregation."""
    per_frame = df.groupBy(key).agg(*[F.max(F.when(p, 1).otherwise(0)).alias(n) for n, p in predicates.items()])
    total = per_frame.agg(*[F.round(F.sum(n) / F.count("*"), 6).alias(n) for n in predicates])
    names = list(predicates)
    return total.select(F.inline(F.array(*[F.struct(F.lit(n).alias("op"), F.col(n).alias("selectivity")) for n in names])))


def multiset_counts(ref: DataFrame, test: DataFrame, key: str = "id") -> DataFrame:
    """tp, fp, fn of two multisets of frame ids."""
    a, b = ref.groupBy(key).agg(F.count("*").alias("a")), test.groupBy(key).agg(F.count("*").alias("b"))
    both = a.join(b, key, "full").select(F.coalesce("a", F.lit(0)).alias("a"), F.coalesce("b", F.lit(0)).alias("b"))
    return both.agg(F.sum(F.least("a", "b")).alias("tp"), F.sum(F.greatest(F.col("b") - F.col("a"), F.lit(0))).alias("fp"), F.sum(F.greatest(F.col("a") - F.col("b"), F.lit(0))).alias("fn"))


def f1_of(counts: DataFrame) -> DataFrame:
    """precision, recall and f1 next to tp, fp, fn; 0 where undefined."""
    tp, fp, fn = (F.col(c).cast("double") for c in ("tp", "fp", "fn"))
    out = counts.withColumns({"precision": F.when(tp + fp > 0, tp / (tp + fp)).otherwise(0.0), "recall": F.when(tp + fn > 0, tp / (tp + fn)).otherwise(0.0)})
    p, r = F.col("precision"), F.col("recall")
    return out.withColumn("f1", F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0))


def dataset_key(df: DataFrame, column: str, bits: int = 224) -> DataFrame:
    """Digest of the distinct values in two levels, so that no task holds them all.

    Values are hashed and put into groups by the first four hexadecimal digits; a group's digest is that of its sorted
    hashes joined by '&', and the key is the digest of the groups' digests in order, joined likewise.
    """
    hashes = df.select(F.sha2(F.col(column).cast("string"), bits).alias("_h")).filter("_h is not null").distinct()
    joined = lambda c: F.sha2(F.array_join(F.array_sort(F.collect_list(c)), "&"), bits)
    groups = hashes.groupBy(F.substring("_h", 1, 4).alias("_g")).agg(joined("_h").alias("_d"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("_g", "_d"))), lambda x: x["_d"])
    return groups.agg(F.sha2(F.array_join(ordered, "&"), bits).alias("key"))  # at most 65,536 digests


def names_key(df: DataFrame, column: str, bits: int = 224) -> DataFrame:
    """Digest of the sorted distinct values themselves, joined by '&': the key of a list of files.

    Values are sorted in range partitions and digested in one pass that holds a batch at a time.
    """
    import hashlib

    import pyarrow as pa

    def digest(parts):
        h, first = hashlib.new(f"sha{bits}"), True
        for b in parts:
            for v in b.column(0).to_pylist():
                h.update(("" if first else "&").encode() + v.encode())
                first = False
        yield pa.RecordBatch.from_pydict({"key": [h.hexdigest()]})

    values = df.select(F.col(column).cast("string").alias("_v")).filter("_v is not null").distinct()
    found = values.orderBy("_v").coalesce(1).mapInArrow(digest, "key string")
    return found.agg(F.coalesce(F.first("key"), F.lit(hashlib.new(f"sha{bits}").hexdigest())).alias("key"))


def params_key(params: Mapping[str, object], bits: int = 224) -> str:
    """Digest of ``name:value`` in the order of the names, joined by '_'."""
    import hashlib

    return hashlib.new(f"sha{bits}", "_".join(f"{k}:{params[k]}" for k in sorted(params)).encode()).hexdigest()


def upsert(stored: DataFrame, fresh: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``fresh``, and those of ``stored`` that it does not replace."""
    return fresh.unionByName(stored.join(fresh.select(keys), keys, "left_anti"))


def linear_fit(df: DataFrame, x: str, y: str) -> DataFrame:
    return df.agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"))
