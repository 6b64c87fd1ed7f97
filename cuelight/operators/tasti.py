"""Approximate answers from an index of embedding clusters: each vector takes the labels of its nearest centroid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of an index up to which it is copied to all executors; beyond, centroids of a tile and copies of each tile.
BROADCAST_BYTES, TILE, SALTS = 64 << 20, 4096, 16


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def mean_centroids(vectors: DataFrame, label: str = "label", embedding: str = "embedding") -> DataFrame:
    """(label, centroid): the mean vector of each label, summed by dimension before the shuffle."""
    flat = vectors.select(label, F.posexplode(F.col(embedding).cast("array<double>")).alias("dim", "x"))
    means = flat.groupBy(label, "dim").agg(F.avg("x").alias("x"))
    ordered = means.groupBy(label).agg(F.sort_array(F.collect_list(F.struct("dim", "x"))).alias("_d"))
    return ordered.select(label, F.col("_d.x").alias("centroid"))


def assign(vectors: DataFrame, centroids: DataFrame, key: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """(key, centroid_label, score): the most cosine-similar centroid; ties go to the smaller label.

    The index is counted first. Up to BROADCAST_BYTES it is copied to each executor as one row; beyond that it is cut
    into tiles of TILE centroids, each vector meets every tile by a shuffled join whose keys are salted, and the best
    centroid of a row is a maximum over its tiles. A vector without a comparable centroid has null label and score.
    """
    index = centroids.select(F.col(label).alias("_l"), F.col("centroid").cast("array<double>").alias("_c")).filter("_l is not null and _c is not null")
    sizes = index.agg(F.count("*").alias("n"), F.sum(F.size("_c")).alias("dims")).first()
    x = F.col(embedding).cast("array<double>")
    scored = F.transform("_all", lambda c: F.struct(F.round(cosine(F.col("_x"), c["c"]), 12).alias("s"), (-c["l"]).alias("n")))
    best = F.array_max(F.filter(scored, lambda c: c["s"].isNotNull()))
    packed = F.collect_list(F.struct(F.col("_l").alias("l"), F.col("_c").alias("c"))).alias("_all")
    if 8 * (sizes.dims or 0) + 16 * sizes.n <= BROADCAST_BYTES:
        rows = vectors.join(F.broadcast(index.agg(packed))).withColumn("_x", x)  # one row that holds the whole index
        return rows.withColumn("_best", best).select(key, (-F.col("_best.n")).alias("centroid_label"), F.col("_best.s").alias("score"))
    tiles = -(-sizes.n // TILE)
    tiled = index.groupBy(F.pmod(F.xxhash64("_l", "_c"), F.lit(tiles)).cast("int").alias("_tile")).agg(packed)
    tiled = tiled.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = vectors.select(F.col(key).alias("_key"), x.alias("_x")).withColumn("_print", F.xxhash64("_key", "_x"))
    counted = rows.groupBy("_key", "_x", "_print").agg(F.count("*").alias("_times"))
    spread = counted.withColumns({"_salt": F.pmod("_print", F.lit(SALTS)).cast("int"), "_tile": F.explode(F.sequence(F.lit(0), F.lit(tiles - 1)))})
    met = spread.join(tiled, ["_tile", "_salt"], "left").select("_key", "_print", "_times", best.alias("_best"))
    found = met.groupBy("_key", "_print", "_times").agg(F.max("_best").alias("_best"))
    found = found.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_times"))))
    return found.select(F.col("_key").alias(key), (-F.col("_best.n")).alias("centroid_label"), F.col("_best.s").alias("score"))


def labels_of(assigned: DataFrame, representatives: DataFrame, keep: list[str]) -> DataFrame:
    """Detections that a vector takes over from its centroid: one row for each label of the centroid's representative.

    ``representatives`` has (centroid_label, label); the score of a detection is the similarity to the centroid.
    """
    return assigned.join(representatives.select("centroid_label", "label"), "centroid_label").select(*keep, "label", "score")


def representatives(vectors: DataFrame, centroids: DataFrame, key: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """(label, representative): the member of each cluster that is least similar to its centroid; ties go to the smaller key."""
    own = vectors.select(label, F.col(key).alias("_k"), F.col(embedding).cast("array<double>").alias("_x")).join(centroids.select(label, "centroid"), label)
    far = F.struct(F.round(cosine(F.col("_x"), F.col("centroid")), 9), F.col("_k"))
    return own.groupBy(label).agg(F.min_by("_k", far).alias("representative"))


def kmeans_index(vectors: DataFrame, k: int = 50, seed: int = 7, key: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(cluster, representative, centroid): k-means clusters, each with its least similar member as representative."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = vectors.withColumn("_v", array_to_vector(F.col(embedding).cast("array<double>")))
    model = KMeans(k=k, seed=seed, featuresCol="_v", predictionCol="cluster").fit(rows)
    centres = vectors.sparkSession.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())], "cluster int, centroid array<double>")
    placed = model.transform(rows).select(key, embedding, "cluster")
    return representatives(placed, centres, key, embedding, "cluster").join(centres, "cluster")
