"""The embedding index: as one row, and cut into tiles beyond its size bound."""

import random

from cuelight.operators import tasti


def _index(spark, n):
    rng = random.Random(n)
    vectors = [(i % 40, [rng.random(), rng.random(), rng.random()]) for i in range(60)] + [(3, [0.1, 0.2, 0.3])] * 3 + [(90, None)]
    centroids = [(i, [rng.random() - 0.5, rng.random(), rng.random()]) for i in range(n)]
    return spark.createDataFrame(vectors, "vec_id long, embedding array<double>"), spark.createDataFrame(centroids, "label int, centroid array<double>")


def test_tiles_give_the_same_rows(spark, monkeypatch):
    vectors, centroids = _index(spark, 50)
    one = sorted(map(str, tasti.assign(vectors, centroids).collect()))
    assert len(one) == vectors.count()
    monkeypatch.setattr(tasti, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(tasti, "TILE", 7)
    assert sorted(map(str, tasti.assign(vectors, centroids).collect())) == one


def test_no_vector_is_lost(spark):
    vectors, _ = _index(spark, 1)
    many = spark.range(10_050).selectExpr("cast(id as int) as label", "array(cast(id as double), 1D, 2D) as centroid")
    assert tasti.assign(vectors, many).count() == vectors.count()
    none = tasti.assign(vectors, many.limit(0))
    assert none.count() == vectors.count() and none.filter("centroid_label is not null").count() == 0


def test_labels_of_representatives(spark):
    vectors, centroids = _index(spark, 4)
    given = spark.createDataFrame([(0, "car"), (0, "dog"), (1, "car"), (2, "cat"), (3, "car")], "centroid_label int, label string")
    assigned = tasti.assign(vectors.filter("embedding is not null"), centroids)
    got = tasti.labels_of(assigned, given, ["vec_id"])
    assert got.count() == assigned.count() + assigned.filter("centroid_label = 0").count()
