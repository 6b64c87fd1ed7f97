"""The adapter for networks, NumPy networks and their stand-ins, and vectors as bytes."""

import numpy as np
from pyspark.sql import functions as F

from cuelight.functions import columns, images
from cuelight.operators import models, networks
from cuelight.plans.catalog import OPERATORS
from cuelight.sources.frames import synthetic_frames


def _images(frames):
    return [(r.id, images.as_image(r.framebytes, r.width, r.height)) for r in frames.orderBy("id").collect()]


def test_split_gives_the_whole():
    whole = networks.Layers.made((6, 5, 4, 3), 1)
    x = np.random.default_rng(0).normal(size=(7, 6))
    for at in range(3):
        first, rest = whole.split(at)
        assert np.allclose(rest(first(x)), whole(x))
    assert np.allclose(networks.quantised(whole)(x), whole(x), atol=0.2)
    assert [len(b) for b in networks.batches_of(list(range(35)))] == [16, 16, 3]


def test_adapter(spark):
    frames = synthetic_frames(spark, 40)
    calls = networks.network_operator("mean", lambda: lambda batch: [[(0.0, 0.0, 1.0, 1.0, "x", int(len(batch) <= 16), float(i.mean()))] if i.mean() > 60 else [] for i in batch])
    got = {r.id: r.mean for r in calls(frames).select("id", F.col("mean")).collect()}
    for i, image in _images(frames):
        assert [d.score for d in got[i]] == ([float(image.mean())] if image.mean() > 60 else [])


def test_prefix_and_suffix(spark):
    frames, models_of = synthetic_frames(spark, 20), networks.stand_ins()
    full = {r.id: r.deepfaceGender[0] for r in models_of["deepfaceGender"]()(frames).collect()}
    split = models_of["deepfaceSuffixGender"]()(models_of["dfprefixembed"]()(frames)).collect()
    assert {r.id: r.deepfaceSuffixGender[0].label for r in split} == {i: d.label for i, d in full.items()}
    assert all(abs(r.deepfaceSuffixGender[0].score - full[r.id].score) < 1e-5 for r in split)


def test_every_name_has_a_model(spark):
    made = models.register_stand_ins()
    assert "svm" in made and models.register_stand_ins() == []
    tasti = {"objectdetect_tasti", "emotiondetect_tasti", "facedetect_tasti", "actiondetect_tasti"}
    needs_more = tasti | {"similarity", "actiondetect"}  # a target image, an index, clips
    for e in OPERATORS.values():
        if e.name not in needs_more:
            assert callable(models.model(e.name))
    frames = synthetic_frames(spark, 6)
    day = {r.id: r.svm[0].label for r in models.model("svm")(frames).collect()}
    assert day == {i: "day" if images.resized(x).mean() > images.DAY else "night" for i, x in _images(frames)}
    assert models.model("simple_transfer")(frames).filter("simple_transfer >= 0").count() == 6
    assert models.model("transfer")(frames).filter("transfer >= 0").count() == 6
    for name in ("objectdetect_nano", "objectdetect_xlarge", "facedetect", "animaldetect"):
        boxes = models.model(name)(frames).select(F.inline(name)).collect()
        assert all(0 <= b.xmin < b.xmax <= 36 and 0 <= b.ymin < b.ymax <= 24 and 0 < b.score <= 1 for b in boxes) and boxes
    assert set(models.engine_models(["md", "svm"])) == {"md", "svm"}


def test_vectors_as_bytes(spark):
    df = spark.createDataFrame([([1.5, -2.0],), (None,), ([],)], "v array<float>")
    rows = df.select("v", columns.bytes_vector(columns.vector_bytes(F.col("v"))).alias("w")).collect()
    assert [r.w for r in rows] == [r.v for r in rows]


def test_boxes(spark):
    r = spark.createDataFrame([(1.0, 2.0, 5.0, 10.0)], "a double, b double, c double, d double")
    c = [F.col(x) for x in "abcd"]
    got = r.select(columns.centre_box(*c).alias("p"), columns.corner_box(*c).alias("q")).first()
    assert tuple(got.p) == (3.0, 6.0, 4.0, 8.0) and tuple(got.q) == (1.0, 2.0, 6.0, 12.0)
