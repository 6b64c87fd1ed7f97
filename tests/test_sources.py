"""Subtitles, ingest arithmetic, null rules of predictions, images, tracker and streams on small inputs."""

import numpy as np
from pyspark.sql import functions as F

from cuelight.functions import columns, images
from cuelight.operators import filters, ingest, metrics, models, predictions
from cuelight.sources import frames as fr
from cuelight.sources.transcripts import parse_srt, read_srt
from cuelight.streaming.detections import read_stream, windowed_counts

SRT = "1\n00:00:05,250 --> 00:00:07,900\nThe FERRY leaves\nat noon\n\n2\r\n00:02:03,000 --> 00:02:04,000\r\nMind the gap \n"


def test_subtitles(spark, tmp_path):
    df = spark.createDataFrame([("a.srt", SRT), ("b.srt", "")], "uri string, text string")
    got = sorted((r.frame_id, r.segment) for r in parse_srt(df, 1).collect())
    assert got == [(5, "the ferry leaves at noon"), (6, "the ferry leaves at noon"), (7, "the ferry leaves at noon"), (123, "mind the gap"), (124, "mind the gap")]
    assert len(parse_srt(df, 1, compat=True).collect()) == 3
    (tmp_path / "x.srt").write_text(SRT)
    assert read_srt(spark, str(tmp_path), 1).count() == 5


def test_chunks(spark):
    chunks = spark.createDataFrame([(0, 5), (1, 5), (2, 4)], "chunk int, chunk_frames long")
    placed = ingest.chunk_offsets(chunks)
    assert [(r.start_chunk, r.end_chunk, r.total_frames) for r in placed.orderBy("chunk").collect()] == [(0, 4, 13), (5, 9, 13), (10, 13, 13)]
    assert sorted(r.id for r in ingest.decode_window(placed, 0.5, 1.0).collect()) == list(range(6, 14))
    assert ingest.subsample(ingest.decode_window(placed, 0, 1), 7).count() == 2


def test_null_rules(spark):
    schema = "id long, p struct<label: array<string>, score: array<double>>"
    df = spark.createDataFrame([(1, ([None], [None])), (2, ([], [])), (3, (["a", "b"], [0.5])), (4, None)], schema)
    got = [tuple(r) for r in predictions.explode_preds(df, "p").orderBy("id", "label").collect()]
    assert got == [(1, None, None), (3, "a", 0.5), (3, "b", None)]


def test_images():
    flat = lambda v: np.full((20, 30, 3), v, np.uint8)
    assert images.mean_value(flat(115)) == 115 and images.mean_value(flat(116)) == 116
    mask = np.zeros((8, 8), bool)
    mask[0, 0:2] = mask[1, 2] = mask[5:7, 5] = mask[7, 0] = True
    assert images.regions(mask) == 3
    assert images.moving_regions(flat(50), flat(50)) == 0
    moved = flat(50).copy()
    for x in (2, 12, 24):
        moved[2:5, x : x + 3] = 255
    assert images.moving_regions(flat(50), moved) == 3
    assert (images.gradient_hash(moved) != images.gradient_hash(moved)).sum() == 0


def test_layout_and_boxes():
    flat = np.full((20, 30, 3), 51, np.uint8)
    assert np.allclose(images.colour_layout(flat), 0.2) and images.colour_layout(flat).shape == (192,)
    drawn = images.with_boxes(flat, np.array([[2, 3, 6, 8], [-5, -5, 100, 100], [9, 9, 8, 8]], float))
    assert (drawn[3, 2:7] == (0, 255, 0)).all() and (drawn[5, 4] == 51).all() and (drawn[0, 0] == (0, 255, 0)).all()


def test_motion_does_not_depend_on_segments(spark):
    frames = fr.synthetic_frames(spark, 40, videos=2)
    one, many = (sorted(map(tuple, models.motion(frames, n).collect())) for n in (1000, 6))
    assert one == many and len(one) == 40
    assert {r[2] for r in one if r[1] in (0, 1)} == {"no_motion"}


def test_tracker(spark):
    rows = [("v", i, "car", float(i), 0.0, float(i) + 10, 10.0) for i in range(5)] + [("v", i, "car", 100.0, 0.0, 110.0, 10.0) for i in (0, 1, 4)] + [("v", 9, "car", 4.0, 0.0, 14.0, 10.0)]
    df = spark.createDataFrame(rows, "uri string, id long, label string, xmin double, ymin double, xmax double, ymax double")
    got = {(r.id, r.xmin): r.track for r in models.track(df).collect()}
    assert len({got[i, float(i)] for i in range(5)}) == 1
    assert got[0, 100.0] == got[1, 100.0] == got[4, 100.0] != got[0, 0.0]
    assert got[9, 4.0] not in {v for k, v in got.items() if k[0] < 9}


def test_columns(spark):
    df = spark.createDataFrame([("/a/b/clip_12.mp4", [1.0, 3.0, 3.0])], "p string, s array<double>")
    r = df.select(columns.base_name(F.col("p")).alias("b"), columns.extension(F.col("p")).alias("e"), columns.chunk_number(F.col("p")).alias("n"), columns.top_class(F.col("s")).alias("t"), F.aggregate(columns.softmax(F.col("s")), F.lit(0.0), lambda a, x: a + x).alias("one")).first()
    assert (r.b, r.e, r.n, r.t) == ("clip_12", "mp4", 12, 1) and abs(r.one - 1) < 1e-12


def test_metrics(spark):
    a, b = (spark.createDataFrame([(x,) for x in v], "id long") for v in ([1, 1, 2], [1, 2, 2, 3]))
    r = metrics.f1_of(metrics.multiset_counts(a, b)).first()
    assert (r.tp, r.fp, r.fn) == (2, 2, 1) and abs(r.f1 - 4 / 7) < 1e-12
    old = spark.createDataFrame([("k", "a", 0.1), ("k", "b", 0.2)], "key string, op string, selectivity double")
    new = spark.createDataFrame([("k", "b", 0.3)], "key string, op string, selectivity double")
    assert sorted(map(tuple, metrics.upsert(old, new, ["key", "op"]).collect())) == [("k", "a", 0.1), ("k", "b", 0.3)]


def test_global_windows_are_partitioned(spark):
    plan = filters.fixed_rate_sample(spark.range(1000).withColumnRenamed("id", "det_id"), 20, "det_id")
    text = plan._jdf.queryExecution().executedPlan().toString()
    for line in text.split("\n"):
        if "SinglePartition" in line:
            assert "det_id" not in line


def test_catalog_and_commands(spark, tmp_path):
    for n in ("b.mp4", "a.mp4", "x.txt"):
        (tmp_path / n).write_bytes(b"x")
    assert [r.uri.rsplit("/", 1)[1] for r in fr.video_catalog(spark, str(tmp_path)).orderBy("id").collect()] == ["a.mp4", "b.mp4"]
    assert "00:01:05" in fr.segment_command("a", 65, "o_%d.mp4")


def test_stream(spark, tmp_path):
    rows = spark.sql("select timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,cast(id as int)) as ts, if(id % 2 = 0, 'a', 'b') as label, 0.5D as score from range(30)")
    rows.write.parquet(str(tmp_path / "in"))
    stream = windowed_counts(read_stream(spark, str(tmp_path / "in"), rows.schema))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("counts").start()
    q.processAllAvailable()
    q.stop()
    got = sorted(map(tuple, spark.sql("select start, end, label, n, mean_score from counts").collect()))
    assert got == sorted(map(tuple, windowed_counts(rows).collect())) and len(got) == 12
