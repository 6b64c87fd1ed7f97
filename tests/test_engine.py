"""Rows that must not be lost or mixed up: caches, null tracks, videos; scans of plans; profiling and running in one call."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cuelight import queries
from cuelight.functions import images
from cuelight.operators import metrics, models, movement, tasti
from cuelight.operators.ordering import global_position, running_total
from cuelight.plans import hints as h
from cuelight.plans.engine import Dependent, Engine
from cuelight.plans.query import Filter, Query, Slot
from cuelight.plans.settings import Settings, parse_two_levels, settings_from
from cuelight.sources import frames as fr
from cuelight.sources import profiles

D = "/root/testdata/sf0.001"


def _engine(spark, **options):
    det = spark.createDataFrame([(i % 5, "a" if i % 2 else "b", i / 20) for i in range(20)], "id long, label string, score double")
    return Engine({"m": models.TableModel(det), "n": models.TableModel(det)}, settings=Settings(**options)), det


def test_cache_knows_its_input(spark):
    engine, _ = _engine(spark, caching=True)
    q = Query("q", (Slot("m", (Filter("quality_filter", (0.0,)),)),))
    plan = engine.plans(q)[0]
    one, two = (spark.createDataFrame([(i,)], "id long") for i in (1, 2))
    assert {r.id for r in engine.run(plan, q, one).collect()} == {1}
    assert {r.id for r in engine.run(plan, q, two).collect()} == {2}
    named = [Query("q", (Slot("m", (Filter("f", fn=lambda d, x=x: d.filter(F.col("label") == x)),)),)) for x in "ab"]
    got = [{r.label for r in engine.run(engine.plans(x)[0], x, one).collect()} for x in named]
    assert got == [{"a"}, {"b"}]
    assert engine.stored_keys(one.select("id").distinct(), [plan]) == {plan.key}
    kept = engine._kept[plan.key][0].found
    assert kept.storageLevel.useMemory and kept.sameSemantics(engine._stored(plan.key, one.distinct(), engine._calls(plan, 0, None)))
    engine.reset_cache()
    assert not kept.storageLevel.useMemory and not engine.stored_keys(one.distinct(), [plan])


def test_null_tracks_and_videos(spark):
    box = "xmin double, xmax double, ymin double, ymax double"
    df = spark.createDataFrame([(1, 1, None, 0.0, 2.0, 0.0, 2.0), (1, 2, 5, 0.0, 2.0, 0.0, 2.0), (2, 3, None, 4.0, 6.0, 0.0, 2.0)], f"id long, det_id long, track long, {box}")
    for per_track in (True, False):
        assert movement.movement(df, back=1, per_track=per_track).count() == 3
    assert global_position(df, F.col("track"), ["id"]).select("pos").orderBy("pos").collect() == [(1,), (2,), (3,)]
    two = df.filter("track is null").withColumns({"uri": F.concat(F.lit("v"), F.col("id").cast("string")), "track": F.lit(1)})
    assert [r.dx for r in movement.movement(two, back=1).orderBy("id").collect()] == [1.0, 5.0]


def test_running_totals(spark):
    rows = [(i % 3, i * 7 % 50 if i % 11 else None, i) for i in range(200)]
    df = spark.createDataFrame(rows, "k long, b long, v long")
    for keys in ((), ("k",)):
        got = running_total(df, F.col("v"), F.col("b"), ["b", "v"], "t", keys).collect()
        assert len(got) == 200
        for r in got:
            before = [v for k, b, v in rows if (not keys or k == r.k) and ((b is not None, b or 0, v) <= (r.b is not None, r.b or 0, r.v))]
            assert r.t == sum(before)
    assert running_total(df.limit(0), F.col("v"), F.col("b"), ["b"], "t").count() == 0


def _scans(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("Relation [")


def test_plans_read_their_inputs_once(spark):
    det = queries.QUERIES
    assert _scans(det["q_angrybernie"](spark, D)) <= 4
    assert _scans(det["q_deepface"](spark, D)) <= 4
    assert _scans(det["faces_and"](spark, D)) == _scans(det["two_people"](spark, D)) == 1


def test_dock_by_every_plan(spark):
    engine, frames, query = queries.dock(spark, D)
    plans = engine.plans(query, queries.DOCK_HINTS, {"qcl": (Filter("objects_or", (("car", "person"),)),)})
    ops = [[s.op for s in p.steps] for p in plans]
    assert ["odx", "ot", "svm"] in ops and ["odx", "ot", "bi"] in ops and any("qcl" in o for o in ops)
    answers = {str(sorted(map(str, engine.run(p, query, frames).select("det_id", "xdir", "ydir").collect()))) for p in plans if "qcl" not in [s.op for s in p.steps]}
    assert len(answers) == 1
    with pytest.raises(ValueError):
        Engine({"ot": Dependent("odx", lambda d: d)}).run(engine.plans(Query("q", (Slot("ot"),)))[0], Query("q", (Slot("ot"),)), frames)


def test_answer_and_profile(spark, tmp_path):
    engine, det = _engine(spark, selectivity_fraction=1.0, prune_plans=True)
    q = Query("q", (Slot("m", (Filter("object_filter", ("a",)),)), Slot("n", (Filter("quality_filter", (0.5,)),))))
    frames = det.select("id").distinct()
    truth = engine.run(engine.plans(q)[0], q, frames)
    stats = engine.profile(q, frames, truth)
    assert stats.selectivity == {"m[object_filter(a)]": 1.0, "n[quality_filter(0.5)]": 1.0} and all(v > 0 for v in stats.latency.values())
    assert set(stats.f1.values()) == {1.0}
    found, choice = engine.answer(q, frames, truth=truth, log=str(tmp_path / "log"))
    assert found.count() == truth.count() and choice.f1 == 1.0
    record = spark.read.csv(str(tmp_path / "log"), header=True).collect()
    assert len(record) == 1 and record[0].query == "q" and record[0].ingest_fps == "1" and float(record[0].run_s) > 0
    stored = engine.materialise(["m", "n"], frames, str(tmp_path), "clip")
    assert engine.run(choice.plan, q, frames, replay=stored).count() == truth.count()
    assert engine.latency("m", frames.limit(0)) == 0
    few = Engine(engine.models, settings=Settings(selectivity_random=True, selectivity_fraction=0.5))
    assert few.sampled(spark.range(1000)).count() < 700


def test_settings():
    text = "storage:\n    input: 'in/'\nexecution:\n    gpu: False  # none here\n    proxy_confidence_thresh: 0.25\ningest:\n    fps: 2\n    end_fraction: 0.5\nlogging:\n    output: 'logs'\n"
    s = settings_from(parse_two_levels(text), caching=True, width=64)
    assert (s.input, s.proxy_confidence, s.ingest.fps, s.ingest.width, s.ingest.end_fraction, s.log, s.caching) == ("in/", 0.25, 2, 64, 0.5, "logs", True)
    with pytest.raises(ValueError):
        Settings().with_options(nothing=1)


def test_keys(spark):
    df = spark.createDataFrame([("b",), ("a",), ("a",), (None,)], "u string")
    import hashlib

    assert metrics.names_key(df, "u").first().key == hashlib.sha224(b"a&b").hexdigest()
    assert metrics.names_key(df.limit(0), "u").first().key == hashlib.sha224(b"").hexdigest()
    assert metrics.params_key({"b": 1, "a": "x"}) == hashlib.sha224(b"a:x_b:1").hexdigest()
    assert metrics.dataset_key(df, "u").first().key == metrics.dataset_key(df.distinct().orderBy("u"), "u").first().key


def test_stored_statistics(spark, tmp_path):
    (tmp_path / "p.json").write_text('{"od": 1.5,\n "i2v": "NOT_GPU_OP",\n}')
    assert profiles.read_profile(spark, str(tmp_path / "p.json")) == {"od": 1.5, "i2v": profiles.NOT_ON_GPU}
    rows = spark.createDataFrame([("k", "p1", "a", 0.5), ("x", "p1", "a", 0.1)], "key string, params string, op string, selectivity double")
    rows.write.option("header", True).csv(str(tmp_path / "s"))
    stored = profiles.read_stats(spark, str(tmp_path / "s"), "key string, params string, op string, selectivity double", "k")
    fresh = spark.createDataFrame([("k", "p1", "a", 0.7), ("k", "p1", "b", 0.2)], stored.schema)
    assert sorted(r.selectivity for r in profiles.merge_stats(stored, fresh).collect()) == [0.2, 0.7]
    path = fr.save_predictions(fresh, str(tmp_path), "od", "clip")
    assert path.endswith("/od_clip.parquet") and spark.read.parquet(path).count() == 2
    shown = fr.result_rows(spark.createDataFrame([(2, "a", 0.1, 1), (1, "b", 0.2, 1)], "id long, label string, score double, x int"))
    assert shown.columns == ["id", "label", "score"] and [r.id for r in shown.collect()] == [1, 2]


# --- queries without SQL against plain versions


def _frames(spark):
    return [(r.uri, r.id, images.as_image(r.framebytes, r.width, r.height)) for r in queries.frames_of_table(spark, D).orderBy("id").collect()]


def test_frame_queries(spark):
    shown = _frames(spark)
    assert len(shown) == 100
    got = {r.id: r for r in queries.QUERIES["brightness"](spark, D).collect()}
    assert {i: r.label for i, r in got.items()} == {i: "day" if images.mean_value(x) > images.DAY else "night" for _, i, x in shown}
    target = images.gradient_hash(shown[3][2])
    assert {r.id: r.similarity for r in queries.QUERIES["frame_similarity"](spark, D).collect()} == {i: float((images.gradient_hash(x) != target).sum()) for _, i, x in shown}
    assert all(np.allclose(r.img2vec, images.colour_layout(shown[r.id][2])) for r in queries.QUERIES["frame_embeddings"](spark, D).collect())
    weights = np.random.default_rng(2).normal(size=(192, 3))
    for r in queries.QUERIES["frame_classes"](spark, D).collect():
        z = images.colour_layout(shown[r.id][2]) @ weights
        odds = np.exp(z - z.max())
        assert r.cls == z.argmax() and abs(r.score - odds.max() / odds.sum()) < 1e-6
    before = {}
    moves = {(r.uri, r.id): r.label for r in queries.QUERIES["motion"](spark, D).collect()}
    for _, i, x in shown:
        v = f"video{i % 2}"
        assert moves[v, i] == ("motion" if v in before and images.moving_regions(before[v], x) > images.REGIONS else "no_motion")
        before[v] = x


def _plain_tracks(rows, overlap=0.3, patience=3):
    """Track numbers of one video's (frame, det_id, label, box) rows."""
    live, out, made = {}, {}, 0
    for frame in sorted({r[0] for r in rows}):
        here = sorted((r for r in rows if r[0] == frame), key=lambda r: r[1])
        live = {t: v for t, v in live.items() if frame - v[0] <= patience}
        pairs = sorted((-models._overlap(np.array(r[3]), np.array(box)), t, n) for n, r in enumerate(here) for t, (_, label, box) in live.items() if label == r[2])
        used, own = set(), {}
        for iou, t, n in pairs:
            if -iou >= overlap and n not in own and t not in used:
                own[n] = t
                used.add(t)
        for n, r in enumerate(here):
            if n not in own:
                made += 1
                own[n] = made
            live[own[n]] = (frame, r[2], r[3])
            out[r[1]] = own[n]
    return out


def test_tracks(spark, monkeypatch):
    got = {r.det_id: r.track for r in queries.QUERIES["track"](spark, D).collect()}
    rows = queries.objects(queries.detections(spark, D)).collect()
    want = {}
    for cam in range(8):
        want |= _plain_tracks([(r.id, r.det_id, r.label, (r.xmin, r.ymin, r.xmax, r.ymax)) for r in rows if r.id % 8 == cam])
    assert got == want
    rng = np.random.default_rng(3)
    made, n = [], 0
    for frame in np.flatnonzero(rng.random(400) < 0.35):
        for label in ("car", "dog")[: rng.integers(1, 3)]:
            x = float(frame % 40) + rng.normal()
            made.append(("v", int(frame), n, label, x, 0.0, x + 12, 9.0))
            n += 1
    df = spark.createDataFrame(made, "uri string, id long, det_id long, label string, xmin double, ymin double, xmax double, ymax double")
    monkeypatch.setattr(models, "SEGMENT", 16)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        got = {r.det_id: r.track for r in models.track(df).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == _plain_tracks([(r[1], r[2], r[3], r[4:]) for r in made])


def test_clusters(spark):
    vectors = spark.read.parquet(f"{D}/embeddings.parquet")
    index = tasti.kmeans_index(vectors, k=5).collect()
    rows = {r.vec_id: np.array(r.embedding) for r in vectors.collect()}
    centres = {r.cluster: np.array(r.centroid) for r in index}
    own = {v: min(centres, key=lambda c: float(((x - centres[c]) ** 2).sum())) for v, x in rows.items()}
    for r in index:
        members = [v for v in rows if own[v] == r.cluster]
        cos = {v: round(float(rows[v] @ centres[r.cluster] / np.linalg.norm(rows[v]) / np.linalg.norm(centres[r.cluster])), 9) for v in members}
        assert r.representative == min(cos, key=lambda v: (cos[v], v))


def test_random_drop_is_a_seeded_subset(spark):
    all_rows = {r.det_id for r in queries.detections(spark, D).select("det_id").collect()}
    one, two = ({r.det_id for r in queries.QUERIES["drop_frames_random"](spark, D).collect()} for _ in range(2))
    assert one == two and one < all_rows and 0.15 < len(one) / len(all_rows) < 0.35


def test_hints_by_superset(spark):
    with pytest.raises(ValueError):
        queries.dock(spark, D)[0].plans(queries.dock(spark, D)[2], [h.superset("qcl", "ot")])
