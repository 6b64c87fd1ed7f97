"""Registered queries of the engine's own operators, and SQL with the same rows.

The tables stand in for video results: ``events`` are detections (ten to a frame, the event type as label, the user as
track), from which four predictors are derived; ``orders`` and ``lineitem`` are frames and detections at larger size.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuelight.operators import filters as flt
from cuelight.operators import ingest, metrics, models, movement, predictions, tasti
from cuelight.operators.ordering import global_position
from cuelight.plans import hints as h
from cuelight.plans.catalog import TRANSFERS
from cuelight.plans.planner import enumerate_plans, plan_count
from cuelight.plans.query import Filter, Query, Slot
from cuelight.sources import frames as frame_sources

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: The detection view and the four derived predictors, for DuckDB.
DET = """with det as (
  select event_id as det_id, event_id // 10 as id, event_type as label, user_id as track, value / 100.0::double as score,
         cast(json_extract_string(props, '$.k') as int) as k
  from events),
odx as (
  select det_id, id, case k % 4 when 0 then 'person' when 1 then 'car' when 2 then 'dog' else 'boat' end as label, score, track,
         k::double as xmin, (k + 10)::double as xmax, ((k * 7) % 100)::double as ymin, ((k * 7) % 100 + 10)::double as ymax
  from det),
ed as (select det_id, id, case track % 7 when 0 then 'angry' else 'other' end as label, score from det),
age as (select det_id, id, k as cls from det),
moved as (
  select *, (xmin + xmax) / 2 as xcent, (ymin + ymax) / 2 as ycent from odx),
steps as (
  select *, xcent - lag(xcent, 10, 0.0) over w as dx, ycent - lag(ycent, 10, 0.0) over w as dy from moved
  window w as (partition by track order by id, det_id)),
global_steps as (
  select *, xcent - lag(xcent, 10, 0.0) over w as dx, ycent - lag(ycent, 10, 0.0) over w as dy from moved
  window w as (order by track, id, det_id)),
turned as (
  select *, case when dx > 20 then 'right' else 'left' end as xdir, case when dy > 20 then 'up' else 'down' end as ydir from steps)
"""


def _query(name: str, sql: str | None = None):
    def put(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """det_id, id (frame), label, track, score, k."""
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("det_id"), F.expr("event_id div 10").alias("id"), F.col("event_type").alias("label"), F.col("user_id").alias("track"), (F.col("value") / 100.0).alias("score"), k.alias("k"))


def faces(det: DataFrame) -> DataFrame:
    return det.select("det_id", "id", "label", "score")


def objects(det: DataFrame) -> DataFrame:
    k = F.col("k")
    label = F.when(k % 4 == 0, "person").when(k % 4 == 1, "car").when(k % 4 == 2, "dog").otherwise("boat")
    y = (k * 7) % 100
    return det.select("det_id", "id", label.alias("label"), "score", "track", k.cast("double").alias("xmin"), (k + 10).cast("double").alias("xmax"), y.cast("double").alias("ymin"), (y + 10).cast("double").alias("ymax"))


def emotions(det: DataFrame) -> DataFrame:
    return det.select("det_id", "id", F.when(F.col("track") % 7 == 0, "angry").otherwise("other").alias("label"), "score")


def ages(det: DataFrame) -> DataFrame:
    return det.select("det_id", "id", F.col("k").alias("cls"))


# --- projections and filters


@_query("explode_preds", DET + "select id, label, score, k from det")
def explode_preds(spark, sf_dir):
    packed = predictions.collect_preds(detections(spark, sf_dir), ["id"], ["label", "score", "k"], "det_id")
    return predictions.explode_preds(packed, "preds", ["id"])


@_query("quality_filter", DET + "select det_id, id, label, score from det where score > 0.6")
def quality_filter(spark, sf_dir):
    return flt.quality_filter(faces(detections(spark, sf_dir)))


@_query("object_filter", DET + "select det_id, id, label, score from det where label = 'error'")
def object_filter(spark, sf_dir):
    return flt.object_filter(faces(detections(spark, sf_dir)), "error")


@_query("objects_or", DET + "select det_id, id, label, score from det where label in ('error', 'signup')")
def objects_or(spark, sf_dir):
    return flt.objects_or(faces(detections(spark, sf_dir)), ["error", "signup"])


@_query("age_old_filter", DET + "select det_id, id, cls from age where cls > 19")
def age_old_filter(spark, sf_dir):
    return flt.age_old_filter(ages(detections(spark, sf_dir)))


@_query("drop_confidence", DET + "select det_id, round(score - 0.1::double, 9) as score from det")
def drop_confidence(spark, sf_dir):
    return predictions.drop_confidence(detections(spark, sf_dir), 0.1).select("det_id", F.round("score", 9).alias("score"))


@_query("add_field_to_struct", DET + "select det_id, label, 'cam' || (id % 3)::varchar as uri from det")
def add_field_to_struct(spark, sf_dir):
    df = detections(spark, sf_dir).select("det_id", F.concat(F.lit("cam"), (F.col("id") % 3).cast("string")).alias("uri"), F.struct("label").alias("p"))
    return predictions.add_field_to_struct(df, "p", "uri", "uri").select("det_id", "p.label", "p.uri")


@_query("dedup_frames", DET + "select det_id, id, label, score from det qualify row_number() over (partition by id order by det_id) = 1")
def dedup_frames(spark, sf_dir):
    return predictions.dedup_frames(faces(detections(spark, sf_dir)), ["id"], "det_id")


@_query("proxy_split", DET + "select det_id, coalesce(score >= 0.8, false) as accepted from det")
def proxy_split(spark, sf_dir):
    low, high = flt.proxy_split(detections(spark, sf_dir), 0.8)
    return low.select("det_id", F.lit(False).alias("accepted")).unionByName(high.select("det_id", F.lit(True).alias("accepted")))


@_query("proxy_cascade_union", DET + "select det_id, id, label from det where (score < 0.8 and k > 50) or score >= 0.8")
def proxy_cascade_union(spark, sf_dir):
    low, high = flt.proxy_split(detections(spark, sf_dir), 0.8)
    return low.filter("k > 50").unionByName(high).select("det_id", "id", "label")


# --- joins across frames


@_query("two_people", DET + "select det_id, id from det where label = 'error' and id in (select id from det where label = 'error' group by id having count(*) = 2)")
def two_people(spark, sf_dir):
    return flt.two_people(flt.object_filter(faces(detections(spark, sf_dir)), "error")).select("det_id", "id")


@_query("faces_and", DET + "select det_id, id, label from det where id in (select id from det where label = 'error') and id in (select id from det where label = 'signup')")
def faces_and(spark, sf_dir):
    return flt.faces_and(faces(detections(spark, sf_dir)), ["error", "signup"]).select("det_id", "id", "label")


@_query("window_expand", DET + "select d.det_id, d.id from det d, (select min(id) - 30 as a, max(id) + 30 as b from det where label = 'purchase' and score > 3.6) w where d.id between a and b")
def window_expand(spark, sf_dir):
    inside = (F.col("label") == "purchase") & (F.col("score") > 3.6)
    return flt.window_expand(faces(detections(spark, sf_dir)), inside).select("det_id", "id")


@_query("canary_replay_semi", DET + "select det_id, id, label from ed where id in (select id from det where label = 'error' and score > 2)")
def canary_replay_semi(spark, sf_dir):
    det = detections(spark, sf_dir)
    left = det.filter("label = 'error' and score > 2").select("id").distinct()
    return models.TableModel(emotions(det))(left).select("det_id", "id", "label")


@_query("embed_reattach_outer", DET + "select det_id, id, len(embedding) as dims, round(embedding[1], 6)::double as first from det left join embeddings on id = vec_id")
def embed_reattach_outer(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    joined = detections(spark, sf_dir).join(vectors, "id", "left")
    dims = F.when(F.col("embedding").isNotNull(), F.size("embedding")).cast("long")
    return joined.select("det_id", "id", dims.alias("dims"), F.round(F.col("embedding")[0], 6).cast("double").alias("first"))


@_query("collapse_frames", DET + "select id, string_agg(det_id::varchar || ':' || label, ',' order by det_id) as boxes from det group by id")
def collapse_frames(spark, sf_dir):
    grouped = predictions.collapse_frames(detections(spark, sf_dir), ["id"], "det_id", ["label"])
    return grouped.select("id", F.array_join(F.transform("boxes", lambda b: F.concat_ws(":", b["det_id"].cast("string"), b["label"])), ",").alias("boxes"))


# --- movement


_MOVED = "det_id, track, round(dx, 6) as dx, round(dy, 6) as dy"


def _moved(df: DataFrame) -> DataFrame:
    return df.select("det_id", "track", F.round("dx", 6).alias("dx"), F.round("dy", 6).alias("dy"))


@_query("movement_lag", DET + f"select {_MOVED} from global_steps")
def movement_lag(spark, sf_dir):
    return _moved(movement.movement(objects(detections(spark, sf_dir)), per_track=False))


@_query("movement_per_track", DET + f"select {_MOVED} from steps")
def movement_per_track(spark, sf_dir):
    return _moved(movement.movement(objects(detections(spark, sf_dir))))


@_query("remove_stationary", DET + f"select {_MOVED} from steps where abs(dx) > 1 and abs(dy) > 1")
def remove_stationary(spark, sf_dir):
    return _moved(movement.remove_stationary(movement.movement(objects(detections(spark, sf_dir)))))


@_query("find_directions", DET + "select det_id, xdir, ydir from turned")
def find_directions(spark, sf_dir):
    return movement.find_directions(movement.movement(objects(detections(spark, sf_dir)))).select("det_id", "xdir", "ydir")


@_query("left_turns", DET + "select det_id, xdir, ydir from turned where xdir = 'left' and ydir = 'up'")
def left_turns(spark, sf_dir):
    return movement.left_turns(movement.find_directions(movement.movement(objects(detections(spark, sf_dir))))).select("det_id", "xdir", "ydir")


# --- ingest and sampling


_CHUNKS = """, chunks as (select id // 5 as chunk, count(distinct id) as chunk_frames from det group by 1),
offsets as (
  select *, (sum(chunk_frames) over (order by chunk) - chunk_frames)::bigint as start_chunk, (sum(chunk_frames) over (order by chunk) - 1)::bigint as end_chunk
  from chunks),
placed as (select *, (select max(end_chunk) from offsets) as total_frames from offsets)
"""


def _chunks(spark, sf_dir) -> DataFrame:
    det = detections(spark, sf_dir).select("id").distinct()
    return ingest.chunk_offsets(det.groupBy(F.expr("id div 5").alias("chunk")).agg(F.count("*").alias("chunk_frames")))


@_query("chunk_offsets", DET + _CHUNKS + "select * from placed")
def chunk_offsets(spark, sf_dir):
    return _chunks(spark, sf_dir)


@_query("decode_window", DET + _CHUNKS + "select chunk, unnest(generate_series(greatest(start_chunk, floor(total_frames * 0.25)::bigint), least(end_chunk, floor(total_frames * 0.5)::bigint))) as id from placed where end_chunk >= floor(total_frames * 0.25) and start_chunk <= floor(total_frames * 0.5)")
def decode_window(spark, sf_dir):
    return ingest.decode_window(_chunks(spark, sf_dir), 0.25, 0.5).select("chunk", "id")


@_query("fixed_rate_sample", DET + "select det_id, id from (select *, row_number() over (order by det_id) as r from det) where r % 20 = 0")
def fixed_rate_sample(spark, sf_dir):
    return flt.fixed_rate_sample(detections(spark, sf_dir), 20, "det_id").select("det_id", "id")


@_query("drop_frames_fixed", DET + "select det_id, id from (select *, row_number() over (order by det_id) as r from det) where r % 4 = 0")
def drop_frames_fixed(spark, sf_dir):
    return flt.drop_frames(detections(spark, sf_dir), 0.75, "det_id").select("det_id", "id")


@_query("drop_frames_random")
def drop_frames_random(spark, sf_dir):
    return flt.drop_frames(detections(spark, sf_dir), 0.75, "det_id", random=True).select("det_id", "id")


# --- statistics


@_query("selectivity_all_ops", DET + """, per as (
  select id, max((score > 0.6)::int) as quality, max((label = 'error')::int) as errors, max((k > 19)::int) as older from det group by id)
select 'quality' as op, round(sum(quality) / count(*), 6) as selectivity from per union all
select 'errors', round(sum(errors) / count(*), 6) from per union all select 'older', round(sum(older) / count(*), 6) from per""")
def selectivity_all_ops(spark, sf_dir):
    return metrics.selectivities(detections(spark, sf_dir), {"quality": F.col("score") > 0.6, "errors": F.col("label") == "error", "older": F.col("k") > 19})


@_query("multiset_f1", DET + """, a as (select id, count(*) as n from det where score > 0.8 group by id),
b as (select id, count(*) as n from det where score > 0.7 and k > 20 group by id),
c as (select coalesce(a.n, 0) as x, coalesce(b.n, 0) as y from a full join b using (id)),
t as (select sum(least(x, y))::bigint as tp, sum(greatest(y - x, 0))::bigint as fp, sum(greatest(x - y, 0))::bigint as fn from c)
select tp, fp, fn, round(tp / (tp + fp), 6) as precision, round(tp / (tp + fn), 6) as recall, round(2.0 * tp / (2 * tp + fp + fn), 6)::double as f1 from t""")
def multiset_f1(spark, sf_dir):
    det = detections(spark, sf_dir)
    out = metrics.f1_of(metrics.multiset_counts(det.filter("score > 0.8"), det.filter("score > 0.7 and k > 20")))
    return out.select("tp", "fp", "fn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


#: Seconds for 16 frames and selectivities of a three-step plan.
_STEPS = [(1, "facedetect", 4.0562, 0.5), (2, "objectdetect", 1.4944, 0.1), (3, "emotiondetect", 10.6612, 0.2)]
_STEP_SQL = "with s(n, op, lat, sel) as (values " + ", ".join(f"({n}, '{o}', {a}::double, {b}::double)" for n, o, a, b in _STEPS) + "), c as (select *, coalesce(product(sel) over (order by n rows between unbounded preceding and 1 preceding), 1) as before from s)"


def _plan_cost(spark) -> DataFrame:
    from cuelight.plans.cost import PRICES, Stats, plan_cost, price
    from cuelight.plans.planner import Plan, Step

    plan = Plan(tuple(Step(o, (), i) for i, (_, o, _, _) in enumerate(_STEPS)))
    stats = Stats({o: a for _, o, a, _ in _STEPS}, {o: s for _, o, _, s in _STEPS})
    cost = plan_cost(plan, stats, 3600)
    rows = [(p, round(cost, 6), round(price(cost, p), 9)) for p in PRICES]
    return spark.createDataFrame(rows, "platform string, cost double, price double")


@_query("plan_cost", _STEP_SQL + " select round(sum(lat * 3600 * before / 16), 6) as cost from c")
def plan_cost_query(spark, sf_dir):
    return _plan_cost(spark).filter("platform = 'cpu'").select("cost")


@_query("plan_price", _STEP_SQL + ", t as (select sum(lat * 3600 * before / 16) as cost from c) select p as platform, round(cost, 6) as cost, round(cost * d, 9) as price from t, (values ('cpu', 0.00018::double), ('t4', 0.00025::double), ('v100', 0.00067::double)) v(p, d)")
def plan_price(spark, sf_dir):
    return _plan_cost(spark)


_TRANSFERS = [(0, 0.1303), (500, 1.0253), (1000, 1.5193), (2000, 4.2907), (4000, 8.5927), (8000, 14.6587)]


@_query("transfer_regression", "select round(regr_slope(s, f), 6) as slope, round(regr_intercept(s, f), 4) as intercept from (values " + ", ".join(f"({f}::double, {s}::double)" for f, s in _TRANSFERS) + ") t(f, s)")
def transfer_regression(spark, sf_dir):
    df = spark.createDataFrame([(float(f), s) for f, s in _TRANSFERS], "f double, s double")
    return metrics.linear_fit(df, "f", "s").select(F.round("slope", 6).alias("slope"), F.round("intercept", 4).alias("intercept"))


@_query("dataset_hash", """with h as (select distinct sha256(url) as h from pages where url is not null),
g as (select substr(h, 1, 4) as g, sha256(string_agg(h, '&' order by h)) as d from h group by 1)
select sha256(string_agg(d, '&' order by g)) as key from g""")
def dataset_hash(spark, sf_dir):
    return metrics.dataset_key(table(spark, sf_dir, "pages"), "url", 256)


@_query("dataset_names_hash", "select sha256(string_agg(u, '&' order by u)) as key from (select distinct url as u from pages where url is not null)")
def dataset_names_hash(spark, sf_dir):
    return metrics.names_key(table(spark, sf_dir, "pages"), "url", 256)


# --- transcripts and similarity


@_query("transcript_search", "select doc_id from documents where contains(lower(text), 'the')")
def transcript_search(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.lower("text").alias("segment"))
    return flt.transcript_search(docs, "the").select("doc_id")


@_query("transcript_frames", "select conv_id, turn * 4 + f as frame_id from conversations, range(4) r(f) where contains(lower(text), 'the')")
def transcript_frames(spark, sf_dir):
    said = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.lower("text").alias("segment"))
    found = flt.transcript_search(said, "the")
    return found.select("conv_id", F.explode(F.sequence(F.col("turn") * 4, F.col("turn") * 4 + 3)).alias("frame_id"))


_CENTROIDS = """with flat as (select label, generate_subscripts(embedding, 1) as d, unnest(embedding)::double as x from embeddings),
means as (select label, d, avg(x) as x from flat group by label, d),
cent as (select label, list(x order by d) as c from means group by label),
near as (
  select vec_id, e.label as own, c.label as centroid_label, round(list_cosine_similarity(e.embedding::double[], c.c), 12) as s
  from embeddings e, cent c),
best as (select vec_id, own, centroid_label, round(s, 4) as score from near qualify row_number() over (partition by vec_id order by s desc, centroid_label) = 1)
"""


@_query("tasti_centroids", _CENTROIDS + "select label, d::int as dim, round(x, 4) as x from means")
def tasti_centroids(spark, sf_dir):
    cent = tasti.mean_centroids(table(spark, sf_dir, "embeddings"))
    return cent.select("label", F.posexplode("centroid").alias("d", "x")).select("label", (F.col("d") + 1).alias("dim"), F.round("x", 4).alias("x"))


def _assigned(spark, sf_dir) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return tasti.assign(vectors, tasti.mean_centroids(vectors)).withColumn("score", F.round("score", 4))


@_query("tasti_assign", _CENTROIDS + "select vec_id, centroid_label, score from best")
def tasti_assign(spark, sf_dir):
    return _assigned(spark, sf_dir)


@_query("tasti_filter", _CENTROIDS + "select vec_id, centroid_label from best where score > 0.6 and centroid_label in (1, 2, 3)")
def tasti_filter(spark, sf_dir):
    return _assigned(spark, sf_dir).filter("score > 0.6 and centroid_label in (1, 2, 3)").select("vec_id", "centroid_label")


@_query("tasti_representatives", _CENTROIDS + """, own as (
  select e.label, e.vec_id, list_cosine_similarity(e.embedding::double[], c.c) as s from embeddings e join cent c on e.label = c.label)
select label, vec_id as representative from own qualify row_number() over (partition by label order by round(s, 9), vec_id) = 1""")
def tasti_representatives(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    return tasti.representatives(vectors, tasti.mean_centroids(vectors)).select("label", "representative")


@_query("img_similarity_rank", "select e.vec_id, round(1 - list_cosine_similarity(e.embedding::double[], t.embedding::double[]), 4) as similarity from embeddings e, (select embedding from embeddings where vec_id = 0) t where 1 - list_cosine_similarity(e.embedding::double[], t.embedding::double[]) < 0.9")
def img_similarity_rank(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    target = vectors.filter("vec_id = 0").select(F.col("x").alias("t"))  # one row
    ranked = vectors.join(F.broadcast(target)).withColumn("similarity", 1 - tasti.cosine(F.col("x"), F.col("t")))
    return flt.similarity_filter(ranked, 0.9).select("vec_id", F.round("similarity", 4).alias("similarity"))


@_query("tasti_kmeans")
def tasti_kmeans(spark, sf_dir):
    return tasti.kmeans_index(table(spark, sf_dir, "embeddings"), k=10).select("cluster", "representative")


# --- the four built-in queries


def angrybernie() -> Query:
    """Frames with two faces, exactly two people, and somebody angry."""
    people = (Filter("people", fn=lambda d: flt.two_people(d.filter("label = 'person' and score > 0.1"))),)
    return Query("angrybernie", (Slot("fd", (Filter("faces_and", (("error", "signup"),)),)), Slot("odx", people), Slot("ed", (Filter("object_filter", ("angry",)),))))


def _engine(spark, sf_dir):
    from cuelight.plans.engine import Engine

    det = detections(spark, sf_dir)
    tables = {"fd": faces(det), "odx": objects(det), "ed": emotions(det), "age": ages(det)}
    return Engine({n: models.TableModel(t) for n, t in tables.items()}), det.select("id").distinct()


def _answer(spark, sf_dir, query: Query) -> DataFrame:
    engine, frames = _engine(spark, sf_dir)
    return engine.run(engine.plans(query)[0], query, frames)


@_query("q_angrybernie", DET + """select det_id, id, label, score from ed where label = 'angry'
  and id in (select id from det where label = 'error') and id in (select id from det where label = 'signup')
  and id in (select id from odx where label = 'person' and score > 0.1 group by id having count(*) = 2)""")
def q_angrybernie(spark, sf_dir):
    return _answer(spark, sf_dir, angrybernie()).select("det_id", "id", "label", "score")


@_query("q_dunk", DET + """select o.det_id, o.id, o.label, o.score from odx o,
  (select min(id) - 30 as a, max(id) + 30 as b from det where label = 'purchase' and score > 2.5) w where o.label = 'dog' and o.id between a and b""")
def q_dunk(spark, sf_dir):
    near = Filter("window_expand", ((F.col("label") == "purchase") & (F.col("score") > 2.5),))
    query = Query("dunk", (Slot("fd", (near,)), Slot("odx", (Filter("object_filter", ("dog",)),))))
    return _answer(spark, sf_dir, query).select("det_id", "id", "label", "score")


#: Models of the dock that equal each other, and the one whose classes hold what the detector may find.
DOCK_HINTS = [h.equals("svm", "bi"), h.superset("qcl", "ot")]


def dock(spark, sf_dir):
    """(engine, frames, query): cars and people that move at night, by a tracker that reads a detector's boxes."""
    from cuelight.plans.engine import Dependent, Engine

    det = detections(spark, sf_dir)
    light = det.groupBy("id").agg(F.avg("k").alias("v")).select("id", F.when(F.col("v") < 45, "night").otherwise("day").alias("label"), F.lit(1.0).alias("score"))
    tables = {"odx": objects(det), "svm": light, "bi": light, "qcl": objects(det)}
    made = {n: models.TableModel(t) for n, t in tables.items()} | {"ot": Dependent("odx", lambda boxes: boxes)}
    moving = (Filter("quality_filter", (0.1,)), Filter("objects_or", (("car", "person"),)), Filter("movement", (10, False)), Filter("remove_stationary"), Filter("find_directions"))
    query = Query("amsterdamdock", (Slot("ot", moving, ("odx",)), Slot("svm", (Filter("object_filter", ("night",)),))), answer=0)
    return Engine(made), det.select("id").distinct(), query


@_query("q_amsterdamdock", DET.replace("from moved\n  window w as (order by", "from moved where score > 0.1 and label in ('car', 'person')\n  window w as (order by") + """select det_id, id, label, case when dx > 20 then 'right' else 'left' end as xdir, case when dy > 20 then 'up' else 'down' end as ydir
  from global_steps where abs(dx) > 1 and abs(dy) > 1 and id in (select id from det group by id having avg(k) < 45)""")
def q_amsterdamdock(spark, sf_dir):
    engine, frames, query = dock(spark, sf_dir)
    plans = engine.plans(query, DOCK_HINTS, {"qcl": (Filter("objects_or", (("car", "dog"),)),)})
    plain = next(p for p in plans if [s.op for s in p.steps] == ["odx", "ot", "svm"])
    return engine.run(plain, query, frames).select("det_id", "id", "label", "xdir", "ydir")


@_query("q_deepface", DET + """select det_id, id, label, score from det where label in ('view', 'click', 'error')
  and id in (select id from age where cls > 19) and id in (select id from ed where label = 'angry')""")
def q_deepface(spark, sf_dir):
    query = Query("deepface", (Slot("age", (Filter("age_old_filter"),)), Slot("ed", (Filter("object_filter", ("angry",)),)), Slot("fd", (Filter("objects_or", (("view", "click", "error"),)),))))
    return _answer(spark, sf_dir, query).select("det_id", "id", "label", "score")


@_query("bench_two_people", "select l_orderkey as id, l_linenumber::int as line from lineitem where l_returnflag = 'A' and l_orderkey in (select l_orderkey from lineitem where l_returnflag = 'A' group by 1 having count(*) = 2)")
def bench_two_people(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), F.col("l_returnflag").alias("label"))
    return flt.two_people(flt.object_filter(df, "A")).select("id", "line")


@_query("proxy_plan", DET + """select det_id, id, label, score from ed where label = 'angry' and (
  id in (select id from det where score >= 0.8 and label = 'error') or
  id in (select id from odx where label = 'person' and id in (select id from det where score < 0.8)))""")
def proxy_plan(spark, sf_dir):
    engine, frames = _engine(spark, sf_dir)
    query = Query("proxied", (Slot("odx", (Filter("object_filter", ("person",)),)), Slot("ed", (Filter("object_filter", ("angry",)),))))
    plans = engine.plans(query, [h.proxy("fd", "odx", 0.8)], {"fd": (Filter("object_filter", ("error",)),)})
    plan = next(p for p in plans if p.steps[0].prefix and p.steps[0].op == "fd")
    return engine.run(plan, query, frames).select("det_id", "id", "label", "score")


_PLAN_SQL = """with f(slot, text) as (values (0, '[faces_and((''error'', ''signup''))]'), (1, '[people]'), (2, '[object_filter(angry)]')),
alt(slot, n, op, cpu, gpu, sel) as (values
  (0, 0, 'fd', 4.0562::double, 2.7556::double, 0.5::double), (1, 0, 'odx', 10.2665, 1.0153, 0.2), (1, 1, 'od', 1.4944, 0.2632, 0.25),
  (1, 2, 'odn', 0.7115, 0.2065, 0.3), (2, 0, 'ed', 10.6612, 7.7553, 0.1), (2, 1, 'edc', 4.2685, 2.0679, 0.1)),
a as (select alt.*, op || text as step from alt join f using (slot)),
p as (
  select row_number() over (order by x.slot, y.slot, z.slot, x.n, y.n, z.n) - 1 as plan, x.step || '>' || y.step || '>' || z.step as steps,
         x.cpu as c1, y.cpu as c2, z.cpu as c3, x.gpu as g1, y.gpu as g2, z.gpu as g3, x.sel as s1, y.sel as s2
  from a x, a y, a z where x.slot <> y.slot and x.slot <> z.slot and y.slot <> z.slot)
"""


@_query("plan_enumeration", _PLAN_SQL + "select plan::int as plan, steps from p")
def plan_enumeration(spark, sf_dir):
    given = [h.equals("odx", "od"), h.equals("od", "odn"), h.equals("ed", "edc")]
    plans = enumerate_plans(angrybernie(), given)
    assert len(enumerate_plans(angrybernie(), given, distinct=False)) == plan_count(angrybernie(), given)
    return spark.createDataFrame([(i, p.key) for i, p in enumerate(plans)], "plan int, steps string")


# --- frames


def frames_of_table(spark, sf_dir, videos: int = 1) -> DataFrame:
    """As many synthetic frames as the detections have."""
    return frame_sources.synthetic_frames(spark, detections(spark, sf_dir).select("id").distinct().count(), videos=videos)


@_query("brightness")
def brightness(spark, sf_dir):
    return predictions.explode_structs(models.brightness(frames_of_table(spark, sf_dir)), "brightness", ["uri", "id"]).select("uri", "id", "label", "cls", "score")


@_query("motion")
def motion(spark, sf_dir):
    return models.motion(frames_of_table(spark, sf_dir, 2), segment=16)


@_query("frame_similarity")
def frame_similarity(spark, sf_dir):
    frames = frames_of_table(spark, sf_dir)
    target = frames.filter("id = 3").first()
    return models.similarity(frames, bytes(target.framebytes), target.width, target.height).select("uri", "id", "similarity")


@_query("frame_classes")
def frame_classes(spark, sf_dir):
    import numpy as np

    rng = np.random.default_rng(2)
    frames = models.classify(frames_of_table(spark, sf_dir), rng.normal(size=(192, 3)), np.zeros(3), ["car", "person", "dog"])
    return predictions.explode_structs(frames, "classes", ["uri", "id"]).select("uri", "id", "label", "cls", F.round("score", 9).alias("score"))


@_query("frame_embeddings")
def frame_embeddings(spark, sf_dir):
    return models.embed(frames_of_table(spark, sf_dir)).select("uri", "id", "img2vec")


@_query("plan_choice", _PLAN_SQL + """, t(x, y) as (values """ + ", ".join(f"({n}::double, {v}::double)" for n, v in TRANSFERS.items()) + """),
line as (select regr_slope(y, x) as m, regr_intercept(y, x) as b from t),
n as (select *, 3600.0::double as n1, 3600.0 * s1 as n2, 3600.0 * s1 * s2 as n3 from p),
costs as (
  select plan, steps, 'cpu' as platform, 0.00018::double as dollars, (c1 * n1 + c2 * n2 + c3 * n3) / 16 as cost from n
  union all
  select plan, steps, platform, dollars, (g1 * n1 + g2 * n2 + g3 * n3) / 16 + greatest(0, m * n1 + b) + greatest(0, m * n2 + b) + greatest(0, m * n3 + b)
  from n, line, (values ('t4', 0.00025::double), ('v100', 0.00067::double)) v(platform, dollars))
select platform, steps, round(cost, 6) as cost, round(cost * dollars, 9) as price from costs
qualify row_number() over (partition by platform order by round(cost * dollars, 12), plan) = 1""")
def plan_choice(spark, sf_dir):
    """The cheapest plan for the first built-in query by published latencies, on each platform."""
    from cuelight.plans.catalog import default_stats
    from cuelight.plans.cost import choose

    given = [h.equals("odx", "od"), h.equals("od", "odn"), h.equals("ed", "edc")]
    stats = default_stats({"fd": 0.5, "odx": 0.2, "od": 0.25, "odn": 0.3, "ed": 0.1, "edc": 0.1})
    plans = enumerate_plans(angrybernie(), given)
    best = [choose(plans, stats, 3600, target="cost", platforms=(on,)) for on in ("cpu", "t4", "v100")]
    return spark.createDataFrame([(c.platform, c.plan.key, round(c.cost, 6), round(c.price, 9)) for c in best], "platform string, steps string, cost double, price double")


@_query("track")
def track(spark, sf_dir):
    seen = objects(detections(spark, sf_dir)).withColumn("uri", F.concat(F.lit("cam"), (F.col("id") % 8).cast("string"))).drop("track")
    return models.track(seen).select("uri", "id", "det_id", "track")


@_query("action_clip", DET + """, f as (select distinct id from det),
n as (select id, (row_number() over (order by id) - 1) // 16 as clip from f)
select id, clip, case when clip % 3 = 0 then 'dunking' else 'standing' end as label from n""")
def action_clip(spark, sf_dir):
    frames = detections(spark, sf_dir).select("id", F.lit("video").alias("uri")).distinct()
    named = models.action_clips(frames, lambda c: c.withColumns({"label": F.when(F.col("clip") % 3 == 0, "dunking").otherwise("standing"), "score": F.lit(1.0)}))
    return named.select("id", "clip", "label")


@_query("global_row_number", DET + "select det_id, row_number() over (order by det_id) as pos from det")
def global_row_number(spark, sf_dir):
    return global_position(detections(spark, sf_dir), F.floor(F.col("det_id") / 1000), ["det_id"]).select("det_id", "pos")


@_query("windowed_counts", """select epoch(time_bucket(interval '1 hour', ts))::bigint as start, event_type as label, count(*) as n, round(avg(value / 100.0::double), 6) as mean_score
from events where ts is not null group by 1, 2""")
def windowed_counts(spark, sf_dir):
    from cuelight.streaming.detections import windowed_counts as counts

    df = table(spark, sf_dir, "events").select("ts", F.col("event_type").alias("label"), (F.col("value") / 100.0).alias("score"))
    return counts(df, width="1 hour").select(F.unix_timestamp("start").alias("start"), "label", "n", F.round("mean_score", 6).alias("mean_score"))
