"""Hints, enumeration, cost and choice, and that every plan gives the same rows when models are exact."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cuelight.operators import filters as flt
from cuelight.plans import cost
from cuelight.plans import hints as h
from cuelight.plans.engine import Engine, Settings
from cuelight.plans.planner import Plan, Step, enumerate_plans, plan_count
from cuelight.plans.query import Filter, Query, Slot
from cuelight.sources.profiles import parse_profile


def _query(*ops):
    return Query("q", tuple(Slot(o, (Filter("quality_filter", (i / 10,)),)) for i, o in enumerate(ops)))


def test_conflicts():
    with pytest.raises(ValueError):
        h.validate([h.equals("a", "b"), h.superset("a", "b")])
    with pytest.raises(ValueError):
        h.validate([h.superset("a", "b"), h.proxy("b", "a", 0.5)])
    assert h.validate([h.equals("a", "b"), h.equals("b", "a")]) == (h.equals("a", "b"),)
    with pytest.raises(ValueError):
        h.proxy("a", "b", None)
    with pytest.raises(ValueError):
        enumerate_plans(_query("odx"), [h.superset("si", "odx")])


@pytest.mark.parametrize(
    "ops,given_hints,count",
    [
        (("fd", "odx", "ed"), [h.equals("odx", "od"), h.equals("od", "odn"), h.equals("ed", "edc")], 36),
        (("fd", "ad"), [], 2),
        (("ot", "svm"), [h.equals("ot", "od"), h.equals("od", "odn"), h.equals("svm", "bi"), h.superset("qcl", "ot")], 24),
        (("a", "g", "r"), [h.equals("a", "a2"), h.equals("g", "g2"), h.equals("r", "r2")], 48),
        (("fd", "odx", "ed"), [h.equals("odx", "od"), h.equals("od", "odn"), h.equals("ed", "edc"), h.superset("si", "odx"), h.proxy("ted", "ed", 0.8), h.proxy("tfd", "fd", 0.8), h.proxy("tod", "odx", 0.8)], 432),
    ],
)
def test_counts(ops, given_hints, count):
    q = _query(*ops)
    prefix = {x.left: (Filter("quality_filter", (0.5,)),) for x in given_hints if x.kind is not h.Kind.EQUALS}
    assert plan_count(q, given_hints) == count
    assert len(enumerate_plans(q, given_hints, prefix, distinct=False)) == count
    assert len({p.key for p in enumerate_plans(q, given_hints, prefix)}) == count


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("EP"), st.integers(0, 2), st.integers(3, 6)), max_size=5))
def test_count_formula(spec):
    q = _query("o0", "o1", "o2")
    made = [h.equals(f"o{a}", f"x{a}{b}") if k == "E" else h.proxy(f"p{b}", f"o{a}", 0.5) for k, a, b in spec]
    made = h.validate(made)
    prefix = {x.left: () for x in made if x.kind is h.Kind.PROXY}
    assert len(enumerate_plans(q, made, prefix, distinct=False)) == plan_count(q, made)


def test_barriers_and_needs():
    q = Query("q", (Slot("a"), Slot("b", (Filter("window_expand"),)), Slot("c", needs=("d",))))
    plans = enumerate_plans(q)
    assert [[s.op for s in p.steps] for p in plans] == [["a", "b", "d", "c"]]
    same = Query("q", (Slot("a", (Filter("x"),)), Slot("a", (Filter("y"),))))
    assert {str(p.steps[0]) for p in enumerate_plans(same)} == {"a[x&y]", "a[y&x]"}


def test_cost_and_choice():
    plan = Plan((Step("a", (), 0), Step("b", (), 1)))
    stats = cost.Stats({"a": 1.0, "b": 2.0}, {"a": 0.5, "b": 0.1})
    assert cost.plan_cost(plan, stats, 160) == 20
    other = Plan((Step("b", (), 1), Step("a", (), 0)))
    assert cost.plan_cost(other, stats, 160) == 21
    assert cost.choose([other, plan], stats, 160).plan is plan
    assert cost.choose([other, plan], stats, 160, prefer="max").plan is other
    assert cost.choose([plan, other], stats, 160, target="dollar", platforms=("cpu", "t4")).price == pytest.approx(20 * 0.00018)
    with pytest.raises(ValueError):
        cost.choose([plan], cost.Stats(stats.latency, stats.selectivity, f1={plan.key: 0.5}), 160)
    gpu = cost.Stats(stats.latency, stats.selectivity, {"a": 0.1, "b": "NOT_GPU_OP"}, lambda n: n / 1000)
    assert cost.plan_cost(plan, gpu, 160, "t4") == pytest.approx(0.16 + 1 + 10)
    assert cost.multiset_f1([1, 1, 2], [1, 2, 2, 3]) == pytest.approx((4 / 7, 0.5, 2 / 3))
    assert parse_profile('{"1": 2.5,\n}') == {"1": 2.5}


def test_prune():
    ranks = {"n": ("od", 0), "s": ("od", 1), "x": ("od", 2)}
    n, s, x = (Plan((Step(o, (), 0),)) for o in "nsx")
    assert cost.prune_by_rank([n, s, x], ranks, s) == [x]


def test_plans_agree(spark):
    rng = random.Random(1)
    rows = [(i // 4, rng.choice(["a", "b", "c"]), rng.random(), rng.randint(0, 40)) for i in range(400)]
    det = spark.createDataFrame(rows, "id long, label string, score double, cls int")
    table = lambda d: (lambda frames: d.join(frames, "id", "left_semi"))
    engine = Engine({n: table(det) for n in ("m1", "m1b", "m2", "m3", "pre")}, settings=Settings(selectivity_fraction=1.0))
    q = Query.from_json([{"model": "m1", "filters": [{"func": "faces_and", "args": [["a", "b"]]}]}, {"model": "m2", "filters": [{"func": "age_old_filter"}]}, {"model": "m3", "filters": [{"func": "object_filter", "args": ["c"]}]}])
    plans = engine.plans(q, [h.equals("m1", "m1b"), h.superset("pre", "m2")], {"pre": (Filter("age_old_filter", (10,)),)})
    frames = det.select("id").distinct()
    answers = {tuple(sorted(map(tuple, engine.run(p, q, frames).select("id", "label", "score").collect()))) for p in plans[:: max(1, len(plans) // 8)]}
    assert len(answers) == 1 and len(next(iter(answers))) > 0
    sel = engine.selectivity(plans[:2], frames)
    assert all(0 <= v <= 1 for v in sel.values())
    replayed = engine.run(plans[0], q, frames, replay={"m1": det})
    assert replayed.count() == len(next(iter(answers)))
    assert "m1" in engine.explain(plans[0], q, frames)
    truth = engine.run(plans[0], q, frames).select("id")
    assert engine.accuracy(plans[:1], q, frames, truth)[plans[0].key] == 1.0
    best = engine.best(q, cost.Stats({"m1": 1.0}, sel), 400)
    assert best.platform == "cpu"


def test_unknown_filter():
    with pytest.raises(ValueError):
        Query.from_json('[{"model": "m", "filters": [{"func": "nope"}]}]')


def test_proxy_split_keeps_nulls(spark):
    df = spark.createDataFrame([(1, 0.79), (2, 0.80), (3, None)], "id long, score double")
    low, high = flt.proxy_split(df, 0.8)
    assert {r.id for r in low.collect()} == {1, 3} and {r.id for r in high.collect()} == {2}


def test_catalog_and_records(spark):
    from cuelight.plans import catalog, records

    stats = catalog.default_stats({"od": 0.5})
    assert stats.latency["odx"] == 10.2665 and stats.gpu_latency["i2v"] == "NOT_GPU_OP"
    assert catalog.ranks()["odx"] == ("objects", 5) and set(catalog.LATENCIES) <= {e.name for e in catalog.OPERATORS.values()}
    line = catalog.transfer_line({0: 1.0, 10: 3.0})
    assert line(5) == pytest.approx(2.0) and line(-100) == 0
    plan = Plan((Step("od", (), 0), Step("odx", (), 1)))
    assert cost.plan_cost(plan, stats, 1600) == pytest.approx(149.44 + 513.325)
    assert '"platform": "t4"' in records.costs_as_json([plan], stats, 1600, ("cpu", "t4"))
    took = {}
    with records.timed(took, "run"):
        pass
    assert records.run_record(spark, took, {"query": "q"}).columns == ["query", "run_s"]
