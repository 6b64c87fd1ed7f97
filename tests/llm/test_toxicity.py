"""Boosting and calibration on made data, features of odd texts, and held-out accuracy of the query."""

import numpy as np

from cuelight.llm import queries
from cuelight.llm import toxicity as t
from cuelight.llm.boosting import Isotonic, Logistic, Trees


def test_trees_and_calibration():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    trees = Trees().fit(x[:2000], y[:2000])
    assert ((trees.probability(x[2000:]) > 0.5) == y[2000:]).mean() > 0.97
    iso = Isotonic().fit(np.linspace(0, 1, 1000), (rng.random(1000) < np.linspace(0, 1, 1000) ** 2).astype(float))
    got = iso.probability(np.linspace(0, 1, 50))
    assert (np.diff(got) >= 0).all() and np.abs(got - np.linspace(0, 1, 50) ** 2).max() < 0.15
    line = Logistic().fit(x, (x[:, 2] + 0.1 * rng.normal(size=3000) > 0).astype(float))
    assert ((line.probability(x) > 0.5) == (x[:, 2] > 0)).mean() > 0.95
    assert Trees().fit(x[:0], y[:0]).probability(x[:3]).shape == (3,)


def test_obfuscation():
    reader = t.Reader(t.Lexicon(frozenset({"idiot"}), frozenset({"vequ"})))
    at = dict(zip(t.FEATURES, range(99), strict=False))
    for text in ("you IDIOT!", "an 1d10t", "i.d.i.o.t", "idiiiiot", "so i d i o t yes", "vequju", "V3qumo"):
        assert reader.features(text)[at["any count"]] >= 1, text
    for text in ("", None, "idiots x", "a i d", "vequ", "x" * 100000, "  !!!"):
        assert reader.features(text)[at["any count"]] == 0, text


def test_rows(spark):
    bad = [f"word{i} you {w} other{i} thing{i}" for i in range(60) for w in ("idiot", "loser")]
    good = [f"word{i} nice{i % 7} other{i} thing{i} you" for i in range(200)]
    rows = [(i, x, int(i < len(bad))) for i, x in enumerate(bad + good)]
    docs = spark.createDataFrame([(i, x, 0.5, 1) for i, x, _ in rows] + [(None, "a loser", 0.1, 2), (9000, None, 0.1, 2), (9001, "", 0.1, 2), (0, rows[0][1], 0.1, 1)], "doc_id long, text string, score double, toxic int")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    got = t.judge(docs.drop("toxic"), labels).collect()
    assert len(got) == len(rows) + 4
    by = {r.doc_id: r for r in got}
    assert np.mean([by[i].predicted == y for i, _, y in rows]) > 0.97
    assert by[None].held_out is False and by[9000].score == by[9001].score
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    one = t.judge(docs.drop("toxic"), labels.limit(0)).select("score").distinct().collect()
    assert len(one) == 1
    assert t.judge(docs.drop("toxic").limit(0), labels).count() == 0


def test_held_out(spark):
    d = "/root/testdata/sf0.1"
    got = queries.op5_toxicity(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").filter("held_out").collect()
    caught = [r.predicted for r in got if r.toxic]
    left = [r.predicted for r in got if not r.toxic]
    assert np.mean(caught) > 0.9 and np.mean(left) < 0.02


def test_rare_words_are_entries(spark):
    """The lexicon holds every unit that passes, however many frequent ones there are."""
    toxic = [f"common words here {i} vile{i % 40}xq {'abcdefgh'[i % 8]}end" for i in range(400)]
    clean = [f"common words here {i} and nothing else {i}" for i in range(400)]
    df = spark.createDataFrame([(x, 1) for x in toxic] + [(x, 0) for x in clean], "text string, label int")
    words = t.learn_lexicon(df).words
    assert {f"vile{i}xq" for i in range(40)} <= words and "common" not in words


def test_contradictory_labels(spark):
    df = spark.createDataFrame([(1, 0), (1, 1), (2, 0), (None, 1)], "doc_id long, toxic int")
    assert sorted(map(tuple, t.one_label(df).collect())) == [(1, 1), (2, 0)]
