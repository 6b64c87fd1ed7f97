"""Classifier accuracy, targets met by the rates, the fit against NumPy, and rows in and out."""

import numpy as np
import pytest

from cuelight.llm import mixing as m
from cuelight.llm import queries


@pytest.fixture(scope="module")
def fitted(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    model = m.fit_classifier(docs.join(labels.select("doc_id"), "doc_id").withColumnRenamed("lang", "domain"))
    return docs, model


def test_posteriors(fitted):
    docs, model = fitted
    assert model.domains == ["de", "en", "es", "fr"]
    rows = m.Mixture(model, [], [], []).rates(docs).collect()
    assert np.mean([model.domains[int(np.argmax(r.posterior))] == r.lang for r in rows]) > 0.95
    assert all(abs(sum(r.posterior) - 1) < 1e-9 and r.tokens == len(r.text.split()) for r in rows)


def test_targets_are_met(fitted):
    docs, model = fitted
    weights = {"en": 0.4, "fr": 0.1, "de": 0.3, "es": 0.2}
    mixture, rated = m.fit_rates(docs.select("doc_id", "text"), model, weights)
    rows = rated.collect()
    a = np.array([r.posterior for r in rows]) * np.array([r.tokens for r in rows])[:, None]
    got = a.T @ np.array([r.rate for r in rows])
    want = np.array([weights[d] for d in model.domains]) * a.sum()
    assert np.abs(got / want - 1).max() <= 1e-3
    assert min(r.rate for r in rows) >= 0 and np.allclose(got, mixture.reached)
    r = np.ones(len(rows))
    for _ in mixture.history:
        r = np.maximum(0, r - (a / a.sum(1, keepdims=True).clip(1e-12)) @ ((a.T @ r - want) / a.sum(0)))
    assert np.abs(np.array([x.rate for x in rows]) - r).max() < 1e-6
    mixed = m.mix(docs, mixture)
    assert mixed.columns == docs.columns
    back = m.Mixture(model, [], [], []).rates(mixed).collect()
    share = np.sum([np.array(x.posterior) * x.tokens for x in back], 0)
    assert np.abs(share / share.sum() - want / want.sum()).max() < 0.05
    plan = mixed._jdf.queryExecution().toString() + rated._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_odd_tables(spark, fitted):
    _, model = fitted
    odd = spark.createDataFrame([(None, None, 1.0, "a"), (1, "", 1.0, "b"), (1, "", 1.0, "b"), (2, "the of and " * 20000, 2.0, "c")], "doc_id long, text string, rate double, posterior string")
    mixture, rated = m.fit_rates(odd.select("doc_id", "text"), model, {"en": 1.0, "xx": 3.0})
    assert rated.count() == 4
    assert m.mix(odd, mixture).columns == odd.columns
    _, none = m.fit_rates(odd.select("doc_id", "text").limit(0), model, {"en": 1.0})
    assert none.count() == 0
    one = m.fit_classifier(odd.selectExpr("doc_id", "text", "'x' as domain").limit(0))
    assert one.domains == ["all"]
    _, all_rows = m.fit_rates(odd.select("doc_id", "text"), one, {"all": 1.0})
    assert {round(r.rate, 6) for r in all_rows.collect()} == {1.0}


def test_query(spark):
    d = "/root/testdata/sf0.01"
    rows = queries.op10_mixing(spark, d).collect()
    assert len(rows) == spark.read.parquet(f"{d}/documents.parquet").count()
    assert {f for r in rows for f in r.asDict()} == {"doc_id", "tokens", "domains", "posterior", "rate", "copies", "target_shares", "reached_shares"}
    assert max(abs(a - b) for a, b in zip(rows[0].target_shares, rows[0].reached_shares, strict=True)) < 0.01
