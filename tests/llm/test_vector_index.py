"""Exact top-k against SQL and against a full product."""

import math

import numpy as np

from cuelight.llm import queries, vector_index

from .against_sql import same_rows


def test_against_sql(spark):
    same_rows(spark, "/root/testdata/sf0.01", queries.op8_top_k, queries.OP8_SQL)


def _brute(rows, k, every):
    ok = [(i, [math.floor(256 * x) for x in v], n) for n, (i, v) in enumerate(rows) if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, v, n in ok:
        if i % every == 0:
            s = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), j) for j, w, m in ok if m != n)[:k]
            out += [(i, r + 1, j, -x) for r, (x, j) in enumerate(s)]
    return sorted(out)


def test_against_full_product(spark, monkeypatch):
    monkeypatch.setattr(vector_index, "LARGEST", 16)
    monkeypatch.setattr(vector_index, "SMALLEST", 16)
    monkeypatch.setattr(vector_index, "QUERY_BLOCK", 8)
    monkeypatch.setattr(vector_index, "CHUNK_BYTES", 9000)
    monkeypatch.setattr(vector_index, "HITS", 20)
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(6, 8))
    rows = [(int(i), (centres[i % 6] + 0.1 * rng.normal(size=8)).tolist()) for i in range(300)]
    rows += [(1000 + i, rows[0][1]) for i in range(120)] + [(0, rows[0][1]), (5, None), (None, rows[1][1]), (10, [1.0, None]), (15, [float("nan")] * 8), (20, [float("inf")] * 8), (25, []), (30, [2.0, -1.0])]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, rank int, score string")
    got = sorted(map(tuple, vector_index.top_k(df, k=5, every=5).collect()))
    assert got == _brute(rows, 5, 5)


def test_few_rows(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [-2.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in vector_index.top_k(df, k=5, every=5).collect()] == [(0, 1, 1, -131072)]
    assert vector_index.top_k(df.limit(0), k=5, every=5).count() == 0
    assert vector_index.top_k(df.limit(1), k=5, every=5).count() == 0


def test_clustered_rows_are_pruned(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(40, 32))
    centres /= np.linalg.norm(centres, axis=1, keepdims=True)
    rows = [(i, ((1 + i % 3 / 10) * (centres[i % 40] + 0.02 * rng.normal(size=32))).tolist()) for i in range(4000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(map(tuple, vector_index.top_k(df, k=5, every=50).collect()))
    assert got == _brute_fast(rows, 5, 50)
    work = vector_index.top_k(df, k=5, every=50, scored=True).collect()
    assert len(work) == 80 and all(r.rows == 4000 for r in work)
    share = sum(r.scored for r in work) / sum(r.rows for r in work)
    assert share < 0.35


def _brute_fast(rows, k, every):
    ids, m = np.array([i for i, _ in rows]), np.floor(256 * np.array([v for _, v in rows]))
    out = []
    for n, i in enumerate(ids):
        if i % every == 0:
            s = m @ m[n]
            order = [j for j in np.lexsort((ids, -s)) if j != n][:k]
            out += [(int(i), r + 1, int(ids[j]), int(s[j])) for r, j in enumerate(order)]
    return sorted(out)


def test_components_of_any_size(spark):
    rng = np.random.default_rng(6)
    rows = [(i, [float(x) for x in rng.normal(size=3) * 10.0 ** rng.integers(-2, 9)]) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(map(tuple, vector_index.top_k(df, k=4, every=7).collect())) == [(a, b, c, max(-(2**63), min(2**63 - 1, s))) for a, b, c, s in _brute(rows, 4, 7)]
    huge = [*rows, (100, [1e300, 0.0, 0.0]), (101, [1e7, 2.0, 0.0])]
    got = vector_index.top_k(spark.createDataFrame(huge, df.schema), k=3, every=10).collect()
    assert len(got) == 3 * 7
    ends = {(r.query_id, r.rank): (r.vec_id, r.score) for r in got}
    positive = [i for i, v in rows if i % 10 == 0 and math.floor(256 * v[0]) > 0]
    assert positive and all(ends[i, 1] == (100, 2**63 - 1) for i in positive)
