"""Components against all pairs of a small table, and the sequential test's bounds."""

import random

import pytest

from cuelight.llm import near_dup as nd
from cuelight.llm import queries
from cuelight.llm.components import components
from cuelight.llm.store import Scratch


def _brute(rows, width, percent):
    sets = []
    for k, t in rows:
        w = nd.words_of(t)
        sets.append((k, frozenset(tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))) if w else frozenset()))
    parent = {k: k for k, _ in rows if k is not None}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = {}
    for k, s in sets:
        for g in s:
            holders.setdefault(g, []).append((k, s))
    for k, s in sets:
        for j, o in {id(o): (j, o) for g in s for j, o in holders[g]}.values():
            if k is not None and j is not None and j < k and 100 * len(s & o) >= percent * len(s | o):
                a, b = top(k), top(j)
                parent[max(a, b)] = min(a, b)
    return sorted((k, len(s), top(k) if k is not None else None, True if k is None else top(k) == k) for k, s in sets if k is not None) + [(None, len(s), None, True) for k, s in sets if k is None]


def _check(df, rows, width, percent):
    got = nd.near_duplicates(df, width=width, percent=percent).collect()
    key = lambda r: (r[0] is None, r)
    assert sorted(map(tuple, got), key=key) == sorted(_brute(rows, width, percent), key=key)


@pytest.mark.parametrize("block", [256, 4])
def test_against_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(nd, "BLOCK", block)
    monkeypatch.setattr(nd, "LARGE", block // 2)
    monkeypatch.setattr(nd, "SET_BLOCK", block // 2)
    monkeypatch.setattr(nd, "CHUNK", 50)
    rng = random.Random(7)
    vocab = [f"w{i}" for i in range(300)]
    rows, n = [], 0
    for _ in range(25):
        base = [rng.choice(vocab) for _ in range(rng.randint(5, 90))]
        for _ in range(rng.randint(1, 14)):
            t = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4, 8])):
                t[rng.randrange(len(t))] = rng.choice(vocab)
            rows.append((n, rng.choice(["  ", "\n", " "]).join(t).title()))
            n += 1
    rows += [(n, None), (n + 1, ""), (n + 2, " \t "), (n + 3, "one"), (n + 4, "ONE"), (n + 5, "x " * 30000), (None, "one"), (None, None)]
    df = spark.createDataFrame([(*r, 3, "c") for r in rows], "doc_id long, text string, key int, component string")
    _check(df, rows, 2, 80)
    if block == 256:
        _check(df, rows, 5, 80)


def test_empty(spark):
    df = spark.createDataFrame([(1, "a b"), (2, "c d")], "doc_id long, text string")
    assert nd.near_duplicates(df.limit(0)).count() == 0
    assert sorted(map(tuple, nd.near_duplicates(df).collect())) == [(1, 1, 1, True), (2, 1, 2, True)]


def test_documents(spark):
    import pyarrow.parquet as pq

    d = "/root/testdata/sf0.01"
    rows = [(r["doc_id"], r["text"]) for r in pq.read_table(f"{d}/documents.parquet").to_pylist()]
    assert sorted(map(tuple, queries.op4_near_dup(spark, d).collect())) == _brute(rows, 2, 80)


def test_bounds():
    tests = nd.least_matches(80)
    assert [n for n, _ in tests] == [30, 60, 90, 120, 150]
    assert all(0 < least < 0.8 * n for n, least in tests)


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(50, 120)] + [(200, i) for i in range(201, 260)] + [(rng.randint(300, 420), rng.randint(300, 420)) for _ in range(90)]
    parent = {v: v for e in edges for v in e}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = top(a), top(b)
        parent[max(a, b)] = min(a, b)
    got = components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "test")).collect()
    assert sorted(map(tuple, got)) == sorted((v, top(v)) for v in {v for e in edges if e[0] != e[1] for v in e})


def test_texts_that_share_a_key(spark):
    rng = random.Random(11)
    vocab = [f"v{i}" for i in range(400)]
    a, b = ([rng.choice(vocab) for _ in range(60)] for _ in range(2))
    rows = [(5, " ".join(a)), (5, " ".join(b)), (7, " ".join([*a, "x"])), (9, " ".join([*b, "y"])), (9, " ".join([*b, "y"])), (12, "alone"), (12, "other"), (3, None)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n_shingles int")
    _check(df, rows, 2, 80)
    got = {r.doc_id: r.component_id for r in nd.near_duplicates(df, width=2).collect()}
    assert got == {5: 5, 7: 5, 9: 5, 12: 12, 3: 3}
