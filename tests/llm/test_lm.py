"""Scores against a plain model in Python, over several blocks and ranges."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from cuelight.llm import lm, queries


def _plain(rows):
    def tokens(t):
        return [*(t or "").encode().lower().split(), None]

    held = [k is not None and zlib.crc32(str(k).encode()) % 5 == 1 for k, _ in rows]
    uni, bi, tri = Counter(), Counter(), Counter()
    for (_, t), h in zip(rows, held, strict=True):
        if not h:
            w = ["<s>", *tokens(t)]
            uni.update(w[1:])
            bi.update(zip(w, w[1:], strict=False))
            tri.update(zip(w, w[1:], w[2:], strict=False))
    n, v, texts = sum(uni.values()), len(uni), sum(not h for h in held)
    share = lambda order, c: lm.WEIGHT[order] * c / (c + lm.HALF[order])
    out = []
    for (k, t), h in zip(rows, held, strict=True):
        w = ["<s>", *tokens(t)]
        base = full = 0.0
        for i in range(1, len(w)):
            x, left = w[i], w[i - 1]
            p = (uni[x] + 0.5) / (n + 0.5 * (v + 1))
            base += math.log10(p)
            c = texts if i == 1 else uni[left]
            p = share(0, c) * bi[left, x] / max(c, 1) + (1 - share(0, c)) * p
            if i > 1:
                c = bi[w[i - 2], left]
                p = share(1, c) * tri[w[i - 2], left, x] / max(c, 1) + (1 - share(1, c)) * p
            full += math.log10(p)
        out.append((k, h, len(w) - 1, sum(uni[x] > 0 for x in w[1:]), n, round(base, 6), round(full, 6)))
    return sorted(out, key=str)


def _got(df):
    return sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in df.collect()), key=str)


@pytest.mark.parametrize("block,size", [(4_000_000, 1_000_000), (300, 50)])
def test_against_plain_model(spark, monkeypatch, block, size):
    monkeypatch.setattr(lm, "BLOCK", block)
    monkeypatch.setattr(lm, "RANGE", size)
    rng = random.Random(4)
    vocab = ["The", "of", "é", *[f"w{i}" for i in range(200)]]
    rows = [(i, " ".join(rng.choice(vocab[: rng.randint(3, 203)]) for _ in range(rng.randint(0, 40)))) for i in range(150)]
    rows += [(1000, None), (1001, ""), (None, "the of new"), (3, rows[3][1]), (1002, "x " * 40000)]
    df = spark.createDataFrame([(*r, 1.0, "x") for r in rows], "doc_id long, text string, score double, held string").repartition(3)
    assert _got(lm.score_texts(df)) == _plain(rows)


def test_few_rows(spark):
    df = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert lm.score_texts(df.limit(0)).count() == 0
    assert _got(lm.score_texts(df)) == _plain([(1, "a b")])


def test_held_out_documents_gain(spark):
    rows = [r for r in queries.op6_lm(spark, "/root/testdata/sf0.01").collect() if r.held_out]
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows) + 0.5 * sum(r.n_tokens for r in rows)


def test_states_and_failure_arcs():
    """Words a, b, c; seen: a b c twice from the start, b a once. Weights of arcs and failure arcs by hand."""
    words, pairs, triples = np.array([2, 3, 2]), np.array([2, 2, 2, 1]), np.array([2, 2, 0])
    link = np.array([-1, 0, 1, 1]), np.array([0, 1, 2, 0])  # <s> a, a b, b c, b a
    chain = np.array([0, 1, 1]), np.array([1, 2, 3])  # <s> a b, a b c, a b a (never seen)
    m = lm.Automaton(words, 2, pairs, triples, link, chain, 7, 3)
    root = (words + 0.5) / (7 + 0.5 * 4)
    first = lambda c, seen, rest: lm.WEIGHT[0] * c / (c + lm.HALF[0]) * seen / c + (1 - lm.WEIGHT[0] * c / (c + lm.HALF[0])) * rest
    second = lm.WEIGHT[1] * 2 / (2 + lm.HALF[1])
    start_a, a_b, b_a = first(2, 2, root[0]), first(2, 2, root[1]), first(3, 1, root[0])
    want = np.log10(start_a) + np.log10(second + (1 - second) * a_b) + np.log10(1 - second) + np.log10(b_a)
    assert abs(m.score(np.array([0, 1, 0]), np.array([0, 1, 3]), np.array([0, 0, 2])) - want) < 1e-12
    unseen = lm.Automaton(np.zeros(1), 0, np.zeros(1), np.zeros(1), (np.array([-1]), np.array([0])), (np.array([0]), np.array([0])), 0, 0)
    assert unseen.score(np.array([0]), np.array([0]), np.array([0])) == 0.0


def test_packed_numbers():
    rng = np.random.default_rng(1)
    for n in (0, 1, 1000):
        hashes = np.unique(rng.integers(0, 2**63, n).astype(np.uint64) * np.uint64(2))
        assert (lm.unpack_sorted(lm.pack_sorted(hashes)) == hashes).all()
        counts = rng.integers(0, 300, n) ** 2
        assert (lm.unpack_counts(lm.pack_counts(counts)) == counts).all()
