"""Fingerprints against a plain version in Python, the order of documents, and all similar pairs."""

import hashlib
import random
import re

from cuelight.llm import queries
from cuelight.llm import spotsigs as s


def _chains(text):
    words = [w for w in re.split(r"[^\w]+|_", text.lower()) if w]
    anchors = set(s.ANCHORS)
    out = set()
    for i, w in enumerate(words):
        after = [x for x in words[i + 1 : i + 1 + s.SPAN] if x not in anchors][: s.CHAIN]
        if w in anchors and len(after) == s.CHAIN:
            out.add(("anchor", w, *after))
    many = sum(1 for i, w in enumerate(words) if w in anchors and len([x for x in words[i + 1 : i + 1 + s.SPAN] if x not in anchors]) >= s.CHAIN)
    if not words:
        return {("whole", text)}
    if many < s.FEW:
        out |= {("each", *words[i : i + s.CHAIN + 1]) for i in range(len(words))}
    return out


def _jaccard(a, b):
    return len(a & b) / len(a | b)


def _want(rows):
    out = []
    for i, (k, t) in enumerate(rows):
        t, nxt = t or "", rows[(i + 1) % len(rows)][1] or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + nxt[:half]
        out.append((k, len(t), hashlib.sha256(edited.encode()).hexdigest(), round(_jaccard(_chains(t), _chains(edited)), 9), round(_jaccard(_chains(t), _chains(nxt)), 9)))
    return out


def _got(df):
    rows = df.collect()
    return rows, sorted((r.doc_id, r.n_chars, r.edited_sha256, round(r.near_edited, 9), round(r.near_next, 9)) for r in rows)


def test_against_plain_version(spark, monkeypatch):
    monkeypatch.setattr(s, "RUN", 7)
    monkeypatch.setattr(s, "QUANTILES", 5)
    rng = random.Random(1)
    vocab = ["the", "of", "und", "é", "la", *[f"wörd{i}" for i in range(40)]]
    rows = [(i * i * 1000003, " ".join(rng.choice(vocab) for _ in range(rng.randint(0, 80))) + rng.choice(["", ".", " \U0001f600"])) for i in range(200)]
    rows += [(10**18, None), (10**18 + 1, ""), (10**18 + 2, "%% $$"), (10**18 + 3, "one"), (10**18 + 4, "the of " * 20000)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, n int, fingerprint string").repartition(5)
    out = s.edited_fingerprints(df)
    rows_out, got = _got(out)
    assert got == sorted(_want(rows))
    assert all(r.fingerprint and len(r.fingerprint) % 8 == 0 for r in rows_out)
    plan = out._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_documents(spark):
    import pyarrow.parquet as pq

    d = "/root/testdata/sf0.001"
    rows = sorted((r["doc_id"], r["text"]) for r in pq.read_table(f"{d}/documents.parquet").to_pylist())
    out, got = _got(queries.op9_fingerprints(spark, d))
    assert got == sorted(_want(rows))
    texts, prints = dict(rows), {}
    for r in out:
        assert prints.setdefault(texts[r.doc_id], r.fingerprint) == r.fingerprint


def test_few_and_repeated_rows(spark):
    one = spark.createDataFrame([(1, "the cat sat")], "doc_id long, text string")
    assert s.edited_fingerprints(one.limit(0)).count() == 0
    r = s.edited_fingerprints(one).first()
    assert r.near_next == 1.0 and r.n_chars == 11
    many = spark.createDataFrame([(1, "a b"), (1, "a b"), (1, "c d"), (None, "e f")], "doc_id long, text string")
    assert s.edited_fingerprints(many).count() == 4


def test_similar_pairs(spark):
    rng = random.Random(3)
    vocab = ["the", "of", *[f"w{i}" for i in range(60)]]
    rows = []
    for g in range(12):
        base = [rng.choice(vocab) for _ in range(60)]
        for _ in range(5):
            t = list(base)
            for _ in range(rng.choice([0, 1, 2, 6])):
                t[rng.randrange(60)] = rng.choice(vocab)
            rows.append((len(rows), " ".join(t)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    members, pairs = s.similar_pairs(df, 0.7)
    sets = {k: frozenset(_chains(t)) for k, t in rows}
    first = {}
    for k, v in sets.items():
        first.setdefault(v, k)
    assert sorted(map(tuple, members.collect())) == sorted((k, first[v]) for k, v in sets.items())
    reps = sorted(first.values())
    want = sorted((a, b, round(_jaccard(sets[a], sets[b]), 9)) for a in reps for b in reps if a < b and _jaccard(sets[a], sets[b]) >= 0.7)
    assert sorted((r.a, r.b, round(r.likeness, 9)) for r in pairs.collect()) == want


def test_next_rows_of_hot_and_missing_keys(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(s, "RUN", 5)
    rows = [(None, f"n{i}") for i in range(60)] + [(7, f"h{i}") for i in range(90)] + [(i, f"k{i}") for i in range(40)]
    df = spark.createDataFrame(rows, "key long, text string").withColumn("_tie", F.xxhash64("text"))
    got = {r.text: r.after for r in s.with_next(df, "key", {"after": "text"}).collect()}
    order = [r.text for r in sorted(df.collect(), key=lambda r: (r.key is not None, r.key or 0, r._tie))]
    assert got == dict(zip(order, [*order[1:], order[0]], strict=True))
