"""The encoder against the tokenizers library, and the segment tree against a plain scan."""

import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cuelight.llm import bpe
from cuelight.llm.queries import BYTE_BPE

ODD = ["", " ", "\n\n  x", "a\x1c\x1d b", "it's  they'll <|endoftext|> x<|endoftext|>", "日本語 テスト", "a" * 5000, "ab " * 300, "é́   x  y", "'s's", "1 22  333\t4", "\U0001f600 \U0001f468‍\U0001f469", "\x85 x﻿ y", "²³ Ⅷ x_y"]


@pytest.fixture(scope="module")
def both():
    from tokenizers import Tokenizer

    with open(BYTE_BPE, encoding="utf-8") as f:
        return Tokenizer.from_file(BYTE_BPE), bpe.Codec(f.read())


def test_odd_texts(both):
    lib, own = both
    for t in ODD:
        ids = lib.encode(t, add_special_tokens=False).ids
        assert own.encode(t) == ids, t
        assert own.decode(ids) == lib.decode(ids, skip_special_tokens=False), t


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text(both, t):
    lib, own = both
    ids = lib.encode(t, add_special_tokens=False).ids
    assert own.encode(t) == ids
    assert own.decode(ids) == lib.decode(ids, skip_special_tokens=False) == t


def test_cut_ids_decode_alike(both):
    lib, own = both
    ids = lib.encode("日本語\U0001f600é", add_special_tokens=False).ids
    for a in range(len(ids)):
        for b in range(a, len(ids) + 1):
            assert own.decode(ids[a:b]) == lib.decode(ids[a:b], skip_special_tokens=False)


def test_tree_against_scan():
    rng = random.Random(5)
    for _ in range(300):
        ranks = {}
        for r in range(rng.randint(0, 12)):
            ranks.setdefault((rng.randint(0, 5), rng.randint(0, 5)), (r, rng.randint(0, 5)))
        seq = [rng.randint(0, 3) for _ in range(rng.randint(0, 20))]
        want = list(seq)
        while True:
            best = min(((ranks[p][0], i) for i, p in enumerate(zip(want, want[1:], strict=False)) if p in ranks), default=None)
            if best is None:
                break
            i = best[1]
            want[i : i + 2] = [ranks[want[i], want[i + 1]][1]]
        assert bpe.merge_symbols(list(seq), ranks) == want


def test_rows(spark, both):
    lib, _ = both
    rows = [(1, "it's a test", 5), (1, "it's a test", 6), (None, None, 7), (3, "", 8), (4, "x" * 70000, 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    got = bpe.round_trip_digests(df, BYTE_BPE).collect()
    assert len(got) == 5
    for r, (k, t, _) in zip(sorted(got, key=lambda r: r.doc_id or 0), sorted(rows, key=lambda r: r[0] or 0), strict=True):
        ids = lib.encode(t or "", add_special_tokens=False).ids
        assert (r.doc_id, r.n_tokens) == (k, len(ids))
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    assert bpe.round_trip_digests(df.limit(0), BYTE_BPE).count() == 0
    checked = bpe.encode_checked(df.withColumnRenamed("n_tokens", "lossless"), BYTE_BPE).collect()
    assert all(r.lossless and r.input_ids == lib.encode(r.text or "", add_special_tokens=False).ids for r in checked) and len(checked) == 5
    back = bpe.decode(bpe.encode(df, BYTE_BPE), BYTE_BPE).collect()
    assert {(r.text or "") == r.decoded for r in back} == {True}


def test_names_that_are_taken(spark):
    df = spark.createDataFrame([("a b", 1)], "text string, input_ids int")
    assert bpe.encode(df, BYTE_BPE).columns == ["text", "input_ids"] and len(bpe.encode(df, BYTE_BPE).first().input_ids) == 2
    assert bpe.encode(df, BYTE_BPE, out="ids").columns == ["text", "input_ids", "ids"]
