"""Each stage of the pipeline against a plain version of its decision, on its own input."""

from collections import Counter

import pyarrow.parquet as pq
import pytest

import corpus_pipeline as p
from cuelight.llm import mixing, quality, toxicity
from cuelight.llm.queries import BYTE_BPE, TARGETS, domain_classifier
from cuelight.llm.store import Scratch, table

from .test_near_dup import _brute

D = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark):
    scratch, docs, out = Scratch(spark, "test"), table(spark, D, "documents"), []
    for name, stage in p.STAGES:
        got = scratch.table(stage(spark, docs, D), name)
        out.append((docs, got))
        docs = got
    return out


def _ids(df):
    return Counter(r.doc_id for r in df.select("doc_id").collect())


def test_columns(stages):
    assert [n for n, _ in p.STAGES] == ["quality", "toxicity", "near_dup", "mixing", "bpe"]
    for before, after in stages[:-1]:
        assert after.columns == before.columns


def test_quality(spark, stages):
    before, after = stages[0]
    model = quality.fit(before, table(spark, D, "labels"))
    assert _ids(after) == _ids(quality.score(before, model).filter(f"quality >= {p.LEAST_QUALITY}"))
    truth = {r.doc_id: r.quality for r in table(spark, D, "labels").collect()}
    kept = set(_ids(after))
    good, bad = [k in kept for k, v in truth.items() if v == 1], [k in kept for k, v in truth.items() if v == 0]
    assert sum(good) >= 0.97 * len(good) and sum(bad) <= 0.25 * len(bad)


def test_toxicity(spark, stages):
    before, after = stages[1]
    labels = table(spark, D, "labels").selectExpr("doc_id", "toxic as label")
    model = toxicity.fit(before.join(labels, "doc_id"), label="label")
    assert _ids(after) == _ids(toxicity.score(before, model).filter(f"score < {p.MOST_TOXIC}"))
    assert 0 < after.count() < before.count()


def test_near_duplicates(stages):
    before, after = stages[2]
    rows = [(r.doc_id, r.text) for r in before.collect()]
    assert _ids(after) == Counter(k for k, _, _, kept in _brute(rows, p.SHINGLE, p.SIMILAR) if kept)


def test_mixing(spark, stages):
    before, after = stages[3]
    model = domain_classifier(before, table(spark, D, "labels"))
    mixture, rated = mixing.fit_rates(before.select("doc_id", "text"), model, TARGETS)
    from pyspark.sql import functions as F

    want = {r.doc_id: r.n for r in rated.select("doc_id", mixing.copies(F.col("rate"), F.col("doc_id")).alias("n")).collect() if r.n}
    assert _ids(after) == Counter(want)


def test_ids(stages):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(BYTE_BPE)
    before, after = stages[4]
    texts = {r.doc_id: r.text for r in before.collect()}
    rows = after.collect()
    assert len(rows) == before.count() and all(r.lossless and r.n_tokens == len(r.input_ids) for r in rows)
    for r in rows[::7]:
        assert r.input_ids == lib.encode(texts[r.doc_id], add_special_tokens=False).ids


def test_odd_rows_and_run(spark, stages):
    docs = table(spark, D, "documents").limit(60)
    odd = spark.createDataFrame([(None, None, None, None, None), (None, "", None, "s", 3), (7, "a b c d e f", "en", "s", 11)], docs.schema)
    both = docs.unionByName(odd)
    for _, stage in p.STAGES:
        got = stage(spark, both, D)
        assert 0 < got.count() <= 3 * both.count()
        assert stage(spark, both.limit(0), D).count() == 0
    assert _ids(p.run(spark, D)) == _ids(stages[-1][1])
    assert len(pq.read_table(f"{D}/documents.parquet")) > p.run(spark, D).count() > 0
