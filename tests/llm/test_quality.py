"""Co-training on documents with few labels, features of odd texts, rows in and out, and accuracy on labelled documents."""

import zlib

import numpy as np
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from cuelight.llm import quality as q
from cuelight.llm import queries


def test_features_of_odd_texts():
    for text in (None, "", " ", "x", "word " * 50000, "\n\n", "%%%", "é" * 9, "a\x00b", "!?"):
        for size in (-1.0, 0.0, 20000.0):
            got = q.features(text, size, 5.0)
            assert [len(g) for g in got] == [len(q.CONTENT), q.WORDS, len(q.FORM)] and all(np.isfinite(g).all() for g in got)
    assert str(q.features(None, 1.0, 2.0)) == str(q.features("", 1.0, 2.0))
    assert q.one_hot(np.array([-1, 3]), np.array([5, -1])).sum(1).tolist() == [1.0, 1.0]


def _rows(docs):
    bucket = lambda s, n: -1 if s is None else zlib.crc32(s.encode()) % n
    got = [q.features(r["text"], -1.0 if r["n_chars"] is None else r["n_chars"], 7.0) for r in docs]
    dense = [np.array([g[i] for g in got], np.float32) for i in range(3)]
    return q.Rows(*dense, np.array([bucket(r["lang"], q.LANGS) for r in docs]), np.array([bucket(r["source"], q.SOURCES) for r in docs]))


def test_exchange_helps_where_labels_are_few():
    """On documents of the corpus: 60 labels, the rest unlabelled; held-out labelled documents are judged."""
    d = "/root/testdata/sf0.1"
    truth = {r["doc_id"]: r["quality"] for r in pq.read_table(f"{d}/labels.parquet").to_pylist()}
    docs = [r for r in pq.read_table(f"{d}/documents.parquet").to_pylist() if r["doc_id"] % 2 or r["doc_id"] in truth]
    rows, y = _rows(docs), np.array([truth.get(r["doc_id"], -1) for r in docs])
    pool, labelled = q.HeldPool(rows.at(np.flatnonzero(y < 0))), np.flatnonzero(y >= 0)
    alone, both = [], []
    for seed in range(4):
        order = np.random.default_rng(seed).permutation(labelled)
        known, asked = order[:60], order[2000:]
        for rounds, into in ((0, alone), (q.ROUNDS, both)):
            m = q.co_train(rows.at(known), y[known].astype(float), np.arange(60) % 4, pool, rounds=rounds)
            if m.text is not None:
                own = m.meta.probability(*rows.at(asked).of("meta"))
                into.append([np.mean((m.views(rows.at(asked))[2] >= 0.5) == y[asked]), _order(own, y[asked])])
    alone, both = np.mean(alone, axis=0), np.mean(both, axis=0)
    assert both[0] > alone[0] + 0.01 and both[0] > 0.95
    assert both[1] > alone[1] + 0.01  # the metadata view learns from the content view


def _order(score, y):
    """Chance that a good row scores above a bad one."""
    good, bad = score[y == 1], score[y == 0]
    return float(np.mean((good[:, None] > bad[None, :]) + 0.5 * (good[:, None] == bad[None, :])))


def test_bars():
    counts = {-9: 2, -3: 5, 0: 80, 4: 10, 8: 3}
    bars = q.Bars.of(counts, 0.5)  # 15 of each class
    level = np.repeat(list(counts), list(counts.values()))
    got = bars.labels(level, np.linspace(0, 1, len(level), endpoint=False))
    assert (got[level < 0] == 0).all() and (got[level > 4] == 1).all() and (got[level == 4] == 1).all()
    assert 0 < (got[level == 0] == 0).sum() < 80


def test_rounds_cover_all_unlabelled_rows(spark, monkeypatch):
    """The stored pool counts and fetches what the same rows in memory give, whatever their partitions."""
    seen, plain = [], q.StoredPool.rows

    def rows(self, models, bars, part, turn):
        got = plain(self, models, bars, part, turn)
        table = self.table.orderBy("id").toPandas()
        held = q.HeldPool(q.Rows(*(np.array(table[c].tolist(), np.float32) for c in ("content", "words", "form")), table["lang"].to_numpy(), table["source"].to_numpy()))
        held.ids = table["id"].to_numpy()
        assert sorted(held.counts(models)) == sorted(self.counts(models))
        for (v, mine, label), (w, theirs, other) in zip(got, sorted(held.rows(models, bars, part, turn), key=lambda x: list(q._OTHER).index(x[0])), strict=True):
            assert v == w and np.array_equal(mine.content, theirs.content) and np.array_equal(label, other)
        seen.append((self.size, [len(x[2]) for x in got]))
        return got

    monkeypatch.setattr(q.StoredPool, "rows", rows)
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    free = docs.join(labels, "doc_id", "left_anti").count()
    q.fit(docs.repartition(5), labels, rounds=2)
    assert [s for s, _ in seen] == [free] * 2 and all(0.2 * free < n < 0.4 * free for _, two in seen for n in two)
    seen.clear()
    q.fit(docs, labels, rounds=1, taught=20)
    assert all(n < 60 for _, two in seen for n in two)


def test_query_accuracy(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet").withColumnRenamed("quality", "truth")
    model = q.fit(docs, labels.filter("doc_id % 3 <> 0"), label="truth")
    got = q.score(docs, model).join(labels.filter("doc_id % 3 = 0"), "doc_id").collect()
    assert np.mean([r.kept for r in got if r.truth == 1]) > 0.98
    assert np.mean([r.kept for r in got if r.truth == 0]) < 0.2


def test_rows(spark):
    d = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (-1, "", "xx", None, 0), (-1, "", "xx", None, 0)], docs.schema)
    both = docs.unionByName(odd).withColumn("quality", F.lit("x"))
    model = q.fit(docs, labels)
    assert q.score(both, model).count() == docs.count() + 3
    kept = q.keep_good(both, model)
    assert kept.columns == both.columns and kept.count() == q.score(both, model).filter("kept").count()
    assert q.score(docs.limit(0), model).count() == 0
    none = q.fit(docs, labels.limit(0))
    assert none.text is None and q.score(docs, none).select("quality").distinct().count() == 1
    assert queries.op2_quality(spark, d).count() == docs.count()
