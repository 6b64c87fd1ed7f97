"""Quality by co-training: a classifier of the text's content and one of the page's metadata teach each other.

The content view reads words and signs: shares of signs, capitals, repeats and the like, and hashed words. The metadata
view reads no word: recorded language, source and length, the length against what is usual for the source, and the page's
form (lines, how they begin and end, bytes a character, how far it can be compressed). Both start from the same labelled
rows. In each round either view scores all unlabelled rows; of those it is most sure of, relative to all others of their
class, it labels the EXCHANGED share, as many of each class as the labelled rows suggest, and hands them to the other
view, which learns from them beside the labelled rows. Every round picks anew. Afterwards each view is calibrated on
labelled rows that neither has learned from, and a logistic model on the two calibrated log-odds, fitted on the same
rows, gives the score.

Bounds: a classifier is fitted on at most about ``sample`` labelled rows (SAMPLE), chosen by the hash of their id, and
``taught`` pseudo-labelled rows (TAUGHT) for each view, chosen by hash among all rows that the round labels. Which rows
those are is decided over all unlabelled rows: their features are stored once, and a round is two narrow passes over
them, one that counts levels of confidence (a few thousand numbers for the driver) and one that fetches the sample. What
reaches the driver thus does not grow with the corpus. Every text is scored whole.

Defined results: null and empty texts are scored like any text without words, null metadata as a value of its own;
without labels, or with labels of one class, every score is the same; of contradictory labels of an id the lower counts;
rows without an id are scored. Other columns are carried by ``keep_good`` and never read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cuelight.llm.boosting import Isotonic, Logistic, Trees, logit
from cuelight.llm.labelled import bounded, share
from cuelight.llm.store import Scratch, in_worker

#: Labelled rows used, rounds, share of the unlabelled rows that a view labels in a round, those of them that the other view is fitted on, and their weight together against the labelled rows'.
SAMPLE, ROUNDS, EXCHANGED, TAUGHT, WEIGHT = 8_000, 4, 0.3, 4_000, 0.5
#: Buckets that languages, sources and words are hashed into; one part in FOLDS of the labelled rows calibrates the views.
LANGS, SOURCES, WORDS, FOLDS = 16, 64, 128, 4
#: Words whose number a worker keeps; others are looked at again.
KNOWN_WORDS = 200_000

CONTENT = ("capitals", "digits", "signs", "other signs", "spaces", "mean word", "long words", "short words", "distinct words", "same as before", "seen 2 before", "top word", "capital words", "words with inner signs", "words ending in signs", "lone signs", "loudest half")
FORM = ("recorded length", "length for its source", "lines", "characters a line", "spread of lines", "lines that end a sentence", "lines that begin with a capital", "distinct lines", "longest line", "bytes a character", "compressed")


class _Words(dict):
    """A word's bucket (7 bits), its sign, four marks (see ``_marks``) and its length, in one number."""

    def __missing__(self, word: str) -> int:
        h = zlib.crc32(word.lower().encode("utf-8", "replace"))
        value = len(word) << 12 | _marks(word) << 8 | (h >> 31) << 7 | h % WORDS
        if len(self) < KNOWN_WORDS:
            self[word] = value
        return value


def _marks(word: str) -> int:
    """Bits: capitals (1), signs inside (2), an unusual sign at the end (4), signs alone (8)."""
    capitals = word.isupper() and len(word) > 1
    if word.isalnum():
        return int(capitals)
    inside = len(word) > 2 and not word[1:-1].isalnum()
    ending = not word[-1].isalnum() and word[-1] not in ".,;:\"')"
    return capitals | inside << 1 | ending << 2 | (not any(map(str.isalnum, word))) << 3


_KNOWN = _Words()


def _bytes(*parts: bytes | range) -> np.ndarray:
    """A table that is true at the bytes of ``parts``."""
    out = np.zeros(256, bool)
    for part in parts:
        out[list(part)] = True
    return out


_UPPER, _LETTER, _DIGIT, _SPACE = _bytes(range(65, 91)), _bytes(range(65, 91), range(97, 123), range(195, 256)), _bytes(range(48, 58)), _bytes(b" \n\t")
_SIGN = _bytes(range(33, 48), range(58, 65), range(91, 97), range(123, 127))
_ODD_SIGN = _SIGN & ~_bytes(b".,'-\"")
_LOUD = _ODD_SIGN | _UPPER
#: Bytes counted at a time, which bounds the memory of a very long text.
_SPAN = 1 << 20


def features(text: str | None, size: float, usual: float) -> tuple[list[float], np.ndarray, list[float]]:
    """Content features, hashed words, and form features, over the whole of a text; a negative ``size`` is a null length."""
    text = text or ""
    raw = text.encode("utf-8", "replace")
    b = np.frombuffer(raw, np.uint8)
    n = max(1, len(b))
    of_byte = sum((np.bincount(b[i : i + _SPAN], minlength=256) for i in range(0, len(b), _SPAN)), np.zeros(256, np.int64))
    upper, letters, digits, spaces, signs, odd = (int(of_byte[t].sum()) for t in (_UPPER, _LETTER, _DIGIT, _SPACE, _SIGN, _ODD_SIGN))
    step = max(1, -(-len(b) // 8))
    loud = np.sort(np.add.reduceat(_LOUD[b], np.arange(0, len(b), step), dtype=np.int64) / step) if len(b) else np.zeros(1)
    words = text.split()
    m = max(1, len(words))
    distinct = list(dict.fromkeys(words))
    ids = dict(zip(distinct, range(len(distinct)), strict=True))
    w = np.fromiter(map(ids.__getitem__, words), np.int64, len(words))
    times = np.bincount(w, minlength=len(distinct))
    code = np.fromiter(map(_KNOWN.__getitem__, distinct), np.int64, len(distinct))
    sizes = code >> 12
    same = float((w[1:] == w[:-1]).mean()) if len(w) > 1 else 0.0
    second = float((w[2:] == w[:-2]).mean()) if len(w) > 2 else 0.0
    rates = [int(times[code & bit != 0].sum()) / m for bit in (256, 512, 1024, 2048)]
    content = [upper / max(1, letters), digits / n, signs / n, odd / n, spaces / n, int((sizes * times).sum()) / m, int(times[sizes > 14].sum()) / m, int(times[sizes < 3].sum()) / m, len(ids) / m, same, second, int(times.max(initial=0)) / m, *rates, float(loud[len(loud) // 2 :].mean())]
    hashed = np.bincount(code & 127, np.where(code & 128, 1, -1) * np.sqrt(times), WORDS) / np.sqrt(m)
    lines = [x for x in text.split("\n") if x.strip()] or [""]
    long = np.fromiter(map(len, lines), np.int64, len(lines))
    ends = sum(x.rstrip()[-1:] in (".", "!", "?", '"') for x in lines) / len(lines)
    begins = sum(x.lstrip()[:1].isupper() for x in lines) / len(lines)
    recorded = float(np.log1p(size)) if size >= 0 else -1.0
    form = [recorded, recorded - usual if size >= 0 else 0.0, float(np.log1p(len(lines))), float(np.log1p(long.mean())), float(long.std() / max(1.0, long.mean())), ends, begins, len(set(lines)) / len(lines), float(np.log1p(long.max())), len(raw) / max(1, len(text)), len(zlib.compress(raw, 1)) / n if raw else 1.0]
    return content, hashed, form


def one_hot(lang: np.ndarray, source: np.ndarray) -> np.ndarray:
    """One column for each language and source bucket (negative: null)."""
    out = np.zeros((len(lang), LANGS + SOURCES))
    for first, bucket in ((0, lang), (LANGS, source)):
        at = np.flatnonzero(bucket >= 0)
        out[at, first + bucket[at].astype(int)] = 1.0
    return out


@dataclass
class View:
    """Boosted trees over a view's dense features and the log-odds that a logistic model gives its coded ones.

    The trees learn from log-odds of a logistic model that has not seen the row (two halves teach each other's).
    """

    trees: Trees | None = None
    coded: Logistic | None = None

    def fit(self, dense: np.ndarray, coded: np.ndarray, y: np.ndarray, weight: np.ndarray) -> View:
        half = np.arange(len(y)) % 2 == 0
        told = np.zeros(len(y))
        for a, b in ((half, ~half), (~half, half)):
            if len(set(y[a].tolist())) == 2:
                told[b] = logit(Logistic(ridge=20.0).fit(coded[a], y[a], weight[a]).probability(coded[b]), 1e-3)
        self.coded = Logistic(ridge=20.0).fit(coded, y, weight)
        self.trees = Trees(rounds=50).fit(np.column_stack([dense, told]), y, weight)
        return self

    def probability(self, dense: np.ndarray, coded: np.ndarray) -> np.ndarray:
        if not len(dense):
            return np.zeros(0)
        return self.trees.probability(np.column_stack([dense, logit(self.coded.probability(coded), 1e-3)]))


@dataclass
class Rows:
    """Features of some rows: content, hashed words, form, and language and source as buckets."""

    content: np.ndarray
    words: np.ndarray
    form: np.ndarray
    lang: np.ndarray
    source: np.ndarray

    def of(self, view: str) -> tuple[np.ndarray, np.ndarray]:
        return (self.content, self.words) if view == "text" else (self.form, one_hot(self.lang, self.source))

    def at(self, where: np.ndarray) -> Rows:
        return Rows(*(a[where] for a in (self.content, self.words, self.form, self.lang, self.source)))

    def __len__(self) -> int:
        return len(self.content)


@dataclass
class Model:
    text: View | None
    meta: View | None
    text_calibration: Isotonic | None
    meta_calibration: Isotonic | None
    combine: Logistic | None
    rate: float
    usual: dict[int, float]

    def views(self, rows: Rows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Calibrated probability of good quality by content, by metadata, and by both."""
        if self.text is None or not len(rows):
            return (np.full(len(rows), self.rate),) * 3
        p = self.text_calibration.probability(self.text.probability(*rows.of("text")))
        q = self.meta_calibration.probability(self.meta.probability(*rows.of("meta")))
        return p, q, self.combine.probability(np.column_stack([logit(p, 1e-3), logit(q, 1e-3)]))


#: Steps of the log-odds that confidence is counted in.
_STEPS = 64
_OTHER = {"text": "meta", "meta": "text"}


def _levels(p: np.ndarray) -> np.ndarray:
    return np.rint(_STEPS * logit(p, 1e-9)).astype(np.int64)


@dataclass(frozen=True)
class Bars:
    """The level up to which a view labels rows as bad and the one from which as good, with the share taken at each."""

    low: int
    low_share: float
    high: int
    high_share: float

    @staticmethod
    def of(counts: dict[int, int], good: float) -> Bars:
        """For the EXCHANGED share of the rows, split as the labelled rows are."""
        size = sum(counts.values())

        def edge(levels: list[int], want: float) -> tuple[int, float]:
            for level in levels:
                if counts[level] >= want:
                    return level, want / counts[level]
                want -= counts[level]
            return levels[-1] if levels else 0, 1.0

        up = sorted(counts)
        return Bars(*edge(up, EXCHANGED * size * (1 - good)), *edge(up[::-1], EXCHANGED * size * good))

    def labels(self, level: np.ndarray, draw: np.ndarray) -> np.ndarray:
        """1, 0 or -1 (none) for each row; ``draw`` settles rows at a bar's own level."""
        good = (level > self.high) | ((level == self.high) & (draw < self.high_share))
        bad = (level < self.low) | ((level == self.low) & (draw < self.low_share))
        return np.where(bad & ~good, 0, np.where(good & ~bad, 1, -1))


def _draw(ids: np.ndarray, salt: int) -> np.ndarray:
    h = (ids.astype(np.uint64) ^ np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)
    return ((h ^ (h >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(40)) / 2.0**24


def _counted(rows: Rows, models: dict[str, View]) -> list[tuple[str, int, int]]:
    """The view that judges, level and number of rows."""
    out = []
    for view, model in models.items():
        out += [(view, int(v), int(n)) for v, n in zip(*np.unique(_levels(model.probability(*rows.of(view))), return_counts=True), strict=True)]
    return out


def _chosen(ids: np.ndarray, rows: Rows, models: dict[str, View], bars: dict[str, Bars], part: float, turn: int) -> list[tuple[str, np.ndarray, np.ndarray]]:
    """The view that is taught, the places of the rows it is fitted on, and their labels; ``part`` of the labelled ones."""
    out = []
    for view, model in models.items():
        label = bars[view].labels(_levels(model.probability(*rows.of(view))), _draw(ids, 1))
        at = np.flatnonzero((label >= 0) & (_draw(ids, 2 + turn) < part))
        out.append((_OTHER[view], at, label[at].astype(float)))
    return out


class HeldPool:
    """Unlabelled rows in memory."""

    def __init__(self, rows: Rows):
        self.size, self.held, self.ids = len(rows), rows, np.arange(len(rows)) * 7919 + 1

    def counts(self, models: dict[str, View]) -> list[tuple[str, int, int]]:
        return _counted(self.held, models)

    def rows(self, models: dict[str, View], bars: dict[str, Bars], part: float, turn: int) -> list[tuple[str, Rows, np.ndarray]]:
        return [(view, self.held.at(at), label) for view, at, label in _chosen(self.ids, self.held, models, bars, part, turn)]


def co_train(rows: Rows, y: np.ndarray, fold: np.ndarray, pool: HeldPool | StoredPool, usual: dict[int, float] | None = None, rounds: int | None = None, taught: int | None = None) -> Model:
    """Fit both views on the rows with fold > 0, exchanging pseudo-labels on the pool; calibrate on fold 0."""
    rate, usual = float((y.sum() + 0.5) / (len(y) + 1)), usual or {}
    learn, check = fold > 0, fold == 0
    if len(set(y[learn].tolist())) < 2 or len(set(y[check].tolist())) < 2:
        return Model(None, None, None, None, None, rate, usual)
    known, good = rows.at(learn), float(y[learn].mean())
    most = TAUGHT if taught is None else taught
    part = min(1.0, most / max(1.0, EXCHANGED * pool.size))
    lessons: dict[str, tuple[Rows, np.ndarray]] = {}

    def fitted(view: str) -> View:
        dense, coded = known.of(view)
        target, weight = y[learn], np.ones(int(learn.sum()))
        if view in lessons and len(lessons[view][1]):
            more, label = lessons[view]
            each = min(1.0, WEIGHT * len(target) / len(label)) if len(label) > len(target) else WEIGHT
            other_dense, other_coded = more.of(view)
            dense, coded = np.vstack([dense, other_dense]), np.vstack([coded, other_coded])
            target, weight = np.concatenate([target, label]), np.concatenate([weight, np.full(len(label), each)])
        return View().fit(dense, coded, target, weight)

    models = {view: fitted(view) for view in _OTHER}
    for turn in range((ROUNDS if rounds is None else rounds) if pool.size else 0):
        levels: dict[str, dict[int, int]] = {view: {} for view in _OTHER}
        for view, level, n in pool.counts(models):
            levels[view][level] = levels[view].get(level, 0) + n
        bars = {view: Bars.of(counts, good) for view, counts in levels.items()}
        lessons = {view: (more, label) for view, more, label in pool.rows(models, bars, part, turn)}
        models = {view: fitted(view) for view in _OTHER}
    checked = rows.at(check)
    p, q = (models[v].probability(*checked.of(v)) for v in ("text", "meta"))
    text_calibration, meta_calibration = Isotonic().fit(p, y[check]), Isotonic().fit(q, y[check], prior=5.0)
    both = np.column_stack([logit(text_calibration.probability(p), 1e-3), logit(meta_calibration.probability(q), 1e-3)])
    return Model(models["text"], models["meta"], text_calibration, meta_calibration, Logistic(ridge=1.0).fit(both, y[check]), rate, usual)


def _columns() -> dict[str, Column]:
    """The text and the three pieces of metadata: hashed language and source (-1: null), recorded length (-1: null)."""

    def bucket(name: str, n: int) -> Column:
        return F.when(F.col(name).isNull(), -1).otherwise(F.pmod(F.xxhash64(F.col(name), F.lit(name)), F.lit(n))).cast("int")

    return {"text": F.col("text").cast("string"), "lang": bucket("lang", LANGS), "source": bucket("source", SOURCES), "size": F.coalesce(F.col("n_chars").cast("double"), F.lit(-1.0))}


def _prepared(docs: DataFrame, key: str) -> DataFrame:
    return docs.select(F.col(key).alias("key"), *[c.alias(n) for n, c in _columns().items()])


def usual_lengths(docs: DataFrame) -> dict[int, float]:
    """Median log length of each source bucket (-1: null), and of all as -2: at most SOURCES + 2 numbers."""
    own = _columns()
    rows = docs.select(own["source"].alias("source"), F.log1p(own["size"]).alias("size")).filter("size >= 0")
    median = F.percentile_approx("size", 0.5, 1000).alias("m")
    out = {r.source: float(r.m) for r in rows.groupBy("source").agg(median).collect()}
    total = rows.agg(median).first().m
    return out | {-2: float(total or 0.0)}


def _batch_rows(text: pa.Array, lang: pa.Array, source: pa.Array, size: pa.Array, usual: dict[int, float]) -> Rows:
    langs, sources = lang.to_numpy(zero_copy_only=False), source.to_numpy(zero_copy_only=False)
    got = [features(t.as_py(), s, usual.get(k, usual.get(-2, 0.0))) for t, s, k in zip(text, size.to_pylist(), sources.tolist(), strict=True)]
    n = len(got)
    return Rows(np.array([g[0] for g in got], np.float32).reshape(n, len(CONTENT)), np.array([g[1] for g in got], np.float32).reshape(n, WORDS), np.array([g[2] for g in got], np.float32).reshape(n, len(FORM)), langs, sources)


_STORED = "content array<float>, words array<float>, form array<float>, lang int, source int"


def _measured(rows: DataFrame, usual: dict[int, float]) -> DataFrame:
    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        in_worker("quality", _KNOWN.clear)
        for b in parts:
            r = _batch_rows(b.column(1), b.column(2), b.column(3), b.column(4), usual)
            lists = [pa.array(list(a), pa.list_(pa.float32())) for a in (r.content, r.words, r.form)]
            yield pa.RecordBatch.from_arrays([b.column(0), *lists, b.column(2), b.column(3)], ["key", "content", "words", "form", "lang", "source"])

    kind = rows.schema["key"].dataType.simpleString()
    return rows.select("key", "text", "lang", "source", "size").mapInArrow(batches, f"key {kind}, {_STORED}")


def _stored_rows(b: pa.RecordBatch, first: int) -> Rows:
    dense = [b.column(first + i).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, n) for i, n in enumerate((len(CONTENT), WORDS, len(FORM)))]
    return Rows(*dense, b.column(first + 3).to_numpy(zero_copy_only=False), b.column(first + 4).to_numpy(zero_copy_only=False))


class StoredPool:
    """All unlabelled rows, as a stored table of id and features."""

    def __init__(self, table: DataFrame):
        self.table, self.size = table, table.count()

    def counts(self, models: dict[str, View]) -> list[tuple[str, int, int]]:
        shared = self.table.sparkSession.sparkContext.broadcast(models)

        def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in parts:
                got = list(zip(*_counted(_stored_rows(b, 1), shared.value), strict=True)) or [(), (), ()]
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(got, (pa.string(), pa.int32(), pa.int64()), strict=True)], ["view", "level", "n"])

        rows = self.table.mapInArrow(batches, "view string, level int, n long").groupBy("view", "level").sum("n").collect()
        shared.destroy()
        return [tuple(r) for r in rows]

    def rows(self, models: dict[str, View], bars: dict[str, Bars], part: float, turn: int) -> list[tuple[str, Rows, np.ndarray]]:
        shared = self.table.sparkSession.sparkContext.broadcast((models, bars))
        schema = f"view string, id long, label int, {_STORED}"

        def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in parts:
                ids = b.column(0).to_numpy(zero_copy_only=False)
                for view, at, label in _chosen(ids, _stored_rows(b, 1), *shared.value, part, turn):
                    some = b.take(pa.array(at))
                    yield pa.RecordBatch.from_arrays([pa.array([view] * len(at), pa.string()), some.column(0), pa.array(label, pa.int32()), *some.columns[1:]], ["view", "id", "label", "content", "words", "form", "lang", "source"])

        found = self.table.mapInArrow(batches, schema).toArrow()  # about TAUGHT rows a view
        shared.destroy()
        out = []
        for view in _OTHER:
            own = found.filter(pa.compute.equal(found.column("view"), view)).sort_by([("id", "ascending")]).combine_chunks()
            parts = own.to_batches()
            b = parts[0] if parts else pa.RecordBatch.from_pylist([], schema=found.schema)
            out.append((view, _stored_rows(b, 3), b.column(2).to_numpy(zero_copy_only=False).astype(float)))
        return out


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "quality", sample: int = SAMPLE, taught: int = TAUGHT, rounds: int | None = None) -> Model:
    """A model from a bounded sample of labelled and all unlabelled rows of ``docs`` (doc columns as in the documents table)."""
    known = labels.select(F.col(key).alias("key"), F.col(label).cast("int").alias("label")).filter("key is not null and label in (0, 1)").groupBy("key").agg(F.min("label").alias("label"))
    scratch = Scratch(docs.sparkSession, "quality")
    usual = usual_lengths(docs)
    measured = _measured(_prepared(docs, key).filter("key is not null"), usual)
    rows = scratch.table(measured.join(known, "key", "left"), "measured")
    some = bounded(rows.filter("label is not null"), "key", sample, "quality").withColumn("fold", F.floor(share(F.col("key"), "quality-fold") * FOLDS).cast("int"))
    got = some.select("fold", "label", "content", "words", "form", "lang", "source").toArrow().sort_by([("fold", "ascending"), ("label", "ascending")]).to_pylist()
    got.sort(key=lambda r: (r["fold"], r["label"], r["content"], r["form"], r["lang"], r["source"]))
    n = len(got)
    held = Rows(*(np.array([r[c] for r in got], np.float32).reshape(n, k) for c, k in (("content", len(CONTENT)), ("words", WORDS), ("form", len(FORM)))), *(np.array([r[c] for r in got], int) for c in ("lang", "source")))
    pool = StoredPool(rows.filter("label is null").select(F.xxhash64("key", F.lit("quality-pool")).alias("id"), "content", "words", "form", "lang", "source"))
    model = co_train(held, np.array([r["label"] for r in got], float), np.array([r["fold"] for r in got], int), pool, usual, rounds, taught)
    scratch.drop(rows)
    return model


def score(docs: DataFrame, model: Model, key: str = "doc_id", threshold: float = 0.5) -> DataFrame:
    """key, text_score, meta_score, quality (probability of label 1) and kept of every row, by a narrow pass."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        in_worker("quality", _KNOWN.clear)
        for b in parts:
            p, q, r = shared.value.views(_batch_rows(*b.columns[1:5], shared.value.usual))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(v, pa.float64()) for v in (p, q, r)), pa.array(r >= threshold)], ["key", "text_score", "meta_score", "quality", "kept"])

    rows = _prepared(docs, key)
    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(batches, f"key {kind}, text_score double, meta_score double, quality double, kept boolean").withColumnRenamed("key", key)


def keep_good(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose quality reaches the threshold, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    width = len(docs.columns)
    own = [f"_{i}" for i in range(width)]
    rows = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, own, strict=True)], *[c.alias(f"of_{n}") for n, c in _columns().items()])

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        in_worker("quality", _KNOWN.clear)
        for b in parts:
            _, _, quality = shared.value.views(_batch_rows(*b.columns[width : width + 4], shared.value.usual))
            kept = b.filter(pa.array(quality >= threshold))
            yield pa.RecordBatch.from_arrays(kept.columns[:width], own)

    schema = T.StructType([T.StructField(n, f.dataType) for n, f in zip(own, docs.schema.fields, strict=True)])
    return rows.mapInArrow(batches, schema).toDF(*docs.columns)
