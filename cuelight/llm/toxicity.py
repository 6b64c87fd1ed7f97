"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

The lexicon is learned: words, and beginnings of words, that stand in labelled toxic texts far more often than in the
others and in many different surroundings (so that copies of one text do not put their words into it). Features are
lexicon densities, nearness to words of the second person, and rates of capitals, punctuation and obfuscation. Trees are
fitted on one part of the sample and calibrated on another.

Bounds: at most about ``sample`` labelled rows (SAMPLE) are used, chosen by the hash of their id; they are fetched once
and stored. The lexicon holds every unit of them that passes the tests. Every text is scored whole. Defined results: null and empty texts get a score like any text without words;
unlabelled data, or labels of one class, give a constant score; of contradictory labels of an id the higher counts; rows without an id are scored and count as not held out.
Ids, languages, sources and labels are no features.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuelight.llm.boosting import Isotonic, Trees
from cuelight.llm.labelled import bounded, crc_remainder, share
from cuelight.llm.store import Scratch, in_worker

#: Labelled rows used, least toxic texts and surroundings of an entry of the lexicon, least ratio of its rates.
SAMPLE, LEAST_TEXTS, LEAST_AROUND, LEAST_RATIO = 12_000, 3, 5, 12.0
#: Lengths of beginnings of words that may become entries.
BEGINNINGS = range(4, 8)
#: Words on either side in which a word of the second person counts as near.
NEAR = 5
#: Words a worker keeps the codes of at most; others are computed again.
KNOWN_WORDS = 150_000
#: Words of the second person in the languages of the corpus.
SECOND_PERSON = set("you your yours yourself yourselves u ur du dich dir dein deine deinen ihr euch euer sie tu te toi ton ta tes vous votre vos tú ti tuyo usted ustedes vosotros".split())
#: Signs that stand for letters.
SIGNS = str.maketrans("013457@$!|", "oieastasil")

_EDGES = re.compile(r"^[\W_]+|[\W_]+$")
_INNER = re.compile(r"[\W_]+")
_RUNS = re.compile(r"(.)\1{2,}")
FEATURES = ("word density", "word count", "beginning density", "beginning count", "hidden density", "any count", "near second person", "second person rate", "capitals", "exclamations", "punctuation", "obfuscation", "digits", "log words", "capital words", "most in 50 words")
WORD, BEGINNING, HIDDEN, SECOND, ODD, SINGLE, LOUD = 1, 2, 4, 8, 16, 32, 64


def plain(token: str) -> str:
    """A token in lower case without the signs at its ends."""
    return _EDGES.sub("", token).lower()


def uncovered(token: str) -> str:
    """A token with look-alike signs turned into letters, inner signs dropped and stretched letters shortened."""
    core = token.strip(".,;:?\"'()[]{}%&*#").lower().translate(SIGNS)
    return _RUNS.sub(r"\1", _INNER.sub("", core))


@dataclass
class Lexicon:
    words: frozenset[str]
    beginnings: frozenset[str]

    def holds(self, word: str) -> int:
        code = WORD if word in self.words else 0
        if any(word[:n] in self.beginnings for n in BEGINNINGS if len(word) > n):
            code |= BEGINNING
        return code


class Reader(dict):
    """Feature vectors of texts under one lexicon; the dict holds the codes of known tokens."""

    def __init__(self, lexicon: Lexicon):
        super().__init__()
        self.lexicon = lexicon

    def __missing__(self, token: str) -> int:
        word = plain(token)
        code = self.lexicon.holds(word) | (SECOND if word in SECOND_PERSON else 0)
        if word and (_INNER.search(word) or any(c.isdigit() for c in word) and any(c.isalpha() for c in word)):
            code |= ODD
        if not code & (WORD | BEGINNING):
            open_word = uncovered(token)
            if open_word != word and len(open_word) > 2 and self.lexicon.holds(open_word):
                code |= HIDDEN
        if len(word) == 1 and word.isalpha():
            code |= SINGLE
        if len(word) > 2 and token.isupper():
            code |= LOUD
        if len(self) < KNOWN_WORDS:
            self[token] = code
        return code

    def features(self, text: str | None) -> list[float]:
        text = text or ""
        tokens = text.split()
        n = len(tokens)
        codes = np.fromiter(map(self.__getitem__, tokens), np.uint8, n)
        single = np.flatnonzero(codes & SINGLE)
        if len(single) >= 3:  # letters written apart
            for run in np.split(single, np.flatnonzero(np.diff(single) != 1) + 1):
                if len(run) >= 3 and self.lexicon.holds("".join(plain(tokens[i]) for i in run)):
                    codes[run[0]] |= HIDDEN
        raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
        upper, lower = int(((raw >= 65) & (raw <= 90)).sum()), int(((raw >= 97) & (raw <= 122)).sum())
        loud, signs, digits = int((raw == 33).sum()), int((((raw >= 33) & (raw <= 47)) | ((raw >= 58) & (raw <= 64))).sum()), int(((raw >= 48) & (raw <= 57)).sum())
        word, begin, hidden = (int(((codes & b) > 0).sum()) for b in (WORD, BEGINNING, HIDDEN))
        hits, second = np.flatnonzero(codes & (WORD | BEGINNING | HIDDEN)), np.flatnonzero(codes & SECOND)
        near = 0.0
        if len(hits) and len(second):
            k = np.searchsorted(second, hits)
            gap = np.minimum(np.abs(hits - second[np.clip(k, 0, len(second) - 1)]), np.abs(hits - second[np.clip(k - 1, 0, len(second) - 1)]))
            near = float((gap <= NEAR).mean())
        most = float((np.searchsorted(hits, hits + 50) - np.arange(len(hits))).max()) if len(hits) else 0.0
        m = max(1, n)
        odd, capital = int(((codes & ODD) > 0).sum()), int(((codes & LOUD) > 0).sum())
        return [word / m, float(word), begin / m, float(begin), hidden / m, float(len(hits)), near, len(second) / m, upper / max(1, upper + lower), loud / m, signs / max(1, len(raw)), odd / m, digits / max(1, len(raw)), float(np.log1p(n)), capital / m, most]


def _units(text: str | None) -> dict[tuple[bool, str], int]:
    """(whole word?, unit) -> mask of 64 bits with one for each surrounding, for all units of a text."""
    words = [w for w in map(plain, (text or "").split()) if w]
    out: dict[tuple[bool, str], int] = defaultdict(int)
    for i, w in enumerate(words):
        around = f"{words[i - 1] if i else ''} {words[i + 1] if i + 1 < len(words) else ''}"
        bit = 1 << (xxhash.xxh32_intdigest(around) & 63)
        out[True, w] |= bit
        for n in BEGINNINGS:
            if len(w) > n:
                out[False, w[:n]] |= bit
    return out


def learn_lexicon(sample: DataFrame) -> Lexicon:
    """The lexicon of ``sample`` (text, label): units of both classes counted where the texts are, and judged by unit."""
    schema = "whole boolean, unit string, toxic long, clean long, around long"

    def counted(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts: dict[tuple[bool, str], list[int]] = defaultdict(lambda: [0, 0, 0])
        for b in parts:
            for t, label in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                for unit, mask in _units(t.as_py()).items():
                    seen = texts[unit]
                    seen[1 - label] += 1
                    if label:
                        seen[2] |= mask
        signed = [m - (1 << 64) if m >> 63 else m for _, _, m in texts.values()]
        columns = [pa.array([u[0] for u in texts], pa.bool_()), pa.array([u[1] for u in texts], pa.string()), *(pa.array([n[i] for n in texts.values()], pa.int64()) for i in (0, 1)), pa.array(signed, pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, ["whole", "unit", "toxic", "clean", "around"])

    sizes = {r.label: r.n for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if not sizes.get(0) or not sizes.get(1):
        return Lexicon(frozenset(), frozenset())
    units = sample.select("text", "label").mapInArrow(counted, schema).groupBy("whole", "unit")
    units = units.agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"), F.bit_or("around").alias("around"))
    often = (F.col("toxic") >= LEAST_TEXTS) & (F.bit_count("around") >= LEAST_AROUND)
    specific = F.col("toxic") / sizes[1] >= LEAST_RATIO * (F.col("clean") + 0.5) / (sizes[0] + 1)
    chosen = units.filter(often & specific).select("whole", "unit").collect()  # part of the units of a bounded sample
    return Lexicon(frozenset(r.unit for r in chosen if r.whole), frozenset(r.unit for r in chosen if not r.whole))


@dataclass
class Model:
    lexicon: Lexicon
    trees: Trees | None
    calibration: Isotonic
    rate: float

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.trees is None or not len(x):
            return np.full(len(x), self.rate)
        return np.clip(self.calibration.probability(self.trees.probability(x)), 0, 1)


def one_label(labels: DataFrame, key: str = "doc_id", label: str = "toxic") -> DataFrame:
    """(key, label) with one row for each id: of contradictory labels the higher counts."""
    return labels.filter(F.col(key).isNotNull()).groupBy(key).agg(F.max(F.col(label).cast("int")).alias("label"))


def fit(labelled: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE) -> Model:
    """A model from at most about ``sample`` rows of ``labelled``; a fifth of them, chosen by hash, calibrates it."""
    scratch = Scratch(labelled.sparkSession, "toxicity")
    rows = labelled.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"), F.col(label).cast("int").alias("label")).filter("label in (0, 1)")
    some = bounded(rows, "key", sample, "toxicity").withColumn("part", F.floor(share(F.col("key"), "toxicity-fold") * 5).cast("int"))
    some = scratch.table(some, "sample")
    lexicon = learn_lexicon(some.filter("part <> 0 or part is null").select("text", "label").distinct())

    def measured(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(lexicon)
        for b in parts:
            yield pa.RecordBatch.from_arrays([b.column(1), b.column(2), pa.array([reader.features(t.as_py()) for t in b.column(0)], pa.list_(pa.float64()))], ["label", "part", "x"])

    got = some.select("text", "label", "part").mapInArrow(measured, "label int, part int, x array<double>").collect()
    scratch.drop(some)
    got.sort(key=lambda r: (r.part or 0, r.label, r.x))
    x = np.array([r.x for r in got], float).reshape(len(got), len(FEATURES))
    y, part = np.array([r.label for r in got], float), np.array([r.part or 0 for r in got])
    rate = float((y.sum() + 0.5) / (len(y) + 1))
    if len(set(y.tolist())) < 2:
        return Model(lexicon, None, Isotonic().fit(np.zeros(0), np.zeros(0)), rate)
    trees = Trees().fit(x[part != 0], y[part != 0])
    return Model(lexicon, trees, Isotonic().fit(trees.probability(x[part == 0]), y[part == 0]), rate)


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score) of every row by a narrow pass."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scored(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        in_worker("toxicity")
        own: Model = shared.value
        reader = Reader(own.lexicon)
        for b in parts:
            x = np.array([reader.features(t.as_py()) for t in b.column(1)], float).reshape(b.num_rows, len(FEATURES))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(own.score(x), pa.float64())], ["key", "score"])

    chosen = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    return chosen.mapInArrow(scored, f"key {chosen.schema['key'].dataType.simpleString()}, score double").withColumnRenamed("key", key)


def keep_clean(docs: DataFrame, model: Model, threshold: float, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text)

    def kept(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        in_worker("toxicity")
        own: Model = shared.value
        reader = Reader(own.lexicon)
        for b in parts:
            x = np.array([reader.features(t.as_py()) for t in b.column(at)], float).reshape(b.num_rows, len(FEATURES))
            yield b.filter(pa.array(own.score(x) < threshold))

    return docs.mapInArrow(kept, docs.schema)


def judge(docs: DataFrame, labels: DataFrame, key: str = "doc_id", threshold: float = 0.3, by: int = 4, held: int = 2) -> DataFrame:
    """key, held_out, score and predicted of every row, learned from labelled rows that are not held out."""
    learn = one_label(labels.filter(F.coalesce(crc_remainder(F.col(key), by) != held, F.lit(False))), key)
    model = fit(docs.select(key, "text").join(learn, key), key, "text", "label")
    out = score(docs, model, key, "text")
    held_out = F.coalesce(crc_remainder(F.col(key), by) == held, F.lit(False))
    return out.select(key, held_out.alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))
