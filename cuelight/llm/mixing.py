"""Mixing by soft membership: domain posteriors of all documents, and rates that bring domain tokens to target weights.

A naive Bayes classifier over hashed words, learned from a labelled table, gives each document a posterior over domains;
how sharp the posteriors are is chosen on labelled documents that it has not learned from. Projected-gradient least
squares then fits a nonnegative rate for every document so that the expected tokens of each domain, the sum of rate *
tokens * posterior, meet the targets. All documents start at rate 1. A step moves each rate against the gradient of
the squared relative misses, preconditioned by document size, and projects it onto zero and above; it needs one
aggregation over (tokens, posterior) and sends one number per domain to the driver. A rate is a function of the
document's own posterior and the steps so far, so no rates are shuffled or joined.

Everything is DataFrame operations. Bounds: at most about SAMPLE labelled documents, BUCKETS word buckets and DOMAINS
domains (more raise an error). Defined results: a null or empty text has no tokens and the prior as posterior; without
labelled documents there is one domain, "all"; a target for a domain that does not occur counts as 0 and the others are
scaled up; rows without an id and repeated rows are rated like any row; other columns are carried by ``mix``.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuelight.llm.labelled import bounded, share
from cuelight.llm.store import Scratch

#: Labelled documents used, word buckets, most domains, candidates of sharpness, part of the labelled that chooses it.
SAMPLE, BUCKETS, DOMAINS, SHARPNESS, FOLDS = 8_000, 4096, 64, (1.0, 3.0, 10.0, 30.0), 5
#: Most steps, relative miss at which they end, steps without progress after which they end, steps between written tables.
STEPS, MISS, IDLE, WRITTEN = 60, 1e-4, 4, 10
#: Words are what stands between spaces and other white space of ASCII.
WORD_GAP = r"[\x20\x09-\x0D]+"


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), WORD_GAP), lambda w: w != "")


def _bucket(word: Column) -> Column:
    return F.pmod(F.xxhash64(F.lower(word)), F.lit(BUCKETS)).cast("int")


def _table(values: list[float]) -> Column:
    """A constant array of doubles."""
    return F.from_json(F.lit(json.dumps(values)), "array<double>")


@dataclass
class Classifier:
    """Domain names, log priors, log probabilities of each bucket by domain, and the sharpness of posteriors."""

    domains: list[str]
    prior: list[float]
    tables: list[list[float]] = field(repr=False)
    sharpness: float = 1.0

    def means(self, df: DataFrame, text: str) -> DataFrame:
        """``df`` with tokens (long) and means (array: mean log probability of a word for each domain)."""
        df = df.withColumn("_b", F.transform(words_of(F.col(text)), _bucket))
        df = df.withColumn("tokens", F.size("_b").cast("long"))

        def mean(values: list[float]) -> Column:
            return F.aggregate("_b", F.lit(0.0), lambda a, b: a + F.get(_table(values), b)) / F.greatest(F.col("tokens"), F.lit(1))

        return df.withColumn("means", F.array(*map(mean, self.tables))).drop("_b")

    def posterior(self, sharpness: float | None = None) -> list[Column]:
        """Posteriors from the columns tokens and means: the prior times exp(sharpness * sqrt(tokens) * mean)."""
        weight = F.lit(self.sharpness if sharpness is None else sharpness) * F.sqrt(F.col("tokens").cast("double"))
        logs = [F.lit(p) + weight * F.col("means")[i] for i, p in enumerate(self.prior)]
        top = F.greatest(*logs) if len(logs) > 1 else logs[0]
        odds = [F.exp(x - top) for x in logs]
        total = odds[0]
        for o in odds[1:]:
            total = total + o
        return [o / total for o in odds]


def fit_classifier(labelled: DataFrame, key: str = "doc_id", text: str = "text", domain: str = "domain", sample: int = SAMPLE) -> Classifier:
    """Naive Bayes on at most about ``sample`` rows of ``labelled`` (key, text, domain)."""
    rows = labelled.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"), F.col(domain).cast("string").alias("domain")).filter("key is not null and domain is not null")
    sample = bounded(rows, "key", sample, "mixing").withColumn("check", F.floor(share(F.col("key"), "mixing-fold") * FOLDS) == 0)
    learn = sample.filter(~F.col("check"))
    sizes = {r.domain: r.n for r in learn.groupBy("domain").agg(F.count("*").alias("n")).orderBy("domain").limit(DOMAINS + 1).collect()}
    if len(sizes) > DOMAINS:
        raise ValueError(f"more than {DOMAINS} domains")
    if len(sizes) < 2:
        return Classifier(list(sizes) or ["all"], [0.0], [[0.0] * BUCKETS])
    names = sorted(sizes)
    counts = learn.select("domain", F.explode(F.transform(words_of(F.col("text")), _bucket)).alias("b")).groupBy("domain", "b").agg(F.count("*").alias("n"))
    tables = {d: [0.5] * BUCKETS for d in names}
    for r in counts.collect():  # at most DOMAINS * BUCKETS rows
        tables[r.domain][r.b] += r.n
    total = sum(sizes.values())
    logs = [[log(x / sum(tables[d])) for x in tables[d]] for d in names]
    model = Classifier(names, [log(sizes[d] / total) for d in names], logs)
    measured = model.means(sample.filter("check"), "text")
    own = F.array_position(F.array(*map(F.lit, names)), F.col("domain")).cast("int")
    losses = measured.filter(own > 0).agg(*[F.avg(-F.log(F.greatest(F.element_at(F.array(*model.posterior(s)), own), F.lit(1e-9)))).alias(str(i)) for i, s in enumerate(SHARPNESS)]).first()
    if losses[0] is not None:
        model.sharpness = min(zip(losses, SHARPNESS, strict=True))[1]
    return model


def _rate(start: Column, history: list[list[float]], posterior: Column) -> Column:
    """The rate after the steps of ``history``, each a number for each domain."""
    if not history:
        return start

    def move(r: Column, step: Column) -> Column:
        toward = F.aggregate(F.zip_with(posterior, step, lambda p, g: p * g), F.lit(0.0), lambda a, x: a + x)
        return F.greatest(F.lit(0.0), r - toward)

    return F.aggregate(F.from_json(F.lit(json.dumps(history)), "array<array<double>>"), start, move)


@dataclass
class Mixture:
    classifier: Classifier
    history: list[list[float]]
    targets: list[float]
    reached: list[float]

    def shares(self) -> tuple[list[float], list[float]]:
        """Target and reached shares of all tokens, by domain: steps may end before the targets are met (STEPS, IDLE)."""
        return [t / (sum(self.targets) or 1.0) for t in self.targets], [r / (sum(self.reached) or 1.0) for r in self.reached]

    def rates(self, df: DataFrame, text: str = "text") -> DataFrame:
        """``df`` with tokens, posterior (array in the order of the domains) and rate, by a narrow pass."""
        df = self.classifier.means(df, text)
        df = df.withColumn("posterior", F.array(*self.classifier.posterior()))
        return df.withColumn("rate", _rate(F.lit(1.0), self.history, F.col("posterior"))).drop("means")


def fit_rates(docs: DataFrame, classifier: Classifier, weights: dict[str, float], text: str = "text", total: float | None = None) -> tuple[Mixture, DataFrame]:
    """The fitted mixture, and a stored table of the columns of ``docs`` but the text, with tokens, posterior and rate.

    ``weights`` are the domains' shares of ``total`` tokens (default: as many as the documents have).
    """
    scratch = Scratch(docs.sparkSession, "mixing")
    start = Mixture(classifier, [], [], [])
    stored = scratch.table(start.rates(docs, text).drop(text), "posteriors")
    k = len(classifier.domains)

    def tokens(table: DataFrame, rate: Column) -> list[float]:
        return [float(x or 0) for x in table.agg(*[F.sum(rate * F.col("tokens") * F.col("posterior")[i]).alias(str(i)) for i in range(k)]).first()]

    there = tokens(stored, F.col("rate"))
    wanted = [weights.get(d, 0.0) if t > 0 else 0.0 for d, t in zip(classifier.domains, there, strict=True)]
    scale = (sum(there) if total is None else total) / (sum(wanted) or 1.0)
    targets = [w * scale for w in wanted]
    history: list[list[float]] = []
    recent: list[list[float]] = []
    reached, best, idle = there, float("inf"), 0
    if sum(there) > 0 and sum(wanted) > 0:
        for _ in range(STEPS):
            step = [(a - t) / c if c > 0 else 0.0 for a, t, c in zip(reached, targets, there, strict=True)]
            miss = max(abs(a - t) / (t if t > 0 else sum(targets)) for a, t in zip(reached, targets, strict=True))
            idle = 0 if miss < 0.99 * best else idle + 1
            best = min(best, miss)
            if miss <= MISS or idle == IDLE:
                break
            history.append(step)
            recent.append(step)
            if len(recent) == WRITTEN:
                stored, recent = scratch.table(stored.withColumn("rate", _rate(F.col("rate"), recent, F.col("posterior"))), "rates"), []
            reached = tokens(stored, _rate(F.col("rate"), recent, F.col("posterior")))
    out = stored.withColumn("rate", _rate(F.col("rate"), recent, F.col("posterior")))
    return Mixture(classifier, history, targets, reached), out


def copies(rate: Column, key: Column) -> Column:
    """How many times a row is taken: the rate, rounded up or down by a fixed share of its key."""
    whole = F.floor(rate)
    return (whole + (F.coalesce(share(key, "mixing-copies"), F.lit(0.5)) < rate - whole).cast("long")).cast("int")


def mix(docs: DataFrame, mixture: Mixture, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` as often as their rates say, with all their columns."""
    own = {c: f"_{i}" for i, c in enumerate(docs.columns)}
    rows = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in own.items()])
    rated = mixture.rates(rows, own[text]).withColumn("_copies", copies(F.col("rate"), F.col(own[key])))
    # An outer explode, as the optimizer would compute posteriors once more to filter rows in front of a plain one.
    taken = rated.withColumn("_copy", F.explode_outer(F.array_repeat(F.lit(1), F.col("_copies")))).filter("_copy is not null")
    return taken.select(*[F.col(n).alias(c) for c, n in own.items()])
