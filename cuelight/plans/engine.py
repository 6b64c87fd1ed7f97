"""Runs plans: each step predicts on the frames that are left, and filters leave fewer.

Everything is lazy: a plan becomes one DataFrame, and only keys travel between steps. The result is the detections of the
query's answering slot, by default the last declared (or of the last step run, with ``compat``), on the frames that all slots accept, so it does
not depend on the order that the planner chose.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuelight.operators import filters as ops
from cuelight.plans import catalog, cost, records
from cuelight.plans.hints import Hint, Kind
from cuelight.plans.planner import Plan, enumerate_plans
from cuelight.plans.query import Filter, Query
from cuelight.plans.settings import Settings
from cuelight.sources.frames import save_predictions

Model = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Dependent:
    """An operator that reads the detections of another one instead of frames, as a tracker does."""

    on: str
    fn: Model

    def __call__(self, detections: DataFrame) -> DataFrame:
        return self.fn(detections)


@dataclass(frozen=True)
class _Kept:
    """A stored prefix result with what it was computed from."""

    frames: DataFrame
    calls: tuple
    found: DataFrame


@dataclass
class Engine:
    """Operators by name, the frames' key columns and the options."""

    models: Mapping[str, Model]
    keys: tuple[str, ...] = ("id",)
    settings: Settings = field(default_factory=Settings)
    _kept: dict[str, list[_Kept]] = field(default_factory=dict)

    def frames_of(self, detections: DataFrame) -> DataFrame:
        return detections.select(*self.keys).distinct()

    def _filtered(self, df: DataFrame, filters: Sequence[Filter]) -> DataFrame:
        for f in filters:
            df = f.apply(df)
        return df

    def _stored(self, key: str, frames: DataFrame, calls: tuple) -> DataFrame | None:
        """The stored result of a prefix over the same frames by the same operators and filters."""
        for k in self._kept.get(key, ()):
            if k.calls == calls and k.frames.sameSemantics(frames):
                return k.found
        return None

    def stored_keys(self, frames: DataFrame, plans: Iterable[Plan]) -> set[str]:
        """Prefixes of ``plans`` whose results over ``frames`` are stored: what a cost estimate counts as free."""
        out = set()
        for plan in plans:
            for i, key in enumerate(plan.prefixes()):
                if self._stored(key, frames, self._calls(plan, i, None)) is not None:
                    out.add(key)
        return out

    def _calls(self, plan: Plan, upto: int, replay: Mapping[str, DataFrame] | None) -> tuple:
        return tuple(((replay or {}).get(s.op, self.models.get(s.op)), tuple(f.identity for f in s.filters)) for s in plan.steps[: upto + 1])

    def run(self, plan: Plan, query: Query, frames: DataFrame, compat: bool = False, replay: Mapping[str, DataFrame] | None = None) -> DataFrame:
        """Detections that answer ``query``; ``replay`` gives stored predictions of operators to use in their place.

        Each step reads its operator once. Only if the answer is not the last step's are its rows joined with the
        frames that the later steps leave.
        """
        source_frames = frames.select(*self.keys).distinct()
        left, answers = source_frames, {}
        waiting: dict[int, DataFrame] = {}
        outputs: dict[str, DataFrame] = {}
        latest = None
        for i, (step, key) in enumerate(zip(plan.steps, plan.prefixes(), strict=True)):
            model = self.models.get(step.op)
            if replay and step.op in replay:
                source = replay[step.op].join(left, list(self.keys), "left_semi")
            elif isinstance(model, Dependent):
                if model.on not in outputs:
                    raise ValueError(f"{step.op} reads {model.on}, which has not run before it")
                source = model(outputs[model.on].join(left, list(self.keys), "left_semi"))
            else:
                source = self.models[step.op](left)
            if step.prefix is not None and step.prefix.kind is Kind.PROXY:
                unsure, sure = ops.proxy_split(source, step.prefix.confidence)
                waiting[step.slot] = self._filtered(sure, step.filters)
                left = self.frames_of(unsure)
                continue
            found = self._filtered(source, step.filters)
            if step.prefix is None and step.slot in waiting:
                found = found.unionByName(waiting.pop(step.slot), allowMissingColumns=True)
            if self.settings.caching:
                calls = self._calls(plan, i, replay)
                stored = self._stored(key, source_frames, calls)
                if stored is None:
                    stored = found.persist()
                    self._kept.setdefault(key, []).append(_Kept(source_frames, calls, stored))
                found = stored
            outputs[step.op] = found
            if step.prefix is None:  # an operator that a slot needs runs before the slot's own, which takes its place here
                answers[step.slot] = latest = found
            left = self.frames_of(found)
        wanted = len(query.slots) - 1 if query.answer is None else query.answer
        last = latest if compat else answers.get(wanted, latest)
        return last if last is latest else last.join(left, list(self.keys), "left_semi")

    def plans(self, query: Query, hints: Iterable[Hint] = (), hint_filters: Mapping[str, Sequence[Filter]] | None = None) -> list[Plan]:
        return enumerate_plans(query, hints, hint_filters)

    def sampled(self, frames: DataFrame, order: str | None = None) -> DataFrame:
        """Keys of the frames that profiling looks at: every n-th by ``order``, a seeded sample, or all without an order."""
        share = self.settings.selectivity_fraction
        if self.settings.selectivity_random:
            frames = frames.sample(False, share, self.settings.seed)
        elif order:
            frames = ops.fixed_rate_sample(frames, max(1, int(1 / share)), order)
        return frames.select(*self.keys).distinct()

    def selectivity(self, plans: Sequence[Plan], frames: DataFrame, order: str | None = None) -> dict[str, float]:
        """Share of sampled frames that each distinct step keeps; every step is measured on the sampled frames, all in one job.

        A step that reads another operator's detections is measured on what the steps before it leave.
        """
        sample = self.sampled(frames, order)
        steps = {str(s): (p, i, s) for p in plans for i, s in enumerate(p.steps)}
        counts = sample.select(F.lit("").alias("step"))
        for name, (plan, i, step) in steps.items():
            model = self.models[step.op]
            if isinstance(model, Dependent):
                before = next(s for s in plan.steps[:i] if s.op == model.on)
                source = model(self._filtered(self.models[model.on](sample), before.filters))
            else:
                source = model(sample)
            counts = counts.unionByName(self.frames_of(self._filtered(source, step.filters)).select(F.lit(name).alias("step")))
        n = {r.step: r.n for r in counts.groupBy("step").agg(F.count("*").alias("n")).collect()}  # one row for each step
        total = n.get("", 0)
        return {name: round(n.get(name, 0) / total, 6) if total else 1.0 for name in steps}

    def latency(self, op: str, frames: DataFrame, count: int = 128) -> float:
        """Seconds for a batch of frames, after one pass that warms up; 0 without frames."""
        some = frames.limit(count).persist()
        n = some.count()
        took = 0.0
        for _ in range(2 if n else 0):
            start = time.perf_counter()
            self.models[op](some).write.format("noop").mode("overwrite").save()
            took = time.perf_counter() - start
        some.unpersist()
        return took * cost.BATCH / max(1, n)

    def accuracy(self, plans: Sequence[Plan], query: Query, frames: DataFrame, truth: DataFrame) -> dict[str, float]:
        """F1 of each plan's frames against ``truth``."""
        from cuelight.operators.metrics import f1_of, multiset_counts

        return {p.key: float(f1_of(multiset_counts(truth, self.run(p, query, frames), self.keys[0])).first().f1) for p in plans}

    def best(self, query: Query, stats: cost.Stats, frames: int, hints: Iterable[Hint] = (), hint_filters: Mapping[str, Sequence[Filter]] | None = None, over: DataFrame | None = None) -> cost.Choice:
        """The plan to run; results stored for the frames ``over`` count as free."""
        s = self.settings
        plans = self.plans(query, hints, hint_filters)
        stored = self.stored_keys(over.select(*self.keys).distinct(), plans) if over is not None and self._kept else ()
        return cost.choose(plans, stats, frames, s.f1_threshold, s.target, s.prefer, s.platforms, stored)

    def profile(self, query: Query, frames: DataFrame, truth: DataFrame | None = None, hints: Iterable[Hint] = (), hint_filters: Mapping[str, Sequence[Filter]] | None = None, latency: Mapping[str, float] | None = None, order: str | None = None) -> cost.Stats:
        """Statistics of all plans: selectivities on sampled frames, latencies where none are given, accuracy against ``truth``.

        With pruning on, plans that only swap operators for lower ranks than a plan that misses the threshold are not
        measured; they count as failed.
        """
        plans = self.plans(query, hints, hint_filters)
        names = {s.op for p in plans for s in p.steps}
        known = dict(latency or {})
        for op in sorted(names - set(known)):
            if not isinstance(self.models[op], Dependent):
                known[op] = self.latency(op, frames)
        f1: dict[str, float] | None = None
        if truth is not None:
            f1, todo = {}, list(plans)
            while todo:
                plan = todo.pop(0)
                f1.update(self.accuracy([plan], query, frames, truth))
                if self.settings.prune_plans and f1[plan.key] < self.settings.f1_threshold:
                    kept = cost.prune_by_rank([plan, *todo], catalog.ranks(), plan)
                    f1 |= {p.key: 0.0 for p in todo if p not in kept}
                    todo = [p for p in todo if p in kept]
        return cost.Stats(known, self.selectivity(plans, frames, order), f1=f1)

    def answer(self, query: Query, frames: DataFrame, canary: DataFrame | None = None, truth: DataFrame | None = None, hints: Iterable[Hint] = (), hint_filters: Mapping[str, Sequence[Filter]] | None = None, stats: cost.Stats | None = None, order: str | None = None, log: str | None = None) -> tuple[DataFrame, cost.Choice]:
        """Profile on the canary (or the frames), choose a plan, and run it: (detections, the choice); ``log`` is a CSV folder for the run's record."""
        hints, took = tuple(hints), {}
        with records.timed(took, "profile"):
            known = stats or self.profile(query, frames if canary is None else canary, truth, hints, hint_filters, order=order)
        with records.timed(took, "plan"):
            choice = self.best(query, known, frames.select(*self.keys).distinct().count(), hints, hint_filters, frames)
        with records.timed(took, "run"):
            found = self.run(choice.plan, query, frames)
            if log:
                found = found.persist()
                found.count()
        if log:
            options = {"query": query.name, "plan": choice.plan.key, "cost": choice.cost, "price": choice.price, "platform": choice.platform, "f1": choice.f1, **self.settings.shown()}
            records.append_run(frames.sparkSession, took, options, log)
        return found, choice

    def materialise(self, ops_of: Iterable[str], canary: DataFrame, folder: str, clip: str) -> dict[str, DataFrame]:
        """Each operator's predictions over the canary, written once and read back: what ``replay`` takes."""
        out: dict[str, DataFrame] = {}
        for op in ops_of:
            model = self.models[op]
            found = model(out[model.on]) if isinstance(model, Dependent) else model(canary.select(*self.keys).distinct())
            out[op] = canary.sparkSession.read.parquet(save_predictions(found, folder, op, clip))
        return out

    def explain(self, plan: Plan, query: Query, frames: DataFrame) -> str:
        """The plan's steps and Spark's physical plan."""
        df = self.run(plan, query, frames)
        return plan.explain() + "\n" + df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))

    def reset_cache(self) -> None:
        for kept in self._kept.values():
            for k in kept:
                k.found.unpersist()
        self._kept.clear()
