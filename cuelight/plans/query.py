"""Queries: conjunctions of operators with ordered filters on their detections."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from cuelight.operators.filters import CROSS_FRAME, FILTERS


@dataclass(frozen=True)
class Filter:
    """A named filter with its arguments, or any function of a detection relation."""

    name: str
    args: tuple = ()
    fn: Callable[..., DataFrame] | None = field(default=None, compare=False)

    def apply(self, df: DataFrame) -> DataFrame:
        fn = self.fn or FILTERS[self.name]
        return fn(df, *self.args)

    @property
    def cross_frame(self) -> bool:
        return self.name in CROSS_FRAME

    @property
    def identity(self) -> tuple:
        """What tells it from filters with other rows: name, arguments and the function itself."""
        return self.name, self.args, self.fn

    def __str__(self) -> str:
        return f"{self.name}({','.join(map(str, self.args))})" if self.args else self.name


@dataclass(frozen=True)
class Slot:
    """One operator of a query; ``needs`` names operators that must have run before."""

    op: str
    filters: tuple[Filter, ...] = ()
    needs: tuple[str, ...] = ()

    @property
    def barrier(self) -> bool:
        return any(f.cross_frame for f in self.filters)


@dataclass(frozen=True)
class Query:
    """``answer`` is the slot whose detections are the result, the last one unless it is given."""

    name: str
    slots: tuple[Slot, ...]
    answer: int | None = None

    @staticmethod
    def from_json(text: str | Sequence[Mapping], name: str = "query") -> Query:
        """``[{"model": op, "filters": [{"func": name, "args": [...]}]}]``."""
        spec = json.loads(text) if isinstance(text, str) else text
        slots = []
        for s in spec:
            filters = tuple(Filter(f["func"], tuple(tuple(a) if isinstance(a, list) else a for a in f.get("args", ()))) for f in s.get("filters", ()))
            unknown = [f.name for f in filters if f.name not in FILTERS]
            if unknown:
                raise ValueError(f"unknown filters: {', '.join(unknown)}")
            slots.append(Slot(s["model"], filters, tuple(s.get("needs", ()))))
        if not slots:
            raise ValueError("a query needs at least one model")
        return Query(name, tuple(slots))
