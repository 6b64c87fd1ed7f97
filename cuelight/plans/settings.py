"""Options of a run, from keyword arguments, a mapping or a file of two levels."""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import asdict, dataclass, fields, replace
from typing import Any


@dataclass(frozen=True)
class Ingest:
    """Size and rate of frames, seconds of a chunk, and the part of a video that is decoded."""

    width: int = 360
    height: int = 240
    fps: int = 1
    chunk_size_s: int = 5
    start_fraction: float = 0.0
    end_fraction: float = 1.0


@dataclass(frozen=True)
class Settings:
    """Options of planning and running."""

    f1_threshold: float = 0.8
    target: str = "performance"
    prefer: str = "min"
    platforms: tuple[str, ...] = ("cpu",)
    selectivity_fraction: float = 0.1
    selectivity_random: bool = False
    prune_plans: bool = False
    caching: bool = False
    proxy_confidence: float = 0.0
    prefix_layers: int = 31
    seed: int = 1234
    input: str = "data/"
    canary: str = "canary/"
    output: str = "output/"
    log: str | None = None
    ingest: Ingest = Ingest()

    def shown(self) -> dict[str, Any]:
        """One flat mapping, the ingest options among the others: what a run's record holds."""
        out = asdict(self)
        return out | {f"ingest_{k}": v for k, v in out.pop("ingest").items()}

    def with_options(self, **options: Any) -> Settings:
        """A copy with other values; options of ingest by their own names."""
        own, inner = {f.name for f in fields(Settings)}, {f.name for f in fields(Ingest)}
        unknown = set(options) - own - inner
        if unknown:
            raise ValueError(f"unknown options: {', '.join(sorted(unknown))}")
        ingest = replace(self.ingest, **{k: v for k, v in options.items() if k in inner})
        return replace(self, ingest=ingest, **{k: v for k, v in options.items() if k in own and k not in inner})


def parse_two_levels(text: str) -> dict[str, dict[str, Any]]:
    """``section:`` lines with indented ``name: value`` lines below; values are JSON or plain words, # begins a comment."""
    out: dict[str, dict[str, Any]] = {}
    section = None
    for line in text.splitlines():
        line = line.split(" #")[0].rstrip()
        if not line.strip() or line.lstrip().startswith("#"):
            continue
        name, _, value = line.strip().partition(":")
        if not line[0].isspace():
            section = out.setdefault(name, {})
        elif section is not None and value:
            word = value.strip()
            try:
                section[name] = json.loads({"True": "true", "False": "false", "None": "null"}.get(word, word))
            except json.JSONDecodeError:
                section[name] = word.strip("'")
    return out


#: Option names of a configuration's sections, by the names they have here.
SECTIONS: dict[str, dict[str, str]] = {
    "storage": {"input": "input", "canary": "canary", "output": "output"},
    "execution": {"proxy_confidence_thresh": "proxy_confidence", "deepface_common_prefix_num_layers": "prefix_layers"},
    "ingest": {n: n for n in ("height", "width", "fps", "chunk_size_s", "start_fraction", "end_fraction")},
    "logging": {"output": "log"},
}


def settings_from(config: Mapping[str, Mapping[str, Any]], **options: Any) -> Settings:
    """Settings of a two-level configuration; names it does not know are left out, ``options`` win."""
    known = {SECTIONS[s][k]: v for s, values in config.items() if s in SECTIONS for k, v in values.items() if k in SECTIONS[s]}
    return Settings().with_options(**known | options)


def read_settings(path: str, **options: Any) -> Settings:
    with open(path, encoding="utf-8") as f:
        return settings_from(parse_two_levels(f.read()), **options)
