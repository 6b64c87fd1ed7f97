"""Model operators: what turns frames into predictions.

Operators are looked up by name and made on first use, so importing this module loads no model. Frame operators are
pandas functions; those that need the frame before run on ordered groups by video. A table model answers from stored
predictions, which is how results of outside networks enter the engine; networks themselves are optional adapters.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cuelight.functions import images
from cuelight.operators.ordering import global_position, running_total
from cuelight.schema import DETECTION

#: Frame numbers that a task puts in order together.
SEGMENT = 65_536
DETECTION_DDL = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in DETECTION.fields)


def brightness(frames: DataFrame, out: str = "brightness") -> DataFrame:
    """Day or night by mean brightness, as one detection without a box."""

    @F.pandas_udf("double")
    def value(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for raw, width, height in parts:
            yield pd.Series([images.mean_value(images.as_image(r, w, h)) for r, w, h in zip(raw, width, height, strict=True)], dtype=float)

    day = F.col("_v") > images.DAY
    one = F.struct(*[F.lit(None).cast("double").alias(n) for n in ("xmin", "ymin", "xmax", "ymax")], F.when(day, "day").otherwise("night").alias("label"), day.cast("int").alias("cls"), F.lit(1.0).alias("score"))
    return frames.withColumn("_v", value("framebytes", "width", "height")).withColumn(out, F.array(one)).drop("_v")


def similarity(frames: DataFrame, target: bytes, width: int, height: int, out: str = "similarity") -> DataFrame:
    """Distance to a target image: differing bits of gradient hashes."""
    wanted = images.gradient_hash(images.as_image(target, width, height))

    @F.pandas_udf("double")
    def distance(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for raw, w, h in parts:
            yield pd.Series([float((images.gradient_hash(images.as_image(r, a, b)) != wanted).sum()) for r, a, b in zip(raw, w, h, strict=True)], dtype=float)

    return frames.withColumn(out, distance("framebytes", "width", "height"))


def classify(frames: DataFrame, weights: np.ndarray, bias: np.ndarray, labels: list[str], out: str = "classes", size: int = 8) -> DataFrame:
    """Top class of a linear model over the frame's colour layout, with its softmax score, as one detection without a box."""

    @F.pandas_udf("cls int, score double")
    def top(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for raw, width, height in parts:
            x = np.array([images.colour_layout(images.as_image(r, w, h), size) for r, w, h in zip(raw, width, height, strict=True)]).reshape(len(raw), -1)
            z = x @ weights + bias
            odds = np.exp(z - z.max(1, keepdims=True)) if len(z) else z
            best = z.argmax(1) if len(z) else np.zeros(0, int)
            yield pd.DataFrame({"cls": best.astype(np.int32), "score": odds[np.arange(len(z)), best] / odds.sum(1) if len(z) else np.zeros(0)})

    # Filters on the class would run the model twice if Spark took it for repeatable.
    found = frames.withColumn("_t", top.asNondeterministic()("framebytes", "width", "height"))
    name = F.element_at(F.array(*map(F.lit, labels)), F.col("_t.cls") + 1)
    one = F.struct(*[F.lit(None).cast("double").alias(n) for n in ("xmin", "ymin", "xmax", "ymax")], name.alias("label"), F.col("_t.cls").alias("cls"), F.col("_t.score").alias("score"))
    return found.withColumn(out, F.array(one)).drop("_t")


def embed(frames: DataFrame, out: str = "img2vec", size: int = 8) -> DataFrame:
    """Colour layout of each frame as an array of floats: what embedding-based operators read."""

    @F.pandas_udf("array<float>")
    def layout(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for raw, width, height in parts:
            yield pd.Series([images.colour_layout(images.as_image(r, w, h), size).astype(np.float32) for r, w, h in zip(raw, width, height, strict=True)])

    return frames.withColumn(out, layout("framebytes", "width", "height"))


def transfer(frames: DataFrame, out: str = "transfer") -> DataFrame:
    """Seconds that copying a frame into an array takes: the baseline of what it costs to reach a model."""

    @F.pandas_udf("double")
    def copy(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        import time

        for raw, width, height in parts:
            took = []
            for r, w, h in zip(raw, width, height, strict=True):
                start = time.perf_counter()
                images.as_image(r, w, h).copy()
                took.append(time.perf_counter() - start)
            yield pd.Series(took, dtype=float)

    return frames.withColumn(out, copy("framebytes", "width", "height"))


def _in_order(fn: Callable[[pd.DataFrame], pd.DataFrame]) -> Callable[[pd.DataFrame], pd.DataFrame]:
    return lambda group: fn(group.sort_values("id", kind="stable").reset_index(drop=True))


def motion(frames: DataFrame, segment: int = 10_000) -> DataFrame:
    """(uri, id, label, cls, score): whether more than two regions changed since the frame before.

    Videos are cut into segments of ``segment`` frame numbers, each with the last frame before it, so that no task
    holds a whole video. The first frame of a video does not move.
    """
    cut = frames.withColumn("_segment", F.floor(F.col("id") / segment))
    last = cut.groupBy("uri", "_segment").agg(F.max_by(F.struct("id", "width", "height", "framebytes"), "id").alias("_last"))
    after = F.lead("_segment").over(Window.partitionBy("uri").orderBy("_segment"))
    carried = last.withColumn("_segment", after).filter("_segment is not null").select("uri", "_last.*", "_segment", F.lit(True).alias("_carried"))
    rows = cut.select("uri", "id", "width", "height", "framebytes", "_segment", F.lit(False).alias("_carried")).unionByName(carried)

    @_in_order
    def follow(group: pd.DataFrame) -> pd.DataFrame:
        moves, before = [], None
        for raw, w, h in zip(group["framebytes"], group["width"], group["height"], strict=True):
            now = images.as_image(raw, w, h)
            moves.append(before is not None and before.shape == now.shape and images.moving_regions(before, now) > images.REGIONS)
            before = now
        out = pd.DataFrame({"uri": group["uri"], "id": group["id"], "label": ["motion" if m else "no_motion" for m in moves], "cls": [int(m) for m in moves], "score": 1.0})
        return out[~group["_carried"].astype(bool)]

    return rows.groupBy("uri", "_segment").applyInPandas(follow, "uri string, id long, label string, cls int, score double")


def track(detections: DataFrame, overlap: float = 0.3, patience: int = 3) -> DataFrame:
    """Detections with a track number per video: each box continues the live track of its label it overlaps most.

    A video is cut wherever more than ``patience`` frame numbers pass without a detection, as no track lives on there;
    the pieces are followed side by side, and their numbers shifted by the tracks of the pieces before. A piece is read
    in batches in the order of its frames, so that memory holds live tracks, not a whole video. Boxes with a null
    corner overlap nothing.
    """
    plain = detections.drop("track")
    names = plain.columns
    order = [c for c in ("id", "det_id") if c in names] + [c for c in ("xmin", "ymin", "xmax", "ymax", "label") if c in names]
    shown = plain.select("uri", "id").distinct()
    gap = F.col("id") - F.lag("id").over(Window.partitionBy("uri", F.floor(F.col("id") / SEGMENT)).orderBy("id"))
    # The first frame of a segment of ids looks at the last one of the segment before it.
    ends = shown.groupBy("uri", F.floor(F.col("id") / SEGMENT).alias("_seg")).agg(F.max("id").alias("_end"))
    before = ends.withColumn("_before", F.lag("_end").over(Window.partitionBy("uri").orderBy("_seg"))).select("uri", "_seg", "_before")
    cuts = shown.withColumns({"_gap": gap, "_seg": F.floor(F.col("id") / SEGMENT)}).join(before, ["uri", "_seg"])
    opens = F.coalesce(F.coalesce("_gap", F.col("id") - F.col("_before")) > patience, F.lit(True)).cast("long")
    pieces = running_total(cuts.withColumn("_opens", opens), F.col("_opens"), F.col("_seg"), ["id"], "_piece", ["uri"]).select("uri", "id", "_piece")
    rows = plain.join(pieces, ["uri", "id"]).select(*names, "_piece").repartition("uri", "_piece").sortWithinPartitions("uri", "_piece", *order)

    def follow(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        piece, frame, made, seen = None, None, 0, []
        live: dict[int, tuple[int, str, np.ndarray]] = {}

        def numbered() -> list[int]:
            """Track numbers of the open frame's boxes."""
            nonlocal live, made
            live = {t: v for t, v in live.items() if frame - v[0] <= patience}
            pairs = sorted(((_overlap(box, old), t, r) for r, (label, box) in enumerate(seen) for t, (_, kind, old) in live.items() if kind == label), key=lambda p: (-p[0], p[1], p[2]))
            out: list[int] = [0] * len(seen)
            taken: set[int] = set()
            for iou, t, r in pairs:
                if iou >= overlap and not out[r] and t not in taken:
                    out[r] = t
                    taken.add(t)
            for r, (label, box) in enumerate(seen):
                if not out[r]:
                    made += 1
                    out[r] = made
                live[out[r]] = (frame, label, box)
            return out

        held: list[pd.DataFrame] = []
        for part in parts:
            boxes = part[["xmin", "ymin", "xmax", "ymax"]].to_numpy(float)
            labels, where = part["label"].tolist(), list(zip(part["uri"], part["_piece"], part["id"], strict=True))
            numbers: list[int] = []
            first = 0
            for i, (uri, own, at) in enumerate(where):
                if (uri, own) != piece or at != frame:
                    if seen:
                        done = numbered()
                        carried = sum(map(len, held))
                        if held:  # the frame began in an earlier batch
                            yield pd.concat(held, ignore_index=True).assign(track=done[:carried])
                            held = []
                        numbers += done[carried:]
                        first = i
                    if (uri, own) != piece:
                        live, made = {}, 0
                    piece, frame, seen = (uri, own), at, []
                seen.append((labels[i], boxes[i]))
            if first:
                yield part.iloc[:first].assign(track=numbers)
            held.append(part.iloc[first:])
        if seen:
            yield pd.concat(held, ignore_index=True).assign(track=numbered())

    schema = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes) + ", track long"
    found = rows.mapInPandas(follow, schema)
    sizes = found.groupBy("uri", "_piece").agg(F.max("track").alias("_made"))
    shifts = running_total(sizes, F.col("_made"), F.floor(F.col("_piece") / 4096), ["_piece"], "_upto", ["uri"]).select("uri", "_piece", (F.col("_upto") - F.col("_made")).alias("_shift"))
    return found.join(shifts, ["uri", "_piece"]).withColumn("track", F.col("track") + F.col("_shift")).select(*names, "track")


def _overlap(a: np.ndarray, b: np.ndarray) -> float:
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    if w <= 0 or h <= 0:
        return 0.0
    both = w * h
    return float(both / ((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - both))


def action_clips(frames: DataFrame, label_of: Callable[[DataFrame], DataFrame], clip: int = 16) -> DataFrame:
    """One label for each run of ``clip`` frames of a video, copied to all of its frames.

    ``label_of`` maps (uri, clip, first_id, frames) rows to the same rows with label and score. Frames are numbered
    within buckets of their ids, so that no task orders a whole video.
    """
    placed = global_position(frames, F.floor(F.col("id") / 65536), ["id"], "_pos", ["uri"])
    numbered = placed.withColumn("clip", F.floor((F.col("_pos") - 1) / clip)).drop("_pos")
    clips = label_of(numbered.groupBy("uri", "clip").agg(F.min("id").alias("first_id"), F.count("*").alias("frames")))
    return numbered.join(clips.select("uri", "clip", "label", "score"), ["uri", "clip"])


@dataclass(frozen=True)
class TableModel:
    """Predictions from a stored detection relation with the frames' key columns."""

    detections: DataFrame
    keys: tuple[str, ...] = ("id",)

    def __call__(self, frames: DataFrame) -> DataFrame:
        return self.detections.join(frames.select(*self.keys), list(self.keys), "left_semi")


def _built_in() -> dict[str, Callable[[], Callable[[DataFrame], DataFrame]]]:
    return {
        "transcriptsearch": lambda: lambda frames: frames,
        "brightness": lambda: brightness,
        "motion": lambda: motion,
        "objecttrack": lambda: track,
        "img2vec": lambda: embed,
        "transfer": lambda: transfer,
    }


_FACTORIES: dict[str, Callable[[], Callable[[DataFrame], DataFrame]]] = _built_in()
_MADE: dict[str, Callable[[DataFrame], DataFrame]] = {}


def register(name: str, factory: Callable[[], Callable[[DataFrame], DataFrame]]) -> None:
    """Make ``name`` available; ``factory`` runs when the model is first asked for."""
    _FACTORIES[name] = factory
    _MADE.pop(name, None)


def register_stand_ins() -> list[str]:
    """Bind every network's name that nothing is bound to with its NumPy stand-in; returns those names."""
    from cuelight.operators.networks import stand_ins

    bound = [n for n in stand_ins() if n not in _FACTORIES]
    for n in bound:
        register(n, stand_ins()[n])
    return bound


def model(name: str) -> Callable[[DataFrame], DataFrame]:
    if name not in _FACTORIES:
        raise KeyError(f"no operator {name!r}; register it first")
    if name not in _MADE:
        _MADE[name] = _FACTORIES[name]()
    return _MADE[name]


def engine_models(short_names: Iterable[str]) -> dict[str, Callable[[DataFrame], DataFrame]]:
    """The catalogue's operators by the short names that queries use."""
    from cuelight.plans.catalog import OPERATORS

    return {n: model(OPERATORS[n].name) for n in short_names}
