"""Networks as operators: an adapter for any model of image batches, and small NumPy networks.

A network is bound to an operator's name by a loader, which runs once in each Python worker and returns a function from
a list of images to one list of detections for each. Frames reach it in batches of BATCH, as their latencies are given
for. ``stand_ins`` binds every name that no network is bound to with a small NumPy model, so that all queries and plans
can be run and measured without any weights; what they predict means nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuelight.functions import images
from cuelight.plans.cost import BATCH

#: xmin, ymin, xmax, ymax, label, cls, score; corners may be None.
Detection = tuple[float | None, float | None, float | None, float | None, str | None, int | None, float | None]
Network = Callable[[list[np.ndarray]], list[list[Detection]]]
_FIELDS = ("xmin", "ymin", "xmax", "ymax", "label", "cls", "score")
_TYPE = "array<struct<xmin: double, ymin: double, xmax: double, ymax: double, label: string, cls: int, score: double>>"
_LOADED: dict[str, Network] = {}


def batches_of(items: Sequence, size: int = BATCH) -> Iterator[Sequence]:
    for lo in range(0, len(items), size):
        yield items[lo : lo + size]


def network_operator(name: str, load: Callable[[], Network], out: str | None = None) -> Callable[[DataFrame], DataFrame]:
    """An operator that adds the network's detections to frames, as an array of structs."""

    def run(frames: DataFrame) -> DataFrame:
        @F.pandas_udf(_TYPE)
        def predict(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
            if name not in _LOADED:
                _LOADED[name] = load()
            network = _LOADED[name]
            for raw, width, height in parts:
                rows: list[list[dict]] = []
                for some in batches_of(list(zip(raw, width, height, strict=True))):
                    found = network([images.as_image(*r) for r in some])
                    rows += [[dict(zip(_FIELDS, d, strict=True)) for d in one] for one in found]
                yield pd.Series(rows, dtype=object)

        return frames.withColumn(out or name, predict.asNondeterministic()("framebytes", "width", "height"))

    return run


@dataclass(frozen=True)
class Layers:
    """A feed-forward network: (weights, bias, whether negative values become 0) of each layer."""

    parts: tuple[tuple[np.ndarray, np.ndarray, bool], ...]

    @staticmethod
    def made(sizes: Sequence[int], seed: int = 0) -> Layers:
        """Fixed random weights."""
        rng = np.random.default_rng(seed)
        last = len(sizes) - 2
        return Layers(tuple((rng.normal(size=(a, b)) / np.sqrt(a), np.zeros(b), i < last) for i, (a, b) in enumerate(zip(sizes[:-1], sizes[1:], strict=True))))

    def __call__(self, x: np.ndarray) -> np.ndarray:
        for w, b, positive in self.parts:
            x = x @ w + b
            x = np.maximum(x, 0) if positive else x
        return x

    def split(self, at: int) -> tuple[Layers, Layers]:
        """The layers up to and with number ``at``, and the rest: one run of the first serves many of the second."""
        return Layers(self.parts[: at + 1]), Layers(self.parts[at + 1 :])


def top(scores: np.ndarray, labels: Sequence[str]) -> list[list[Detection]]:
    """The best class of each line, with its softmax score and no box."""
    odds = np.exp(scores - scores.max(axis=1, keepdims=True))
    odds /= odds.sum(axis=1, keepdims=True)
    best = odds.argmax(axis=1)
    return [[(None, None, None, None, labels[k], int(k), float(o[k]))] for k, o in zip(best, odds, strict=True)]


def classifier(layers: Layers, labels: Sequence[str], size: int = 8) -> Callable[[], Network]:
    """Loader of a network that names each frame by its colour layout."""
    return lambda: lambda batch: top(layers(np.array([images.colour_layout(x, size) for x in batch])), labels)


def quantised(layers: Layers) -> Layers:
    """The same network with weights rounded to 255 steps of each layer."""

    def steps(w: np.ndarray) -> np.ndarray:
        scale = max(float(np.abs(w).max()), 1e-12) / 127
        return np.round(w / scale) * scale

    return Layers(tuple((steps(w), b, p) for w, b, p in layers.parts))


def prefix_operator(layers: Layers, out: str = "dfprefixembed", size: int = 8) -> Callable[[DataFrame], DataFrame]:
    """What the shared first layers make of each frame, as the bytes of 32-bit floats."""

    def run(frames: DataFrame) -> DataFrame:
        @F.pandas_udf("binary")
        def embed(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
            for raw, width, height in parts:
                rows: list[bytes] = []
                for some in batches_of(list(zip(raw, width, height, strict=True))):
                    x = layers(np.array([images.colour_layout(images.as_image(*r), size) for r in some]))
                    rows += [v.tobytes() for v in x.astype(np.float32)]
                yield pd.Series(rows, dtype=object)

        return frames.withColumn(out, embed("framebytes", "width", "height"))

    return run


def suffix_operator(layers: Layers, labels: Sequence[str], out: str, column: str = "dfprefixembed") -> Callable[[DataFrame], DataFrame]:
    """The remaining layers on a prefix's bytes; rows without them have no detection."""

    def run(rows: DataFrame) -> DataFrame:
        @F.pandas_udf(_TYPE)
        def predict(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for raw in parts:
                out_rows: list[list[dict]] = [[] for _ in raw]
                at = [i for i, r in enumerate(raw) if r is not None]
                for some in batches_of(at):
                    x = np.array([np.frombuffer(raw.iloc[i], np.float32) for i in some], np.float64)
                    for i, one in zip(some, top(layers(x), labels), strict=True):
                        out_rows[i] = [dict(zip(_FIELDS, d, strict=True)) for d in one]
                yield pd.Series(out_rows, dtype=object)

        return rows.withColumn(out, predict(column))

    return run


def svm_loader(weights: np.ndarray | None = None, bias: float | None = None) -> Callable[[], Network]:
    """Loader of a linear day and night classifier on the pixels of a frame of 200 x 200; by default their mean against DAY."""

    def load() -> Network:
        w = np.full(200 * 200 * 3, 1 / (200 * 200 * 3)) if weights is None else weights
        b = -images.DAY if bias is None else bias

        def run(batch: list[np.ndarray]) -> list[list[Detection]]:
            day = np.array([images.resized(x).ravel().astype(np.float64) @ w + b for x in batch]) > 0
            return [[(None, None, None, None, "day" if d else "night", int(d), 1.0)] for d in day]

        return run

    return load


def regions_loader(label: str, cls: int, size: int, above: float = 30.0) -> Callable[[], Network]:
    """Loader of a detector of what stands out from the frame's mean, on a grid of ``size``: one box around it."""

    def run(batch: list[np.ndarray]) -> list[list[Detection]]:
        out: list[list[Detection]] = []
        for x in batch:
            gray = images.resized(x, size, size).astype(np.float64).mean(axis=2)
            far = np.abs(gray - gray.mean())
            rows, cols = np.nonzero(far > above)
            if not len(rows):
                out.append([])
                continue
            sy, sx = x.shape[0] / size, x.shape[1] / size
            score = float(min(1.0, far.max() / 255))
            out.append([(float(cols.min() * sx), float(rows.min() * sy), float((cols.max() + 1) * sx), float((rows.max() + 1) * sy), label, cls, score)])
        return out

    return lambda: run


def timed_operator(out: str, seconds: float | None = None) -> Callable[[DataFrame], DataFrame]:
    """Seconds that a frame costs without any model: waiting ``seconds`` a batch, or making an array of it."""

    def run(frames: DataFrame) -> DataFrame:
        @F.pandas_udf("double")
        def measure(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
            import time

            for raw, width, height in parts:
                took: list[float] = []
                for some in batches_of(list(zip(raw, width, height, strict=True))):
                    start = time.perf_counter()
                    if seconds is None:
                        np.array([images.as_image(*r) for r in some], np.float32)
                    else:
                        time.sleep(seconds)
                    took += [(time.perf_counter() - start) / len(some)] * len(some)
                yield pd.Series(took, dtype=float)

        return frames.withColumn(out, measure("framebytes", "width", "height"))

    return run


#: Labels of the networks that the catalogue names.
EMOTIONS = ("angry", "disgust", "fear", "happy", "sad", "surprise", "neutral")
GENDERS, RACES = ("Woman", "Man"), ("asian", "indian", "black", "white", "middle eastern", "latino hispanic")
ANIMALS = ("animal", "person", "vehicle")
AGES = tuple(map(str, range(101)))
_SIZES = {"objectdetect_nano": 16, "objectdetect": 32, "objectdetect_medium": 48, "objectdetect_large": 64, "objectdetect_xlarge": 96}
#: Layers of the stand-ins' faces and the number of the last one that prefix and suffixes share.
_FACE, SHARED = (192, 32, 32, 16), 1


def face_network(labels: Sequence[str], seed: int) -> Layers:
    """A stand-in for a face attribute: shared first layers, a last one of its own."""
    shared, own = Layers.made(_FACE), Layers.made((_FACE[-1], len(labels)), seed)
    return Layers((*shared.parts[:-1], (*shared.parts[-1][:2], True), *own.parts))


def stand_ins() -> dict[str, Callable[[], Callable[[DataFrame], DataFrame]]]:
    """Operator name -> factory of a NumPy model, for each name of the catalogue that stands for a network."""
    faces = {"deepfaceAge": (AGES, 1), "deepfaceGender": (GENDERS, 2), "deepfaceRace": (RACES, 3)}
    whole = Layers.made((192, 24, 5), 4)
    things = ("car", "person", "dog", "boat", "tree")
    out: dict[str, Callable[[], Callable[[DataFrame], DataFrame]]] = {
        "svm": lambda: network_operator("svm", svm_loader()),
        "classification": lambda: network_operator("classification", classifier(whole, things)),
        "qclassification": lambda: network_operator("qclassification", classifier(quantised(whole), things)),
        "proxyclassification": lambda: network_operator("proxyclassification", classifier(Layers.made((192, 5), 5), things)),
        "facedetect": lambda: network_operator("facedetect", regions_loader("face", 0, 64)),
        "animaldetect": lambda: network_operator("animaldetect", regions_loader(ANIMALS[0], 0, 48)),
        "emotiondetect": lambda: network_operator("emotiondetect", classifier(Layers.made((192, 16, 7), 6), EMOTIONS)),
        "emotiondetect_cascades": lambda: network_operator("emotiondetect_cascades", classifier(Layers.made((192, 7), 7), EMOTIONS)),
        "dfprefixembed": lambda: prefix_operator(face_network(GENDERS, 2).split(SHARED)[0]),
        "overhead": lambda: timed_operator("overhead", 1.0),
        "simple_transfer": lambda: timed_operator("simple_transfer"),
    }
    for name, size in _SIZES.items():
        out[name] = lambda name=name, size=size: network_operator(name, regions_loader("object", 0, size))
    for name, (labels, seed) in faces.items():
        out[name] = lambda name=name, labels=labels, seed=seed: network_operator(name, classifier(face_network(labels, seed), labels))
        suffix = name.replace("deepface", "deepfaceSuffix")
        out[suffix] = lambda suffix=suffix, labels=labels, seed=seed: suffix_operator(face_network(labels, seed).split(SHARED)[1], labels, suffix)
    return out
