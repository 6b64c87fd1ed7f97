"""Operators by the short names that queries use, what they read, how accurate they are within their family, and their
measured latencies."""

from __future__ import annotations

from dataclasses import dataclass

from cuelight.plans.cost import Stats
from cuelight.sources.profiles import NOT_ON_GPU

FRAME, VECTOR, PREFIX = ("framebytes", "width", "height"), ("img2vec",), ("dfprefixembed",)


@dataclass(frozen=True)
class Entry:
    """``rank`` orders a family by accuracy, the best highest; operators that need another name it in ``needs``."""

    name: str
    reads: tuple[str, ...] = FRAME
    family: str | None = None
    rank: int = 0
    needs: tuple[str, ...] = ()


#: Short names and the operators they stand for.
OPERATORS: dict[str, Entry] = {
    "ts": Entry("transcriptsearch", ()),
    "si": Entry("similarity"),
    "bi": Entry("brightness"),
    "svm": Entry("svm"),
    "md": Entry("motion"),
    "fd": Entry("facedetect", family="faces", rank=2),
    "ed": Entry("emotiondetect", family="emotions", rank=2),
    "edc": Entry("emotiondetect_cascades", family="emotions", rank=1),
    "cl": Entry("classification"),
    "qcl": Entry("qclassification"),
    "pc": Entry("proxyclassification"),
    "ad": Entry("actiondetect"),
    "odn": Entry("objectdetect_nano", family="objects", rank=1),
    "od": Entry("objectdetect", family="objects", rank=2),
    "odm": Entry("objectdetect_medium", family="objects", rank=3),
    "odl": Entry("objectdetect_large", family="objects", rank=4),
    "odx": Entry("objectdetect_xlarge", family="objects", rank=5),
    "ot": Entry("objecttrack", needs=("odx",)),
    "i2v": Entry("img2vec"),
    "tod": Entry("objectdetect_tasti", VECTOR, "objects", 0, ("i2v",)),
    "ted": Entry("emotiondetect_tasti", VECTOR, "emotions", 0, ("i2v",)),
    "tfd": Entry("facedetect_tasti", VECTOR, "faces", 0, ("i2v",)),
    "tad": Entry("actiondetect_tasti", VECTOR, needs=("i2v",)),
    "dfage": Entry("deepfaceAge"),
    "dfgender": Entry("deepfaceGender"),
    "dfrace": Entry("deepfaceRace"),
    "dfprefix": Entry("dfprefixembed"),
    "dfsuffixage": Entry("deepfaceSuffixAge", PREFIX, needs=("dfprefix",)),
    "dfsuffixgender": Entry("deepfaceSuffixGender", PREFIX, needs=("dfprefix",)),
    "dfsuffixrace": Entry("deepfaceSuffixRace", PREFIX, needs=("dfprefix",)),
    "transfer": Entry("transfer"),
    "overhead": Entry("overhead"),
    "simple": Entry("simple_transfer"),
}

#: Published seconds for 16 frames on a CPU and on a GPU (None: runs on CPUs only).
LATENCIES: dict[str, tuple[float, float | None]] = {
    "actiondetect": (4.5774, 0.6337),
    "actiondetect_tasti": (0.1650, None),
    "brightness": (0.8508, 0.8508),
    "classification": (1.0253, 0.2195),
    "deepfaceAge": (4.2741, None),
    "deepfaceGender": (3.4695, None),
    "deepfaceRace": (3.4135, None),
    "deepfaceSuffixAge": (0.9766, None),
    "deepfaceSuffixGender": (0.9656, None),
    "deepfaceSuffixRace": (0.9621, None),
    "dfprefixembed": (2.9872, None),
    "emotiondetect": (10.6612, 7.7553),
    "emotiondetect_cascades": (4.2685, 2.0679),
    "emotiondetect_tasti": (0.1892, None),
    "facedetect": (4.0562, 2.7556),
    "facedetect_tasti": (0.1860, None),
    "img2vec": (2.2562, None),
    "motion": (0.9687, None),
    "objectdetect": (1.4944, 0.2632),
    "objectdetect_large": (4.6735, 0.6393),
    "objectdetect_medium": (3.5648, 0.4258),
    "objectdetect_nano": (0.7115, 0.2065),
    "objectdetect_tasti": (0.1849, None),
    "objectdetect_xlarge": (10.2665, 1.0153),
    "objecttrack": (0.9583, 0.4394),
    "proxyclassification": (0.3173, 0.1073),
    "qclassification": (1.0161, 0.5834),
    "similarity": (0.3938, None),
    "svm": (1.1521, 1.1521),
    "transcriptsearch": (0.0448, None),
}

#: Published seconds that a number of frames takes to reach a GPU.
TRANSFERS: dict[int, float] = {0: 0.1303, 1: 0.2329, 50: 0.3628, 100: 0.3644, 250: 0.3369, 500: 1.0253, 1000: 1.5193, 2000: 4.2907, 3000: 5.2522, 4000: 8.5927, 5000: 14.8644, 6000: 8.0822, 7000: 12.6468, 8000: 14.6587}


def ranks() -> dict[str, tuple[str, int]]:
    """Family and rank of the operators that have one, for pruning."""
    return {k: (e.family, e.rank) for k, e in OPERATORS.items() if e.family}


def transfer_line(points: dict[int, float] | None = None):
    """Least-squares seconds for a number of frames, never negative."""
    xy = list((TRANSFERS if points is None else points).items())
    mx, my = sum(x for x, _ in xy) / len(xy), sum(y for _, y in xy) / len(xy)
    slope = sum((x - mx) * (y - my) for x, y in xy) / sum((x - mx) ** 2 for x, _ in xy)
    return lambda n: max(0.0, my + slope * (n - mx))


def default_stats(selectivity: dict[str, float] | None = None, f1: dict[str, float] | None = None) -> Stats:
    """The published latencies by short name, with given selectivities and accuracies."""
    known = {k: LATENCIES[e.name] for k, e in OPERATORS.items() if e.name in LATENCIES}
    return Stats({k: a for k, (a, _) in known.items()}, selectivity or {}, {k: NOT_ON_GPU if b is None else b for k, (_, b) in known.items()}, transfer_line(), f1)
