"""NumPy image measures on raw (height, width, 3) frames."""

from __future__ import annotations

import numpy as np

#: Mean brightness above which it is day, change of a pixel that counts, regions above which a frame moves.
DAY, CHANGE, REGIONS = 115.0, 20, 2


def as_image(raw: bytes, width: int, height: int) -> np.ndarray:
    return np.frombuffer(raw, np.uint8).reshape(height, width, 3)


def resized(image: np.ndarray, height: int = 200, width: int = 200) -> np.ndarray:
    """Nearest pixels on a grid of the given size."""
    rows = (np.arange(height) * image.shape[0] // height).clip(0, image.shape[0] - 1)
    cols = (np.arange(width) * image.shape[1] // width).clip(0, image.shape[1] - 1)
    return image[rows][:, cols]


def mean_value(image: np.ndarray) -> float:
    """Mean of the V channel: each pixel's largest component."""
    return float(resized(image).max(axis=2).mean())


def smooth_gray(image: np.ndarray) -> np.ndarray:
    """Luma, smoothed by the 5-tap binomial kernel in both directions."""
    gray = image[..., :3].astype(np.float64) @ np.array([0.114, 0.587, 0.299])
    kernel = np.array([1, 4, 6, 4, 1]) / 16
    padded = np.pad(gray, 2, mode="reflect" if min(gray.shape) > 2 else "edge")
    across = sum(k * padded[:, i : i + gray.shape[1]] for i, k in enumerate(kernel))
    return sum(k * across[i : i + gray.shape[0]] for i, k in enumerate(kernel))


def dilated(a: np.ndarray, size: int = 5) -> np.ndarray:
    half = size // 2
    padded = np.pad(a, half, mode="constant")
    across = np.max([padded[:, i : i + a.shape[1]] for i in range(size)], axis=0)
    return np.max([across[i : i + a.shape[0]] for i in range(size)], axis=0)


def regions(mask: np.ndarray) -> int:
    """Number of 8-connected regions, by joining the runs of neighbouring lines."""
    parent: list[int] = []

    def top(x: int) -> int:
        while parent[x] != x:
            x = parent[x]
        return x

    above: list[tuple[int, int, int]] = []
    for line in mask:
        edges = np.flatnonzero(np.diff(np.concatenate([[0], line.astype(np.int8), [0]])))
        here = []
        for start, end in zip(edges[::2], edges[1::2], strict=True):
            name = len(parent)
            parent.append(name)
            for s, e, other in above:
                if s <= end and e >= start:
                    parent[top(name)] = top(other)
            here.append((int(start), int(end), name))
        above = here
    return len({top(i) for i in range(len(parent))})


def moving_regions(before: np.ndarray, now: np.ndarray) -> int:
    change = dilated(np.abs(smooth_gray(now) - smooth_gray(before)))
    return regions(change > CHANGE)


def gradient_hash(image: np.ndarray, size: int = 16) -> np.ndarray:
    """Bits that tell where brightness rises to the right on a coarse grid."""
    gray = resized(image).astype(np.float64).mean(axis=2)
    step = 200 // size
    coarse = gray[: step * size, : step * size].reshape(size, step, size, step).mean(axis=(1, 3))
    return (np.diff(coarse, axis=1) > 0).ravel()


def colour_layout(image: np.ndarray, size: int = 8) -> np.ndarray:
    """Mean colours on a coarse grid, between 0 and 1."""
    step = 200 // size
    cut = resized(image)[: step * size, : step * size].astype(np.float64)
    return cut.reshape(size, step, size, step, 3).mean(axis=(1, 3)).ravel() / 255


def with_boxes(image: np.ndarray, boxes: np.ndarray, colour: tuple[int, int, int] = (0, 255, 0), line: int = 1) -> np.ndarray:
    """A copy of the image with the outlines of (xmin, ymin, xmax, ymax) boxes, clipped to the image."""
    out = image.copy()
    h, w = out.shape[:2]
    for box in boxes:
        x0, y0, x1, y1 = (int(v) for v in (max(0, box[0]), max(0, box[1]), min(w - 1, box[2]), min(h - 1, box[3])))
        if x0 <= x1 and y0 <= y1:
            out[y0 : y0 + line, x0 : x1 + 1] = out[max(y0, y1 - line + 1) : y1 + 1, x0 : x1 + 1] = colour
            out[y0 : y1 + 1, x0 : x0 + line] = out[y0 : y1 + 1, max(x0, x1 - line + 1) : x1 + 1] = colour
    return out
