"""What walks over one image in order: growing from peaks, outlines and their painting, with what these need, in NumPy.

A group is one image of a known size. Everything that sums or compares neighbourhoods is elsewhere, as relations:
stencils, morphology, components, shapes. Connectivity is 8.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame


def gaussian(a: np.ndarray, sigma: float) -> np.ndarray:
    radius = max(1, int(4 * sigma + 0.5))
    k = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    return _separable(a, k / k.sum(), "symmetric")


def _separable(a: np.ndarray, k: np.ndarray, mode: str) -> np.ndarray:
    r = len(k) // 2
    for axis in (0, 1):
        pad = [(r, r) if i == axis else (0, 0) for i in (0, 1)]
        p = np.pad(a, pad, mode)
        a = sum(w * np.take(p, np.arange(i, i + a.shape[axis]), axis) for i, w in enumerate(k))
    return a


def dilate(m: np.ndarray, size: int) -> np.ndarray:
    r = size // 2
    p = np.pad(m, r)
    return np.lib.stride_tricks.sliding_window_view(p, (2 * r + 1, 2 * r + 1)).any(axis=(2, 3))


def erode(m: np.ndarray, size: int) -> np.ndarray:
    r = size // 2
    p = np.pad(m, r, constant_values=True)
    return np.lib.stride_tricks.sliding_window_view(p, (2 * r + 1, 2 * r + 1)).all(axis=(2, 3))


def opened(m: np.ndarray, size: int) -> np.ndarray:
    return dilate(erode(m, size), size)


def shut(m: np.ndarray, size: int) -> np.ndarray:
    return erode(dilate(m, size), size)


def components(m: np.ndarray) -> np.ndarray:
    """Labels 1.. of the 8-connected regions in row-major order of their first pixel; 0 elsewhere."""
    h, w = m.shape
    big = h * w + 1
    lab = np.where(m, np.arange(1, h * w + 1).reshape(h, w), big)
    while True:
        p = np.pad(lab, 1, constant_values=big)
        least = np.lib.stride_tricks.sliding_window_view(p, (3, 3)).min(axis=(2, 3))
        new = np.where(m, np.minimum(lab, least), big)
        flat = np.concatenate([[0], new.ravel(), [big]])[: big + 1]
        new = np.where(m, np.minimum(new, flat[np.where(m, new, 0)]), big)  # a step along the labels' own labels
        if (new == lab).all():
            break
        lab = new
    roots = np.unique(lab[m])
    out = np.zeros((h, w), np.int64)
    out[m] = np.searchsorted(roots, lab[m]) + 1
    return out


def filled(m: np.ndarray) -> np.ndarray:
    """The mask with holes filled: background that 4-connected steps can't reach from the frame."""
    free = np.pad(~m, 1, constant_values=True)
    seen = np.zeros_like(free)
    seen[0, :] = seen[-1, :] = True
    seen[:, 0] = seen[:, -1] = True
    while True:
        grown = seen.copy()
        grown[1:] |= seen[:-1]
        grown[:-1] |= seen[1:]
        grown[:, 1:] |= seen[:, :-1]
        grown[:, :-1] |= seen[:, 1:]
        grown &= free
        grown |= seen
        if (grown == seen).all():
            return ~seen[1:-1, 1:-1]
        seen = grown


def local_peaks(heat: np.ndarray, distance: int, floor: float) -> list[tuple[int, int]]:
    """Pixels above floor that nothing within `distance` (a square) exceeds, away from the frame by that much, highest first; of two that close the first stays."""
    size = 2 * distance + 1
    top = np.lib.stride_tricks.sliding_window_view(np.pad(heat, distance, constant_values=-np.inf), (size, size)).max(axis=(2, 3))
    inside = np.zeros(heat.shape, bool)
    inside[distance : heat.shape[0] - distance, distance : heat.shape[1] - distance] = True
    at = np.argwhere((heat == top) & (heat > floor) & inside)
    kept: list[tuple[int, int]] = []
    for y, x in sorted(map(tuple, at.tolist()), key=lambda p: (-heat[p], p)):
        if all(max(abs(y - a), abs(x - b)) > distance for a, b in kept):
            kept.append((y, x))
    return kept


def watershed(heat: np.ndarray, mask: np.ndarray, markers: list[tuple[int, int]]) -> np.ndarray:
    """Labels 1.. grown from the markers over the mask, highest pixels first, by 4-connected steps; 0 where none reaches."""
    lab, queue, order = np.zeros(heat.shape, np.int64), [], 0
    for i, (y, x) in enumerate(markers, 1):
        if mask[y, x]:
            lab[y, x] = i
            heapq.heappush(queue, (-heat[y, x], order, y, x))
            order += 1
    while queue:
        _, _, y, x = heapq.heappop(queue)
        for a, b in ((y - 1, x), (y, x - 1), (y, x + 1), (y + 1, x)):
            if 0 <= a < heat.shape[0] and 0 <= b < heat.shape[1] and mask[a, b] and not lab[a, b]:
                lab[a, b] = lab[y, x]
                heapq.heappush(queue, (-heat[a, b], order, a, b))
                order += 1
    return lab


def box_mean(a: np.ndarray, size: int) -> np.ndarray:
    """Mean of a square around each pixel, the edge repeated."""
    return _separable(a, np.full(size, 1 / size), "edge")


def clean(m: np.ndarray, min_area: int, open_size: int = 5, close_size: int = 9, fill: bool = False) -> np.ndarray:
    """Opened, closed, with components under min_area dropped, and holes filled if asked."""
    m = shut(opened(m, open_size), close_size)
    lab = components(m)
    m = (np.bincount(lab.ravel()) >= min_area)[lab] & (lab > 0)
    return filled(m) if fill else m


def as_pixels(f: Callable[[np.ndarray], np.ndarray]) -> Callable[[np.ndarray], list[tuple]]:
    """A kernel that gives the pixels of f's raster."""
    return lambda a: [(int(y), int(x), float(v)) for (y, x), v in np.ndenumerate(np.round(f(a), 9))]


# Steps around a pixel, clockwise from the east (y, x).
_AROUND = [(0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1), (-1, 0), (-1, 1)]


def outlines(lab: np.ndarray) -> list[list[tuple[int, int]]]:
    """The outer border of each label 1.. as pixels (x, y), walked clockwise from its first pixel in row-major order."""
    p = np.pad(lab, 1)
    rings = []
    for i in range(1, int(lab.max()) + 1):
        start = tuple(int(v) for v in np.argwhere(p == i)[0])
        at, came, ring = start, 4, []
        while True:
            ring.append((at[1] - 1, at[0] - 1))
            turn = next((k for k in range(1, 9) if p[at[0] + _AROUND[(came + k) % 8][0], at[1] + _AROUND[(came + k) % 8][1]] == i), None)
            if turn is None:
                break
            d = (came + turn) % 8
            step = (at[0] + _AROUND[d][0], at[1] + _AROUND[d][1])
            if at == start and len(ring) > 1 and step == second:
                ring.pop()
                break
            if len(ring) == 1:
                second = step
            at, came = step, (d + 4) % 8
        rings.append(ring)
    return rings


def ring_measures(ring: list[tuple[int, int]]) -> tuple[float, float]:
    """(area, perimeter) of a closed ring."""
    z = np.asarray(ring, float)
    n = np.roll(z, -1, 0)
    return abs(float((z[:, 0] * n[:, 1] - n[:, 0] * z[:, 1]).sum())) / 2, float(np.hypot(*(n - z).T).sum())


def simplified(ring: list[tuple[int, int]], eps: float) -> list[tuple[int, int]]:
    """A closed ring without the points that lie within eps of the line between those kept (Douglas and Peucker), split at the point farthest from the first."""
    z = np.asarray(ring, float)
    if len(z) < 4:
        return ring
    half = int(np.argmax(((z - z[0]) ** 2).sum(1)))
    closed, keep, todo = np.vstack([z, z[:1]]), {0, half}, [(0, half), (half, len(z))]
    while todo:
        a, b = todo.pop()
        if b - a < 2:
            continue
        d, v = closed[b] - closed[a], closed[a + 1 : b] - closed[a]
        length = np.hypot(*d)
        off = np.abs(d[0] * v[:, 1] - d[1] * v[:, 0]) / length if length else np.hypot(*v.T)
        i = int(off.argmax())
        if off[i] > eps:
            keep.add(a + 1 + i)
            todo += [(a, a + 1 + i), (a + 1 + i, b)]
    return [ring[i] for i in sorted(keep)]


def polygons(m: np.ndarray, min_area: float = 200, share: float = 0.004) -> list[list[tuple[int, int]]]:
    """The simplified outer borders of a mask's components whose outlined area is at least min_area, with three points or more."""
    found = []
    for ring in outlines(components(m)):
        area, perimeter = ring_measures(ring)
        if area >= min_area and len(simple := simplified(ring, share * perimeter)) >= 3:
            found.append(simple)
    return found


def painted(rings: list[list[tuple[int, int]]], height: int, width: int, holes: list[list[tuple[int, int]]] = ()) -> np.ndarray:
    """The mask of polygons, borders included, without their holes' interiors."""
    y, x = np.mgrid[:height, :width].astype(float)
    out = np.zeros((height, width), bool)
    for rings_, inside_ in ((rings, True), (holes, False)):
        for ring in rings_:
            odd, edge = np.zeros(out.shape, bool), np.zeros(out.shape, bool)
            for (x0, y0), (x1, y1) in zip(ring, [*ring[1:], ring[0]], strict=True):
                if y0 != y1:
                    odd ^= ((y0 <= y) != (y1 <= y)) & (x < x0 + (y - y0) * (x1 - x0) / (y1 - y0))
                n = max(abs(x1 - x0), abs(y1 - y0), 1)
                for t in range(n + 1):
                    ey, ex = round(y0 + (y1 - y0) * t / n), round(x0 + (x1 - x0) * t / n)
                    if 0 <= ey < height and 0 <= ex < width:
                        edge[ey, ex] = True
            out = out | odd | edge if inside_ else out & ~(odd & ~edge)
    return out


# --- pixel tables as rasters -------------------------------------------------------------------------------------------


def by_image(px: DataFrame, keys: list[str], value: str, height: int, width: int, kernel: Callable[[np.ndarray], list[tuple]], schema: str) -> DataFrame:
    """keys and the rows that kernel gives for each image of a pixel table (keys, y, x, value); absent pixels are 0. A group is one image of a known size."""
    from pyspark.sql.types import StructType

    kinds = StructType([*[px.schema[c] for c in keys], *px.sparkSession.createDataFrame([], schema).schema])

    def run(key, pdf):
        import pandas as pd

        a = np.zeros((height, width))
        a[pdf["y"].to_numpy(), pdf["x"].to_numpy()] = pdf[value].to_numpy(float)
        return pd.DataFrame([(*key, *r) for r in kernel(a)], columns=kinds.fieldNames())

    return px.select(*keys, "y", "x", value).groupBy(*keys).applyInPandas(run, kinds)


def region_pixels(lab: np.ndarray) -> list[tuple]:
    """(region, y, x) of labelled pixels."""
    y, x = np.nonzero(lab)
    return list(zip(lab[y, x].tolist(), y.tolist(), x.tolist(), strict=True))
