"""Windows over images that stand as dense pixel tables (keys, y, x, values): no image is held by one task.

An image is cut into tiles of TILE pixels a side; a pixel is copied to the tiles whose halo it is in, about
4 * radius / TILE of the pixels. So one shuffle serves both directions: a kernel works on a tile's frame in NumPy, and
places beyond the border are looked up in it by mapping coordinates. Windows of kernels that aren't separable (waves, entropy) are
spread out a strip of a tile's rows at a time: as rows they would be as many as the window has places, times the
pixels. Medians are aggregates over windows, which hold one row or column of a tile.

Box sums need no halo: they are differences of running totals along whole rows, then along whole columns.

Absent pixels aren't interpolated: make tables dense first (`dense`).
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

TILE = 256
#: Values of windows that a tile's task spreads out at a time.
STRIP = 1 << 20
#: What stands for a null or absent pixel in a frame: a NaN that no arithmetic makes.
NONE = np.array([0x7FF80000DEADBEEF]).view(np.float64)[0]
BORDERS = ("reflect", "mirror", "nearest")


def dense(px: DataFrame, images: DataFrame, keys: list[str], values: dict[str, object], height: int, width: int) -> DataFrame:
    """keys, y, x and the values of every pixel of images (keys) of one size; `values` names them and what an absent pixel has."""
    grid = images.select(*keys).distinct().withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(height - 1)))).withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(width - 1))))
    met = grid.join(px.select(*keys, F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), *values), [*keys, "y", "x"], "left")
    return met.select(*keys, "y", "x", *[F.coalesce(c, F.lit(v)).alias(c) for c, v in values.items()])


def gaussian_kernel(sigma: float) -> list[float]:
    """Weights of a Gaussian, cut off at four deviations, that add up to 1."""
    r = int(4 * sigma + 0.5)
    w = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-r, r + 1)]
    return [v / sum(w) for v in w]


def _check(extent: int, r: int, border: str) -> None:
    if border not in BORDERS:
        raise ValueError(f"unknown border {border!r}: one of {BORDERS}")
    if r > extent - (border == "mirror") and border != "nearest":
        raise ValueError(f"a radius of {r} exceeds an image's side of {extent}")


def _copies(c: Column, extent: int, r: int, border: str) -> Column:
    """Where a coordinate stands, itself and beyond the border: the edge repeated (reflect), not repeated (mirror), or carried on (nearest)."""
    _check(extent, r, border)
    none = F.array().cast("array<int>")
    if border == "nearest":
        low, high = F.sequence(F.lit(-r), F.lit(-1)) if r else none, F.sequence(F.lit(extent), F.lit(extent + r - 1)) if r else none
        return F.concat(F.array(c), F.when(c == 0, low).otherwise(none), F.when(c == extent - 1, high).otherwise(none))
    skip = 1 if border == "mirror" else 0
    low = F.when((c >= skip) & (c < r + skip), F.array(-c - 1 + skip)).otherwise(none)
    high = F.when((c < extent - skip) & (c >= extent - r - skip), F.array(2 * extent - 1 - skip - c)).otherwise(none)
    return F.concat(F.array(c), low, high)


def with_halo(px: DataFrame, keys: list[str], values: Sequence[str], ry: int, rx: int, height: int, width: int, border: str, tile: int = 0) -> DataFrame:
    """keys, ty, tx, y, x, values: every tile's pixels and those up to ry rows and rx columns around it, partitioned by tile."""
    tile = tile or TILE
    out = px.select(*keys, "y", "x", *values)
    for c, r, extent in (("y", ry, height), ("x", rx, width)):
        out = out.withColumn(c, F.explode(_copies(F.col(c), extent, r, border)))
        first = F.greatest(F.lit(0), F.floor((F.col(c) - r) / tile).cast("int"))
        last = F.least(F.lit((extent - 1) // tile), F.floor((F.col(c) + r) / tile).cast("int"))
        out = out.withColumn(f"t{c}", F.explode(F.sequence(first, last)))
    return out.select(*keys, "ty", "tx", "y", "x", *values).repartition(*keys, "ty", "tx")


def _inside(c: str, extent: int, tile: int) -> Column:
    at = F.col(f"t{c}") * tile
    return (F.col(c) >= at) & (F.col(c) < F.least(at + tile, F.lit(extent)))


def _mapped(first: int, end: int, extent: int, border: str | None) -> np.ndarray:
    """Where the coordinates from first to end - 1 stand inside an image, as _copies has it; -1 beyond an image without a border."""
    c = np.arange(first, end)
    if border is None:
        return np.where((c >= 0) & (c < extent), c, -1)
    if border == "nearest":
        return np.clip(c, 0, extent - 1)
    skip = int(border == "mirror")
    return np.where(c < 0, skip - 1 - c, np.where(c >= extent, 2 * extent - 1 - skip - c, c))


def by_tile(px: DataFrame, keys: list[str], values: Sequence[str], ry: int, rx: int, height: int, width: int, border: str | None, outs: Sequence[str], code: Callable[[object], np.ndarray], absent: float, kernel: Callable[[list[np.ndarray]], Sequence], tile: int = 0) -> DataFrame:
    """keys, y, x, outs (doubles): what kernel makes of each tile's frames, one for each value, ry rows and rx columns wider on every side. A group is one tile with its halo.

    code turns an Arrow column of values into numbers; pixels that are absent, or beyond an image without a border, are
    `absent`. kernel gives a column of each out for the tile's pixels in row-major order. Only pixels and their copies for
    neighbouring tiles are shuffled: what stands beyond the border is looked up in the frame.
    """
    tile = tile or TILE
    near = px.select(*keys, "y", "x", *values).filter(F.col("y").between(0, height - 1) & F.col("x").between(0, width - 1))
    for c, r, extent in (("y", ry, height), ("x", rx, width)):
        if border is not None:
            _check(extent, r, border)
        first = F.greatest(F.lit(0), F.floor((F.col(c) - r) / tile).cast("int"))
        near = near.withColumn(f"t{c}", F.explode(F.sequence(first, F.least(F.lit((extent - 1) // tile), F.floor((F.col(c) + r) / tile).cast("int")))))
    kinds = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in px.select(*keys).schema], "y int, x int", *[f"`{n}` double" for n in outs]])

    def run(key, rows):
        import pyarrow as pa

        of, at = [], []
        for k, r, extent in ((key[-2].as_py(), ry, height), (key[-1].as_py(), rx, width)):
            low, high = k * tile, min((k + 1) * tile, extent)
            start, end = max(0, low - r), min(extent, high + r)
            of.append((start, end, low, high))
            places = _mapped(low - r, high + r, extent, border)
            at.append(np.where(places < 0, end - start, places - start))  # one row and column more stand for what is outside
        (y0, y1, ya, yb), (x0, x1, xa, xb) = of
        frames, placed = [], (rows["y"].to_numpy() - y0, rows["x"].to_numpy() - x0)
        for v in values:
            inside = np.full((y1 - y0 + 1, x1 - x0 + 1), absent, type(absent))
            inside[placed] = code(rows[v])
            frames.append(inside[np.ix_(*at)])
        y, x = (m.ravel().astype(np.int32) for m in np.meshgrid(np.arange(ya, yb), np.arange(xa, xb), indexing="ij"))
        return pa.table([*[pa.repeat(k, len(y)) for k in key[:-2]], pa.array(y), pa.array(x), *[pa.array(c) for c in kernel(frames)]], names=[*keys, "y", "x", *outs])

    return near.groupBy(*keys, "ty", "tx").applyInArrow(run, kinds)


def _along(frame: np.ndarray, weights: Sequence[float], axis: int) -> np.ndarray:
    """Each place's neighbours along an axis, weighted; the frame gets narrower."""
    n = frame.shape[axis] - len(weights) + 1
    out = np.zeros([n if i == axis else m for i, m in enumerate(frame.shape)])
    for k, weight in enumerate(weights):
        if weight:
            out += weight * (frame[k : k + n] if axis == 0 else frame[:, k : k + n])
    return out


def _separated(px: DataFrame, keys: list[str], values: Sequence[str], outs: dict[str, tuple[str, Sequence[float], Sequence[float]]], height: int, width: int, border: str, tile: int) -> DataFrame:
    """keys, y, x, outs: each a value weighted along x, then along y (value, along_y, along_x); kernels of one size. Null where a null or absent pixel has a weight."""
    _, ky, kx = next(iter(outs.values()))

    def kernel(frames: list[np.ndarray]) -> list:
        import pyarrow as pa

        made = []
        for value, along_y, along_x in outs.values():
            frame = frames[values.index(value)]
            none = np.isnan(frame) & (frame.view(np.int64) == NONE.view(np.int64))
            out = _along(_along(frame, along_x, 1), along_y, 0).ravel()
            missing = none.any() and _along(_along(none.astype(float), np.abs(along_x), 1), np.abs(along_y), 0).ravel() > 0
            made.append(pa.array(out, mask=missing) if none.any() else out)
        return made

    def code(column) -> np.ndarray:
        out = column.to_numpy().astype(float)
        out[column.is_null().to_numpy()] = NONE
        return out

    return by_tile(px, keys, values, len(ky) // 2, len(kx) // 2, height, width, border, list(outs), code, float(NONE), kernel, tile)


def separable(px: DataFrame, keys: list[str], values: Sequence[str], along_y: Sequence[float], along_x: Sequence[float], height: int, width: int, border: str = "reflect", tile: int = 0) -> DataFrame:
    """keys, y, x and the values, each weighted by along_x over its row's neighbours, then by along_y over its column's. Kernels have odd lengths."""
    return _separated(px, keys, values, {v: (v, along_y, along_x) for v in values}, height, width, border, tile)


def gaussian(px: DataFrame, keys: list[str], values: Sequence[str], sigma: float, height: int, width: int, tile: int = 0) -> DataFrame:
    """keys, y, x and the values, smoothed; borders are reflected."""
    k = gaussian_kernel(sigma)
    return separable(px, keys, values, k, k, height, width, "reflect", tile)


def median(px: DataFrame, keys: list[str], value: str, size: int, height: int, width: int, tile: int = 0) -> DataFrame:
    """keys, y, x, value: the median of the size x size window (size odd), the border carried on. A frame holds size rows of a column's windows."""
    tile, r = tile or TILE, size // 2
    out = with_halo(px, keys, [value], r, r, height, width, "nearest", tile)
    across = Window.partitionBy(*keys, "ty", "tx", "y").orderBy("x").rowsBetween(-r, r)
    rows = out.withColumn("__row", F.collect_list(value).over(across)).filter(_inside("x", width, tile))
    down = Window.partitionBy(*keys, "ty", "tx", "x").orderBy("y").rowsBetween(-r, r)
    box = rows.withColumn("__box", F.collect_list("__row").over(down)).filter(_inside("y", height, tile))
    return box.select(*keys, "y", "x", F.get(F.array_sort(F.flatten("__box")), F.lit(size * size // 2)).alias(value))


def _strips(frame: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """The size x size windows of a frame, some rows at a time: of each strip the windows of its pixels, as a view."""
    windows = np.lib.stride_tricks.sliding_window_view(frame, (size, size))
    step = max(1, STRIP // (windows.shape[1] * size * size))
    return (windows[i : i + step].reshape(-1, size, size) for i in range(0, len(windows), step))


def _answers(px: DataFrame, keys: list[str], value: str, kernels: list[list[list[float]]], height: int, width: int, border: str, tile: int, outs: Sequence[str], of: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """keys, y, x, outs: `of` the kernels' answers (pixels x kernels) as columns of outs."""
    size = len(kernels[0])
    bank = np.array(kernels, float).reshape(len(kernels), -1).T

    def kernel(frames: list[np.ndarray]) -> np.ndarray:
        return np.concatenate([of(w.reshape(len(w), -1) @ bank) for w in _strips(frames[0], size)]).T

    some = px.filter(F.col(value).isNotNull()).withColumn(value, F.col(value).cast("double"))
    return by_tile(some, keys, [value], size // 2, size // 2, height, width, border, outs, lambda c: c.to_numpy(), 0.0, kernel, tile)


def weighted(px: DataFrame, keys: list[str], value: str, kernels: dict[str, list[list[float]]], height: int, width: int, border: str = "mirror", tile: int = 0) -> DataFrame:
    """keys, y, x and a column for each kernel (square, of one odd size, not separable): the sum of its weights times the pixels around. Nulls and absent pixels add nothing."""
    return _answers(px, keys, value, list(kernels.values()), height, width, border, tile, list(kernels), lambda a: a)


def strongest(px: DataFrame, keys: list[str], value: str, kernels: list[list[list[float]]], height: int, width: int, border: str = "mirror", tile: int = 0) -> DataFrame:
    """keys, y, x, value: the largest answer, of either sign, of kernels as in `weighted`; only this leaves the tile's task."""
    return _answers(px, keys, value, kernels, height, width, border, tile, [value], lambda a: np.abs(a).max(axis=1, keepdims=True))


def entropy(px: DataFrame, keys: list[str], level: str, radius: int, height: int, width: int, out: str = "entropy", tile: int = 0) -> DataFrame:
    """keys, y, x, out: the bits of the levels' distribution over the disk around each pixel, as far as it is inside the image. Null is a level.

    A pixel's levels are sorted, so its counts are the lengths of runs; no row is made for a place of the disk.
    """
    size, d = 2 * radius + 1, np.arange(-radius, radius + 1)
    disk = d[:, None] ** 2 + d**2 <= radius**2
    counts = np.arange(disk.sum() + 1)
    spread = counts * np.log2(np.maximum(counts, 1))

    def bits(near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        near.sort(axis=1)
        new = np.ones(near.shape, bool)
        new[:, 1:] = near[:, 1:] != near[:, :-1]
        at = np.flatnonzero(new)
        n = np.where(near.ravel()[at] < 0, 0, np.diff(at, append=near.size))
        rows = np.searchsorted(at, np.arange(0, near.size, near.shape[1]))
        return np.add.reduceat(n, rows), np.add.reduceat(spread[n], rows)

    def kernel(frames: list[np.ndarray]) -> list:
        import pyarrow as pa

        frame = frames[0].astype(np.int16) if frames[0].max() < 1 << 15 else frames[0]
        n, s = (np.concatenate(a) for a in zip(*[bits(w[:, disk]) for w in _strips(frame, size)], strict=True))
        some = np.maximum(n, 1)
        return [pa.array(np.log2(some) - s / some, mask=n == 0)]

    def code(column) -> np.ndarray:
        import pandas as pd

        return pd.factorize(column.to_pandas(), use_na_sentinel=False)[0]

    return by_tile(px, keys, [level], radius, radius, height, width, None, [out], code, -1, kernel, tile).filter(F.col(out).isNotNull())  # null: nothing around


def local_contrast(px: DataFrame, keys: list[str], value: str, height: int, width: int, share: float = 0.12) -> DataFrame:
    """px with value less its surroundings (a Gaussian of a share of the shorter side, 4 pixels at least), between its 1st and 99th percentile."""
    from ..functions.numeric import norm01

    around = gaussian(px, keys, [value], max(4, int(share * min(height, width))), height, width).withColumnRenamed(value, "__around")
    high = px.join(around, [*keys, "y", "x"]).withColumn(value, F.col(value) - F.col("__around")).drop("__around")
    return norm01(high, keys, value, value)


def gradients(px: DataFrame, keys: list[str], value: str, height: int, width: int) -> DataFrame:
    """keys, y, x, gx, gy: Sobel slopes; the border is mirrored."""
    slope, smooth = [-1.0, 0.0, 1.0], [1.0, 2.0, 1.0]
    return _separated(px, keys, [value], {"gx": (value, smooth, slope), "gy": (value, slope, smooth)}, height, width, "mirror", 0)


def coherence(px: DataFrame, keys: list[str], value: str, height: int, width: int, sigma: float = 6.0) -> DataFrame:
    """keys, y, x, value: from 0 (no direction prevails) to 1 (one does), by the eigenvalues of the smoothed products of slopes."""
    g = gradients(px, keys, value, height, width)
    products = g.select(*keys, "y", "x", (F.col("gx") * F.col("gx")).alias("xx"), (F.col("gy") * F.col("gy")).alias("yy"), (F.col("gx") * F.col("gy")).alias("xy"))
    t = gaussian(products, keys, ["xx", "yy", "xy"], sigma, height, width)
    apart = F.sqrt(F.pow(F.col("xx") - F.col("yy"), F.lit(2)) + 4 * F.col("xy") * F.col("xy"))
    return t.select(*keys, "y", "x", F.greatest(F.lit(0.0), F.least(F.lit(1.0), apart / (F.col("xx") + F.col("yy") + F.lit(1e-6)))).alias(value))


# --- summed areas ------------------------------------------------------------------------------------------------------


def integral(px: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, y, x, total: the sum over all pixels up to y and x. Windows hold one row or column of an image."""
    row = Window.partitionBy(*keys, "y").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    column = Window.partitionBy(*keys, "x").orderBy("y").rowsBetween(Window.unboundedPreceding, 0)
    rows = px.select(*keys, "y", "x", F.sum(value).over(row).alias("total"))
    return rows.select(*keys, "y", "x", F.sum("total").over(column).alias("total"))


def box_totals(boxes: DataFrame, totals: DataFrame, keys: list[str], ident: Sequence[str]) -> DataFrame:
    """keys, ident, total: the sum inside each box [x0, x1) x [y0, y1) of an integral image, by four lookups; 0 for an empty one."""
    corner = lambda y, x, sign: F.struct((F.col(y) - 1).alias("y"), (F.col(x) - 1).alias("x"), F.lit(sign).alias("sign"))
    corners = F.array(corner("y1", "x1", 1), corner("y0", "x1", -1), corner("y1", "x0", -1), corner("y0", "x0", 1))
    at = boxes.filter("x0 < x1 AND y0 < y1").select(*keys, *ident, F.explode(corners).alias("c")).select(*keys, *ident, "c.*")
    met = at.filter("y >= 0 AND x >= 0").join(totals, [*keys, "y", "x"])
    sums = met.groupBy(*keys, *ident).agg(F.sum(F.col("sign") * F.col("total")).alias("total"))
    return boxes.select(*keys, *ident).join(sums, [*keys, *ident], "left").withColumn("total", F.coalesce("total", F.lit(0)))


def box_sums(px: DataFrame, keys: list[str], value: str, size: int, total: str, n: str) -> DataFrame:
    """px with total and n: the sum over the size x size window (size odd), and the number of its pixels inside the image. Exact for whole numbers."""
    r = size // 2
    sums = px.withColumns({"__s": F.col(value), "__n": F.lit(1)})
    for c, other in (("x", "y"), ("y", "x")):
        w = Window.partitionBy(*keys, other).orderBy(c)
        upto = w.rowsBetween(Window.unboundedPreceding, 0)
        ran = sums.withColumns({f"{s}_upto": F.sum(s).over(upto) for s in ("__s", "__n")})
        for s in ("__s", "__n"):
            last = F.coalesce(F.lead(f"{s}_upto", r).over(w), F.last(f"{s}_upto").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
            ran = ran.withColumn(s, last - F.coalesce(F.lag(f"{s}_upto", r + 1).over(w), F.lit(0)))
        sums = ran.drop("__s_upto", "__n_upto")
    return sums.withColumnsRenamed({"__s": total, "__n": n})


def box_mean(px: DataFrame, keys: list[str], value: str, size: int, out: str) -> DataFrame:
    """px with out: the mean over the size x size window (size odd), of its pixels inside the image only."""
    sums = box_sums(px, keys, value, size, "__total", "__count")
    return sums.withColumn(out, F.col("__total") / F.col("__count")).drop("__total", "__count")
