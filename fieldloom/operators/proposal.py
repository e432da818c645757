"""Regions proposed from heat maps that stand as pixel tables, and the prompts that follow from them.

Thresholds, areas, confidences, ranks and prompts are aggregates over pixels; cleaning and labelling work on runs; only growing from
peaks (B_localmax and watershed) walks over one image a group. Masks are opened by 5 and closed by 9; connectivity is 8. An
image without a region gives no row; an unknown method is an error.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from ..sources.scratch import cut
from . import components, morphology, pixels, raster, select, stencils

# Percentiles of the methods.
LEVELS = {"multi_thresh": [55, 65, 75, 85], "stability": [55, 62, 70, 78, 86], "D_multithresh": [60, 70, 80, 90]}
METHODS = ("A_threshold", "B_localmax", "C_adaptive", "D_multithresh", "multi_thresh", "adaptive", "watershed", "stability")


def grown(h: np.ndarray, apart: int) -> np.ndarray:
    """Labels grown from the peaks that keep `apart` pixels, over the upper 45 % of a raster."""
    peaks = raster.local_peaks(h, apart, h.mean() + 0.3 * h.std())
    return raster.watershed(h, h >= np.percentile(h, 55), peaks)


def _above_around(heat: DataFrame, keys: list[str], value: str, kernel: list[float], border: str, above: float, height: int, width: int) -> DataFrame:
    """The pixels that exceed their surroundings' weighted mean by `above` grey levels, and are not below the image's mean."""
    grey = heat.select(*keys, "y", "x", value, F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(value))) * 255).cast("double").alias("__g"))
    around = stencils.separable(grey, keys, ["__g"], kernel, kernel, height, width, border).withColumnRenamed("__g", "__a")
    mean = grey.groupBy(*keys).agg(F.avg(value).alias("__m"))
    met = grey.join(around, [*keys, "y", "x"]).join(mean, keys)
    return met.filter((F.col("__g") > F.round("__a", 6) + above) & (F.col(value) >= F.col("__m"))).select(*keys, "y", "x", value)


def masks(heat: DataFrame, keys: list[str], value: str, method: str, height: int, width: int) -> DataFrame:
    """keys, level, y, x: the pixels that a method's thresholds leave, before cleaning."""
    if method == "A_threshold":
        found = pixels.above_sigma(heat, keys, value, 1.0).withColumn("level", F.lit(0))
    elif method == "C_adaptive":
        found = _above_around(heat, keys, value, [1 / 51] * 51, "nearest", 5, height, width).withColumn("level", F.lit(0))
    elif method == "adaptive":
        found = _above_around(heat, keys, value, stencils.gaussian_kernel(9.5), "reflect", 8, height, width).withColumn("level", F.lit(0))
    else:
        found = pixels.above_percentiles(heat, keys, value, LEVELS[method])
        if method == "stability":
            found = found.groupBy(*keys, "y", "x").agg(F.count(F.lit(1)).alias("n")).filter("n >= 3").withColumn("level", F.lit(0))
    return found.select(*keys, "level", "y", "x")


def labelled(px: DataFrame, keys: list[str], value: str, method: str, height: int, width: int, apart: int = 25) -> DataFrame:
    """keys, level, region, y, x and value: the pixels of each region that the method finds, of any area. Absent pixels are 0."""
    if method not in METHODS:
        raise ValueError(f"unknown method {method!r}: one of {METHODS}")
    first = method[0].isupper()
    heat = stencils.dense(px, px, keys, {value: 0.0}, height, width)
    if first:
        heat = stencils.gaussian(cut(heat, "dense"), keys, [value], 9, height, width)
    heat = cut(heat.select(*keys, "y", "x", value), "heat")
    if method in ("B_localmax", "watershed"):
        grow = (lambda a: grown(a, apart)) if first else (lambda a: grown(raster.gaussian(a, 7), apart))
        found = raster.by_image(heat.withColumn("level", F.lit(0)), [*keys, "level"], value, height, width, lambda a: raster.region_pixels(grow(a)), "region int, y int, x int")
        return found.join(heat, [*keys, "y", "x"])
    each, images = [*keys, "level"], heat.select(*keys).distinct()
    levels = images.withColumn("level", F.explode(F.array(*[F.lit(v) for v in LEVELS.get(method, [0]) if method != "stability"] or [F.lit(0)])))
    runs = components.runs(masks(heat, keys, value, method, height, width), each)
    opened = cut(morphology.opened(runs, levels, each, 5, height, width), "opened")
    clean = cut(morphology.closed(opened, levels, each, 9, height, width), "closed")
    if not first:
        clean = morphology.united(components.filled(clean, levels, each, height, width), each)
    found = components.connected(clean, each)
    names = found.select(*each, "region").distinct().withColumn("n", F.row_number().over(Window.partitionBy(*each).orderBy("region")))
    at = components.pixels_of(found.join(names, [*each, "region"]).drop("region"), *each, "n").withColumnRenamed("n", "region")
    return cut(at.join(heat, [*keys, "y", "x"]).select(*each, "region", "y", "x", value), "labelled")


def propose(px: DataFrame, keys: list[str], value: str, method: str, height: int, width: int, min_area: float, k: int = 6, apart: int = 25) -> tuple[DataFrame, DataFrame]:
    """(regions, their pixels): regions of at least min_area, one a rounded centroid, with rank by confidence.

    D_multithresh keeps the lowest level's region of a centroid and all ranks, as A to C do; the others keep the most confident, and k of them.
    """
    at = labelled(px, keys, value, method, height, width, apart)
    rows = pixels.regions(at, [*keys, "level", "region"], value).filter(F.col("area") >= min_area)
    late = method == "D_multithresh"
    if method[0].isupper() and not late:
        found = select.top_k(rows, keys, 1 << 30, F.round("confidence", 9).desc(), F.col("region"))
    else:
        found = pixels.ranked(rows, keys, F.col("level") if late else None, None if late else k)
    return found, at.join(found.select(*keys, "level", "region", "rank"), [*keys, "level", "region"])


def region_prompts(at: DataFrame, keys: list[str], value: str, shrink: float = 0.05) -> DataFrame:
    """One row a region: its box, the box drawn in, its peak, and `apart`, the distance that its points keep."""
    p = pixels.prompts(at, [*keys, "level", "region"], value, shrink)
    side = F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))
    return p.withColumn("apart", F.greatest(F.lit(8), (0.15 * side).cast("int")).cast("double"))


def positive_points(at: DataFrame, prompts: DataFrame, keys: list[str], value: str, k: int = 6) -> DataFrame:
    """Up to k points a region, the highest first, each farther than `apart` from those before."""
    ids = [*keys, "level", "region"]
    met = at.select(*ids, "y", "x", value).join(prompts.select(*ids, "apart"), ids)
    return select.spaced_points(met, ids, "y", "x", value, k, "apart", pool=None).drop("apart")


def negative_points(at: DataFrame, prompts: DataFrame, negative: DataFrame, keys: list[str], value: str, height: int, width: int, k: int = 4) -> DataFrame:
    """Up to k spaced points among the 200 of most negative heat (negative: keys, y, x, value) within 15 pixels outside a region."""
    ids = [*keys, "level", "region"]
    own = components.runs(at, ids)
    near = components.pixels_of(morphology.dilated(own, ids, 31, height, width), *ids)
    outside = near.join(at.select(*ids, "y", "x"), [*ids, "y", "x"], "left_anti")
    met = outside.join(negative.select(*keys, "y", "x", value), [*keys, "y", "x"]).join(prompts.select(*ids, "apart"), ids)
    return select.spaced_points(met.select(*ids, "y", "x", value, "apart"), ids, "y", "x", value, k, "apart").drop("apart")
