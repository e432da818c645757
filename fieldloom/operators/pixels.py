"""Operators over pixel tables: one row a pixel (keys, y, x and columns), so that images of any size are split among tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .ordered import percentiles


def hsv(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """Hue in 0..179, saturation and value in 0..255, of colours in 0..255; hue of grey is 0."""
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    span = (top - low).cast("double")
    sector = F.when(top == r, 60.0 * (g - b) / span).when(top == g, 120.0 + 60.0 * (b - r) / span).otherwise(240.0 + 60.0 * (r - g) / span)
    degrees = F.when(span == 0, 0.0).otherwise(F.when(sector < 0, sector + 360.0).otherwise(sector))
    hue = (F.floor(degrees / 2 + 0.5).cast("int")) % 180
    return hue, F.when(top == 0, 0).otherwise(F.floor(255.0 * span / top + 0.5).cast("int")), top


def colour_stats(px: DataFrame, keys: list[str], r: Column, g: Column, b: Column, height: int, width: int) -> DataFrame:
    """keys, sat_fraction, yellow_px, red_px, has_white_margin, has_left_info_panel of images of one size."""
    h, s, v = F.col("__h"), F.col("__s"), F.col("__v")
    white = (v > 235) & (s < 20)
    edge = max(2, int(0.02 * min(height, width)))
    border = (F.col("y") < edge) | (F.col("y") >= height - edge) | (F.col("x") < edge) | (F.col("x") >= width - edge)
    left = F.col("x") < int(0.16 * width)
    share = lambda c, where: F.avg(F.when(where, c.cast("double")))
    hue, saturation, value = hsv(r, g, b)
    whole = F.lit(True)
    return px.withColumns({"__h": hue, "__s": saturation, "__v": value}).groupBy(*keys).agg(
        share((s > 40) & (v > 40), whole).alias("sat_fraction"),
        F.count_if(h.between(20, 38) & (s > 90) & (v > 120)).alias("yellow_px"),
        F.count_if(((h <= 8) | (h >= 170)) & (s > 110) & (v > 90)).alias("red_px"),
        F.coalesce((share(white, border) > 0.15) | (share(white, whole) > 0.10), F.lit(False)).alias("has_white_margin"),
        F.coalesce(share(white, left) > 0.45, F.lit(False)).alias("has_left_info_panel"),
    )


def outside_panel(x: Column, width: int, is_layout: Column) -> Column:
    """Whether a pixel counts: the left 17.5 % of a map layout doesn't."""
    return ~(is_layout & (x < int(0.175 * width)))


def box_pixels(boxes: DataFrame, keys: list[str], corners: list[str], height: int, width: int) -> DataFrame:
    """keys, y, x: the distinct pixels of boxes [x0, y0, x1, y1], rounded half to even, clipped, ending before the last."""
    edge = lambda c: F.bround(F.col(c), 0).cast("int")
    z = F.lit(0)
    clipped = boxes.select(*keys, F.greatest(z, edge(corners[0])).alias("__x0"), F.greatest(z, edge(corners[1])).alias("__y0"), F.least(F.lit(width), edge(corners[2])).alias("__x1"), F.least(F.lit(height), edge(corners[3])).alias("__y1"))
    some = clipped.filter("__x1 > __x0 AND __y1 > __y0")
    rows = some.withColumn("y", F.explode(F.sequence("__y0", F.col("__y1") - 1)))
    return rows.withColumn("x", F.explode(F.sequence("__x0", F.col("__x1") - 1))).select(*keys, "y", "x").distinct()


def centre_labels(tiles: DataFrame, px: DataFrame, keys: list[str], size: int, height: int, width: int) -> DataFrame:
    """tiles (keys, ty, tx) with label by the pixel in the middle (clamped to the image): 1 where pos, else 0 where neg, else -1."""
    at = tiles.withColumn("y", F.least(F.col("ty") + size // 2, F.lit(height - 1))).withColumn("x", F.least(F.col("tx") + size // 2, F.lit(width - 1)))
    label = F.when(F.col("pos"), 1).when(F.col("neg"), 0).otherwise(-1)
    return at.join(px.select(*keys, "y", "x", "pos", "neg"), [*keys, "y", "x"], "left").withColumn("label", label).drop("y", "x", "pos", "neg")


def _origins(at: str, extent: int, size: int, step: int) -> Column:
    """The origins of the full tiles that hold a coordinate."""
    last = (extent - size) // step
    first = F.greatest(F.lit(0), F.ceil((F.col(at) - size + 1) / step).cast("int"))
    upto = F.least(F.lit(last), F.floor(F.col(at) / step).cast("int"))
    return F.when(first <= upto, F.transform(F.sequence(first, upto), lambda k: k * step)).otherwise(F.array().cast("array<int>"))


def majority_labels(px: DataFrame, keys: list[str], size: int, step: int, height: int, width: int) -> DataFrame:
    """keys, ty, tx, label of full tiles: 1 where over half of their area is pos, else 0 where over half is neg, else -1. Absent pixels are neither."""
    met = px.withColumn("ty", F.explode(_origins("y", height, size, step))).withColumn("tx", F.explode(_origins("x", width, size, step)))
    share = lambda c: F.count_if(F.col(c)) / F.lit(float(size * size))
    label = F.when(share("pos") > 0.5, 1).when(share("neg") > 0.5, 0).otherwise(-1)
    return met.groupBy(*keys, "ty", "tx").agg(label.alias("label"))


def flat_overlap(tiled: DataFrame, keys: list[str], value: str, size: int) -> DataFrame:
    """keys, y, x, v: the plain mean of the tiles (ty, tx, value) over each pixel."""
    px = tiled.withColumn("y", F.explode(F.sequence(F.col("ty"), F.col("ty") + size - 1))).withColumn("x", F.explode(F.sequence(F.col("tx"), F.col("tx") + size - 1)))
    return px.groupBy(*keys, "y", "x").agg(F.avg(value).alias("v"))


def above_sigma(px: DataFrame, keys: list[str], value: str, k: float) -> DataFrame:
    """The pixels at or above mean + k population deviations of their image."""
    limits = px.groupBy(*keys).agg(F.round(F.avg(value) + k * F.stddev_pop(value), 9).alias("__limit"))
    return px.join(limits, keys).filter(F.col(value) >= F.col("__limit")).drop("__limit")


def above_percentiles(px: DataFrame, keys: list[str], value: str, levels: list[int]) -> DataFrame:
    """keys, y, x, value, level: each pixel once for every percentile of its image that it reaches."""
    q = percentiles(px, keys, value, [p / 100 for p in levels], "__q")
    pairs = F.zip_with(F.array(*[F.lit(p) for p in levels]), "__q", lambda p, t: F.struct(p.alias("level"), F.round(t, 9).alias("limit")))
    met = px.join(q, keys).withColumn("__z", F.explode(F.filter(pairs, lambda z: F.col(value) >= z["limit"])))
    return met.select(*keys, "y", "x", value, F.col("__z.level").alias("level"))


def peak(px: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, y, x: the highest pixel, the first in row-major order among equals."""
    best = px.groupBy(*keys).agg(F.max(F.struct(F.col(value), -F.col("y"), -F.col("x"))).alias("b"))
    return best.select(*keys, (-F.col("b.col2")).alias("y"), (-F.col("b.col3")).alias("x"))


def exact_mean(value: str) -> Column:
    """The mean of a group's values, whatever their order: summed to 18 decimals. Values that no decimal(28, 18) holds (NaN, 10^10 and more) are averaged as doubles."""
    exact = F.col(value).cast("double").try_cast("decimal(28, 18)")
    mean = (F.sum(exact).cast("decimal(28, 18)") / F.count(exact).cast("decimal(10, 0)")).cast("double")
    return F.when(F.count(exact) == F.count(value), mean).otherwise(F.avg(value))


def regions(px: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, area, confidence, cy, cx (means) and the box x0, y0, x1, y1, ending one past the last pixel, of labelled pixels."""
    end = lambda c: F.max(c) + 1
    return px.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("area"), exact_mean(value).alias("confidence"), F.avg("y").alias("cy"), F.avg("x").alias("cx"),
        F.min("x").alias("x0"), F.min("y").alias("y0"), end("x").alias("x1"), end("y").alias("y1"),
    )


def ranked(found: DataFrame, keys: list[str], first: Column | None, k: int | None) -> DataFrame:
    """Regions with rank by confidence, one for each centroid rounded (half to even) to 10 pixels: the first by `first`, else the most confident."""
    cells = found.withColumn("__cy", F.bround("cy", -1)).withColumn("__cx", F.bround("cx", -1))
    best = [F.round("confidence", 9).desc(), F.col("level"), F.col("region")]
    keep = Window.partitionBy(*keys, "__cy", "__cx").orderBy(*([first, F.col("region")] if first is not None else best))
    one = cells.withColumn("__n", F.row_number().over(keep)).filter("__n = 1")
    out = one.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*best))).drop("__n", "__cy", "__cx")
    return out.filter(F.col("rank") <= k) if k else out


def prompts(px: DataFrame, keys: list[str], value: str, shrink: float) -> DataFrame:
    """keys, the region's box (x0, y0, x1, y1: last pixels inside), the box drawn in by a share of its sides, and its peak."""
    b = px.groupBy(*keys).agg(*[f(c).alias(n) for n, f, c in (("x0", F.min, "x"), ("y0", F.min, "y"), ("x1", F.max, "x"), ("y1", F.max, "y"))])
    dw, dh = (((F.col(f"{a}1") - F.col(f"{a}0")) * F.lit(shrink)).cast("int") for a in "xy")
    inner = b.select("*", (F.col("x0") + dw).alias("ex0"), (F.col("y0") + dh).alias("ey0"), (F.col("x1") - dw).alias("ex1"), (F.col("y1") - dh).alias("ey1"))
    return inner.join(peak(px, keys, value).select(*keys, F.col("y").alias("peak_y"), F.col("x").alias("peak_x")), keys)


def box_or_points(px: DataFrame, keys: list[str], box: Column, points: Column) -> DataFrame:
    """The pixels of box and points where the points' mask is over a tenth of the box's, else of the box alone."""
    n = px.groupBy(*keys).agg((F.count_if(points) > 0.1 * F.count_if(box)).alias("__both"))
    return px.join(n, keys).filter(box & (points | ~F.col("__both"))).drop("__both")


def simple_scores(px: DataFrame, keys: list[str], pred: Column, pos: Column, neg: Column) -> DataFrame:
    """iou, coverage, fp_on_black (null without neg) with 1e-6 in the denominators, pred_area_frac, and leak: the share of neg hit, over at least one pixel."""
    n = lambda c: F.count_if(c).cast("double")
    four = lambda c: F.bround(c, 4)
    eps = 1e-6
    return px.groupBy(*keys).agg(
        four(n(pred & pos) / (n(pred | pos) + eps)).alias("iou"), four(n(pred & pos) / (n(pos) + eps)).alias("coverage"),
        F.when(n(neg) > 0, four(n(pred & neg) / (n(neg) + eps))).alias("fp_on_black"), four(n(pred) / F.count(F.lit(1))).alias("pred_area_frac"),
        (n(pred & neg) / F.greatest(n(neg), F.lit(1.0))).alias("leak"),
    )
