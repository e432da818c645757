"""Morphology of masks that stand as runs (keys, y, x0, x1): boxes as structuring elements, outside of the image neutral.

A dilation lengthens runs and copies them to the rows within reach, then unites what overlaps; an erosion is
the dilation of the complement. Work grows with the runs and the element's height, not with its area.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from . import components


def united(table: DataFrame, keys: list[str]) -> DataFrame:
    """keys, y, x0, x1: runs without overlap or touch. A window holds one row of one image."""
    row = Window.partitionBy(*keys, "y").orderBy("x0", "x1")
    reached = F.max("x1").over(row.rowsBetween(Window.unboundedPreceding, -1))
    begun = table.withColumn("__new", F.when(F.col("x0") <= reached + 1, 0).otherwise(1))
    joined = begun.withColumn("__of", F.sum("__new").over(row.rowsBetween(Window.unboundedPreceding, 0)))
    return joined.groupBy(*keys, "y", "__of").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1")).drop("__of")


def dilated(table: DataFrame, keys: list[str], size: int, height: int, width: int) -> DataFrame:
    """The runs within size // 2 pixels, in both directions, of a mask's."""
    r = size // 2
    reach = F.sequence(F.greatest(F.lit(0), F.col("y") - r), F.least(F.lit(height - 1), F.col("y") + r))
    wide = table.select(*keys, F.explode(reach).alias("y"), F.greatest(F.lit(0), F.col("x0") - r).alias("x0"), F.least(F.lit(width - 1), F.col("x1") + r).alias("x1"))
    return united(wide, keys)


def eroded(table: DataFrame, images: DataFrame, keys: list[str], size: int, height: int, width: int) -> DataFrame:
    """The runs of the pixels whose whole neighbourhood inside the image is set."""
    rest = dilated(components.gaps(table, images, keys, height, width), keys, size, height, width)
    return components.gaps(rest, images, keys, height, width)


def opened(table: DataFrame, images: DataFrame, keys: list[str], size: int, height: int, width: int) -> DataFrame:
    return dilated(eroded(table, images, keys, size, height, width), keys, size, height, width)


def closed(table: DataFrame, images: DataFrame, keys: list[str], size: int, height: int, width: int) -> DataFrame:
    return eroded(dilated(table, keys, size, height, width), images, keys, size, height, width)


def border(table: DataFrame, images: DataFrame, keys: list[str], height: int, width: int) -> DataFrame:
    """keys, y, x: the set pixels with an unset one among their eight neighbours inside the image."""
    inner = components.pixels_of(eroded(table, images, keys, 3, height, width), *keys)
    return components.pixels_of(united(table, keys), *keys).join(inner, [*keys, "y", "x"], "left_anti")


def boundary_f1(pred: DataFrame, truth: DataFrame, images: DataFrame, keys: list[str], height: int, width: int, tolerance: int) -> DataFrame:
    """keys, f1 of two masks' borders, matched within a square of `tolerance` pixels; 0 where no border pixel is met."""
    of = {n: border(m, images, keys, height, width) for n, m in (("p", pred), ("t", truth))}
    near = {n: components.pixels_of(dilated(components.runs(b, keys), keys, 2 * tolerance + 1, height, width), *keys) for n, b in of.items()}
    hit = lambda a, b: of[a].join(near[b].withColumn("__hit", F.lit(1)), [*keys, "y", "x"], "left").groupBy(*keys).agg(F.count("__hit").alias(f"hit_{a}"), F.count(F.lit(1)).alias(f"all_{a}"))
    counts = images.select(*keys).distinct().join(hit("p", "t"), keys, "left").join(hit("t", "p"), keys, "left")
    precision, recall = (F.coalesce(F.try_divide(F.col(f"hit_{a}").cast("double"), F.col(f"all_{a}")), F.lit(0.0)) for a in "pt")
    return counts.select(*keys, F.coalesce(F.try_divide(2 * precision * recall, precision + recall), F.lit(0.0)).alias("f1"))
