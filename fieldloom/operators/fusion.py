"""Fusion of score maps that stand as columns of one pixel table, each in [0, 1]."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# The rules' names, and the constants in `fuse`.
RULES = ("weighted_avg", "geometric_mean", "rank_avg", "min", "max", "gate")


def fuse(rule: str, maps: list[Column], weights: list[float] | None = None) -> Column:
    """The fused score; weights are weighted_avg's alone. For rank_avg, maps are ranks; for gate, the first map is gated by the mean of the others (1 without any)."""
    if rule == "weighted_avg":
        w = weights or [1.0] * len(maps)
        return sum((m * F.lit(float(k)) for m, k in zip(maps, w, strict=True)), F.lit(0.0)) / F.lit(float(sum(w)))
    if rule == "rank_avg":
        return sum(maps, F.lit(0.0)) / F.lit(float(len(maps)))
    if rule == "geometric_mean":
        return F.exp(sum((F.log(m + F.lit(1e-3)) for m in maps), F.lit(0.0)) / F.lit(float(len(maps))))
    if rule == "min":
        return F.least(*maps)
    if rule == "max":
        return F.greatest(*maps)
    if rule == "gate":
        rest = sum(maps[1:], F.lit(0.0)) / F.lit(float(len(maps) - 1)) if len(maps) > 1 else F.lit(1.0)
        return maps[0] * (F.lit(0.4) + F.lit(0.6) * rest)
    raise ValueError(f"unknown rule {rule!r}: one of {RULES}")


def fused_map(px: DataFrame, keys: list[str], maps: list[str], rule: str, height: int, width: int, weights: list[float] | None = None, smooth: float = 3.0, out: str = "v") -> DataFrame:
    """keys, y, x, out: maps of a dense pixel table, each between its 1st and 99th percentile, fused, smoothed by a Gaussian and brought to [0, 1] again."""
    from ..functions import numeric
    from ..sources.scratch import cut
    from . import stencils

    scaled = numeric.norm01_maps(px.select(*keys, "y", "x", *maps), keys, maps)
    if rule == "rank_avg":
        for m in maps:
            scaled = numeric.pixel_rank(scaled.withColumn(m, F.round(m, 9)), keys, m, ["y", "x"], m)
    fused = scaled.select(*keys, "y", "x", fuse(rule, [F.col(m) for m in maps], weights).alias(out))
    smoothed = cut(stencils.gaussian(fused, keys, [out], smooth, height, width), "fused") if smooth else fused
    return numeric.norm01(smoothed, keys, out, out)


def starts(extent: int, size: int, overlap: float) -> list[int]:
    """Where the tiles of an axis begin; the last one is clamped to the edge."""
    last = max(extent - size, 0)
    return sorted({*range(0, last + 1, max(1, round(size * (1 - overlap)))), last})


def tiles(df: DataFrame, width: Column, height: Column, size: int, overlap: float) -> DataFrame:
    """df exploded to tile origins tx, ty; the last tile of each axis is clamped to the edge."""
    step = max(1, round(size * (1 - overlap)))

    def starts(extent: Column) -> Column:
        last = F.greatest(extent - size, F.lit(0))
        return F.array_distinct(F.concat(F.sequence(F.lit(0), last, F.lit(step)), F.array(last)))

    return df.withColumn("ty", F.explode(starts(height.cast("int")))).withColumn("tx", F.explode(starts(width.cast("int"))))


def cosine_weight(offset: Column, size: int) -> Column:
    """A Hann window's value at an offset inside a tile."""
    return 0.5 - 0.5 * F.cos(2 * F.pi() * offset / F.lit(float(size - 1)))


def blend(tiled: DataFrame, keys: list[str], value: str, size: int) -> DataFrame:
    """keys, y, x, v: overlapping tiles (tx, ty, value) blended with cosine windows. Each tile's pixels are exploded, so pixels and tiles meet without a range join."""
    px = tiled.withColumn("dy", F.explode(F.sequence(F.lit(0), F.lit(size - 1)))).withColumn("dx", F.explode(F.sequence(F.lit(0), F.lit(size - 1))))
    px = px.withColumn("w", F.greatest(F.lit(1e-3), cosine_weight(F.col("dy"), size) * cosine_weight(F.col("dx"), size)))
    out = px.groupBy(*keys, (F.col("ty") + F.col("dy")).alias("y"), (F.col("tx") + F.col("dx")).alias("x"))
    return out.agg((F.sum(F.col(value) * F.col("w")) / F.greatest(F.sum("w"), F.lit(1e-6))).alias("v"))
