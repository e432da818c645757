"""Rounding, normalisation and ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def even_round(c: Column, places: int) -> Column:
    """Half-to-even rounding."""
    return F.bround(c, places)


def norm01(df: DataFrame, keys: list[str], value: str, out: str, low: float = 0.01, high: float = 0.99) -> DataFrame:
    """df with out: value between its group's percentiles, clipped to [0, 1]; null where value is. Exact, linearly interpolated percentiles."""
    from ..operators.ordered import attach, percentiles

    met = attach(df, percentiles(df, keys, value, [low, high], "__q"), keys, "left")
    lo, hi = F.get("__q", F.lit(0)), F.get("__q", F.lit(1))
    scaled = (F.col(value) - lo) / (hi - lo + F.lit(1e-6))
    clipped = F.when(scaled.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), scaled)))
    return met.withColumn(out, clipped).drop("__q")


def norm01_maps(df: DataFrame, keys: list[str], values: list[str], low: float = 0.01, high: float = 0.99) -> DataFrame:
    """df with each of the values between its group's percentiles, as norm01 does, from one search for all of them."""
    from ..operators.ordered import attach, percentiles

    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("__map"), F.col(c).cast("double").alias("__v")) for c in values]))
    long = df.select(*keys, pairs.alias("p")).select(*keys, "p.*")
    bounds = percentiles(long, [*keys, "__map"], "__v", [low, high], "__q").groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("__map", "__q"))).alias("__at"))

    def scaled(c: str) -> Column:
        q = F.element_at("__at", F.lit(c))
        v = (F.col(c) - F.get(q, F.lit(0))) / (F.get(q, F.lit(1)) - F.get(q, F.lit(0)) + F.lit(1e-6))
        return F.when(v.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), v)))

    return attach(df, bounds, keys, "left").withColumns({c: scaled(c) for c in values}).drop("__at")


def minmax(df: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """df with out: value between its group's extremes; 0 where they are equal."""
    bounds = df.groupBy(*keys).agg(F.min(value).alias("__lo"), F.max(value).alias("__hi"))
    return df.join(bounds, keys).withColumn(out, F.coalesce(F.try_divide(F.col(value) - F.col("__lo"), F.col("__hi") - F.col("__lo")), F.lit(0.0))).drop("__lo", "__hi")


def pixel_rank(df: DataFrame, keys: list[str], value: str, ties: list[str], out: str) -> DataFrame:
    """df with out: the row's place in its group's order, 0 to 1; 0 for a row alone. Groups may have any size."""
    from ..operators.ordered import positions

    placed = positions(df, keys, [value, *ties], "__place", "__size")
    return placed.withColumn(out, F.coalesce(F.try_divide("__place", F.col("__size") - 1), F.lit(0.0))).select(*[c for c in df.columns if c != out], out)
