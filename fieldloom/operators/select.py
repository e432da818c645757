"""Ordered selections: arg-max, top-k with deduplication, islands, sweeps, spaced points, upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def first_by(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each group in an order; give an ordinal last, so that ties have one winner."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").drop("__rn")


def top_k(df: DataFrame, keys: list[str], k: int, *order: Column) -> DataFrame:
    """The first k rows of each group, with rank."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= k)


def top_k_spread(df: DataFrame, keys: list[str], y: str, x: str, k: int, *order: Column) -> DataFrame:
    """Top k after keeping the best row of each cell of centroids rounded (half to even) to 10."""
    cells = df.withColumn("cy", F.bround(F.col(y), -1)).withColumn("cx", F.bround(F.col(x), -1))
    return top_k(first_by(cells, [*keys, "cy", "cx"], *order), keys, k, *order)


def islands(df: DataFrame, keys: list[str], at: str, gap: float) -> DataFrame:
    """keys, island, first, last, n, middle: runs of values with no step above gap."""
    w = Window.partitionBy(*keys).orderBy(at)
    new = F.when(F.col(at) - F.lag(at).over(w) > gap, 1).otherwise(0)
    numbered = df.withColumn("__new", new).withColumn("island", F.sum("__new").over(w))
    out = numbered.groupBy(*keys, "island").agg(F.min(at).alias("first"), F.max(at).alias("last"), F.count(F.lit(1)).alias("n"))
    return out.withColumn("middle", F.bround((F.col("first") + F.col("last")) / 2, 0))


def sweep(df: DataFrame, keys: list[str], value: str, thresholds: list[float]) -> DataFrame:
    """keys, threshold, n: rows at or above each threshold, from one pass."""
    counts = df.groupBy(*keys).agg(F.array(*[F.struct(F.lit(float(t)).alias("threshold"), F.count_if(F.col(value) >= F.lit(float(t))).alias("n")) for t in thresholds]).alias("z"))
    return counts.select(*keys, F.explode("z").alias("z")).select(*keys, "z.threshold", "z.n")


def latest(old: DataFrame, new: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """An upsert: new rows replace old ones of the same keys. Of rows of one age the first in `order` stays, then that whose columns, as JSON, come first."""
    both = old.withColumn("__age", F.lit(1)).unionByName(new.withColumn("__age", F.lit(0)))
    return first_by(both, keys, F.col("__age"), *order, F.to_json(F.struct(*old.columns))).drop("__age")


def spaced_points(df: DataFrame, keys: list[str], y: str, x: str, score: str, k: int, distance: float | str, pool: int | None = 200) -> DataFrame:
    """Greedy choice of up to k points, each farther than `distance` (or that column's value) from those before; the order decides,
    so a group is walked by one function: over its best `pool` points, or without a pool over all, where groups are bounded (an image's region)."""
    import pandas as pd

    apart = [distance] if isinstance(distance, str) else []
    best = df.select(*keys, y, x, score, *apart)
    if pool:
        best = top_k(best, keys, pool, F.col(score).desc(), F.col(y), F.col(x)).drop("rank")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in best.schema) + ", pick int"

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([score, y, x], ascending=[False, True, True])
        least = float(pdf[distance].iloc[0]) if apart else float(distance)
        kept: list[tuple[float, float]] = []
        rows = []
        for i, (py, px) in enumerate(zip(pdf[y], pdf[x], strict=True)):
            if all((py - a) ** 2 + (px - b) ** 2 > least**2 for a, b in kept):
                kept.append((py, px))
                rows.append(i)
                if len(kept) == k:
                    break
        return pdf.iloc[rows].assign(pick=range(1, len(rows) + 1))

    return best.groupBy(*keys).applyInPandas(walk, schema)
