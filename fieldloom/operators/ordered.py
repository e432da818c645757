"""Order statistics, places and running totals of groups of any size: no window or aggregate holds a whole group.

Places and totals come from one range partition of the rows by group and order. The sorted rows are written with
an id that counts up within each partition; a group's rows in earlier partitions are counted from
one row a partition, so a group that holds a third of all rows is spread over as many tasks as it needs.
Percentiles are found by refining histograms: each pass counts the rows of the bins that may hold a
wanted place and goes on inside the bin that does, until it holds one value.

Nulls and NaN take no part in percentiles; groups without a value have none. Rows with null keys are a
group. Orders should be total, or rows that tie take their places by chance.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..sources.scratch import cut

#: Sorted rows of a block, in which running totals are local windows.
BLOCK_BITS = 12
#: Bins of a refinement, and the rows that a bin may hold to be counted value by value.
BINS, FEW = 4096, 4096


def attach(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """left with right's other columns, joined on keys of which nulls are equal."""
    named = right.withColumnsRenamed({k: f"__of_{k}" for k in keys})
    on = [F.col(k).eqNullSafe(F.col(f"__of_{k}")) for k in keys] or F.lit(True)
    return left.join(named, on, how).drop(*[f"__of_{k}" for k in keys])


def _sorted(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """df in order, written with __id (counting up within a partition) and __part."""
    placed = df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order).withColumn("__id", F.monotonically_increasing_id())
    return cut(placed.withColumn("__part", F.shiftright("__id", 33)), "sorted")


def _before(sums: DataFrame, keys: list[str], at: str, value: str) -> Column:
    w = Window.partitionBy(*keys).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(value).over(w), F.lit(0))


def positions(df: DataFrame, keys: list[str], order: list[str], out: str = "position", size: str = "size") -> DataFrame:
    """df with each row's place in its group's order, from 0, and the group's number of rows."""
    rows = _sorted(df, keys, order)
    parts = rows.groupBy(*keys, "__part").agg(F.min("__id").alias("__first"), F.count(F.lit(1)).alias("__n"))
    parts = parts.withColumn("__earlier", _before(parts, keys, "__part", "__n")).withColumn(size, F.sum("__n").over(Window.partitionBy(*keys)))
    met = attach(rows, parts, [*keys, "__part"])
    return met.select(*df.columns, (F.col("__id") - F.col("__first") + F.col("__earlier")).alias(out), size)


def running(df: DataFrame, keys: list[str], order: list[str], value: str, out: str) -> DataFrame:
    """df with `out`: the sum of `value` over the rows of the group that come before."""
    rows = _sorted(df, keys, order).withColumn("__block", F.shiftright("__id", BLOCK_BITS))
    local = rows.withColumn("__local", _before(rows, [*keys, "__block"], "__id", value))
    blocks = rows.groupBy(*keys, "__part", "__block").agg(F.sum(value).alias("__sum"))
    in_part = blocks.select(*keys, "__part", "__block", _before(blocks, [*keys, "__part"], "__block", "__sum").alias("__in_part"))
    parts = blocks.groupBy(*keys, "__part").agg(F.sum("__sum").alias("__sum"))
    of_parts = parts.select(*keys, "__part", _before(parts, keys, "__part", "__sum").alias("__of_parts"))
    base = attach(in_part, of_parts, [*keys, "__part"]).select(*keys, "__block", (F.col("__in_part") + F.col("__of_parts")).alias("__base"))
    return attach(local, base, [*keys, "__block"]).select(*df.columns, (F.col("__local") + F.col("__base")).alias(out))


def _magnitude(v: Column) -> Column:
    """A bin that never falls where v rises: the sign and the power of two; about 4,200 in all."""
    power = F.least(F.floor(F.log2(F.abs(v))), F.lit(1100)) + 1101
    return F.when(v == 0, F.lit(0)).when(v > 0, power).otherwise(-power).cast("int")


def _wanted(n: Column, probabilities: Sequence[float]) -> Column:
    """The places on either side of each probability's."""
    at = [F.lit(float(p)) * (n - 1) for p in probabilities]
    return F.array_distinct(F.array(*[f(x).cast("long") for x in at for f in (F.floor, F.ceil)]))


def _holding(bins: DataFrame, columns: list[str]) -> DataFrame:
    """A row for each wanted place: the bin that holds it, as `low`, `high`, `n` and `earlier` (rows in lower bins)."""
    inside = F.filter("wanted", lambda r: (r >= F.col("earlier")) & (r < F.col("earlier") + F.col("n")))
    return bins.select(*columns, F.explode(inside).alias("place"), "low", "high", "n", "earlier")


def order_statistics(df: DataFrame, keys: list[str], value: str, probabilities: Sequence[float]) -> DataFrame:
    """keys, size, place, v: the values at the places that the probabilities' linear interpolation needs."""
    v = F.col(value).cast("double")
    rows = df.filter(v.isNotNull() & ~F.isnan(v)).select(*keys, v.alias("v"))
    bins = rows.groupBy(*keys, _magnitude(F.col("v")).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
    bins = bins.withColumn("earlier", _before(bins, keys, "bin", "n")).withColumn("size", F.sum("n").over(Window.partitionBy(*keys)))
    held = cut(_holding(bins.withColumn("wanted", _wanted(F.col("size"), probabilities)), [*keys, "size"]), "places")
    done = [held.filter("low = high")]
    while not held.filter("low < high").isEmpty():
        # All wanted places of one bin are sought together; a group has at most two bins for each probability.
        each = held.filter("low < high").groupBy(*keys, "size", "low", "high", "n", "earlier").agg(F.collect_set("place").alias("wanted"))
        groups = each.groupBy(*keys).agg(F.collect_list(F.struct("size", "low", "high", "n", "earlier", "wanted")).alias("__in"))
        met = attach(rows, groups, keys).select(*keys, "v", F.explode(F.filter("__in", lambda b: F.col("v").between(b["low"], b["high"]))).alias("b")).select(*keys, "v", "b.*")
        share = (F.col("v") / 2 - F.col("low") / 2) / (F.col("high") / 2 - F.col("low") / 2)
        bin_ = F.least(F.floor(share * BINS), F.lit(BINS - 1)).cast("int")
        of = [*keys, "size", "wanted", "low", "high", "earlier"]
        finer = met.groupBy(*of, bin_.alias("bin"), F.when(F.col("n") <= FEW, F.col("v")).alias("one")).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("__low"), F.max("v").alias("__high"))
        inside = Window.partitionBy(*keys, "low").orderBy("bin", "one").rowsBetween(Window.unboundedPreceding, -1)
        finer = finer.withColumn("earlier", F.col("earlier") + F.coalesce(F.sum("n").over(inside), F.lit(0))).withColumn("low", F.col("__low")).withColumn("high", F.col("__high"))
        held = cut(_holding(finer, [*keys, "size"]), "places")
        done.append(held.filter("low = high"))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.select(*keys, "size", "place", F.col("low").alias("v"))


def percentiles(df: DataFrame, keys: list[str], value: str, probabilities: Sequence[float], out: str = "q") -> DataFrame:
    """keys, out: an array of exact percentiles, linearly interpolated, in the order of the probabilities (0 to 1)."""
    found = order_statistics(df, keys, value, probabilities).groupBy(*keys, "size").agg(F.map_from_entries(F.collect_list(F.struct("place", "v"))).alias("__at"))

    def one(p: float) -> Column:
        h = F.lit(float(p)) * (F.col("size") - 1)
        low, high = (F.element_at("__at", f(h).cast("long")) for f in (F.floor, F.ceil))
        return F.when(low == high, low).otherwise(low + (high - low) * (h - F.floor(h)))

    return found.select(*keys, F.array(*[one(p) for p in probabilities]).alias(out))
