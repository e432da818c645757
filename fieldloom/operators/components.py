"""Connected components of masks that stand as pixel tables, found on runs: no image is held by one task.

A run is a maximal stretch of set pixels in a row of an image, so a mask is a table (keys, y, x0, x1). Runs
of neighbouring rows are linked where they touch; the pairs are sought by row and by the blocks of
columns that a run covers, so that a row of many runs isn't compared with all of the next one. The
links are contracted by stars, in rounds that grow with the logarithm of a component's reach, and each
round is written in the shared folder. A region is named by its first run: y * 2^32 + x0 of its first
pixel in row-major order, so names sort like the regions' first pixels.

Tables of runs and pairs are joined by merging, by a hint: written tables look as small to Spark as their compressed files, and it
would broadcast many times that through the driver.

Components of an empty mask are none; repeated pixels count once; a null key is a key like any other
only where Spark joins it, so give images non-null keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..sources.scratch import cut, drop

#: Columns of a block, by which runs of neighbouring rows find each other.
BLOCK = 256
_ROW = 1 << 32


def runs(px: DataFrame, keys: list[str]) -> DataFrame:
    """keys, y, x0, x1: the runs of a mask's pixels (keys, y, x). A window holds one row of one image."""
    row = Window.partitionBy(*keys, "y").orderBy("x")
    island = F.col("x") - F.row_number().over(row)
    at = px.select(*keys, "y", "x").distinct().withColumn("__island", island)
    return at.groupBy(*keys, "y", "__island").agg(F.min("x").alias("x0"), F.max("x").alias("x1")).drop("__island")


def pixels_of(table: DataFrame, *columns: str) -> DataFrame:
    """The pixels (columns, y, x) of runs. They look as small as their runs to Spark, so joins with them merge, too."""
    return table.withColumn("x", F.explode(F.sequence("x0", "x1"))).select(*columns, "y", "x").hint("merge")


def gaps(table: DataFrame, images: DataFrame, keys: list[str], height: int, width: int) -> DataFrame:
    """The runs of the complement, in images (keys) of one size; those of rows without any run included."""
    rows = images.select(*keys).distinct().withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(height - 1))))
    ends = rows.select(*keys, "y", F.lit(width).alias("x0"), F.lit(width).alias("x1")).unionByName(table.select(*keys, "y", F.col("x0").cast("int"), F.col("x1").cast("int")))
    before = F.coalesce(F.lag("x1").over(Window.partitionBy(*keys, "y").orderBy("x0")) + 1, F.lit(0))
    return ends.select(*keys, "y", before.alias("x0"), (F.col("x0") - 1).alias("x1")).filter("x0 <= x1")


def _blocks(low: Column, high: Column) -> Column:
    return F.explode(F.sequence(F.floor(low / BLOCK).cast("int"), F.floor(high / BLOCK).cast("int")))


def links(table: DataFrame, keys: list[str], diagonal: bool = True) -> DataFrame:
    """keys, a, b: pairs of runs (by name) of neighbouring rows that touch, at corners too if diagonal."""
    reach = 1 if diagonal else 0
    name = F.col("y").cast("long") * _ROW + F.col("x0")
    upper = table.select(*keys, (F.col("y") + 1).alias("y"), F.col("x0").alias("u0"), F.col("x1").alias("u1"), name.alias("a"))
    upper = upper.withColumn("block", _blocks(F.col("u0") - reach, F.col("u1") + reach))
    lower = table.select(*keys, "y", "x0", "x1", name.alias("b")).withColumn("block", _blocks(F.col("x0"), F.col("x1")))
    touch = (F.col("x0") <= F.col("u1") + reach) & (F.col("u0") <= F.col("x1") + reach)
    return upper.hint("merge").join(lower, [*keys, "y", "block"]).filter(touch).select(*keys, "a", "b").distinct()


def _stars(edges: DataFrame, keys: list[str]) -> bool:
    """Whether every node points at one node at most, and at none that points on."""
    ends = edges.select(*keys, "u", F.lit(1).alias("out")).unionByName(edges.select(*keys, F.col("v").alias("u")).distinct().withColumn("out", F.lit(0)))
    return ends.groupBy(*keys, "u").agg(F.sum("out").alias("out"), F.count(F.lit(1)).alias("n")).filter("out > 1 OR (out = 1 AND n > 1)").isEmpty()


def contract(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """keys, node, region: the smallest node that each node of keys, a, b reaches; nodes without a pair are left out.

    A round points every node's larger neighbours at its smallest one, then its smaller neighbours. Both
    are minima, joined back to the pairs, so a node with very many neighbours burdens no single task.
    """
    edges = cut(pairs.select(*keys, F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "pairs")
    while not _stars(edges, keys):
        both = edges.unionByName(edges.select(*keys, F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy(*keys, "u").agg(F.min(F.least("u", "v")).alias("m"))
        larger = both.filter("v > u").hint("merge").join(least, [*keys, "u"]).select(*keys, F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v").distinct()
        least = larger.groupBy(*keys, "u").agg(F.min("v").alias("m"))
        smaller = larger.hint("merge").join(least, [*keys, "u"]).select(*keys, F.col("v").alias("u"), F.col("m").alias("v"))
        after = cut(smaller.unionByName(least.select(*keys, "u", F.col("m").alias("v"))).filter("u > v").distinct(), "pairs")
        drop(edges)
        edges = after
    heads = edges.select(*keys, F.col("v").alias("node")).distinct().withColumn("region", F.col("node"))
    return edges.groupBy(*keys, F.col("u").alias("node")).agg(F.min("v").alias("region")).unionByName(heads)


def connected(table: DataFrame, keys: list[str], diagonal: bool = True) -> DataFrame:
    """runs (keys, y, x0, x1) with region: the component that each is of."""
    table = cut(table.select(*keys, "y", "x0", "x1"), "runs")
    named = table.withColumn("node", F.col("y").cast("long") * _ROW + F.col("x0"))
    found = named.hint("merge").join(contract(links(table, keys, diagonal), keys), [*keys, "node"], "left")
    return found.withColumn("region", F.coalesce("region", "node")).drop("node")


def summary(labelled: DataFrame, keys: list[str]) -> DataFrame:
    """keys, region, area and the box x0, y0, x1, y1 (ending one past the last pixel) of each component of labelled runs."""
    return labelled.groupBy(*keys, "region").agg(
        F.sum(F.col("x1") - F.col("x0") + 1).alias("area"), F.min("x0").alias("x0"), F.min("y").alias("y0"), (F.max("x1") + 1).alias("x1"), (F.max("y") + 1).alias("y1")
    )


def fragments(labelled: DataFrame, images: DataFrame, keys: list[str]) -> DataFrame:
    """keys, fragments: the number of components of every image, 0 where its mask is empty."""
    n = labelled.select(*keys, "region").distinct().groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return images.select(*keys).distinct().join(n, keys, "left").select(*keys, F.coalesce("n", F.lit(0)).alias("fragments"))


def at_least(labelled: DataFrame, keys: list[str], area: float) -> DataFrame:
    """The labelled runs of components of at least an area."""
    large = summary(labelled, keys).filter(F.col("area") >= area).select(*keys, "region")
    return labelled.hint("merge").join(large, [*keys, "region"], "left_semi")


def filled(table: DataFrame, images: DataFrame, keys: list[str], height: int, width: int) -> DataFrame:
    """The runs of a mask with its holes: complement components (joined at sides only) that don't reach the frame. Runs may touch."""
    rest = connected(gaps(table, images, keys, height, width), keys, diagonal=False)
    at_frame = (F.col("y0") == 0) | (F.col("x0") == 0) | (F.col("y1") == height) | (F.col("x1") == width)
    holes = rest.hint("merge").join(summary(rest, keys).filter(~at_frame).select(*keys, "region"), [*keys, "region"], "left_semi")
    return table.select(*keys, "y", "x0", "x1").unionByName(holes.select(*keys, "y", "x0", "x1"))
