"""Label-free prototypes: clusters of embeddings, weighted by how far a second map agrees with them, and a principal axis with a sense.

Clusters are found by Lloyd's steps from a fixed start (the rows of least ident of each target), so a rerun gives the same
ones. A step assigns rows against the target's few centres and averages them in one aggregate; what is joined to
the rows is one array of at most K_MOST centres a target. Means of vectors are by element, so no group's vectors meet in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..sources.scratch import cut
from .metrics import dot

# Rows a cluster, and the least and the most clusters of a target.
ROWS_EACH, K_LEAST, K_MOST = 20, 2, 6
_EPS = 1e-6


def _vector(name: str) -> Column:
    return F.transform(F.col(name), lambda v: v.cast("double"))


def _centres(rows: DataFrame, keys: list[str], ident: str) -> DataFrame:
    """keys, centres: an array of (cluster, c), the rows of least ident, as many as the target's size asks for."""
    n = rows.groupBy(*keys).agg(F.greatest(F.lit(K_LEAST), F.least(F.lit(K_MOST), F.floor(F.count(F.lit(1)) / ROWS_EACH))).alias("__k"))
    first = rows.withColumn("cluster", F.row_number().over(Window.partitionBy(*keys).orderBy(ident)) - 1).filter(F.col("cluster") < K_MOST)
    kept = first.join(n, keys).filter(F.col("cluster") < F.col("__k"))
    return kept.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("cluster", F.col("__v").alias("c")))).alias("centres"))


def _assigned(rows: DataFrame, centres: DataFrame, keys: list[str]) -> DataFrame:
    """rows with cluster: the nearest centre, the first of equally near ones (to nine places)."""
    far = lambda c: F.round(dot(c["c"], c["c"]) - 2 * dot(F.col("__v"), c["c"]), 9)  # noqa: E731  (less the row's own square)
    best = F.array_min(F.transform("centres", lambda c: F.struct(far(c).alias("far"), c["cluster"].alias("cluster"))))
    return rows.join(centres, keys).withColumn("cluster", best["cluster"]).drop("centres")


def _means(assigned: DataFrame, keys: list[str], width: int, *more: Column) -> DataFrame:
    elements = F.array(*[F.avg(F.get("__v", F.lit(i))) for i in range(width)])
    return assigned.groupBy(*keys, "cluster").agg(elements.alias("c"), *more)


def clusters(df: DataFrame, keys: list[str], ident: str, vector: str, width: int, steps: int = 10) -> tuple[DataFrame, DataFrame]:
    """(df with cluster, centres: keys, cluster, c): after so many steps. A cluster that loses its rows goes."""
    rows = df.withColumn("__v", _vector(vector))
    centres = _centres(rows, keys, ident)
    for _ in range(steps):
        moved = _means(_assigned(rows, centres, keys), keys, width)
        centres = cut(moved.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("cluster", "c"))).alias("centres")), "centres")
    each = centres.select(*keys, F.explode("centres").alias("z")).select(*keys, "z.cluster", "z.c")
    return _assigned(rows, centres, keys).drop("__v"), each


def agreement(assigned: DataFrame, centres: DataFrame, keys: list[str], vector: str, agrees: str, width: int) -> DataFrame:
    """assigned rows with similarity: to the target's prototype, from 0 to 1 within the target.

    The prototype is the centres' mean, weighted by the softmax of each cluster's mean of `agrees` in units of
    their deviation, and of unit length.
    """
    mean = assigned.groupBy(*keys, "cluster").agg(F.avg(agrees).alias("__agree"))
    met = centres.join(mean, [*keys, "cluster"])
    scale = met.groupBy(*keys).agg(F.max("__agree").alias("__top"), F.stddev_pop("__agree").alias("__dev"))
    weighed = met.join(scale, keys).withColumn("__w", F.exp((F.col("__agree") - F.col("__top")) / (F.col("__dev") + _EPS)))
    proto = weighed.groupBy(*keys).agg(F.array(*[F.sum(F.col("__w") * F.get("c", F.lit(i))) / F.sum("__w") for i in range(width)]).alias("__p"))
    proto = proto.withColumn("__p", F.transform("__p", lambda v: v / (F.sqrt(dot(F.col("__p"), F.col("__p"))) + _EPS)))
    sim = assigned.join(proto, keys).withColumn("similarity", dot(_vector(vector), F.col("__p"))).drop("__p")
    return stretched(sim, keys, "similarity")


def stretched(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """df with value from 0 (the group's least) to 1."""
    ends = df.groupBy(*keys).agg(F.min(value).alias("__lo"), F.max(value).alias("__hi"))
    return df.join(ends, keys).withColumn(value, (F.col(value) - F.col("__lo")) / (F.col("__hi") - F.col("__lo") + _EPS)).drop("__lo", "__hi")


def principal(df: DataFrame, keys: list[str], vector: str, against: str, width: int, out: str = "pc1") -> DataFrame:
    """df with out: the place along each target's principal axis, from 0 to 1, turned so that it runs against `against` (dark is high).

    The products of the centred elements are summed by Spark; what is left is one small matrix a target, of which the axis is
    taken. A target without variance has no axis, and 0 everywhere.
    """
    import numpy as np

    rows = df.withColumn("__v", _vector(vector))
    at = lambda i: F.get("__v", F.lit(i))
    firsts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.array(*[F.avg(at(i)) for i in range(width)]).alias("m"))
    centred = rows.join(firsts.select(*keys, "m"), keys).withColumn("__c", F.zip_with("__v", "m", lambda a, b: a - b)).drop("m")
    products = F.explode(F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.struct(i.alias("i"), F.transform("__c", lambda v: v * F.get("__c", i)).alias("row"))))
    sums = centred.select(*keys, products.alias("p")).groupBy(*keys, "p.i").agg(F.array(*[F.sum(F.get("p.row", F.lit(j))) for j in range(width)]).alias("row"))
    matrix = sums.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "row"))), lambda r: r["row"]).alias("cov"))

    def axis(batches):
        for pdf in batches:
            found = []
            for cov in pdf["cov"]:
                values, vectors = np.linalg.eigh(np.array([np.asarray(r, float) for r in cov]))
                found.append(vectors[:, -1].tolist() if values[-1] > 0 else [0.0] * width)
            yield pdf.drop(columns="cov").assign(axis=found)

    kinds = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in matrix.select(*keys).schema], "axis array<double>"])
    axes = matrix.mapInPandas(axis, kinds)
    placed = centred.join(axes, keys).withColumn(out, dot(F.col("__c"), F.col("axis"))).drop("__v", "__c", "axis")
    turned = placed.groupBy(*keys).agg((F.covar_pop(out, against) > 0).alias("__turn"))  # of the correlation's sign
    return stretched(placed.join(turned, keys).withColumn(out, F.when(F.coalesce("__turn", F.lit(False)), -F.col(out)).otherwise(F.col(out))).drop("__turn"), keys, out)
