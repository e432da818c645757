"""Exact nearest neighbours by dot product: blocks around pivots, bounds, and products of only those blocks that can win.

Each group's pivots are its rows of least hash, about the root of its size and PIVOTS at most; a row belongs to the pivot at the
least angle. A block's rows lie within its widest angle of its pivot, so for any row the angle to the pivot less that width
bounds the product with all of the block. A row is compared with its own block first, which gives it a
score to beat; then with the blocks whose bound reaches that score. Blocks are split in parts of about PART rows by hash, and so are the
rows that visit them, so a task multiplies two small matrices whatever the group's size.

Ties (to nine places) go to the smaller ident. A row alone in its group has no neighbour and is left out. Zero vectors stand at a
right angle to all. Idents are unique in their group.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..sources.scratch import cut
from .metrics import dot

PIVOTS, PART = 32, 1024
_SLACK = 1e-7


def _angle(cosine: Column) -> Column:
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine)))


def _placed(rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows with norm, angles (to each of the group's pivots, in order), block (the nearest pivot's place) and hash."""
    size = F.sqrt(dot(F.col("v"), F.col("v")))
    rows = rows.withColumns({"norm": size, "hash": F.xxhash64("id")})
    n = rows.groupBy(*keys).agg(F.least(F.lit(PIVOTS), F.ceil(F.sqrt(F.count(F.lit(1))))).alias("__k"))
    first = rows.withColumn("__i", F.row_number().over(Window.partitionBy(*keys).orderBy("hash", "id"))).filter(F.col("__i") <= PIVOTS).join(n, keys).filter(F.col("__i") <= F.col("__k"))
    unit = F.transform("v", lambda x: x / F.greatest(F.col("norm"), F.lit(1e-300)))
    pivots = first.select(*keys, "__i", unit.alias("u")).groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("__i", "u"))), lambda p: p["u"]).alias("__p"))  # PIVOTS vectors a group
    angles = F.transform("__p", lambda u: _angle(dot(F.col("v"), u) / F.greatest(F.col("norm"), F.lit(1e-300))))
    out = rows.join(pivots, keys).withColumn("angles", angles).drop("__p")
    return out.withColumn("block", (F.array_position("angles", F.array_min("angles")) - 1).cast("int"))


def _compared(queries: DataFrame, members: DataFrame, keys: list[str]) -> DataFrame:
    """keys, id, nn, s, compared: each query's best row of each part that it visits. queries: keys, block, parts, hash, id, v; members: keys, block, parts, visits, hash, id, v."""
    # A query goes to every part of a block, a part's rows to every share of its visitors.
    asked = queries.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("share", F.pmod(F.shiftrightunsigned("hash", 20), F.col("visits")).cast("int"))
    held = members.withColumn("part", F.pmod("hash", F.col("parts")).cast("int")).withColumn("share", F.explode(F.sequence(F.lit(0), F.col("visits") - 1)))
    at = [*keys, "block", "part", "share"]
    kinds = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in queries.select(*keys).schema], "id long, nn long, s double, compared long"])

    def best(key, q, m):
        import pandas as pd

        if not len(q) or not len(m):
            return pd.DataFrame([], columns=[*keys, "id", "nn", "s", "compared"])
        m = m.sort_values("m_id")
        a, b, ids = np.stack(q["v"].to_numpy()), np.stack(m["m_v"].to_numpy()), m["m_id"].to_numpy()
        s = np.round(a @ b.T, 9)
        s[q["id"].to_numpy()[:, None] == ids[None]] = -np.inf
        top = s.argmax(axis=1)  # of equal ones the first, which has the smaller id
        out = pd.DataFrame({"id": q["id"].to_numpy(), "nn": ids[top], "s": s[np.arange(len(s)), top], "compared": np.isfinite(s).sum(axis=1)})
        for k, v in zip(keys, key):
            out[k] = v
        return out[np.isfinite(out["s"])][[*keys, "id", "nn", "s", "compared"]]

    named = held.select(*[F.col(c).alias(f"m_{c}") for c in (*at, "id", "v")])
    return asked.select(*at, "id", "v").groupBy(*at).cogroup(named.groupBy(*[f"m_{c}" for c in at])).applyInPandas(best, kinds)


def nearest(df: DataFrame, keys: list[str], ident: str, vector: str) -> DataFrame:
    """keys, id, nn, similarity, compared: of each row (id: a long) the other row of its group with the largest dot product, and how many rows it was multiplied with."""
    rows = df.select(*keys, F.col(ident).cast("long").alias("id"), F.transform(vector, lambda x: x.cast("double")).alias("v"))
    placed = cut(_placed(rows, keys), "placed")
    own = F.get("angles", F.col("block"))
    blocks = placed.groupBy(*keys, "block").agg(F.count(F.lit(1)).alias("n"), F.max(own).alias("wide"), F.max("norm").alias("most"), F.min("norm").alias("least"))
    blocks = blocks.withColumn("parts", F.ceil(F.col("n") / PART).cast("int"))
    members = placed.join(blocks.select(*keys, "block", "n", "parts"), [*keys, "block"])
    at_home = members.withColumn("visits", F.col("parts"))
    first = cut(_compared(at_home, at_home, keys), "first")
    one = F.max_by(F.struct("nn", "s"), F.struct("s", -F.col("nn"))).alias("b")
    scored = placed.join(first.groupBy(*keys, "id").agg(F.max("s").alias("to_beat")), [*keys, "id"], "left")
    each = blocks.groupBy(*keys).agg(F.collect_list(F.struct("block", "wide", "most", "least", "parts")).alias("__b"))  # PIVOTS blocks a group
    bound = F.cos(F.greatest(F.lit(0.0), F.least(F.lit(math.pi), F.get("angles", F.col("b.block"))) - F.col("b.wide") - _SLACK))
    reach = F.col("norm") * F.when(bound > 0, bound * F.col("b.most")).otherwise(bound * F.col("b.least"))
    open_ = scored.join(each, keys).withColumn("b", F.explode("__b")).filter((F.col("b.block") != F.col("block")) & (F.col("to_beat").isNull() | (reach + _SLACK >= F.col("to_beat"))))
    visits = cut(open_.select(*keys, "id", "v", "hash", F.col("b.block").alias("block"), F.col("b.parts").alias("parts")), "visits")
    shares = visits.groupBy(*keys, "block").agg(F.ceil(F.count(F.lit(1)) / PART).cast("int").alias("visits"))
    second = _compared(visits.join(shares, [*keys, "block"]), members.join(shares, [*keys, "block"]), keys)
    found = first.unionByName(second).groupBy(*keys, "id").agg(one, F.sum("compared").alias("compared"))
    return found.select(*keys, "id", "b.nn", F.col("b.s").alias("similarity"), "compared")
