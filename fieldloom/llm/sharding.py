"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

The ring is divided into fixed cells; every shard owns the arcs behind its virtual nodes. A shard's
room is exact: rows // shards, and one more for the first rows % shards of them, so that counts are
at most one apart. A shard takes the keys of its own arcs in ring order while it has room; what
overflows continues clockwise, virtual node by virtual node, to the next shard with room. Only the
cells' row counts (a number fixed by the ring, not by the data) reach the driver; a row finds its
shard and slot by its rank within its cell, and the ranks are running totals of small sub-cells.

Defined results: a null id is a key like any other; a null text has size 1 and check sum 0; rows that
are equal in id, size and check sum are told apart by their slots only; an empty table gives no rows;
other columns are not looked at.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .common import table

#: Cells of the ring; each holds whole arcs' parts, and the virtual nodes sit between cells.
CELLS = 4096
VIRTUAL_NODES = 64
SUB = 4096


def ring(shards: int, virtual_nodes: int = VIRTUAL_NODES, cells: int = CELLS) -> list[int]:
    """The shard that owns each cell: that of the next virtual node clockwise."""
    node: dict[int, tuple[str, int]] = {}
    for s in range(shards):
        for v in range(virtual_nodes):
            digest = hashlib.blake2b(f"{s}/{v}".encode(), digest_size=16).hexdigest()
            at = int(digest[:8], 16) % cells
            # Two virtual nodes on one spot: the smaller digest keeps it, whatever the number of shards.
            node[at] = min(node.get(at, (digest, s)), (digest, s))
    if not node:
        raise ValueError("a ring needs a shard")
    owner, current = [0] * cells, node[min(node)][1]
    for c in range(cells - 1, -1, -1):
        current = node[c][1] if c in node else current
        owner[c] = current
    return owner


def segments(counts: dict[int, int], owner: list[int], shards: int) -> list[tuple[int, int, int, int, int]]:
    """(cell, first rank, end rank, shard, first slot): where the rows of each cell go, in ring order."""
    total = sum(counts.values())
    room = [total // shards + (s < total % shards) for s in range(shards)]
    filled, out, over = [0] * shards, [], []
    for cell in sorted(counts):
        s, n = owner[cell], counts[cell]
        k = min(n, room[s] - filled[s])
        if k:
            out.append((cell, 0, k, s, filled[s]))
            filled[s] += k
        if k < n:
            over.append((cell, k, n))
    cells = len(owner)
    for cell, first, end in over:
        at = cell
        while first < end:
            at = (at + 1) % cells
            s = owner[at]
            if k := min(end - first, room[s] - filled[s]):
                out.append((cell, first, first + k, s, filled[s]))
                filled[s] += k
                first += k
    return out


def assign(df: DataFrame, key: Column, tie: list[str], shards: int = 16, virtual_nodes: int = VIRTUAL_NODES) -> DataFrame:
    """One row for each row of df: its `tie` columns, shard and slot. Rows with equal tie columns and key are interchangeable."""
    spark = df.sparkSession
    h = F.xxhash64(key)
    spread = F.pmod(F.xxhash64(F.shiftrightunsigned(h, 8), *[F.col(c) for c in tie]), F.lit(SUB))
    keyed = df.select(*tie, h.alias("__h"))
    alike = keyed.groupBy(*tie, "__h").agg(F.count(F.lit(1)).alias("__n"))
    alike = alike.withColumn("__cell", F.pmod(F.shiftrightunsigned("__h", 52), F.lit(CELLS))).withColumn("__sub", spread)
    per_sub = alike.groupBy("__cell", "__sub").agg(F.sum("__n").alias("__size"))
    before = F.coalesce(F.sum("__size").over(Window.partitionBy("__cell").orderBy("__sub").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = per_sub.withColumn("__base", before).select("__cell", "__sub", "__base")
    counts = {r["__cell"]: r["n"] for r in per_sub.groupBy("__cell").agg(F.sum("__size").alias("n")).collect()}  # at most CELLS rows
    owner = ring(shards, virtual_nodes)
    plan = spark.createDataFrame(segments(counts, owner, shards), "cell long, first long, end long, shard int, slot0 long")
    w = Window.partitionBy("__cell", "__sub").orderBy("__h", *tie).rowsBetween(Window.unboundedPreceding, -1)
    ranked = alike.withColumn("__before", F.coalesce(F.sum("__n").over(w), F.lit(0))).join(bases, ["__cell", "__sub"])
    each = ranked.withColumn("__rank", F.explode(F.sequence(F.col("__base") + F.col("__before"), F.col("__base") + F.col("__before") + F.col("__n") - 1)))
    # At most CELLS + shards segments: a bound set by the ring.
    at = (F.col("__cell") == F.col("cell")) & (F.col("__rank") >= F.col("first")) & (F.col("__rank") < F.col("end"))
    return each.join(F.broadcast(plan), at).select(*tie, "shard", (F.col("slot0") + F.col("__rank") - F.col("first")).alias("slot"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7: every document's shard and slot under the law of equal row counts."""
    docs = table(spark, sf_dir, "documents").select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
    )
    placed = assign(docs, F.col("doc_id"), ["doc_id", "size", "text_crc32"])
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
