"""N-gram Jaccard join: an exact similarity join in the metric space of shingle sets.

Distance is 1 - |X & Y| / |X | Y|, a metric; texts with equal sets are one point. Nearly all texts are at
distance 1 of each other, where no pivot tells them apart, so an index of shingles finds for each text the
few others that it isn't at distance 1 of, and the metric does the rest:

* pivots: of the texts that share one of their first shingles (longest first, then by hash) the smallest
  id is a centre; a text within the threshold eps of centres goes to the nearest one's Voronoi cell, of
  radius r, with its exact distance kept. Texts that are left look for centres again, ROUNDS times;
* windows: texts that are linked lack at most `margin` shingles of each other, so they share one of their
  first margin + 1, and their cells meet in that shingle's region. Two cells can hold a link only if their
  centres are within eps + r1 + r2; at the boundary, where the centres aren't linked themselves, members
  at x and y of their centres only if x + y >= distance of the centres - eps;
* recursion: a shingle that more than `leaf` cells hold moves behind all others in the order, once, and
  texts with too few others left read their whole sets. Regions that still hold more than `leaf` cells
  have a centre of their own, and join again by what their texts differ in from it: linked texts differ
  in at most as many shingles as their sizes allow, so either both are so near the centre that the one
  with most to spare stands for all such, or they share some of these differences.

Before two whole sets are compared, their first shingles bound the overlap from above. Pairs that one
class holds already are not compared again, so links are complete as classes, not as a list.
Shingles are compared by 56 bits of hash and their length.

Defined results: a null or text without words has an empty set and is linked with nothing; a text with
fewer words than a shingle is one shingle of them all; rows that share a doc_id are one document; rows
with a null doc_id take the class of the rows with the same set, and null without one; an empty table
gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import re
from functools import lru_cache, reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .common import may_hold, stash, table, unstash
from .components import components

#: Documents of a region that are compared with each other at most; larger ones are joined around a centre.
LEAF = 32
#: First pivots by which a document looks for a centre, and rounds of that.
FIRST, ROUNDS = 4, 3
#: Parts of the index that are built one after another, so that the disk holds one part's shuffles.
PARTS = 4
#: First shingles that bound an overlap.
BOUND = 96
#: Further shingles that short texts carry beside their first margin + 1.
SPARE = 40
#: Texts that a task holds as Python objects at a time, and words whose hashes a worker keeps.
ROWS, KEPT = 512, 1 << 16
#: Asked shingles up to which all are broadcast; more are looked up by a shuffled join.
ASKED = 1 << 18
_WORDS = re.compile(rb"[^\x20\x09-\x0D]+")
_FACTORS = np.random.default_rng(2).integers(1, 1 << 63, 64, np.uint64) | np.uint64(1)


class _Hashes(dict):
    """word -> hash, with the word's length (255 at most) in the low byte; bounded."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        h = (xxhash.xxh64_intdigest(word) & ~255) | min(len(word), 255)
        if len(self) < KEPT:
            self[word] = h
        return h


_hashes = _Hashes()


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """The text's distinct shingles as sorted 63-bit numbers: its length (longest first), then 56 bits of hash."""
    found = _WORDS.findall((text or "").encode("utf-8", "replace").lower())  # of bytes, lower() changes A-Z only
    if not found:
        return np.zeros(0, np.int64)
    k = min(words, len(found))
    h = np.fromiter(map(_hashes.__getitem__, found), np.uint64, len(found))
    size = (h & np.uint64(255)).astype(np.int64)
    n = len(found) - k + 1
    x, length = np.full(n, k, np.uint64), np.zeros(n, np.int64)
    for j in range(k):
        y = h[j : j + n] ^ (h[j : j + n] >> np.uint64(31))
        x += y * _FACTORS[j]
        length += size[j : j + n]
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    x = (x >> np.uint64(8)) | ((127 - np.minimum(length, 127)).astype(np.uint64) << np.uint64(56))
    return np.unique(x.view(np.int64))


def margin(n: int, percent: int) -> int:
    """Shingles of a set of n that a set within the threshold can lack."""
    return n - -(-percent * n // 100)


def leading(x: np.ndarray) -> np.ndarray:
    """The first shingles of a sorted set by the upper half of their bits, as far as these tell them apart."""
    short = (x[:BOUND] >> 32).astype(np.int32)
    same = np.flatnonzero(short[1:] == short[:-1])
    return short[: same[0] + 1] if len(same) else short


def _pieces(batches):
    return (b.slice(i, ROWS) for b in batches for i in range(0, b.num_rows, ROWS))


def signatures(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """doc_id, n (shingles), f1 and f2 (the set's fingerprint), m (margin), pivots (the first of its shingles, enough for the margin, and half as many or SPARE more), first (`leading`)."""

    def run(batches):
        import pyarrow as pa
        import xxhash

        for b in _pieces(batches):
            n, f1, f2, m, pivots, first = [], [], [], [], [], []
            for text in b.column(1).to_pylist():
                x = shingle_set(text, words)
                f = np.frombuffer(xxhash.xxh3_128_digest(x.tobytes()), np.int64)
                k = margin(len(x), percent)
                n.append(len(x))
                f1.append(int(f[0]))
                f2.append(int(f[1]))
                m.append(k)
                pivots.append(x[: k + 1 + max((k + 1) // 2 + 10, SPARE)].copy())  # a view would keep the whole set
                first.append(leading(pivots[-1]))
            columns = [b.column(0), pa.array(n, pa.int64()), pa.array(f1, pa.int64()), pa.array(f2, pa.int64()), pa.array(m, pa.int64()), pa.array(pivots, pa.list_(pa.int64())), pa.array(first, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "f1", "f2", "m", "pivots", "first"])

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return plain.mapInArrow(run, "doc_id long, n long, f1 long, f2 long, m long, pivots array<long>, first array<int>")


def compare(pairs: DataFrame, docs: DataFrame, words: int, apart: bool = False) -> DataFrame:
    """a, b, common, whole, far: the exact distance of each pair, from their whole texts; with `apart`, also the shingles that only b has, then those that only a has."""
    ids = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id")))
    texts = may_hold(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "doc_id", ids, "id")
    first, second = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta")), texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb"))
    both = pairs.select("a", "b").join(second, "b").join(first, "a").select("a", "b", "ta", "tb")

    def run(batches):
        import pyarrow as pa

        sets = lru_cache(maxsize=256)(lambda text: shingle_set(text, words))
        for batch in _pieces(batches):
            common, whole, only = [], [], []
            for ta, tb in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x, y = sets(ta), sets(tb)
                same = x[np.minimum(np.searchsorted(x, y), len(x) - 1)] == y if len(x) else np.zeros(len(y), bool)
                c = int(same.sum())
                common.append(c)
                whole.append(len(x) + len(y) - c)
                if apart:
                    only.append(np.concatenate([y[~same], np.setdiff1d(x, y[same], assume_unique=True)]))
            columns = [batch.column(0), batch.column(1), pa.array(common, pa.int64()), pa.array(whole, pa.int64())]
            names = ["a", "b", "common", "whole"]
            if apart:
                columns.append(pa.array(only, pa.list_(pa.int64())))
                names.append("apart")
            yield pa.RecordBatch.from_arrays(columns, names)

    out = both.mapInArrow(run, "a long, b long, common long, whole long" + ", apart array<long>" * apart)
    return out.withColumn("far", 1 - F.col("common") / F.greatest("whole", F.lit(1)))


def _linked(percent: int) -> Column:
    return F.col("common") * 100 >= F.col("whole") * percent


def _sized(a: str, b: str, reach: Column) -> Column:
    """Whether sets of these sizes can be within `reach`."""
    return F.least(a, b) >= (1 - reach) * F.greatest(a, b) - 1e-6


def _possible(pairs: DataFrame, held: DataFrame, reach: Column) -> DataFrame:
    """The pairs (a, b) that can be within `reach`: of the shingles before one text's first ones end, all common ones are known, and of the others at most all are.

    Halves of bits only add to what is common, and a shingle whose half equals the last one's counts as one of the others.
    """
    end = lambda p, n: F.when(F.size(p) < F.col(n), F.element_at(p, -1)).otherwise(F.lit((1 << 31) - 1))
    side = lambda x: held.select(F.col("node").alias(x), F.col("n").alias(f"{x}_n"), F.col("first").alias(f"{x}_p"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    last = F.least(end(F.col("a_p"), "a_n"), end(F.col("b_p"), "b_n"))
    beyond = lambda x: F.col(f"{x}_n") - F.size(F.filter(f"{x}_p", lambda v: v < F.col("last")))
    both = both.withColumn("last", last).withColumn("most", F.size(F.array_intersect("a_p", "b_p")) + F.least(beyond("a"), beyond("b")))
    near = F.col("most") >= (1 - reach) * (F.col("a_n") + F.col("b_n") - F.col("most")) - 1e-6
    return both.filter(near).select(*pairs.columns)


def _cells(held: DataFrame, docs: DataFrame, words: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(a, b): links found; (node, centre, far): the texts that are in another's cell, by the nearest centre that is in none itself."""
    links = cells = None
    heads = held.select("node", "n", F.slice("pivots", 1, FIRST).alias("head"))  # no join moves more of a text than these
    left, more = heads, None
    for _ in range(ROUNDS):
        if more is not None:  # written, so that a round's plan doesn't hold those of the rounds before
            left = heads.join(stash(more, "left"), "node")  # a semi join would be planned below the slice
        first = left.select("node", "n", F.explode("head").alias("pivot"))
        centres = first.groupBy("pivot").agg(F.min(F.struct("node", "n")).alias("c"), F.max("node").alias("z")).filter("c.node < z").select("pivot", F.col("c.node").alias("a"), F.col("c.n").alias("a_n"))
        spokes = first.join(centres, "pivot").filter((F.col("a") < F.col("node")) & _sized("a_n", "n", F.lit(1 - percent / 100)))
        spokes = spokes.select("a", F.col("node").alias("b")).distinct()
        spokes = stash(_possible(spokes, held, F.lit(1 - percent / 100)), "spokes")
        near = stash(compare(spokes, docs, words).filter(_linked(percent)).select("a", "b", "far"), "near")
        free = near.join(near.select(F.col("b").alias("a")).distinct(), "a", "left_anti")
        inside = free.groupBy("b").agg(F.min(F.struct("far", "a")).alias("c")).select(F.col("b").alias("node"), F.col("c.a").alias("centre"), F.col("c.far").alias("far"))
        inside = stash(inside, "cells")
        links = near.select("a", "b") if links is None else links.unionByName(near.select("a", "b"))
        cells = inside if cells is None else cells.unionByName(inside)
        # Centres and their cells are done here; those without a neighbour as well.
        open_ = near.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(inside.select("node"), "node", "left_anti").join(inside.select(F.col("centre").alias("node")).distinct(), "node", "left_anti")
        missed = spokes.join(near.select("a", "b"), ["a", "b"], "left_anti").select(F.col("b").alias("node")).distinct()
        more = missed.unionByName(open_).distinct().join(inside.select("node"), "node", "left_anti")
    return links, cells


def _whole_sets(nodes: DataFrame, docs: DataFrame, words: int) -> DataFrame:
    """node, at, pivot: every shingle of the given documents' sets, by its place in the first order."""
    texts = may_hold(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "doc_id", nodes, "node")
    texts = texts.join(nodes.select("node"), F.col("doc_id") == F.col("node")).select("node", "text")

    def run(batches):
        import pyarrow as pa

        for b in _pieces(batches):
            sets = [shingle_set(t, words) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.list_(pa.int64()))], ["node", "pivots"])

    sets = texts.mapInArrow(run, "node long, pivots array<long>")
    return sets.select("node", F.posexplode("pivots").alias("at", "pivot"))


def _index(every: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pivot) of more than one cell, and their rows of `every`."""
    mets, entries = [], []
    for part in range(PARTS):
        own = every.filter(F.pmod("pivot", F.lit(PARTS)) == part)
        # A shingle of one cell alone joins nothing.
        met = own.groupBy("pivot").agg(F.min("centre").alias("lo"), F.max("centre").alias("hi")).filter("lo < hi").select("pivot")
        mets.append(stash(met, "shared"))
        entries.append(stash(own.join(mets[-1], "pivot"), "entries"))
    return reduce(DataFrame.unionByName, mets), reduce(DataFrame.unionByName, entries)


def _carrying(held: DataFrame, within: DataFrame, asked: DataFrame) -> DataFrame:
    """pivot, node: the texts of `within` that carry an asked shingle up to their last place; a join by the shingle, whose rows are those found, without a filter's chance hits."""
    if asked.count() <= ASKED:  # then no text's shingles are moved
        found = held.select("node", F.posexplode("pivots").alias("at", "pivot")).join(F.broadcast(asked), "pivot")
        return found.join(within, "node").filter("at <= last").select("pivot", "node")
    first = held.select("node", "pivots").join(within, "node")
    return first.select("node", F.explode(F.slice("pivots", F.lit(1), (F.col("last") + 1).cast("int"))).alias("pivot")).join(asked, "pivot").select("pivot", "node")


def _regions(held: DataFrame, cells: DataFrame, docs: DataFrame, words: int, leaf: int) -> tuple[DataFrame, DataFrame]:
    """Two tables. pivot, node, centre, most: the texts under each of their first margin + 1 shingles, in an order in which crowded ones come last
    (`most`: what texts that meet under a crowded one can have in common). node, n, lost, rest: the texts of plain ones, their crowded shingles, and those after their first ones."""
    of = held.join(cells.select("node", "centre"), "node", "left").withColumn("centre", F.coalesce("centre", "node"))
    every = of.select("node", "centre", F.posexplode("pivots").alias("at", "pivot"))
    met, entries = _index(every)
    sizes = entries.select("pivot", "centre").distinct().groupBy("pivot").agg(F.count(F.lit(1)).alias("cells"))
    hot = stash(sizes.filter(F.col("cells") > leaf), "hot")
    lost = stash(entries.join(hot, "pivot").groupBy("node").agg(F.count(F.lit(1)).alias("lost")), "lost")
    short = lost.join(held.select("node", "n", "m", F.size("pivots").alias("carried")), "node").filter("carried - lost < m + 1").select("node", "n", "m")
    short = stash(short, "short")
    # Texts with enough other shingles carry the first of these.
    enough = held.select("node", "n", "m").join(lost, "node", "left").join(short.select("node"), "node", "left_anti")
    enough = stash(enough.select("node", "n", F.coalesce("lost", F.lit(0)).alias("lost"), "m"), "enough")
    within = enough.select("node", (F.col("m") + F.col("lost")).alias("last"))
    plain = entries.join(hot, "pivot", "left_anti").join(within, "node").filter("at <= last").select("pivot", "node", "centre")
    # The others carry the first of all their other shingles, then crowded ones, the least crowded first.
    whole = stash(_whole_sets(short, docs, words), "whole-sets")
    # Shingles that crowd among these come last as well, unless another text carries them in its first places.
    more = stash(whole.groupBy("pivot").agg(F.count(F.lit(1)).alias("cells")).filter(F.col("cells") > leaf).join(hot.select("pivot"), "pivot", "left_anti"), "hot")
    # Besides these, one pass over what the other texts carry asks for shingles of at most one cell that come first in a whole set, whichever of these do come last.
    late = whole.join(hot.unionByName(more).select("pivot", F.lit(1).alias("late")), "pivot", "left").join(short, "node")
    before = F.sum(F.when(F.col("late").isNull(), 1).otherwise(0)).over(Window.partitionBy("node").orderBy("at"))
    early = late.withColumn("before", before).filter("late is null and before <= m + 1").select("pivot").distinct()
    asked = stash(early.join(met, "pivot", "left_anti").unionByName(more.select("pivot")), "asked")
    seen = stash(_carrying(held, within, asked), "seen")
    hot = hot.unionByName(stash(more.join(seen.select("pivot").distinct(), "pivot", "left_anti"), "hot"))
    whole = whole.join(hot, "pivot", "left").join(short, "node")
    by = Window.partitionBy("node")
    order = by.orderBy(F.col("cells").asc_nulls_first(), F.when(F.col("cells").isNull(), F.col("at")), "pivot")
    deep = whole.withColumn("rank", F.row_number().over(order)).withColumn("crowd", F.count("cells").over(by))
    # Texts that meet under crowded shingles only have no others in common: that asks for nearly all of a text to be crowded.
    deep = deep.filter((F.col("rank") <= F.col("m") + 1) & (F.col("cells").isNull() | (F.col("crowd") >= F.col("n") - F.col("m"))))
    deep = deep.select("pivot", "node", F.col("cells").isNull().alias("open"), F.when(F.col("cells").isNotNull(), F.col("crowd")).alias("most"))
    deep = stash(deep.join(of.select("node", "centre"), "node"), "deep")
    # Texts that hold these further shingles among their own first ones.
    beyond = stash(deep.filter("open").select("pivot").distinct().join(met, "pivot", "left_anti"), "beyond")
    others = seen.join(beyond, "pivot").join(of.select("node", "centre"), "node").select("pivot", "node", "centre")
    free = F.lit(None).cast("long").alias("most")
    regions = plain.unionByName(others).select("pivot", "node", "centre", free).unionByName(deep.select("pivot", "node", "centre", "most"))
    # Of its first margin + 1 + lost shingles such a text shares crowded ones besides those that regions show, and after them whatever is left.
    return regions, enough.select("node", "n", "lost", (F.col("n") - F.col("m") - 1 - F.col("lost")).alias("rest"))


def _meeting_often(pairs: DataFrame, radius: DataFrame, simple: DataFrame, eps: float) -> DataFrame:
    """a, b, reach (what the radii leave possible), without the pairs that are too far apart by their sizes, and those of single texts that meet in too few regions (`met`) to be linked."""
    wide = lambda df, x: df.join(radius.select(F.col("centre").alias(x), F.col("r").alias(f"r_{x}")), x, "left").fillna(0.0, [f"r_{x}"])
    known = lambda df, x: df.join(simple.select(F.col("node").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in ("n", "lost", "rest")]), x, "left")
    out = known(known(wide(wide(pairs, "a"), "b"), "a"), "b").withColumn("reach", F.lit(eps) + F.col("r_a") + F.col("r_b"))
    # All common shingles up to the end of one text's first ones are known; of the others at most the rest of that text are.
    most = F.col("met") + F.least("lost_a", "lost_b") + F.greatest("rest_a", "rest_b")
    near = most >= (1 - F.lit(eps)) * (F.col("n_a") + F.col("n_b") - most) - 1e-6
    single = (F.col("r_a") == 0) & (F.col("r_b") == 0)
    sized = F.col("n_a").isNull() | F.col("n_b").isNull() | _sized("n_a", "n_b", F.col("reach"))
    return out.filter((~single | F.coalesce(near, F.lit(True))) & sized).select("a", "b", "reach")


def join(docs: DataFrame, words: int, percent: int, leaf: int = LEAF) -> DataFrame:
    """One row for each row of docs: doc_id, n_shingles, component_id."""
    eps = 1 - percent / 100
    whole_signed = stash(signatures(docs, words, percent), "signatures")
    point = ["f1", "f2", "n"]
    signed = stash(whole_signed.select("doc_id", *point), "fingerprints")
    # Points of the space: texts with equal sets, by their smallest id.
    points = signed.filter("n > 0 and doc_id is not null").groupBy(*point).agg(F.min("doc_id").alias("node"))
    held = whole_signed.join(points.select("node", *[F.col(c).alias(f"_{c}") for c in point]), F.col("doc_id") == F.col("node"))
    held = stash(held.filter("f1 = _f1 and f2 = _f2 and n = _n").dropDuplicates(["node", *point]).select("node", "n", "m", "pivots", "first"), "points")
    unstash(whole_signed)
    # A doc_id with several sets has no distance; it neither is a centre nor goes to a cell.
    torn = signed.filter("n > 0 and doc_id is not null").groupBy(F.col("doc_id").alias("node")).agg(F.min(F.struct(*point)).alias("lo"), F.max(F.struct(*point)).alias("hi")).filter("lo <> hi").select("node")
    torn = stash(torn, "torn")
    links, cells = _cells(held.join(torn, "node", "left_anti"), docs, words, percent)
    regions, simple = _regions(held, cells, docs, words, leaf)
    regions = stash(regions, "regions")
    sizes = regions.select("pivot", "centre").distinct().groupBy("pivot").agg(F.count(F.lit(1)).alias("cells")).filter("cells > 1")
    sizes = stash(sizes, "sizes")

    # Regions of at most `leaf` cells compare the centres, as far as their radii let them.
    small = regions.select("pivot", "centre").distinct().join(sizes.filter(F.col("cells") <= leaf), "pivot").groupBy("pivot").agg(F.collect_list("centre").alias("of"))
    of = F.col("of")
    met = F.flatten(F.transform(of, lambda a: F.transform(F.filter(of, lambda b: b > a), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    pairs = small.select(F.explode(met).alias("p")).groupBy("p.a", "p.b").agg(F.count(F.lit(1)).alias("met")).join(links.distinct(), ["a", "b"], "left_anti")
    radius = cells.groupBy("centre").agg(F.max("far").alias("r"))
    pairs = _meeting_often(pairs, radius, simple.join(torn, "node", "left_anti"), eps)
    pairs = stash(_possible(pairs, held, F.col("reach")), "pairs")
    centred = stash(compare(pairs, docs, words).join(pairs, ["a", "b"]), "centred")
    links = links.unionByName(centred.filter(_linked(percent)).select("a", "b"))

    # Larger regions have a centre of their own, which measures its distance to the others.
    members = regions.join(sizes.filter(F.col("cells") > leaf), "pivot").select("pivot", "node", "most")
    middle = members.groupBy("pivot").agg(F.min("node").alias("centre"))
    members = members.join(middle, "pivot").join(held.select("node", "n"), "node").groupBy("node", "centre", "n").agg(F.max(F.coalesce("most", "n")).alias("most"))
    members = stash(members, "members")
    spokes = members.filter("node <> centre").select(F.col("centre").alias("a"), F.col("node").alias("b")).distinct()
    measured = stash(compare(spokes, docs, words, apart=True), "measured")
    around = members.join(measured.select(F.col("a").alias("centre"), F.col("b").alias("node"), "far", (F.col("whole") - F.col("common")).alias("d"), "apart"), ["centre", "node"])
    links = links.unionByName(measured.filter(_linked(percent)).select("a", "b")).unionByName(_by_the_nearest(around, percent))
    links = stash(links.distinct(), "all-links")
    classes = stash(components(links), "classes")

    more = stash(_boundary_pairs(centred.filter(~_linked(percent) & (F.col("far") <= F.col("reach") + 1e-9)), cells, classes, eps), "boundary")
    more = more.unionByName(stash(_difference_pairs(around, members.filter("node = centre"), classes, percent), "differences")).distinct()
    more = stash(_possible(more, held, F.lit(eps)), "late-pairs")
    if not more.isEmpty():
        late = stash(compare(more, docs, words).filter(_linked(percent)).select("a", "b"), "late-links")
        classes = components(late.unionByName(classes.select(F.col("node").alias("a"), F.col("component").alias("b"))))

    of_point = points.join(classes, "node", "left")
    of_point = of_point.select(*[F.col(c).alias(f"_{c}") for c in point], F.coalesce("component", "node").alias("component_id"))
    same = (F.col("f1") == F.col("_f1")) & (F.col("f2") == F.col("_f2")) & (F.col("n") == F.col("_n"))
    out = signed.select("doc_id", *point).join(of_point, same, "left")
    own = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"))


def _with_class(df: DataFrame, node: str, classes: DataFrame, out: str) -> DataFrame:
    return df.join(classes.select(F.col("node").alias(node), F.col("component").alias(out)), node, "left").withColumn(out, F.coalesce(out, node))


def _boundary_pairs(centred: DataFrame, cells: DataFrame, classes: DataFrame, eps: float) -> DataFrame:
    """Pairs of two cells' members, in different classes yet, that the triangle inequality leaves possible by their distances to the centres."""
    apart = _with_class(_with_class(centred.select("a", "b", "far"), "a", classes, "ca"), "b", classes, "cb").filter("ca <> cb").select("a", "b", "far")
    one = cells.select("node", "centre", F.col("far").alias("off"))
    one = one.unionByName(one.select(F.col("centre").alias("node"), "centre", F.lit(0.0).alias("off")).distinct())
    own = lambda x: one.select(F.col("centre").alias(x), F.col("node").alias(f"{x}_node"), F.col("off").alias(f"{x}_off"))
    met = apart.join(own("a"), "a", "left").join(own("b"), "b", "left")
    x, y = F.coalesce("a_node", "a"), F.coalesce("b_node", "b")
    window = F.coalesce("a_off", F.lit(0.0)) + F.coalesce("b_off", F.lit(0.0)) >= F.col("far") - eps - 1e-9
    return met.filter(window).select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))


def _spare(percent: int) -> Column:
    """How much nearer to the centre a text is than a link asks for, by its own size's share; a link of two texts is certain where their sum isn't negative."""
    return (100 - percent) * F.col("n") - (100 + percent) * F.col("d")


def _by_the_nearest(around: DataFrame, percent: int) -> DataFrame:
    """(a, b): of each large region, the links of the text with most to spare to all with which that is enough."""
    rows = around.select("centre", "node", _spare(percent).alias("spare"))
    best = rows.groupBy("centre").agg(F.max(F.struct("spare", "node")).alias("best"))
    linked = rows.join(best, "centre").filter((F.col("spare") + F.col("best.spare") >= 0) & (F.col("node") != F.col("best.node")))
    return linked.select(F.least("node", "best.node").alias("a"), F.greatest("node", "best.node").alias("b"))


def _difference_pairs(around: DataFrame, middle: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs of a large region, in different classes yet, that share enough of what they differ in from its centre to be linked.

    One of them at least is outside the centre's class, so beyond the threshold from it; texts x and y
    that differ from the centre in dx and dy shingles, and from each other in at most what their sizes
    allow, then share more than half of dx (as sizes differ, a little more or less). So they share one of
    the first dx - that + 1, in an order that puts shingles that the centre lacks first.
    """
    share = (100 - percent) / (100 + percent)
    sized = middle.select("centre", F.col("n").alias("centre_n"))
    of = _with_class(_with_class(around, "node", classes, "class"), "centre", classes, "centre_class").join(sized, "centre")
    open_ = of.filter("class <> centre_class").select("centre").distinct()
    least = F.greatest(F.ceil((F.col("d") + F.lit(share) * (F.col("centre_n") - F.col("n"))) / 2 - 1e-9), F.lit(1))
    of = of.join(open_, "centre").withColumn("half", F.col("d") - least + 1).withColumn("inside", F.col("class") == F.col("centre_class"))
    rows = of.select("centre", "node", "n", "most", "class", "inside", "far", "half", F.posexplode("apart").alias("at", "of"))
    mine = rows.filter("at < half")
    theirs = rows.filter("not inside").select("centre", "of", (F.col("at") < F.col("half")).alias("y_first"), *[F.col(c).alias(f"y_{c}") for c in ("node", "n", "most", "class", "far")])
    eps, shared = 1 - percent / 100, F.least("most", "y_most")
    window = (shared * 100 >= (F.col("n") + F.col("y_n") - shared) * percent) & (F.abs(F.col("far") - F.col("y_far")) <= F.lit(eps + 1e-9))
    window = window & (F.least("n", "y_n") * 100 >= F.greatest("n", "y_n") * percent) & (F.col("class") != F.col("y_class"))
    once = F.col("inside") | (F.col("y_first") & (F.col("node") < F.col("y_node")))
    met = mine.join(theirs, ["centre", "of"]).filter(window & once)
    return met.select(F.least("node", "y_node").alias("a"), F.greatest("node", "y_node").alias("b")).distinct()


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2: the class of every document under a similarity of 0.9 of sets of three-word shingles."""
    return join(table(spark, sf_dir, "documents"), words=3, percent=90)
