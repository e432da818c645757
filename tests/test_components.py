"""Components on runs against flood fills."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldloom.operators import components as C

KEYS = ["image"]


def flood(m, diagonal=True):
    steps = [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1) if (i or j) and (diagonal or not (i and j))]
    lab = np.full(m.shape, -1, np.int64)
    for y, x in zip(*np.nonzero(m)):
        if lab[y, x] < 0:
            name, todo = (int(y) << 32) + int(x), [(y, x)]
            lab[y, x] = name
            while todo:
                a, b = todo.pop()
                for i, j in steps:
                    p, q = a + i, b + j
                    if 0 <= p < m.shape[0] and 0 <= q < m.shape[1] and m[p, q] and lab[p, q] < 0:
                        lab[p, q] = name
                        todo.append((p, q))
    return lab


def spiral(n):
    m = np.zeros((n, n), bool)
    top, left, bottom, right = 0, 0, n - 1, n - 1
    while top <= bottom and left <= right:
        m[top, left : right + 1] = True
        m[top : bottom + 1, right] = True
        m[bottom, left + 1 : right + 1] = True
        m[top + 2 : bottom + 1, left + 1] = True
        top, left, bottom, right = top + 2, left + 2, bottom - 2, right - 2
    return m


def masks():
    rng = np.random.default_rng(3)
    return [rng.random((20, 30)) < p for p in (0.2, 0.4, 0.55, 0.7, 0.9)] + [spiral(30)[:20, :30], np.zeros((20, 30), bool), np.ones((20, 30), bool), np.indices((20, 30)).sum(0) % 2 == 0]


def table(spark, images):
    rows = [(k, int(y), int(x)) for k, m in enumerate(images) for y, x in zip(*np.nonzero(m))]
    return spark.createDataFrame(rows, "image int, y int, x int")


def images_of(spark, n):
    return spark.range(n).select(F.col("id").cast("int").alias("image"))


@pytest.mark.parametrize("diagonal", [True, False])
@pytest.mark.parametrize("block", [4, 256])
def test_regions_are_flood_fills(spark, diagonal, block, monkeypatch):
    monkeypatch.setattr(C, "BLOCK", block)
    ms = masks()
    px = table(spark, ms)
    got = C.pixels_of(C.connected(C.runs(px.union(px), KEYS), KEYS, diagonal), "image", "region").collect()
    want = {(k, int(y), int(x), int(lab[y, x])) for k, m in enumerate(ms) for lab in [flood(m, diagonal)] for y, x in zip(*np.nonzero(m))}
    assert len(got) == len(want) and {(r["image"], r["y"], r["x"], r["region"]) for r in got} == want


def test_areas_boxes_and_fragments(spark):
    ms = masks()
    labelled = C.connected(C.runs(table(spark, ms), KEYS), KEYS)
    got = {(r["image"], r["region"]): (r["area"], r["x0"], r["y0"], r["x1"], r["y1"]) for r in C.summary(labelled, KEYS).collect()}
    want, counts = {}, {}
    for k, m in enumerate(ms):
        lab = flood(m)
        counts[k] = len(set(lab[m].tolist()))
        for name in set(lab[m].tolist()):
            y, x = np.nonzero(lab == name)
            want[k, name] = (len(y), x.min(), y.min(), x.max() + 1, y.max() + 1)
    assert got == want
    assert {r["image"]: r["fragments"] for r in C.fragments(labelled, images_of(spark, len(ms)), KEYS).collect()} == counts
    big = C.at_least(labelled, KEYS, 9)
    assert {(r["image"], r["region"]) for r in big.collect()} == {k for k, v in want.items() if v[0] >= 9}


def test_holes(spark):
    ms = masks()
    got = C.pixels_of(C.filled(C.runs(table(spark, ms), KEYS), images_of(spark, len(ms)), KEYS, 20, 30), "image")
    rows = [(r["image"], r["y"], r["x"]) for r in got.collect()]
    want = set()
    for k, m in enumerate(ms):
        lab = flood(~m, diagonal=False)
        frame = set(np.concatenate([lab[0], lab[-1], lab[:, 0], lab[:, -1]]).tolist())
        hole = ~m & ~np.isin(lab, list(frame))
        want |= {(k, int(y), int(x)) for y, x in zip(*np.nonzero(m | hole))}
    assert len(rows) == len(set(rows)) and set(rows) == want


def test_no_pixels(spark):
    none = table(spark, [])
    assert C.connected(C.runs(none, KEYS), KEYS).count() == 0
    assert C.filled(C.runs(none, KEYS), images_of(spark, 2), KEYS, 4, 4).count() == 0


def test_pixels_and_pairs_are_not_broadcast(spark):
    one = spark.createDataFrame([(0, 0, 0, 3), (0, 1, 2, 5)], "image int, y int, x0 int, x1 int")
    px = spark.createDataFrame([(0, 0, 1, 1.0)], "image int, y int, x int, v double")
    for df in (C.pixels_of(one, "image").join(px, ["image", "y", "x"]), px.join(C.pixels_of(one, "image"), ["image", "y", "x"], "left"), C.links(one, ["image"]), C.connected(one, ["image"])):
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
