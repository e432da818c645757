"""Clusters, agreement-weighted prototypes and principal axes against NumPy; GeoJSON by parsing it."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldloom.functions import geometry as geo
from fieldloom.operators import prototypes as P
from fieldloom.sources import sinks

WIDTH = 5
RNG = np.random.default_rng(12)


@pytest.fixture(scope="module")
def tiles(spark):
    sizes = {"a": 130, "b": 45, "c": 2}
    rows, arrays = [], {}
    for t, n in sizes.items():
        v = RNG.normal(size=(n, WIDTH)) + 3 * RNG.integers(0, 3, (n, 1))
        agree, bright = RNG.random(n), -v[:, 1] + 0.1 * RNG.random(n)
        arrays[t] = v, agree, bright
        rows += [(t, i, v[i].tolist(), float(agree[i]), float(bright[i])) for i in range(n)]
    flat = np.ones((3, WIDTH))
    arrays["flat"] = flat, np.zeros(3), np.zeros(3)
    rows += [("flat", i, flat[i].tolist(), 0.0, 0.0) for i in range(3)]
    return spark.createDataFrame(rows, "t string, i int, v array<double>, agree double, bright double").repartition(4).cache(), arrays


def lloyd(v, steps):
    k = max(2, min(6, len(v) // 20))
    names, centres = np.arange(min(k, len(v))), v[:k].copy()
    near = lambda: names[np.argmin(np.round((centres**2).sum(1) - 2 * v @ centres.T, 9), axis=1)]
    for _ in range(steps):
        lab = near()
        names, centres = np.unique(lab), np.stack([v[lab == c].mean(0) for c in np.unique(lab)])
    return near(), names, centres


@pytest.mark.parametrize("steps", [0, 1, 6])
def test_clusters_and_agreement(tiles, steps):
    df, arrays = tiles
    assigned, centres = P.clusters(df, ["t"], "i", "v", WIDTH, steps)
    got = {(r["t"], r["i"]): r["cluster"] for r in assigned.collect()}
    sims = {(r["t"], r["i"]): r["similarity"] for r in P.agreement(assigned, centres, ["t"], "v", "agree", WIDTH).collect()}
    for t, (v, agree, _) in arrays.items():
        lab, names, cs = lloyd(v, steps)
        assert [got[t, i] for i in range(len(v))] == lab.tolist()
        used = [k for k, c in enumerate(names) if (lab == c).any()]
        a = np.array([agree[lab == names[k]].mean() for k in used])
        w = np.exp((a - a.max()) / (a.std() + 1e-6))
        proto = (w[:, None] * cs[used]).sum(0) / w.sum()
        s = v @ (proto / (np.linalg.norm(proto) + 1e-6))
        assert np.allclose([sims[t, i] for i in range(len(v))], (s - s.min()) / (s.max() - s.min() + 1e-6), atol=1e-9)


def test_principal_axis_runs_against_brightness(tiles):
    df, arrays = tiles
    got = {(r["t"], r["i"]): r["pc1"] for r in P.principal(df, ["t"], "v", "bright", WIDTH).collect()}
    for t, (v, _, bright) in arrays.items():
        c = v - v.mean(0)
        pc = c @ np.linalg.svd(c)[2][0] if t != "flat" else np.zeros(len(v))
        if t != "flat" and np.corrcoef(pc, bright)[0, 1] > 0:
            pc = -pc
        mine = np.array([got[t, i] for i in range(len(v))])
        assert np.allclose(mine, (pc - pc.min()) / (pc.max() - pc.min() + 1e-6), atol=1e-6)


def test_geojson(spark):
    rows = [(1, "s", [[(0.0, 0.0), (4.0, 0.0), (4.0, 4.0)], [(2.0, 1.0), (3.0, 1.0), (3.0, 2.0)]], None), (2, "s", [[(0.0, 0.0), (1.0, 0.0), (0.0, 1.0)]], None), (3, "w", [[(0.0, 0.0), (2.0, 0.0), (0.0, 2.0)]], [10.0, 0.5, 0.0, 20.0, 0.0, -0.5])]
    df = spark.createDataFrame(rows, "id int, sheet string, rings array<array<struct<x:double,y:double>>>, gt array<double>")
    props = geo.properties({"id": F.col("id"), "class": F.lit("é"), "note": F.lit(None).cast("string")}, {"class": F.lit("z"), "extra": F.lit(True)})
    crs = F.when(F.col("gt").isNotNull(), F.lit("urn:x"))
    out = {r["sheet"]: json.loads(r["json"]) for r in sinks.feature_collections(df, ["sheet"], geo.polygon_feature(F.col("rings"), props, F.col("gt")), F.col("id"), crs).collect()}
    assert "crs" not in out["s"] and out["w"]["crs"] == {"type": "name", "properties": {"name": "urn:x"}}
    first = out["s"]["features"][0]
    assert first["geometry"]["coordinates"] == [[[0, 0], [4, 0], [4, 4], [0, 0]], [[2, 1], [3, 1], [3, 2], [2, 1]]]
    assert first["properties"] == {"id": 1, "class": "z", "extra": True} and [f["properties"]["id"] for f in out["s"]["features"]] == [1, 2]
    assert out["w"]["features"][0]["geometry"]["coordinates"] == [[[10, 20], [11, 20], [10, 19], [10, 20]]]
