"""Neighbours by bounds against all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldloom.operators import neighbours as N

RNG = np.random.default_rng(21)


def groups():
    centres = RNG.normal(size=(12, 6)) * 3
    tight = centres[RNG.integers(0, 12, 400)] + 0.05 * RNG.normal(size=(400, 6))
    loose = RNG.normal(size=(150, 6)) * RNG.uniform(0.1, 4, (150, 1))
    ties = np.repeat(np.eye(6), 4, axis=0)
    odd = np.array([[0.0] * 6, [1.0] * 6, [-1.0] * 6, [0.0] * 6])
    return {"tight": tight, "loose": loose, "ties": ties, "odd": odd, "alone": np.ones((1, 6)), "pair": -np.ones((2, 6))}


@pytest.mark.parametrize("part", [7, 1024])
def test_all_pairs(spark, monkeypatch, part):
    monkeypatch.setattr(N, "PART", part)
    gs = groups()
    df = spark.createDataFrame([(g, 10 * i + 3, x.tolist()) for g, v in gs.items() for i, x in enumerate(v)], "g string, row int, v array<double>").repartition(5)
    got = {(r["g"], r["id"]): r for r in N.nearest(df, ["g"], "row", "v").collect()}
    assert len(got) == sum(len(v) for g, v in gs.items() if g != "alone")
    for g, v in gs.items():
        s = np.round(v @ v.T, 9)
        np.fill_diagonal(s, -np.inf)
        for i in range(len(v)) if g != "alone" else ():
            r = got[g, 10 * i + 3]
            assert r["nn"] == 10 * int(s[i].argmax()) + 3 and abs(r["similarity"] - s[i].max()) < 1e-8, (g, i)
    n = len(gs["tight"])
    assert sum(r["compared"] for (g, _), r in got.items() if g == "tight") < 0.5 * n * (n - 1)
    assert all(r["compared"] <= len(gs[g]) - 1 for (g, _), r in got.items())


def test_float_vectors_and_no_rows(spark):
    df = spark.createDataFrame([(1, 1, [0.5, 0.5]), (1, 2, [0.25, 0.5]), (1, 3, [-1.0, 0.0])], "t int, vec_id long, e array<float>")
    assert {r["id"]: r["nn"] for r in N.nearest(df, ["t"], "vec_id", "e").collect()} == {1: 2, 2: 1, 3: 2}
    assert N.nearest(df.filter(F.lit(False)), ["t"], "vec_id", "e").count() == 0
