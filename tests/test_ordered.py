"""Places, running totals and percentiles against plain sorting; no window or percentile aggregate over a group."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldloom.functions import numeric
from fieldloom.operators import metrics, ordered

PROBABILITIES = [0.0, 0.01, 0.25, 0.5, 0.55, 0.99, 1.0]


def rows():
    rng = random.Random(1)
    out = [("big", i, rng.gauss(0, 1) * 10 ** rng.randint(-8, 8)) for i in range(3000)]
    out += [("ties", i, float(rng.randint(0, 3))) for i in range(500)]
    out += [("one", 0, 7.5), ("two", 0, -1.0), ("two", 1, 3.0), ("same", 0, 2.0), ("same", 1, 2.0)]
    out += [("wide", i, v) for i, v in enumerate([-math.inf, -1e308, -5e-324, 0.0, -0.0, 5e-324, 1e308, math.inf])]
    out += [("dense", i, 1.0 + i * 2.0**-52) for i in range(200)]
    out += [(None, i, float(i)) for i in range(40)]
    return out


@pytest.fixture(scope="module")
def table(spark):
    extra = [("big", 9999, None), ("big", 9998, math.nan), ("none", 0, None)]
    return spark.createDataFrame(rows() + extra, "g string, i long, v double").repartition(6)


def groups():
    out = {}
    for g, _, v in rows():
        out.setdefault(g, []).append(v)
    return {g: sorted(v) for g, v in out.items()}


@pytest.mark.parametrize("bins,few", [(4096, 4096), (4, 2), (8, 0)])
def test_percentiles(table, monkeypatch, bins, few):
    monkeypatch.setattr(ordered, "BINS", bins)
    monkeypatch.setattr(ordered, "FEW", few)
    got = {r["g"]: r["q"] for r in ordered.percentiles(table.filter("g <> 'wide' OR g IS NULL"), ["g"], "v", PROBABILITIES).collect()}
    want = {g: v for g, v in groups().items() if g != "wide"}
    assert set(got) == set(want)
    for g, v in want.items():
        assert np.allclose(got[g], np.quantile(v, PROBABILITIES), rtol=1e-12, atol=0), g


def test_extreme_values_are_places_of_their_own(table):
    got = {r["place"]: r["v"] for r in ordered.order_statistics(table.filter("g = 'wide'"), ["g"], "v", [k / 7 for k in range(8)]).collect()}
    want = groups()["wide"]
    assert {k: got[k] for k in (0, 1, 2, 5, 6, 7)} == {k: want[k] for k in (0, 1, 2, 5, 6, 7)}


def test_plans_hold_no_group(table):
    plan = ordered.percentiles(table, ["g"], "v", [0.5])._jdf.queryExecution().toString().lower()
    assert "percentile(" not in plan and "collect_list(v" not in plan
    placed = ordered.positions(table, ["g"], ["v", "i"])._jdf.queryExecution().optimizedPlan().toString()
    assert "row_number" not in placed and "rank(" not in placed


def test_positions(table):
    got = {(r["g"], r["i"]): (r["position"], r["size"]) for r in ordered.positions(table.filter("v IS NOT NULL AND NOT isnan(v)"), ["g"], ["v", "i"]).collect()}
    by = {}
    for g, i, v in rows():
        by.setdefault(g, []).append((v, i))
    want = {(g, i): (k, len(m)) for g, m in by.items() for k, (_, i) in enumerate(sorted(m))}
    assert got == want


def test_running(spark, monkeypatch):
    monkeypatch.setattr(ordered, "BLOCK_BITS", 3)
    data = [("a" if i % 3 else "b", i, i % 7) for i in range(700)] + [(None, i, 2) for i in range(30)]
    df = spark.createDataFrame(data, "g string, i long, n long").repartition(5)
    got = {(r["g"], r["i"]): r["before"] for r in ordered.running(df, ["g"], ["i"], "n", "before").collect()}
    want, total = {}, {}
    for g, i, n in sorted(data, key=lambda r: r[1]):
        want[g, i] = total.get(g, 0)
        total[g] = total.get(g, 0) + n
    assert got == want


def test_auroc(spark):
    rng = np.random.default_rng(2)
    data = [("x", float(s), bool(p)) for s, p in zip(rng.integers(0, 40, 600), rng.random(600) < 0.3)] + [("one", 1.0, True), ("one", 2.0, True)]
    df = spark.createDataFrame(data, "g string, s double, p boolean")
    got = {r["g"]: r["auroc"] for r in metrics.auroc(df, ["g"], F.col("s"), F.col("p")).collect()}
    pos, neg = [s for g, s, p in data if g == "x" and p], [s for g, s, p in data if g == "x" and not p]
    want = np.mean([(a > b) + (a == b) / 2 for a in pos for b in neg])
    assert abs(got["x"] - want) < 1e-9 and got["one"] is None


def test_norm_and_rank(table):
    some = table.filter("g IN ('big', 'one', 'none')")
    out = {(r["g"], r["i"]): r["o"] for r in numeric.norm01(some, ["g"], "v", "o").collect()}
    lo, hi = np.quantile(groups()["big"], [0.01, 0.99])
    for g, i, v in rows():
        if g == "big":
            assert abs(out[g, i] - min(1, max(0, (v - lo) / (hi - lo + 1e-6)))) < 1e-9
    assert out["one", 0] == 0 and out["none", 0] is None and len(out) == some.count()
    ranks = {r["i"]: r["o"] for r in numeric.pixel_rank(table.filter("g = 'ties'"), ["g"], "v", ["i"], "o").collect()}
    assert sorted(ranks.values()) == [pytest.approx(k / 499) for k in range(500)]
