import numpy as np
import pytest

from fieldloom.operators import pixels, proposal, raster

SIDE = 40


def _heat():
    y, x = np.mgrid[:SIDE, :SIDE]
    bump = lambda a, b, r, h: h * np.exp(-((y - a) ** 2 + (x - b) ** 2) / (2 * r * r))
    return np.round(bump(10, 10, 4, 1.0) + bump(28, 30, 5, 0.8) + 0.01 * np.random.default_rng(2).random((SIDE, SIDE)), 6)


@pytest.fixture(scope="module")
def heat(spark):
    a = _heat()
    return a, spark.createDataFrame([(t, int(y), int(x), float(v)) for t in (1, 2) for (y, x), v in np.ndenumerate(a if t == 1 else a.T)], "t long, y int, x int, v double").cache()


def _brute_stable(a):
    m = sum((a >= np.round(np.percentile(a, p), 9)).astype(int) for p in (55, 62, 70, 78, 86)) >= 3
    lab = raster.components(raster.clean(m, 1, fill=True))
    rows = []
    for i in range(1, lab.max() + 1):
        y, x = np.nonzero(lab == i)
        if len(y) >= 8:
            rows.append((round(float(a[y, x].mean()), 9), len(y), int(x.min()), int(y.min()), int(x.max()) + 1, int(y.max()) + 1, (round(y.mean(), -1), round(x.mean(), -1))))
    out, seen = [], set()
    for r in sorted(rows, reverse=True):
        if r[-1] not in seen:
            seen.add(r[-1])
            out.append(r[:-1])
    return out[:6]


def test_stability_is_the_naive_loop(heat):
    a, df = heat
    found, at = proposal.propose(df, ["t"], "v", "stability", SIDE, SIDE, 8)
    rows = found.filter("t = 1").orderBy("rank").collect()
    assert [(round(r.confidence, 9), r.area, r.x0, r.y0, r.x1, r.y1) for r in rows] == _brute_stable(a)
    assert at.filter("t = 1").count() == sum(r.area for r in rows)


@pytest.mark.parametrize("method", proposal.METHODS)
def test_methods_find_both_bumps(heat, method):
    _, df = heat
    found, _ = proposal.propose(df, ["t"], "v", method, SIDE, SIDE, 8, apart=5)
    rows = found.filter("t = 2").collect()
    assert rows and [r.rank for r in sorted(rows, key=lambda r: -r.confidence)] == list(range(1, len(rows) + 1))
    smooth = method in ("A_threshold", "B_localmax", "C_adaptive", "D_multithresh")
    assert any(r.x0 <= 10 < r.x1 and r.y0 <= 10 < r.y1 for r in rows)
    assert smooth or any(r.x0 <= 28 < r.x1 and r.y0 <= 30 < r.y1 for r in rows)


def test_unknown_method(heat):
    with pytest.raises(ValueError):
        proposal.propose(heat[1], ["t"], "v", "other", SIDE, SIDE, 8)


def test_prompts(heat):
    a, df = heat
    _, at = proposal.propose(df.filter("t = 1"), ["t"], "v", "stability", SIDE, SIDE, 8)
    prompts = proposal.region_prompts(at, ["t"], "v")
    inside = {}
    for r in at.collect():
        inside.setdefault((r.level, r.region), {})[r.y, r.x] = r.v
    boxes = {(p.level, p.region): p for p in prompts.collect()}
    assert boxes.keys() == inside.keys()
    for key, p in boxes.items():
        ys, xs = [y for y, _ in inside[key]], [x for _, x in inside[key]]
        assert (p.x0, p.y0, p.x1, p.y1) == (min(xs), min(ys), max(xs), max(ys))
        assert p.ex0 == p.x0 + int((p.x1 - p.x0) * 0.05) and p.ey1 == p.y1 - int((p.y1 - p.y0) * 0.05)
        assert (p.peak_y, p.peak_x) == min(inside[key], key=lambda q: (-inside[key][q], q))
    points = {}
    for r in proposal.positive_points(at, prompts, ["t"], "v").orderBy("pick").collect():
        points.setdefault((r.level, r.region), []).append((r.y, r.x))
    for key, got in points.items():
        kept = []
        for q in sorted(inside[key], key=lambda q: (-inside[key][q], q)):
            if len(kept) < 6 and all((q[0] - k[0]) ** 2 + (q[1] - k[1]) ** 2 > boxes[key].apart ** 2 for k in kept):
                kept.append(q)
        assert got == kept
    negative = proposal.negative_points(at, prompts, df.filter("t = 1"), ["t"], "v", SIDE, SIDE).collect()
    assert negative and all((r.y, r.x) not in inside[r.level, r.region] for r in negative)


def test_hsv(spark):
    rows = spark.createDataFrame([(255, 0, 0), (0, 255, 0), (0, 0, 255), (90, 90, 90), (0, 0, 0), (200, 180, 40)], "r int, g int, b int")
    got = [tuple(r) for r in rows.select(*pixels.hsv(rows.r, rows.g, rows.b)).collect()]
    assert got[:5] == [(0, 255, 255), (60, 255, 255), (120, 255, 255), (0, 0, 90), (0, 0, 0)]
    assert got[5] == (26, 204, 200)


def test_confidence_does_not_depend_on_the_order_of_pixels(spark):
    values = [round(0.1 + 0.012345 * k % 0.9, 6) for k in range(1, 48)]
    values.append(round(0.722066 * 48 + 24e-9 - sum(values), 6))
    rows = [(k, 0, x, v) for k, vs in enumerate((values, values[::-1], sorted(values), sorted(values, reverse=True))) for x, v in enumerate(vs)]
    px = spark.createDataFrame(rows + [(4, 0, 0, 1e300), (4, 0, 1, 0.0), (5, 0, 0, None)], "t int, y int, x int, v double").coalesce(1)
    got = {r["t"]: r["confidence"] for r in pixels.regions(px, ["t"], "v").collect()}
    from fractions import Fraction

    want = float(sum(Fraction(str(v)) for v in values) / 48)
    assert [got[k] for k in range(4)] == [want] * 4 and got[4] == 5e299 and got[5] is None
