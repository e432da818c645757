"""Windows over tiles and morphology on runs against NumPy on whole images."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldloom.operators import components as C, morphology as M, stencils as S, textures as T

KEYS, H, W = ["image"], 21, 34
RNG = np.random.default_rng(4)
IMAGES = [RNG.random((H, W)), np.indices((H, W)).sum(0) / 10.0]
MASKS = [RNG.random((H, W)) < p for p in (0.5, 0.75, 0.93)] + [np.zeros((H, W), bool), np.ones((H, W), bool)]
PAD = {"reflect": "symmetric", "mirror": "reflect", "nearest": "edge"}


def windows(a, ry, rx, border):
    return np.lib.stride_tricks.sliding_window_view(np.pad(a, ((ry, ry), (rx, rx)), PAD[border]), (2 * ry + 1, 2 * rx + 1))


def table(spark, images, value="v"):
    rows = [(k, y, x, a[y, x].item()) for k, a in enumerate(images) for y in range(H) for x in range(W)]
    return spark.createDataFrame(rows, f"image int, y int, x int, {value} double").repartition(5)


def arrays(df, value="v"):
    out = {}
    for r in df.collect():
        a = out.setdefault(r["image"], np.full((H, W), np.nan))
        assert np.isnan(a[r["y"], r["x"]])
        a[r["y"], r["x"]] = r[value]
    return [out[k] for k in sorted(out)]


@pytest.fixture(scope="module")
def px(spark):
    return table(spark, IMAGES).cache()


@pytest.mark.parametrize("border", S.BORDERS)
@pytest.mark.parametrize("tile", [8, 256])
def test_separable(px, border, tile):
    ky, kx = [0.5, -1.0, 2.0, 0.0, 1.5], [1.0, 2.0, -3.0]
    got = arrays(S.separable(px, KEYS, ["v"], ky, kx, H, W, border, tile))
    for a, g in zip(IMAGES, got):
        assert np.allclose(g, np.einsum("yxij,i,j->yx", windows(a, 2, 1, border), ky, kx))


def test_one_shuffle_for_both_directions(px):
    plan = S.separable(px, KEYS, ["v"], [1.0] * 3, [1.0] * 3, H, W)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


@pytest.mark.parametrize("tile", [10, 256])
def test_gaussian(px, tile):
    k = np.array(S.gaussian_kernel(1.7))
    for a, g in zip(IMAGES, arrays(S.gaussian(px, KEYS, ["v"], 1.7, H, W, tile))):
        assert np.allclose(g, np.einsum("yxij,i,j->yx", windows(a, len(k) // 2, len(k) // 2, "reflect"), k, k))


def test_radius_beyond_the_image_is_an_error(px):
    with pytest.raises(ValueError):
        S.gaussian(px, KEYS, ["v"], 9.0, H, W)
    with pytest.raises(ValueError):
        S.with_halo(px, KEYS, ["v"], 1, 1, H, W, "wrap")


@pytest.mark.parametrize("tile", [8, 256])
def test_median(px, tile):
    for a, g in zip(IMAGES, arrays(S.median(px, KEYS, "v", 7, H, W, tile))):
        assert np.allclose(g, np.median(windows(a, 3, 3, "nearest"), axis=(2, 3)))


def test_coherence(px):
    sy, sx = np.array([1.0, 2, 1]), np.array([-1.0, 0, 1])
    k = np.array(S.gaussian_kernel(2.0))
    for a, g in zip(IMAGES, arrays(S.coherence(px, KEYS, "v", H, W, 2.0))):
        w = windows(a, 1, 1, "mirror")
        gx, gy = np.einsum("yxij,i,j->yx", w, sy, sx), np.einsum("yxij,i,j->yx", w, sx, sy)
        xx, yy, xy = (np.einsum("yxij,i,j->yx", windows(v, 8, 8, "reflect"), k, k) for v in (gx * gx, gy * gy, gx * gy))
        assert np.allclose(g, np.clip(np.sqrt((xx - yy) ** 2 + 4 * xy**2) / (xx + yy + 1e-6), 0, 1))


def test_local_contrast(px):
    k = np.array(S.gaussian_kernel(4))
    for a, g in zip(IMAGES, arrays(S.local_contrast(px, KEYS, "v", H, W))):
        high = a - np.einsum("yxij,i,j->yx", windows(a, 16, 16, "reflect"), k, k)
        lo, hi = np.percentile(high, [1, 99])
        assert np.allclose(g, np.clip((high - lo) / (hi - lo + 1e-6), 0, 1))


@pytest.mark.parametrize("size", [1, 5, 51])
def test_box_mean(px, size):
    r = size // 2
    for a, g in zip(IMAGES, arrays(S.box_mean(px, KEYS, "v", size, "m"), "m")):
        want = [[a[max(0, y - r) : y + r + 1, max(0, x - r) : x + r + 1].mean() for x in range(W)] for y in range(H)]
        assert np.allclose(g, want)


def test_box_totals(spark, px):
    boxes = [(k, i, int(a), int(b), int(c), int(d)) for k in (0, 1) for i, (a, b, c, d) in enumerate([(0, 0, W, H), (3, 4, 9, 6), (5, 5, 5, 9), (W - 1, H - 1, W, H), (0, 7, 1, 8)])]
    df = spark.createDataFrame(boxes, "image int, box int, x0 int, y0 int, x1 int, y1 int")
    got = {(r["image"], r["box"]): r["total"] for r in S.box_totals(df, S.integral(px, KEYS, "v"), KEYS, ["box"]).collect()}
    assert len(got) == len(boxes)
    for k, i, x0, y0, x1, y1 in boxes:
        assert abs(got[k, i] - IMAGES[k][y0:y1, x0:x1].sum()) < 1e-9


def test_dense(spark):
    some = spark.createDataFrame([(0, 1, 2, 5.0)], "image int, y long, x long, v double")
    out = S.dense(some, spark.range(2).select(F.col("id").cast("int").alias("image")), KEYS, {"v": 0.0}, 3, 4).collect()
    assert len(out) == 24 and [tuple(r) for r in out if r["v"]] == [(0, 1, 2, 5.0)]


# --- morphology --------------------------------------------------------------------------------------------------------


def dilate(m, size):
    return np.lib.stride_tricks.sliding_window_view(np.pad(m, size // 2), (size, size)).any(axis=(2, 3))


def erode(m, size):
    return ~dilate(~m, size)


@pytest.fixture(scope="module")
def masks(spark):
    rows = [(k, int(y), int(x)) for k, m in enumerate(MASKS) for y, x in zip(*np.nonzero(m))]
    return C.runs(spark.createDataFrame(rows, "image int, y int, x int"), KEYS).cache(), spark.range(len(MASKS)).select(F.col("id").cast("int").alias("image"))


def pixels(df):
    out = np.zeros((len(MASKS), H, W), bool)
    for r in C.pixels_of(df, "image").collect():
        assert not out[r["image"], r["y"], r["x"]]
        out[r["image"], r["y"], r["x"]] = True
    return list(out)


@pytest.mark.parametrize("size", [1, 3, 9])
def test_dilation_and_erosion(masks, size):
    runs, images = masks
    assert all((g == dilate(m, size)).all() for g, m in zip(pixels(M.dilated(runs, KEYS, size, H, W)), MASKS))
    assert all((g == erode(m, size)).all() for g, m in zip(pixels(M.eroded(runs, images, KEYS, size, H, W)), MASKS))


def test_opening_and_closing(masks):
    runs, images = masks
    assert all((g == dilate(erode(m, 5), 5)).all() for g, m in zip(pixels(M.opened(runs, images, KEYS, 5, H, W)), MASKS))
    assert all((g == erode(dilate(m, 9), 9)).all() for g, m in zip(pixels(M.closed(runs, images, KEYS, 9, H, W)), MASKS))


def test_boundary_f1(spark, masks):
    runs, images = masks
    other = M.dilated(runs, KEYS, 3, H, W)
    got = {r["image"]: r["f1"] for r in M.boundary_f1(runs, other, images, KEYS, H, W, 1).collect()}
    for k, m in enumerate(MASKS):
        a, b = m & ~erode(m, 3), dilate(m, 3) & ~erode(dilate(m, 3), 3)
        p, r = (x[dilate(y, 3)].sum() / max(x.sum(), 1) for x, y in ((a, b), (b, a)))
        assert abs(got[k] - (2 * p * r / (p + r) if p + r else 0)) < 1e-12


# --- texture -----------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("tile", [9, 256])
def test_weighted(px, tile):
    kernels = {n: RNG.random((5, 5)).tolist() for n in "ab"}
    out = S.weighted(px, KEYS, "v", kernels, H, W, "mirror", tile)
    for n, k in kernels.items():
        for a, g in zip(IMAGES, arrays(out, n)):
            assert np.allclose(g, np.einsum("yxij,ij->yx", windows(a, 2, 2, "mirror"), np.array(k)))


@pytest.mark.parametrize("tile", [9, 256])
def test_entropy(spark, tile):
    levels = [RNG.integers(0, 6, (H, W)).astype(float), np.zeros((H, W))]
    px = table(spark, levels, "level").withColumn("level", F.col("level").cast("int"))
    for a, g in zip(levels, arrays(S.entropy(px, KEYS, "level", 3, H, W, "e", tile), "e")):
        for y, x in ((0, 0), (10, 17), (H - 1, 5), (8, W - 1)):
            near = [a[p, q] for p in range(H) for q in range(W) if (p - y) ** 2 + (q - x) ** 2 <= 9]
            p = np.unique(near, return_counts=True)[1] / len(near)
            assert abs(g[y, x] + (p * np.log2(p)).sum()) < 1e-9


def test_waves_and_periods_answer_to_stripes(spark):
    stripes = np.tile(np.sin(np.arange(W) * 2 * np.pi * 0.2), (H, 1))
    noise = RNG.random((H, W)) - 0.5
    px = table(spark, [stripes, noise])
    waves = arrays(T.wave_energy(px, KEYS, "v", H, W, (0.2,), 8, 9))
    best = np.zeros((H, W))
    y, x = np.mgrid[-4:5, -4:5].astype(float)
    for j in range(8):
        t = np.pi * j / 8
        u, v = x * np.cos(t) + y * np.sin(t), y * np.cos(t) - x * np.sin(t)
        k = np.exp(-(u * u + 0.25 * v * v) / 32) * np.cos(2 * np.pi * 0.2 * u)
        best = np.maximum(best, np.abs(np.einsum("yxij,ij->yx", windows(stripes, 4, 4, "mirror"), k - k.mean())))
    assert np.allclose(waves[0], best)
    got = {(r["image"], r["ty"], r["tx"]): r["period"] for r in T.periodicity(px, KEYS, "v", 16, H, W).collect()}
    assert {(ty, tx) for k, ty, tx in got if k == 0} == {(ty, tx) for ty in (0, H - 16) for tx in (0, 8, 16, W - 16)}
    h = np.hanning(16)
    a = stripes[:16, 8:24]
    f = np.abs(np.fft.fftshift(np.fft.fft2((a - a.mean()) * h[:, None] * h)))
    f[6:11, 6:11] = 0
    assert abs(got[0, 0, 8] - f.max() / (f.mean() + 1e-6)) < 1e-9
    assert min(v for (k, *_), v in got.items() if k == 0) > 2 * max(v for (k, *_), v in got.items() if k == 1)


def test_row_prior_prefers_rows(spark):
    n = 48
    half = np.tile(127 + 100 * np.sin(np.arange(n) * 2 * np.pi * 0.2)[:, None], (1, n))
    half[:, n // 2 :] = 60 + 10 * RNG.random((n, n // 2))
    rows = [(0, y, x, half[y, x].item()) for y in range(n) for x in range(n)]
    out = T.row_prior(spark.createDataFrame(rows, "image int, y int, x int, g double"), KEYS, "g", n, n, 24)
    means = {r["left"]: r["m"] for r in out.groupBy((F.col("x") < n // 2).alias("left")).agg(F.avg("v").alias("m")).collect()}
    assert out.count() == n * n and means[True] > 2 * means[False]


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_entropy_makes_no_row_for_a_place_of_the_disk(spark):
    px = table(spark, [IMAGES[0]], "level").withColumn("level", F.floor(F.col("level") * 6).cast("int"))
    plan = _plan(S.entropy(px, KEYS, "level", 3, H, W, "e"))
    assert "Join" not in plan and "Aggregate" not in plan and plan.count("Exchange hashpartitioning") == 1


def test_entropy_of_nulls_and_absent_pixels(spark):
    rows = [(0, y, x, None if x % 2 else 7) for y in range(4) for x in range(6) if x < 5]
    px = spark.createDataFrame(rows, "image int, y int, x int, level int")
    got = {(r["y"], r["x"]): r["e"] for r in S.entropy(px, KEYS, "level", 1, 4, 6, "e", 3).collect()}
    assert len(got) == 4 * 6 and got[0, 5] == 0.0
    assert abs(got[1, 4] + 3 / 4 * np.log2(3 / 4) + 1 / 4 * np.log2(1 / 4)) < 1e-12


def test_periodicity_joins_no_exploded_tiles(px):
    plan = _plan(T.periodicity(px, KEYS, "v", 16, H, W))
    assert "Join" not in plan and plan.count("Exchange hashpartitioning") == 1


def test_periodicity_by_blocks(px):
    got = [{(r["image"], r["ty"], r["tx"]): r["period"] for r in T.periodicity(px, KEYS, "v", 8, H, W, block=b).collect()} for b in (5, 256)]
    assert len(got[0]) == 2 * 5 * 8 and got[0].keys() == got[1].keys()
    assert all(abs(v - got[1][k]) < 1e-9 for k, v in got[0].items())


def test_waves_make_no_row_for_a_place_of_the_kernel(px):
    plan = _plan(T.wave_energy(px, KEYS, "v", H, W, (0.2,), 2, 9))
    assert "Join" not in plan and "Aggregate" not in plan and plan.count("Exchange hashpartitioning") == 1


@pytest.mark.parametrize("tile", [9, 256])
def test_strongest_is_the_largest_of_weighted(px, tile):
    kernels = {n: (RNG.random((5, 5)) - 0.5).tolist() for n in "ab"}
    one, two = (arrays(S.weighted(px, KEYS, "v", kernels, H, W), n) for n in "ab")
    for a, b, g in zip(one, two, arrays(S.strongest(px, KEYS, "v", list(kernels.values()), H, W, "mirror", tile))):
        assert np.allclose(g, np.maximum(np.abs(a), np.abs(b)))


def test_separable_kernels_lag_no_rows(px):
    plan = _plan(S.coherence(px, KEYS, "v", H, W, 2.0))
    assert "Window" not in plan and "Join" not in plan


def test_separable_of_nulls(spark):
    rows = [(0, y, x, None if (y, x) == (1, 1) else float("nan") if (y, x) == (3, 5) else 1.0) for y in range(4) for x in range(6)]
    got = {(r["y"], r["x"]): r["v"] for r in S.separable(spark.createDataFrame(rows, "image int, y int, x int, v double"), KEYS, ["v"], [1.0, 1.0, 1.0], [0.0, 1.0, 1.0], 4, 6, "nearest", 3).collect()}
    assert len(got) == 24 and {k for k, v in got.items() if v is None} == {(y, x) for y in (0, 1, 2) for x in (0, 1)}
    assert {k for k, v in got.items() if v is not None and v != v} == {(y, x) for y in (2, 3) for x in (4, 5)} and got[0, 3] == 6.0
