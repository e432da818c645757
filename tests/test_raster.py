import numpy as np
from hypothesis import given, settings, strategies as st

from fieldloom.operators import raster

masks = st.integers(0, 2**30).map(lambda s: np.random.default_rng(s).random((7, 9)) < 0.45)


def _flood(m):
    lab, n = np.zeros(m.shape, int), 0
    for y, x in zip(*np.nonzero(m), strict=True):
        if lab[y, x]:
            continue
        n += 1
        todo = [(y, x)]
        while todo:
            a, b = todo.pop()
            if 0 <= a < m.shape[0] and 0 <= b < m.shape[1] and m[a, b] and not lab[a, b]:
                lab[a, b] = n
                todo += [(a + i, b + j) for i in (-1, 0, 1) for j in (-1, 0, 1)]
    return lab


@settings(max_examples=40, deadline=None)
@given(masks)
def test_components_are_flood_fills(m):
    assert (raster.components(m) == _flood(m)).all()
    assert raster.components(np.pad(m, 2)).max() == raster.components(m).max()


@settings(max_examples=30, deadline=None)
@given(masks)
def test_morphology(m):
    brute = np.array([[m[max(0, y - 1) : y + 2, max(0, x - 1) : x + 2].any() for x in range(m.shape[1])] for y in range(m.shape[0])])
    assert (raster.dilate(m, 3) == brute).all()
    assert (raster.erode(m, 3) == ~raster.dilate(~m, 3)).all()
    assert not (raster.opened(m, 3) & ~m).any() and not (m & ~raster.shut(m, 3)).any()
    assert not (m & ~raster.filled(m)).any()
    assert (raster.filled(raster.filled(m)) == raster.filled(m)).all()


def test_fill():
    ring = np.zeros((7, 7), bool)
    ring[1:6, 1:6] = True
    ring[2:5, 2:5] = False
    assert raster.filled(ring).sum() == 25


def test_smoothing_keeps_constants_and_mass():
    a = np.full((6, 8), 3.0)
    assert np.allclose(raster.gaussian(a, 1.5), 3.0)
    b = np.random.default_rng(1).random((12, 12))
    assert np.isclose(raster.gaussian(b, 1.0).mean(), b.mean())


def test_watershed_and_peaks():
    heat = np.array([[1.0, 5, 1, 0, 1, 4, 1]])
    lab = raster.watershed(heat, np.ones((1, 7), bool), [(0, 1), (0, 5)])
    assert lab[0, 1] == 1 and lab[0, 5] == 2 and (lab > 0).all()
    assert (raster.watershed(heat, heat > 0, [(0, 1)])[0, 4:] == 0).all()
    top = np.zeros((20, 20))
    top[6, 6], top[8, 8], top[15, 15] = 3, 2, 1
    assert raster.local_peaks(top, 3, 0.5) == [(6, 6), (15, 15)]


@settings(max_examples=60, deadline=None)
@given(masks)
def test_outlines_walk_the_outer_border(m):
    lab = raster.components(m)
    rings = raster.outlines(lab)
    assert len(rings) == lab.max()
    for i, ring in enumerate(rings, 1):
        at = {(y, x) for x, y in ring}
        mine = lab == i
        assert all(mine[p] for p in at)
        assert all(max(abs(a[0] - b[0]), abs(a[1] - b[1])) <= 1 for a, b in zip(ring, ring[1:] + ring[:1]))
        solid = raster.filled(mine)
        frame = np.pad(~solid, 1, constant_values=True)
        border = {(y, x) for y, x in np.argwhere(solid) if frame[y, x + 1] or frame[y + 2, x + 1] or frame[y + 1, x] or frame[y + 1, x + 2]}
        assert {(int(y), int(x)) for y, x in border} <= at
        painted = raster.painted([ring], *m.shape)
        assert (painted >= mine).all() and (painted <= solid).all()


def test_polygons():
    m = np.zeros((40, 40), bool)
    m[5:30, 8:35] = True
    m[36:38, 1:3] = True
    (ring,) = raster.polygons(m)
    assert set(ring) == {(8, 5), (34, 5), (34, 29), (8, 29)}
    again = raster.painted([ring], 40, 40)
    assert (again == (m & (np.arange(40)[:, None] < 32))).all()
    assert not raster.painted([ring], 40, 40, [[(15, 10), (25, 10), (25, 20), (15, 20)]])[15, 20]
