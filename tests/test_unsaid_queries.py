"""Contents of queries that have no SQL, against plain Python on the small tables."""

import json
import struct

import duckdb
import numpy as np
import xxhash

from fieldloom.plans.registry import QUERIES

SF = "/root/testdata/sf0.001"


def _rows(sql):
    return duckdb.sql(sql).fetchall()


def test_seeded_sample(spark, monkeypatch):
    got = [tuple(r) for r in QUERIES["seeded_sample"](spark, SF).collect()]
    keys = _rows(f"SELECT l_orderkey, l_linenumber FROM '{SF}/lineitem.parquet'")
    assert sorted(got) == sorted(keys)  # fewer than the sample: all, in its order

    def h(key):
        seed = 42
        for kind, v in (("<q", key[0]), ("<i", key[1]), ("<i", 42)):
            seed = xxhash.xxh64_intdigest(struct.pack(kind, v), seed=seed)
        return seed - (1 << 64) if seed >= 1 << 63 else seed

    assert got == sorted(keys, key=lambda k: (h(k), *k))


def test_pca_first(spark):
    got = {r["vec_id"]: r["pc1"] for r in QUERIES["pca_first"](spark, SF).collect()}
    rows = _rows(f"SELECT vec_id, embedding FROM '{SF}/embeddings.parquet' ORDER BY vec_id")
    v = np.array([r[1] for r in rows], float)
    c = v - v.mean(0)
    want = c @ np.linalg.svd(c, full_matrices=False)[2][0]
    mine = np.array([got[r[0]] for r in rows])
    assert min(np.abs(mine - want).max(), np.abs(mine + want).max()) < 1e-6


def test_geojson_export(spark):
    found = {}
    for r in QUERIES["geojson_export"](spark, SF).collect():
        body = json.loads(r["json"])
        assert body["type"] == "FeatureCollection" and [f["id"] for f in body["features"]] == sorted(f["id"] for f in body["features"])
        found |= {f["id"]: (r["p_brand"], r["sheet"], f) for f in body["features"]}
    parts = _rows(f"SELECT p_partkey, p_brand, p_size FROM '{SF}/part.parquet'")
    assert len(found) == len(parts)
    for key, brand, s in parts:
        b, sheet, f = found[key]
        assert (b, sheet) == (brand, key // 1000)
        assert f["geometry"]["coordinates"] == [[[0, 0], [s, 0], [s, 2 * s], [s / 2, s], [0, 2 * s], [0, 0]]]


def test_clusters_are_near_their_means(spark):
    got = {r["vec_id"]: r["cluster"] for r in QUERIES["kmeans_clusters"](spark, SF).collect()}
    rows = _rows(f"SELECT vec_id, embedding FROM '{SF}/embeddings.parquet' ORDER BY vec_id")
    v, lab = np.array([r[1] for r in rows], float), np.array([got[r[0]] for r in rows])
    means = np.stack([v[lab == c].mean(0) for c in range(6)])
    near = ((v[:, None] - means[None]) ** 2).sum(2).argmin(1)
    assert (near == lab).mean() > 0.95
