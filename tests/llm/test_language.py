"""The byte network: gradients by finite differences, held-out accuracy, odd rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldloom.llm import language_id as L
from fieldloom.llm.quality_classifier import is_held_out

SF = "/root/testdata/sf0.01"


def test_gradients():
    net = L.Network(["a", "b", "c"], seed=3)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    rng = np.random.default_rng(1)
    x, y = rng.integers(97, 123, (5, 12)).astype(np.uint8), np.array([0, 1, 2, 1, 0])
    g = net.gradients(x, y)
    loss = lambda: -np.log(net.probabilities(x)[np.arange(5), y]).mean()
    for name, v in net.p.items():
        flat = np.flatnonzero(np.abs(g[name]).ravel() > 1e-4)[:6]
        for i in flat:
            at = np.unravel_index(i, v.shape)
            old = v[at]
            v[at] = old + 1e-3
            up = loss()
            v[at] = old - 1e-3
            down = loss()
            v[at] = old
            assert abs((up - down) / 2e-3 - g[name][at]) < 2e-3 + 0.05 * abs(g[name][at])


def test_every_filter_sees_every_place():
    """The maxima equal a plain convolution of each width, the last bytes included."""
    net = L.Network(["a", "b"])
    x = np.random.default_rng(2).integers(97, 123, (3, L.WINDOW)).astype(np.uint8)
    top = np.max(list(net._places(x)), axis=0)
    for k, w in enumerate(L.WIDTHS):
        f = net.p["filters"][: w * L.EMBEDDING, k * L.FILTERS : (k + 1) * L.FILTERS]
        e = net.p["embedding"][np.hstack([x, np.zeros((3, w - 1), np.uint8)])]
        plain = np.max([e[:, t : t + w].reshape(3, -1) @ f for t in range(L.WINDOW)], axis=0)
        assert (plain <= top[:, k * L.FILTERS : (k + 1) * L.FILTERS] + 1e-4).all()
        assert np.allclose(plain, top[:, k * L.FILTERS : (k + 1) * L.FILTERS], atol=1e-4)


def test_held_out_accuracy_and_reruns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r["doc_id"]: r for r in L.query(spark, SF).collect()}
    truth = {r["doc_id"]: r["lang"] for r in docs.select("doc_id", "lang").collect()}
    assert set(rows) == set(truth)
    held = [i for i, r in rows.items() if r["held_out"]]
    assert np.mean([rows[i]["lang_pred"] == truth[i] for i in held]) > 0.98
    assert all(0 <= r["score"] <= 1 for r in rows.values())
    again = {r["doc_id"]: r for r in L.query(spark, SF).collect()}
    assert again == rows


def test_held_out_rows_teach_nothing(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    wrong = docs.withColumn("lang", F.when(is_held_out("doc_id"), F.lit("xx")).otherwise(F.col("lang")))
    assert L.sampled_windows(docs) == L.sampled_windows(wrong)


def test_letters():
    assert L.letters_of("½² Ⅷ 12_") == b"" and L.letters_of("½²x") != b"" and L.letters_of("日本") != b""
    assert L.letters_of("It's 2 Ünï--") == "it s ünï".encode()


def test_every_window_counts(spark):
    """A text's end weighs as much as its beginning."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    net = L.fit(docs)
    by = {r["lang"]: r["t"] for r in docs.groupBy("lang").agg(F.max_by("text", F.length("text")).alias("t")).collect()}
    short, long = by["en"][:2000], by["fr"][:8000]
    assert net.score([short + "\n" + long, long + "\n" + short])[0] == ["fr", "fr"]
    assert net.score([long[:500]] * 3 + [None])[0] == ["fr"] * 3 + ["und"]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(1, "der die das und nicht", "de"), (2, "the and of to in is", "en"), (3, None, "en"), (4, "", "de"), (5, "123 !!", "de"), (6, "ΩΨΔ", None), (None, "the and of", "en"), (7, "le la les des", None), (2, "the and of to in is", "en"), (8, "the of " * 40_000, "en"), (9, "und der " * 9, "de"), (11, "I", "en")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("mine")).withColumn("window", F.lit(1))


def test_odd_rows(spark, odd):
    got = L.predict(odd, L.fit(odd)).collect()
    assert len(got) == 12
    for r in got:
        nothing = r["text"] in (None, "", "123 !!")
        assert (r["lang_pred"] == "und") == nothing and (r["score"] == 0) == nothing
        assert r["window"] == 1


def test_nothing_or_one_language_learned(spark, odd):
    empty = L.fit(odd.limit(0))
    assert {tuple(r) for r in L.predict(odd, empty).select("lang_pred", "score").collect()} == {("und", 0.0)}
    one = L.predict(odd, L.fit(odd.filter("lang = 'en'")))
    assert {tuple(r) for r in one.select("lang_pred", "score").collect()} == {("en", 1.0), ("und", 0.0)}


def test_sample_is_bounded_per_language(spark, odd):
    many = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("der und die").alias("text"), F.when(F.col("id") < 3900, "de").otherwise("en").alias("lang"))
    rows = L.sampled_windows(many, per_language=50, sample=90)
    assert len(rows) <= 90 and {n for n, _ in rows} == {"de", "en"}
    assert max(sum(n == k for n, _ in rows) for k in ("de", "en")) <= 50
