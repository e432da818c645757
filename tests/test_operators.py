import math

import pytest
from pyspark.sql import functions as F

from fieldloom.functions import geometry as geo, text as txt
from fieldloom.operators import fusion, georef, metrics, select
from fieldloom.sources import readers, sinks
from fieldloom.streaming import recorder


def test_names(spark):
    df = spark.createDataFrame([("a_31021969_x.tif",), ("b1980 1969.jpg",), ("c 123456789.png",), ("שדה (1).tif",), (None,), ("scan120345.jpg",), ("x_99999999_01021980",), ("d05031899_1969",)], "n string")
    date, years = txt.photo_date(F.col("n")), txt.years_in_name(F.col("n"))
    rows = df.select(date.alias("d"), txt.derived_year(date, years).alias("y"), txt.safe_stem(F.col("n")).alias("s")).collect()
    assert [r.d for r in rows] == ["1969-02-31", None, None, None, None, None, None, "1899-03-05"]
    assert [r.y for r in rows] == [1969, 1969, None, None, None, None, None, 1899]
    assert rows[3].s == "שדה__1_.tif"


def test_mask_scores_of_nothing(spark):
    df = spark.createDataFrame([(1, False, False, False)], "t int, p boolean, g boolean, k boolean")
    r = metrics.mask_scores(df, ["t"], F.col("p"), F.col("g"), F.col("k")).first()
    assert r.mask_iou == 0.0 and r.coverage is None and r.precision_pos is None and r.fp_on_black is None


def test_auroc_is_antisymmetric(spark):
    df = spark.range(200).select(F.lit(1).alias("t"), (F.col("id") * 7 % 13).alias("s"), (F.col("id") % 3 == 0).alias("y"))
    a = metrics.auroc(df, ["t"], F.col("s"), F.col("y")).first().auroc
    b = metrics.auroc(df, ["t"], -F.col("s"), F.col("y")).first().auroc
    assert math.isclose(a + b, 1)
    assert metrics.auroc(df.filter("y"), ["t"], F.col("s"), F.col("y")).first().auroc is None


def test_affine_recovers_a_transform(spark):
    df = spark.range(40).select(F.lit(1).alias("k"), (F.col("id") % 7).cast("double").alias("px"), (F.col("id") % 5).cast("double").alias("py"))
    df = df.withColumn("wx", 3 + 2 * F.col("px") - F.col("py")).withColumn("wy", 9 - F.col("px") - 4 * F.col("py"))
    fit = georef.fit_affine(df, ["k"], "px", "py", "wx", "wy")
    assert all(math.isclose(a, b, abs_tol=1e-9) for a, b in zip(fit.first().gt, [3, 2, -1, 9, -1, -4], strict=True))
    assert georef.residuals(df, fit, ["k"], "px", "py", "wx", "wy").first().rmse < 1e-9


def test_boxes_and_rings(spark):
    box = lambda *v: [F.lit(float(x)) for x in v]
    r = spark.range(1).select(geo.box_iou(box(0, 0, 2, 2), box(1, 1, 3, 3)).alias("a"), geo.box_iou(box(0, 0, 0, 0), box(0, 0, 0, 0)).alias("z")).first()
    assert math.isclose(r.a, 1 / 7) and r.z == 0.0


def test_gate_of_one_map(spark):
    assert spark.range(1).select(fusion.fuse("gate", [F.lit(0.5)]).alias("v")).first().v == 0.5


def test_unknown_rule():
    with pytest.raises(ValueError):
        fusion.fuse("median", [])


def test_selection(spark):
    df = spark.createDataFrame([(1, 0.0), (1, 5.0), (1, 20.0), (1, 24.0)], "k int, v double")
    got = sorted((r["first"], r["last"], r.n, r.middle) for r in select.islands(df, ["k"], "v", 8).collect())
    assert got == [(0.0, 5.0, 2, 2.0), (20.0, 24.0, 2, 22.0)]
    old, new = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    assert sorted(map(tuple, select.latest(old, new, ["k"]).collect())) == [(1, "a"), (2, "c"), (3, "d")]
    pts = spark.createDataFrame([(1, 0.0, 0.0, 9.0), (1, 0.0, 1.0, 8.0), (1, 0.0, 5.0, 7.0)], "k int, y double, x double, s double")
    assert [r.x for r in select.spaced_points(pts, ["k"], "y", "x", "s", 2, 3.0).orderBy("pick").collect()] == [0.0, 5.0]


def test_sources_sinks_and_stream(spark, tmp_path):
    assert readers.or_empty(spark, f"file://{tmp_path}/none", "a int").count() == 0
    df = spark.createDataFrame([(1, "x"), (1, "x"), (2, None)], "k int, v string").withColumn("t", F.to_timestamp(F.lit("2024-01-01")))
    sinks.write_json_lines(df.drop("t"), f"{tmp_path}/j")
    assert spark.read.json(f"{tmp_path}/j").count() == 3
    assert [r.value for r in sinks.markdown_rows(df.drop("t").limit(1)).collect()] == ["| 1 | x |"]
    sinks.record(df, f"{tmp_path}/in")
    rows = recorder.once(recorder.arriving(spark, f"{tmp_path}/in", df.schema), ["k"], "t")
    recorder.record(rows, f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 2


def test_image_files(spark, tmp_path):
    for n in ("b.PNG", "a.tif", "c.txt"):
        (tmp_path / n).write_bytes(b"x")
    assert [r.filename for r in readers.image_files(spark, str(tmp_path)).orderBy("filename").collect()] == ["a.tif", "b.PNG"]


def test_best_iou_compares_each_distinct_box_once(spark):
    pred = [(n, float(x * 30), float(x * 20)) for n in (1, 2, 3) for x in range(5)] * 40
    truth = [(n, float(x), float(y)) for n, some in ((1, [(5, 5), (100, 70)]), (2, [(400, 400)])) for x, y in some] * 40
    p, g = spark.createDataFrame(pred, "n int, p0 double, p1 double"), spark.createDataFrame(truth, "n int, g0 double, g1 double")
    best = geo.best_iou(p, g, ["n"], ["p0", "p1"], ["g0", "g1"], 40, 30)
    rows = best.collect()
    got = {(r["n"], r["p0"], r["p1"]): r["iou"] for r in rows}

    def iou(a, b):
        i = max(0, 40 - abs(a[0] - b[0])) * max(0, 30 - abs(a[1] - b[1]))
        return i / (2400 - i)

    assert len(rows) == len(got) and got == {b: max(iou(b[1:], t[1:]) for t in truth if t[0] == b[0]) for b in pred if b[0] < 3}


def test_control_points_are_dealt(spark):
    v = spark.createDataFrame([(k % 2, k, None if k == 3 else k / 2) for k in range(7)], "sheet int, px int, wx double")
    h = spark.createDataFrame([(k % 3, k) for k in range(40)] + [(0, 0)], "sheet int, py int")
    one, many = (georef.control_points(v, h, ["sheet"], n) for n in (1, 5))
    plan = many._jdf.queryExecution().executedPlan().toString()
    assert many.columns == one.columns and "Broadcast" not in plan and "__part" in plan
    assert sorted(map(str, many.collect())) == sorted(map(str, one.collect()))
