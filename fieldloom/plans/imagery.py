"""Queries over images: every ten suppliers of `lineitem` make an image of 48 x 48 pixels with a score, a negative score and two truth masks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import geometry as geo
from ..operators import pixels, proposal, raster, select
from ..sources.readers import table
from .registry import _ROWS, _experiment_rows, _rings, _six, query

SIDE = 48
_T = ["target"]
_FIELD = f"""SELECT target, y, x, round(0.5::DOUBLE + 0.35::DOUBLE * sin(y / 6.0::DOUBLE) * cos(x / 7.0::DOUBLE) + d, 6) AS v, round(10 * t, 6) AS w, r AS pos, a AND NOT r AS neg
FROM (SELECT l_suppkey // 10 AS target, (l_partkey % {SIDE})::INT AS y, (l_orderkey % {SIDE})::INT AS x, avg(l_discount) AS d, avg(l_tax) AS t, bool_or(l_returnflag = 'R') AS r, bool_or(l_returnflag = 'A') AS a FROM lineitem GROUP BY 1, 2, 3)"""


def _field(spark: SparkSession, d: str) -> DataFrame:
    """target, y, x, v and w (scores), pos and neg (masks)."""
    cell = [(F.floor(F.col("l_suppkey") / 10)).alias("target"), (F.col("l_partkey") % SIDE).cast("int").alias("y"), (F.col("l_orderkey") % SIDE).cast("int").alias("x")]
    is_, flag = (lambda c: F.bool_or(F.col("l_returnflag") == c)), F.col
    px = table(spark, d, "lineitem").groupBy(*cell).agg(F.avg("l_discount").alias("d"), F.avg("l_tax").alias("t"), is_("R").alias("pos"), is_("A").alias("a"))
    wave = 0.5 + 0.35 * F.sin(F.col("y") / 6) * F.cos(F.col("x") / 7) + F.col("d")
    return px.select("target", "y", "x", F.round(wave, 6).alias("v"), F.round(10 * F.col("t"), 6).alias("w"), "pos", (flag("a") & ~flag("pos")).alias("neg"))


# --- colours ----------------------------------------------------------------------------------------------------------

_RGB = f"""SELECT l_suppkey // 10 AS target, (l_linenumber * 7 % {SIDE})::INT AS y, (l_orderkey % {SIDE})::INT AS x, (l_partkey * 37 % 256)::INT AS r, (l_orderkey * 11 % 256)::INT AS g, (l_suppkey * 53 % 256)::INT AS b FROM lineitem"""
_HSV = f"""SELECT *, CASE WHEN s0 = 0 THEN 0 ELSE floor((CASE WHEN h0 < 0 THEN h0 + 360 ELSE h0 END) / 2 + 0.5)::INT % 180 END AS h, CASE WHEN vv = 0 THEN 0 ELSE floor(255.0::DOUBLE * s0 / vv + 0.5)::INT END AS s
FROM (SELECT *, CASE WHEN vv = r THEN 60.0::DOUBLE * (g - b) / nullif(s0, 0) WHEN vv = g THEN 120 + 60.0::DOUBLE * (b - r) / nullif(s0, 0) ELSE 240 + 60.0::DOUBLE * (r - g) / nullif(s0, 0) END AS h0
FROM (SELECT *, greatest(r, g, b) AS vv, (greatest(r, g, b) - least(r, g, b))::DOUBLE AS s0 FROM ({_RGB})))"""


def _rgb(spark, d):
    mod = lambda c, k: (F.col(c) * k % 256).cast("int")
    return table(spark, d, "lineitem").select(
        F.floor(F.col("l_suppkey") / 10).alias("target"), (F.col("l_linenumber") * 7 % SIDE).cast("int").alias("y"), (F.col("l_orderkey") % SIDE).cast("int").alias("x"),
        mod("l_partkey", 37).alias("r"), mod("l_orderkey", 11).alias("g"), mod("l_suppkey", 53).alias("b"),
    )


_EDGE = f"(y < 2 OR y >= {SIDE - 2} OR x < 2 OR x >= {SIDE - 2})"


_STATS = f"""SELECT target, round(avg((s > 40 AND vv > 40)::INT), 9) AS sat_fraction, count_if(h BETWEEN 20 AND 38 AND s > 90 AND vv > 120) AS yellow_px, count_if((h <= 8 OR h >= 170) AND s > 110 AND vv > 90) AS red_px,
coalesce(avg((vv > 235 AND s < 20)::INT) FILTER ({_EDGE}) > 0.15, false) OR avg((vv > 235 AND s < 20)::INT) > 0.10 AS has_white_margin, coalesce(avg((vv > 235 AND s < 20)::INT) FILTER (x < 7) > 0.45, false) AS has_left_info_panel FROM ({_HSV}) GROUP BY target"""


@query(_STATS)
def color_stats(spark, d):
    out = pixels.colour_stats(_rgb(spark, d), _T, F.col("r"), F.col("g"), F.col("b"), SIDE, SIDE)
    return out.withColumn("sat_fraction", F.round("sat_fraction", 9))


@query(f"""SELECT target, CASE WHEN ink > 300 OR panel THEN 'annotated' ELSE 'original' END AS role, CASE WHEN panel AND mp < 6 THEN 'map_layout' WHEN ink > 300 OR panel THEN 'example_crop' ELSE 'orthophoto' END AS subtype
FROM (SELECT target, (yellow_px + red_px) AS ink, has_left_info_panel AS panel, {SIDE * SIDE / 1e6!r}::DOUBLE AS mp FROM ({_STATS}))""")
def image_roles(spark, d):
    """Roles and kinds of images from what their pixels show."""
    from ..operators import catalog

    stats = color_stats(spark, d)
    ink = F.col("yellow_px") + F.col("red_px")
    role, subtype = catalog.classify(ink, F.col("has_left_info_panel"), F.lit(SIDE * SIDE / 1e6))
    return stats.select("target", role.alias("role"), subtype.alias("subtype"))


@query(f"""SELECT target, count_if(yellow) AS yellow, count_if(red) AS red, count_if(black) AS black FROM (SELECT target, r > b + 35 AND g > b + 35 AND abs(r - g) < 70 AND h BETWEEN 18 AND 42 AS yellow, r > g + 28 AND r > b + 28 AS red, vv < 45 AND s < 70 AS black
FROM ({_HSV}) WHERE NOT (target % 2 = 0 AND x < 8)) GROUP BY target""")
def ink_counts(spark, d):
    """Ink pixels an image, without the left panel of map layouts (every second image)."""
    from ..operators.catalog import ink_masks

    px = _rgb(spark, d).filter(pixels.outside_panel(F.col("x"), SIDE, F.col("target") % 2 == 0))
    h, s, _ = pixels.hsv(F.col("r"), F.col("g"), F.col("b"))
    return px.groupBy("target").agg(*[F.count_if(c).alias(n) for n, c in ink_masks(F.col("r"), F.col("g"), F.col("b"), h, s).items()])


# --- masks and tiles --------------------------------------------------------------------------------------------------


@query(f"SELECT target, y, x, CASE WHEN pos THEN 'cultivated_area' WHEN neg THEN 'hard_negative' ELSE 'none' END AS klass FROM ({_FIELD})")
def class_paint(spark, d):
    klass = F.when(F.col("pos"), "cultivated_area").when(F.col("neg"), "hard_negative").otherwise("none")
    return _field(spark, d).select("target", "y", "x", klass.alias("klass"))


_TILES = f"(SELECT target, ty, tx FROM (SELECT DISTINCT l_suppkey // 10 AS target FROM lineitem), (SELECT unnest([0, 8, 16, 24, 32]) AS ty), (SELECT unnest([0, 8, 16, 24, 32]) AS tx))"


def _tiles(spark, d):
    at = F.array(*[F.lit(v) for v in (0, 8, 16, 24, 32)])
    targets = table(spark, d, "lineitem").select(F.floor(F.col("l_suppkey") / 10).alias("target")).distinct()
    return targets.withColumn("ty", F.explode(at)).withColumn("tx", F.explode(at))


@query(f"SELECT t.target, ty::INT AS ty, tx::INT AS tx, CASE WHEN pos THEN 1 WHEN neg THEN 0 ELSE -1 END AS label FROM {_TILES} t LEFT JOIN ({_FIELD}) f ON t.target = f.target AND y = least(ty + 8, 47) AND x = least(tx + 8, 47)")
def tile_label_center(spark, d):
    return pixels.centre_labels(_tiles(spark, d), _field(spark, d), _T, 16, SIDE, SIDE)


@query(f"""SELECT t.target, ty::INT AS ty, tx::INT AS tx, CASE WHEN count_if(pos) / 256.0 > 0.5 THEN 1 WHEN count_if(neg) / 256.0 > 0.5 THEN 0 ELSE -1 END AS label
FROM {_TILES} t JOIN ({_FIELD}) f ON t.target = f.target AND y BETWEEN ty AND ty + 15 AND x BETWEEN tx AND tx + 15 GROUP BY ALL""")
def tile_label_majority(spark, d):
    return pixels.majority_labels(_field(spark, d), _T, 16, 8, SIDE, SIDE)


@query(f"SELECT target, y, x, v FROM ({_FIELD}) JOIN (SELECT target, round(avg(v) + stddev_pop(v), 9) AS t FROM ({_FIELD}) GROUP BY target) USING (target) WHERE v >= t")
def sigma_mask(spark, d):
    return pixels.above_sigma(_field(spark, d), _T, "v", 1.0).select("target", "y", "x", "v")


@query(f"""SELECT target, level, count(*) AS n FROM ({_FIELD}) JOIN (SELECT target, unnest([60, 70, 80, 90]) AS level, round(unnest(quantile_cont(v, [0.6, 0.7, 0.8, 0.9])), 9) AS t FROM ({_FIELD}) GROUP BY target) USING (target) WHERE v >= t GROUP BY ALL""")
def percentile_masks(spark, d):
    return pixels.above_percentiles(_field(spark, d), _T, "v", [60, 70, 80, 90]).groupBy("target", "level").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT target, y, x FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY v DESC, y, x) AS rn FROM ({_FIELD})) WHERE rn = 1")
def peak_pixel(spark, d):
    return pixels.peak(_field(spark, d), _T, "v")


@query(f"""WITH t AS (SELECT target, ty, tx, (target * 7 + ty * 3 + tx) % 11 / 10.0::DOUBLE AS s FROM {_TILES})
SELECT target, (ty + dy)::INT AS y, (tx + dx)::INT AS x, round(avg(s), 6) AS v FROM t, range(0, 16) a(dy), range(0, 16) b(dx) GROUP BY ALL""")
def flat_overlap_mean(spark, d):
    tiled = _tiles(spark, d).withColumn("s", (F.col("target") * 7 + F.col("ty") * 3 + F.col("tx")) % 11 / 10.0)
    return _six(pixels.flat_overlap(tiled, _T, "s", 16), "v")


_BOXES = f"SELECT l_suppkey AS target, l_quantity / 2 - 5.5::DOUBLE AS x0, l_linenumber * 4.5::DOUBLE AS y0, l_quantity / 2 + 1 AS x1, l_linenumber * 4.5::DOUBLE + 3 AS y1 FROM lineitem"


@query(f"""WITH b AS (SELECT DISTINCT target, greatest(0, round_even(x0, 0))::INT AS x0, greatest(0, round_even(y0, 0))::INT AS y0, least(24, round_even(x1, 0))::INT AS x1, least(24, round_even(y1, 0))::INT AS y1 FROM ({_BOXES}))
SELECT DISTINCT target, y::INT AS y, x::INT AS x FROM b, range(0, 24) r(y), range(0, 24) c(x) WHERE y >= y0 AND y < y1 AND x >= x0 AND x < x1""")
def boxes_mask(spark, d):
    q, n = F.col("l_quantity") / 2, F.col("l_linenumber") * 4.5
    boxes = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("target"), (q - 5.5).alias("x0"), n.alias("y0"), (q + 1).alias("x1"), (n + 3).alias("y1"))
    return pixels.box_pixels(boxes, _T, ["x0", "y0", "x1", "y1"], 24, 24)


@query(f"""SELECT target, klass, count(*) AS area, avg(v)::DECIMAL(18, 6)::DOUBLE AS confidence, floor(avg(y))::INT AS cy, floor(avg(x))::INT AS cx, min(x) AS x0, min(y) AS y0, max(x) + 1 AS x1, max(y) + 1 AS y1
FROM (SELECT *, pos::INT AS klass FROM ({_FIELD})) GROUP BY target, klass""".replace("avg(v)::DECIMAL(18, 6)::DOUBLE", "round(avg(v), 6)"))
def mask_boxes(spark, d):
    """Area, mean score, whole centroid and box of the truth mask and of the rest."""
    out = pixels.regions(_field(spark, d).withColumn("klass", F.col("pos").cast("int")), ["target", "klass"], "v")
    return _six(out, "confidence").withColumns({"cy": F.floor("cy").cast("int"), "cx": F.floor("cx").cast("int")})


@query(f"""SELECT target, y, x FROM (SELECT target, y, x, v >= 0.5 AS b, w >= 0.6 AS p FROM ({_FIELD})) JOIN (SELECT target, count_if(w >= 0.6) > 0.1 * count_if(v >= 0.5) AS two FROM ({_FIELD}) GROUP BY target) USING (target) WHERE b AND (p OR NOT two)""")
def box_or_points(spark, d):
    return pixels.box_or_points(_field(spark, d), _T, F.col("v") >= 0.5, F.col("w") >= 0.6).select("target", "y", "x")


@query(f"""SELECT target, round_even(tp / (u + 1e-6), 4) AS iou, round_even(tp / (g + 1e-6), 4) AS coverage, CASE WHEN k > 0 THEN round_even(fk / (k + 1e-6), 4) END AS fp_on_black, round_even(p / n, 4) AS pred_area_frac, fk / greatest(k, 1) AS leak
FROM (SELECT target, count_if(q AND pos)::DOUBLE AS tp, count_if(q OR pos)::DOUBLE AS u, count_if(pos)::DOUBLE AS g, count_if(neg)::DOUBLE AS k, count_if(q AND neg)::DOUBLE AS fk, count_if(q)::DOUBLE AS p, count(*)::DOUBLE AS n FROM (SELECT *, v >= 0.5 AS q FROM ({_FIELD})) GROUP BY target)""")
def simple_scores(spark, d):
    return pixels.simple_scores(_field(spark, d), _T, F.col("v") >= 0.5, F.col("pos"), F.col("neg"))


@query(f"SELECT target, (corr(v, w) > 0) AS inverted, round(max(CASE WHEN turned THEN -v ELSE v END), 6) AS top FROM (SELECT *, corr(v, w) OVER (PARTITION BY target) > 0 AS turned FROM ({_FIELD})) GROUP BY target")
def correlation_sign(spark, d):
    """Whether a map is turned, so that it runs against another, and its highest value then."""
    px = _field(spark, d)
    turned = px.groupBy("target").agg((F.corr("v", "w") > 0).alias("inverted"))
    return px.join(turned, "target").groupBy("target", "inverted").agg(F.round(F.max(F.when(F.col("inverted"), -F.col("v")).otherwise(F.col("v"))), 6).alias("top"))


@query(f"SELECT target, y, x, round((v + w) / 2, 7) + 0.0 AS mean_v, greatest(v, w) AS max_v FROM ({_FIELD})")
def ensemble_maps(spark, d):
    """The mean of an image's maps (scales) and their largest value (prompts)."""
    return _field(spark, d).select("target", "y", "x", (F.round((F.col("v") + F.col("w")) / 2, 7) + 0.0).alias("mean_v"), F.greatest("v", "w").alias("max_v"))


# --- joins and tables -------------------------------------------------------------------------------------------------

# Classes of annotation colours.
CLASS_OF_COLOR = {"yellow": "cultivated_area", "red": "cultivated_area", "black": "hard_negative"}


@query("SELECT s_suppkey, coalesce(pred, 0) AS pred FROM supplier LEFT JOIN (SELECT l_suppkey, count(*) AS pred FROM lineitem WHERE l_discount > 0.09 AND l_tax > 0.07 GROUP BY 1) ON s_suppkey = l_suppkey")
def load_or_zero(spark, d):
    """Targets with their predictions, 0 where there is none."""
    pred = table(spark, d, "lineitem").filter("l_discount > 0.09 AND l_tax > 0.07").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.count(F.lit(1)).alias("pred"))
    return table(spark, d, "supplier").select("s_suppkey").join(pred, "s_suppkey", "left").select("s_suppkey", F.coalesce("pred", F.lit(0)).alias("pred"))


@query("SELECT l_orderkey, l_linenumber, CASE l_returnflag WHEN 'A' THEN 'cultivated_area' WHEN 'R' THEN 'cultivated_area' ELSE 'hard_negative' END AS klass FROM lineitem")
def color_class(spark, d):
    color = F.when(F.col("l_returnflag") == "A", "yellow").when(F.col("l_returnflag") == "R", "red").otherwise("black")
    words = F.create_map(*[F.lit(v) for kv in CLASS_OF_COLOR.items() for v in kv])
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.get(F.array(words), F.lit(0))[color].alias("klass"))


@query("SELECT s_suppkey, n_name AS model, length(n_name) AS vram FROM supplier LEFT JOIN (SELECT * FROM nation WHERE n_regionkey < 3) ON s_nationkey = n_nationkey")
def model_lookup(spark, d):
    """Rows with what a small table tells of their model; null where it lacks it."""
    known = table(spark, d, "nation").filter("n_regionkey < 3").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("model"), F.length("n_name").cast("long").alias("vram"))
    return table(spark, d, "supplier").join(known, "s_nationkey", "left").select("s_suppkey", "model", "vram")


@query("SELECT o_orderkey, c_custkey, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey")
def summary_manifest(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    return table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey")).join(c, "c_custkey").select("o_orderkey", "c_custkey", "c_mktsegment")


@query("""WITH l AS (SELECT l_suppkey, l_partkey, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_partkey, l_orderkey, l_linenumber)::INT AS i FROM lineitem WHERE l_returnflag = 'R'),
t AS (SELECT l_suppkey, l_orderkey AS label, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey)::INT AS i FROM lineitem WHERE l_returnflag = 'A') SELECT l_suppkey, i, l_partkey, label FROM l JOIN t USING (l_suppkey, i)""")
def zip_lines(spark, d):
    """The i-th line with the i-th label of a sheet, as far as both go."""
    from pyspark.sql import Window

    rows = table(spark, d, "lineitem")
    nth = lambda f, *order: rows.filter(F.col("l_returnflag") == f).withColumn("i", F.row_number().over(Window.partitionBy("l_suppkey").orderBy(*order)))
    labels = nth("A", "l_orderkey", "l_linenumber", "l_partkey").select("l_suppkey", "i", F.col("l_orderkey").alias("label"))
    return nth("R", "l_partkey", "l_orderkey", "l_linenumber").select("l_suppkey", "i", "l_partkey").join(labels, ["l_suppkey", "i"])


@query(f"SELECT prompt, threshold, count(*) AS targets, sum(CASE WHEN prompt = 'v' THEN nv ELSE nw END)::BIGINT AS kept FROM (SELECT prompt, t / 10.0::DOUBLE AS threshold, target, count_if(v >= t / 10.0::DOUBLE) AS nv, count_if(w >= t / 10.0::DOUBLE) AS nw FROM ({_FIELD}), (SELECT unnest(['v', 'w']) AS prompt), (SELECT unnest([2, 4, 6, 8]) AS t) GROUP BY ALL) GROUP BY prompt, threshold")
def experiment_grid(spark, d):
    """Every target x prompt x threshold from one pass over the scores: the grid is a literal array, not a join."""
    cells = F.array(*[F.struct(F.lit(p).alias("prompt"), F.lit(t / 10).alias("threshold"), F.count_if(F.col(p) >= F.lit(t / 10)).alias("n")) for p in "vw" for t in (2, 4, 6, 8)])
    grid = _field(spark, d).groupBy("target").agg(cells.alias("z")).select("target", F.explode("z").alias("z")).select("target", "z.*")
    return grid.groupBy("prompt", "threshold").agg(F.count(F.lit(1)).alias("targets"), F.sum("n").alias("kept"))


@query(f"""SELECT 'best' AS kind, target::VARCHAR AS name, coalesce(cov, 0) AS a, iou AS b FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY coalesce(cov, 0) DESC, config) AS rn FROM ({_ROWS}) WHERE config <> 'NO') WHERE rn = 1
UNION ALL SELECT 'mean', config, round(avg(cov), 4), round(avg(iou), 4) FROM ({_ROWS}) GROUP BY config
UNION ALL SELECT 'split', CASE WHEN config LIKE 'N%' THEN 'negative' ELSE 'positive' END, round(avg(cov), 4), round(avg(iou), 4) FROM ({_ROWS}) GROUP BY 2""")
def experiment_summaries(spark, d):
    """The best positive prompt of each target by coverage, the means of each variant, and those of positive and negative prompts."""
    rows = _experiment_rows(spark, d)
    best = select.first_by(rows.filter("config <> 'NO'").withColumn("cov", F.coalesce("cov", F.lit(0.0))), ["target"], F.desc("cov"), F.col("config"))
    means = lambda kind, key: rows.groupBy(key.alias("name")).agg(F.round(F.avg("cov"), 4).alias("a"), F.round(F.avg("iou"), 4).alias("b")).select(F.lit(kind).alias("kind"), "name", "a", "b")
    side = F.when(F.col("config").startswith("N"), "negative").otherwise("positive")
    one = best.select(F.lit("best").alias("kind"), F.col("target").cast("string").alias("name"), F.col("cov").alias("a"), F.col("iou").alias("b"))
    return one.unionByName(means("mean", F.col("config"))).unionByName(means("split", side))


@query("SELECT o_orderkey, CASE WHEN year(o_orderdate) < 1994 THEN 'year implausible' ELSE '' END || CASE WHEN year(o_orderdate) < 1994 AND o_orderstatus = 'P' THEN ';' ELSE '' END || CASE WHEN o_orderstatus = 'P' THEN 'partial' ELSE '' END AS notes FROM orders")
def plausible_notes(spark, d):
    """Notes on a record: those that hold, in order."""
    notes = F.array(F.when(F.year("o_orderdate") < 1994, "year implausible"), F.when(F.col("o_orderstatus") == "P", "partial"))
    return table(spark, d, "orders").select("o_orderkey", F.concat_ws(";", F.filter(notes, lambda n: n.isNotNull())).alias("notes"))


@query("SELECT doc_id, array_to_string(list_slice(string_split(text, ' '), 1, 12), '|') AS labels FROM documents WHERE text IS NOT NULL")
def first_labels(spark, d):
    docs = table(spark, d, "documents").filter("text IS NOT NULL")
    return docs.select("doc_id", F.array_join(F.slice(F.split("text", " "), 1, 12), "|").alias("labels"))


@query("SELECT page_id, url FROM pages WHERE contains(url, '?') OR length(html) > 3000 ORDER BY url, page_id")
def annotated_by_name(spark, d):
    """Images of one role, by name."""
    return table(spark, d, "pages").filter(F.contains("url", F.lit("?")) | (F.length("html") > 3000)).select("page_id", "url").orderBy("url", "page_id")


# --- polygons ---------------------------------------------------------------------------------------------------------


@query("""SELECT p_partkey, area >= 200 AS not_small, area / greatest(p_size, 1) >= 1.6 AS is_ring, touches, round(4 * pi() * area / (per * per + 1e-6), 6) + 0.0 AS compactness, CASE WHEN p_brand LIKE 'Brand#1%' THEN 'hard_negative' ELSE 'cultivated_area' END AS klass FROM (SELECT *, 1.5::DOUBLE * p_size * p_size AS area,
5::DOUBLE * p_size + 2 * sqrt(p_size * p_size / 4.0::DOUBLE + p_size * p_size) AS per, (p_partkey % 9 <= 2 OR p_partkey % 9 + 2 * p_size >= 98) AS touches FROM part) WHERE area >= 3e-4 * 100 * 100""")
def polygon_filters(spark, d):
    """Polygons of at least the least area and three vertices, with the tests that sort them: small, ring-like, at the frame, class."""
    ring = F.col("ring")
    area = geo.ring_area(ring)
    some = _rings(spark, d).filter((area >= 3e-4 * 100 * 100) & (F.size(ring) >= 3))
    ink = F.greatest(F.get(ring, F.lit(1))["x"], F.lit(1.0))
    off = (F.col("p_partkey") % 9).cast("double")
    placed = F.transform(ring, lambda p: F.struct((p["x"] + off).alias("x"), (p["y"] + off).alias("y")))
    klass = F.when(F.col("p_brand").startswith("Brand#1"), "hard_negative").otherwise("cultivated_area")
    return _six(some.select(
        "p_partkey", (area >= 200).alias("not_small"), (area / ink >= 1.6).alias("is_ring"), geo.touches_frame(placed, F.lit(100), F.lit(100)).alias("touches"),
        geo.compactness(area, geo.ring_perimeter(ring)).alias("compactness"), klass.alias("klass"),
    ), "compactness")


@query("""SELECT p_brand, count(*) AS n, '{"brand":"' || p_brand || '","n_polygons":' || count(*) || ',"cultivated":' || count_if(p_size % 2 = 0) || CASE WHEN max(p_size) > 48 THEN ',"largest":' || max(p_size) ELSE '' END || '}' AS json FROM part GROUP BY p_brand""")
def dataset_summary(spark, d):
    """A nested summary an image as JSON; keys whose condition fails are left out."""
    body = F.struct(F.col("p_brand").alias("brand"), F.col("n").alias("n_polygons"), "cultivated", F.when(F.col("top") > 48, F.col("top")).alias("largest"))
    counted = table(spark, d, "part").groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("p_size") % 2 == 0).alias("cultivated"), F.max("p_size").alias("top"))
    return counted.select("p_brand", "n", F.to_json(body).alias("json"))


@query("""SELECT p_partkey, '{"id":' || p_partkey || ',"class":"' || CASE WHEN p_size % 2 = 0 THEN 'cultivated_area' ELSE 'hard_negative' END || '","points":[[0,0],[' || p_size || ',0],[' || p_size || ',' || 2 * p_size || ']]}' AS json FROM part""")
def polygon_json(spark, d):
    """A polygon's record as JSON, its class under the key `class`."""
    s = F.col("p_size").cast("int")
    points = F.array(F.array(F.lit(0), F.lit(0)), F.array(s, F.lit(0)), F.array(s, 2 * s))
    klass = F.when(s % 2 == 0, "cultivated_area").otherwise("hard_negative")
    return table(spark, d, "part").select("p_partkey", F.to_json(F.struct(F.col("p_partkey").alias("id"), klass.alias("class"), points.alias("points"))).alias("json"))


# --- kernels on whole images ------------------------------------------------------------------------------------------


def _kernel(name: str, schema: str, kernel, value: str = "v") -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return raster.by_image(_field(spark, d), _T, value, SIDE, SIDE, kernel, schema)

    run.__name__ = name
    query()(run)


_PIXEL = "y int, x int, v double"
_rows = raster.as_pixels
_kernel("raster_watershed", _PIXEL, _rows(lambda a: proposal.grown(raster.gaussian(a, 2), 5).astype(float)))
_kernel("mask_polygons", "polygon int, points array<array<int>>", lambda a: [(i, [list(p) for p in r]) for i, r in enumerate(raster.polygons(raster.clean(a > 0.5, 9), 9))])


@query()
def polygon_masks(spark, d):
    """The pixels that the polygons of an image's mask paint."""

    def kernel(a: np.ndarray) -> list[tuple]:
        y, x = np.nonzero(raster.painted(raster.polygons(raster.clean(a > 0.5, 9), 9), SIDE, SIDE))
        return list(zip(y.tolist(), x.tolist(), strict=True))

    return raster.by_image(_field(spark, d), _T, "v", SIDE, SIDE, kernel, "y int, x int")
