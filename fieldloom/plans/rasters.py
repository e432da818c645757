"""Queries over dense images as relations: windows over tiles, morphology and components on runs, packed masks, grid lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import numeric as num
from ..operators import bitmaps, components, fusion, georef, morphology, proposal, shapes, stencils, textures
from ..operators.select import first_by
from ..sources.scratch import cut
from .imagery import _FIELD, _T, SIDE, _field
from .registry import _DIM, _DOT, ORACLE_SQL, QUERIES, _six, query

_LEAST = 0.004 * SIDE * SIDE

# --- the images, dense ------------------------------------------------------------------------------------------------

_BASE = f"""f AS MATERIALIZED ({_FIELD}), i AS MATERIALIZED (SELECT DISTINCT target AS t FROM f),
d AS MATERIALIZED (SELECT t, g.y::INT AS y, g.x::INT AS x, coalesce(v, 0) AS v, coalesce(w, 0) AS w, coalesce(pos, false) AS pos, coalesce(neg, false) AS neg
FROM (SELECT t, y, x FROM i, range(0, {SIDE}) a(y), range(0, {SIDE}) b(x)) g LEFT JOIN f ON f.target = g.t AND f.y = g.y AND f.x = g.x)"""


def _with(*ctes: str) -> str:
    return "WITH RECURSIVE " + ",\n".join([_BASE, *ctes]) + "\n"


def _dense(spark: SparkSession, d: str, *values: str) -> DataFrame:
    """target, y, x and values of every pixel; 0 (or false) where the table has none."""
    px = _field(spark, d)
    absent = {"v": 0.0, "w": 0.0, "pos": False, "neg": False}
    return cut(stencils.dense(px, px, _T, {c: absent[c] for c in values}, SIDE, SIDE), "dense")


def _mask(px: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The runs of the pixels over 0.5, and the images."""
    return components.runs(px.filter("v > 0.5"), _T), px.select("target").distinct()


def _painted(px: DataFrame, runs: DataFrame) -> DataFrame:
    """target, y, x, v: 1 in the runs, else 0."""
    inside = components.pixels_of(runs, *_T).withColumn("__in", F.lit(1.0))
    return px.select("target", "y", "x").join(inside, ["target", "y", "x"], "left").select("target", "y", "x", F.coalesce("__in", F.lit(0.0)).alias("v"))


# --- SQL of the parts -------------------------------------------------------------------------------------------------


def _at(p: str, border: str = "reflect") -> str:
    """A coordinate inside the image for one that may be beyond it."""
    if border == "nearest":
        return f"greatest(0, least({SIDE - 1}, {p}))"
    low, high = ("-1 - ({p})", f"{2 * SIDE - 1} - ({{p}})") if border == "reflect" else ("-({p})", f"{2 * SIDE - 2} - ({{p}})")
    return f"CASE WHEN {p} < 0 THEN {low.format(p=p)} WHEN {p} >= {SIDE} THEN {high.format(p=p)} ELSE {p} END"


def _separable_sql(name: str, src: str, along_y: list[float], along_x: list[float], border: str = "reflect") -> str:
    """CTEs: name(t, y, x, v) is src weighted along x, then along y."""
    kernel = lambda k: ", ".join(f"({i - len(k) // 2}, {w!r}::DOUBLE)" for i, w in enumerate(k))
    return f"""{name}_kx(k, c) AS (VALUES {kernel(along_x)}), {name}_ky(k, c) AS (VALUES {kernel(along_y)}),
{name}_x AS MATERIALIZED (SELECT g.t, g.y, g.x, sum(c * s.v) AS v FROM {src} g CROSS JOIN {name}_kx JOIN {src} s ON s.t = g.t AND s.y = g.y AND s.x = {_at('g.x + k', border)} GROUP BY ALL),
{name} AS MATERIALIZED (SELECT g.t, g.y, g.x, sum(c * s.v) AS v FROM {name}_x g CROSS JOIN {name}_ky JOIN {name}_x s ON s.t = g.t AND s.x = g.x AND s.y = {_at('g.y + k', border)} GROUP BY ALL)"""


def _gaussian_sql(name: str, src: str, sigma: float) -> str:
    k = stencils.gaussian_kernel(sigma)
    return _separable_sql(name, src, k, k)


def _norm_sql(name: str, src: str) -> str:
    return f"""{name} AS MATERIALIZED (SELECT t, y, x, greatest(0, least(1, (v - lo) / (hi - lo + 1e-6))) AS v FROM {src} JOIN (SELECT t, quantile_cont(v, 0.01) AS lo, quantile_cont(v, 0.99) AS hi FROM {src} GROUP BY t) USING (t))"""


def _runs_sql(name: str, src: str) -> str:
    """CTE: name(t, y, x0, x1) of the distinct pixels (t, y, x) of src."""
    return f"{name} AS MATERIALIZED (SELECT t, y, min(x) AS x0, max(x) AS x1 FROM (SELECT t, y, x, x - row_number() OVER (PARTITION BY t, y ORDER BY x) AS island FROM (SELECT DISTINCT t, y, x FROM {src})) GROUP BY t, y, island)"


def _components_sql(name: str, runs: str, reach: int = 1) -> str:
    """CTEs: name(t, y, x0, x1, region) of runs, joined at corners too (reach 1) or at sides only (0)."""
    return f"""{name}_n AS MATERIALIZED (SELECT t, y, x0, x1, y::BIGINT * 4294967296 + x0 AS id FROM {runs}),
{name}_e AS MATERIALIZED (SELECT a.t, a.id AS a, b.id AS b FROM {name}_n a JOIN {name}_n b ON a.t = b.t AND abs(a.y - b.y) = 1 AND a.x0 <= b.x1 + {reach} AND b.x0 <= a.x1 + {reach}),
{name}_w(t, id, low) AS (SELECT t, id, id FROM {name}_n UNION SELECT e.t, e.b, w.low FROM {name}_w w JOIN {name}_e e ON w.t = e.t AND w.id = e.a AND w.low < e.b),
{name} AS MATERIALIZED (SELECT n.t, n.y, n.x0, n.x1, min(low) AS region FROM {name}_n n JOIN {name}_w w ON n.t = w.t AND n.id = w.id GROUP BY ALL)"""


def _pixels_sql(src: str, columns: str = "t") -> str:
    return f"SELECT {columns}, y, unnest(range(x0, x1 + 1))::INT AS x FROM {src}"


def _filled_sql(name: str, px: str, images: str) -> str:
    """CTEs: name(t, y, x): px and the pixels that it encloses."""
    return f"""{name}_bg AS MATERIALIZED (SELECT g.t, g.y, g.x FROM (SELECT t, y::INT AS y, x::INT AS x FROM {images}, range(0, {SIDE}) a(y), range(0, {SIDE}) b(x)) g ANTI JOIN {px} p ON p.t = g.t AND p.y = g.y AND p.x = g.x),
{_runs_sql(f'{name}_br', f'{name}_bg')}, {_components_sql(f'{name}_bc', f'{name}_br', 0)},
{name}_h AS (SELECT t, region FROM {name}_bc GROUP BY ALL HAVING min(y) > 0 AND max(y) < {SIDE - 1} AND min(x0) > 0 AND max(x1) < {SIDE - 1}),
{name} AS MATERIALIZED (SELECT t, y, x FROM {px} UNION SELECT t, y, x FROM ({_pixels_sql(f'{name}_bc', 't, region')}) JOIN {name}_h USING (t, region))"""


def _dilated_sql(name: str, px: str, size: int) -> str:
    r = size // 2
    return f"{name} AS MATERIALIZED (SELECT DISTINCT t, (y + dy)::INT AS y, (x + dx)::INT AS x FROM {px}, range({-r}, {r + 1}) a(dy), range({-r}, {r + 1}) b(dx) WHERE y + dy BETWEEN 0 AND {SIDE - 1} AND x + dx BETWEEN 0 AND {SIDE - 1})"


def _eroded_sql(name: str, px: str, size: int, grid: str = "d") -> str:
    none = f"{name}_c AS MATERIALIZED (SELECT t, y, x FROM {grid} ANTI JOIN {px} p USING (t, y, x))"
    return f"{none}, {_dilated_sql(f'{name}_g', f'{name}_c', size)}, {name} AS MATERIALIZED (SELECT t, y, x FROM {grid} ANTI JOIN {name}_g p USING (t, y, x))"


def _painted_sql(px: str) -> str:
    return f"SELECT t AS target, d.y, d.x, (p.t IS NOT NULL)::INT::DOUBLE AS v FROM d LEFT JOIN {px} p USING (t, y, x)"


_OVER = "m AS MATERIALIZED (SELECT t, y, x FROM d WHERE v > 0.5)"
_V = "s AS MATERIALIZED (SELECT t, y, x, v FROM d)"
_OUT = "SELECT t AS target, y, x, round(v, 6) + 0.0 AS v FROM "

# --- windows ----------------------------------------------------------------------------------------------------------


@query(_with(_V, _gaussian_sql("g", "s", 3.0)) + _OUT + "g")
def raster_smooth(spark, d):
    return _six(stencils.gaussian(_dense(spark, d, "v"), _T, ["v"], 3.0, SIDE, SIDE), "v")


@query(_with(_V, _gaussian_sql("g", "s", max(4, int(0.12 * SIDE))), "h AS MATERIALIZED (SELECT t, y, x, s.v - g.v AS v FROM s JOIN g USING (t, y, x))", _norm_sql("n", "h")) + _OUT + "n")
def raster_local_contrast(spark, d):
    return _six(stencils.local_contrast(_dense(spark, d, "v"), _T, "v", SIDE, SIDE), "v")


_SOBEL = [_separable_sql("gx", "s", [1.0, 2.0, 1.0], [-1.0, 0.0, 1.0], "mirror"), _separable_sql("gy", "s", [-1.0, 0.0, 1.0], [1.0, 2.0, 1.0], "mirror")]
_PRODUCTS = [f"{n} AS MATERIALIZED (SELECT t, y, x, {a}.v * {b}.v AS v FROM gx JOIN gy USING (t, y, x))" for n, a, b in (("pxx", "gx", "gx"), ("pyy", "gy", "gy"), ("pxy", "gx", "gy"))]


@query(_with(_V, *_SOBEL, *_PRODUCTS, *[_gaussian_sql(f"j{n}", f"p{n}", 6.0) for n in ("xx", "yy", "xy")])
       + "SELECT t AS target, y, x, round(greatest(0, least(1, sqrt((a.v - b.v) * (a.v - b.v) + 4 * c.v * c.v) / (a.v + b.v + 1e-6))), 6) + 0.0 AS v FROM jxx a JOIN jyy b USING (t, y, x) JOIN jxy c USING (t, y, x)")
def raster_coherence(spark, d):
    return _six(stencils.coherence(_dense(spark, d, "v"), _T, "v", SIDE, SIDE), "v")


@query(_with("k AS MATERIALIZED (SELECT t, y, x, round(v * 1000000)::BIGINT AS v FROM d)", """o AS (SELECT g.t, g.y, g.x, g.v, sum(s.v)::BIGINT AS total, count(*) AS n FROM (SELECT t, y, x, v, y + dy AS yy, x + dx AS xx FROM k, range(-5, 6) a(dy), range(-5, 6) b(dx)) g JOIN k s ON s.t = g.t AND s.y = g.yy AND s.x = g.xx GROUP BY ALL)""")
       + "SELECT t AS target, y, x, total, n, v * n >= total + 20000 * n AS above FROM o")
def adaptive_mask(spark, d):
    """The sum (in millionths) and size of the window around each pixel, and whether the pixel exceeds its mean by a fiftieth."""
    px = _dense(spark, d, "v").withColumn("v", F.round(F.col("v") * 1000000).cast("long"))
    out = stencils.box_sums(px, _T, "v", 11, "total", "n")
    return out.select("target", "y", "x", "total", F.col("n").cast("long").alias("n"), (F.col("v") * F.col("n") >= F.col("total") + 20000 * F.col("n")).alias("above"))


_PARTS = "SELECT (l_suppkey // 10) AS t, l_orderkey * 8 + l_linenumber AS box, (l_quantity / 2)::INT AS x0, l_linenumber::INT AS y0, ((l_quantity / 2)::INT + l_partkey % 23)::INT AS x1, (l_linenumber + l_orderkey % 40)::INT AS y1 FROM lineitem"


@query(_with("""s AS MATERIALIZED (SELECT t, y, x, sum(sum(v)) OVER (PARTITION BY t, x ORDER BY y) AS c FROM (SELECT t, y, x, sum(v) OVER (PARTITION BY t, y ORDER BY x) AS v FROM d) GROUP BY t, y, x)""",
             f"b AS MATERIALIZED (SELECT DISTINCT * FROM ({_PARTS.replace('(l_quantity / 2)::INT', 'floor(l_quantity / 2)::INT')}))", "z AS (SELECT t, y + 1 AS y, x + 1 AS x, c FROM s)")
       + """SELECT b.t AS target, box, b.x0, b.y0, b.x1, b.y1, round(CASE WHEN b.x0 < b.x1 AND b.y0 < b.y1 THEN coalesce(p.c, 0) - coalesce(q.c, 0) - coalesce(r.c, 0) + coalesce(o.c, 0) ELSE 0 END, 6) + 0.0 AS total FROM b LEFT JOIN z p ON p.t = b.t AND p.y = b.y1 AND p.x = b.x1
LEFT JOIN z q ON q.t = b.t AND q.y = b.y0 AND q.x = b.x1 LEFT JOIN z r ON r.t = b.t AND r.y = b.y1 AND r.x = b.x0 LEFT JOIN z o ON o.t = b.t AND o.y = b.y0 AND o.x = b.x0""")  # fmt: skip
def box_totals(spark, d):
    """The sum of an image inside each of many boxes."""
    from ..sources.readers import table

    x0, n = F.floor(F.col("l_quantity") / 2).cast("int"), F.col("l_linenumber")
    boxes = table(spark, d, "lineitem").select(
        F.floor(F.col("l_suppkey") / 10).alias("target"), (F.col("l_orderkey") * 8 + n).alias("box"), x0.alias("x0"), n.alias("y0"), (x0 + F.col("l_partkey") % 23).cast("int").alias("x1"), (n + F.col("l_orderkey") % 40).cast("int").alias("y1")
    ).distinct()
    return _six(stencils.box_totals(boxes, stencils.integral(_dense(spark, d, "v"), _T, "v"), _T, ["box", "x0", "y0", "x1", "y1"]).withColumn("total", F.col("total").cast("double")), "total")


# --- texture ----------------------------------------------------------------------------------------------------------


def _entropy_sql(name: str, src: str, radius: int) -> str:
    return f"""{name} AS MATERIALIZED (SELECT t, y, x, log2(sum(n)) - sum(n * log2(n)) / sum(n) AS v FROM (SELECT g.t, g.yy AS y, g.xx AS x, g.v AS level, count(*)::DOUBLE AS n
FROM (SELECT t, y + dy AS yy, x + dx AS xx, v FROM {src}, range({-radius}, {radius + 1}) a(dy), range({-radius}, {radius + 1}) b(dx) WHERE dy * dy + dx * dx <= {radius * radius}) g WHERE yy BETWEEN 0 AND {SIDE - 1} AND xx BETWEEN 0 AND {SIDE - 1} GROUP BY ALL) GROUP BY t, y, x)"""


def _waves_sql(name: str, src: str) -> str:
    r = textures.SIZE // 2
    bank = [(f, j) for f in textures.FREQUENCIES for j in range(textures.DIRECTIONS)]
    turn = lambda j: (f"cos(pi() * {j} / {textures.DIRECTIONS})", f"sin(pi() * {j} / {textures.DIRECTIONS})")
    one = lambda f, j: "exp(-(power(dx * {c} + dy * {s}, 2) + power({a} * (dy * {c} - dx * {s}), 2)) / {d}) * cos(2 * pi() * {f} * (dx * {c} + dy * {s}))".format(c=turn(j)[0], s=turn(j)[1], a=textures.ASPECT, d=2 * textures.DEVIATION**2, f=f)
    raw = ", ".join(f"{one(f, j)} AS r{i}" for i, (f, j) in enumerate(bank))
    centred = ", ".join(f"r{i} - avg(r{i}) OVER () AS k{i}" for i in range(len(bank)))
    sums = ", ".join(f"abs(sum(s.v * k{i}))" for i in range(len(bank)))
    return f"""{name}_k AS MATERIALIZED (SELECT dy, dx, {centred} FROM (SELECT dy, dx, {raw} FROM range({-r}, {r + 1}) a(dy), range({-r}, {r + 1}) b(dx))),
{name} AS MATERIALIZED (SELECT g.t, g.y, g.x, greatest({sums}) AS v FROM (SELECT t, y, x, {name}_k.*, {_at('y + dy', 'mirror')} AS yy, {_at('x + dx', 'mirror')} AS xx FROM {src}, {name}_k) g JOIN {src} s ON s.t = g.t AND s.y = g.yy AND s.x = g.xx GROUP BY g.t, g.y, g.x)"""


def _periods_sql(name: str, src: str, size: int) -> str:
    starts = sorted({*range(0, SIDE - size + 1, size // 2), SIDE - size})
    at = f"(SELECT unnest({starts}) AS {{c}})"
    hann = lambda d: f"(0.5 - 0.5 * cos(2 * pi() * {d} / {size - 1}))"
    low = f"least(u, {size} - u) <= {textures.LOW_WAVES} AND least(w, {size} - w) <= {textures.LOW_WAVES}"
    return f"""{name}_p AS MATERIALIZED (SELECT t, ty, tx, y - ty AS dy, x - tx AS dx, (v - avg(v) OVER (PARTITION BY t, ty, tx)) * {hann('(y - ty)')} * {hann('(x - tx)')} AS z FROM {src}, {at.format(c='ty')}, {at.format(c='tx')} WHERE y BETWEEN ty AND ty + {size - 1} AND x BETWEEN tx AND tx + {size - 1}),
{name}_r AS MATERIALIZED (SELECT t, ty, tx, dy, u, sum(z * cos(2 * pi() * u * dx / {size})) AS re, -sum(z * sin(2 * pi() * u * dx / {size})) AS im FROM {name}_p, range(0, {size}) f(u) GROUP BY ALL),
{name}_f AS MATERIALIZED (SELECT t, ty, tx, u, w, CASE WHEN {low} THEN 0 ELSE sqrt(power(sum(re * cos(2 * pi() * w * dy / {size}) + im * sin(2 * pi() * w * dy / {size})), 2) + power(sum(im * cos(2 * pi() * w * dy / {size}) - re * sin(2 * pi() * w * dy / {size})), 2)) END AS a FROM {name}_r, range(0, {size}) f(w) GROUP BY t, ty, tx, u, w),
{name}_t AS (SELECT t, ty, tx, max(a) / (avg(a) + 1e-6) AS period FROM {name}_f GROUP BY ALL),
{name} AS MATERIALIZED (SELECT t, (ty + dy)::INT AS y, (tx + dx)::INT AS x, sum(period * greatest(1e-3, {hann('dy')} * {hann('dx')})) / greatest(sum(greatest(1e-3, {hann('dy')} * {hann('dx')})), 1e-6) AS v FROM {name}_t, range(0, {size}) a(dy), range(0, {size}) b(dx) GROUP BY ALL)"""


_GREY255 = "q AS MATERIALIZED (SELECT t, y, x, v * 255 AS v FROM d), l AS MATERIALIZED (SELECT t, y, x, floor(v * 255)::INT AS v FROM d)"


@query(_with(_V, _waves_sql("g", "s")) + _OUT + "g")
def raster_gabor(spark, d):
    return _six(textures.wave_energy(_dense(spark, d, "v"), _T, "v", SIDE, SIDE), "v")


@query(_with(_GREY255, _entropy_sql("e", "l", textures.DISK)) + _OUT + "e")
def raster_entropy(spark, d):
    px = _dense(spark, d, "v").withColumn("level", F.floor(F.col("v") * 255).cast("int"))
    return _six(stencils.entropy(px, _T, "level", textures.DISK, SIDE, SIDE, "v"), "v")


@query(_with(_GREY255, _periods_sql("p", "q", 16)) + _OUT + "p")
def raster_periodicity(spark, d):
    px = _dense(spark, d, "v").withColumn("v", F.col("v") * 255)
    return _six(fusion.blend(textures.periodicity(px, _T, "v", 16, SIDE, SIDE), _T, "period", 16), "v")


_PRIOR = [_V, _GREY255, *_SOBEL, *_PRODUCTS, *[_gaussian_sql(f"j{n}", f"p{n}", 6.0) for n in ("xx", "yy", "xy")],
          "a0 AS MATERIALIZED (SELECT t, y, x, greatest(0, least(1, sqrt((a.v - b.v) * (a.v - b.v) + 4 * c.v * c.v) / (a.v + b.v + 1e-6))) AS v FROM jxx a JOIN jyy b USING (t, y, x) JOIN jxy c USING (t, y, x))",
          _waves_sql("b0", "s"), _periods_sql("c0", "q", 32), _entropy_sql("d0", "l", textures.DISK), "q2 AS MATERIALIZED (SELECT t, y, x, v * v AS v FROM q)", _gaussian_sql("m1", "q", textures.SPREAD), _gaussian_sql("m2", "q2", textures.SPREAD),
          "e0 AS MATERIALIZED (SELECT t, y, x, m2.v - m1.v * m1.v AS v FROM m1 JOIN m2 USING (t, y, x))", *[_norm_sql(f"{n}1", f"{n}0") for n in "abcde"],
          "core AS MATERIALIZED (SELECT t, y, x, a.v * (0.5 + 0.5 * b.v) * (0.5 + 0.5 * c.v) * (1 - 0.35 * k.v) * (0.3 + 0.7 * e.v) AS v FROM a1 a JOIN b1 b USING (t, y, x) JOIN c1 c USING (t, y, x) JOIN d1 k USING (t, y, x) JOIN e1 e USING (t, y, x))",
          _gaussian_sql("h", "core", textures.LAST), _norm_sql("n", "h")]


@query(_with(*_PRIOR) + "SELECT t AS target, y, x, round(v, 5) + 0.0 AS v FROM n")
def raster_texture(spark, d):
    px = _dense(spark, d, "v").withColumn("v", F.col("v") * 255)
    return textures.row_prior(px, _T, "v", SIDE, SIDE, 32).withColumn("v", F.round("v", 5) + F.lit(0.0))


# --- fusion -----------------------------------------------------------------------------------------------------------

_SOURCES = [f"{n}0 AS MATERIALIZED (SELECT t, y, x, {e} AS v FROM d)" for n, e in (("a", "v"), ("b", "w"), ("c", "round(v * (1 - w), 9)"))]
_MAPS = [*_SOURCES, *[_norm_sql(f"{n}1", f"{n}0") for n in "abc"]]
_RANKED = [f"{n}2 AS MATERIALIZED (SELECT t, y, x, (row_number() OVER (PARTITION BY t ORDER BY round(v, 9), y, x) - 1) / {SIDE * SIDE - 1}.0::DOUBLE AS v FROM {n}1)" for n in "abc"]
_RULES_SQL = {
    "weighted_avg": "(2 * a.v + b.v + c.v) / 4",
    "geometric_mean": "exp((ln(a.v + 1e-3) + ln(b.v + 1e-3) + ln(c.v + 1e-3)) / 3)",
    "rank_avg": "(a.v + b.v + c.v) / 3",
    "min": "least(a.v, b.v, c.v)",
    "max": "greatest(a.v, b.v, c.v)",
    "gate": "a.v * (0.4 + 0.6 * (b.v + c.v) / 2)",
}


def _fused(spark: SparkSession, d: str, rule: str) -> DataFrame:
    maps = _dense(spark, d, "v", "w").withColumn("u", F.round(F.col("v") * (1 - F.col("w")), 9))
    return fusion.fused_map(maps, _T, ["v", "w", "u"], rule, SIDE, SIDE, [2.0, 1.0, 1.0] if rule == "weighted_avg" else None, 3.0, "fused")


def _fused_query(rule: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        return _six(_fused(spark, d, rule), "fused")

    return run


for _rule, _sql in _RULES_SQL.items():
    QUERIES[f"fused_map_{_rule}"] = _fused_query(_rule)
    _n = 2 if _rule == "rank_avg" else 1
    _fuse = f"e AS MATERIALIZED (SELECT t, y, x, {_sql} AS v FROM a{_n} a JOIN b{_n} b USING (t, y, x) JOIN c{_n} c USING (t, y, x))"
    ORACLE_SQL[f"fused_map_{_rule}"] = _with(*_MAPS, *(_RANKED if _n == 2 else []), _fuse, _gaussian_sql("g", "e", 3.0), _norm_sql("n", "g")) + "SELECT t AS target, y, x, round(v, 6) + 0.0 AS fused FROM n"

# --- morphology and components ----------------------------------------------------------------------------------------


@query(_with(_OVER, _eroded_sql("m1", "m", 5), _dilated_sql("m2", "m1", 5), _dilated_sql("m3", "m2", 9), _eroded_sql("m4", "m3", 9)) + _painted_sql("m4"))
def raster_morphology(spark, d):
    px = _dense(spark, d, "v")
    runs, images = _mask(px)
    opened = cut(morphology.opened(runs, images, _T, 5, SIDE, SIDE), "opened")
    return _painted(px, morphology.closed(opened, images, _T, 9, SIDE, SIDE))


@query(_with(_OVER, _filled_sql("h", "m", "i")) + _painted_sql("h"))
def raster_fill(spark, d):
    px = _dense(spark, d, "v")
    runs, images = _mask(px)
    return _painted(px, components.filled(runs, images, _T, SIDE, SIDE))


_LARGE = f"k AS (SELECT t, region FROM c GROUP BY ALL HAVING sum(x1 - x0 + 1) >= {_LEAST!r})"


@query(_with(_OVER, _runs_sql("r", "m"), _components_sql("c", "r"), _LARGE, f"q AS MATERIALIZED (SELECT t, y, x FROM ({_pixels_sql('c', 't, region')}) JOIN k USING (t, region))", _filled_sql("h", "q", "i")) + _painted_sql("h"))
def raster_cleanup(spark, d):
    px = _dense(spark, d, "v")
    runs, images = _mask(px)
    large = components.at_least(components.connected(runs, _T), _T, _LEAST).select("target", "y", "x0", "x1")
    return _painted(px, components.filled(cut(large, "large"), images, _T, SIDE, SIDE))


@query(_with(_OVER, _runs_sql("r", "m"), _components_sql("c", "r")) + "SELECT t AS target, y, x0, x1, region FROM c")
def component_runs(spark, d):
    return components.connected(_mask(_dense(spark, d, "v"))[0], _T)


_TRUTH = "p AS MATERIALIZED (SELECT t, y, x FROM d WHERE pos)"


@query(_with(_TRUTH, _runs_sql("r", "p"), _components_sql("c", "r")) + "SELECT t AS target, region, sum(x1 - x0 + 1)::BIGINT AS area, min(x0) AS x0, min(y) AS y0, max(x1) + 1 AS x1, max(y) + 1 AS y1 FROM c GROUP BY ALL HAVING sum(x1 - x0 + 1) > 100")
def truth_boxes(spark, d):
    """The boxes of the truth mask's components of over 100 pixels."""
    labelled = components.connected(components.runs(_dense(spark, d, "pos").filter("pos"), _T), _T)
    return components.summary(labelled, _T).filter("area > 100")


@query(_with(_TRUTH, _runs_sql("r", "p"), _components_sql("c", "r")) + "SELECT i.t AS target, coalesce(n, 0) AS fragments FROM i LEFT JOIN (SELECT t, count(DISTINCT region) AS n FROM c GROUP BY t) USING (t)")
def fragment_count(spark, d):
    px = _dense(spark, d, "pos")
    return components.fragments(components.connected(components.runs(px.filter("pos"), _T), _T), px, _T)


@query(_with("u AS MATERIALIZED (SELECT t, y, x, v FROM d JOIN (SELECT t, round(avg(v) + stddev_pop(v), 9) AS k FROM d GROUP BY t) USING (t) WHERE v >= k)", _runs_sql("r", "u"), _components_sql("c", "r"))
       + f"SELECT t AS target, region, count(*) AS area, min(y) AS y0, min(x) AS x0, max(y) + 1 AS y1, max(x) + 1 AS x1, round(avg(v), 6) + 0.0 AS confidence FROM ({_pixels_sql('c', 't, region')}) JOIN u USING (t, y, x) GROUP BY ALL HAVING count(*) >= {_LEAST!r}")
def region_boxes(spark, d):
    """Boxes, areas and mean scores of the components above mean + one deviation."""
    from ..operators import pixels

    px = _dense(spark, d, "v")
    high = cut(pixels.above_sigma(px, _T, "v", 1.0), "high")
    at = components.pixels_of(components.connected(components.runs(high, _T), _T), "target", "region").join(high, ["target", "y", "x"])
    return _six(pixels.regions(at, ["target", "region"], "v").select("target", "region", "area", "y0", "x0", "y1", "x1", "confidence").filter(F.col("area") >= _LEAST), "confidence")


def _border_sql(name: str, px: str) -> str:
    return f"{_eroded_sql(f'{name}_e', px, 3)}, {name} AS MATERIALIZED (SELECT t, y, x FROM {px} ANTI JOIN {name}_e e USING (t, y, x))"


@query(_with(_OVER, _V, _gaussian_sql("g", "s", 2.0), "n AS MATERIALIZED (SELECT t, y, x FROM g WHERE round(v, 9) > 0.5)", _border_sql("bm", "m"), _border_sql("bn", "n"), _dilated_sql("dm", "bm", 5), _dilated_sql("dn", "bn", 5),
             "hm AS (SELECT t, count(dn.t) / count(*) AS p FROM bm LEFT JOIN dn USING (t, y, x) GROUP BY t)", "hn AS (SELECT t, count(dm.t) / count(*) AS r FROM bn LEFT JOIN dm USING (t, y, x) GROUP BY t)")
       + "SELECT i.t AS target, round(coalesce(2 * p * r / nullif(p + r, 0), 0), 9) AS f1 FROM i LEFT JOIN hm USING (t) LEFT JOIN hn USING (t)")
def boundary_f1(spark, d):
    """How the borders of a mask and of the smoothed image's mask agree, within two pixels."""
    px = _dense(spark, d, "v")
    runs, images = _mask(px)
    smooth = stencils.gaussian(px, _T, ["v"], 2.0, SIDE, SIDE).withColumn("v", F.round("v", 9))
    out = morphology.boundary_f1(runs, cut(_mask(smooth)[0], "smooth"), images, _T, SIDE, SIDE, 2)
    return out.withColumn("f1", F.round("f1", 9))


# --- scores and choice of masks ---------------------------------------------------------------------------------------


def _scores_sql(name: str, px: str, heat: str) -> str:
    """CTEs: name(t, score) of masks px (t, y, x), of which a heat relation has (t, y, x, heat, negative)."""
    images = f"(SELECT DISTINCT t FROM {px})"
    quads = f"""{name}_q AS MATERIALIZED (SELECT t, region, y - dy AS qy, x - dx AS qx, bit_or((1 << (2 * dy + dx))::INT) AS q FROM ({_pixels_sql(f'{name}_c', 't, region')}), range(0, 2) a(dy), range(0, 2) b(dx) GROUP BY ALL)"""
    return f"""{_filled_sql(f'{name}_s', px, images)}, {_runs_sql(f'{name}_r', f'{name}_s')}, {_components_sql(f'{name}_c', f'{name}_r')}, {quads},
{name}_m AS (SELECT t, region, sum(CASE WHEN q = 15 THEN 1.0::DOUBLE WHEN bit_count(q) = 3 THEN 0.5::DOUBLE ELSE 0 END) AS area, sum(CASE WHEN q = 15 THEN 0 WHEN bit_count(q) = 3 THEN sqrt(2.0::DOUBLE) WHEN q IN (6, 9) THEN 2 * sqrt(2.0::DOUBLE) WHEN bit_count(q) = 2 THEN 1.0::DOUBLE ELSE 0 END) AS perimeter FROM {name}_q GROUP BY ALL),
{name}_o AS (SELECT t, 4 * pi() * area / (perimeter * perimeter + 1e-6) AS compact, frag FROM (SELECT *, row_number() OVER (PARTITION BY t ORDER BY area DESC, region) AS rn, count(*) OVER (PARTITION BY t) AS frag FROM {name}_m) WHERE rn = 1),
{name} AS MATERIALIZED (SELECT t, CASE WHEN n < 10 THEN -1e9 ELSE fill - 0.5 * low - 0.4 * neg + 0.15 * compact - 0.03 * frag END AS score FROM (SELECT t, count(*) AS n, avg(heat) AS fill, avg((heat < 0.35)::INT) AS low, avg(negative) AS neg FROM {px} JOIN {heat} USING (t, y, x) GROUP BY t) JOIN {name}_o USING (t))"""


@query(_with(_V, _norm_sql("h0", "s"), "k0 AS (SELECT t, y, x, 1 - v AS v FROM h0)", _norm_sql("k1", "k0"), "heat AS MATERIALIZED (SELECT t, y, x, h0.v AS heat, k1.v AS negative FROM h0 JOIN k1 USING (t, y, x))",
             "half AS MATERIALIZED (SELECT t, y, x FROM heat JOIN (SELECT t, round(quantile_cont(heat, 0.5), 9) AS q FROM heat GROUP BY t) USING (t) WHERE round(heat, 9) >= q)", _scores_sql("z", "half", "heat"))
       + "SELECT t AS target, round(score, 6) AS score FROM z")
def mask_score(spark, d):
    """The score of the upper half of each image, with its complement as negative heat."""
    from ..operators.ordered import percentiles

    px = num.norm01(_dense(spark, d, "v"), _T, "v", "heat").withColumn("negative", 1 - F.col("heat")).select("target", "y", "x", "heat", "negative")
    heat = cut(num.norm01(px, _T, "negative", "negative"), "heat")
    limit = percentiles(heat, _T, "heat", [0.5]).select("target", F.round(F.get("q", F.lit(0)), 9).alias("limit"))
    half = heat.join(limit, "target").filter(F.round("heat", 9) >= F.col("limit"))
    return _six(shapes.mask_scores(cut(components.runs(half, _T), "half"), heat, _T, [], SIDE, SIDE), "score")


_NEED = 0.62
_CANDIDATES = f"""g AS MATERIALIZED (SELECT t, region, min(y) AS y0, min(x0) AS x0, max(y) AS y1, max(x1) AS x1 FROM c GROUP BY ALL HAVING sum(x1 - x0 + 1) >= {_LEAST!r}),
b0 AS MATERIALIZED (SELECT g.t, region, 0 AS cand, d.y, d.x, w, neg FROM g JOIN d ON d.t = g.t AND d.y BETWEEN y0 AND y1 AND d.x BETWEEN x0 AND x1),
b1 AS MATERIALIZED (SELECT g.t, region, 1 AS cand, d.y, d.x FROM g JOIN d ON d.t = g.t AND d.y BETWEEN y0 + (y1 - y0) // 10 AND y1 - (y1 - y0) // 10 AND d.x BETWEEN x0 + (x1 - x0) // 10 AND x1 - (x1 - x0) // 10),
b2 AS MATERIALIZED (SELECT g.t, region, d.y, d.x, neg, d.y BETWEEN y0 AND y1 AND d.x BETWEEN x0 AND x1 AS inside FROM g JOIN d ON d.t = g.t AND d.y BETWEEN y0 - 2 AND y1 + 2 AND d.x BETWEEN x0 - 2 AND x1 + 2 WHERE w >= 0.35),
b4 AS (SELECT t, region, b.n, coalesce(p.n, 0) AS m FROM (SELECT t, region, count(*) AS n FROM b0 GROUP BY ALL) b LEFT JOIN (SELECT t, region, count(*) AS n FROM b2 GROUP BY ALL) p USING (t, region)),
cands AS MATERIALIZED (SELECT t, region, cand, y, x FROM b0 UNION ALL SELECT * FROM b1 UNION ALL SELECT t, region, 2, y, x FROM b2 UNION ALL SELECT t, region, 3, y, x FROM b2 WHERE NOT neg
UNION ALL SELECT b0.t, b0.region, 4, b0.y, b0.x FROM b0 JOIN b4 USING (t, region) WHERE m <= 0.1 * n OR w >= 0.35),
named AS MATERIALIZED (SELECT t || '/' || region || '/' || cand AS t, y, x, t AS image FROM cands), heat AS MATERIALIZED (SELECT n.t, n.y, n.x, d.v AS heat, 1 - d.w AS negative FROM named n JOIN d ON d.t = n.image AND d.y = n.y AND d.x = n.x)"""


def _candidates(px: DataFrame, high: DataFrame) -> DataFrame:
    """target, region, candidate, y, x: five masks for every region, which stand in for a predictor's answers to a box, a box drawn in, points, points with negative ones, and box and points."""
    boxes = components.summary(components.connected(components.runs(high, _T), _T), _T).filter(F.col("area") >= _LEAST)
    boxes = cut(boxes.select("target", "region", "y0", "x0", (F.col("y1") - 1).alias("y1"), (F.col("x1") - 1).alias("x1")), "boxes")

    def inside(grow: int, drawn: bool) -> DataFrame:
        dy, dx = (((F.col(f"{a}1") - F.col(f"{a}0")) / 10).cast("int") if drawn else F.lit(0) for a in "yx")
        span = lambda a, delta, extent: F.explode(F.sequence(F.greatest(F.lit(0), F.col(f"{a}0") - grow + delta), F.least(F.lit(extent - 1), F.col(f"{a}1") + grow - delta)))
        exploded = boxes.select("target", "region", span("y", dy, SIDE).alias("y"), "x0", "x1").select("target", "region", "y", span("x", dx, SIDE).alias("x"))
        return exploded.hint("merge")  # as in pixels_of: all pixels look as small as the boxes

    of = px.select("target", "y", "x", (F.col("w") >= 0.35).alias("point"), "neg")
    box = cut(inside(0, False).join(of, ["target", "y", "x"]), "box")
    points = cut(inside(2, False).join(of, ["target", "y", "x"]).filter("point"), "points")
    sizes = box.groupBy("target", "region").agg(F.count(F.lit(1)).alias("n")).join(points.groupBy("target", "region").agg(F.count(F.lit(1)).alias("m")), ["target", "region"], "left").na.fill(0, ["m"])
    both = box.hint("merge").join(sizes, ["target", "region"]).filter((F.col("m") <= 0.1 * F.col("n")) | F.col("point"))
    parts = [box, inside(0, True), points, points.filter("NOT neg"), both]
    out = None
    for k, p in enumerate(parts):
        one = p.select("target", "region", F.lit(k).alias("candidate"), "y", "x")
        out = one if out is None else out.unionByName(one)
    return cut(out, "candidates")


def _chosen_sql() -> str:
    above = f"u AS MATERIALIZED (SELECT t, y, x FROM d WHERE v >= {_NEED})"
    best = "best AS (SELECT image, region, cand FROM (SELECT split_part(t, '/', 1)::BIGINT AS image, split_part(t, '/', 2)::BIGINT AS region, split_part(t, '/', 3)::INT AS cand, row_number() OVER (PARTITION BY split_part(t, '/', 1), split_part(t, '/', 2) ORDER BY round(score, 9) DESC, split_part(t, '/', 3)::INT) AS rn FROM z) WHERE rn = 1)"
    return _with(above, _runs_sql("r", "u"), _components_sql("c", "r"), _CANDIDATES, _scores_sql("z", "named", "heat"), best)


@query(_chosen_sql() + "SELECT image AS target, region, cand AS candidate FROM best")
def candidate_choice(spark, d):
    """The best of each region's candidate masks by the label-free score; the first of equal ones."""
    px = _dense(spark, d, "v", "w", "neg")
    scores = _candidate_scores(px, _candidates(px, px.filter(F.col("v") >= _NEED)))
    return first_by(scores, ["target", "region"], F.desc("score"), F.col("candidate")).select("target", "region", "candidate")


def _candidate_scores(px: DataFrame, candidates: DataFrame) -> DataFrame:
    heat = px.select("target", "y", "x", F.col("v").alias("heat"), (1 - F.col("w")).alias("negative"))
    runs = cut(components.runs(candidates, ["target", "region", "candidate"]), "candidate-runs")
    scores = shapes.mask_scores(runs.withColumnRenamed("region", "of"), heat, _T, ["of", "candidate"], SIDE, SIDE)
    return cut(scores.select("target", F.col("of").alias("region"), "candidate", F.round("score", 9).alias("score")), "scores")


@query(_chosen_sql().rstrip() + f""",
un AS MATERIALIZED (SELECT DISTINCT c.t, y, x FROM cands c JOIN best b ON b.image = c.t AND b.region = c.region AND b.cand = c.cand), {_runs_sql('ur', 'un')}, {_components_sql('uc', 'ur')},
uk AS (SELECT t, region FROM uc GROUP BY ALL HAVING sum(x1 - x0 + 1) >= {_LEAST!r}), uq AS MATERIALIZED (SELECT t, y, x FROM ({_pixels_sql('uc', 't, region')}) JOIN uk USING (t, region)), {_filled_sql('uh', 'uq', 'i')},
us AS (SELECT t, count(uh.t) AS area, count_if(pos) AS truth, count_if(pos AND uh.t IS NOT NULL) AS hit, count_if(neg AND uh.t IS NOT NULL) AS wrong, count_if(neg) AS black FROM d LEFT JOIN uh USING (t, y, x) GROUP BY t)
SELECT t AS target, area, truth, hit, round(coalesce(hit / nullif(area + truth - hit, 0), 0), 9) AS iou, round(hit / nullif(truth, 0), 9) AS coverage, round(wrong / nullif(black, 0), 9) AS fp_on_black, round(area / greatest(truth, 1), 9) AS area_ratio FROM us""")
def predicted_masks(spark, d):
    """Every image's chosen masks united, cleaned (small components dropped, holes filled) and scored against the truth, on packed words."""
    px = _dense(spark, d, "v", "w", "pos", "neg")
    candidates = _candidates(px, px.filter(F.col("v") >= _NEED))
    words = bitmaps.pack(candidates, ["target", "region", "candidate"], SIDE)
    union = bitmaps.choose(words, _candidate_scores(px, candidates), _T, ["region"])
    labelled = components.connected(components.runs(bitmaps.unpack(union, _T, SIDE), _T), _T)
    large = cut(components.at_least(labelled, _T, _LEAST).select("target", "y", "x0", "x1"), "large")
    final = bitmaps.pack(components.pixels_of(components.filled(large, px, _T, SIDE, SIDE), *_T), _T, SIDE)
    of = lambda c: bitmaps.pack(px.filter(c), _T, SIDE)
    out = bitmaps.overlap(px, final, of("pos"), of("neg"), _T)
    return out.withColumns({c: F.round(c, 9) for c in ("iou", "coverage", "fp_on_black", "area_ratio")})


# --- region proposal --------------------------------------------------------------------------------------------------


def _labelled_sql(method: str) -> list[str]:
    """CTEs: lab(t, level, region, y, x, v), the pixels of the regions that a method finds."""
    first = method[0].isupper()
    heat = [_V, _gaussian_sql("heat", "s", 9.0)] if first else ["heat AS MATERIALIZED (SELECT t, y, x, v FROM d)"]
    grey = "gr AS MATERIALIZED (SELECT t, y, x, floor(greatest(0, least(1, v)) * 255)::DOUBLE AS v FROM heat)"
    above = lambda more: f"mk AS MATERIALIZED (SELECT h.t * 100 AS t, h.y, h.x FROM heat h JOIN gr USING (t, y, x) JOIN ar USING (t, y, x) JOIN (SELECT t, avg(v) AS m FROM heat GROUP BY t) USING (t) WHERE gr.v > round(ar.v, 6) + {more} AND h.v >= m)"
    levels = [0] if method == "stability" else proposal.LEVELS.get(method, [0])
    if method == "A_threshold":
        found = ["mk AS MATERIALIZED (SELECT t * 100 AS t, y, x FROM heat JOIN (SELECT t, round(avg(v) + stddev_pop(v), 9) AS k FROM heat GROUP BY t) USING (t) WHERE v >= k)"]
    elif method == "C_adaptive":
        found = [grey, _separable_sql("ar", "gr", [1 / 51] * 51, [1 / 51] * 51, "nearest"), above(5)]
    elif method == "adaptive":
        found = [grey, _gaussian_sql("ar", "gr", 9.5), above(8)]
    else:
        ps = proposal.LEVELS[method]
        limits = f"SELECT t, unnest({ps}) AS level, round(unnest(quantile_cont(v, {[p / 100 for p in ps]})), 9) AS k FROM heat GROUP BY t"
        per = f"SELECT t, level, y, x FROM heat JOIN ({limits}) USING (t) WHERE v >= k"
        found = [f"mk AS MATERIALIZED (SELECT t * 100 AS t, y, x FROM ({per}) GROUP BY t, y, x HAVING count(*) >= 3)" if method == "stability" else f"mk AS MATERIALIZED (SELECT t * 100 + level AS t, y, x FROM ({per}))"]
    grid = f"du AS MATERIALIZED (SELECT t * 100 + level AS t, y, x FROM d, (SELECT unnest({levels}) AS level)), di AS (SELECT DISTINCT t FROM du)"
    clean = [_eroded_sql("k1", "mk", 5, "du"), _dilated_sql("k2", "k1", 5), _dilated_sql("k3", "k2", 9), _eroded_sql("k4", "k3", 9, "du")]
    if not first:
        clean.append(_filled_sql("k5", "k4", "di"))
    px = "k4" if first else "k5"
    return [*heat, *found, grid, *clean, _runs_sql("r", px), _components_sql("c", "r"),
            f"lab AS MATERIALIZED (SELECT z.t // 100 AS t, (z.t % 100)::INT AS level, region::INT AS region, z.y, z.x, v FROM (SELECT t, y, x, dense_rank() OVER (PARTITION BY t ORDER BY region) AS region FROM ({_pixels_sql('c', 't, region')})) z JOIN heat h ON h.t = z.t // 100 AND h.y = z.y AND h.x = z.x)"]


def _proposed_sql(method: str) -> list[str]:
    """CTEs: lab, and found: the regions that stay, with their rank."""
    regs = f"rg AS MATERIALIZED (SELECT t, level, region, count(*) AS area, avg(v) AS confidence, avg(y) AS cy, avg(x) AS cx, min(x) AS x0, min(y) AS y0, max(x) + 1 AS x1, max(y) + 1 AS y1 FROM lab GROUP BY ALL HAVING count(*) >= {_LEAST!r})"
    late = method == "D_multithresh"
    if method[0].isupper() and not late:
        return [*_labelled_sql(method), regs, "found AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY round(confidence, 9) DESC, region)::INT AS rank FROM rg)"]
    first = "level, region" if late else "round(confidence, 9) DESC, level, region"
    one = f"ro AS (SELECT *, row_number() OVER (PARTITION BY t, round_even(cy, -1), round_even(cx, -1) ORDER BY {first}) AS rn FROM rg)"
    rank = "rk AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY round(confidence, 9) DESC, level, region)::INT AS rank FROM ro WHERE rn = 1)"
    return [*_labelled_sql(method), regs, one, rank, "found AS (SELECT * FROM rk" + ("" if late else " WHERE rank <= 6") + ")"]


def _proposed(method: str) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        found, _ = proposal.propose(_field(spark, d), _T, "v", method, SIDE, SIDE, _LEAST, apart=5)
        return _six(found.select("target", "level", "region", "rank", "area", "confidence", "x0", "y0", "x1", "y1"), "confidence")

    run.__name__ = f"propose_{method.lower()}"
    grows = method in ("B_localmax", "watershed")
    query(None if grows else _with(*_proposed_sql(method)) + "SELECT t AS target, level, region, rank, area, round(confidence, 6) + 0.0 AS confidence, x0, y0, x1, y1 FROM found")(run)


for _method in proposal.METHODS:
    _proposed(_method)


def _prompted(spark, d):
    field = _field(spark, d)
    _, at = proposal.propose(field, _T, "v", "stability", SIDE, SIDE, _LEAST)
    at = cut(at, "regions")
    return field, at, proposal.region_prompts(at, _T, "v")


_IN = "p AS MATERIALIZED (SELECT lab.* FROM lab JOIN found USING (t, level, region)), b AS MATERIALIZED (SELECT t, level, region, min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1 FROM p GROUP BY ALL), pk AS (SELECT t, level, region, y AS peak_y, x AS peak_x FROM (SELECT *, row_number() OVER (PARTITION BY t, level, region ORDER BY v DESC, y, x) AS rn FROM p) WHERE rn = 1)"


@query(_with(*_proposed_sql("stability"), _IN) + """SELECT t AS target, level, region, x0, y0, x1, y1, x0 + trunc((x1 - x0) * 0.05)::INT AS ex0, y0 + trunc((y1 - y0) * 0.05)::INT AS ey0, x1 - trunc((x1 - x0) * 0.05)::INT AS ex1, y1 - trunc((y1 - y0) * 0.05)::INT AS ey1,
peak_y, peak_x, greatest(8, trunc(0.15 * greatest(x1 - x0, y1 - y0)))::DOUBLE AS apart FROM b JOIN pk USING (t, level, region)""")
def region_prompts(spark, d):
    """Of each proposed region its box, the box drawn in, its peak, and the distance that its points keep."""
    return _prompted(spark, d)[2]


@query()
def prompt_points(spark, d):
    """Positive points inside each proposed region, negative ones around it."""
    field, at, prompts = _prompted(spark, d)
    negative = field.select("target", "y", "x", F.col("w").alias("v"))
    pos = proposal.positive_points(at, prompts, _T, "v").withColumn("kind", F.lit("pos"))
    return pos.unionByName(proposal.negative_points(at, prompts, negative, _T, "v", SIDE, SIDE).withColumn("kind", F.lit("neg")))


# --- sheets -----------------------------------------------------------------------------------------------------------

_GREY = "least(255, floor(v * 60)::INT + CASE WHEN (x % 13 = 3 OR y % 12 = (t % 3) + 4) AND (y * 7 + x * 5) % 9 <> 0 THEN 110 ELSE 0 END)"
_LINES = _with(f"s AS MATERIALIZED (SELECT t, y, x, {_GREY} AS v FROM d)",
               f"g AS MATERIALIZED (SELECT p.t, p.y, p.x, p.v, quantile_disc(s.v, 0.5) AS m FROM (SELECT t, y, x, v, {_at('y + dy', 'nearest')} AS yy, {_at('x + dx', 'nearest')} AS xx FROM s, range(-5, 6) a(dy), range(-5, 6) b(dx)) p JOIN s ON s.t = p.t AND s.y = p.yy AND s.x = p.xx GROUP BY ALL)",
               f"n AS MATERIALIZED (SELECT t, axis, place, count(*) AS n FROM (SELECT t, unnest(['x', 'y']) AS axis, unnest([x, y]) AS place FROM g WHERE v - m > 25 AND x BETWEEN {int(0.2 * SIDE)} AND {int(0.995 * SIDE) - 1} AND y BETWEEN {int(0.01 * SIDE)} AND {int(0.99 * SIDE) - 1}) GROUP BY ALL)",
               "k AS (SELECT *, max(n) OVER (PARTITION BY t, axis) AS top FROM n)",
               "j AS (SELECT t, axis, place, sum(new) OVER (PARTITION BY t, axis ORDER BY place) AS island FROM (SELECT *, CASE WHEN place - lag(place) OVER (PARTITION BY t, axis ORDER BY place) > 4 THEN 1 ELSE 0 END AS new FROM k WHERE n > 0.45 * top))",
               "lines AS MATERIALIZED (SELECT t, axis, row_number() OVER (PARTITION BY t, axis ORDER BY island)::INT AS i, round_even((min(place) + max(place)) / 2.0, 0)::INT AS line FROM j GROUP BY t, axis, island)")


def _lines(spark: SparkSession, d: str) -> DataFrame:
    y, x = F.col("y"), F.col("x")
    on = ((x % 13 == 3) | (y % 12 == F.col("target") % 3 + 4)) & ((y * 7 + x * 5) % 9 != 0)
    grey = F.least(F.lit(255), F.floor(F.col("v") * 60).cast("int") + F.when(on, 110).otherwise(0))
    return georef.graticule(_dense(spark, d, "v").withColumn("v", grey), _T, "v", SIDE, SIDE, 11, 4)


@query(_LINES + "SELECT t AS target, axis, i, line FROM lines")
def sheet_lines(spark, d):
    """The grid lines of every sheet, from its pixels."""
    return _lines(spark, d)


_READ = "SELECT t, axis, i::INT AS i, CASE WHEN axis = 'x' THEN 215640 + 40 * (i - 1) + (t * i) % 3 ELSE 591440 - 40 * (i - 1) - (t + i) % 2 END AS world FROM i AS images(t), (SELECT unnest(['x', 'x', 'y', 'y', 'y']) AS axis, unnest([1, 2, 1, 2, 3]) AS i)"


@query(_LINES.rstrip() + f""",
q AS (SELECT t, axis, line::DOUBLE AS p, world::DOUBLE AS w FROM lines JOIN ({_READ}) USING (t, axis, i)),
gp AS (SELECT v.t, v.p AS px, h.p AS py, v.w AS wx, h.w AS wy FROM (SELECT * FROM q WHERE axis = 'x') v JOIN (SELECT * FROM q WHERE axis = 'y') h USING (t)),
ce AS (SELECT t, count(*) AS n, avg(px) AS mx, avg(py) AS my, avg(wx) AS ox, avg(wy) AS oy FROM gp GROUP BY t),
su AS (SELECT t, n, mx, my, ox, oy, sum((px - mx) * (px - mx)) AS uu, sum((px - mx) * (py - my)) AS uv, sum((py - my) * (py - my)) AS vv, sum((px - mx) * (wx - ox)) AS ux, sum((py - my) * (wx - ox)) AS vx, sum((px - mx) * (wy - oy)) AS uy, sum((py - my) * (wy - oy)) AS vy FROM gp JOIN ce USING (t) GROUP BY ALL),
co AS (SELECT t, n, mx, my, ox, oy, (ux * vv - vx * uv) / nullif(uu * vv - uv * uv, 0) AS a, (vx * uu - ux * uv) / nullif(uu * vv - uv * uv, 0) AS b, (uy * vv - vy * uv) / nullif(uu * vv - uv * uv, 0) AS dd, (vy * uu - uy * uv) / nullif(uu * vv - uv * uv, 0) AS e FROM su),
re AS (SELECT t, sqrt(avg(f)) AS rmse, sqrt(max(f)) AS most FROM (SELECT t, power(a * (px - mx) + b * (py - my) - (wx - ox), 2) + power(dd * (px - mx) + e * (py - my) - (wy - oy), 2) AS f FROM gp JOIN co USING (t)) GROUP BY t)
SELECT t AS target, n, round(a, 6) + 0.0 AS dx_px, round(e, 6) + 0.0 AS dy_py, round((abs(a) + abs(e)) / 2, 6) AS resolution, round(rmse, 6) AS rmse, round(most, 6) AS max_residual FROM co JOIN re USING (t)""")
def sheet_georeference(spark, d):
    """Sheets georeferenced from their pixels: lines found, paired with the coordinates read at them as far as both go, crossed and fitted."""
    i, t = F.col("i"), F.col("target")
    read = F.explode(F.array(*[F.struct(F.lit(a).alias("axis"), F.lit(k).alias("i")) for a, n in (("x", 2), ("y", 3)) for k in range(1, n + 1)]))
    labels = _field(spark, d).select("target").distinct().select("target", read.alias("r")).select("target", "r.*")
    world = F.when(F.col("axis") == "x", 215640 + 40 * (i - 1) + (t * i) % 3).otherwise(591440 - 40 * (i - 1) - (t + i) % 2)
    points = georef.sheet_points(_lines(spark, d), labels.withColumn("world", world), _T)
    out = georef.georeferenced(cut(points, "points"), _T)
    at = lambda k: F.get("gt", F.lit(k))
    return _six(out.select("target", "n", at(1).alias("dx_px"), at(5).alias("dy_py"), "resolution", "rmse", "max_residual"), "dx_px", "dy_py", "resolution", "rmse", "max_residual")


# --- polygons of sheets -----------------------------------------------------------------------------------------------

_CRS = "urn:ogc:def:crs:EPSG::2039"
_POINT = "'[' || ({x})::DOUBLE || ',' || ({y})::DOUBLE || ']'"


def _ring_sql(points: list[tuple[str, str]], world: bool) -> str:
    at = [(f"215640 + 0.5 * ({x}) - 0.25 * ({y})", f"591440 - 0.25 * ({x}) - 0.5 * ({y})") if world else (x, y) for x, y in [*points, points[0]]]
    return "'[' || " + " || ',' || ".join(_POINT.format(x=x, y=y) for x, y in at) + " || ']'"


def _coordinates_sql(world: bool) -> str:
    outer, hole = _ring_sql([("0", "0"), ("p_size", "0"), ("p_size", "2 * p_size")], world), _ring_sql([("p_size - 3", "2"), ("p_size - 2", "2"), ("p_size - 2", "4")], world)
    return f"'[' || {outer} || CASE WHEN p_size > 20 THEN ',' || {hole} ELSE '' END || ']'"


@query(f"""SELECT p_brand, sheet, '{{"type":"FeatureCollection","features":[' || string_agg(f, ',' ORDER BY p_partkey) || ']' || CASE WHEN world THEN ',"crs":{{"type":"name","properties":{{"name":"{_CRS}"}}}}' ELSE '' END || '}}' AS json
FROM (SELECT p_partkey, p_brand, p_partkey // 1000 AS sheet, p_brand NOT LIKE 'Brand#1%' AS world, '{{"type":"Feature","geometry":{{"type":"Polygon","coordinates":' || CASE WHEN p_brand LIKE 'Brand#1%' THEN {_coordinates_sql(False)} ELSE {_coordinates_sql(True)} END || '}},"properties":{{"id":' || p_partkey || ',"class":"cultivated_area","detection_source":"survey","size":' || p_size || '}}}}' AS f FROM part) GROUP BY p_brand, sheet, world""")
def geojson_sheets(spark, d):
    """A collection a sheet: in world coordinates, with their system, where the sheet has a transform, else in pixels; one property replaced, one added."""
    from ..functions import geometry as geo
    from ..sources import sinks
    from ..sources.readers import table

    size = F.col("p_size").cast("int")
    point = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    outer = F.array(point(F.lit(0), F.lit(0)), point(size, F.lit(0)), point(size, 2 * size))
    hole = F.array(point(size - 3, F.lit(2)), point(size - 2, F.lit(2)), point(size - 2, F.lit(4)))
    rings = F.when(size > 20, F.array(outer, hole)).otherwise(F.array(outer))
    world = ~F.col("p_brand").startswith("Brand#1")
    gt = F.when(world, F.array(*[F.lit(v) for v in (215640.0, 0.5, -0.25, 591440.0, -0.25, -0.5)]))
    props = geo.properties({"id": F.col("p_partkey"), "class": F.lit("cultivated_area"), "detection_source": F.lit("annotation")}, {"detection_source": F.lit("survey"), "size": size})
    sheets = table(spark, d, "part").withColumn("sheet", F.floor(F.col("p_partkey") / 1000))  # a collection is a sheet's polygons, at most 1000
    return sinks.feature_collections(sheets, ["p_brand", "sheet"], geo.polygon_feature(rings, props, gt), F.col("p_partkey"), F.when(world, F.lit(_CRS)))


# --- prototypes -------------------------------------------------------------------------------------------------------

_AVG = "[" + ", ".join(f"avg(v[{i}])" for i in range(1, _DIM + 1)) + "]"
_NEAREST_SQL = f"SELECT * FROM (SELECT r.*, c.cluster, row_number() OVER (PARTITION BY r.vec_id ORDER BY round({_DOT.format(a='c.c', b='c.c')} - 2 * {_DOT.format(a='r.v', b='c.c')}, 9), c.cluster) AS rn FROM r JOIN {{c}} c ON r.t = c.t) WHERE rn = 1"
_PROTO = ", ".join(f"sum(w * c[{i}]) / sum(w)" for i in range(1, _DIM + 1))


def _tiles_of(spark, d):
    """Embeddings of eight targets, with the second map's value and the brightness of each."""
    from ..sources.readers import table

    e = table(spark, d, "embeddings")
    return e.select("vec_id", "embedding", (F.col("vec_id") % 8).alias("t"), ((F.col("label") + F.col("vec_id") % 7) / 20.0).alias("agree"), F.get("embedding", F.lit(0)).cast("double").alias("bright"))


@query(f"""WITH r AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda q: q::DOUBLE) AS v, vec_id % 8 AS t, (label + vec_id % 7) / 20.0::DOUBLE AS agree FROM embeddings),
c0 AS MATERIALIZED (SELECT t, rn - 1 AS cluster, v AS c FROM (SELECT *, row_number() OVER (PARTITION BY t ORDER BY vec_id) AS rn, count(*) OVER (PARTITION BY t) AS n FROM r) WHERE rn <= greatest(2, least(6, n // 20))),
a0 AS MATERIALIZED ({_NEAREST_SQL.format(c='c0')}), c1 AS MATERIALIZED (SELECT t, cluster, {_AVG} AS c FROM a0 GROUP BY ALL), a1 AS MATERIALIZED ({_NEAREST_SQL.format(c='c1')}),
g AS (SELECT c1.*, m.agree FROM c1 JOIN (SELECT t, cluster, avg(agree) AS agree FROM a1 GROUP BY ALL) m USING (t, cluster)), s AS (SELECT t, max(agree) AS top, stddev_pop(agree) AS dev FROM g GROUP BY t),
p AS (SELECT t, [{_PROTO}] AS p FROM (SELECT g.t, c, exp((agree - top) / (dev + 1e-6)) AS w FROM g JOIN s USING (t)) GROUP BY t), q AS (SELECT t, list_transform(p, lambda z: z / (sqrt({_DOT.format(a='p', b='p')}) + 1e-6)) AS p FROM p),
z AS (SELECT a1.vec_id, a1.t, a1.cluster, {_DOT.format(a='a1.v', b='q.p')} AS sim FROM a1 JOIN q ON a1.t = q.t)
SELECT vec_id, t, cluster::INT AS cluster, round((sim - min(sim) OVER (PARTITION BY t)) / (max(sim) OVER (PARTITION BY t) - min(sim) OVER (PARTITION BY t) + 1e-6), 6) + 0.0 AS similarity FROM z""")
def agreement_prototypes(spark, d):
    """Tiles by their likeness to a prototype of clusters, weighted by their agreement with a second map."""
    from ..operators import prototypes

    tiles = _tiles_of(spark, d)
    assigned, centres = prototypes.clusters(tiles, ["t"], "vec_id", "embedding", _DIM, steps=1)
    out = prototypes.agreement(cut(assigned, "assigned"), centres, ["t"], "embedding", "agree", _DIM)
    return _six(out.select("vec_id", "t", "cluster", "similarity"), "similarity")


@query()
def pca_dark_high(spark, d):
    """The first principal axis of each target's tiles, turned against their brightness."""
    from ..operators import prototypes

    return _six(prototypes.principal(_tiles_of(spark, d), ["t"], "embedding", "bright", _DIM).select("vec_id", "t", "pc1"), "pc1")


# --- stores and rounds ------------------------------------------------------------------------------------------------


@query("""SELECT o_custkey, o_orderkey, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE o_orderstatus WHEN 'P' THEN 0 WHEN 'O' THEN 1 ELSE 2 END, o_orderkey DESC) AS rn FROM orders) WHERE rn = 1""")
def result_store(spark, d):
    """Three writes to a keyed store: each one's rows replace the earlier ones of the same customer."""
    from ..sources.readers import table
    from ..sources.store import ResultStore

    orders = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderstatus")
    store = ResultStore(spark, _folder(spark, "orders"), orders.schema, ["o_custkey"])
    for status in "FOP":
        store.upsert(orders.filter(F.col("o_orderstatus") == status), F.desc("o_orderkey"))
    return store.read()


def _folder(spark: SparkSession, name: str) -> str:
    import uuid

    from ..sources.scratch import folder

    return f"{folder(spark)}/{name}-{uuid.uuid4().hex}"


_WEIGHTS = {"v": (1, 0), "w": (0, 1), "2v+w": (2, 1), "v+2w": (1, 2)}
_STEPS = (0.3, 0.4, 0.5, 0.6, 0.7)
_CELLS_SQL = f"""WITH f AS MATERIALIZED ({_FIELD}), ws(name, a, b, o) AS (VALUES {', '.join(f"('{n}', {a}, {b}, {i})" for i, (n, (a, b)) in enumerate(_WEIGHTS.items()))}), ks(k, o) AS (VALUES {', '.join(f'({k}::DOUBLE, {i})' for i, k in enumerate(_STEPS))}),
c1 AS (SELECT 0 AS round, name || '@0.5' AS cell, o AS ordinal, a, b, 0.5::DOUBLE AS k FROM ws),"""
_IOU_SQL = """SELECT round, cell, ordinal, target, coalesce(count_if(hit AND pos) / nullif(count_if(hit OR pos), 0), 0) AS iou FROM (SELECT c.*, target, pos, round((a * v + b * w) / (a + b), 9) >= k AS hit FROM f, {c} c) GROUP BY ALL"""
_SUMS_SQL = "SELECT round, cell, ordinal, count(*) AS targets, round_even(avg(iou), 6) AS mean_iou, round_even(min(iou), 6) AS min_iou, round_even(0.5::DOUBLE * (avg(iou) + min(iou)), 6) AS robust FROM {r} GROUP BY ALL"


@query(f"""{_CELLS_SQL} r1 AS MATERIALIZED ({_IOU_SQL.format(c='c1')}), s1 AS MATERIALIZED ({_SUMS_SQL.format(r='r1')}), w1 AS (SELECT split_part(cell, '@', 1) AS name FROM s1 ORDER BY robust DESC, ordinal LIMIT 1),
c2 AS (SELECT 1 AS round, ws.name || '@' || k AS cell, ks.o AS ordinal, a, b, k FROM ws JOIN w1 USING (name), ks), r2 AS MATERIALIZED ({_IOU_SQL.format(c='c2')}), s2 AS MATERIALIZED ({_SUMS_SQL.format(r='r2')})
SELECT *, row_number() OVER (PARTITION BY round ORDER BY robust DESC, ordinal) = 1 AS won FROM (SELECT * FROM s1 UNION ALL SELECT * FROM s2)""")
def staged_sweep(spark, d):
    """Two rounds: weights of two maps at one threshold, then thresholds for the winning weights; scores against the truth."""
    from ..operators import rounds
    from ..sources.store import ResultStore

    px = cut(_field(spark, d).select("target", "v", "w", "pos"), "maps")

    def evaluate(cells: list[str]) -> DataFrame:
        def score(cell: str):
            name, k = cell.split("@")
            a, b = _WEIGHTS[name]
            hit = F.round((a * F.col("v") + b * F.col("w")) / (a + b), 9) >= float(k)
            iou = F.coalesce(F.try_divide(F.count_if(hit & F.col("pos")).cast("double"), F.count_if(hit | F.col("pos"))), F.lit(0.0))
            return F.struct(F.lit(cell).alias("cell"), iou.alias("iou"))

        return px.groupBy("target").agg(F.array(*[score(c) for c in cells]).alias("z")).select("target", F.explode("z").alias("z")).select("z.cell", "target", "z.iou")

    grid = [lambda won: [f"{n}@0.5" for n in _WEIGHTS], lambda won: [f"{won[-1].split('@')[0]}@{k}" for k in _STEPS]]
    store = ResultStore(spark, _folder(spark, "sweep"), rounds.SCHEMA, rounds.KEYS)
    winners = rounds.run(store, grid, evaluate)
    won = F.array(*[F.lit(w) for w in winners])
    return rounds.summaries(store.read()).withColumn("won", F.get(won, F.col("round")) == F.col("cell"))
