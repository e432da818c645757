"""The engine's registered queries over the given tables, each with DuckDB's SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions import geometry as geo, numeric as num, text as txt
from ..operators import catalog, fusion, georef, metrics, models, neighbours, ordered, select
from ..sources import sinks
from ..sources.readers import table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _six(df: DataFrame, *columns: str) -> DataFrame:
    """Doubles that are sums in no fixed order, rounded alike on both sides; -0.0 becomes 0.0."""
    return df.withColumns({c: F.round(F.col(c), 6) + F.lit(0.0) for c in columns})


# --- experiments: a configuration is (returnflag, linestatus), a target a supplier, IoU the mean discount -------------

_ROWS = "SELECT l_returnflag || l_linestatus AS config, l_suppkey AS target, round(avg(l_discount), 6) AS iou, CASE WHEN l_suppkey % 5 <> 0 THEN round(avg(l_tax), 6) END AS cov FROM lineitem GROUP BY l_returnflag, l_linestatus, l_suppkey"
_SUMMARY = f"""SELECT config, round_even(avg(iou), 4) AS mean_iou, round_even(median(iou), 4) AS median_iou, round_even(min(iou), 4) AS min_iou, round_even(max(iou), 4) AS max_iou,
round_even(avg(cov), 4) AS mean_cov, round_even(0.5::DOUBLE * (avg(iou) + min(iou)), 6) AS robust FROM ({_ROWS}) GROUP BY config"""


def _experiment_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").groupBy(F.concat("l_returnflag", "l_linestatus").alias("config"), F.col("l_suppkey").alias("target"))
    rows = rows.agg(F.round(F.avg("l_discount"), 6).alias("iou"), F.round(F.avg("l_tax"), 6).alias("cov"))
    return rows.withColumn("cov", F.when(F.col("target") % 5 != 0, F.col("cov")))


@query(_SUMMARY)
def robust_config_summary(spark, d):
    return metrics.config_summary(_experiment_rows(spark, d), ["config"])


@query(f"SELECT config, robust FROM ({_SUMMARY}) ORDER BY robust DESC, config LIMIT 1")
def argmax_config(spark, d):
    return metrics.config_summary(_experiment_rows(spark, d), ["config"]).select("config", "robust").orderBy(F.desc("robust"), "config").limit(1)


@query(f"SELECT config, count(*) AS n, count(cov) AS n_cov, round(avg(cov), 4) AS mean_cov FROM ({_ROWS}) GROUP BY config")
def null_skip_mean(spark, d):
    return _experiment_rows(spark, d).groupBy("config").agg(F.count(F.lit(1)).alias("n"), F.count("cov").alias("n_cov"), F.round(F.avg("cov"), 4).alias("mean_cov"))


@query(f"""SELECT 'max' AS kind, config, max(iou) AS iou, round(avg(cov), 4) AS cov FROM ({_ROWS}) WHERE config LIKE 'R%' GROUP BY config
UNION ALL SELECT 'mean', config, round(avg(iou), 4), round(avg(cov), 4) FROM ({_ROWS}) WHERE config NOT LIKE 'R%' GROUP BY config""")
def comparison_table(spark, d):
    rows = _experiment_rows(spark, d)
    part = lambda kind, df, iou: df.groupBy("config").agg(iou.alias("iou"), F.round(F.avg("cov"), 4).alias("cov")).select(F.lit(kind).alias("kind"), "config", "iou", "cov")
    is_max = F.col("config").startswith("R")
    return part("max", rows.filter(is_max), F.max("iou")).unionByName(part("mean", rows.filter(~is_max), F.round(F.avg("iou"), 4)))


@query(f"SELECT target, config, iou FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY iou DESC, config) AS rn FROM ({_ROWS})) WHERE rn = 1")
def best_config_per_target(spark, d):
    return select.first_by(_experiment_rows(spark, d), ["target"], F.desc("iou"), F.col("config")).select("target", "config", "iou")


@query(f"SELECT target, {', '.join(f'max(iou) FILTER (config = {c!r}) AS {c.lower()}' for c in ('AF', 'NF', 'NO', 'RF'))} FROM ({_ROWS}) GROUP BY target")
def variant_pivot(spark, d):
    out = _experiment_rows(spark, d).groupBy("target").pivot("config", ["AF", "NF", "NO", "RF"]).agg(F.max("iou"))
    return out.toDF(*[c.lower() for c in out.columns])


@query("""SELECT coalesce(n.o_custkey, o.o_custkey) AS o_custkey, coalesce(n.k, o.k) AS k, (n.o_custkey IS NOT NULL) AS renewed
FROM (SELECT o_custkey, max(o_orderkey) AS k FROM orders WHERE o_orderstatus <> 'F' GROUP BY o_custkey) n
FULL JOIN (SELECT o_custkey, max(o_orderkey) AS k FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey) o ON n.o_custkey = o.o_custkey""")
def upsert_latest(spark, d):
    orders = table(spark, d, "orders")
    of = lambda kept, new: orders.filter(kept).groupBy("o_custkey").agg(F.max("o_orderkey").alias("k")).withColumn("renewed", F.lit(new))
    return select.latest(of("o_orderstatus = 'F'", False), of("o_orderstatus <> 'F'", True), ["o_custkey"])


# --- masks and ranking ------------------------------------------------------------------------------------------------

_PX = "(l_discount >= 0.05) AS pred, (l_returnflag = 'R') AS pos, (l_returnflag = 'A') AS neg"


def _mask():
    return [F.col("l_discount") >= 0.05, F.col("l_returnflag") == "R", F.col("l_returnflag") == "A"]


@query(f"""SELECT l_linestatus, tp / nullif(g, 0) AS coverage, coalesce(tp / nullif(u, 0), 0.0) AS mask_iou, fk / nullif(k, 0) AS fp_on_black,
o / n AS fp_area_frac, tp / nullif(p, 0) AS precision_pos, p / n AS pred_area_frac, p / greatest(g, 1) AS area_ratio
FROM (SELECT l_linestatus, count_if(pred) AS p, count_if(pos) AS g, count_if(neg) AS k, count_if(pred AND pos) AS tp, count_if(pred AND neg) AS fk, count_if(pred OR pos) AS u, count_if(pred AND NOT pos AND NOT neg) AS o, count(*) AS n
FROM (SELECT l_linestatus, {_PX} FROM lineitem) GROUP BY l_linestatus)""")
def mask_metrics(spark, d):
    return metrics.mask_scores(table(spark, d, "lineitem"), ["l_linestatus"], *_mask())


@query(f"""SELECT l_linestatus, CASE WHEN pred AND neg THEN 'fp_on_neg' WHEN pred AND pos THEN 'tp' WHEN pred THEN 'fp_other' ELSE 'none' END AS kind, count(*) AS n
FROM (SELECT l_linestatus, {_PX} FROM lineitem) GROUP BY ALL""")
def detection_classes(spark, d):
    pred, pos, neg = _mask()
    kind = F.when(pred & neg, "fp_on_neg").when(pred & pos, "tp").when(pred, "fp_other").otherwise("none")
    return table(spark, d, "lineitem").groupBy("l_linestatus", kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query("""WITH a AS (SELECT DISTINCT l_partkey FROM lineitem WHERE l_returnflag = 'R'), b AS (SELECT DISTINCT l_partkey FROM lineitem WHERE l_returnflag = 'A')
SELECT 'union' AS op, count(*) AS n FROM (SELECT * FROM a UNION SELECT * FROM b) UNION ALL SELECT 'intersect', count(*) FROM (SELECT * FROM a INTERSECT SELECT * FROM b)
UNION ALL SELECT 'except', count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b)""")
def mask_setops(spark, d):
    flags = table(spark, d, "lineitem").filter(F.col("l_returnflag").isin("R", "A")).groupBy("l_partkey")
    flags = flags.agg(F.bool_or(F.col("l_returnflag") == "R").alias("a"), F.bool_or(F.col("l_returnflag") == "A").alias("b"))
    a, b = F.col("a"), F.col("b")
    counts = flags.agg(F.count_if(a | b).alias("u"), F.count_if(a & b).alias("i"), F.count_if(a & ~b).alias("e"))
    return counts.select(F.explode(F.array(*[F.struct(F.lit(k).alias("op"), F.col(c).alias("n")) for k, c in (("union", "u"), ("intersect", "i"), ("except", "e"))])).alias("z")).select("z.*")


_AUROC = """SELECT {key}, round(sum(w) / nullif(sum(p) * sum(n), 0), 6) AS auroc FROM (SELECT {key}, p, n, p * (coalesce(sum(n) OVER (PARTITION BY {key} ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + n / 2) AS w
FROM (SELECT {key}, {score} AS s, count_if({pos})::DOUBLE AS p, count_if(NOT {pos})::DOUBLE AS n FROM {src} GROUP BY ALL)) GROUP BY {key}"""


@query(_AUROC.format(key="l_linestatus", score="l_quantity", pos="(l_returnflag = 'R')", src="lineitem"))
def auroc_rank(spark, d):
    return _six(metrics.auroc(table(spark, d, "lineitem"), ["l_linestatus"], F.col("l_quantity"), F.col("l_returnflag") == "R"), "auroc")


@query("""SELECT t AS threshold, round(tp / (u + 1e-6), 6) AS iou FROM (SELECT t, count_if(s >= t AND pos) AS tp, count_if(s >= t OR pos) AS u
FROM (SELECT l_quantity / 50 AS s, l_returnflag = 'R' AS pos FROM lineitem), (SELECT round(0.1 + k * 0.05, 2)::DOUBLE AS t FROM range(0, 13) r(k)) GROUP BY t) ORDER BY iou DESC, threshold LIMIT 1""")
def best_threshold(spark, d):
    score, pos = F.col("l_quantity") / 50, F.col("l_returnflag") == "R"
    row = lambda t: F.struct(F.lit(t).alias("threshold"), F.count_if((score >= t) & pos).alias("tp"), F.count_if((score >= t) | pos).alias("u"))
    each = table(spark, d, "lineitem").agg(F.array(*[row(round(0.1 + k * 0.05, 2)) for k in range(13)]).alias("z")).select(F.explode("z").alias("z")).select("z.*")
    return each.select("threshold", F.round(F.col("tp") / (F.col("u") + F.lit(1e-6)), 6).alias("iou")).orderBy(F.desc("iou"), "threshold").limit(1)


_EVENT_VALUES = "(SELECT event_id, event_type, value FROM events WHERE value IS NOT NULL)"


def _events(spark, d):
    return table(spark, d, "events").filter("value IS NOT NULL").select("event_id", "event_type", "value")


@query(f"SELECT event_type, t::DOUBLE AS threshold, count_if(value >= t) AS n FROM {_EVENT_VALUES}, (SELECT unnest([0, 10, 25, 50, 75, 100]) AS t) GROUP BY ALL")
def threshold_sweep(spark, d):
    return select.sweep(_events(spark, d), ["event_type"], "value", [0, 10, 25, 50, 75, 100])


_PCT = [55, 65, 75, 85]
_STABLE = [55, 62, 70, 78, 86]


def _limits(events: DataFrame, percents: list[int]) -> DataFrame:
    q = ordered.percentiles(events, ["event_type"], "value", [p / 100 for p in percents])
    return q.select("event_type", *[F.get("q", F.lit(i)).alias(f"q{p}") for i, p in enumerate(percents)])


@query(f"""WITH q AS (SELECT event_type, {', '.join(f'quantile_cont(value, {p / 100}) AS q{p}' for p in _PCT)} FROM {_EVENT_VALUES} GROUP BY event_type)
SELECT event_type, {', '.join(f'count_if(value >= q{p}) AS n{p}' for p in _PCT)} FROM {_EVENT_VALUES} JOIN q USING (event_type) GROUP BY event_type""")
def multi_percentile(spark, d):
    e = _events(spark, d)
    q = _limits(e, _PCT)
    return e.join(q, "event_type").groupBy("event_type").agg(*[F.count_if(F.col("value") >= F.col(f"q{p}")).alias(f"n{p}") for p in _PCT])


@query(f"""WITH q AS (SELECT event_type, {', '.join(f'quantile_cont(value, {p / 100}) AS q{p}' for p in _STABLE)} FROM {_EVENT_VALUES} GROUP BY event_type)
SELECT event_id, ({' + '.join(f'(value >= q{p})::INT' for p in _STABLE)})::INT AS votes FROM {_EVENT_VALUES} JOIN q USING (event_type) WHERE {' + '.join(f'(value >= q{p})::INT' for p in _STABLE)} >= 3""")
def stability_count(spark, d):
    e = _events(spark, d)
    q = _limits(e, _STABLE)
    votes = sum((F.col("value") >= F.col(f"q{p}")).cast("int") for p in _STABLE)
    return e.join(q, "event_type").select("event_id", votes.alias("votes")).filter("votes >= 3")


# --- normalisation and fusion -----------------------------------------------------------------------------------------

_Q = "quantile_cont({v}, 0.01) AS lo, quantile_cont({v}, 0.99) AS hi"


@query(f"""SELECT event_id, round(greatest(0, least(1, (value - lo) / (hi - lo + 1e-6))), 6) AS v FROM {_EVENT_VALUES} JOIN (SELECT event_type, {_Q.format(v='value')} FROM {_EVENT_VALUES} GROUP BY event_type) USING (event_type)""")
def norm01(spark, d):
    return _six(num.norm01(_events(spark, d), ["event_type"], "value", "v").select("event_id", "v"), "v")


@query(f"""SELECT event_id, round(coalesce((value - lo) / nullif(hi - lo, 0), 0), 6) AS v FROM {_EVENT_VALUES} JOIN (SELECT event_type, min(value) AS lo, max(value) AS hi FROM {_EVENT_VALUES} GROUP BY event_type) USING (event_type)""")
def minmax(spark, d):
    return _six(num.minmax(_events(spark, d), ["event_type"], "value", "v").select("event_id", "v"), "v")


@query(f"""SELECT event_id, round((row_number() OVER w - 1) / nullif(count(*) OVER (PARTITION BY event_type) - 1, 0), 6) AS v FROM {_EVENT_VALUES} WINDOW w AS (PARTITION BY event_type ORDER BY value, event_id)""")
def pixel_rank(spark, d):
    return _six(num.pixel_rank(_events(spark, d), ["event_type"], "value", ["event_id"], "v").select("event_id", "v"), "v")


_MAPS = ("l_quantity", "l_extendedprice", "l_tax")


def _score_maps(spark, d):
    """Three normalised maps of one target a supplier; a pixel is a line of an order."""
    px = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", *_MAPS)
    q = px.groupBy("l_suppkey").agg(*[F.percentile(c, [0.01, 0.99]).alias(f"q_{c}") for c in _MAPS])
    px = px.join(q, "l_suppkey")
    scaled = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col(c) - F.get(f"q_{c}", F.lit(0))) / (F.get(f"q_{c}", F.lit(1)) - F.get(f"q_{c}", F.lit(0)) + F.lit(1e-6))))
    return px.select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", F.col("l_extendedprice").alias("p"), *[scaled(c).alias(n) for c, n in zip(_MAPS, "abc", strict=True)])


_MAPS_SQL = f"""SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey, l_extendedprice, {', '.join(f'greatest(0, least(1, ({c} - lo_{n}) / (hi_{n} - lo_{n} + 1e-6))) AS {n}' for c, n in zip(_MAPS, 'abc', strict=True))}
FROM lineitem JOIN (SELECT l_suppkey, {', '.join(f'quantile_cont({c}, 0.01) AS lo_{n}, quantile_cont({c}, 0.99) AS hi_{n}' for c, n in zip(_MAPS, 'abc', strict=True))} FROM lineitem GROUP BY l_suppkey) USING (l_suppkey)"""
_RANKS_SQL = f"SELECT l_orderkey, l_linenumber, {', '.join(f'(row_number() OVER (PARTITION BY l_suppkey ORDER BY round({n}, 9), l_orderkey, l_linenumber, l_partkey, l_extendedprice) - 1) / nullif(count(*) OVER (PARTITION BY l_suppkey) - 1, 0) AS {n}' for n in 'abc')} FROM ({_MAPS_SQL})"
_FUSED_SQL = {
    "weighted_avg": "(2 * a + b + c) / 4",
    "geometric_mean": "exp((ln(a + 1e-3) + ln(b + 1e-3) + ln(c + 1e-3)) / 3)",
    "rank_avg": "(a + b + c) / 3",
    "min": "least(a, b, c)",
    "max": "greatest(a, b, c)",
    "gate": "a * (0.4 + 0.6 * (b + c) / 2)",
}


def _fusion(rule: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        maps = _score_maps(spark, d)
        if rule == "rank_avg":
            for n in "abc":
                maps = num.pixel_rank(maps.withColumn(n, F.round(n, 9)), ["l_suppkey"], n, ["l_orderkey", "l_linenumber", "l_partkey", "p"], n)
        fused = fusion.fuse(rule, [F.col(n) for n in "abc"], [2.0, 1.0, 1.0] if rule == "weighted_avg" else None)
        return _six(maps.select("l_orderkey", "l_linenumber", fused.alias("v")), "v")

    return run


for _rule, _sql in _FUSED_SQL.items():
    QUERIES[f"fusion_{_rule}"] = _fusion(_rule)
    ORACLE_SQL[f"fusion_{_rule}"] = f"SELECT l_orderkey, l_linenumber, round({_sql}, 6) + 0.0 AS v FROM ({_RANKS_SQL if _rule == 'rank_avg' else _MAPS_SQL})"


@query("""WITH z AS (SELECT p_partkey, 20 + p_size AS w, 20 + 2 * p_size AS h FROM part), s AS (SELECT p_partkey, greatest(w - 16, 0) AS lx, greatest(h - 16, 0) AS ly FROM z),
x AS (SELECT DISTINCT p_partkey, unnest(list_append(range(0, lx + 1, 8), lx)) AS tx FROM s), y AS (SELECT DISTINCT p_partkey, unnest(list_append(range(0, ly + 1, 8), ly)) AS ty FROM s)
SELECT p_partkey, tx::INT AS tx, ty::INT AS ty FROM x JOIN y USING (p_partkey)""")
def tile_grid(spark, d):
    part = table(spark, d, "part")
    return fusion.tiles(part, 20 + F.col("p_size"), 20 + 2 * F.col("p_size"), 16, 0.5).select("p_partkey", "tx", "ty")


@query("""WITH t AS (SELECT p_partkey, tx, ty, (p_retailprice + 3 * tx + 5 * ty) / 100 AS v FROM part, (SELECT unnest([0, 4, 8]) AS tx), (SELECT unnest([0, 4, 8]) AS ty)),
p AS (SELECT p_partkey, ty + dy AS y, tx + dx AS x, v, greatest(1e-3, (0.5 - 0.5 * cos(2 * pi() * dy / 7)) * (0.5 - 0.5 * cos(2 * pi() * dx / 7))) AS w FROM t, range(0, 8) a(dy), range(0, 8) b(dx))
SELECT p_partkey, y::INT AS y, x::INT AS x, round(sum(v * w) / greatest(sum(w), 1e-6), 6) AS v FROM p GROUP BY ALL""")
def blend_tiles(spark, d):
    part = table(spark, d, "part")
    tiled = fusion.tiles(part, F.lit(16), F.lit(16), 8, 0.5).withColumn("s", (F.col("p_retailprice") + 3 * F.col("tx") + 5 * F.col("ty")) / 100)
    return _six(fusion.blend(tiled.select("p_partkey", "tx", "ty", "s"), ["p_partkey"], "s", 8), "v")


# --- catalogue --------------------------------------------------------------------------------------------------------

_NAME_SQL = "('Luftbild ' || strftime(o_orderdate, '%d%m%Y') || '_' || o_orderkey || '/' || o_orderpriority || ' (é).tif')"


def _named(spark, d):
    o = table(spark, d, "orders")
    return o.withColumn("name", F.concat(F.lit("Luftbild "), F.date_format("o_orderdate", "ddMMyyyy"), F.lit("_"), F.col("o_orderkey").cast("string"), F.lit("/"), F.col("o_orderpriority"), F.lit(" (é).tif")))


@query("""WITH n AS (SELECT o_orderkey, o_orderdate, o_orderkey % 3 AS kind, CASE o_orderkey % 3 WHEN 0 THEN strftime(o_orderdate, '%d%m%Y') WHEN 1 THEN '32' || strftime(o_orderdate, '%m%Y') ELSE (1940 + o_orderkey % 90)::VARCHAR || ' und 1945-1945' END || '_' || o_orderkey || '.tif' AS name FROM orders),
y AS (SELECT *, list_sort(list_distinct(list_transform(list_filter(string_split_regex(name, '[^0-9]+'), lambda s: length(s) = 4 AND s[1:2] IN ('19', '20')), lambda s: s::INT))) AS years FROM n)
SELECT o_orderkey, CASE WHEN kind = 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS photo_date, array_to_string(years, ',') AS years, CASE WHEN kind = 0 THEN year(o_orderdate)::INT ELSE years[1] END AS y FROM y""")
def date_years_regex(spark, d):
    """Dates and years of names: a third with a date, a third with a day out of range, a third with years alone."""
    key, day = F.col("o_orderkey"), F.date_format("o_orderdate", "ddMMyyyy")
    told = F.when(key % 3 == 0, day).when(key % 3 == 1, F.concat(F.lit("32"), F.substring(day, 3, 6))).otherwise(F.concat((1940 + key % 90).cast("string"), F.lit(" und 1945-1945")))
    named = table(spark, d, "orders").withColumn("name", F.concat(told, F.lit("_"), key.cast("string"), F.lit(".tif")))
    date, years = txt.photo_date(F.col("name")), txt.years_in_name(F.col("name"))
    return named.select("o_orderkey", date.alias("photo_date"), F.array_join(years, ",").alias("years"), txt.derived_year(date, years).alias("y"))


@query(f"SELECT o_orderkey, regexp_replace({_NAME_SQL}, '[^\\p{{L}}\\p{{N}}._-]', '_', 'g') AS stem FROM orders")
def safe_stem(spark, d):
    return _named(spark, d).select("o_orderkey", txt.safe_stem(F.col("name")).alias("stem"))


@query("SELECT doc_id, substr(sha256(encode(text) || encode(strlen(text)::VARCHAR)), 1, 16) AS h FROM documents")
def head_hash(spark, d):
    return table(spark, d, "documents").select("doc_id", txt.head_hash(F.col("text").cast("binary")).alias("h"))


@query("""SELECT page_id, CASE WHEN ink > 300 OR panel THEN 'annotated' ELSE 'original' END AS role, CASE WHEN panel AND mp < 6 THEN 'map_layout' WHEN ink > 300 OR panel THEN 'example_crop' ELSE 'orthophoto' END AS subtype
FROM (SELECT page_id, length(html) - length(replace(html, 'e', '')) AS ink, contains(url, '?') AS panel, length(html) / 1000.0::DOUBLE AS mp FROM pages)""")
def classify_catalog(spark, d):
    ink = F.length("html") - F.length(F.replace("html", F.lit("e")))
    role, subtype = catalog.classify(ink, F.contains("url", F.lit("?")), F.length("html") / 1000.0)
    return table(spark, d, "pages").select("page_id", role.alias("role"), subtype.alias("subtype"))


@query("""SELECT a.o_orderkey, p.paired FROM (SELECT *, year(o_orderdate) AS y FROM orders WHERE o_orderstatus = 'O') a
LEFT JOIN (SELECT year(o_orderdate) AS y, max('o' || lpad(o_orderkey::VARCHAR, 12, '0')) AS paired FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) p ON a.y = p.y""")
def pair_last_wins(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", F.year("o_orderdate").alias("y"), F.concat(F.lit("o"), F.lpad(F.col("o_orderkey").cast("string"), 12, "0")).alias("name"))
    return catalog.pair_by_year(o.filter("o_orderstatus = 'O'"), o.filter("o_orderstatus = 'F'"), "y", "name").select("o_orderkey", "paired")


@query("SELECT c_custkey, coalesce(CASE WHEN n_regionkey = 2 THEN upper(n_name) END, c_mktsegment) AS c_mktsegment FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey")
def override_left(spark, d):
    given = table(spark, d, "nation").filter("n_regionkey = 2").select(F.col("n_nationkey").alias("c_nationkey"), F.upper("n_name").alias("c_mktsegment"))
    return catalog.override(table(spark, d, "customer"), given, "c_nationkey", ["c_mktsegment"]).select("c_custkey", "c_mktsegment")


@query("""SELECT c_custkey, o_orderkey FROM customer LEFT JOIN (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM orders) ON c_custkey = o_custkey AND rn = 1""")
def first_match(spark, d):
    first = select.first_by(table(spark, d, "orders"), ["o_custkey"], F.col("o_orderdate"), F.col("o_orderkey")).select(F.col("o_custkey").alias("c_custkey"), "o_orderkey")
    return table(spark, d, "customer").select("c_custkey").join(first, "c_custkey", "left")


@query("SELECT l_suppkey, count_if(l_returnflag = 'A') AS a, count_if(l_returnflag = 'N') AS n, count_if(l_returnflag = 'R') AS r FROM lineitem GROUP BY l_suppkey")
def pivot_colors(spark, d):
    out = table(spark, d, "lineitem").groupBy("l_suppkey").pivot("l_returnflag", ["A", "N", "R"]).agg(F.count(F.lit(1)))
    return out.na.fill(0).toDF("l_suppkey", "a", "n", "r")


@query("SELECT quality, toxic, count(*) AS n FROM labels GROUP BY ALL")
def class_totals(spark, d):
    return table(spark, d, "labels").groupBy("quality", "toxic").agg(F.count(F.lit(1)).alias("n"))


# --- georeferencing and geometry --------------------------------------------------------------------------------------


@query("""SELECT v.s_nationkey, v.s_suppkey AS vertical, h.c_custkey AS horizontal FROM supplier v JOIN customer h ON v.s_nationkey = h.c_nationkey""")
def gcp_cross(spark, d):
    v = table(spark, d, "supplier").select("s_nationkey", F.col("s_suppkey").alias("vertical"))
    h = table(spark, d, "customer").select(F.col("c_nationkey").alias("s_nationkey"), F.col("c_custkey").alias("horizontal"))
    return georef.control_points(v, h, ["s_nationkey"], 16)


_GCP_SQL = "SELECT l_suppkey, l_quantity AS px, l_linenumber * 10.0::DOUBLE AS py, 1000 + 2 * l_quantity - 0.5::DOUBLE * l_linenumber * 10 + l_tax AS wx, 500 - 0.25::DOUBLE * l_quantity - 2 * l_linenumber * 10 + l_discount AS wy FROM lineitem"


def _gcps(spark, d):
    q, n = F.col("l_quantity"), F.col("l_linenumber") * 10.0
    return table(spark, d, "lineitem").select("l_suppkey", q.alias("px"), n.alias("py"), (1000 + 2 * q - 0.5 * n + F.col("l_tax")).alias("wx"), (500 - 0.25 * q - 2 * n + F.col("l_discount")).alias("wy"))


_GCP_SUMS = f"""WITH g AS ({_GCP_SQL}), c AS (SELECT l_suppkey, avg(px) AS mx, avg(py) AS my, avg(wx) AS ox, avg(wy) AS oy FROM g GROUP BY l_suppkey),
s AS (SELECT l_suppkey, sum((px - mx) * (px - mx)) AS uu, sum((px - mx) * (py - my)) AS uv, sum((py - my) * (py - my)) AS vv, sum((px - mx) * (wx - ox)) AS ux, sum((py - my) * (wx - ox)) AS vx, sum((px - mx) * (wy - oy)) AS uy, sum((py - my) * (wy - oy)) AS vy FROM g JOIN c USING (l_suppkey) GROUP BY l_suppkey)"""


@query(f"""{_GCP_SUMS}
SELECT l_suppkey, round((ux * vv - vx * uv) / (uu * vv - uv * uv), 6) AS a, round((vx * uu - ux * uv) / (uu * vv - uv * uv), 6) AS b, round((uy * vv - vy * uv) / (uu * vv - uv * uv), 6) AS dd, round((vy * uu - uy * uv) / (uu * vv - uv * uv), 6) AS e FROM s""")
def affine_fit(spark, d):
    fit = georef.fit_affine(_gcps(spark, d), ["l_suppkey"], "px", "py", "wx", "wy")
    at = {1: "a", 2: "b", 4: "dd", 5: "e"}
    return _six(fit.select("l_suppkey", *[F.get("gt", F.lit(i)).alias(n) for i, n in at.items()]), *at.values())


@query(f"""{_GCP_SUMS},
k AS (SELECT l_suppkey, (ux * vv - vx * uv) / (uu * vv - uv * uv) AS a, (vx * uu - ux * uv) / (uu * vv - uv * uv) AS b, (uy * vv - vy * uv) / (uu * vv - uv * uv) AS p, (vy * uu - uy * uv) / (uu * vv - uv * uv) AS q FROM s),
r AS (SELECT l_suppkey, power(a * (px - mx) + b * (py - my) - (wx - ox), 2) + power(p * (px - mx) + q * (py - my) - (wy - oy), 2) AS f FROM g JOIN c USING (l_suppkey) JOIN k USING (l_suppkey))
SELECT l_suppkey, round(sqrt(avg(f)), 6) AS rmse, round(sqrt(max(f)), 6) AS max_residual FROM r GROUP BY l_suppkey""")
def affine_residuals(spark, d):
    gcps = _gcps(spark, d)
    out = georef.residuals(gcps, georef.fit_affine(gcps, ["l_suppkey"], "px", "py", "wx", "wy"), ["l_suppkey"], "px", "py", "wx", "wy")
    return _six(out, "rmse", "max_residual")


def _rings(spark, d):
    """A rectangle a part, with a notch."""
    s = F.col("p_size").cast("double")
    point = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    zero = F.lit(0.0)
    ring = F.array(point(zero, zero), point(s, zero), point(s, 2 * s), point(s / 2, s), point(zero, 2 * s))
    return table(spark, d, "part").select("p_partkey", "p_brand", "p_retailprice", ring.alias("ring"))


@query("SELECT p_partkey, round(1.5::DOUBLE * p_size * p_size, 6) AS area, round(5::DOUBLE * p_size + 2 * sqrt(p_size * p_size / 4.0::DOUBLE + p_size * p_size), 6) AS perimeter FROM part")
def polygon_area_perimeter(spark, d):
    r = F.col("ring")
    return _six(_rings(spark, d).select("p_partkey", geo.ring_area(r).alias("area"), geo.ring_perimeter(r).alias("perimeter")), "area", "perimeter")


@query("SELECT p_partkey, round(10 + 0.5::DOUBLE * p_size - 0.25::DOUBLE * 2 * p_size, 6) AS x2, round(20 - 0.1::DOUBLE * p_size - 2.0::DOUBLE * 2 * p_size, 6) AS y2 FROM part")
def pixel_to_world(spark, d):
    gt = F.array(*[F.lit(v) for v in (10.0, 0.5, -0.25, 20.0, -0.1, -2.0)])
    third = F.get(geo.to_world(F.col("ring"), gt), F.lit(2))
    return _six(_rings(spark, d).select("p_partkey", third["x"].alias("x2"), third["y"].alias("y2")), "x2", "y2")


@query()
def geojson_export(spark, d):
    feature = geo.feature(F.col("p_partkey"), F.col("ring"), F.struct("p_brand", "p_retailprice"))
    sheets = _rings(spark, d).withColumn("sheet", F.floor(F.col("p_partkey") / 1000))  # a collection is a sheet's polygons, at most 1000
    return sinks.feature_collections(sheets, ["p_brand", "sheet"], feature, F.col("p_partkey"))


_BOX = "{k}, {x} AS x0, {y} AS y0, {x} + 40 AS x1, {y} + 30 AS y1"


@query("""WITH p AS (SELECT c_custkey, c_nationkey AS n, (c_custkey * 7 % 100)::DOUBLE AS x0, (c_custkey * 13 % 100)::DOUBLE AS y0 FROM customer), g AS (SELECT s_nationkey AS n, (s_suppkey * 11 % 100)::DOUBLE AS x0, (s_suppkey * 17 % 100)::DOUBLE AS y0 FROM supplier),
o AS (SELECT c_custkey, greatest(0, least(p.x0, g.x0) + 40 - greatest(p.x0, g.x0)) * greatest(0, least(p.y0, g.y0) + 30 - greatest(p.y0, g.y0)) AS i FROM p JOIN g USING (n)) SELECT c_custkey, round(max(i / (2400 - i)), 6) AS best_iou FROM o GROUP BY c_custkey""")
def box_iou_best(spark, d):
    box = lambda k, a, b: [(F.col(k) * a % 100).cast("double"), (F.col(k) * b % 100).cast("double")]
    p = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("n"), *[c.alias(f"p{i}") for i, c in enumerate(box("c_custkey", 7, 13))])
    g = table(spark, d, "supplier").select(F.col("s_nationkey").alias("n"), *[c.alias(f"g{i}") for i, c in enumerate(box("s_suppkey", 11, 17))])
    best = geo.best_iou(p, g, ["n"], ["p0", "p1"], ["g0", "g1"], 40, 30)
    return p.join(best, ["n", "p0", "p1"]).groupBy("c_custkey").agg(F.round(F.max("iou"), 6).alias("best_iou"))


@query("""SELECT user_id, island, epoch(min(ts))::BIGINT AS first, epoch(max(ts))::BIGINT AS last, count(*) AS n FROM (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island
FROM (SELECT user_id, ts, event_id, CASE WHEN floor(epoch(ts)) - lag(floor(epoch(ts))) OVER (PARTITION BY user_id ORDER BY ts, event_id) > 21600 THEN 1 ELSE 0 END AS new FROM events)) GROUP BY ALL""".replace("epoch(min(ts))::BIGINT", "floor(epoch(min(ts)))::BIGINT").replace("epoch(max(ts))::BIGINT", "floor(epoch(max(ts)))::BIGINT"))
def gap_islands(spark, d):
    e = table(spark, d, "events").select("user_id", F.unix_timestamp("ts").alias("at"))
    return select.islands(e, ["user_id"], "at", 21600).drop("middle")


@query("""WITH s AS (SELECT p_brand, p_size AS pos, sum(p_retailprice) AS v FROM part GROUP BY ALL), k AS (SELECT *, max(v) OVER (PARTITION BY p_brand) AS top FROM s),
f AS (SELECT p_brand, pos, CASE WHEN pos - lag(pos) OVER (PARTITION BY p_brand ORDER BY pos) > 2 THEN 1 ELSE 0 END AS new FROM k WHERE v > 0.45 * top),
g AS (SELECT p_brand, pos, sum(new) OVER (PARTITION BY p_brand ORDER BY pos) AS island FROM f) SELECT p_brand, round_even((min(pos) + max(pos)) / 2.0, 0) AS line FROM g GROUP BY p_brand, island""")
def graticule_lines(spark, d):
    sums = table(spark, d, "part").groupBy("p_brand", F.col("p_size").alias("at")).agg(F.sum("p_retailprice").alias("v"))
    peaks = sums.withColumn("top", F.max("v").over(Window.partitionBy("p_brand"))).filter(F.col("v") > 0.45 * F.col("top"))
    return select.islands(peaks, ["p_brand"], "at", 2).select("p_brand", F.col("middle").alias("line"))


# --- selection --------------------------------------------------------------------------------------------------------


@query("""WITH a AS (SELECT *, round_even(l_extendedprice / 100, -1) AS cy, round_even(l_quantity, -1) AS cx FROM lineitem), b AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey, cy, cx ORDER BY l_tax DESC, l_orderkey, l_linenumber, l_partkey) AS r1 FROM a)
SELECT l_suppkey, l_orderkey, l_linenumber, rank FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_tax DESC, l_orderkey, l_linenumber, l_partkey)::INT AS rank FROM b WHERE r1 = 1) WHERE rank <= 6""")
def top_k_dedupe(spark, d):
    rows = table(spark, d, "lineitem").withColumn("y", F.col("l_extendedprice") / 100)
    order = (F.desc("l_tax"), F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey"))
    return select.top_k_spread(rows, ["l_suppkey"], "y", "l_quantity", 6, *order).select("l_suppkey", "l_orderkey", "l_linenumber", "rank")


@query("""WITH r AS (SELECT l_suppkey, l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber) - 1 AS i, count(*) OVER (PARTITION BY l_suppkey) AS n FROM lineitem)
SELECT l_suppkey, l_orderkey, l_linenumber FROM r WHERE i IN (0, (n - 1) // 4, 2 * (n - 1) // 4, 3 * (n - 1) // 4, n - 1)""")
def evenly_spaced_sample(spark, d):
    w = Window.partitionBy("l_suppkey")
    r = table(spark, d, "lineitem").withColumn("i", F.row_number().over(w.orderBy("l_orderkey", "l_linenumber")) - 1).withColumn("n", F.count(F.lit(1)).over(w))
    return r.filter(F.array_contains(F.transform(F.sequence(F.lit(0), F.lit(4)), lambda k: F.floor(k * (F.col("n") - 1) / 4)), F.col("i").cast("long"))).select("l_suppkey", "l_orderkey", "l_linenumber")


@query()
def seeded_sample(spark, d):
    return table(spark, d, "lineitem").orderBy(F.xxhash64("l_orderkey", "l_linenumber", F.lit(42)), "l_orderkey", "l_linenumber").limit(20_000).select("l_orderkey", "l_linenumber")


@query()
def spaced_points(spark, d):
    px = table(spark, d, "lineitem").select("l_suppkey", F.col("l_extendedprice").alias("y"), F.col("l_quantity").alias("x"), F.col("l_tax").alias("s"))
    return select.spaced_points(px, ["l_suppkey"], "y", "x", "s", 6, 500.0)


_OTSU_BINS = 64


@query(f"""WITH m AS (SELECT l_returnflag AS f, min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem GROUP BY 1), h AS (SELECT f, least({_OTSU_BINS - 1}, floor((l_extendedprice - lo) / (hi - lo) * {_OTSU_BINS}))::INT AS b, count(*)::DOUBLE AS n FROM lineitem JOIN m ON f = l_returnflag GROUP BY 1, 2),
c AS (SELECT f, b, sum(n) OVER w AS n0, sum(n * b) OVER w AS s0, sum(n) OVER (PARTITION BY f) AS nt, sum(n * b) OVER (PARTITION BY f) AS st FROM h WINDOW w AS (PARTITION BY f ORDER BY b)),
v AS (SELECT f, b, CASE WHEN n0 < nt THEN round(n0 * (nt - n0) * power(s0 / n0 - (st - s0) / (nt - n0), 2), 3) END AS between_ FROM c) SELECT f AS l_returnflag, b AS threshold_bin FROM (SELECT *, row_number() OVER (PARTITION BY f ORDER BY between_ DESC NULLS LAST, b) AS rn FROM v) WHERE rn = 1""")
def otsu_threshold(spark, d):
    px = table(spark, d, "lineitem").select("l_returnflag", "l_extendedprice")
    scaled = num.minmax(px, ["l_returnflag"], "l_extendedprice", "v")
    h = scaled.groupBy("l_returnflag", F.least(F.lit(_OTSU_BINS - 1), F.floor(F.col("v") * _OTSU_BINS)).cast("int").alias("b")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    w, whole = Window.partitionBy("l_returnflag").orderBy("b"), Window.partitionBy("l_returnflag")
    nb = F.col("n") * F.col("b")
    c = h.select("l_returnflag", "b", F.sum("n").over(w).alias("n0"), F.sum(nb).over(w).alias("s0"), F.sum("n").over(whole).alias("nt"), F.sum(nb).over(whole).alias("st"))
    n1 = F.col("nt") - F.col("n0")
    between = F.when(n1 > 0, F.round(F.col("n0") * n1 * F.pow(F.col("s0") / F.col("n0") - F.try_divide(F.col("st") - F.col("s0"), n1), 2), 3))
    return select.first_by(c.withColumn("s", between), ["l_returnflag"], F.desc_nulls_last("s"), F.col("b")).select("l_returnflag", F.col("b").alias("threshold_bin"))


# --- embeddings -------------------------------------------------------------------------------------------------------

_DIM = 64
_DOT = "list_sum(list_transform(range(1, 65), lambda i: {a}[i]::DOUBLE * {b}[i]::DOUBLE))"
_SUMS = ", ".join(f"sum(CASE WHEN {{c}} THEN embedding[{i}]::DOUBLE ELSE 0 END)" for i in range(1, 65))


_LOO = f"""WITH e AS (SELECT vec_id, embedding AS v, label < 5 AS y, vec_id % 8 AS t FROM embeddings), s AS (SELECT vec_id % 8 AS t, [{_SUMS.format(c='label < 5')}] AS p, [{_SUMS.format(c='label >= 5')}] AS q, count_if(label < 5) AS np, count_if(label >= 5) AS nq FROM embeddings GROUP BY 1)
SELECT vec_id, t, y, round(CASE WHEN y THEN ({_DOT.format(a='p', b='v')} - {_DOT.format(a='v', b='v')}) / greatest(np - 1, 1) - {_DOT.format(a='q', b='v')} / greatest(nq, 1) ELSE {_DOT.format(a='p', b='v')} / greatest(np, 1) - ({_DOT.format(a='q', b='v')} - {_DOT.format(a='v', b='v')}) / greatest(nq - 1, 1) END, 6) + 0.0 AS loo_score FROM e JOIN s USING (t)"""


@query(f"SELECT vec_id, loo_score FROM ({_LOO})")
def loo_prototype(spark, d):
    e = table(spark, d, "embeddings").withColumn("t", F.col("vec_id") % 8)
    return _six(metrics.loo_prototype_scores(e, ["t"], "embedding", F.col("label") < 5, _DIM).select("vec_id", "loo_score"), "loo_score")


@query(_AUROC.format(key="t", score="loo_score", pos="y", src=f"({_LOO})"))
def loo_auroc(spark, d):
    e = table(spark, d, "embeddings").withColumn("t", F.col("vec_id") % 8)
    return _six(metrics.auroc(metrics.loo_prototype_scores(e, ["t"], "embedding", F.col("label") < 5, _DIM), ["t"], F.col("loo_score"), F.col("label") < 5), "auroc")


@query(f"""WITH e AS (SELECT vec_id, embedding AS v, label, vec_id % 8 AS t FROM embeddings), p AS (SELECT a.vec_id, a.label, b.vec_id AS nn, b.label AS nn_label, row_number() OVER (PARTITION BY a.vec_id ORDER BY round({_DOT.format(a='a.v', b='b.v')}, 9) DESC, b.vec_id) AS rn FROM e a JOIN e b ON a.t = b.t AND a.vec_id <> b.vec_id)
SELECT vec_id, nn, (label = nn_label) AS agrees FROM p WHERE rn = 1""")
def one_nn(spark, d):
    e = table(spark, d, "embeddings").withColumn("t", F.col("vec_id") % 8)
    near = neighbours.nearest(e, ["t"], "vec_id", "embedding").withColumnRenamed("id", "vec_id").select("vec_id", "nn")
    labels = table(spark, d, "embeddings").select("vec_id", "label")
    both = near.join(labels, "vec_id").join(labels.toDF("nn", "nn_label"), "nn")
    return both.select("vec_id", "nn", (F.col("label") == F.col("nn_label")).alias("agrees"))


def _means(spark, d):
    e = table(spark, d, "embeddings")
    return e.groupBy("label").agg(F.array(*[F.avg(F.get("embedding", F.lit(i)).cast("double")) for i in range(_DIM)]).alias("m"))


_MEANS = f"SELECT label, [{', '.join(f'avg(embedding[{i}]::DOUBLE)' for i in range(1, 65))}] AS m FROM embeddings GROUP BY label"


@query(f"SELECT vec_id, p.label AS prototype, round({_DOT.format(a='embedding', b='m')} / sqrt({_DOT.format(a='m', b='m')}), 6) + 0.0 AS similarity FROM embeddings e, ({_MEANS}) p")
def prototype_similarity(spark, d):
    p = _means(spark, d).select(F.col("label").alias("prototype"), "m", F.sqrt(metrics.dot(F.col("m"), F.col("m"))).alias("norm"))
    met = table(spark, d, "embeddings").crossJoin(p)
    return _six(met.select("vec_id", "prototype", (metrics.dot(F.col("embedding"), F.col("m")) / F.col("norm")).alias("similarity")), "similarity")


@query(f"SELECT vec_id, round(avg({_DOT.format(a='embedding', b='m')}) FILTER (p.label < 5) - avg({_DOT.format(a='embedding', b='m')}) FILTER (p.label >= 5), 6) + 0.0 AS margin FROM embeddings e, ({_MEANS}) p GROUP BY vec_id")
def prompt_margin(spark, d):
    p = _means(spark, d).select(F.col("label").alias("prompt"), "m")
    s = table(spark, d, "embeddings").crossJoin(p).select("vec_id", "prompt", metrics.dot(F.col("embedding"), F.col("m")).alias("s"))
    mean = lambda c: F.avg(F.when(c, F.col("s")))
    return _six(s.groupBy("vec_id").agg((mean(F.col("prompt") < 5) - mean(F.col("prompt") >= 5)).alias("margin")), "margin")


@query()
def kmeans_clusters(spark, d):
    return models.kmeans(table(spark, d, "embeddings"), "embedding", 6).select("vec_id", "cluster")


@query()
def pca_first(spark, d):
    return models.pca(table(spark, d, "embeddings"), "embedding", 1).select("vec_id", F.get("components", F.lit(0)).alias("pc1"))


@query()
def model_scores(spark, d):
    """The plumbing of a batch model, with the labelled stand-in."""
    score = models.scorer(models.stand_in, [[_DIM]])
    return table(spark, d, "embeddings").select("vec_id", score(F.array(*[F.get("embedding", F.lit(i)) for i in range(_DIM)])).alias("stand_in_score"))


from . import imagery, rasters  # noqa: E402, F401  (register their queries)
