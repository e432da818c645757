"""Rings, boxes and affine transforms as column expressions; a point is a struct of x and y."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def box_iou(a: list[Column], b: list[Column]) -> Column:
    """Intersection over union of two boxes [x0, y0, x1, y1]; 0 where both are empty."""
    w = F.greatest(F.lit(0.0), F.least(a[2], b[2]) - F.greatest(a[0], b[0]))
    h = F.greatest(F.lit(0.0), F.least(a[3], b[3]) - F.greatest(a[1], b[1]))
    area = lambda z: (z[2] - z[0]) * (z[3] - z[1])
    return F.coalesce(F.try_divide(w * h, area(a) + area(b) - w * h), F.lit(0.0))


def cells(box: list[Column], width: int, height: int) -> Column:
    """The cells (structs cx, cy) of a grid that a box [x0, y0, x1, y1] touches; boxes that overlap share one."""
    span = lambda a, b, size: F.sequence(F.floor(a / size).cast("int"), F.floor(b / size).cast("int"))
    across = span(box[0], box[2], width)
    return F.flatten(F.transform(across, lambda x: F.transform(span(box[1], box[3], height), lambda y: F.struct(x.alias("cx"), y.alias("cy")))))


def best_iou(pred: DataFrame, truth: DataFrame, keys: list[str], p: list[str], g: list[str], width: int, height: int) -> DataFrame:
    """keys, p, iou: the best overlap of each distinct box of pred with truth's boxes of its keys; none for keys that truth lacks.

    All boxes have one size, and p and g name their corners' columns. Each distinct box is compared once, however many rows share it, and only
    with boxes of a cell of the grid that both touch; a box that meets none has 0.
    """
    corners = lambda a: [F.col(a[0]), F.col(a[1]), F.col(a[0]) + width, F.col(a[1]) + height]
    one, two = pred.select(*keys, *p).distinct(), truth.select(*keys, *g).distinct()
    in_cells = lambda df, a: df.withColumn("__cell", F.explode(cells(corners(a), width, height)))
    met = in_cells(one, p).hint("merge").join(in_cells(two, g), [*keys, "__cell"]).groupBy(*keys, *p).agg(F.max(box_iou(corners(p), corners(g))).alias("iou"))
    some = one.join(truth.select(*keys).distinct(), keys, "left_semi")
    return some.join(met, [*keys, *p], "left").withColumn("iou", F.coalesce("iou", F.lit(0.0)))


def closed(ring: Column) -> Column:
    """The ring with its first point appended."""
    return F.concat(ring, F.slice(ring, 1, 1))


def _edges(ring: Column, f) -> Column:
    """f of each edge, summed."""
    steps = F.zip_with(ring, F.concat(F.slice(ring, F.lit(2), F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1)), f)
    return F.aggregate(steps, F.lit(0.0), lambda a, v: a + v)


def ring_area(ring: Column) -> Column:
    return F.abs(_edges(ring, lambda p, q: p["x"] * q["y"] - q["x"] * p["y"])) / 2


def ring_perimeter(ring: Column) -> Column:
    return _edges(ring, lambda p, q: F.hypot(q["x"] - p["x"], q["y"] - p["y"]))


def compactness(area: Column, perimeter: Column) -> Column:
    return 4 * F.pi() * area / (perimeter * perimeter + F.lit(1e-6))


def touches_frame(ring: Column, width: Column, height: Column, fraction: float = 0.01) -> Column:
    """Whether a vertex lies within the frame's margin."""
    m = F.floor(F.least(width, height) * fraction) + 1
    return F.exists(ring, lambda p: (p["x"] <= m) | (p["y"] <= m) | (p["x"] >= width - m) | (p["y"] >= height - m))


def to_world(ring: Column, gt: Column) -> Column:
    """Points through an affine transform, an array of six: x0, dx/px, dx/py, y0, dy/px, dy/py."""
    g = lambda i: F.get(gt, F.lit(i))
    return F.transform(ring, lambda p: F.struct((g(0) + p["x"] * g(1) + p["y"] * g(2)).alias("x"), (g(3) + p["x"] * g(4) + p["y"] * g(5)).alias("y")))


def feature(ident: Column, ring: Column, properties: Column) -> Column:
    """A GeoJSON feature (struct) of one ring, closed."""
    coordinates = F.array(F.transform(closed(ring), lambda p: F.array(p["x"], p["y"])))
    return F.struct(F.lit("Feature").alias("type"), ident.alias("id"), F.struct(F.lit("Polygon").alias("type"), coordinates.alias("coordinates")).alias("geometry"), properties.alias("properties"))


def properties(own: dict[str, Column], more: dict[str, Column] | None = None) -> Column:
    """A feature's properties; those of `more` replace own ones of the same name, in their place, and others follow."""
    return F.struct(*[c.alias(n) for n, c in {**own, **(more or {})}.items()])


def polygon_feature(rings: Column, props: Column, gt: Column | None = None) -> Column:
    """A GeoJSON feature of an outer ring and its holes, each closed; in world coordinates where gt (six numbers, see to_world) isn't null, else in pixels."""
    pairs = lambda ring: F.transform(closed(ring), lambda p: F.array(p["x"].cast("double"), p["y"].cast("double")))
    at = F.transform(rings, pairs)
    if gt is not None:
        at = F.when(gt.isNull(), at).otherwise(F.transform(rings, lambda ring: pairs(to_world(ring, gt))))
    geometry = F.struct(F.lit("Polygon").alias("type"), at.alias("coordinates"))
    return F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), props.alias("properties"))
