"""Sinks: GeoJSON, manifests, markdown tables, recorders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..operators.select import latest


def write_json_lines(df: DataFrame, path: str) -> None:
    """One JSON object a line; null fields are left out."""
    df.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(path)


def feature_collections(features: DataFrame, keys: list[str], feature: Column, order: Column, crs: Column | None = None) -> DataFrame:
    """keys and json: a GeoJSON collection of each group's features (one image's polygons), in order; with the name of a crs where that isn't null."""
    named = [F.first(crs, ignorenulls=True).alias("c")] if crs is not None else []
    grouped = features.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(order.alias("o"), feature.alias("f")))).alias("z"), *named)
    parts = [F.lit("FeatureCollection").alias("type"), F.transform("z", lambda x: x["f"]).alias("features")]
    if named:
        name = F.struct(F.lit("name").alias("type"), F.struct(F.col("c").alias("name")).alias("properties"))
        parts.append(F.when(F.col("c").isNotNull(), name).alias("crs"))
    return grouped.select(*keys, F.to_json(F.struct(*parts)).alias("json"))


def markdown_rows(df: DataFrame) -> DataFrame:
    """value: each row as a line of a markdown table."""
    return df.select(F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in df.columns]), F.lit(" |")).alias("value"))


def record(df: DataFrame, path: str) -> None:
    """Appends rows."""
    df.write.mode("append").parquet(path)


def upsert(df: DataFrame, old: DataFrame, keys: list[str], path: str) -> None:
    """Writes old with df's rows in place of those of the same keys; to another path than old's. For a store that is always whole see store.py."""
    latest(old, df, keys).write.mode("overwrite").parquet(path)
