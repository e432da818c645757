"""The image catalogue: classification, overrides and pairing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def classify(ink: Column, has_panel: Column, megapixels: Column) -> tuple[Column, Column]:
    """(role, subtype): annotated where there is ink or an information panel."""
    annotated = (ink > 300) | has_panel
    role = F.when(annotated, "annotated").otherwise("original")
    subtype = F.when(annotated & has_panel & (megapixels < 6), "map_layout").when(annotated, "example_crop").otherwise("orthophoto")
    return role, subtype


def pair_by_year(annotated: DataFrame, originals: DataFrame, year: str, name: str) -> DataFrame:
    """annotated with paired: the last name among the originals of the year; a null or zero year pairs with nothing."""
    last = originals.filter(F.col(year) != 0).groupBy(year).agg(F.max(name).alias("paired"))
    return annotated.join(last, year, "left")


def override(df: DataFrame, overrides: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """df with columns replaced where overrides has the key and a value."""
    given = overrides.select(F.col(key).alias("__k"), *[F.col(c).alias(f"__o_{c}") for c in columns])
    joined = df.join(given, F.col(key) == F.col("__k"), "left")
    return joined.select(*[F.coalesce(f"__o_{c}", c).alias(c) if c in columns else F.col(c) for c in df.columns])


def ink_masks(r: Column, g: Column, b: Column, hue: Column, saturation: Column) -> dict[str, Column]:
    """The three inks' pixel predicates; hue in 0..179."""
    r, g, b = r.cast("int"), g.cast("int"), b.cast("int")
    return {
        "yellow": (r > b + 35) & (g > b + 35) & (F.abs(r - g) < 70) & hue.between(18, 42),
        "red": (r > g + 28) & (r > b + 28),
        "black": (F.greatest(r, g, b) < 45) & (saturation < 70),
    }
