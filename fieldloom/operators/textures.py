"""Texture of grey images as relations: answers of oriented waves, periodicity of tiles, and the prior for parallel rows."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, functions as F

from ..functions import numeric
from ..sources.scratch import cut
from . import fusion, stencils

# The bank of waves (cycles a pixel; directions; side, deviation and aspect of the envelope), the spectrum's place left out, and the prior's weights and widths.
FREQUENCIES, DIRECTIONS, SIZE, DEVIATION, ASPECT = (0.12, 0.2, 0.3), 8, 21, 4.0, 0.5
LOW_WAVES = 2
DISK, SPREAD, LAST = 9, 9.0, 5.0
WAVES, PERIODS, CHAOS, FLOOR = 0.5, 0.5, 0.35, 0.3


def wave(frequency: float, direction: float, size: int = SIZE) -> list[list[float]]:
    """A cosine across a direction under an oval Gaussian, less its mean, as rows of weights."""
    r, rows = size // 2, []
    for dy in range(-r, r + 1):
        across = [dx * math.cos(direction) + dy * math.sin(direction) for dx in range(-r, r + 1)]
        along = [dy * math.cos(direction) - dx * math.sin(direction) for dx in range(-r, r + 1)]
        rows.append([math.exp(-(a * a + (ASPECT * b) ** 2) / (2 * DEVIATION**2)) * math.cos(2 * math.pi * frequency * a) for a, b in zip(across, along)])
    mean = sum(map(sum, rows)) / size**2
    return [[v - mean for v in row] for row in rows]


def wave_energy(px: DataFrame, keys: list[str], value: str, height: int, width: int, frequencies=FREQUENCIES, directions: int = DIRECTIONS, size: int = SIZE) -> DataFrame:
    """keys, y, x, value: the strongest answer, of either sign, of a bank of waves; the border is mirrored."""
    bank = [wave(f, math.pi * j / directions, size) for f in frequencies for j in range(directions)]
    return stencils.strongest(px, keys, value, bank, height, width)


def periodicity(px: DataFrame, keys: list[str], value: str, size: int, height: int, width: int, out: str = "period", block: int = 0) -> DataFrame:
    """keys, ty, tx, out: of each tile of size pixels (half overlapping), its spectrum's highest peak over its mean, without the longest waves.

    A group is the tiles that begin in one block of an image. Pixels go to their blocks by arithmetic, without a join: exploded tiles
    look as small as their images to Spark, which would broadcast them.
    """
    block = block or stencils.TILE
    starts = {c: fusion.starts(extent, size, 0.5) for c, extent in (("y", height), ("x", width))}
    near = px.select(*keys, "y", "x", value).filter(F.col("y").between(0, starts["y"][-1] + size - 1) & F.col("x").between(0, starts["x"][-1] + size - 1))
    for c in "yx":
        first, last = (F.floor(v / block).cast("int") for v in (F.col(c) - (size - 1), F.col(c)))
        near = near.withColumn(f"b{c}", F.explode(F.sequence(F.greatest(F.lit(0), first), F.least(F.lit(starts[c][-1] // block), last))))
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in px.select(*keys).schema], f"ty int, tx int, `{out}` double"])
    k = np.minimum(np.arange(size), size - np.arange(size))  # waves along an axis, of either sign
    long_, taper = np.ix_(k <= LOW_WAVES, k <= LOW_WAVES), np.hanning(size)

    def peaks(key, rows):
        import pyarrow as pa

        (y, x), at = ((np.array([s for s in starts[c] if s // block == b.as_py()], int) for c, b in zip("yx", key[-2:], strict=True)), [b.as_py() * block for b in key[-2:]])
        image, some = (np.zeros((block + size, block + size), t) for t in (float, bool))
        places = tuple(rows[c].to_numpy() - low for c, low in zip("yx", at, strict=True))
        image[places], some[places] = rows[value].to_numpy().astype(float), True
        found = []
        for ty in y:
            within = (ty - at[0] + np.arange(size))[None, :, None], (x - at[1])[:, None, None] + np.arange(size)
            tiles, held = image[within], some[within].any(axis=(1, 2))
            waves = np.abs(np.fft.fft2((tiles - tiles.mean(axis=(1, 2), keepdims=True)) * taper[:, None] * taper))
            waves[:, long_[0], long_[1]] = 0
            ratio = waves.max(axis=(1, 2)) / (waves.mean(axis=(1, 2)) + 1e-6)
            found += [(int(ty), int(tx), float(v)) for tx, v, h in zip(x, ratio, held, strict=True) if h]
        ty, tx, ratio = (list(c) for c in zip(*found, strict=True)) if found else ([], [], [])
        return pa.table([*[pa.repeat(v, len(ty)) for v in key[:-2]], pa.array(ty, pa.int32()), pa.array(tx, pa.int32()), pa.array(ratio, pa.float64(), from_pandas=True)], names=[*keys, "ty", "tx", out])

    return near.groupBy(*keys, "by", "bx").applyInArrow(peaks, schema)


def row_prior(px: DataFrame, keys: list[str], grey: str, height: int, width: int, tile: int = 96) -> DataFrame:
    """keys, y, x, v: from 0 to 1, how much a place of a grey image (0 to 255) looks like parallel rows.

    One direction that prevails is the core; waves and periods raise it, chaos lowers it, and flat places are damped.
    """
    unit = px.select(*keys, "y", "x", (F.col(grey) / 255).alias("u"))
    one = stencils.coherence(unit, keys, "u", height, width).withColumnRenamed("u", "rows")
    two = wave_energy(unit, keys, "u", height, width).withColumnRenamed("u", "waves")
    three = fusion.blend(periodicity(px, keys, grey, min(tile, height, width), height, width), keys, "period", min(tile, height, width)).withColumnRenamed("v", "periods")
    four = stencils.entropy(px.select(*keys, "y", "x", F.floor(grey).cast("int").alias("level")), keys, "level", DISK, height, width, "chaos")
    both = px.select(*keys, "y", "x", F.col(grey).alias("m"), (F.col(grey) * F.col(grey)).alias("s"))
    moments = stencils.gaussian(both, keys, ["m", "s"], SPREAD, height, width)
    five = moments.select(*keys, "y", "x", (F.col("s") - F.col("m") * F.col("m")).alias("spread"))
    met = one
    for other in (two, three, four, five):
        met = met.join(other, [*keys, "y", "x"])
    parts = numeric.norm01_maps(cut(met, "texture"), keys, ["rows", "waves", "periods", "chaos", "spread"])
    c = F.col
    core = c("rows") * (1 - WAVES + WAVES * c("waves")) * (1 - PERIODS + PERIODS * c("periods")) * (1 - CHAOS * c("chaos")) * (FLOOR + (1 - FLOOR) * c("spread"))
    smooth = cut(stencils.gaussian(parts.select(*keys, "y", "x", core.alias("v")), keys, ["v"], LAST, height, width), "texture")
    return numeric.norm01(smooth, keys, "v", "v")
