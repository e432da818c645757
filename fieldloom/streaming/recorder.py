"""A recorder as a stream: rows that arrive as files are recorded once for each key.

An extension: batches of result files are picked up as they come, and re-delivered rows leave no
duplicate while their key is inside the watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def arriving(spark: SparkSession, folder: str, schema: StructType | str, files: int = 64) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)


def once(rows: DataFrame, keys: list[str], time: str, late: str = "1 hour") -> DataFrame:
    """The first row of each key, with state for `late` only."""
    return rows.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def record(rows: DataFrame, path: str, checkpoint: str):
    """Starts recording all that is there; ends by itself."""
    return rows.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start(path)
