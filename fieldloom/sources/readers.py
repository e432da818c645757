"""Sources: tables, image folders, JSON documents, caches that may be absent."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

# Extensions of images.
EXTENSIONS = ("jpg", "jpeg", "jpe", "png", "tif", "tiff", "bmp")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def image_files(spark: SparkSession, folder: str) -> DataFrame:
    """filename, path, length, modificationTime and content of a folder's images (not of its subfolders)."""
    files = spark.read.format("binaryFile").load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    return files.withColumn("filename", name).filter(F.lower(F.element_at(F.split(name, r"\."), -1)).isin(*EXTENSIONS))


def decoded_images(spark: SparkSession, folder: str) -> DataFrame:
    """filename, width, height, n_channels and data (rows of BGR bytes) of a folder's images."""
    images = spark.read.format("image").option("dropInvalid", True).load(folder).select("image.*")
    return images.select(F.element_at(F.split("origin", "/"), -1).alias("filename"), "width", "height", F.col("nChannels").alias("n_channels"), "data")


def json_table(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """A JSON document (an array of objects, or lines) under a declared schema."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def or_empty(spark: SparkSession, path: str, schema: StructType | str, kind: str = "parquet") -> DataFrame:
    """The table at a path, or an empty one where there is none."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        return spark.read.schema(schema).format(kind).load(path)
    return spark.createDataFrame([], schema)
