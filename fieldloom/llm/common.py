"""Small helpers that every operator of this subpackage shares."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: A word is a run of anything but the six ASCII white-space bytes.
WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
SPACES = "\x20\x09\x0a\x0b\x0c\x0d"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, by whatever file system the path names."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only, so that the result doesn't depend on a locale or a Unicode version."""
    return F.translate(text, UPPER, LOWER)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where a local session names none (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="fieldloom-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def stash(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Writes df once to the shared folder and reads it back: a cut in the lineage that outlives lost executors.

    Spark deletes the shuffle files of finished work when the driver's collector finds its plan unused;
    asking for a collection here keeps the disk's load to about one step's, however many steps there are.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    spark._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path)


def unstash(df: DataFrame) -> None:
    """Deletes a stashed table that no plan reads any more."""
    files = df.inputFiles()
    if files:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(files[0].rpartition("/")[0])
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def running_total(df: DataFrame, keys: Sequence[str], index: str, value: str, out: str, fan: int = 4096) -> DataFrame:
    """Adds `out`: the sum of `value` over the rows of the same keys with a smaller `index` (a dense or sparse long >= 0, unique within the keys).

    No task holds a key's rows: they are summed in blocks of `fan` indexes, the block sums in blocks
    of blocks, and so on until the top level has few rows; each level is one window over small groups.
    """
    from pyspark.sql import Window

    keys = list(keys)
    block, base = f"__block_{out}", f"__base_{out}"
    blocked = df.withColumn(block, F.floor(F.col(index) / F.lit(fan)).cast("long"))
    sums = blocked.groupBy(*keys, block).agg(F.sum(value).alias("__sum"))
    above = _running_sums(sums, keys, block, "__sum", fan, levels=2).withColumnRenamed("__before", base)
    w = Window.partitionBy(*keys, block).orderBy(index).rowsBetween(Window.unboundedPreceding, -1)
    local = blocked.withColumn(out, F.coalesce(F.sum(value).over(w), F.lit(0)))
    same = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in [*keys, block]]
    joined = local.alias("l").join(above.select(*keys, block, base).alias("r"), same)
    return joined.select("l.*", F.col(f"r.{base}").alias(base)).withColumn(out, F.col(out) + F.col(base)).drop(block, base)


def _running_sums(df: DataFrame, keys: list[str], index: str, value: str, fan: int, levels: int) -> DataFrame:
    from pyspark.sql import Window

    if levels == 0:
        w = Window.partitionBy(*keys).orderBy(index).rowsBetween(Window.unboundedPreceding, -1)
        return df.withColumn("__before", F.coalesce(F.sum(value).over(w), F.lit(0)))
    up = f"__up{levels}"
    blocked = df.withColumn(up, F.floor(F.col(index) / F.lit(fan)).cast("long"))
    sums = blocked.groupBy(*keys, up).agg(F.sum(value).alias("__upsum"))
    above = _running_sums(sums, keys, up, "__upsum", fan, levels - 1).withColumnRenamed("__before", "__upbefore")
    w = Window.partitionBy(*keys, up).orderBy(index).rowsBetween(Window.unboundedPreceding, -1)
    local = blocked.withColumn("__before", F.coalesce(F.sum(value).over(w), F.lit(0)))
    same = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in [*keys, up]]
    joined = local.alias("l").join(above.select(*keys, up, "__upbefore").alias("r"), same)
    return joined.select("l.*", "r.__upbefore").withColumn("__before", F.col("__before") + F.col("__upbefore")).drop(up, "__upbefore")


#: Bits of the filter that may_hold ships to a scan; a bound whatever the input.
FILTER_BITS = 1 << 21


def may_hold(df: DataFrame, column: str, ids: DataFrame, id_column: str, rest: bool = False) -> DataFrame:
    """The rows of df whose id may be among ids: all that are, and those that share a bit with one; with rest, all other rows.

    A bitmap of fixed size (at most FILTER_BITS / 64 rows) is broadcast, so that wide rows which
    a later exact join would drop are not shuffled. It drops nothing that the join keeps.
    """
    residue = lambda c: F.pmod(F.xxhash64(F.col(c)), F.lit(FILTER_BITS))
    word = lambda c: F.floor(residue(c) / 64).cast("int")
    bit = lambda c: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(residue(c), F.lit(64)).cast("int"))
    bitmap = ids.select(word(id_column).alias("__word"), bit(id_column).alias("__bit")).groupBy("__word").agg(F.bit_or("__bit").alias("__bits"))
    marked = df.withColumn("__word", word(column)).join(F.broadcast(bitmap), "__word", "left" if rest else "inner")
    held = F.coalesce(F.col("__bits").bitwiseAND(bit(column)), F.lit(0)) != 0
    return marked.filter(~held if rest else held).drop("__word", "__bits")
