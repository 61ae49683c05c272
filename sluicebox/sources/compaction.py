"""Merge small text files."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sluicebox.session import materialise, sql_settings

# Fixed value: target size of a merged file, in MiB.
TARGET_MIB = 10
# Files of a directory that are laid end to end in one task; more files of it are dealt to several such lanes.
LANE_FILES = 100_000


def _directory() -> Column:
    return F.url_decode(F.element_at(F.split("_metadata.file_path", "/"), -2))


def plan_files(spark: SparkSession, source: str, target_bytes: int) -> tuple[DataFrame, int]:
    """For each file below ``source`` its ``directory``, ``offset``, ``base`` and ``width``; and how many merged files.

    The files of a directory are laid end to end, and cut evenly into as few merged files as its bytes need: the file at
    ``offset`` is in the merged file ``base + offset / width``. Only names and sizes are read. A directory gets one merged
    file more for each further LANE_FILES files.
    """
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(source)
    files = listed.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("bytes"), _directory().alias("directory")
    )
    lanes = files.groupBy("directory").agg(F.ceil(F.count(F.lit(1)) / LANE_FILES).alias("lanes"))
    dealt = files.join(lanes, "directory").withColumn("lane", F.pmod(F.xxhash64("file"), "lanes")).drop("lanes")
    keys = ["directory", "lane"]
    before = F.sum("bytes").over(Window.partitionBy(*keys).orderBy("file").rowsBetween(Window.unboundedPreceding, -1))
    laid = materialise(dealt.withColumn("offset", F.coalesce(before, F.lit(0))), "files")
    # A row for each directory, like the listing of the folder above them.
    totals = laid.groupBy(*keys).agg(F.sum("bytes").alias("bytes")).orderBy(*keys).collect()
    bins = [-(-max(row["bytes"], 1) // target_bytes) for row in totals]
    bases = list(accumulate(bins, initial=0))
    widths = [max(1, -(-row["bytes"] // n)) for row, n in zip(totals, bins)]
    rows = [(row["directory"], row["lane"], base, width) for row, base, width in zip(totals, bases, widths)]
    based = spark.createDataFrame(rows, "directory string, lane bigint, base bigint, width bigint")
    return materialise(laid.join(based, keys).select("file", "directory", "offset", "base", "width"), "plan"), bases[-1]


def compact_text(
    spark: SparkSession, source: str, target: str, target_mib: int = TARGET_MIB, compression: str = "none"
) -> None:
    """Merge the text files of each directory under ``source`` into files of about the target size.

    The files of ``source/x`` go to ``target/directory=x``; files of different directories never share a file, unless
    the directories have the same name below different parents. The merged files are planned from names and sizes, see
    :func:`plan_files`; each is one partition of the only shuffle and is written by one task. A file above the target is
    divided if its format allows that. Lines keep their bytes; which file they are in changes.
    """
    size = target_mib * 1024 * 1024
    plan, files = plan_files(spark, source, size)
    with sql_settings(
        spark,
        spark__sql__files__maxPartitionBytes=size,
        spark__sql__files__openCostInBytes=0,
        spark__sql__files__minPartitionNum=1,
    ):
        lines = spark.read.option("recursiveFileLookup", "true").text(source)
        block = F.col("_metadata.file_block_start").alias("block")
        placed = lines.select("value", F.col("_metadata.file_path").alias("file"), block).join(plan, "file")
        merged = (F.col("base") + F.expr("(offset + block) div width")).cast("int")
        dealt = placed.withColumn("MERGED", merged).repartitionById(max(1, files), F.col("MERGED"))
        writer = dealt.select("value", "directory").write.option("compression", compression)
        writer.partitionBy("directory").text(target)
