"""File sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from sluicebox.functions.dates import day_path, under

# Fixed value: rows per Parquet file.
MAX_ROWS_PER_FILE = 100_000


def clustered(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Bring the rows of a partition together before a partitioned write.

    Without it every task writes a file per partition. A rebalance splits a partition that is too large for a task
    and joins small ones, so a hot event type is written by many tasks.
    """
    return df.hint("rebalance", *by)


def write_split(df: DataFrame, path: str) -> None:
    """Gzip JSON lines in one directory per event type; fails if the path exists. Null fields are not written.

    A column ``et`` is an error, as it would clash with the directory.
    """
    if "et" in df.columns:
        raise ValueError("the events have a field named 'et', which is taken by the directory of the type")
    split = df.withColumn("et", df["event_type"])
    clustered(split, ["et"]).write.option("compression", "gzip").partitionBy("et").json(path)


def write_parquet(
    df: DataFrame,
    path: str,
    partition_by: Sequence[str] = (),
    mode: str = "errorifexists",
    max_rows: int = MAX_ROWS_PER_FILE,
) -> None:
    """Parquet with a row cap per file. Overwriting a partitioned path replaces the partitions written, no others."""
    writer = df.write.mode(mode).option("maxRecordsPerFile", max_rows)
    if partition_by:
        writer = writer.partitionBy(*partition_by).option("partitionOverwriteMode", "dynamic")
    writer.parquet(path)


def write_day(df: DataFrame, root: str, day: str, mode: str = "errorifexists") -> str:
    """Parquet at ``root/yyyy/mm/dd``."""
    path = under(root, day_path(day))
    df.write.mode(mode).parquet(path)
    return path
