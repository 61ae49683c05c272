"""Catalog tables and extracts in any format Spark has a reader for."""

from __future__ import annotations

import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluicebox.functions.dates import day_path, under
from sluicebox.session import sql_settings

# Tables beside the one that is being replaced.
LOADING, REPLACED = "_loading", "_replaced"


def read_table(spark: SparkSession, name: str) -> DataFrame:
    return spark.read.table(name)


def read_extract(
    spark: SparkSession, path: str, fmt: str = "avro", options: Mapping[str, str] | None = None
) -> DataFrame:
    """A table's staged extract; ``avro`` needs the spark-avro package on the cluster."""
    return spark.read.format(fmt).options(**(options or {})).load(path)


def read_day(spark: SparkSession, root: str, day: str) -> DataFrame:
    """Parquet at ``root/yyyy/mm/dd``."""
    return spark.read.parquet(under(root, day_path(day)))


def write_table(df: DataFrame, name: str, mode: str = "append", path: str | None = None) -> None:
    """Append to a table, or replace its rows and schema with ``mode="overwrite"``. Creates it if it is missing.

    A replaced table is loaded beside the old one first, at a location of its own. Only a finished load takes the name:
    the old table is renamed, the new one renamed, the old one dropped. A load that fails leaves the old table; a run
    that ends between the two renames leaves both, and the next one goes on from there.
    """
    spark = df.sparkSession
    if mode != "overwrite":
        writer = df.write.mode(mode)
        (writer if path is None else writer.option("path", path)).saveAsTable(name)
        return
    new, old = f"{name}{LOADING}", f"{name}{REPLACED}"
    recover_table(spark, name)
    spark.sql(f"DROP TABLE IF EXISTS {quoted(new)}")
    try:
        writer = df.write.mode("errorifexists")
        if path is not None:
            writer = writer.option("path", under(path, f"load-{uuid.uuid4().hex}"))
        writer.saveAsTable(new)
    except BaseException:
        spark.sql(f"DROP TABLE IF EXISTS {quoted(new)}")
        raise
    if spark.catalog.tableExists(name):
        spark.sql(f"ALTER TABLE {quoted(name)} RENAME TO {quoted(old)}")
    spark.sql(f"ALTER TABLE {quoted(new)} RENAME TO {quoted(name)}")
    spark.sql(f"DROP TABLE IF EXISTS {quoted(old)}")


# The partition of a table that says which run appended a row.
RUN = "RUN_ID"


def append_run(df: DataFrame, name: str, run: str) -> None:
    """Append the rows of one run; a repeated run replaces what it appended before, so that each run counts once.

    The run is the partition ``RUN`` of the table, overwritten as a whole by one committed write. A missing table is
    created empty first, so that a run that fails between the two steps can be repeated.
    """
    spark = df.sparkSession
    if RUN in df.columns:
        raise ValueError(f"the rows have a column {RUN!r}, which names the run")
    if not spark.catalog.tableExists(name):
        fields = ", ".join(f"{quoted_part(f.name)} {f.dataType.simpleString()}" for f in df.schema.fields)
        spark.sql(f"CREATE TABLE IF NOT EXISTS {quoted(name)} ({fields}, {RUN} STRING) USING parquet PARTITIONED BY ({RUN})")
    columns = read_table(spark, name).columns
    if RUN not in columns or sorted(columns) != sorted([*df.columns, RUN]):
        raise ValueError(f"{name} has the columns {columns}, not {df.columns} and the run's {RUN!r}")
    keyed = df.withColumn(RUN, F.lit(run)).select(*(quoted_part(c) for c in columns))
    with sql_settings(spark, spark__sql__sources__partitionOverwriteMode="dynamic"):
        keyed.write.insertInto(name, overwrite=True)
    if not keyed.take(1):  # a dynamic overwrite replaces only partitions that it has rows for
        spark.sql(f"ALTER TABLE {quoted(name)} DROP IF EXISTS PARTITION ({RUN} = {sql_text(run)})")


def read_rows(spark: SparkSession, name: str) -> DataFrame:
    """A table without the column that names its runs."""
    return read_table(spark, name).drop(RUN)


def sql_text(value: str) -> str:
    escaped = value.replace("\\", "\\\\").replace("'", "\\'")
    return f"'{escaped}'"


def quoted_part(name: str) -> str:
    escaped = name.replace("`", "``")
    return f"`{escaped}`"


def recover_table(spark: SparkSession, name: str) -> None:
    """Give a table its name back if a replacement ended between its two renames."""
    old = f"{name}{REPLACED}"
    if spark.catalog.tableExists(old):
        if spark.catalog.tableExists(name):
            spark.sql(f"DROP TABLE {quoted(old)}")
        else:
            spark.sql(f"ALTER TABLE {quoted(old)} RENAME TO {quoted(name)}")


def quoted(name: str) -> str:
    return ".".join(f"`{part}`" for part in name.split("."))


def register_view(df: DataFrame, name: str) -> DataFrame:
    """Make a DataFrame known to SQL in this session."""
    df.createOrReplaceTempView(name)
    return df
