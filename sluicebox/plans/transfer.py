"""Whole-table transfers between a catalog table and a dated lake path."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluicebox.functions.dates import dated_table, day_path, under
from sluicebox.sources.layout import create_file, path_exists, read_file
from sluicebox.sources.sinks import write_day
from sluicebox.sources.tables import append_run, read_day, read_extract, read_rows, read_table, write_table


def warehouse_to_lake(
    spark: SparkSession,
    day: str,
    table: str,
    directory: str,
    *,
    fmt: str | None = None,
    options: Mapping[str, str] | None = None,
    mode: str = "errorifexists",
) -> str:
    """All columns and rows of a table to Parquet at ``directory/yyyy/mm/dd``; returns that path.

    ``table`` is a catalog table, or the path of an extract if ``fmt`` names its format.
    """
    df = read_table(spark, table) if fmt is None else read_extract(spark, table, fmt, options)
    return write_day(df, directory, day, mode)


def lake_to_warehouse(
    spark: SparkSession, day: str, directory: str, table: str, *, mode: str = "overwrite", path: str | None = None
) -> None:
    """Parquet at ``directory/yyyy/mm/dd`` to a catalog table, replacing its rows and schema."""
    write_table(read_day(spark, directory, day), table, mode, path)


def distinct_countries(df: DataFrame) -> DataFrame:
    """Each country once, sorted; a missing country is one too."""
    return df.select("country").distinct().orderBy(F.col("country").asc_nulls_first())


# The file beside the lake's folders that says which run of a day's chain owns the day's path.
CLAIM = "_chain"


def claim_day(spark: SparkSession, day: str, directory: str, run: str) -> None:
    """Make a day's lake path the run's own, before anything is written; a path of another owner is an error."""
    name, path = f"{CLAIM}.{day}", under(directory, day_path(day))
    if path_exists(spark, under(directory, name)):
        owner = read_file(spark, directory, name)
        if owner != run:
            raise FileExistsError(f"{path} belongs to run {owner!r}; nothing was appended")
    elif path_exists(spark, path) or not create_file(spark, directory, name, run):
        raise FileExistsError(f"{path} exists or is being written; nothing was appended")


def country_chain(
    spark: SparkSession,
    day: str,
    directory: str,
    *,
    source: str,
    result: str,
    copy: str,
    mode: str = "append",
    lake_mode: str = "errorifexists",
    run: str | None = None,
) -> str:
    """Append the day's countries to a dated table, put that table into the lake, and load it from there again.

    With ``run``, a name that a scheduler's retries share, the chain can be repeated after a failure at any step: the
    run's rows in the result table are replaced, the lake path is the run's own and is replaced too, and the load
    replaces the copy. Every table then equals that of one clean run. Another run appends its own rows, and takes over
    a lake path only with ``lake_mode="overwrite"``.

    Without ``run`` every call appends. The lake path is looked at before anything is appended, so that a repeated call
    does not append twice and then fail.
    """
    path = under(directory, day_path(day))
    dated = dated_table(result, day)
    if run is None:
        if lake_mode == "errorifexists" and path_exists(spark, path):
            raise FileExistsError(f"{path} exists; nothing was appended")
    elif lake_mode == "errorifexists":
        claim_day(spark, day, directory, run)
        lake_mode = "overwrite"
    countries = distinct_countries(read_table(spark, dated_table(source, day)))
    if run is None or mode == "overwrite":
        write_table(countries, dated, mode)
    else:
        append_run(countries, dated, run)
    write_day(read_rows(spark, dated), directory, day, lake_mode)
    lake_to_warehouse(spark, day, directory, dated_table(copy, day))
    return dated_table(copy, day)
