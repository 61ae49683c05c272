"""Raw JSON lines, read once: staged as they are, and their schemas worked out from there."""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sluicebox.functions.dates import day_path, under
from sluicebox.sources.json_events import infer_json_schema
from sluicebox.sources.layout import path_exists
from sluicebox.sources.work import Work

# Lines in a staged file, which one task reads later.
MAX_LINES_PER_FILE = 500_000
# Hours inferred at once; an hour of few files leaves tasks free for the next one.
CONCURRENT_HOURS = 8


class StagedLines(NamedTuple):
    """The folder that holds the lines of each hour, and the schema that they show."""

    folders: dict[str, str]
    schemas: dict[str, StructType]


def hour_lines(spark: SparkSession, root: str, day: str, hours: Sequence[str]) -> DataFrame:
    """The raw lines (``value``) under ``root/yyyy/mm/dd/HH/`` with the hour of the path as ``HOUR``."""
    lines = spark.read.option("recursiveFileLookup", "true").text([under(root, day_path(day), h) for h in hours])
    hour = F.regexp_extract(F.col("_metadata.file_path"), f".*/{day_path(day)}/([0-9]{{2}})/", 1)
    return lines.select("value", hour.alias("HOUR"))


def stage_lines(lines: DataFrame, hours: Sequence[str], folder: str) -> StagedLines:
    """Write the lines by hour to ``folder``, and learn the schema of each hour from what is written there.

    This is the only read of the raw files: a map-only write of their text. The JSON reader then infers the hours from
    the staged lines, some at a time; a type for each task comes to the driver. Types are thus those of the reader,
    whatever numbers and odd lines an hour holds, and each line is parsed once for them. The staged lines keep their
    text, as a number in a column of mixed types must keep the digits it came with. They are files of bounded size even
    if the raw ones are not to be split. Blank lines are no events.
    """
    spark = lines.sparkSession
    writer = lines.where(F.col("value").rlike(r"\S")).select("value", "HOUR").write.partitionBy("HOUR")
    writer.option("compression", "lz4").option("maxRecordsPerFile", MAX_LINES_PER_FILE).text(folder)

    def schema(hour: str) -> StructType:
        place = under(folder, f"HOUR={hour}")
        return infer_json_schema(spark, [place]) if path_exists(spark, place) else StructType([])

    with ThreadPoolExecutor(CONCURRENT_HOURS) as pool:
        schemas = dict(zip(hours, pool.map(schema, hours), strict=True))
    return StagedLines(dict.fromkeys(hours, folder), schemas)


def stage_hours(
    spark: SparkSession, root: str, day: str, hours: Sequence[str], folder: str, work: Work, prints: dict[str, str]
) -> StagedLines:
    """The staged lines of some hours: those that an earlier run has staged from the same files, and others anew."""
    depends = {hour: [root, day, hour, prints[hour]] for hour in hours}
    found = {hour: work.find("lines", depends[hour]) for hour in hours}
    missing = [hour for hour in hours if found[hour] is None]
    if missing:
        fresh = stage_lines(hour_lines(spark, root, day, missing), missing, folder)
        for hour in missing:
            found[hour] = {"folder": folder, "schema": fresh.schemas[hour].jsonValue()}
            work.finish("lines", depends[hour], found[hour])
    schemas = {hour: StructType.fromJson(made["schema"]) for hour, made in found.items()}
    return StagedLines({hour: made["folder"] for hour, made in found.items()}, schemas)


def read_staged(
    spark: SparkSession, staged: StagedLines, hours: Sequence[str], schema: StructType, hour_column: str | None = "hh"
) -> DataFrame:
    """The events of some staged hours by the JSON reader with a schema, and the hour of each. An hour may have none."""
    if hour_column in schema.names:
        raise ValueError(f"the events have a field named {hour_column!r}, which is taken by the hour of the path")
    known = [hour for hour in hours if hour in staged.folders]
    folders = [path for hour in known if path_exists(spark, path := under(staged.folders[hour], f"HOUR={hour}"))]
    if folders:
        reader = spark.read.schema(schema).option("recursiveFileLookup", "true")
        events = reader.json(folders)
        hour = F.regexp_extract(F.col("_metadata.file_path"), "/HOUR=([^/]*)/", 1)
    else:
        events, hour = spark.createDataFrame([], schema), F.lit("")
    return events if hour_column is None else events.withColumn(hour_column, hour)
