"""JSON-lines events: by hour directory, by event type, with an inferred or a given schema."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructField, StructType

from sluicebox.functions.dates import day_path, under
from sluicebox.functions.types import ambiguous, parse_variant_type
from sluicebox.functions.types import read_type as read_type_of
from sluicebox.operators.flatten import DROPPED_FIELDS, flat_columns, prune_schema
from sluicebox.sources.layout import escape_value
from sluicebox.session import sql_settings

# Spark's name for the text of a line that is no JSON object. Such a line has no event type, so it is never kept.
_MALFORMED = "_corrupt_record"


def read_json(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """JSON lines. Without a schema all lines are scanned once to infer it.

    With a schema, fields outside it are dropped, missing ones are null, and a value that does not fit is null.
    """
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.json(path)


def infer_json_schema(spark: SparkSession, paths: Sequence[str]) -> StructType:
    schema = spark.read.option("recursiveFileLookup", "true").json(list(paths)).schema
    return StructType([f for f in schema.fields if f.name != _MALFORMED])


def infer_hour_schemas(
    spark: SparkSession, root: str, day: str, hours: Sequence[str], concurrent: int = 4
) -> dict[str, StructType]:
    """One inferred schema per hour directory, several hours at a time."""
    base = under(root, day_path(day))
    with ThreadPoolExecutor(concurrent) as pool:
        found = pool.map(lambda hour: infer_json_schema(spark, [under(base, hour)]), hours)
    return dict(zip(hours, found, strict=True))


def merge_types(left: DataType, right: DataType) -> DataType | None:
    """The type that reads both sides as each would read alone; None if there is none."""
    if isinstance(left, StructType) and isinstance(right, StructType):
        return merge_schemas(left, right)
    if isinstance(left, ArrayType) and isinstance(right, ArrayType):
        element = merge_types(left.elementType, right.elementType)
        return None if element is None else ArrayType(element)
    return left if left == right else None


def merge_schemas(left: StructType, right: StructType) -> StructType | None:
    """All fields of both schemas; None if a common field differs in type."""
    fields = {f.name: f for f in left.fields}
    for field in right.fields:
        if field.name in fields:
            merged = merge_types(fields[field.name].dataType, field.dataType)
            if merged is None:
                return None
            fields[field.name] = StructField(field.name, merged)
        else:
            fields[field.name] = field
    return StructType(sorted(fields.values(), key=lambda f: f.name))


def batch_hours(
    schemas: dict[str, StructType], dropped: Iterable[str] = DROPPED_FIELDS, fix_locale: bool = False
) -> list[tuple[list[str], StructType]]:
    """Hours that one plan can read without changing any type or column name, with their common schema.

    Hours mostly differ by rare fields only, so a day is usually one batch. Only kept fields are compared.
    """
    batches: list[tuple[list[str], StructType]] = []
    for hour, schema in schemas.items():
        schema = kept_schema(schema, dropped, fix_locale)
        for i, (hours, common) in enumerate(batches):
            merged = merge_schemas(common, schema)
            if merged is None:
                continue
            try:
                flat_columns(merged, dropped, fix_locale)
            except ValueError:
                continue
            batches[i] = ([*hours, hour], merged)
            break
        else:
            batches.append(([hour], schema))
    return batches


def kept_schema(
    schema: StructType, dropped: Iterable[str] = DROPPED_FIELDS, fix_locale: bool = False
) -> StructType:
    """The schema without the fields that flattening would drop, for the JSON scan."""
    return prune_schema(schema, [leaf for leaf, _ in flat_columns(schema, dropped, fix_locale)])


def read_hours(
    spark: SparkSession, root: str, day: str, hours: Sequence[str], schema: StructType, hour_column: str = "hh"
) -> DataFrame:
    """Events under ``root/yyyy/mm/dd/hh/`` for the given hours, with the hour taken from the path."""
    if hour_column in schema.names:
        raise ValueError(f"the events have a field named {hour_column!r}, which is taken by the hour of the path")
    base = under(root, day_path(day))
    reader = spark.read.schema(schema).option("recursiveFileLookup", "true")
    hour = F.regexp_extract(F.col("_metadata.file_path"), f".*/{day_path(day)}/([0-9]{{2}})/", 1)
    return reader.json([under(base, h) for h in hours]).withColumn(hour_column, hour)


def list_types(spark: SparkSession, split_root: str) -> DataFrame:
    """Event types present in a split, sorted. Only file names are looked at, and marker files are not data."""
    with sql_settings(spark, spark__sql__sources__partitionColumnTypeInference__enabled="false"):
        files = spark.read.format("binaryFile").load(split_root)
    return files.select("et").distinct().orderBy("et")


def read_split(spark: SparkSession, split_root: str) -> DataFrame:
    """All types of a split with one schema and the type of the directory as ``et``."""
    with sql_settings(spark, spark__sql__sources__partitionColumnTypeInference__enabled="false"):
        return read_json(spark, split_root)


def read_type(spark: SparkSession, split_root: str, event_type: str) -> DataFrame:
    """Events of one type of a split, with the schema this type's lines show and without the column ``et``."""
    return read_json(spark, under(split_root, f"et={escape_value(event_type)}"))


def type_schemas(spark: SparkSession, split_root: str, concurrent: int = 8) -> dict[str, StructType]:
    """The schema that the lines of each type of a split show, in the order of the names.

    One grouped aggregate over all lines, whatever the number of types: the lines are parsed on the executors, schemas
    are merged before the shuffle, and a row with a type's name and schema comes to the driver. Types are those that the
    JSON reader infers. Types with lines that only the reader accepts (quotes of the other kind, numbers that are none, a
    name twice in an object), or with numbers whose variants are :func:`ambiguous`, are left to the reader.
    """
    with sql_settings(spark, spark__sql__sources__partitionColumnTypeInference__enabled="false"):
        lines = spark.read.schema("value string, et string").format("text").load(split_root)
    event, odd = parsed_line("value")
    found = lines.groupBy("et").agg(F.schema_of_variant_agg(event).alias("shown"), F.max(odd).alias("odd")).collect()

    def schema(row) -> StructType:
        if row["odd"] or ambiguous(row["shown"]):
            return infer_json_schema(spark, [under(split_root, f"et={escape_value(row['et'] or '')}")])
        return shown_schema(row["shown"])

    found.sort(key=lambda row: row["et"] or "")
    with ThreadPoolExecutor(concurrent) as pool:
        return {row["et"] or "": shown for row, shown in zip(found, pool.map(schema, found), strict=True)}


def parsed_line(name: str) -> tuple[Column, Column]:
    """A line as a variant if it is a JSON object, and whether it may be one that only the JSON reader accepts."""
    line = F.ltrim(F.col(name))
    event = F.when(line.startswith("{"), F.try_parse_json(F.col(name)))
    return event, F.coalesce(line != "", F.lit(False)) & event.isNull()


def shown_schema(text: str | None) -> StructType:
    """The schema that the JSON reader gives to lines whose variants have this merged type."""
    found = None if text in (None, "VOID") else read_type_of(parse_variant_type(text))
    return found if isinstance(found, StructType) else StructType([])


def read_types(spark: SparkSession, split_root: str) -> dict[str, DataFrame]:
    """Every type of a split with the schema its own lines show, in the order of the names."""
    return {
        et: read_json(spark, under(split_root, f"et={escape_value(et)}"), schema)
        for et, schema in type_schemas(spark, split_root).items()
    }
