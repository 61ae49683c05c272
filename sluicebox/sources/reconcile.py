"""Parquet directories whose columns differ in type, read as one table."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sluicebox.functions.types import common_schema, widen
from sluicebox.sources.json_events import merge_schemas
from sluicebox.sources.layout import list_glob


def schema_classes(schemas: dict[str, StructType]) -> list[tuple[list[str], StructType]]:
    """Directories that one scan can read, as their common columns agree in type, with all columns of each class."""
    alike: dict[str, tuple[list[str], StructType]] = {}
    for path, schema in schemas.items():
        alike.setdefault(schema.json(), ([], schema))[0].append(path)
    classes: list[tuple[list[str], StructType]] = []
    for paths, schema in alike.values():
        for i, (members, common) in enumerate(classes):
            merged = merge_schemas(common, schema)
            if merged is not None:
                classes[i] = ([*members, *paths], merged)
                break
        else:
            classes.append((paths, schema))
    return classes


def read_reconciled(
    spark: SparkSession,
    patterns: Sequence[str],
    placed: Callable[[DataFrame], DataFrame] = lambda df: df,
    concurrent: int = 16,
) -> DataFrame:
    """All directories that match as one table, each column with the least type that holds its values everywhere.

    Where the types agree, which Spark finds out by reading the footers in one job, this is one scan. Otherwise the
    schema of each directory is read, directories that agree are one scan with all their columns, and each scan is
    widened and united by name: as many scans as there are types at odds, not directories. Files of one directory have
    one schema. ``placed`` may add columns to each scan, such as those of its path, which a union no longer knows.
    """
    try:
        return placed(spark.read.option("mergeSchema", "true").parquet(*patterns))
    except (Py4JJavaError, PySparkException) as error:  # a failed job reaches Python as either
        if "CANNOT_MERGE_SCHEMAS" not in str(error):
            raise
    folders = sorted({path for pattern in patterns for path in list_glob(spark, pattern)})
    with ThreadPoolExecutor(concurrent) as pool:
        found = pool.map(lambda path: spark.read.parquet(path).schema, folders)
        schemas = dict(zip(folders, found, strict=True))
    classes = schema_classes(schemas)
    wanted = common_schema([schema for _, schema in classes])
    target = {f.name: f.dataType for f in wanted.fields}

    def scan(paths: list[str], schema: StructType) -> DataFrame:
        rows = placed(spark.read.schema(schema).parquet(*paths))
        columns = {f.name: widen(F.col(f"`{f.name}`"), f.dataType, target[f.name]) for f in schema.fields}
        added = [c for c in rows.columns if c not in columns]
        missing = [F.lit(None).cast(target[c]).alias(c) for c in target if c not in columns]
        return rows.select(*[v.alias(c) for c, v in columns.items()], *missing, *added).select(*[f"`{c}`" for c in [*target, *added]])

    return reduce(DataFrame.unionAll, [scan(*members) for members in classes])
