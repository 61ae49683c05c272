"""App versions per group of events; a group is an event type within an hour unless the caller says otherwise."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sluicebox.functions.predicates import is_version, version_numbers

KEYS = ("hh", "event_type")
VERSION = "app_version_name"
TOP_VERSIONS = 100


def version_counts(df: DataFrame, keys: Sequence[str] = KEYS, version: str = VERSION) -> DataFrame:
    """Events per version; events without a version are a version of their own."""
    return df.groupBy(*keys, version).agg(F.count(F.lit(1)).alias("n"))


def top_versions(
    df: DataFrame, keys: Sequence[str] = KEYS, version: str = VERSION, limit: int = TOP_VERSIONS
) -> DataFrame:
    """The greatest versions of each group as text, with their counts and ranks.

    Rows are counted per version first, then each task keeps its ``limit`` best per group before the shuffle, so a
    group with very many rows or versions does not meet in one task.
    """
    order = Window.partitionBy(*keys).orderBy(F.col(version).desc_nulls_last())
    ranked = version_counts(df, keys, version).withColumn("version_rank", F.row_number().over(order))
    return ranked.where(F.col("version_rank") <= limit)


def newest_version(
    df: DataFrame,
    keys: Sequence[str] = KEYS,
    version: str = VERSION,
    order: str = "text",
) -> DataFrame:
    """The newest of all matching versions of each group; a group in which none matches the pattern has no row.

    ``text`` takes the greatest string, so 9.0.0 is newer than 10.0.0; ``numeric`` compares the numbers.
    """
    matching = df.select(*keys, version).where(is_version(F.col(version)))
    if order == "text":
        return matching.groupBy(*keys).agg(F.max(version).alias(version))
    if order == "numeric":
        newest = F.max(F.struct(version_numbers(F.col(version)), F.col(version).alias("text")))
        return matching.distinct().groupBy(*keys).agg(newest.getField("text").alias(version))
    raise ValueError(f"order must be 'text' or 'numeric', not {order!r}")
