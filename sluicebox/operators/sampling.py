"""Samples of the rows that carry the newest version."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluicebox.operators.lookups import join_lookup
from sluicebox.operators.versions import KEYS, VERSION

SAMPLE_ROWS = 10
LANES = 512


def bernoulli_sample(df: DataFrame, fraction: float, seed: int = 0) -> DataFrame:
    """Each row with the given probability, without replacement; 1.0 keeps every row."""
    return df if fraction == 1.0 else df.sample(False, fraction, seed)


def _row_order(df: DataFrame, order_by: Sequence[str]) -> list[Column]:
    """A repeatable order: the named columns, or a hash of the whole row."""
    if order_by:
        return [F.col(f"`{c}`") for c in order_by]
    return [F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])]


def first_rows(
    df: DataFrame, keys: Sequence[str], rows: int, order_by: Sequence[str] = (), lanes: int = LANES
) -> DataFrame:
    """The first ``rows`` rows of each group.

    A task keeps at most ``rows`` per group before each shuffle. The first shuffle spreads a group over lanes (one
    lane per scan task, up to ``lanes``), so that the survivors of very many scan tasks do not all go to one task.
    """
    order = _row_order(df, order_by)
    by_lane = Window.partitionBy(*keys, "LANE").orderBy(*order)
    by_group = Window.partitionBy(*keys).orderBy(*order)
    laned = df.withColumn("LANE", F.spark_partition_id() % lanes)
    survivors = laned.withColumn("RANK", F.row_number().over(by_lane)).where(F.col("RANK") <= rows)
    ranked = survivors.drop("LANE", "RANK").withColumn("sample_rank", F.row_number().over(by_group))
    return ranked.where(F.col("sample_rank") <= rows)


def newest_version_sample(
    df: DataFrame,
    newest: DataFrame,
    keys: Sequence[str] = KEYS,
    version: str = VERSION,
    rows: int = SAMPLE_ROWS,
    order_by: Sequence[str] = (),
    fraction: float = 1.0,
) -> DataFrame:
    """Up to ``rows`` rows per group among those of its newest version, ranked in ``sample_rank``."""
    matching = join_lookup(df, newest, [*keys, version]).select(*[f"`{c}`" for c in df.columns])
    return first_rows(bernoulli_sample(matching, fraction), keys, rows, order_by)
