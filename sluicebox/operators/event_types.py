"""Operators on event types."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluicebox.functions.predicates import DENIED_TYPES, is_retained_type, left_out_reason


def distinct_event_types(df: DataFrame) -> DataFrame:
    """Each event type once, greatest first, a missing type last."""
    return df.select("event_type").distinct().orderBy(F.col("event_type").desc())


def retain_event_types(df: DataFrame, denied: Iterable[str] = DENIED_TYPES) -> DataFrame:
    """Rows of the types worth keeping. One predicate on the column; no list of types is collected."""
    return df.where(is_retained_type(F.col("event_type"), denied))


def count_events(df: DataFrame, keys: Iterable[str] = ("event_type", "hh")) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def count_left_out(denied: Iterable[str] = DENIED_TYPES) -> list[Column]:
    """A count of the events that are left out for each reason, for an aggregate or an observation."""
    reason = left_out_reason(F.col("event_type"), denied)
    return [F.count_if(reason == name).alias(name) for name in ("no type", "denied", "unclean name")]


def skipped_events(df: DataFrame, denied: Iterable[str] = DENIED_TYPES) -> DataFrame:
    """How many events of each type are left out, and why."""
    reason = left_out_reason(F.col("event_type"), denied).alias("reason")
    return df.select(reason, "event_type").where("reason IS NOT NULL").groupBy("reason", "event_type").agg(
        F.count(F.lit(1)).alias("n")
    )
