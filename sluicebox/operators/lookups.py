"""Joins of a large table with a derived lookup table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame


def join_lookup(facts: DataFrame, lookup: DataFrame, on: Sequence[str]) -> DataFrame:
    """Inner join with a written lookup that has one row per key.

    Adaptive execution broadcasts the lookup if its measured size allows that. Else both sides are shuffled and sorted,
    and it divides the hot keys.
    """
    return facts.join(lookup, list(on))
