"""Conditions and sort keys on event types and app versions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: event types that are never kept, unless the caller names others.
DENIED_TYPES = ("Event1", "Event2", "Event3")

# Fixed value: a version. The dots match any character and the match may be anywhere.
VERSION_PATTERN = r"\d+.\d+.\d+"

# Underscore, comma or any Unicode whitespace. Java's \s leaves out the four information separators even with (?U).
_UNCLEAN_TYPE = r"(?U)[_,\s\x1c-\x1f]"


def is_retained_type(event_type: Column, denied: Iterable[str] = DENIED_TYPES) -> Column:
    """True for a type that is present, not denied and cleanly named. A null type is not retained."""
    wanted = event_type.isNotNull() & ~event_type.rlike(_UNCLEAN_TYPE)
    denied = list(denied)
    return wanted & ~event_type.isin(denied) if denied else wanted


def left_out_reason(event_type: Column, denied: Iterable[str] = DENIED_TYPES) -> Column:
    """Why an event of this type is left out, null if it is retained. A malformed line has no type."""
    denied = list(denied)
    reason = F.when(event_type.isNull(), "no type")
    reason = reason.when(event_type.isin(denied), "denied") if denied else reason
    return reason.when(event_type.rlike(_UNCLEAN_TYPE), "unclean name")


def is_version(version: Column) -> Column:
    return version.cast("string").rlike(VERSION_PATTERN)


def version_numbers(version: Column) -> Column:
    """The runs of digits in a version as numbers, so that 10.0 sorts after 9.0."""
    digits = F.regexp_extract_all(version.cast("string"), F.lit(r"(\d+)"))
    return F.transform(digits, lambda part: part.try_cast("decimal(38,0)"))
