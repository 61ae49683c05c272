"""Run dates, and the paths and names made from them."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_day(text: str) -> date:
    """``20180601`` -> a date; anything else is a ValueError."""
    return datetime.strptime(text, "%Y%m%d").date()


def day_path(text: str) -> str:
    """``20180601`` -> ``2018/06/01``."""
    day = parse_day(text)
    return f"{day.year:04d}/{day.month:02d}/{day.day:02d}"


def hour_name(hour: int) -> str:
    if not 0 <= hour <= 23:
        raise ValueError(f"hour out of range: {hour}")
    return f"{hour:02d}"


def dated_table(name: str, text: str) -> str:
    """``test.user_info`` on ``20180601`` -> ``test.user_info_20180601``."""
    parse_day(text)
    return f"{name}_{text}"


def under(root: str, *parts: str) -> str:
    """Join path parts with single slashes, whether or not the root ends in one."""
    return "/".join([root.rstrip("/"), *(part.strip("/") for part in parts)])


def hour_column(ts: Column) -> Column:
    """Two-digit hour of a timestamp column."""
    return F.date_format(ts, "HH")


def day_path_column(ts: Column) -> Column:
    """``yyyy/MM/dd`` of a timestamp column."""
    return F.date_format(ts, "yyyy/MM/dd")


def day_column(text: Column) -> Column:
    """Date of a ``yyyyMMdd`` text column; null where the text is no date."""
    return F.try_to_timestamp(text, F.lit("yyyyMMdd")).cast("date")
