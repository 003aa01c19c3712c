"""Dates; "today" is always a parameter."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import UNKNOWN
from .text import clean


def observation_date(x: Column, today: Column) -> Column:
    """The date that a text begins with, in one of four formats, or any that Spark reads; else ``today``."""
    text = F.substring(clean(x), 1, 10)
    parsed = [F.try_to_date(F.when(text.rlike(p), text), f) for p, f in ((r"^\d{4}-\d{1,2}-\d{1,2}$", "yyyy-M-d"), (r"^\d{1,2}-\d{1,2}-\d{4}$", "d-M-yyyy"), (r"^\d{1,2}/\d{1,2}/\d{4}$", "d/M/yyyy"), (r"^\d{4}/\d{1,2}/\d{1,2}$", "yyyy/M/d"))]
    return F.coalesce(*parsed, F.to_date(F.try_to_timestamp(clean(x))), today)


def age_days(created: Column, observed: Column) -> Column:
    """Days since; at least 0; -1 if unknown."""
    days = F.datediff(observed, created)
    return F.when(days < 0, 0).otherwise(F.coalesce(days, F.lit(UNKNOWN)))


def expiry_days(expires: Column, observed: Column) -> Column:
    """Days until, negative when past; -1 if unknown."""
    return F.coalesce(F.datediff(expires, observed), F.lit(UNKNOWN))


def age_exact(created: Column, now: Column) -> Column:
    """Whole days between two instants, at least 0; -1 if unknown."""
    days = F.floor((F.unix_timestamp(now) - F.unix_timestamp(created)) / 86400)
    return F.when(days < 0, 0).otherwise(F.coalesce(days, F.lit(UNKNOWN))).cast("int")


def expiry_exact(expires: Column, now: Column) -> Column:
    return F.coalesce(F.floor((F.unix_timestamp(expires) - F.unix_timestamp(now)) / 86400), F.lit(UNKNOWN)).cast("int")


def registry_time(x: Column) -> Column:
    """An RFC 3339 time, with or without fraction and zone, or a plain date; else null."""
    return F.when(x.rlike(r"^\d{4}-\d{2}-\d{2}(T\d{2}:\d{2}:\d{2}(\.\d{1,6})?(Z|[+-]\d{2}:?\d{2})?)?$"), F.try_to_timestamp(x))


def day_first(day: Column) -> Column:
    return F.date_format(day, "dd-MM-yyyy")
