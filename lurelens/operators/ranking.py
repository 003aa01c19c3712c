"""Exact positions and quantiles of whole tables, without a window or a sort over all rows in one task."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import delete, keep

#: Bins of a pass over the values; so many counts come to the driver.
BINS = 4096


def positions(rows: DataFrame, order: list[Column], by: list[str] | None = None, out: str = "position") -> DataFrame:
    """``rows`` with ``out``: the place of each row, from 0, in the order of the columns ``order`` among the rows that are
    equal in ``by``.

    Rows are dealt in ranges of (by, order) and sorted within them; a row's place is its number within the range, plus the
    rows of the ranges before it, less those of the groups before its own.  Only one count for each range and group is
    summed up.  ``order`` must tell all rows of a group apart, or ties come in any order.
    """
    by = by or []
    keys = [*(F.col(c) for c in by), *order]
    # The number of a row in its partition is in the low 33 bits; written out once, for the bounds of ranges are drawn anew
    # whenever a range exchange runs again.
    within = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    placed = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    placed = keep(placed.withColumns({"_part": F.spark_partition_id(), "_local": within}), "ranges")
    counted = placed.groupBy("_part").agg(F.count("*").alias("_n"))  # one row for each range
    before = counted.withColumn("_before", F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).select("_part", "_before")
    place = F.col("_before") + F.col("_local")
    if not by:
        return placed.join(F.broadcast(before), "_part").select(*rows.columns, place.alias(out))
    starts = placed.groupBy("_part", *by).agg(F.min("_local").alias("_local")).join(before, "_part").groupBy(*by).agg(F.min(place).alias("_start"))
    starts = starts.select(F.struct(*by).alias("_g"), "_start")
    same = [F.col(f"_g.{c}").eqNullSafe(placed[c]) for c in by]
    return placed.join(F.broadcast(before), "_part").join(starts, same).select(*rows.columns, (place - F.col("_start")).alias(out))


@dataclass
class Ranked:
    value: float  #: the value at a place
    below: int  #: rows with lesser values
    equal: int  #: rows with this value


def _finite(rows: DataFrame, column: str) -> DataFrame:
    x = F.col(column).cast("double")
    return rows.select(x.alias("x")).where(F.col("x").isNotNull() & (F.abs("x") < float("inf")))


def nth_value(rows: DataFrame, column: str, place: int) -> Ranked | None:
    """The value at ``place``, from 0, of the sorted finite values of a column; None if there are not so many.

    Each pass counts the values in equal bins between the bounds and goes on within the one bin that holds the place,
    until all its values are the same.  A pass is one scan with map-side counts; a bin's own least and greatest value
    bound the next pass, so the range shrinks by the number of bins each time, and ties end it at once.
    """
    values = _finite(rows, column)
    low, high, n = values.agg(F.min("x"), F.max("x"), F.count("x")).first()
    if place < 0 or place >= n:
        return None
    below, total = 0, n
    while low < high:
        width = high / BINS - low / BINS  # the difference itself may be too large for a double
        inside = values.where(F.col("x").between(low, high))
        if 0 < width and max(abs(low), abs(high)) / width < 2**40:
            bin_of = F.least(F.floor(F.col("x") / width - F.lit(low / width)).cast("int"), F.lit(BINS - 1))
        else:  # neighbours, for their size: halves tell them apart
            middle = low / 2 + high / 2
            bin_of = (F.col("x") > (middle if low <= middle < high else low)).cast("int")
        counted = inside.groupBy(bin_of.alias("bin")).agg(F.count("*").alias("n"), F.min("x").alias("low"), F.max("x").alias("high"))
        for row in sorted(counted.collect()):  # BINS rows at most
            if below + row["n"] > place:
                low, high, total = row["low"], row["high"], row["n"]
                break
            below += row["n"]
    return Ranked(low, below, total)


def quantile(rows: DataFrame, column: str, share: float) -> float | None:
    """The exact quantile of a column's finite values, between two values in proportion; None without any."""
    values = keep(_finite(rows, column), "values")
    n = values.count()
    found = None
    if n:
        at = share * (n - 1)
        first = int(at)
        low = nth_value(values, "x", first)
        if at == first or low.below + low.equal > first + 1:
            found = low.value
        else:
            found = (first + 1 - at) * low.value + (at - first) * values.where(F.col("x") > low.value).agg(F.min("x")).first()[0]
    delete(values)
    return found


def lowest(rows: DataFrame, column: str, key: str, n: int) -> DataFrame:
    """The ``n`` rows of the least values of a column, ties by ``key``: those under the value at that place, and of its ties
    as many as are lacking."""
    last = nth_value(rows, column, n - 1) if n > 0 else None
    if last is None:
        return rows if n > 0 else rows.limit(0)
    value = F.col(column).cast("double")
    tied = rows.where(value == last.value)
    if last.below + last.equal > n:
        tied = positions(tied, [F.col(key)], out="_place").where(F.col("_place") < n - last.below).drop("_place")
    return rows.where(value < last.value).unionByName(tied)
