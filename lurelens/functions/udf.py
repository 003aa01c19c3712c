"""Vectorised functions that are made when they are first used, so that modules can be imported without a session.
Their Arrow batches are bounded by bytes, so that a worker holds as much whatever the rows' sizes are."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, SparkSession
from pyspark.sql.functions import pandas_udf

#: Most bytes of an Arrow batch, as a batch of 10,000 pages may have any size; a lower bound of the session's stays.
BATCH_BYTES, LIMIT = 4 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"


def bound_batches(spark: SparkSession) -> None:
    now = spark.conf.get(LIMIT).lower().removesuffix("b")
    if not (now.isdigit() and 0 < int(now) <= BATCH_BYTES):
        spark.conf.set(LIMIT, str(BATCH_BYTES))


def vectorized(returns: str) -> Callable:
    """Like ``pandas_udf(returns)``, but without a session at the time of definition."""

    def wrap(f: Callable) -> Callable[..., Column]:
        def call(*columns: Column | str) -> Column:
            bound_batches(SparkSession.active())
            return pandas_udf(f, returns)(*columns)

        call.__doc__, call.__name__, call.__wrapped__ = f.__doc__, f.__name__, f
        return call

    return wrap
