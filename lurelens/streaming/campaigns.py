"""Streaming forms of the campaign and reuse counts.  An extension: the batch rules know no streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def campaign_windows(stream: DataFrame, time_col: str = "ts", hash_col: str = "hash", domain_col: str = "domain", window: str = "7 days", slide: str = "1 day", late: str = "1 day") -> DataFrame:
    """(window_start, window_end, hash, domains): about how many distinct domains show a hash in each sliding window.  State
    is one sketch for each hash and open window; rows later than ``late`` are dropped by the watermark."""
    seen = stream.where(F.col(hash_col).isNotNull() & F.col(domain_col).isNotNull()).withWatermark(time_col, late)
    counted = seen.groupBy(F.window(time_col, window, slide).alias("w"), F.col(hash_col).alias("hash")).agg(F.approx_count_distinct(domain_col, 0.02).alias("domains"))
    return counted.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "hash", "domains")


def first_sightings(stream: DataFrame, keys: list[str], time_col: str = "ts", late: str = "1 day") -> DataFrame:
    """Each key once within the watermark."""
    return stream.withWatermark(time_col, late).dropDuplicatesWithinWatermark(keys)
