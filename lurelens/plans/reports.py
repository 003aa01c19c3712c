"""Questions that reviewers ask of classified rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.rules import review_band

SHOWN = ("url", "target_brand_domain", "standard_score", "hardened_score", "validation_status")


def per_class(classified: DataFrame) -> DataFrame:
    return classified.groupBy("final_classification").agg(F.count("*").alias("n"))


def both_models(classified: DataFrame) -> DataFrame:
    return classified.where("standard_prediction = 1 and hardened_prediction = 1").select(*SHOWN)


def hardened_only(classified: DataFrame) -> DataFrame:
    return classified.where("standard_prediction = 0 and hardened_prediction = 1").select(*SHOWN)


def hosts_in(classified: DataFrame, hosts: DataFrame) -> DataFrame:
    """Rows whose host, without www, is in a list (host)."""
    wanted = hosts.select(T.hostname("host").alias("_h")).distinct()
    return classified.join(wanted, T.hostname("url") == F.col("_h"), "left_semi")


def for_review(scored: DataFrame, limit: int = 0) -> DataFrame:
    """The highest scores first, in bands."""
    out = scored.withColumn("band", review_band(F.col("pu_score"))).orderBy(F.desc("pu_score"), "url")
    return out.limit(limit) if limit else out
