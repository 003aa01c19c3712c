"""The enrichment plan: load, merge, match, filter, gate, enrich, label."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Settings
from ..operators import contexts as C
from ..operators.counts import campaign_counts, mark_shared_ips
from ..operators.evidence import feature_rows
from ..operators.match import match_brands, split_by_match
from ..operators.rules import label_rows


@dataclass
class Enriched:
    features: DataFrame  #: all rows, labelled, with every column
    compact: DataFrame  #: the same rows in the fixed columns
    failed: DataFrame  #: rows without a match or without DNS
    official: DataFrame  #: rows that are official domains


def finalize(rows: DataFrame) -> DataFrame:
    """Campaign counts and rule labels over all rows."""
    return label_rows(campaign_counts(rows))


def ml_rows(finalized: DataFrame) -> DataFrame:
    return finalized.where("include_in_ml = 1")


def enrich(contexts: DataFrame, brands: DataFrame, settings: Settings, evidence: dict[str, DataFrame] | None = None, references: dict[str, DataFrame] | None = None) -> Enriched:
    """From raw candidate rows (sources.readers.CONTEXT and ord) to labelled feature rows."""
    merged = C.merge_contexts(contexts)
    kept, unmatched = split_by_match(match_brands(merged, brands, settings), settings)
    candidates, official = C.official_split(kept, brands)
    failed = unmatched
    if evidence and "dns" in evidence:
        candidates, dns_failed = C.dns_split(candidates, evidence["dns"])
        failed = C.union_all(unmatched, dns_failed)
    features = feature_rows(candidates, brands, settings, evidence, references)
    features = finalize(mark_shared_ips(features))
    return Enriched(features, C.enforce_schema(features), failed, official)


def imitation_report(urls: DataFrame, brands: DataFrame, official: DataFrame, settings: Settings) -> DataFrame:
    """(host, matched_brand, score, distance, is_official) for each distinct host of ``urls`` (url)."""
    from ..functions import text as T

    hosts = urls.select(T.hostname("url").alias("host")).where("host <> ''").distinct()
    rows = hosts.select(F.concat(F.lit("http://"), F.col("host")).alias("url"), F.col("host").alias("detected_domain"), F.lit("").alias("target_domain"), F.lit("").alias("cse_name"))
    matched = match_brands(rows, brands, settings)
    listed = official.select(F.col("domain").alias("_o")).distinct()
    return matched.join(listed, F.col("host") == F.col("_o"), "left").select(
        "host", F.coalesce("match_domain", F.lit("")).alias("matched_brand"), "match_score", F.col("min_edit_distance_to_brand_domain").alias("distance"), F.col("_o").isNotNull().alias("is_official"),
    )
