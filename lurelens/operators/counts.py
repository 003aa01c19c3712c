"""Counts across rows: IP reuse and campaigns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import CAMPAIGN_DAYS, UNKNOWN
from ..functions import text as T


def ip_brand_counts(rows: DataFrame, ips, brand) -> DataFrame:
    """(ip, brands): distinct brands for each address in the array column ``ips``."""
    one = rows.select(F.explode(ips).alias("ip"), brand.alias("brand"))
    return one.groupBy("ip").agg(F.count_distinct("brand").alias("brands"))


def source_ip_counts(rows: DataFrame) -> DataFrame:
    """From the source columns; the brand is the name, else the target, else "unknown"."""
    brand = F.coalesce(F.nullif("cse_name", F.lit("")), F.nullif(T.hostname("target_domain"), F.lit("")), F.lit("unknown"))
    return ip_brand_counts(rows, T.ip_list(F.concat_ws(" ", "hosting_ip", "dns_records")), brand)


def mark_shared_ips(rows: DataFrame, key: str = "ord") -> DataFrame:
    """ip_seen_with_many_brands from resolved_ips: 1 if one of a row's addresses serves several brands, -1 without any; the
    brand is the target, else the name, else "unknown"."""
    brand = F.coalesce(F.nullif("target_brand_domain", F.lit("")), F.nullif("critical_sector_entity_name", F.lit("")), F.lit("unknown"))
    ips = T.ip_list(F.col("resolved_ips"))
    shared = ip_brand_counts(rows, ips, brand).where("brands > 1").select("ip")
    hit = rows.select(key, F.explode(ips).alias("ip")).join(shared, "ip", "left_semi").select(key).distinct().withColumn("_hit", F.lit(1))
    joined = rows.drop("ip_seen_with_many_brands").join(hit, key, "left")
    return joined.withColumn("ip_seen_with_many_brands", F.when(F.size(ips) == 0, UNKNOWN).otherwise(F.coalesce("_hit", F.lit(0)))).drop("_hit")


def campaign_counts(rows: DataFrame, hash_col: str = "html_dom_hash", domain_col: str = "domain") -> DataFrame:
    """same_html_hash_domain_count_7d in one batch, where all observations are of one day: distinct domains by hash."""
    filled = rows.where((F.coalesce(F.col(hash_col), F.lit("")) != "") & (F.coalesce(F.col(domain_col), F.lit("")) != ""))
    counted = filled.groupBy(hash_col).agg(F.count_distinct(domain_col).alias("_n"))
    joined = rows.drop("same_html_hash_domain_count_7d").join(counted, hash_col, "left")
    return joined.withColumn("same_html_hash_domain_count_7d", F.coalesce("_n", F.lit(0)).cast("int")).drop("_n")


def campaign_counts_dated(rows: DataFrame, hash_col: str, domain_col: str, day_col: str, days: int = CAMPAIGN_DAYS) -> DataFrame:
    """(hash, day, domains): distinct domains seen within ``days`` around each day on which a hash was seen.  An extension:
    with dates, the window is a true one.  Each observation goes to the days it counts for, so this is one equi-join on
    pre-aggregated rows."""
    seen = rows.where(F.col(hash_col).isNotNull() & F.col(day_col).isNotNull()).select(F.col(hash_col).alias("hash"), F.col(domain_col).alias("domain"), F.to_date(day_col).alias("day")).distinct()
    spread = seen.select("hash", "domain", F.explode(F.transform(F.sequence(F.lit(-days), F.lit(days)), lambda k: F.date_add("day", k))).alias("day"))
    counted = spread.groupBy("hash", "day").agg(F.count_distinct("domain").alias("domains"))
    return counted.join(seen.select("hash", "day").distinct(), ["hash", "day"], "left_semi")
