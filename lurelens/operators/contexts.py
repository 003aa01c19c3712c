"""Relational operators on candidate rows.  ``ord`` is the input order; first-wins rules and ties go by it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import COMPACT_BOOLEAN, COMPACT_COLUMNS, COMPACT_TEXT, DNS_FAILED_COLUMNS, UNKNOWN
from ..functions import text as T
from .hosts import resolve

MERGED = ("target_domain", "cse_name", "registrar_name", "registrant_name", "registrant_country", "nameservers", "hosting_ip", "hosting_isp", "hosting_country", "dns_records", "remarks", "source_file", "source_row")


def merge_contexts(rows: DataFrame, fields: tuple[str, ...] = MERGED) -> DataFrame:
    """One row for each (detected_domain, host of target_domain): the first URL, the label of the highest priority (the
    first of equals), and of every other field the first non-empty value."""
    keyed = rows.withColumn("_target", T.hostname("target_domain"))
    filled = lambda c: (F.coalesce(F.col(c).cast("string"), F.lit("")) != "")
    return (
        keyed.groupBy("detected_domain", "_target")
        .agg(
            F.min("ord").alias("ord"),
            F.min_by("url", "ord").alias("url"),
            F.max_by("source_label", F.struct(T.label_priority(F.col("source_label")), -F.col("ord"))).alias("source_label"),
            *(F.min_by(F.when(filled(c), F.col(c)), F.when(filled(c), F.col("ord"))).alias(c) for c in fields if c in rows.columns),
        )
        .drop("_target")
    )


def official_split(rows: DataFrame, brands: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(candidates, official): rows whose host is exactly a brand domain or some row's target are official; hosts below
    an official domain are candidates."""
    targets = rows.select(T.hostname("target_domain").alias("official"))
    official = brands.select(F.col("domain").alias("official")).union(targets).where("official <> ''").distinct()
    host = T.hostname("detected_domain")
    kept = rows.join(official, host == F.col("official"), "left_anti")
    removed = rows.join(official, host == F.col("official")).select(
        "url", F.col("detected_domain").alias("domain"), T.hostname("target_domain").alias("target_brand_domain"), F.col("official").alias("matched_official_domain"),
        "source_label", "source_file", "source_row", F.lit("filtered_official_domain").alias("validation_status"), F.lit("exact official domain").alias("validation_reason"),
    )
    return kept, removed


def official_or_below(rows: DataFrame, official: DataFrame, host: str = "host") -> DataFrame:
    """Rows whose host is an official domain or lies below one: the host's suffixes are looked up, by an equi-join."""
    labels = F.split(F.col(host), r"\.")
    ends = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, -i, i), "."))
    keys = rows.select(host).distinct().where(F.col(host) != "").select(host, F.explode(ends).alias("domain"))
    return rows.join(keys.join(official.select("domain").distinct(), "domain", "left_semi").select(host).distinct(), host, "left_semi")


def dns_split(rows: DataFrame, dns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(active, failed) by DNS evidence on the host; rows without evidence have failed."""
    joined = rows.join(dns.withColumnRenamed("host", "_host"), T.hostname("detected_domain") == F.col("_host"), "left").drop("_host")
    active = F.coalesce(F.col("dns_check_pass") == 1, F.lit(False))
    failed = joined.where(~active).select(
        "url", F.col("detected_domain").alias("domain"), T.hostname("target_domain").alias("target_brand_domain"), F.col("cse_name").alias("critical_sector_entity_name"),
        "source_label", "source_file", "source_row", F.coalesce("status", F.lit("error")).alias("dns_status"), *(F.coalesce(c, F.lit(0)).alias(c) for c in ("dns_check_pass", "dns_resolves_to_ip")),
        F.coalesce("resolved_ips", F.lit("")).alias("resolved_ips"), *(F.coalesce(c, F.lit(0)).alias(c) for c in ("cname_exists", "cname_chain_length")), F.coalesce("dns_error", F.lit("")).alias("dns_error"),
        F.lit("dns_failed_skipped").alias("validation_status"), F.lit("DNS failed before feature extraction; excluded from ML input").alias("validation_reason"),
    ).select(*DNS_FAILED_COLUMNS)
    return joined.where(active).select(*rows.columns), failed


def dns_counts(active: DataFrame, failed: DataFrame) -> DataFrame:
    """(source, active, skipped) rows by source file."""
    source = lambda df: F.coalesce(F.nullif(F.col("source_file"), F.lit("")), F.lit("unknown"))
    both = active.select(source(active).alias("source"), F.lit(1).alias("a"), F.lit(0).alias("s")).union(failed.select(source(failed), F.lit(0), F.lit(1)))
    return both.groupBy("source").agg(F.sum("a").alias("active"), F.sum("s").alias("skipped"))


def dedupe_by_priority(rows: DataFrame, keys: list[str], label: str = "label", ord_col: str = "ord") -> DataFrame:
    """One row for each key: the one of the highest label priority (the first of equals), in the place of the first."""
    priority = F.struct(T.label_priority(F.col(label)), -F.col(ord_col))
    rest = [c for c in rows.columns if c not in (*keys, ord_col)]
    top = rows.groupBy(*keys).agg(F.min(ord_col).alias(ord_col), F.max_by(F.struct(*rest), priority).alias("_row"))
    return top.select(*keys, ord_col, *(F.col(f"_row.{c}").alias(c) for c in rest)).select(*rows.columns)


def first_of_each(rows: DataFrame, keys: list[str], ord_col: str = "ord") -> DataFrame:
    """The first row of each key."""
    rest = [c for c in rows.columns if c not in keys]
    top = rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), ord_col).alias("_row"))
    return top.select(*keys, *(F.col(f"_row.{c}").alias(c) for c in rest)).select(*rows.columns)


def cap(rows: DataFrame, limit: int, *order: str) -> DataFrame:
    """The first ``limit`` rows; 0 keeps all."""
    return rows.orderBy(*order).limit(limit) if limit > 0 else rows


def top_counts(rows: DataFrame, column: str, limit: int = 8) -> DataFrame:
    """The most frequent values with their counts; ties by value."""
    return rows.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column).limit(limit)


def enforce_schema(rows: DataFrame, columns: tuple[str, ...] = COMPACT_COLUMNS) -> DataFrame:
    """The fixed columns; null and "" become false, "unknown" or -1 by kind."""

    def one(c: str):
        default = F.lit(False) if c in COMPACT_BOOLEAN else F.lit("unknown") if c in COMPACT_TEXT else F.lit(UNKNOWN)
        if c not in rows.columns:
            return default.alias(c)
        kind = "boolean" if c in COMPACT_BOOLEAN else "string" if c in COMPACT_TEXT else "double"
        value = F.col(c).cast(kind)
        if kind == "boolean":  # -1 stands for unknown in flags, and is kept as null before the default
            value = F.when(F.col(c).cast("string") != "-1", value)
        return F.coalesce(F.nullif(value, F.lit("")) if kind == "string" else value, default).alias(c)

    return rows.select(*(one(c) for c in columns))


def failed_rows(rows: DataFrame, status: str = "failed") -> DataFrame:
    """Placeholders with defaults for rows whose extraction failed."""
    empty = enforce_schema(rows.select(F.lit(None).cast("string").alias("_none")))
    return empty.withColumn("extraction_status", F.lit(status)).withColumn("validation_status", F.lit("extraction_failed")).withColumn("validation_reason", F.lit("row-level extraction failed")).withColumn("label", F.lit(0))


def in_order(rows: DataFrame, ord_col: str = "ord") -> DataFrame:
    return rows.orderBy(ord_col)


def union_all(*parts: DataFrame) -> DataFrame:
    """All rows; columns that a part lacks are null there."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def registered_changes(chain: DataFrame, key: str, order: str, url: str, suffixes: T.Suffixes | DataFrame) -> DataFrame:
    """(key, changes): how often the registered domain differs from that of the URL before it in the chain."""
    w = Window.partitionBy(key).orderBy(order)
    chain, (known,) = resolve(chain.withColumn("_h", T.hostname(url)), {"_sh": F.col("_h")}, suffixes)
    seen = chain.withColumn("_d", T.registered_domain(F.col("_h"), known)).withColumn("_p", F.lag("_d").over(w))
    return seen.groupBy(key).agg(F.sum(((F.coalesce("_p", F.lit("")) != "") & (F.col("_d") != "") & (F.col("_d") != F.col("_p"))).cast("int")).alias("changes"))
