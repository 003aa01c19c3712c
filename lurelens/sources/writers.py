"""Writers of result files."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import CANDIDATE_COLUMNS
from ..functions.dates import day_first


def write_csv(df: DataFrame, path: str, columns: list[str] | None = None, single: bool = False) -> None:
    """CSV with a header; ``columns`` fixes them (missing ones are empty), others are left out.  ``single`` makes one part
    file, for small reports only."""
    out = df
    if columns:
        out = df.select(*(F.col(f"`{c}`") if c in df.columns else F.lit("").alias(c) for c in columns))
    flat = out.select(*(F.to_json(c).alias(c) if t.startswith(("array", "struct", "map")) else F.col(f"`{c}`") for c, t in out.dtypes))
    (flat.coalesce(1) if single else flat).write.mode("overwrite").csv(path, header=True, emptyValue="", nullValue="")


def candidate_rows(matched: DataFrame, source: str, label: str, day: Column, *also: str) -> DataFrame:
    """The nine columns of a candidate file from rows with url, match_domain, match_name, match_score."""
    note = F.concat(F.lit("cse_match_score="), F.format_string("%.6f", "match_score"))
    values = (F.lit(""), F.lit(source), F.col("url"), F.col("match_domain"), F.col("match_name"), F.lit(label), day_first(day), F.lit(""), note)
    return matched.select(*also, *(v.alias(n) for v, n in zip(values, CANDIDATE_COLUMNS, strict=True)))


def write_json(report: dict, df: DataFrame, path: str) -> None:
    """A small report as one JSON text."""
    df.sparkSession.createDataFrame([(json.dumps(report, indent=2, default=str),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def write_hashes(df: DataFrame, path: str) -> None:
    write_csv(df, path, [c for c in df.columns])
