"""Confusion counts, threshold sweeps, folds and negatives."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import threshold_grid
from ..functions import text as T
from ..storage import keep
from .ranking import lowest, nth_value, positions, quantile

COUNTS = ("tp", "fp", "tn", "fn")
AVERAGED = ("accuracy", "precision", "recall", "specificity", "balanced_accuracy", "f1")


def rate(a: Column, b: Column) -> Column:
    return F.when(b == 0, F.lit(0.0)).otherwise(a / b)


def confusion_aggregates(truth: Column, predicted: Column) -> list[Column]:
    hit = lambda t, p: F.count_if((truth == t) & (predicted == p))
    return [hit(1, 1).alias("tp"), hit(0, 1).alias("fp"), hit(0, 0).alias("tn"), hit(1, 0).alias("fn")]


def with_ratios(counted: DataFrame) -> DataFrame:
    """The ratios of a table with tp, fp, tn, fn; 0 where there is nothing to divide by."""
    tp, fp, tn, fn = (F.col(c) for c in COUNTS)
    out = counted.withColumns({
        "rows": tp + fp + tn + fn, "positives": tp + fn, "negatives": tn + fp, "accuracy": rate(tp + tn, tp + fp + tn + fn), "precision": rate(tp, tp + fp),
        "recall": rate(tp, tp + fn), "specificity": rate(tn, tn + fp), "false_positive_rate": rate(fp, fp + tn), "false_negative_rate": rate(fn, fn + tp),
    })
    p, r = F.col("precision"), F.col("recall")
    return out.withColumns({"f1": rate(2 * p * r, p + r), "balanced_accuracy": (r + F.col("specificity")) / 2})


def confusion(rows: DataFrame, truth: str, predicted: str, *by: str) -> DataFrame:
    return with_ratios(rows.groupBy(*by).agg(*confusion_aggregates(F.col(truth), F.col(predicted))))


def metric_summary(rows: DataFrame, truth: str, score: str, threshold: float) -> DataFrame:
    """The confusion with the lowest positive and the highest negative score."""
    t, s = F.col(truth), F.col(score)
    counted = rows.agg(*confusion_aggregates(t, (s >= threshold).cast("int")), F.min(F.when(t == 1, s)).alias("positive_score_min"), F.max(F.when(t == 0, s)).alias("negative_score_max"))
    return with_ratios(counted)


def threshold_sweep(rows: DataFrame, truth: str, score: str) -> DataFrame:
    """(k, threshold, counts, ratios) at each of the 181 thresholds.

    One pass: a row falls into the bin of the highest threshold it reaches; sums over the bins from the top, of which
    there are 182, give the counts.  The data is never joined with the grid.
    """
    grid = threshold_grid()
    spark = rows.sparkSession
    s = F.coalesce(F.col(score).cast("double"), F.lit(-1.0))
    # The grid point at or below the score: guessed by its step, then set right by comparing with the neighbours.
    points = F.array(*map(F.lit, grid))
    guess = F.floor((s - grid[0]) / 0.005 + 0.5).cast("int")
    at = lambda k: F.coalesce(F.get(points, k), F.lit(float("inf")))
    k = F.least(F.greatest(guess, F.lit(-1)), F.lit(len(grid) - 1))
    reached = F.when((k >= 0) & (at(k) > s), k - 1).when((k < len(grid) - 1) & (at(k + 1) <= s), k + 1).otherwise(k)
    binned = rows.where(F.col(truth).isin(0, 1)).groupBy(reached.alias("bin")).agg(F.count_if(F.col(truth) == 1).alias("p"), F.count_if(F.col(truth) == 0).alias("n"))
    table = spark.createDataFrame([(i, float(x)) for i, x in enumerate(grid)], "k int, threshold double")
    every = F.broadcast(binned)  # at most 182 rows
    counted = table.join(every, F.lit(True), "left").groupBy("k", "threshold").agg(*(F.coalesce(F.sum(F.when(c, F.col(v))), F.lit(0)).alias(name) for name, v, c in (
        ("tp", "p", F.col("bin") >= F.col("k")), ("fp", "n", F.col("bin") >= F.col("k")), ("tn", "n", F.col("bin") < F.col("k")), ("fn", "p", F.col("bin") < F.col("k"))
    )))
    return with_ratios(counted)


def choose_threshold(sweep: DataFrame, target_recall: float) -> DataFrame:
    """One row: of the thresholds that reach the recall, the one of the best (precision, f1, threshold); if none does, the
    lowest one of the best (f1, recall, precision)."""
    fit = F.col("recall") >= target_recall
    zero = F.lit(0.0)
    key = F.struct(fit.cast("int"), F.when(fit, F.col("precision")).otherwise(F.col("f1")), F.when(fit, F.col("f1")).otherwise(F.col("recall")), F.when(fit, zero).otherwise(F.col("precision")), F.when(fit, F.col("k")).otherwise(-F.col("k")))
    columns = sweep.columns
    return sweep.agg(F.max_by(F.struct(*columns), key).alias("best")).select(*(F.col(f"best.{c}").alias(c) for c in columns))


def fold_summary(folds: DataFrame, metrics: tuple[str, ...] = AVERAGED) -> DataFrame:
    """Mean and population deviation of each metric over the folds."""
    return folds.agg(*(f(m).alias(f"{m}_{n}") for m in metrics for f, n in ((F.avg, "mean"), (F.stddev_pop, "std"))))


def fold_order(key: Column, seed: int) -> Column:
    """A shuffle by hash, the same in every engine that has MD5."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")).cast("binary"))


def assign_folds(rows: DataFrame, role: str, key: str, folds: int, seed: int) -> DataFrame:
    """``fold``: rows of each role are shuffled and dealt to the folds in turn."""
    placed = positions(rows, [fold_order(F.col(key), seed), F.col(key)], [role], "_place")
    return placed.select(*rows.columns, (F.col("_place") % folds).cast("int").alias("fold"))


def group_holdout(rows: DataFrame, group: str, split: int, seed: int, share: float = 0.25) -> DataFrame:
    """``is_test``: a quarter of the distinct groups, rounded up, drawn by hash; whole groups stay together."""
    groups = keep(rows.select(F.coalesce(F.col(group).cast("string"), F.lit("")).alias("_g")).distinct(), "groups")
    size = math.ceil(groups.count() * share)
    drawn = positions(groups, [fold_order(F.col("_g"), seed + split), F.col("_g")], out="_place").select("_g", (F.col("_place") < size).alias("is_test"))
    return rows.join(drawn, F.coalesce(F.col(group).cast("string"), F.lit("")) == F.col("_g")).drop("_g")


def reliable_negatives(scored: DataFrame, score: str, key: str, quantile_share: float, most: float, least_rows: int) -> DataFrame:
    """``scored`` with cutoff and is_reliable: scores up to the quantile, but no more than ``most``; if those are fewer
    than ``least_rows``, the lowest ``least_rows`` instead.

    Quantile and lowest rows are exact and found by counting, so no task holds all rows.  Without a score nothing is
    reliable and the cutoff is null.
    """
    found = quantile(scored, score, quantile_share)
    cutoff = None if found is None else min(found, most)
    n, under = scored.agg(F.count("*"), F.count_if(F.col(score) <= F.lit(cutoff))).first()
    if cutoff is not None and under < min(least_rows, n):
        low = lowest(scored, score, key, least_rows).select(F.col(key).alias("_key")).withColumn("_low", F.lit(True))
        cutoff = nth_value(scored, score, min(least_rows, n) - 1).value
        marked = scored.join(low, F.col(key) == F.col("_key"), "left").drop("_key")
        return marked.withColumn("cutoff", F.lit(cutoff)).withColumn("is_reliable", F.coalesce("_low", F.lit(False))).drop("_low")
    reliable = F.coalesce(F.col(score) <= F.lit(cutoff), F.lit(False))
    return scored.withColumn("cutoff", F.lit(cutoff).cast("double")).withColumn("is_reliable", reliable)


def numeric_features(rows: DataFrame, excluded: tuple[str, ...]) -> tuple[DataFrame, list[str]]:
    """(rows with the features as doubles, their names): columns that hold numbers and vary; what is no finite number is
    -1.  One pass counts all columns at once."""
    names = [c for c in rows.columns if c not in excluded]

    def value(c: str) -> Column:
        text = F.lower(F.col(c).cast("string"))
        plain = F.when(text.isin("true"), F.lit(1.0)).when(text.isin("false"), F.lit(0.0)).otherwise(F.expr(f"try_cast(`{c}` AS double)"))
        return F.when(F.isnan(plain) | (F.abs(plain) == float("inf")), F.lit(None)).otherwise(plain)

    kinds = dict(rows.dtypes)
    names = [c for c in names if not kinds[c].startswith(("array", "map", "struct", "binary", "date", "timestamp"))]
    seen = rows.agg(*(F.count(value(c)).alias(f"n_{i}") for i, c in enumerate(names)), *(f(F.coalesce(value(c), F.lit(-1.0))).alias(f"{g}_{i}") for i, c in enumerate(names) for f, g in ((F.min, "a"), (F.max, "b")))).first()
    kept = [c for i, c in enumerate(names) if seen[f"n_{i}"] and seen[f"a_{i}"] != seen[f"b_{i}"]]
    return rows.withColumns({c: F.coalesce(value(c), F.lit(-1.0)) for c in kept}), kept


def truth_column(rows: DataFrame, candidates: tuple[str, ...]) -> str:
    """The first candidate column with a usable label, found in one pass; "" if there is none."""
    there = [c for c in candidates if c in rows.columns]
    if not there:
        return ""
    kinds = dict(rows.dtypes)
    numeric = lambda c: kinds[c] in ("int", "bigint", "double", "float", "smallint", "tinyint") or kinds[c].startswith("decimal")
    seen = rows.agg(*(F.count(T.truth(F.col(f"`{c}`"), numeric(c))).alias(f"n{i}") for i, c in enumerate(there))).first()
    return next((c for i, c in enumerate(there) if seen[f"n{i}"]), "")
