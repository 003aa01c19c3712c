"""Two-step positive-unlabeled training of random forests, and scoring with two models.

The procedure is the point, not equal scores.  Features are binned once into a table of packed vectors, which all forests
(``forest.py``) are fitted on, those of independent folds and draws side by side.  Rows carry a key; folds
and splits are by hash of it, so they do not depend on how the rows lie.
"""

from __future__ import annotations

import itertools
import json
import random
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import HARDENED_COLUMNS, LEAK_COLUMNS, TRUTH_COLUMNS, Settings
from ..functions import text as T
from ..operators import metrics as M
from ..operators.ranking import positions
from ..operators.rules import final_decision, pu_roles, training_role
from ..storage import delete, keep
from . import forest
from .forest import Forest, Growth

MODEL_COLUMNS = {"standard": ("standard_score", "standard_threshold", "standard_prediction"), "hardened": ("hardened_score", "hardened_threshold", "hardened_prediction")}
DECISION_COLUMNS = ("final_classification", "classification_confidence", "recommended_action", "classification_reason")


@dataclass
class Trained:
    model: Forest
    threshold: float
    features: list[str]
    summary: dict = field(default_factory=dict)
    scored: DataFrame | None = None
    cross_validated: DataFrame | None = None

    def importances(self) -> list[tuple[str, float]]:
        values = self.model.gains(SparkSession.getActiveSession())
        return sorted(zip(self.features, values, strict=True), key=lambda x: (-x[1], x[0]))

    def save(self, path: str) -> None:
        self.model.save(f"{path}/model")
        meta = json.dumps({"threshold": self.threshold, "features": self.features, "summary": self.summary}, default=str)
        SparkSession.getActiveSession().createDataFrame([(meta,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")

    @staticmethod
    def load(spark: SparkSession, path: str) -> Trained:
        meta = json.loads(spark.read.text(f"{path}/meta", wholetext=True).first()["value"])
        return Trained(Forest.load(f"{path}/model"), meta["threshold"], meta["features"], meta["summary"])


#: What options are drawn from: 72 combinations.  Depth 0 is no bound.
GRID = {"trees": (100, 200, 300), "depth": (0, 10, 20), "split": (2, 5), "leaf": (1, 2), "weights": ("balanced_subsample", "balanced")}
BINS = 64
#: Forests that are fitted at the same time; Spark deals their tasks.
SIDE_BY_SIDE = 8


def binning(table: DataFrame, features: list[str], bins: int = BINS) -> Bucketizer:
    """The bins of each feature, found once for all forests: between all values where they are few, else at quantiles, which
    are closer together at both ends."""
    distinct = table.agg(*(F.approx_count_distinct(c).alias(c) for c in features)).first()
    few = [c for c in features if distinct[c] <= bins * 3 // 4]
    shares = sorted({k / bins for k in range(1, bins)} | {e for k in (8, 10, 12) for e in (2.0**-k, 1 - 2.0**-k)})
    found = table.agg(*(F.sort_array(F.collect_set(c)).alias(c) if c in few else F.array_distinct(F.percentile_approx(c, shares, 10_000)).alias(c) for c in features)).first()
    splits = [[-float("inf"), *(found[c][1:] if c in few else found[c]), float("inf")] for c in features]
    return Bucketizer(inputCols=features, outputCols=[f"{c}_bin" for c in features], splitsArray=[x if len(x) > 2 else [-float("inf"), 0.0, float("inf")] for x in splits])


@dataclass
class Forests:
    """Fits forests of one packed table: ``rows`` have the bins of all features as one vector, and whatever marks the fold
    or the draw a row takes part in."""

    bins: Bucketizer
    s: Settings

    def fit(self, rows: DataFrame, seed: int, label: str = "y", trees: int = 0, depth: int = 0, split: int = 2, leaf: int = 2, weights: str = "balanced") -> Forest:
        """A forest in which both classes weigh the same.  A node of fewer than ``split`` rows is not split, nor may a child
        have fewer than ``leaf``."""
        return forest.fit(rows, self.bins, Growth(trees or self.s.trees, depth, split, leaf, weights), seed, label)

    def predict(self, model: Forest, rows: DataFrame, out: str = "score") -> DataFrame:
        """``rows`` of the packed table with a model's score."""
        return rows.withColumn(out, model.score(F.col("x")))


def side_by_side(spark: SparkSession, jobs: list) -> list:
    """The results of independent functions, run in threads of the session, in order."""
    with ThreadPoolExecutor(max(1, min(SIDE_BY_SIDE, len(jobs)))) as pool:
        return list(pool.map(lambda job: inheritable_thread_target(spark)(job)(), jobs))


def predict(model: Forest, rows: DataFrame, out: str = "score") -> DataFrame:
    """``rows`` (f0, f1, ...) with the score of a whole model, bins included."""
    kept = rows.columns
    return model.bins.transform(rows).withColumn(out, model.score(forest.bin_vector(model.bins))).select(*(c for c in kept if c != out), out)


def out_of_fold(rows: DataFrame, forests: Forests, key: str, folds: int, seed: int) -> DataFrame:
    """``rows`` with the score of a model that has not seen them, written out: the models end with it."""
    dealt = keep(M.assign_folds(rows, "y", key, folds, seed), "folds")
    models = side_by_side(rows.sparkSession, [lambda k=k: forests.fit(dealt.where(F.col("fold") != k), seed) for k in range(folds)])
    scored = keep(reduce(DataFrame.unionByName, (forests.predict(m, dealt.where(F.col("fold") == k)) for k, m in enumerate(models))).drop("fold"), "out-of-fold")
    delete(dealt)
    for m in models:
        m.delete(rows.sparkSession)
    return scored


def hold_out(rows: DataFrame, key: str, seed: int) -> DataFrame:
    """``held``: a quarter of the rows, one at least, by hash."""
    n = rows.count()
    size = max(1, round(n * 0.25)) if n else 0
    placed = positions(rows, [M.fold_order(F.col(key), seed), F.col(key)], out="_place")
    return placed.withColumn("held", F.col("_place") < size).drop("_place")


def search_forest(rows: DataFrame, forests: Forests, key: str, tries: int = 10, most_folds: int = 3) -> dict:
    """The options of the best mean F1 over folds, of ``tries`` drawn from GRID; the first of equals; none if there is nothing
    to draw from.  All draws and folds are fitted side by side on one table."""
    s, smallest = forests.s, min((r["count"] for r in rows.groupBy("y").count().collect()), default=0)
    folds = min(most_folds, smallest)
    if folds < 2 or tries < 1:
        return {}
    grid = [dict(zip(GRID, x, strict=True)) for x in itertools.product(*GRID.values())]
    drawn = random.Random(s.seed + 12).sample(grid, min(tries, len(grid)))
    dealt = keep(M.assign_folds(rows, "y", key, folds, s.seed), "search-folds")

    def f1(options: dict, k: int) -> float:
        model = forests.fit(dealt.where(F.col("fold") != k), s.seed + 11, **options)
        found = M.metric_summary(forests.predict(model, dealt.where(F.col("fold") == k)), "y", "score", 0.5).first()["f1"]
        model.delete(rows.sparkSession)
        return found

    found = side_by_side(rows.sparkSession, [lambda o=o, k=k: f1(o, k) for o in drawn for k in range(folds)])
    delete(dealt)
    means = [sum(found[i : i + folds]) / folds for i in range(0, len(found), folds)]
    return drawn[means.index(max(means))]


def train(rows: DataFrame, s: Settings, key: str = "row_key", hardened: bool = False, tries: int = 0, cv_folds: int = 0, group_columns: list[str] | None = None, group_splits: int = 5) -> Trained:
    """A quarter of the positives is set aside.  The others against the unlabeled rows first, out of fold; unlabeled rows that
    score low become reliable negatives, of which a quarter is set aside too; positives against those then, and what
    was set aside chooses the threshold.

    Too few positives or unlabeled rows, or no varying numeric column, is an error.
    """
    excluded = (key, *LEAK_COLUMNS, *(HARDENED_COLUMNS if hardened else ()))
    # Written once, as what follows reads the columns several times; what is no feature in any case is left out.
    roled = pu_roles(rows)
    numbers = [c for c, kind in roled.dtypes if c not in excluded and not kind.startswith(("array", "map", "struct", "binary", "date", "timestamp", "void"))]
    roled = keep(roled.select(key, *(F.col(f"`{c}`") for c in numbers)), "roles")
    n = roled.agg(F.count("*").alias("all"), F.count_if("is_positive").alias("p"), F.count_if("is_unlabeled").alias("u")).first()
    if n["p"] < s.min_positives or n["u"] < s.min_unlabeled:
        raise ValueError(f"need {s.min_positives} positives and {s.min_unlabeled} unlabeled rows, got {n['p']} and {n['u']}")
    table, features = M.numeric_features(roled, (*excluded, "is_positive", "is_unlabeled"))
    if not features:
        raise ValueError("no numeric training feature varies")
    # Column names with dots or spaces would not do as inputs of the assembler.
    inputs = [f"f{i}" for i in range(len(features))]
    table = keep(table.select(key, "is_positive", "is_unlabeled", *(F.col(f"`{c}`").alias(i) for c, i in zip(features, inputs, strict=True))), "features")
    bins = binning(table, inputs)
    forests = Forests(bins, s)
    packed = bins.transform(table).select(key, "is_positive", "is_unlabeled", forest.bin_vector(bins).alias("x"))
    packed = keep(packed.repartition(max(1, n["all"] // 50_000)), "packed")  # few tasks for few rows: the fits run side by side
    delete(roled, table)

    positives = keep(hold_out(packed.where("is_positive").withColumn("y", F.lit(1)), key, s.seed), "positives")
    fitted = positives.where("not held").drop("held")
    unlabeled = packed.where("is_unlabeled").withColumn("y", F.lit(0))
    folds = max(2, min(5, fitted.count(), n["u"]))
    first = out_of_fold(fitted.unionByName(unlabeled), forests, key, folds, s.seed)
    negatives = M.reliable_negatives(first.where("y = 0"), "score", key, s.reliable_quantile, s.reliable_max_score, s.min_reliable).where("is_reliable")
    negatives = keep(negatives.drop("is_reliable", "score"), "negatives")
    cutoff = negatives.select("cutoff").first()["cutoff"]
    held = keep(positives.unionByName(hold_out(negatives.drop("cutoff"), key, s.seed)), "held")
    fitting, validation = held.where("not held"), held.where("held")
    options = search_forest(fitting, forests, key, tries) if tries else {}
    model = forests.fit(fitting, s.seed + 11, **options)
    validated = keep(forests.predict(model, validation).select("y", "score"), "validated")
    chosen = M.choose_threshold(M.threshold_sweep(validated, "y", "score"), s.target_recall).first()
    summary = {
        "positives": n["p"], "unlabeled": n["u"], "reliable_negatives": negatives.count(), "cutoff": cutoff, "threshold": chosen["threshold"], "options": options,
        "validation": M.metric_summary(validated, "y", "score", chosen["threshold"]).first().asDict(), "features": features,
    }
    marks = held.select(key, F.col("y").alias("_y"), F.col("held").alias("_held"))
    scored = forests.predict(model, packed, "pu_score").join(marks, key, "left")
    flags = {"in_positive_validation": F.coalesce((F.col("_y") == 1) & F.col("_held"), F.lit(False)), "in_negative_validation": F.coalesce((F.col("_y") == 0) & F.col("_held"), F.lit(False)), "in_reliable_negative": F.coalesce(F.col("_y") == 0, F.lit(False))}
    scored = scored.withColumns(flags)
    scored = keep(scored.select(key, training_role(scored).alias("pu_training_role"), "pu_score", (F.col("pu_score") >= chosen["threshold"]).cast("int").alias("pu_prediction")), "scored")
    trained = Trained(model, chosen["threshold"], features, summary, rows.join(scored, key))
    if cv_folds >= 2:
        trained.cross_validated, summary["cross_validation"] = cross_validate(packed, forests, key, cv_folds, trained.threshold)
    if group_columns:
        summary["group_holdout"] = group_holdouts(rows, held, forests, key, group_columns, group_splits, trained.threshold)
    delete(positives, first, negatives, held, validated, packed)
    return trained


def calibrate(rows: DataFrame, forests: Forests, key: str, seed: int, fallback: float) -> tuple[float, str]:
    """A threshold from a quarter of the rows that a model does not see; the fallback if a class has fewer than two."""
    n = [r["count"] for r in rows.groupBy("y").count().collect()]
    if len(n) < 2 or min(n) < 2:
        return fallback, "fallback_main_validation"
    held = keep(hold_out(rows.where("y = 1"), key, seed).unionByName(hold_out(rows.where("y = 0"), key, seed)), "calibration")
    scored = forests.predict(forests.fit(held.where("not held"), seed), held.where("held"))
    return M.choose_threshold(M.threshold_sweep(scored, "y", "score"), forests.s.target_recall).first()["threshold"], "inner_calibration"


def cross_validate(packed: DataFrame, forests: Forests, key: str, folds: int, fallback: float) -> tuple[DataFrame | None, dict]:
    """Each fold mines its own negatives among the rows it trains on, with a model of its own, sets its own threshold, and
    judges the fold's positives and those of its unlabeled rows that the same model finds as low.  Folds run side by side."""
    s, spark = forests.s, packed.sparkSession
    used = packed.where("is_positive or is_unlabeled").withColumn("y", F.col("is_positive").cast("int"))
    smallest = min((r["count"] for r in used.groupBy("y").count().collect()), default=0)
    folds = min(folds, smallest)
    if folds < 2:
        return None, {"skipped": "Need at least two positive rows and two unlabeled rows for k-fold CV."}
    dealt = keep(M.assign_folds(used, "y", key, folds, s.seed), "cv-folds")

    def one(k: int) -> tuple[DataFrame, dict]:
        inside = F.col("fold") != k
        mined = keep(forests.predict(forests.fit(dealt.where(inside), s.seed + 2000 + k), dealt.where("y = 0")), "cv-mined")
        negatives = keep(M.reliable_negatives(mined.where(inside), "score", key, s.reliable_quantile, s.reliable_max_score, s.min_reliable).where("is_reliable"), "cv-negatives")
        cutoff = negatives.select("cutoff").first()["cutoff"]
        outside = mined.where(~inside)
        judged = M.reliable_negatives(outside, "score", key, 1.0, cutoff, max(1, round(outside.count() * s.reliable_quantile))).where("is_reliable")
        fitting = keep(dealt.where(inside & (F.col("y") == 1)).unionByName(negatives.select(*dealt.columns)), "cv-fitting")
        threshold, how = calibrate(fitting, forests, key, s.seed + 3000 + k, fallback)
        tested = forests.predict(forests.fit(fitting, s.seed + 4000 + k), dealt.where(~inside & (F.col("y") == 1)).unionByName(judged.select(*dealt.columns)), "pu_cv_score")
        tested = keep(tested.withColumn("pu_cv_prediction", (F.col("pu_cv_score") >= threshold).cast("int")), "cv-tested")
        row = M.confusion(tested, "y", "pu_cv_prediction").first().asDict()
        role = F.when(F.col("y") == 1, "positive_test").otherwise("reliable_negative_test")
        part = tested.select(key, role.alias("pu_cv_role"), F.lit(k + 1).alias("pu_cv_fold"), "pu_cv_score", "pu_cv_prediction")
        sizes = {r["y"]: r["count"] for r in fitting.groupBy("y").count().collect()}
        delete(mined, negatives, fitting)
        return part, row | {"fold": k + 1, "threshold": threshold, "threshold_source": how, "train_positives": sizes.get(1, 0), "train_reliable_negatives": sizes.get(0, 0), "train_reliable_negative_cutoff": cutoff}

    found = side_by_side(spark, [lambda k=k: one(k) for k in range(folds)])
    averaged = M.fold_summary(spark.createDataFrame([{m: float(r[m]) for m in M.AVERAGED} for _, r in found])).first().asDict()
    delete(dealt)
    return reduce(DataFrame.unionByName, (part for part, _ in found)), {"folds": [r for _, r in found], "aggregate": averaged}


def group_holdouts(rows: DataFrame, held: DataFrame, forests: Forests, key: str, columns: list[str], splits: int, threshold: float) -> dict:
    """For each column: models that have not seen a quarter of its groups, or why there are none."""
    reports: dict = {}
    for column in columns:
        if column not in rows.columns:
            reports[column] = {"skipped": f"Column not found: {column}"}
            continue
        named = keep(held.join(rows.select(key, F.coalesce(F.col(f"`{column}`").cast("string"), F.lit("")).alias("_group")), key), "groups")
        if named.select("_group").distinct().limit(2).count() < 2:
            reports[column] = {"skipped": "Need at least two distinct groups."}
            continue

        def one(k: int, named: DataFrame = named) -> dict | None:
            parts = keep(M.group_holdout(named, "_group", k, forests.s.seed), "group-split")
            fit, test = parts.where(~F.col("is_test")), parts.where("is_test")
            sizes = fit.agg(F.count_distinct("y").alias("kinds"), F.count("*").alias("n")).first(), test.agg(F.count_distinct("y").alias("kinds"), F.count_distinct("_group").alias("groups")).first()
            if min(x["kinds"] for x in sizes) < 2:
                return None
            scored = forests.predict(forests.fit(fit, forests.s.seed + 1001 + k), test)
            row = M.metric_summary(scored, "y", "score", threshold).first().asDict()
            delete(parts)
            return row | {"fold": k + 1, "train_rows": sizes[0]["n"], "test_groups": sizes[1]["groups"]}

        found = [r for r in side_by_side(rows.sparkSession, [lambda k=k: one(k) for k in range(splits)]) if r]
        if not found:
            reports[column] = {"skipped": "No fold contained both classes in train and test."}
            continue
        table = rows.sparkSession.createDataFrame([{m: float(r[m]) for m in M.AVERAGED} for r in found])
        reports[column] = {"splits": found, "aggregate": M.fold_summary(table).first().asDict()}
        delete(named)
    return reports


def score_model(rows: DataFrame, trained: Trained, prefix: str) -> DataFrame:
    """``rows`` with the model's score, threshold and prediction.  The model's own columns are read; one that is missing or
    no number is -1."""
    def value(c: str):
        if c not in rows.columns:
            return F.lit(-1.0)
        text = F.lower(F.col(f"`{c}`").cast("string"))
        x = F.when(text == "true", F.lit(1.0)).when(text == "false", F.lit(0.0)).otherwise(F.expr(f"try_cast(`{c}` AS double)"))
        return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), F.lit(-1.0)).otherwise(x)

    own = [c for c in rows.columns]
    packed = rows.select(F.struct(*(F.col(f"`{c}`") for c in own)).alias("_r"), *(value(c).alias(f"f{i}") for i, c in enumerate(trained.features)))
    scored = predict(trained.model, packed, "_score")
    names = [f"{prefix}_score", f"{prefix}_threshold", f"{prefix}_prediction"]
    return scored.select("_r.*", F.col("_score").alias(names[0]), F.lit(trained.threshold).alias(names[1]), (F.col("_score") >= trained.threshold).cast("int").alias(names[2]))


def score(rows: DataFrame, standard: Trained, hardened: Trained) -> tuple[DataFrame, DataFrame]:
    """(classified, long): each row with both models and the decision; and each row once for each model."""
    both = final_decision(score_model(score_model(rows, standard, "standard"), hardened, "hardened"))
    return both, long_scores(both, rows.columns, {"standard": len(standard.features), "hardened": len(hardened.features)})


def long_scores(classified: DataFrame, columns: list[str], feature_counts: dict[str, int]) -> DataFrame:
    """One row for each row and model, by exploding both models' columns in place; the input is read once."""
    one = lambda m: F.struct(F.lit(m).alias("model"), F.col(f"{m}_score").alias("score"), F.col(f"{m}_threshold").alias("threshold"), F.col(f"{m}_prediction").alias("prediction"), F.lit(feature_counts[m]).alias("feature_count"))
    return classified.select(*(F.col(f"`{c}`") for c in columns), F.explode(F.array(one("standard"), one("hardened"))).alias("_m")).select(*(F.col(f"`{c}`") for c in columns), "_m.*")


def empty_scores(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The typed empty results of an empty input; no model is loaded."""
    for c in ("url", "target_brand_domain", "validation_status"):
        if c not in rows.columns:
            rows = rows.withColumn(c, F.lit(None).cast("string"))
    none = rows.where(F.lit(False))
    columns = none.columns
    for m in MODEL_COLUMNS.values():
        none = none.withColumns({m[0]: F.lit(None).cast("double"), m[1]: F.lit(None).cast("double"), m[2]: F.lit(None).cast("int")})
    return none.withColumns({c: F.lit(None).cast("string") for c in DECISION_COLUMNS}), long_scores(none, columns, {"standard": 0, "hardened": 0})


def evaluate(classified: DataFrame, truth: str = "") -> dict:
    """The report of four predictions and two sweeps against the ground truth, or why there is none."""
    if truth and truth not in classified.columns:
        raise ValueError(f"Ground-truth column not found: {truth}")
    column = truth or M.truth_column(classified, TRUTH_COLUMNS)
    if not column:
        return {"skipped": True, "reason": "No explicit ground-truth label column found.", "candidate_truth_columns": list(TRUTH_COLUMNS)}
    kind = dict(classified.dtypes)[column]
    judged = classified.withColumn("_t", T.truth(F.col(f"`{column}`"), kind not in ("string", "boolean"))).withColumns({
        "_confirmed": (F.col("final_classification") == "confirmed_phishing").cast("int"),
        "_review": F.col("final_classification").isin("confirmed_phishing", "suspicious_needs_review").cast("int"),
    })
    n = judged.agg(F.count("*").alias("all"), F.count("_t").alias("used"), F.first("standard_threshold", True).alias("standard"), F.first("hardened_threshold", True).alias("hardened")).first()
    if not n["used"]:
        return {"skipped": True, "reason": f"Ground-truth column {column} contains no usable binary labels.", "truth_column": column}
    used = judged.where("_t is not null")
    views = {"standard": "standard_prediction", "hardened": "hardened_prediction", "final_confirmed_only": "_confirmed", "final_review_or_confirmed": "_review"}
    models = {k: M.confusion(used, "_t", v).first().asDict() for k, v in views.items()}
    for k in ("standard", "hardened"):
        models[k]["threshold"] = float(n[k] or 0.0)
    sweeps = {k: [r.asDict() for r in M.threshold_sweep(used, "_t", f"{k}_score").orderBy("k").collect()] for k in ("standard", "hardened")}
    return {"skipped": False, "truth_column": column, "input_rows": n["all"], "evaluated_rows": n["used"], "ignored_rows": n["all"] - n["used"], "models": models, "threshold_sweeps": sweeps}


def validate(contexts: DataFrame, brands: DataFrame, s: Settings, standard: Trained, hardened: Trained, evidence: dict | None = None, truth: str = "") -> dict:
    """Extraction, scoring and evaluation in one go."""
    from .enrich import enrich

    features = enrich(contexts, brands, s, evidence).features
    classified, _ = score(features, standard, hardened)
    return evaluate(classified, truth)
