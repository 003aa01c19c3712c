"""Quality rules: base counts of each text, and robust multivariate outliers among what the base rules leave.

Six transformed statistics of a text are a vector.  For each lang and source the minimum covariance determinant (MCD)
is estimated: from the medians and median deviations, concentration steps take the half of the texts that lie nearest by
Mahalanobis distance and estimate centre and covariance of them anew, until no determinant moves by more than 2 percent.  Texts within the
0.975 quantile are then weighted in once more, and a text is rejected when its distance to the final estimate is
beyond the last quantile.  A floor on each variance keeps coordinates that are the same in most texts from making the
covariance singular.

Everything is DataFrame operations.  A step is one scan of the vectors that sums moments for each group and bin of the
distance; the nearest half is a prefix of the bins.  Coordinates are whole numbers of 1/1024, so sums are exact and
the outcome doesn't depend on how the rows lie.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, keep

P, UNIT = 6, 1024
PAIRS = [(i, j) for i in range(P) for j in range(i + 1)]
#: Least standard deviation of each coordinate: log words, log letters a word, then log percentages.
FLOORS = (0.25, 0.15, 0.35, 1.0, 1.0, 0.35)
SPACE, SYMBOLS = " \t\n\x0b\f\r", "#*$%&|<>"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def chi_square_share(x: float, dimensions: int) -> float:
    """The share of the chi-square distribution below x."""
    a, x = dimensions / 2, x / 2
    if x <= 0:
        return 0.0
    term = total = math.exp(a * math.log(x) - x - math.lgamma(a + 1))
    k = 0
    while term > total * 1e-16:
        k += 1
        term *= x / (a + k)
        total += term
    return min(total, 1.0)


def chi_square_quantile(share: float, dimensions: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if chi_square_share(middle, dimensions) < share else (low, middle)
    return (low + high) / 2


def consistency(share: float) -> float:
    """What the covariance of the nearest ``share`` of a normal sample is to be multiplied with."""
    return share / chi_square_share(chi_square_quantile(share, P), P + 2)


def base_counts(docs: DataFrame, text_col: str, *others: Column) -> DataFrame:
    """``others``, COUNTS, n_lines (lines with a word) and n_doubled (words like the one before) of each row; a null text has
    no words."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    length = F.char_length(text)
    cut = docs.select(
        *others,
        F.char_length(F.translate(text, SPACE, "")).cast("long").alias("word_chars"),
        (length - F.char_length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.filter(F.split(text, "\n"), lambda x: F.char_length(F.translate(x, SPACE, "")) > 0).alias("lines"),
        F.array_remove(F.split(text, "[ \\t-\\r]+"), "").alias("words"),
    )
    names = [c for c in cut.columns if c not in ("lines", "words")]
    at = lambda k: F.get("words", k)
    # A hash of each window of five words tells the texts without repeats, which most are.
    windows = F.transform(F.sequence(F.lit(0), F.size("words") - 5), lambda i: F.xxhash64(*(at(i + k) for k in range(5))))
    hashed = cut.select(
        *names, "words", F.size("words").cast("long").alias("n_words"), F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.filter(F.zip_with("words", F.slice("words", 2, F.size("words")), lambda a, b: a == b), lambda x: x)).cast("long").alias("n_doubled"),
        F.when(F.size("words") >= 5, windows).otherwise(F.array().cast("array<bigint>")).alias("hashes"),
    )
    names += ["n_words", "n_lines", "n_dup_lines", "n_doubled"]
    # In the others equal windows are neighbours once they are sorted; the words themselves decide.
    window = lambda h, i: F.struct(h.alias("h"), F.array_join(F.slice("words", i + 1, 5), " ").alias("w"), i.alias("i"))
    some = F.size(F.array_distinct("hashes")) < F.size("hashes")
    sorted_ = hashed.select(*names, F.when(some, F.sort_array(F.transform("hashes", window))).alias("runs"))
    same = lambda x, k: F.coalesce((F.get("runs", k)["h"] == x["h"]) & (F.get("runs", k)["w"] == x["w"]), F.lit(False))
    repeated = F.filter(F.transform("runs", lambda x, k: F.when(same(x, k - 1) | same(x, k + 1), x["i"])), lambda i: i.isNotNull())
    placed = sorted_.select(*names, F.sort_array(repeated).alias("places"))
    steps = F.zip_with("places", F.slice("places", 2, F.size("places")), lambda a, b: F.least(F.coalesce(b - a, F.lit(5)), F.lit(5)))
    covered = F.aggregate(steps, F.lit(0), lambda total, x: total + x)
    return placed.select(*names, F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"))


def _vector() -> list[Column]:
    """The coordinates, in whole units; a text without words has some too."""
    words, lines = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("n_lines"), F.lit(1))
    values = (
        F.log1p(F.col("n_words")), F.log((1 + F.col("word_chars")) / (1 + F.col("n_words"))),
        F.log1p(100 * F.col("n_symbols") / words), F.log1p(100 * F.col("n_dup_lines") / lines), F.log1p(100 * F.col("n_repeat_words") / words),
        F.log1p(100 * F.col("n_doubled") / words),
    )
    return [F.round(x * UNIT).cast("long").alias(f"x{k}") for k, x in enumerate(values)]


def _groups(passed: DataFrame, least_rows: int) -> DataFrame:
    """lang, source, group: sources with fewer rows than ``least_rows`` share a group of their lang, and those of langs where that is
    too small one group; without enough rows there, there is none (null)."""
    counted = keep(passed.groupBy("lang", "source").agg(F.count("*").alias("n")), "sizes")
    few = counted.where(F.col("n") < least_rows)
    by_lang = few.groupBy("lang").agg(F.sum("n").alias("of_lang"))
    rest = by_lang.where(F.col("of_lang") < least_rows).agg(F.sum("of_lang").alias("of_rest"))
    size = F.length("lang").cast("string")
    group = (
        F.when(F.col("n") >= least_rows, F.concat(F.lit("s"), size, F.lit(":"), "lang", "source"))
        .when(F.col("of_lang") >= least_rows, F.concat(F.lit("l"), size, F.lit(":"), "lang"))
        .when(F.col("of_rest") >= least_rows, F.lit("r"))
    )
    return counted.join(by_lang, "lang", "left").join(rest, F.lit(True), "left").select("lang", "source", group.alias("group"))


def _moments() -> list[Column]:
    x = [F.col(f"x{k}") for k in range(P)]
    return [F.count("*").alias("n"), *(F.sum(x[k]).alias(f"s{k}") for k in range(P)), *(F.sum(x[i] * x[j]).alias(f"s{i}{j}") for i, j in PAIRS)]


def _estimate(moments: DataFrame, factor: float, floors: tuple[float, ...]) -> DataFrame:
    """group, the centre m0.., the inverse a.. of the Cholesky factor of the covariance, and its log determinant."""
    n = F.col("n").cast("double")
    mean = [F.col(f"s{k}").cast("double") / n for k in range(P)]
    floor = [(f * UNIT) ** 2 for f in floors]
    cov = {f"c{i}{j}": factor * (F.col(f"s{i}{j}").cast("double") / n - mean[i] * mean[j]) + (floor[i] if i == j else 0.0) for i, j in PAIRS}
    out = moments.select("group", "was", *(m.alias(f"m{k}") for k, m in enumerate(mean)), *(c.alias(name) for name, c in cov.items()))
    minus = lambda c, pairs: sum((-(F.col(a) * F.col(b)) for a, b in pairs), F.col(c))
    for j in range(P):
        out = out.withColumn(f"l{j}{j}", F.sqrt(minus(f"c{j}{j}", [(f"l{j}{k}", f"l{j}{k}") for k in range(j)])))
        if j + 1 < P:
            out = out.withColumns({f"l{i}{j}": minus(f"c{i}{j}", [(f"l{i}{k}", f"l{j}{k}") for k in range(j)]) / F.col(f"l{j}{j}") for i in range(j + 1, P)})
    for i in range(P):
        below = lambda i, j: sum((F.col(f"l{i}{k}") * F.col(f"a{k}{j}") for k in range(j, i)), F.lit(0.0))
        out = out.withColumns({f"a{i}{j}": (1 / F.col(f"l{i}{i}") if i == j else -below(i, j) / F.col(f"l{i}{i}")) for j in range(i + 1)})
    logdet = sum((2 * F.log(F.col(f"l{k}{k}")) for k in range(1, P)), 2 * F.log("l00"))
    return out.select("group", *(f"m{k}" for k in range(P)), *(f"a{i}{j}" for i, j in PAIRS), logdet.alias("logdet"), "was")


def _distance() -> Column:
    """The squared Mahalanobis distance of x0.. by the columns of an estimate."""
    off = [F.col(f"x{k}") - F.col(f"m{k}") for k in range(P)]
    rows = [sum((F.col(f"a{i}{j}") * off[j] for j in range(1, i + 1)), F.col(f"a{i}0") * off[0]) for i in range(P)]
    return sum((y * y for y in rows[1:]), rows[0] * rows[0])


def _start(vectors: DataFrame, floors: tuple[float, ...]) -> DataFrame:
    """Medians, and median deviations as scales, each exact over whole units."""
    median = vectors.groupBy("group").agg(*(F.percentile(f"x{k}", 0.5).alias(f"m{k}") for k in range(P)))
    median = keep(median, "medians")
    off = vectors.join(median, "group").groupBy("group").agg(*(F.percentile(F.abs(F.col(f"x{k}") - F.col(f"m{k}")), 0.5).alias(f"d{k}") for k in range(P)))
    scale = {f"a{i}{j}": 1 / F.greatest(1.4826 * F.col(f"d{i}"), F.lit(floors[i] * UNIT)) if i == j else F.lit(0.0) for i, j in PAIRS}
    return median.join(off, "group").select("group", *(f"m{k}" for k in range(P)), *(c.alias(name) for name, c in scale.items()), F.lit(None).cast("double").alias("logdet"))


def _concentrated(vectors: DataFrame, estimate: DataFrame, share: float, floors: tuple[float, ...]) -> DataFrame:
    """The estimate of the nearest ``share`` of each group, rounded up to whole bins of a 64th of an octave."""
    binned = F.floor(64 * F.log2(_distance() + 2.0**-20)).alias("bin")
    cells = vectors.join(estimate, "group").select("group", binned, "logdet", *(f"x{k}" for k in range(P))).groupBy("group", "bin").agg(*_moments(), F.max("logdet").alias("was"))
    order = Window.partitionBy("group").orderBy("bin")
    before = F.sum("n").over(order) - F.col("n")
    inside = cells.withColumns({"_before": before, "_all": F.sum("n").over(Window.partitionBy("group"))}).where(F.col("_before") < F.ceil(share * F.col("_all")))
    sums = [c for c in cells.columns if c not in ("group", "bin", "was")]
    return _estimate(inside.groupBy("group").agg(*(F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in sums), F.max("was").alias("was")), consistency(share), floors)


def robust_estimates(vectors: DataFrame, share: float = 0.5, steps: int = 12, still: float = 0.02, reweighted: float = 0.975, floors: tuple[float, ...] = FLOORS) -> DataFrame:
    """The reweighted MCD estimate of each group of ``vectors`` (group, x0 to x5)."""
    estimate = keep(_start(vectors, floors), "estimate")
    for step in range(steps):
        new = keep(_concentrated(vectors, estimate, share, floors), "estimate")
        discard(estimate)
        estimate = new
        moved = new.agg(F.max(F.abs(F.col("logdet") - F.col("was")))).first()[0] if step else math.inf
        if moved is None or moved < still:
            break
    near = vectors.join(estimate, "group").where(_distance() <= chi_square_quantile(reweighted, P)).select("group", *(f"x{k}" for k in range(P)))
    return keep(_estimate(near.groupBy("group").agg(*_moments(), F.lit(None).cast("double").alias("was")), consistency(reweighted), floors), "estimate")


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least_words: int = 10, most_repeated_percent: int = 20, least_rows: int = 200, quantile: float = 0.99999) -> DataFrame:
    """``id_col``, COUNTS, base_failed, kept and distance (the squared Mahalanobis distance, null where there is no estimate) for
    each row of ``docs``.

    Base rules reject texts of fewer than ``least_words`` words, or with more than ``most_repeated_percent`` percent of the words in
    repeated windows; a null or empty text has no words.  Of the others, those of a lang and source make an estimate; a null
    lang or source counts as an empty one; groups of fewer than ``least_rows`` texts are pooled by lang, then over all, and
    are kept where even that is too few.  A text beyond the chi-square ``quantile`` is rejected.  Repeated
    rows each count and come back as they are; an empty table gives an empty one.  Other columns are left out.
    """
    known = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    failed = ((F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeated_percent * F.col("n_words"))).alias("base_failed")
    counted = base_counts(docs, text_col, F.col(id_col).alias("id"), known(lang_col).alias("lang"), known(source_col).alias("source"))
    measured = keep(counted.select("id", "lang", "source", *COUNTS, failed, *_vector()), "counts")
    groups = _groups(measured.where(~F.col("base_failed")), least_rows)
    placed = keep(measured.join(groups, ["lang", "source"], "left").drop("lang", "source"), "vectors")
    estimate = robust_estimates(placed.where("not base_failed and group is not null").select("group", *(f"x{k}" for k in range(P))))
    judged = placed.join(estimate, "group", "left").withColumn("distance", F.when(~F.col("base_failed"), _distance()))
    near = F.coalesce(F.col("distance") <= chi_square_quantile(quantile, P), F.lit(True))
    return judged.select(F.col("id").alias(id_col), *COUNTS, "base_failed", (~F.col("base_failed") & near).alias("kept"), "distance")
