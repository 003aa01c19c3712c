"""Document quality by a sparse rule ensemble.

Shallow trees are boosted on statistics of whole texts; each path from a root is a rule, a conjunction of
comparisons; a lasso logistic regression keeps few of the rules; and what is kept becomes one Spark column
expression over the statistics.  Only the bounded sample of labelled rows reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import in_fold, keep, tune

STATS = [
    "chars", "words", "lines", "mean_word", "longest_word", "upper", "digits", "marks", "symbols", "pipes", "bangs",
    "spaces", "beyond_ascii", "distinct_words", "top_word", "repeated_lines", "caps_words", "marked_words", "short_words", "sentence_ends",
]

_UPPER = bytes(range(65, 91))
_DIGIT = b"0123456789"
_MARK = bytes(b for b in range(33, 127) if not (48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122))
_SYMBOL = b"#$%&*@^~<>{}[]\\=+_"


def statistics(text: str) -> list[float]:
    """The statistics of one whole text, all finite; those of an empty text are 0."""
    data = text.encode()
    n = len(data) or 1
    found = data.split()
    w = len(found) or 1
    lines = data.split(b"\n")
    upper = len(data) - len(data.translate(None, _UPPER))
    digits = len(data) - len(data.translate(None, _DIGIT))
    marks = len(data) - len(data.translate(None, _MARK))
    symbols = len(data) - len(data.translate(None, _SYMBOL))
    lengths = list(map(len, found))
    counts: dict[bytes, int] = {}
    for x in found:
        counts[x] = counts.get(x, 0) + 1
    caps = sum(c for x, c in counts.items() if x.isupper() and len(x) > 1)
    ended = sum(c for x, c in counts.items() if x[-1:] in b"#$%&*!|")
    return [
        float(len(text)), float(len(found)), float(len(lines)), sum(lengths) / w, float(max(lengths, default=0)),
        upper / n, digits / n, marks / n, symbols / n, data.count(b"|") / w, data.count(b"!") / w,
        (n - sum(lengths)) / n if data else 0.0, (len(data) - len(text)) / n, len(counts) / w if found else 0.0,
        max(counts.values(), default=0) / w, 1 - len(set(lines)) / len(lines), caps / w, ended / w,
        sum(1 for x in lengths if x <= 3) / w, data.count(b".") / w,
    ]


def with_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """doc_id and the columns STATS for each row of ``docs``, and ``row_col`` (a bigint) if it is given; a null text
    counts as empty."""
    tune(docs.sparkSession)
    own = [row_col] if row_col else []
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *own)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([statistics(x or "") for x in batch.column(1).to_pylist()], np.float64).reshape(-1, len(STATS))
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, np.ascontiguousarray(found.T)), *batch.columns[2:]], ["doc_id", *STATS, *own])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(measure, f"doc_id {kind}, " + ", ".join([*(f"{x} double" for x in STATS), *(f"{x} bigint" for x in own)]))


Rule = tuple[tuple[int, bool, float], ...]  #: (statistic, whether it is over the value, the value), all of which hold


@dataclass
class RuleModel:
    """score = logistic(bias + the weights of the rules that hold)."""

    bias: float = 0.0
    rules: list[tuple[Rule, float]] = field(default_factory=list)
    names: list[str] = field(default_factory=lambda: list(STATS))

    def column(self) -> Column:
        """The score as a Spark expression over the statistics."""
        total = F.lit(float(self.bias))
        for rule, weight in self.rules:
            held = None
            for k, over, value in rule:
                one = F.col(self.names[k]) > value if over else F.col(self.names[k]) <= value
                held = one if held is None else held & one
            total = total + F.when(held, F.lit(float(weight))).otherwise(F.lit(0.0))
        return 1.0 / (1.0 + F.exp(-total))

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.bias)
        for rule, weight in self.rules:
            total += weight * holds(rule, x)
        return 1 / (1 + np.exp(-total))


def holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    held = np.ones(len(x), bool)
    for k, over, value in rule:
        held &= (x[:, k] > value) if over else (x[:, k] <= value)
    return held


def tree_rules(x: np.ndarray, y: np.ndarray, trees: int, depth: int, bins: int, rate: float, seed: int) -> list[Rule]:
    """The paths of boosted trees of logistic loss; splits are at quantiles."""
    rng = np.random.default_rng(seed)
    cuts = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, bins + 1)[1:-1])) for k in range(x.shape[1])]
    place = np.stack([np.searchsorted(c, x[:, k], side="left") for k, c in enumerate(cuts)], 1)
    margin, rules = np.full(len(y), np.log((y.mean() + 1e-9) / (1 - y.mean() + 1e-9))), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        gradient, weight = y - p, p * (1 - p)
        rows = np.flatnonzero(rng.random(len(y)) < 0.7)
        features = np.flatnonzero(rng.random(x.shape[1]) < 0.6)
        waiting: list[tuple[Rule, np.ndarray]] = [((), rows)]
        while waiting:
            rule, at = waiting.pop()
            g, h = gradient[at].sum(), weight[at].sum()
            best = (1e-6, -1, 0.0)
            if len(rule) < depth and len(at) >= 20:
                for k in features:
                    gs = np.cumsum(np.bincount(place[at, k], gradient[at], len(cuts[k]) + 1))[:-1]
                    hs = np.cumsum(np.bincount(place[at, k], weight[at], len(cuts[k]) + 1))[:-1]
                    if len(gs):
                        gain = gs**2 / (hs + 1) + (g - gs) ** 2 / (h - hs + 1) - g**2 / (h + 1)
                        j = int(np.argmax(gain))
                        best = max(best, (float(gain[j]), int(k), float(cuts[k][j])))
            if best[1] < 0:
                if rule:
                    margin[holds(rule, x)] += rate * g / (h + 1)
                continue
            _, k, value = best
            over = x[at, k] > value
            for side in (True, False):
                longer = (*rule, (k, side, value))
                rules.append(longer)
                waiting.append((longer, at[over == side]))
    return rules


def lasso(z: np.ndarray, y: np.ndarray, penalty: float, steps: int) -> tuple[float, np.ndarray]:
    """Bias and weights of the l1-penalised logistic regression, by FISTA; the bias is free."""
    n, m = z.shape
    y = y.astype(np.float32)
    w, bias = np.zeros(m, np.float32), float(np.log((y.mean() + 1e-9) / (1 - y.mean() + 1e-9)))
    v, c, t = w.copy(), bias, 1.0
    norm = np.ones(m, np.float32) / np.float32(np.sqrt(m))
    for _ in range(12):
        norm = z.T @ (z @ norm)
        size = np.linalg.norm(norm) or 1.0
        norm /= size
    step = 4.0 * n / (size + n)
    for _ in range(steps):
        error = (1 / (1 + np.exp(-(z @ v + np.float32(c)))) - y).astype(np.float32)
        new = v - step * (z.T @ error) / n
        new = np.sign(new) * np.maximum(np.abs(new) - step * penalty, 0)
        fresh = c - step * error.mean()
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        new = new.astype(np.float32)
        v, c = new + np.float32((t - 1) / nt) * (new - w), fresh + (t - 1) / nt * (fresh - bias)
        w, bias, t = new, fresh, nt
    return float(bias), w.astype(np.float64)


def fit(x: np.ndarray, y: np.ndarray, trees: int = 30, depth: int = 3, bins: int = 48, rate: float = 0.3, penalty: float = 3e-4, steps: int = 300, seed: int = 7) -> RuleModel:
    """The model of statistics ``x`` and labels ``y`` (0 or 1).  Without rows the score is 0.5; with labels of one
    kind it is their smoothed share."""
    if len(np.unique(y)) < 2:
        return RuleModel(float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1))))
    order = np.lexsort(np.column_stack((x, y)).T)  # the model does not depend on the order of the rows
    x, y = x[order], y[order].astype(np.float64)
    distinct: dict[bytes, Rule] = {}
    for rule in tree_rules(x, y, trees, depth, bins, rate, seed):
        held = holds(rule, x)
        key = np.packbits(held if held[0] else ~held).tobytes()  # a rule and its opposite say the same
        if 0 < held.sum() < len(y) and (key not in distinct or len(rule) < len(distinct[key])):
            distinct[key] = rule
    rules = list(distinct.values())
    if not rules:
        return RuleModel(float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1))))
    z = np.column_stack([holds(r, x) for r in rules]).astype(np.float32)
    bias, w = lasso(z, y, penalty, steps)
    return RuleModel(bias, [(r, float(v)) for r, v in zip(rules, w, strict=True) if v])


def score_quality(docs: DataFrame, labels: DataFrame, label_col: str = "quality", threshold: float = 0.7, most_labelled: int = 8_000, row_col: str | None = None) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of ``docs``, and ``row_col`` if it is given.

    The model learns from at most ``most_labelled`` labelled rows outside the held-out fold (crc32 of the id mod 4
    is 2), chosen by a hash of the id, so the sample is the same however the rows lie.  Labels other than 0 and 1,
    labels without a document and null ids teach nothing.  A null text is scored as an empty one.  Repeated rows
    come back as they are; other columns are left out.
    """
    measured = keep(with_statistics(docs, row_col=row_col), "statistics")
    marks = labels.select(F.col("doc_id"), F.col(label_col).alias("label")).where("doc_id is not null and label in (0, 1)").where(~in_fold("doc_id", 4, 2))
    marks = marks.groupBy("doc_id").agg(F.max("label").alias("label"))
    known = measured.join(marks, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", *STATS).limit(most_labelled)
    rows = known.select("label", *STATS).toPandas().to_numpy(np.float64)
    model = fit(rows[:, 1:], rows[:, 0])
    scored = measured.select("doc_id", in_fold("doc_id", 4, 2).alias("held_out"), model.column().alias("score"), *([row_col] if row_col else []))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
