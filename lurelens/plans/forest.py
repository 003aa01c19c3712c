"""Random forests over binned features, grown by Spark's tasks, some trees each.

Rows that agree in all bins are one cell with a count of each class, so a tree costs what the cells do: Spark groups the
rows into cells, each task reads these and grows its trees level by level, all nodes of a level at once.  Trees are
written as rows of a table; no forest comes to the driver, and a task that predicts reads them one after another.
A tree depends on the cells, the seed and its number only, so it does not matter which task grows it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import delete, delete_path, keep, read_batches

TREES = "tree int, feature binary, cut binary, child binary, value binary, gains array<double>"
#: Tasks of a forest, sampled cells that a task grows trees of at once, and rows that a task scores at once.
TASKS, TOGETHER, SCORED = 16, 1 << 17, 1 << 19


@dataclass
class Growth:
    """How trees grow; ``depth`` 0 is no bound.  Both kinds of class weights make the classes weigh the same, in all trees
    alike ("balanced") or in each tree's own sample ("balanced_subsample")."""

    trees: int
    depth: int = 0
    split: int = 2
    leaf: int = 1
    weights: str = "balanced"


def bin_vector(bins: Bucketizer) -> Column:
    """The bins of all features, one byte each."""
    return F.array(*(F.col(c).cast("tinyint") for c in bins.getOutputCols()))


def _purity(n: list[np.ndarray], w: list[np.ndarray]) -> np.ndarray:
    """The sum of the classes' squared weights by their weight: the larger, the less is the Gini impurity times weight."""
    a, b = n[0] * w[0], n[1] * w[1]
    return (a * a + b * b) / np.maximum(a + b, 1e-300)


def _best_cuts(node: np.ndarray, bins: np.ndarray, counts: list[np.ndarray], totals: list[np.ndarray], w: list[np.ndarray], leaf: int) -> tuple[np.ndarray, ...]:
    """(score, bin, left counts of both classes) of each node's best cut of one feature; -1 where no cut leaves ``leaf``
    rows on both sides.  Every node has an entry.  Counts are summed up by node and bin in a dense table, or sorted where
    most of that would be empty."""
    cell = node << 7 | bins
    if len(totals[0]) << 7 <= 8 * len(cell):
        dense = [np.bincount(cell, c, len(totals[0]) << 7) for c in counts]
        there = np.flatnonzero(dense[0] + dense[1])
        run = [np.cumsum(d[there]) for d in dense]
    else:
        order = np.sort(cell << 32 | np.arange(len(cell)))
        at, cell = order & 0xFFFFFFFF, order >> 32
        ends = np.append(np.flatnonzero(cell[1:] != cell[:-1]), len(cell) - 1)
        there = cell[ends]
        run = [np.cumsum(c[at])[ends] for c in counts]
    node, bins = there >> 7, there & 127
    left = [r - (np.cumsum(t) - t)[node] for r, t in zip(run, totals, strict=True)]
    right = [t[node] - n for t, n in zip(totals, left, strict=True)]
    sides = [x[node] for x in w]
    score = _purity(left, sides) + _purity(right, sides)
    score[(left[0] + left[1] < leaf) | (right[0] + right[1] < leaf)] = -1.0
    best = np.maximum.reduceat(score, np.append(0, np.flatnonzero(node[1:] != node[:-1]) + 1))
    hits = np.flatnonzero(score == best[node])
    which = np.zeros(len(best), np.int64)
    which[node[hits[::-1]]] = hits[::-1]  # the first of equals
    return best, bins[which], left[0][which], left[1][which]


def grow(x: np.ndarray, n: np.ndarray, how: Growth, seed: int, trees: list[int]) -> list[dict]:
    """Trees of cells: ``x`` has their bins, ``n`` (2, cells) their counts of both classes.

    Each is grown of a sample of as many rows as there are, in the mean, drawn with replacement (Poisson counts).  A node looks at
    the square root of the number of features, drawn anew, and at further ones only if these offer no cut.
    """
    features = x.shape[1]
    tried = max(1, int(features**0.5))
    cells, counts, root, weights, draws = [], [[], []], [], [], []
    for k, tree in enumerate(trees):
        draw = np.random.default_rng([seed, tree])
        sample = draw.poisson(n)
        there = np.flatnonzero(sample[0] + sample[1])
        cells.append(there)
        root.append(np.full(len(there), k))
        for c in (0, 1):
            counts[c].append(sample[c][there])
        sums = (sample if how.weights == "balanced_subsample" else n).sum(axis=1)
        weights.append(np.where(sums > 0, sums.sum() / np.maximum(2 * sums, 1), 1.0))
        draws.append(draw)
    row, node = np.concatenate(cells) * features, np.concatenate(root)  # where a cell's bins begin; its node
    counts, w = [np.concatenate(c) for c in counts], np.array(weights)
    flat = np.ascontiguousarray(x).reshape(-1)
    # Nodes of this level: their trees and counts; they stand tree by tree.
    tree_of = np.arange(len(trees))
    totals = [np.bincount(node, c, len(trees)).astype(np.int64) for c in counts]
    made: list[list[tuple[np.ndarray, ...]]] = [[] for _ in trees]
    size, gains = np.ones(len(trees), np.int64), np.zeros((len(trees), features))
    level = 0
    while len(tree_of):
        own_w = [w[tree_of, c] for c in (0, 1)]
        mass = [t * v for t, v in zip(totals, own_w, strict=True)]
        value = np.where(mass[0] + mass[1] > 0, mass[1] / np.maximum(mass[0] + mass[1], 1e-300), 0.0)
        open_ = (totals[0] > 0) & (totals[1] > 0) & (totals[0] + totals[1] >= max(how.split, 2 * how.leaf)) & (not how.depth or level < how.depth)
        opened = np.flatnonzero(open_)
        live = np.flatnonzero(open_[node])
        row, node, counts = row[live], (np.cumsum(open_) - 1)[node[live]], [c[live] for c in counts]  # from here on numbered among the open nodes
        best, feature, cut = np.full(len(opened), -1.0), np.full(len(opened), -1), np.zeros(len(opened), np.int64)
        left = [np.zeros(len(opened), np.int64) for _ in (0, 1)]
        inside, inside_w = [t[opened] for t in totals], [v[opened] for v in own_w]
        # Every tree draws for its own nodes, so it does not depend on those it grows beside.
        per_tree = np.bincount(tree_of, minlength=len(trees)).tolist()
        order = np.argsort(np.concatenate([d.random((m, features), np.float32) for d, m in zip(draws, per_tree, strict=True)])[opened], axis=1)
        for j in range(features):
            if j < tried:
                to, own, at, mine = np.arange(len(opened)), node, row, counts
            else:
                to = np.flatnonzero(best < 0)
                some = np.flatnonzero(best[node] < 0)
                own, at, mine = (np.cumsum(best < 0) - 1)[node[some]], row[some], [c[some] for c in counts]
            if not len(to):
                break
            looked = order[to, j]
            found = _best_cuts(own, flat[at + looked[own]], mine, [t[to] for t in inside], [v[to] for v in inside_w], how.leaf)
            better = found[0] > best[to]
            to = to[better]
            best[to], feature[to], cut[to], left[0][to], left[1][to] = found[0][better], looked[better], *(f[better] for f in found[1:])
        split = feature >= 0
        parents = opened[split]
        before = np.zeros(len(tree_of) + 1, np.int64)
        before[parents + 1] = 1
        before = np.cumsum(before)  # splits before each node
        starts = np.searchsorted(tree_of, np.arange(len(trees) + 1))
        whole = [np.full(len(tree_of), -1, np.int16), np.zeros(len(tree_of), np.uint8), np.zeros(len(tree_of), np.int32), value.astype(np.float32)]
        whole[0][parents], whole[1][parents] = feature[split], cut[split]
        whole[2][parents] = size[tree_of[parents]] + 2 * (before[parents] - before[starts[tree_of[parents]]])
        for t in range(len(trees)):
            made[t].append(tuple(p[starts[t] : starts[t + 1]] for p in whole))
        size += 2 * np.bincount(tree_of[parents], minlength=len(trees))
        np.add.at(gains, (tree_of[parents], feature[split]), (best - _purity(inside, inside_w))[split])
        # Rows go on to the children, which become the nodes of the next level.
        if not split.all():
            live = np.flatnonzero(split[node])
            row, node, counts = row[live], node[live], [c[live] for c in counts]
        node = 2 * (np.cumsum(split) - 1)[node] + (flat[row + feature[node]] > cut[node])
        totals = [np.stack((a[split], t[split] - a[split]), 1).reshape(-1) for a, t in zip(left, inside, strict=True)]
        tree_of = np.repeat(tree_of[parents], 2)
        level += 1
    out = []
    for t, parts in enumerate(made):
        feature, cut, child, value = (np.concatenate(p) for p in zip(*parts, strict=True))
        total = gains[t].sum()
        out.append({"feature": feature, "cut": cut, "child": child, "value": value, "gains": gains[t] / total if total > 0 else gains[t]})
    return out


def walk(x: np.ndarray, feature: np.ndarray, cut: np.ndarray, child: np.ndarray, value: np.ndarray) -> np.ndarray:
    """The value of the leaf that each row of bins comes to."""
    flat, features = np.ascontiguousarray(x).reshape(-1), x.shape[1]
    node = np.zeros(len(x), np.int32)
    live = np.arange(len(x))
    while True:
        here = node[live]
        f = feature[here]
        inner = f >= 0
        if not inner.all():
            live, here, f = live[inner], here[inner], f[inner]
        if not len(live):
            return value[node]
        node[live] = child[here] + (flat[live * features + f] > cut[here])


@dataclass
class Forest:
    """A fitted forest: the table of its trees, in shared storage at ``path``, and the bins of the features it was given."""

    bins: Bucketizer
    path: str

    def trees(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(TREES).parquet(self.path)

    def gains(self, spark: SparkSession) -> list[float]:
        """The features' shares of the gain, the mean over the trees; they sum up to 1, if there is a cut."""
        n = len(self.bins.getInputCols())
        means = self.trees(spark).select(*(F.avg(F.get("gains", F.lit(i))) for i in range(n))).first()
        total = sum(means)
        return [v / total if total else 0.0 for v in means]

    def save(self, path: str) -> None:
        spark = SparkSession.getActiveSession()
        self.bins.write().overwrite().save(f"{path}/bins")
        self.trees(spark).write.mode("overwrite").parquet(f"{path}/trees")

    def delete(self, spark: SparkSession) -> None:
        delete_path(spark, self.path)

    @staticmethod
    def load(path: str) -> Forest:
        return Forest(Bucketizer.load(f"{path}/bins"), f"{path}/trees")

    def score(self, x: Column) -> Column:
        """The mean of the trees' shares of class 1 at each row's leaf.  Rows are gathered, for each of which a byte a feature
        is held, before the trees are read, one at a time."""
        path, features = self.path, len(self.bins.getInputCols())

        def scores(held: list[pa.Array]) -> Iterator[pa.Array]:
            rows = np.concatenate([b.flatten().to_numpy(zero_copy_only=False) for b in held]).astype(np.uint8).reshape(-1, features)
            kinds, of = np.unique(rows, axis=0, return_inverse=True)
            total, n = np.zeros(len(kinds)), 0
            for batch in read_batches(path, ["feature", "cut", "child", "value"], 1):
                for tree in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                    total += walk(kinds, *(np.frombuffer(b, t) for b, t in zip(tree, ("<i2", "u1", "<i4", "<f4"), strict=True)))
                    n += 1
            found, at = (total / max(n, 1))[of.reshape(-1)], 0
            for b in held:
                yield pa.array(found[at : at + len(b)])
                at += len(b)

        def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            held, n = [], 0
            for batch in batches:
                held.append(batch)
                n += len(batch)
                if n >= SCORED:
                    yield from scores(held)
                    held, n = [], 0
            if held:
                yield from scores(held)

        return F.arrow_udf(predict, "double")(x)


def fit(rows: DataFrame, bins: Bucketizer, how: Growth, seed: int, label: str = "y") -> Forest:
    """A forest of ``rows``, which have the bins as ``x`` and the class, 0 or 1, as ``label``."""
    spark = rows.sparkSession
    counted = rows.groupBy("x").agg(F.count_if(F.col(label) == 0).alias("n0"), F.count_if(F.col(label) == 1).alias("n1"))
    cells = keep(counted, "cells")
    path, tasks = cells.kept_path, min(TASKS, how.trees)
    features = len(bins.getInputCols())

    def plant(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x, n = None, None
        for batch in batches:
            for task in batch.column(0).to_pylist():
                if x is None:
                    parts = list(read_batches(path, ["x", "n0", "n1"], 1 << 16))
                    x = np.concatenate([p.column(0).flatten().to_numpy(zero_copy_only=False) for p in parts] or [np.zeros(0)]).astype(np.uint8).reshape(-1, features)
                    n = np.array([np.concatenate([p.column(k).to_numpy() for p in parts] or [np.zeros(0)]) for k in (1, 2)], np.int64)
                    order = np.lexsort(x.T)  # however the files lie
                    x, n = x[order], n[:, order]
                    del parts
                mine = list(range(task, how.trees, tasks))
                step = max(1, TOGETHER // max(1, len(x)))
                for i in range(0, len(mine), step):
                    group = mine[i : i + step]
                    grown = grow(x, n, how, seed, group)
                    columns = [pa.array(group, pa.int32()), *(pa.array([t[k].tobytes() for t in grown], pa.binary()) for k in ("feature", "cut", "child", "value")), pa.array([t["gains"].tolist() for t in grown], pa.list_(pa.float64()))]
                    yield pa.RecordBatch.from_arrays(columns, ["tree", "feature", "cut", "child", "value", "gains"])

    trees = keep(spark.range(0, tasks, 1, tasks).mapInArrow(plant, TREES), "trees")
    delete(cells)
    return Forest(bins, trees.kept_path)
