"""Approximate nearest neighbours by cosine, with collision counting on query-aware hashing.

Vectors are dealt by a hash of their id into blocks of bounded size.  Each block sorts the projections of its unit
vectors on m random directions, one array for each.  A query opens a window around its own projection in every
array and widens all of them step by step (virtual rehashing: a wider window is a coarser hash); a vector that has
fallen into at least l windows is verified by its exact cosine.  The windows stop growing when enough vectors have
been verified.  The nearest of all blocks are merged.  Every vector is indexed, and every block meets every block
of queries once, in one task of bounded size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import keep, tune


class CollisionIndex:
    """Sorted projections of unit vectors (rows of ``units``)."""

    def __init__(self, units: np.ndarray, projections: int, seed: int):
        directions = np.random.default_rng(seed).standard_normal((units.shape[1], projections))
        values = units @ directions
        self.directions = directions
        self.order = np.ascontiguousarray(np.argsort(values, axis=0, kind="stable").T)
        self.sorted = np.take_along_axis(np.ascontiguousarray(values.T), self.order, 1)
        self.n = len(units)

    def candidates(self, queries: np.ndarray, share: float, enough: int, width: float, growth: float, levels: int = 12) -> Iterator[np.ndarray]:
        """For each query the rows that fall into at least ``share`` of the windows, once there are ``enough`` of them;
        all rows if the windows come to hold everything.  The window ends are looked up ``levels`` widths at a time."""
        at = queries @ self.directions
        m = at.shape[1]
        need, enough = max(1, math.ceil(share * m)), min(enough, self.n)
        widths = width * growth ** np.arange(levels)
        low = np.stack([np.searchsorted(self.sorted[j], at[:, j, None] - widths, "left") for j in range(m)], 1)
        high = np.stack([np.searchsorted(self.sorted[j], at[:, j, None] + widths, "right") for j in range(m)], 1)
        base = np.arange(m) * self.n
        flat = self.order.ravel()
        for q in range(len(at)):
            counts = np.zeros(self.n, np.int64)
            lows, highs, step = low[q], high[q], 0
            left = right = None
            while True:
                a, b = lows[:, step], highs[:, step]
                if left is None:
                    ends = zip((base + a).tolist(), (base + b).tolist(), strict=True)
                    fresh = [flat[i:j] for i, j in ends]
                else:
                    fresh = [flat[i:j] for i, j in zip((base + a).tolist(), (base + left).tolist(), strict=True) if i < j]
                    fresh += [flat[i:j] for i, j in zip((base + right).tolist(), (base + b).tolist(), strict=True) if i < j]
                if fresh:
                    counts += np.bincount(np.concatenate(fresh), minlength=self.n)
                found = np.flatnonzero(counts >= need)
                if len(found) >= enough or (a == 0).all() and (b == self.n).all():
                    yield found
                    break
                left, right, step = a, b, step + 1
                if step == lows.shape[1]:  # wider windows for this query
                    wider = widths[-1] * growth ** np.arange(1, 1 + levels) * 2.0 ** np.arange(1, 1 + levels)
                    lows = np.stack([np.searchsorted(self.sorted[j], at[q, j] - wider, "left") for j in range(m)])
                    highs = np.stack([np.searchsorted(self.sorted[j], at[q, j] + wider, "right") for j in range(m)])
                    step = 0


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(1))[:, None]


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", block_rows: int = 8192, query_rows: int = 2048, projections: int = 64, share: float = 0.7, verified_share: float = 0.15, verified_least: int = 64, seed: int = 11) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of ``queries`` its ``k`` nearest rows of ``vectors`` found, without
    the rows of the query's own id, nearest first, ties to the smaller id.

    score is the cosine of the original vectors in double precision.  Vectors that are null, empty or zero, or hold
    null, NaN or infinite components, take no part on either side, and neither do rows with a null id; vectors are
    only compared with those of their own length.  Repeated ids count as often as they stand in ``vectors``, and once
    in ``queries``.  Other columns are left out.
    """
    spark = vectors.sparkSession
    tune(spark)

    def clean(df: DataFrame) -> DataFrame:
        v = F.col(vector_col).cast("array<double>")
        finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        some = F.exists(v, lambda x: x != 0)
        return df.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where(finite & some)

    base = clean(vectors)
    asked = keep(clean(queries).dropDuplicates(["id"]), "queries")
    n, q = base.count(), asked.count()
    blocks, parts = max(1, math.ceil(n / block_rows)), max(1, math.ceil(q / query_rows))

    def dealt(df: DataFrame, own: str, own_parts: int, other: str, other_parts: int) -> DataFrame:
        placed = df.withColumn(own, F.pmod(F.xxhash64("id"), F.lit(own_parts)))
        return placed.withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(other_parts - 1)))).withColumn("cell", F.col("block") * parts + F.col("part"))

    left = dealt(base, "block", blocks, "part", parts).select("cell", "id", "v")
    right = dealt(asked, "part", parts, "block", blocks).select("cell", "id", "v")

    def search(data: pa.Table, wanted: pa.Table) -> pa.Table:
        out: list[tuple[int, int, float]] = []
        by_length: dict[int, tuple[list, list]] = {}
        for side, rows in enumerate((data, wanted)):
            for key, v in zip(rows["id"].to_pylist(), rows["v"].to_pylist(), strict=True):
                by_length.setdefault(len(v), ([], []))[side].append((key, v))
        for mine, theirs in by_length.values():
            if not mine or not theirs:
                continue
            mine.sort(key=lambda x: x[0])
            ids = np.array([x[0] for x in mine], np.int64)
            x = np.array([x[1] for x in mine], np.float64)
            norms = np.sqrt((x * x).sum(1))
            index = CollisionIndex(_unit(x), projections, seed)
            enough = max(verified_least, math.ceil(verified_share * len(ids)))
            asked = np.array([v for _, v in theirs], np.float64)
            lengths = np.sqrt((asked * asked).sum(1))
            searched = index.candidates(_unit(asked), share, enough, 0.3, 1.15)
            for (key, _), y, length, found in zip(theirs, asked, lengths, searched, strict=True):
                found = found[ids[found] != key]
                if len(found) < k:  # few vectors, or the query's own rows: all of the block
                    found = np.flatnonzero(ids != key)
                scores = (x[found] * y).sum(1) / (norms[found] * length)
                best = np.lexsort((ids[found], -scores))[:k]
                out += [(key, int(ids[found[b]]), float(scores[b])) for b in best]
        frame = pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})
        return pa.Table.from_pandas(frame, preserve_index=False)

    found = left.groupBy("cell").cogroup(right.groupBy("cell")).applyInArrow(search, "query_id bigint, vec_id bigint, score double")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
