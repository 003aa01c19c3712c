"""Hard negatives by norm-bucketed exact search of inner products.

Candidates are sorted by their norm and packed into buckets, longest first; anchors are packed into blocks.  The search
goes down the buckets in waves of doubling length.  No vector of a bucket can score more than the anchor's norm times
the bucket's largest norm (Cauchy-Schwarz), so a block meets a bucket only while that bound reaches what one of its
anchors still needs: the running k-th score of its best, or the lower limit of its score window.  A wave joins the
blocks that are still searching with the buckets they can reach, one row for each such pair, and ends with the merged
state of each block in the shared folder.  When no block reaches the next bucket, all shorter vectors are left unread.

Components are whole numbers.  Products are taken in double precision where every sum is below 2^53, so that it is
exact, and in whole numbers otherwise.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, keep, tune

NO_SCORE, NO_ID = np.iinfo(np.int64).min, np.iinfo(np.int64).max
_PACKED = "part int, seq bigint, length int, n int, top double, ids binary, labels binary, data binary"
_STATE = "block bigint, reach double, best binary"


def _pack_matrix(x: np.ndarray) -> bytes:
    """Whole numbers held in doubles, in the smallest type that holds them."""
    most = float(np.abs(x).max()) if x.size else 0.0
    kind = "<i2" if most < 2**15 else "<i4" if most < 2**31 else "<f8"
    return kind.encode() + x.astype(kind).tobytes()


def _matrix(data: bytes, n: int, length: int) -> np.ndarray:
    return np.frombuffer(data, data[:3].decode(), offset=3).astype(np.float64).reshape(n, length)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The exact inner products of the rows of two matrices of whole numbers, as int64."""
    length = a.shape[1]
    bound = (float(np.abs(a).max()) if a.size else 0.0) * (float(np.abs(b).max()) if b.size else 0.0) * max(length, 1)
    if bound < 2**53:
        return (a @ b.T).astype(np.int64)
    whole = np.array([[int(x) for x in row] for row in a], object).reshape(a.shape) @ np.array([[int(x) for x in row] for row in b], object).reshape(b.shape).T
    if max(map(abs, whole.ravel().tolist()), default=0) >= NO_ID:
        raise OverflowError("an inner product does not fit into 64 bits")
    return whole.astype(np.int64)


def _first(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """The k best of each row of (scores, ids), best first: an array (rows, k, 2); NO_SCORE marks none."""
    order = np.lexsort((ids, ~scores), axis=-1)[:, :k]
    out = np.full((len(scores), k, 2), NO_SCORE, np.int64)
    out[:, :, 1] = NO_ID
    out[:, : order.shape[1], 0] = np.take_along_axis(scores, order, 1)
    out[:, : order.shape[1], 1] = np.take_along_axis(ids, order, 1)
    return out


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """The k best of each row of a matrix of scores whose columns are ``ids``; NO_SCORE takes no part."""
    n = scores.shape[1]
    if n > 4 * k:  # whatever ties with the k-th score stays in
        cut = np.partition(scores, n - k, axis=1)[:, n - k]
        rows, columns = np.nonzero((scores >= cut[:, None]) & (scores > NO_SCORE))
        width = int(np.bincount(rows, minlength=len(scores)).max()) if len(rows) else 1
        at = np.arange(len(rows)) - np.searchsorted(rows, rows)
        few, some = np.full((len(scores), width), NO_SCORE, np.int64), np.full((len(scores), width), NO_ID, np.int64)
        few[rows, at], some[rows, at] = scores[rows, columns], ids[columns]
        return _first(few, some, k)
    return _first(scores, np.where(scores > NO_SCORE, ids[None, :], NO_ID), k)


def _merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Two states (..., k, 2) as one."""
    k = a.shape[-2]
    both = np.concatenate((a, b), -2).reshape(-1, 2 * k, 2)
    return _first(both[:, :, 0], both[:, :, 1], k).reshape(a.shape)


class Windows:
    """What each anchor of a block looks for: in ``kinds`` windows of scores, the k best rows of a label that fits."""

    def __init__(self, low: np.ndarray, high: np.ndarray, open_: np.ndarray, same_label: bool, k: int):
        self.low, self.high, self.open, self.same_label, self.k = low, high, open_, same_label, k

    @staticmethod
    def of_positives(n: int, k: int) -> Windows:
        return Windows(np.full((n, 1), NO_SCORE + 1), np.full((n, 1), NO_ID), np.ones((n, 1), bool), True, k)

    @staticmethod
    def of_negatives(positives: np.ndarray, percent: int, k: int) -> Windows:
        """From ``percent`` % of the positive's score, rounded up, to that score; none below a score of 0."""
        high = positives[:, :, 0]
        low = np.array([[-(-percent * p // 100) if p >= 0 else 0 for p in row] for row in high.tolist()], np.int64).reshape(high.shape)
        return Windows(low, high, (high >= 0) & (low <= high), False, k)

    def empty(self) -> np.ndarray:
        state = np.full((*self.low.shape, self.k, 2), NO_SCORE, np.int64)
        state[..., 1] = NO_ID
        return state

    def need(self, state: np.ndarray) -> np.ndarray:
        """For each anchor the least score that can still change its state; infinite where no window is open."""
        kth = state[:, :, -1, 0]
        return np.where(self.open, np.maximum(self.low, kth).astype(np.float64), np.inf).min(1)

    def reach(self, state: np.ndarray, norms: np.ndarray) -> np.ndarray:
        """For each anchor the least norm with which a vector can still reach its need."""
        need = self.need(state)
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(need <= 0, 0.0, need / norms * (1 - 1e-9))

    def visit(self, state: np.ndarray, block: tuple, bucket: tuple) -> np.ndarray:
        """What a bucket adds, as a state.  Anchors that cannot reach the bucket, and its rows that are too short for all
        the others, are left out."""
        ids, labels, x, norms = block
        their_ids, their_labels, y, lengths = bucket
        found = self.empty()
        reach = self.reach(state, norms)
        alive = np.flatnonzero(reach <= lengths[0])
        if not len(alive):
            return found
        stop = int(np.searchsorted(-lengths, -reach[alive].min(), "right"))
        scores = products(x[alive], y[:stop])
        fits = (labels[alive, None] == their_labels[None, :stop]) == self.same_label
        fits &= ids[alive, None] != their_ids[None, :stop]
        for w in range(self.low.shape[1]):
            least = np.maximum(self.low[alive, w], state[alive, w, -1, 0])[:, None]
            inside = fits & self.open[alive, w, None] & (scores >= least) & (scores <= self.high[alive, w, None])
            found[alive, w] = _best(np.where(inside, scores, NO_SCORE), their_ids[:stop], self.k)
        return found


def _tasks(work: int) -> int:
    """Tasks for so many packed rows, each of which is some work of its own."""
    return max(1, min(work, 20_000))


def _packs(rows: DataFrame, scale: int, size: int) -> DataFrame:
    """Rows (id, label, v) sorted by norm, longest first, in packs of ``size`` at most of one length of vector, numbered from 0 in
    that order; ``top`` is the largest norm of a pack."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = [np.floor(np.asarray(v, np.float64) * scale) for v in batch.column(2).to_pylist()]
            norms = [math.sqrt(float((x * x).sum())) for x in whole]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(norms, pa.float64()), pa.array([x.tobytes() for x in whole], pa.binary())], ["id", "label", "norm", "v"])

    measured = keep(rows.mapInArrow(measure, "id bigint, label bigint, norm double, v binary"), "measured")
    parts = max(1, math.ceil(measured.count() / (8 * size)))
    order = [F.col("norm").desc(), F.col("id"), F.col("v")]
    placed = measured.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple]] = {}
        seq = part = 0

        def flush(length: int) -> pa.RecordBatch:
            nonlocal seq
            some = held.pop(length)
            x = np.frombuffer(b"".join(r[3] for r in some), np.float64).reshape(len(some), length)
            seq += 1
            values = [[part], [seq], [length], [len(some)], [some[0][2]], [np.array([r[0] for r in some], "<i8").tobytes()], [np.array([r[1] for r in some], "<i8").tobytes()], [_pack_matrix(x)]]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, (pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.binary(), pa.binary(), pa.binary()), strict=True)], ["part", "seq", "length", "n", "top", "ids", "labels", "data"])

        for batch in batches:
            for *row, part in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                length = len(row[3]) // 8
                held.setdefault(length, []).append(row)
                if len(held[length]) == size:
                    yield flush(length)
        for length in sorted(held):
            yield flush(length)

    packed = keep(placed.mapInArrow(pack, _PACKED), "packs")
    # One total for each partition comes to the driver.
    totals = sorted((r["part"], r["n"]) for r in packed.groupBy("part").agg(F.count("*").alias("n")).collect())
    starts, done = [], 0
    for k, n in totals:
        starts.append((k, done))
        done += n
    before = rows.sparkSession.createDataFrame(starts, "part int, before bigint")
    numbered = packed.join(before, "part").select((F.col("before") + F.col("seq") - 1).alias("number"), "length", "n", "top", "ids", "labels", "data")
    numbered = keep(numbered.coalesce(_tasks(done)), "packs-numbered")
    discard(measured, packed)
    numbered.packs = done
    return numbered


def _unpacked(n: int, length: int, ids: bytes, labels: bytes, data: bytes) -> tuple:
    x = _matrix(data, n, length)
    return np.frombuffer(ids, "<i8"), np.frombuffer(labels, "<i8"), x, np.sqrt((x * x).sum(1))


def _wave(blocks: DataFrame, n_blocks: int, state: DataFrame, buckets: DataFrame, first: int, last: int, windows: Callable) -> DataFrame:
    """The state after the buckets from ``first`` to before ``last``."""
    mine = [F.col(c).alias(f"a_{c}") for c in ("n", "ids", "labels", "data", "given")]
    asking = state.join(blocks.select("block", "length", *mine), "block")
    asking = asking.withColumn("number", F.explode(F.sequence(F.lit(first), F.lit(last - 1))))
    cells = asking.join(buckets.where((F.col("number") >= first) & (F.col("number") < last)), ["number", "length"]).where(F.col("reach") <= F.col("top"))

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, best, length, n, ids, labels, data, given, m, i, l, d in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                wanted = windows(n, given)
                now = np.frombuffer(best, np.int64).reshape(wanted.empty().shape)
                found = wanted.visit(now, _unpacked(n, length, ids, labels, data), _unpacked(m, length, i, l, d))
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([found.tobytes()], pa.binary())], ["block", "best"])

    added = cells.select("block", "best", "length", "a_n", "a_ids", "a_labels", "a_data", "a_given", "n", "ids", "labels", "data").coalesce(_tasks(n_blocks * (last - first))).mapInArrow(visit, "block bigint, best binary")
    old = state.join(blocks.select("block", "length", *mine), "block").select("block", "best", "length", "a_n", "a_ids", "a_labels", "a_data", "a_given")
    new = added.select("block", "best", F.lit(None).cast("int").alias("length"), F.lit(None).cast("int").alias("a_n"), *(F.lit(None).cast("binary").alias(f"a_{c}") for c in ("ids", "labels", "data", "given")))
    met = old.unionByName(new).repartition("block").sortWithinPartitions("block", F.col("length").isNull())

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = key = wanted = norms = None

        def row() -> pa.RecordBatch:
            reach = float(wanted.reach(now, norms).min())
            return pa.RecordBatch.from_arrays([pa.array([key], pa.int64()), pa.array([reach]), pa.array([now.tobytes()], pa.binary())], ["block", "reach", "best"])

        for batch in batches:
            for block, best, length, n, ids, labels, data, given in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if n is not None:  # the block as it was comes first
                    if key is not None:
                        yield row()
                    key, wanted = block, windows(n, given)
                    now = np.frombuffer(best, np.int64).reshape(wanted.empty().shape)
                    norms = _unpacked(n, length, ids, labels, data)[3]
                else:
                    now = _merged(now, np.frombuffer(best, np.int64).reshape(now.shape))
        if key is not None:
            yield row()

    return met.coalesce(_tasks(n_blocks)).mapInArrow(merge, _STATE)  # a block stays in one partition


def _searched(blocks: DataFrame, n_blocks: int, buckets: DataFrame, windows: Callable) -> DataFrame:
    """The state of all blocks when no bucket can change it any more."""

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, n, given in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                wanted = windows(n, given)
                reach = float(wanted.reach(wanted.empty(), np.ones(n)).min())  # 0 where anything is still wanted
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([0.0 if reach < math.inf else reach]), pa.array([wanted.empty().tobytes()], pa.binary())], ["block", "reach", "best"])

    state = keep(blocks.select("block", "n", "given").mapInArrow(begin, _STATE), "state")
    first, length = 0, 1
    while first < buckets.packs:
        last = min(first + length, buckets.packs)
        top = buckets.where(F.col("number") == first).select("top").first()["top"]
        live = state.where(F.col("reach") <= top)
        if live.isEmpty():
            break
        new = keep(_wave(blocks, n_blocks, live, buckets, first, last, windows).unionByName(state.where(F.col("reach") > top)).coalesce(_tasks(n_blocks)), "state")
        discard(state)
        state, first, length = new, last, 2 * length
    return state


def hard_negatives(vectors: DataFrame, anchors: DataFrame, k_positives: int = 5, k_negatives: int = 5, percent: int = 80, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", bucket_rows: int = 4096, block_rows: int = 512) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Components become floor(``scale`` x); a score is the whole-number inner product with the anchor; higher scores come
    first, ties by smaller id.  An anchor's positives are its first ``k_positives`` rows of its label and another id.  For each
    of them come the first ``k_negatives`` rows of other labels with ``percent`` positive_score <= 100 negative_score <= 100
    positive_score (so none for a positive score below 0).

    ``anchors`` are rows like ``vectors``; of several with one id the least (label, vector) is taken.  Rows with a null id,
    label or vector, or with a null, NaN or infinite component take no part on either side; vectors are compared with
    those of their own length only, zero vectors score 0.  Repeated rows of ``vectors`` each count.  A score
    beyond 64 bits is an error.  Other columns are left out.
    """
    spark = vectors.sparkSession
    tune(spark)

    def clean(df: DataFrame) -> DataFrame:
        v = F.col(vector_col).cast("array<double>")
        finite: Column = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        rows = df.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
        return rows.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), v.alias("v")).where(finite)

    buckets = _packs(clean(vectors), scale, bucket_rows)
    asked = clean(anchors).groupBy("id").agg(F.min(F.struct("label", "v")).alias("r")).select("id", "r.*")
    blocks = _packs(asked, scale, block_rows)
    n_blocks = blocks.packs
    blocks = blocks.withColumnRenamed("number", "block").withColumn("given", F.lit(None).cast("binary"))

    def positive_windows(n: int, _: bytes | None) -> Windows:
        return Windows.of_positives(n, k_positives)

    def negative_windows(n: int, positives: bytes) -> Windows:
        return Windows.of_negatives(np.frombuffer(positives, np.int64).reshape(n, k_positives, 2), percent, k_negatives)

    positives = _searched(blocks, n_blocks, buckets, positive_windows)
    given = keep(blocks.drop("given").join(positives.select("block", F.col("best").alias("given")), "block").coalesce(_tasks(n_blocks)), "given")
    found = _searched(given, n_blocks, buckets, negative_windows)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n, ids, given, best in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                positive = np.frombuffer(given, np.int64).reshape(n, k_positives, 2)
                state = np.frombuffer(best, np.int64).reshape(n, k_positives, k_negatives, 2)
                a, p, r = np.nonzero(state[..., 0] > NO_SCORE)
                columns = (np.frombuffer(ids, "<i8")[a], positive[a, p, 1], (r + 1).astype(np.int32), state[a, p, r, 1], positive[a, p, 0], state[a, p, r, 0])
                yield pa.RecordBatch.from_arrays(list(map(pa.array, columns)), ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"])

    return given.join(found, "block").select("n", "ids", "given", "best").mapInArrow(rows, "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint")


ORACLE = """
WITH rows AS (
  SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
  SELECT a.id AS anchor_id, b.id AS id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
  FROM rows a JOIN rows b ON a.id % 100 = 0 AND a.id <> b.id AND len(a.v) = len(b.v)),
positives AS (SELECT * FROM pairs WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, p.id AS positive_id, row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY n.score DESC, n.id)::INTEGER AS rank,
  n.id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM positives p JOIN pairs n ON n.anchor_id = p.anchor_id AND NOT n.same AND 80 * p.score <= 100 * n.score AND 100 * n.score <= 100 * p.score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY n.score DESC, n.id) <= 5
"""
