"""Near-duplicate documents by DartMinHash signatures.

Each weighted element (a shingle, with weight 1 or its count) owns the region [0, weight) x [0, rank limit) of a
plane on which darts lie as a Poisson process that the element's hash alone decides.  A dart also names one of k
coordinates.  Per coordinate the dart of least rank is kept; two documents agree there with the probability of
their weighted Jaccard similarity.  Only about k log k darts fall on a document, however many shingles it has.

Bands of coordinates give buckets.  The pivot of a bucket is its least document; a pivot's group is all that share a
bucket with it, so every candidate pair lies in the group of its bucket's pivot.  A group is dealt to blocks of bounded
size, each with the pivot.  A block compares its members with the pivot, and those far from it with the others by an
exact set join: a member must share one of its rarest shingles (rarest within the block) with any partner, and Jaccard
distance is a metric, so members much nearer to the pivot than the nearest far one are out of reach.  Of the links
found a block returns those that join what was apart, so never more than it has members.  Blocks of one group are then
joined the same way, far members of each with the members of all.  No pair of documents is a row, but links are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, grouped, keep, tune
from .graph import components
from .shingles import Shingler, mix, words

_U = np.uint64


def _unit(h: np.ndarray) -> np.ndarray:
    """Uniform in (0, 1)."""
    return ((h >> _U(11)).astype(np.float64) + 0.5) / 2.0**53


def dart_signature(elements: np.ndarray, weights: np.ndarray, k: int) -> np.ndarray:
    """k uint64 dart marks, the earliest dart of each coordinate.  ``elements``: distinct uint64 hashes.

    A weight's region is cut in octaves [0,1), [1,2), [2,4), ...; in an octave of width d an element's darts come
    by rank as a Poisson process of rate d, each with a place in the octave.  A dart counts if its place is under
    the weight.  The rank limit is raised until each coordinate has a dart.
    """
    best_rank = np.full(k, np.inf)
    best_mark = np.zeros(k, np.uint64)
    total = float(weights.sum())
    if not len(elements) or not total > 0:
        return best_mark
    octaves = []
    low, width, number = 0.0, 1.0, 0
    while True:
        inside = weights > low
        if not inside.any():
            break
        octaves.append((low, width, mix(elements[inside] ^ _U(0x51ED270B35A4C3F1 * (number + 1) & (1 << 64) - 1)), weights[inside]))
        low, width, number = low + width, width if number == 0 else width * 2, number + 1
    limit = k * (np.log(k) + 3.0) / total
    while True:
        ranks, marks, coordinates = [], [], []
        for low, width, seeds, w in octaves:
            rank, seed, weight, step = np.zeros(len(seeds)), seeds, w, 0
            while len(seed):
                if len(seed) <= 64:  # few elements with many darts each: all their darts at once
                    steps = int(limit * width + 6 * np.sqrt(limit * width)) + 12
                    draw = mix(seed + ((2 * np.arange(step, step + steps, dtype=np.uint64)[:, None] + _U(1)) * _U(0x9E3779B97F4A7C15)))
                    rank = rank - np.cumsum(np.log(_unit(draw)), axis=0) / width
                    live = rank < limit
                    mark = mix(draw ^ _U(0xD1B54A32D192ED03))
                    hit = live & (low + width * _unit(mark) < weight)
                    ranks.append(rank[hit])
                    marks.append(mark[hit])
                    coordinates.append((mix(mark[hit]) % _U(k)).astype(np.int64))
                    last = live[-1]
                    rank, seed, weight, step = rank[-1][last], seed[last], weight[last], step + steps
                    continue
                draw = mix(seed + _U((2 * step + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
                rank = rank - np.log(_unit(draw)) / width
                live = rank < limit
                rank, seed, weight, draw = rank[live], seed[live], weight[live], draw[live]
                mark = mix(draw ^ _U(0xD1B54A32D192ED03))
                hit = low + width * _unit(mark) < weight
                ranks.append(rank[hit])
                marks.append(mark[hit])
                coordinates.append((mix(mark[hit]) % _U(k)).astype(np.int64))
                step += 1
        ranks, marks, coordinates = map(np.concatenate, (ranks, marks, coordinates))
        if len(np.unique(coordinates)) == k:
            break
        limit *= 2
    order = np.lexsort((marks, ranks))[::-1]
    best_mark[coordinates[order]] = marks[order]
    return best_mark


def weighted(shingles: np.ndarray, weighting: str) -> tuple[np.ndarray, np.ndarray]:
    elements, counts = np.unique(shingles, return_counts=True)
    return elements, (np.ones(len(elements)) if weighting == "unit" else counts.astype(np.float64))


def _elements(shingles: np.ndarray, weighting: str) -> np.ndarray:
    """The distinct elements of a text, sorted.  A multiset is a set of (element, number): the k-th copy of an element is
    an element of its own."""
    elements, weights = weighted(shingles, weighting)
    if weighting == "unit":
        return elements
    copies = weights.astype(np.int64)
    number = np.arange(copies.sum()) - np.repeat(np.cumsum(copies) - copies, copies)
    with np.errstate(over="ignore"):
        return np.sort(mix(np.repeat(elements, copies) + number.astype(np.uint64) * _U(0x9E3779B97F4A7C15)))


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, bands: int = 25, rows: int = 5, weighting: str = "unit") -> DataFrame:
    """(doc_id, key, n, buckets) for each row with words and an id: key is the MD5 of the words, n the total weight,
    buckets one long for each band of the signature.

    weighting: "unit" (sets: the similarity is Jaccard's) or "count" (multisets).
    """
    tune(docs.sparkSession)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("doc_id is not null and text is not null")

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(shingle)
        salt = mix(np.arange(1, bands + 1, dtype=np.uint64))
        with np.errstate(over="ignore"):
            for batch in batches:
                ids, keys, sizes, buckets = [], [], [], []
                for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    found = words(text)
                    if not found:
                        continue
                    elements, weights = weighted(shingler.of_words(found), weighting)
                    marks = dart_signature(elements, weights, bands * rows).reshape(bands, rows)
                    bucket = salt.copy()
                    for r in range(rows):
                        bucket = mix(bucket * _U(0x9E3779B97F4A7C15) + marks[:, r])
                    ids.append(key)
                    keys.append(hashlib.md5(b" ".join(found)).digest())
                    sizes.append(float(weights.sum()))
                    buckets.append(bucket.view(np.int64))
                flat = np.concatenate(buckets) if buckets else np.zeros(0, np.int64)
                listed = pa.ListArray.from_arrays(pa.array(np.arange(len(ids) + 1, dtype=np.int32) * bands), pa.array(flat))
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.binary()), pa.array(sizes, pa.float64()), listed], ["doc_id", "key", "n", "buckets"])

    return source.mapInArrow(sign, "doc_id bigint, key binary, n double, buckets array<bigint>")


class Linked:
    """Union-find over any keys; the root of a set is its least key."""

    def __init__(self):
        self.up: dict = {}

    def root(self, x):
        up = self.up
        top = x
        while (y := up.get(top, top)) != top:
            top = y
        while (y := up.get(x, x)) != x:
            up[x], x = top, y
        return top

    def join(self, x, y) -> bool:
        x, y = self.root(x), self.root(y)
        if x == y:
            return False
        self.up[max(x, y)] = min(x, y)
        return True


def _common(one: np.ndarray, sets: list[np.ndarray]) -> np.ndarray:
    """How many elements each of ``sets`` (none empty) shares with ``one``, which is sorted."""
    flat = np.concatenate(sets)
    at = np.minimum(np.searchsorted(one, flat), len(one) - 1)
    first = np.cumsum([0, *map(len, sets[:-1])])
    return np.add.reduceat((one[at] == flat).astype(np.int64), first)


def set_join(left: list[tuple], right: list[tuple], threshold: float, linked: Linked) -> Iterator[tuple[int, int, float]]:
    """Links (a, b, similarity) of ``left`` with ``right`` (node, sorted elements) that join what ``linked`` has apart.

    Of the elements of x a partner has at least ``threshold`` in common with it, so it has one of the others plus one:
    the rarest of them in ``right`` are looked up, which are few or have few owners.
    """
    sets = [x for _, x in right]
    sizes = np.array([len(x) for x in sets])
    flat = np.concatenate(sets)
    order = np.argsort(flat, kind="stable")
    owners, flat = np.repeat(np.arange(len(sets), dtype=np.int32), sizes)[order], flat[order]
    del order
    first = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]]))
    known, often = flat[first], np.diff(first, append=len(flat))
    del flat
    for node, x in left:
        at = np.minimum(np.searchsorted(known, x), len(known) - 1)
        at = at[known[at] == x]
        need = int(np.ceil(threshold * len(x) - 1e-9))
        if len(at) < need:
            continue
        rare = at[np.argsort(often[at], kind="stable")[: len(at) - need + 1]]
        found = np.unique(np.concatenate([owners[first[k] : first[k] + often[k]] for k in rare]))
        n = sizes[found]
        found = found[np.minimum(n, len(x)) >= threshold * np.maximum(n, len(x)) - 1e-9]
        mine = linked.root(node)
        found = [k for k in found.tolist() if linked.root(right[k][0]) != mine]
        if not found:
            continue
        shared = _common(x, [sets[k] for k in found])
        similar = shared / (len(x) + sizes[found] - shared)
        for k in np.flatnonzero(similar >= threshold - 1e-12).tolist():
            other = right[found[k]][0]
            if linked.join(node, other):
                yield min(node, other), max(node, other), float(similar[k])


def block_links(pivot: tuple, members: list[tuple], threshold: float) -> tuple[list[tuple[int, int, float]], np.ndarray]:
    """Links within a block that hold all similar members together, and the members' similarities with the pivot."""
    sizes = np.array([len(x) for _, x in members])
    shared = _common(pivot[1], [x for _, x in members])
    similar = shared / (sizes + len(pivot[1]) - shared)
    linked, links = Linked(), []
    for k in np.flatnonzero(similar >= threshold - 1e-12).tolist():
        if linked.join(pivot[0], members[k][0]):
            links.append((min(pivot[0], members[k][0]), max(pivot[0], members[k][0]), float(similar[k])))
    far = similar < threshold - 1e-12
    if far.any():
        within = np.flatnonzero(far | (similar <= similar[far].max() + 1.0 - threshold + 1e-9))
        if len(within) > 1:
            links += set_join([members[k] for k in np.flatnonzero(far)], [members[k] for k in within], threshold, linked)
    return links, similar


_FOUND = "a bigint, b bigint, similarity double, elements binary"


def _found(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * 4
    kinds = [pa.int64(), pa.int64(), pa.float64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["a", "b", "similarity", "elements"])


def _blocks(count: str, elements: str, block_rows: int, block_elements: int) -> Column:
    """How many blocks of bounded size take so many members with so many elements together."""
    return F.greatest(F.ceil(F.col(count) / block_rows), F.ceil(F.col(elements) / block_elements), F.lit(1)).cast("int")


def _block_of(blocks: str, *salt) -> Column:
    return F.pmod(F.xxhash64("node", *map(F.lit, salt)), F.col(blocks)).cast("int")


def links(signed: DataFrame, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, threshold: float = 0.8, weighting: str = "unit", block_rows: int = 8192, block_elements: int = 1 << 20) -> tuple[DataFrame, DataFrame]:
    """(membership, edges): the node of each document, which is the least id with its words, and verified links
    (a, b, similarity) of nodes that hold every candidate pair at or over the threshold together."""
    # The key is of the words, which decide n and the buckets: one row stands for all of its key, however often one repeats.
    reps = keep(signed.groupBy("key").agg(F.min("doc_id").alias("node"), F.first("n").alias("n"), F.first("buckets").alias("buckets")), "reps")
    members = keep(signed.select("doc_id", "key").join(reps.select("key", "node"), "key").select("doc_id", "node"), "members")
    alone = reps.select("node", "n", F.explode("buckets").alias("bucket"))
    pivots = alone.groupBy("bucket").agg(F.min("node").alias("pivot"), F.max("node").alias("last")).where("pivot < last").select("bucket", "pivot")
    pairs = keep(alone.join(pivots.hint("merge"), "bucket").where("node <> pivot").groupBy("pivot", "node").agg(F.max("n").alias("n")), "pairs")
    sized = pairs.groupBy("pivot").agg(F.count("*").alias("rows"), F.sum("n").alias("elements"))
    sized = sized.select("pivot", _blocks("rows", "elements", block_rows, block_elements).alias("blocks"))
    placed = pairs.join(sized.hint("merge"), "pivot").select("pivot", _block_of("blocks").alias("block"), "blocks", F.lit(True).alias("member"), "node")
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")
    placed = placed.union(sized.select("pivot", every, "blocks", F.lit(False), F.col("pivot").alias("node")))
    texts = docs.select(F.col(id_col).cast("long").alias("node"), F.col(text_col).alias("text")).where("node is not null and text is not null")
    if signed.groupBy("doc_id").count().where("count > 1").limit(1).count():
        texts = texts.dropDuplicates(["node", "text"])
    sent = placed.hint("merge").join(texts, "node").select("pivot", "block", "blocks", "member", "node", "text")
    sent = sent.repartition("pivot", "block").sortWithinPartitions("pivot", "block", "member", "node")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(shingle)
        out: list[tuple] = []

        def sets() -> Iterator[pa.RecordBatch]:  # the texts of a batch make way for their elements
            for batch in batches:
                elements = [_elements(shingler(t), weighting) for t in batch.column(5).to_pylist()]
                yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array([x.tobytes() for x in elements], pa.binary())], [*"pbkmne"])

        for (pivot, _, blocks), rows in grouped(sets(), 3):
            held = [(node, np.frombuffer(x, np.uint64)) for _, node, x in rows if x]
            # The pivot stands first; more texts of its id are members like others.
            if len(held) < 2 or held[0][0] != pivot:
                continue
            found, similar = block_links(held[0], held[1:], threshold)
            out += [(*link, None) for link in found]
            if blocks > 1:
                out += [(pivot, node, float(s), x.tobytes()) for (node, x), s in zip(held[1:], similar, strict=True)]
            if len(out) >= 4096:
                yield _found(out)
                out = []
        yield _found(out)

    found = keep(sent.mapInArrow(compare, _FOUND), "links")
    discard(reps, pairs)
    edges = found.where("elements is null").select("a", "b", "similarity")
    apart = found.where("elements is not null")
    if apart.limit(1).count():
        edges = edges.union(_across(apart, threshold, block_rows, block_elements))
    return members, edges


def _across(apart: DataFrame, threshold: float, block_rows: int, block_elements: int) -> DataFrame:
    """Links between the blocks of groups of several blocks: rows (pivot a, node b, similarity with a, elements)."""
    far = F.col("similarity") < threshold - 1e-12
    apart = apart.select(F.col("a").alias("pivot"), F.col("b").alias("node"), "similarity", "elements")
    top = apart.where(far).groupBy("pivot").agg(F.max("similarity").alias("top"))
    used = apart.join(top, "pivot").where(far | (F.col("similarity") <= F.col("top") + 1.0 - threshold + 1e-9))
    n = F.octet_length("elements") / 8
    sized = used.groupBy("pivot").agg(F.count("*").alias("rows"), F.sum(n).alias("size"), F.count_if(far).alias("far_rows"), F.sum(F.when(far, n).otherwise(0.0)).alias("far_size"))
    sized = sized.select("pivot", _blocks("rows", "size", block_rows, block_elements).alias("right"), _blocks("far_rows", "far_size", block_rows, block_elements).alias("left"))
    used = used.join(sized, "pivot")
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    right = used.select("pivot", all_of("left").alias("i"), _block_of("right", 1).alias("j"), F.lit(1).alias("side"), "node", "elements")
    left = used.where(far).select("pivot", _block_of("left", 2).alias("i"), all_of("right").alias("j"), F.lit(0).alias("side"), "node", "elements")
    cells = left.union(right).repartition("pivot", "i", "j").sortWithinPartitions("pivot", "i", "j", "side", "node")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in grouped(batches, 3):
            sides: tuple[list, list] = ([], [])
            for side, node, x in rows:
                sides[side].append((node, np.frombuffer(x, np.uint64)))
            if all(sides):
                yield _found([(*link, None) for link in set_join(*sides, threshold, Linked())])

    return keep(cells.mapInArrow(join, _FOUND), "links").select("a", "b", "similarity")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, threshold: float = 0.8, bands: int = 25, rows: int = 5, weighting: str = "unit") -> DataFrame:
    """(doc_id, class_id, is_kept) for each row of ``docs``: class_id is the least id of the documents that are
    linked, at any distance, by similarities of at least ``threshold``; is_kept is true for that one.

    Texts without words (null, empty, only punctuation) are alone in their class; a null id has a null class and is
    kept; rows with equal ids count as one document.  Other columns are left out.
    """
    signed = keep(signatures(docs, id_col, text_col, shingle, bands, rows, weighting), "signatures")
    members, edges = links(signed, docs, id_col, text_col, shingle, threshold, weighting)
    joined = components(edges)
    discard(signed)
    classes = members.join(joined, "node", "left").groupBy("doc_id").agg(F.min(F.coalesce("component", "node")).alias("class_id"))
    ids = docs.select(F.col(id_col).cast("long").alias("doc_id"))
    out = ids.join(classes, "doc_id", "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"))
    return out.withColumn("is_kept", F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(True)))
