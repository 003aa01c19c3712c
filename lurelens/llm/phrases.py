"""Collocations of two to four words, mined from depth-limited count tries.

Each task builds count tries of the pieces of its texts, no deeper than the longest phrase, and serialises them in
sorted order, cut at common prefix ranges.  The slices of a range meet in one task, where the sorted runs are merged
into one trie.  A walk over it gives the counts of phrases and of their left parts; right parts are reached by suffix
links (a phrase without its first words), which are an equi-join of frequent phrases.  Only phrases that are frequent,
or lie on the edge of a range and may go on in the next one, leave the merge; the parts of a frequent phrase are
frequent themselves, so nothing that a score needs is left out.

Words are sorted by their UTF-8 bytes.  The bounds of the ranges come from a share of the documents; they decide
which task merges what, never a result.
"""

from __future__ import annotations

import json
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import keep, tune

DEPTH = 4
STOP = b"."  #: stands for every end of a piece; no word holds it
_FOLD = bytes(
    b + 32 if 65 <= b <= 90 else 46 if b in b".,;:!?\n\v\f\r" else 32 if b == 9 else b for b in range(256)
)

_SLICE = "lang string, range int, words binary, ids binary, counts binary"
_NODES = "lang string, phrase string, depth int, f bigint, edge boolean, l array<bigint>"


def tokens(text: str) -> list[bytes]:
    """The lower-cased words of a text, with STOP between its pieces."""
    return text.encode().translate(_FOLD).replace(STOP, b" . ").split()


def _pack(columns: list[np.ndarray], size: int) -> np.ndarray:
    """One sortable uint64 for each row of ids below ``size``; columns beyond 64 bits are ranked in pairs first."""
    bits = max(1, int(size - 1).bit_length())
    if bits * len(columns) <= 64:
        key = np.zeros(len(columns[0]), np.uint64)
        for c in columns:
            key = (key << np.uint64(bits)) | c.astype(np.uint64)
        return key
    first, second = (_pack(half, size) for half in (columns[: len(columns) // 2], columns[len(columns) // 2 :]))
    ranked = [np.unique(x, return_inverse=True) for x in (first, second)]
    return ranked[0][1].astype(np.uint64) * np.uint64(len(ranked[1][0])) + ranked[1][1].astype(np.uint64)


class Trie:
    """A count trie as its sorted paths: ``ids`` (a row of DEPTH word numbers for each path, from 1, 0 where it has
    ended) and ``counts``; words are numbered in byte order."""

    def __init__(self, words: list[bytes], ids: np.ndarray, counts: np.ndarray):
        self.words, self.ids, self.counts = words, ids, counts

    @staticmethod
    def of_paths(words: list[bytes], ids: np.ndarray, counts: np.ndarray | None = None) -> Trie:
        """Sorted paths with equal ones added up.  ``ids`` may be sorted runs one after the other, which the stable
        sort merges."""
        key = _pack([ids[:, k] for k in range(DEPTH)], len(words) + 1)
        order = np.argsort(key, kind="stable")
        key = key[order]
        starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
        if counts is None:
            counts = np.diff(np.append(starts, len(key)))
        else:
            counts = np.add.reduceat(counts[order], starts) if len(starts) else counts
        return Trie(words, ids[order[starts]], counts.astype(np.int64))

    @staticmethod
    def of_stream(stream: np.ndarray, vocabulary: list[bytes]) -> Trie:
        """The trie of all pieces in a stream of places in ``vocabulary``, where place 0 is STOP."""
        order = sorted(range(1, len(vocabulary)), key=vocabulary.__getitem__)
        number = np.zeros(len(vocabulary), np.uint32)
        number[order] = np.arange(1, len(vocabulary))
        at = np.concatenate((number[stream], np.zeros(DEPTH, np.uint32)))
        ids = np.empty((len(stream), DEPTH), np.uint32)
        goes_on = np.ones(len(stream), bool)
        for k in range(DEPTH):
            goes_on &= at[k : k + len(stream)] != 0
            ids[:, k] = np.where(goes_on, at[k : k + len(stream)], 0)
        return Trie.of_paths([vocabulary[i] for i in order], ids[ids[:, 0] != 0])

    @staticmethod
    def merge(tries: list[Trie]) -> Trie:
        """The k-way merge: words are numbered anew over all tries, then their sorted paths are merged."""
        words = sorted(set().union(*(t.words for t in tries)))
        number = {w: i for i, w in enumerate(words, 1)}
        ids = [np.array([0, *map(number.__getitem__, t.words)], np.uint32)[t.ids] for t in tries]
        return Trie.of_paths(words, np.concatenate(ids), np.concatenate([t.counts for t in tries]))

    def path(self, k: int) -> tuple[bytes, ...]:
        return tuple(self.words[i - 1] for i in self.ids[k] if i)

    def place(self, bound: tuple[bytes, ...]) -> int:
        """The first path that is not below ``bound``."""
        low, high = 0, len(self.ids)
        while low < high:
            middle = (low + high) // 2
            low, high = (middle + 1, high) if self.path(middle) < bound else (low, middle)
        return low

    def slices(self, bounds: list[tuple[bytes, ...]]) -> Iterator[tuple[int, Trie]]:
        """(range, its part of the trie, with the words that occur there) for each range that has paths."""
        cuts = [0, *(self.place(b) for b in bounds), len(self.ids)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            if a < b:
                used, at = np.unique(self.ids[a:b], return_inverse=True)
                pad = 0 if used[0] == 0 else 1
                yield k, Trie([self.words[i - 1] for i in used[1 - pad :]], (at + pad).reshape(-1, DEPTH).astype(np.uint32), self.counts[a:b])

    def serialised(self) -> tuple[bytes, bytes, bytes]:
        """(words, ids column by column, counts), each compressed."""
        kind = "<u2" if len(self.words) < 1 << 16 else "<u4"
        packed = (b" ".join(self.words), kind.encode() + self.ids.T.astype(kind).tobytes(), self.counts.astype("<i8").tobytes())
        codec = pa.Codec("zstd", 1)
        return tuple(len(x).to_bytes(8, "little") + codec.compress(x, asbytes=True) for x in packed)

    @staticmethod
    def read(words: bytes, ids: bytes, counts: bytes) -> Trie:
        codec = pa.Codec("zstd")
        words, ids, counts = (codec.decompress(x[8:], int.from_bytes(x[:8], "little"), asbytes=True) for x in (words, ids, counts))
        numbers = np.frombuffer(ids, ids[:3].decode(), offset=3).reshape(DEPTH, -1).T
        return Trie(words.split(b" "), np.ascontiguousarray(numbers).astype(np.uint32), np.frombuffer(counts, "<i8"))

    def nodes(self, least: int) -> pa.Table:
        """The nodes of at least ``least`` occurrences and all on the paths at either end of the trie (edge), as phrase,
        depth, f, edge and l: the counts of the ancestors from depth 1 on, null where an ancestor is on an edge."""
        text = pa.array(["", *(w.decode() for w in self.words)], pa.string())
        n, changed = len(self.ids), np.zeros(len(self.ids), bool)
        changed[:1] = True
        out, ancestors = [], []
        for d in range(1, DEPTH + 1):
            changed[1:] |= self.ids[1:, d - 1] != self.ids[:-1, d - 1]
            starts = np.flatnonzero(changed)
            f = np.add.reduceat(self.counts, starts) if n else self.counts
            edge = np.zeros(len(starts), bool)
            edge[:1] = edge[-1:] = True
            chosen = (self.ids[starts, d - 1] != 0) & (edge | (f >= least))
            at = starts[chosen]
            parts = [pc.take(text, pa.array(self.ids[at, k])) for k in range(d)]
            left = []
            for run_of, f_of, edge_of in ancestors:
                up = run_of[at]
                left.append(pa.array(f_of[up], mask=edge_of[up]))
            ends = np.arange(len(at) + 1, dtype=np.int32) * len(left)
            flat = pc.take(pa.concat_arrays(left), pa.array(np.arange(len(at) * len(left)).reshape(len(left), -1).T.ravel())) if left else pa.array([], pa.int64())
            out.append(pa.table({
                "phrase": pc.binary_join_element_wise(*parts, " ") if d > 1 else parts[0], "depth": pa.array(np.full(len(at), d, np.int32)),
                "f": pa.array(f[chosen]), "edge": pa.array(edge[chosen]), "l": pa.ListArray.from_arrays(pa.array(ends), flat),
            }))
            ancestors.append((np.cumsum(changed) - 1, f, edge))
        return pa.concat_tables(out)


def _shards(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[str, Trie]]:
    """(lang, trie) of the texts of a task; a trie holds about ``most`` words at the most before it is passed on."""
    held: dict[str, tuple[dict, list[np.ndarray]]] = {}
    size = 0

    def flush() -> Iterator[tuple[str, Trie]]:
        for lang, (number, streams) in sorted(held.items()):
            yield lang, Trie.of_stream(np.concatenate(streams), list(number))

    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            number, streams = held.setdefault(lang, (_Numbers(), []))
            found = tokens(text)
            found.append(STOP)
            streams.append(np.fromiter(map(number.__getitem__, found), np.uint32, len(found)))
            size += len(found)
            if size >= most:
                yield from flush()
                held, size = {}, 0
    yield from flush()


class _Numbers(dict):
    """Numbers words in the order in which they come; STOP is 0."""

    def __init__(self):
        super().__init__({STOP: 0})

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        return number


def _range_bounds(rows: DataFrame, ranges: int, share: int, range_words: int) -> dict[str, list[tuple[bytes, ...]]]:
    """At most ``ranges`` bounds over all langs, from the tries of about one document in ``share``.  Of these every ``step``-th
    path is taken, so some eight for each range come to the driver, which holds as much as for a range exchange."""
    if ranges < 2:
        return {}
    step = max(1, range_words // (share * 8))

    def thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, (lang, trie) in enumerate(_shards(batches, range_words)):
            first = zlib.crc32(f"{TaskContext.get().partitionId()} {k} {lang}".encode()) % step  # a trie may be shorter than a step
            paths = [json.dumps([w.decode() for w in trie.path(i)]) for i in range(first, len(trie.ids), step)]
            yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(paths), pa.string()), "path": pa.array(paths, pa.string())})

    found: dict[str, list[tuple[bytes, ...]]] = {}
    for r in rows.sample(1 / share, seed=5).mapInArrow(thin, "lang string, path string").collect():
        found.setdefault(r["lang"], []).append(tuple(w.encode() for w in json.loads(r["path"])))
    every = max(1, math.ceil(sum(map(len, found.values())) / ranges))
    return {lang: sorted(set(sorted(paths)[every - 1 :: every])) for lang, paths in found.items()}


def _words_from(phrase: Column, first: Column | int, n: Column | int) -> Column:
    return F.array_join(F.slice(F.split(phrase, " "), first, n), " ")


def frequent_phrases(docs: DataFrame, least: int = 30, text_col: str = "text", lang_col: str = "lang", range_words: int = 2_000_000, share: int = 64) -> tuple[DataFrame, DataFrame]:
    """(phrases, totals).  phrases: lang, phrase, depth (1 to 4 words), f, l (the counts of its proper left parts, shortest
    first) of each phrase that occurs ``least`` times or more; totals: lang, n (all words).

    A null text is empty, a null lang is ``und``; repeated rows count as often as they stand; a corpus without words
    gives empty tables.  Other columns are left out.
    """
    spark = docs.sparkSession
    tune(spark)
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bounds = spark.sparkContext.broadcast(_range_bounds(rows, math.ceil(size / 6 / range_words), share, range_words))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, trie in _shards(batches, 2 * range_words):
            for k, part in trie.slices(bounds.value.get(lang, [])):
                words, ids, counts = part.serialised()
                yield pa.RecordBatch.from_pydict({"lang": [lang], "range": pa.array([k], pa.int32()), "words": [words], "ids": [ids], "counts": [counts]})

    def merge(key: tuple, runs: pa.Table) -> pa.Table:
        lang = key[0].as_py()
        trie = Trie.merge([Trie.read(*run) for run in zip(*(runs[c].to_pylist() for c in ("words", "ids", "counts")), strict=True)])
        total = pa.table({"phrase": [""], "depth": pa.array([0], pa.int32()), "f": [int(trie.counts.sum())], "edge": [True], "l": pa.array([[]], pa.list_(pa.int64()))})
        found = pa.concat_tables([total, trie.nodes(least)])
        return found.add_column(0, "lang", pa.array([lang] * len(found), pa.string()))

    met = rows.mapInArrow(build, _SLICE).groupBy("lang", "range").applyInArrow(merge, _NODES)
    nodes = keep(met, "trie-nodes")
    totals = nodes.where("depth = 0").groupBy("lang").agg(F.sum("f").alias("n"))
    # Nodes on the edges of ranges are added up; all others come whole from one range.
    edges = nodes.where("edge and depth > 0").groupBy("lang", "phrase", "depth").agg(F.sum("f").alias("f"), F.first("l").alias("l"))
    whole = nodes.where("not edge").select("lang", "phrase", "depth", "f", "l").unionByName(edges.where(F.col("f") >= least))
    # A left part that is on an edge is looked up among the edges.
    lacking = F.exists("l", lambda x: x.isNull())
    steps = whole.where(lacking).select("lang", "phrase", F.posexplode("l").alias("k", "x")).where("x is null").select("lang", "phrase", "k", _words_from(F.col("phrase"), 1, F.col("k") + 1).alias("part"))
    known = edges.select("lang", F.col("phrase").alias("part"), F.col("f").alias("found"))
    filled = steps.join(known, ["lang", "part"]).groupBy("lang", "phrase").agg(F.map_from_entries(F.collect_list(F.struct("k", "found"))).alias("fill"))  # three entries at most
    mended = whole.join(filled, ["lang", "phrase"], "left").withColumn("l", F.transform("l", lambda x, k: F.coalesce(x, F.get(F.map_values("fill"), F.array_position(F.map_keys("fill"), k).cast("int") - 1))))
    return keep(mended.drop("fill"), "phrases"), totals


def collocations(docs: DataFrame, least: int = 30, top: int = 2000, inside_percent: int = 80, text_col: str = "text", lang_col: str = "lang", range_words: int = 2_000_000, share: int = 64) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: for each lang the ``top`` phrases of two to four words by score.

    a, l, r: occurrences of the phrase, and of its first and last part at the cut that scores least (ties to the
    shorter first part); score = floor(2000000 a / (l + r)); n: all words of the lang.  A phrase is left out if it lies
    in a longer one with at least ``inside_percent`` percent of its occurrences.  Ties of the score go to the larger a, then to
    the phrase that is smaller by its bytes.  Nulls, empty texts and repeated rows: see ``frequent_phrases``.
    """
    frequent, totals = frequent_phrases(docs, least, text_col, lang_col, range_words, share)
    phrases = frequent.where("depth > 1")
    # Suffix links: the phrase without its first k words.
    links = phrases.select("lang", "phrase", "depth", F.explode(F.sequence(F.lit(1), F.col("depth") - 1)).alias("k"), F.col("f").alias("a"), "l")
    links = links.withColumn("rest", _words_from(F.col("phrase"), F.col("k") + 1, F.col("depth"))).withColumn("l", F.get("l", F.col("k") - 1))
    right = frequent.where(F.col("depth") < DEPTH).select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r"))
    wide = lambda c: F.col(c).cast("decimal(20,0)")  # noqa: E731  products may pass 64 bits
    scored = links.join(right, ["lang", "rest"]).withColumns({"wa": wide("a"), "ws": wide("l") + wide("r")}).withColumn("score", F.expr("(cast(2000000 as decimal(7,0)) * wa) div ws"))
    best = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r")).alias("cut"))
    # Parts of longer phrases, two words at least.
    parts = phrases.where("depth > 2").select("lang", "phrase", "depth", F.col("f").alias("a"), F.explode(F.sequence(F.lit(2), F.col("depth") - 1)).alias("m"))
    parts = parts.select("lang", "a", "m", "phrase", F.explode(F.sequence(F.lit(1), F.col("depth") - F.col("m") + 1)).alias("i")).select("lang", "a", _words_from(F.col("phrase"), F.col("i"), F.col("m")).alias("phrase"))
    longer = parts.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = best.join(longer, ["lang", "phrase"], "left").where(F.coalesce(F.lit(100) * wide("longer") < F.lit(inside_percent) * F.col("cut.a").cast("decimal(20,0)"), F.lit(True)))
    kept = kept.select("lang", "phrase", "cut.*").drop("k")
    # The first of each lang are chosen in two steps, so that no task orders all phrases of a lang.
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    near = Window.partitionBy("lang", "salt").orderBy(*order)
    some = kept.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(64))).withColumn("rank", F.row_number().over(near)).where(F.col("rank") <= top).drop("salt")
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


ORACLE = r"""
WITH pieces AS (
  SELECT row_number() OVER () AS piece, lang, p FROM (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents)),
words AS (SELECT piece, lang, list_filter(regexp_split_to_array(p, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces),
totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM words GROUP BY lang),
grams AS (
  SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS phrase FROM (
    SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM words, (SELECT unnest([1, 2, 3, 4]) AS m) WHERE len(w) >= m)),
f AS (SELECT lang, m, phrase, count(*)::BIGINT AS f FROM grams GROUP BY ALL HAVING count(*) >= 30),
cuts AS (
  SELECT lang, m, phrase, f AS a, k, array_to_string(string_split(phrase, ' ')[1:k], ' ') AS head, array_to_string(string_split(phrase, ' ')[k + 1:m], ' ') AS rest FROM (
    SELECT *, unnest(range(1, m)) AS k FROM f WHERE m > 1)),
scored AS (
  SELECT c.lang, c.m, c.phrase, c.a, c.k, x.f AS l, y.f AS r, ((2000000::HUGEINT * c.a) // (x.f::HUGEINT + y.f))::BIGINT AS score
  FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = c.head JOIN f y ON y.lang = c.lang AND y.phrase = c.rest),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
parts AS (
  SELECT lang, f, array_to_string(string_split(phrase, ' ')[i:i + size - 1], ' ') AS phrase FROM (
    SELECT *, unnest(range(1, m - size + 2)) AS i FROM (SELECT *, unnest(range(2, m)) AS size FROM f WHERE m > 2))),
longer AS (SELECT lang, phrase, max(f) AS longest FROM parts GROUP BY ALL),
kept AS (SELECT b.* FROM best b LEFT JOIN longer g ON g.lang = b.lang AND g.phrase = b.phrase WHERE g.longest IS NULL OR 100::HUGEINT * g.longest < 80::HUGEINT * b.a)
SELECT lang, rank, phrase, a, l, r, n, score FROM (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept) JOIN totals USING (lang)
WHERE rank <= 2000
"""
