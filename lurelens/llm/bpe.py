"""Byte-level BPE encoding and decoding.

Distinct words are encoded by Spark's higher-order functions: each word of a block of documents is folded, merge
by merge, over the array of its bytes, with the ranks in a literal map.  Pieces are held by their ids, and the map has
the rank of each pair of pieces that is one too.  It is an array of small maps indexed by a hash, as a look-up in one
Spark map takes time in proportion to its size.

Texts are read twice.  The first pass sends the distinct words of each input partition, cut into parts by their hashes;
a part's words are folded once for all documents of a block, which is a run of input partitions with about
``block_chars`` characters, and their ids are written in the shared folder as sorted arrays, so that memory is bounded
whatever the corpus is.  The second pass splits the texts again and lays out the ids of their words.  No text is
shuffled.  Words of over LONG_WORD bytes, which a fold would copy at every step, tokens that the merges alone do not give,
and any words that the block's arrays lack, as when a task that runs again meets its rows in another order, are merged in
the second pass.
"""

from __future__ import annotations

import base64
import heapq
import json
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, filesystem, grouped, keep, new_path, put_file, tune
from .pretokens import make_split

BUCKETS = 1 << 16
SPREAD = 40503  #: odd, so that the pairs of one piece with others fall into different buckets
NO_RANK = 2**31 - 1
PARTS = 64  #: into which the words of a block are cut, by the leading bits of their hashes
LONG_WORD = 512


def read_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a .tiktoken file: a base64 token and its rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(x[0]): int(x[1]) for x in map(bytes.split, lines) if x}


def pair_table(ranks: dict[bytes, int]) -> Column:
    """The ranks of pairs as a literal array of maps: the map at (left * SPREAD + right) mod BUCKETS has the pair of ids, as
    left * 2^32 + right, of each two tokens which make a third."""
    maps: dict[int, list[str]] = {}
    for token, rank in ranks.items():
        for i in range(1, len(token)):
            left, right = ranks.get(token[:i]), ranks.get(token[i:])
            if left is not None and right is not None:
                maps.setdefault((left * SPREAD + right) % BUCKETS, []).append(f'"{left << 32 | right}":{rank}')
    text = ",".join("{" + ",".join(maps.get(k, ())) + "}" for k in range(BUCKETS))
    return F.from_json(F.lit(f"[{text}]"), "array<map<string,int>>").cast("array<map<bigint,int>>")


def _let(value: Column, body) -> Column:
    return F.get(F.transform(F.array(value), body), F.lit(0))


def fold_word(word: Column, pairs: Column) -> Column:
    """The ids that the merges give one word, which is an array of the ids of its bytes.

    The state of the fold is the array of pieces and the array of the ranks of neighbouring pairs; a step joins the
    leftmost pair of least rank, whose id is that rank, and looks up its two new pairs.  Behind the last pair the ranks
    may end in some that stand for none.
    """

    def rank(left: Column, right: Column) -> Column:
        left, right = left.cast("long"), right.cast("long")
        bucket = F.get(pairs, (left * SPREAD + right).bitwiseAND(F.lit(BUCKETS - 1).cast("long")).cast("int"))
        return F.coalesce(F.element_at(bucket, F.shiftleft(left, 32).bitwiseOR(right)), F.lit(NO_RANK))

    def join(state: Column, best: Column) -> Column:
        p, r = state["p"], state["r"]

        def at(k: Column) -> Column:  # k: 1-based place of the pair; a look-up beyond either end finds no rank
            def renewed(x: Column, i: Column) -> Column:
                return F.when(i == k - 2, rank(F.get(p, k - 2), best)).when(i == k - 1, rank(best, F.get(p, k + 1))).otherwise(x)

            return F.struct(
                F.filter(F.transform(p, lambda x, i: F.when(i == k - 1, best).otherwise(x)), lambda x, i: i != k).alias("p"),
                F.filter(F.transform(r, renewed), lambda x, i: i != k).alias("r"),
            )

        return _let(F.array_position(r, best).cast("int"), at)

    def step(state: Column, _: Column) -> Column:
        return _let(
            F.coalesce(F.array_min(state["r"]), F.lit(NO_RANK)),
            lambda best: F.when(best == NO_RANK, state).otherwise(join(state, best)),
        )

    ranked = F.zip_with(F.slice(word, F.lit(1), F.size(word) - 1), F.slice(word, 2, F.size(word)), rank)
    start = F.struct(word.alias("p"), ranked.alias("r"))
    return F.aggregate(F.sequence(F.lit(1), F.size(word) - 1), start, step, lambda state: state["p"])


def merge_word(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one word of any length."""
    return [ranks[word]] if word in ranks else _merges(word, ranks)


def _merges(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """What the merges give a word: a heap of the ranked pairs, the leftmost of the least rank first."""
    end = [i + 1 for i in range(len(word))]  # where the piece that begins at i ends; 0: it is part of another
    before = list(range(-1, len(word) - 1))
    heap: list[tuple[int, int, int]] = []

    def push(i: int) -> None:
        j = end[i]
        if j < len(word) and (rank := ranks.get(word[i : end[j]])) is not None:
            heapq.heappush(heap, (rank, i, end[j]))

    for i in range(len(word)):
        push(i)
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = end[i]
        if not j or j >= len(word) or end[j] != stop:
            continue
        end[i], end[j] = stop, 0
        if stop < len(word):
            before[stop] = i
        push(i)
        if before[i] >= 0:
            push(before[i])
    out, i = [], 0
    while i < len(word):
        out.append(ranks[word[i : end[i]]])
        i = end[i]
    return out


class Units:
    """Numbers the stretches of about ``chars`` characters of the texts of this task: (partition << 20) + place."""

    def __init__(self, chars: int):
        self.chars, self.seen, self.first = chars, 0, TaskContext.get().partitionId() << 20

    def take(self, text: str) -> int:
        unit = self.first + self.seen // self.chars
        self.seen += len(text)
        return unit


def _hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def _asked(rows: DataFrame, pattern: str, block_chars: int, most_words: int = 300_000) -> DataFrame:
    """(unit, part, words, chars): the distinct words of each unit, in parts; a word may be sent more than once."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, units, zip_ = make_split(pattern), Units(block_chars), zstandard.ZstdCompressor(level=3)
        unit, chars, words = None, 0, set()

        def flush() -> pa.RecordBatch:
            found = [w for w in (w.encode() for w in words) if len(w) <= LONG_WORD]
            hashes = _hashes(found)
            order = np.argsort(hashes, kind="stable")
            cuts = np.searchsorted(hashes[order] >> np.uint64(58), np.arange(PARTS + 1))
            blobs = []
            for p in range(PARTS):
                mine = [found[k] for k in order[cuts[p] : cuts[p + 1]].tolist()]
                sizes = np.array([len(w) for w in mine], np.uint16).tobytes()
                blobs.append(zip_.compress(len(mine).to_bytes(4, "little") + sizes + b"".join(mine)))
            kinds = [pa.array([unit] * PARTS, pa.int64()), pa.array(range(PARTS), pa.int32()), pa.array(blobs, pa.binary()), pa.array([chars] + [0] * (PARTS - 1), pa.int64())]
            return pa.RecordBatch.from_arrays(kinds, ["unit", "part", "words", "chars"])

        for batch in batches:
            for text in batch.column(1).to_pylist():
                text = text or ""
                here = units.take(text)
                if words and (here != unit or len(words) > most_words):
                    yield flush()
                    chars, words = 0, set()
                unit, chars = here, chars + len(text)
                words.update(split(text))
        if words:
            yield flush()

    return keep(rows.mapInArrow(ask, "unit bigint, part int, words binary, chars bigint"), "bpe-words")


def _blocks(asked: DataFrame, block_chars: int) -> dict[int, int]:
    """The block of each unit: runs of units of about ``block_chars`` characters.  One number for each input partition (or
    stretch of ``block_chars`` characters of one) comes to the driver."""
    blocks, chars = {}, 0
    for unit, n in sorted(map(tuple, asked.where("chars > 0").groupBy("unit").agg(F.sum("chars")).collect())):
        blocks[unit] = chars // block_chars
        chars += n
    return blocks


def _fold_blocks(asked: DataFrame, blocks: dict[int, int], ranks: dict[bytes, int], folder: str) -> None:
    """Fold the distinct words of each (block, part) and write their hashes, numbers of ids and ids, in the order of the
    hashes, as a file in ``folder``.  What it holds depends on the words alone, so a task may run twice."""
    spark = asked.sparkSession
    bytes_ = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
    unmerged = {word for word, rank in ranks.items() if _merges(word, ranks) != [rank]}
    placed = asked.join(spark.createDataFrame(list(blocks.items()), "unit bigint, block bigint"), "unit")
    n = max(1, len(set(blocks.values())))
    placed = placed.select("block", "part", "words").repartition(PARTS * min(n, 1000), "block", "part").sortWithinPartitions("block", "part")

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (block, part), rows in grouped(batches, 2):
            words: set[bytes] = set()
            for (blob,) in rows:
                raw = zstandard.ZstdDecompressor().decompress(blob)
                count = int.from_bytes(raw[:4], "little")
                at = 4 + 2 * count
                for size in np.frombuffer(raw, "<u2", count, 4).tolist():
                    words.add(raw[at : at + size])
                    at += size
            found = sorted(words - unmerged)
            hashes = _hashes(found)
            alone = np.unique(hashes, return_counts=True)[1] == 1
            order = np.argsort(hashes, kind="stable")
            if not alone.all():  # words of equal hashes are left to the second pass
                order = order[np.repeat(alone, np.unique(hashes, return_counts=True)[1])]
            mine = [found[i] for i in order.tolist()]
            ends = np.cumsum([0, *map(len, mine)]).astype(np.int32)
            spelled = pa.ListArray.from_arrays(pa.array(ends), pa.array(bytes_[np.frombuffer(b"".join(mine), np.uint8)]))
            yield pa.RecordBatch.from_arrays(
                [pa.array([block], pa.int64()), pa.array([part], pa.int32()), pa.array([hashes[order].tobytes()], pa.binary()), pa.ListArray.from_arrays(pa.array([0, len(mine)], pa.int32()), spelled)],
                ["block", "part", "hashes", "spelled"],
            )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                block, part, hashes = (batch.column(k)[row].as_py() for k in range(3))
                codes = batch.column(3)[row].values
                at = codes.offsets.to_numpy()
                ids = codes.values.to_numpy(zero_copy_only=False)[at[0] : at[-1]]
                put_file(f"{folder}/{block}/{part}", [(len(hashes) // 8).to_bytes(8, "little"), hashes, np.diff(at).astype("<u2").tobytes(), ids.astype("<u4").tobytes()])
            yield pa.RecordBatch.from_arrays(batch.columns[:2], ["block", "part"])

    table = pair_table(ranks)
    # Written, so that a task never has the workers of both steps at once.
    words = keep(placed.mapInArrow(distinct, "block bigint, part int, hashes binary, spelled array<array<int>>"), "bpe-distinct")
    coded = words.select("block", "part", "hashes", _let(table, lambda t: F.transform("spelled", lambda w: fold_word(w, t))).alias("codes"))
    coded.mapInArrow(write, "block bigint, part int").write.format("noop").mode("overwrite").save()
    discard(words)


class Numbers(dict):
    """Numbers words in the order in which they come, in one look-up each; ``fresh`` has those since it was last cleared."""

    def __init__(self):
        super().__init__()
        self.fresh: list[str] = []

    def __missing__(self, word: str) -> int:
        number = self[word] = len(self)
        self.fresh.append(word)
        return number


class BlockCodes:
    """The hashes of a block's words, and where their ids are in ``ids``."""

    def __init__(self, folder: str, block: int):
        store, local = filesystem(f"{folder}/{block}")
        found: list[list[np.ndarray]] = [[], [], []]
        for part in range(PARTS):
            with store.open_input_stream(f"{local}/{part}") as file:
                data = file.read()
            n = int.from_bytes(data[:8], "little")
            found[0].append(np.frombuffer(data, "<u8", n, 8))
            found[1].append(np.frombuffer(data, "<u2", n, 8 + 8 * n))
            ids = np.frombuffer(data, "<u4", -1, 8 + 10 * n)
            found[2].append(ids.astype(np.uint16 if not len(ids) or ids.max() < 1 << 16 else np.uint32))
        self.hashes, self.sizes, self.ids = map(np.concatenate, found)
        self.first = np.cumsum(self.sizes, dtype=np.uint32) - self.sizes

    def find(self, words: list[bytes]) -> np.ndarray:
        """The place of each word; -1 where it is not."""
        if not len(self.hashes):
            return np.full(len(words), -1)
        hashes = _hashes(words)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        at[(self.hashes[at] != hashes) | (np.fromiter(map(len, words), np.int64, len(words)) > LONG_WORD)] = -1
        return at


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, id_col: str = "doc_id", text_col: str = "text", block_chars: int = 1 << 30) -> DataFrame:
    """One row (``id_col``, ids array<int>) for each row of ``docs``, in no fixed order.

    A null text is empty, and an empty text has no ids; repeated rows and null ids come back as they are; other
    columns are left out, so their names cannot clash.  Every byte must have a rank.
    """
    spark = docs.sparkSession
    tune(spark)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    id_type = rows.schema["id"].dataType.simpleString()
    folder = new_path(spark, "bpe-codes")
    asked = _asked(rows, pattern, block_chars)
    blocks = _blocks(asked, block_chars)
    if blocks:
        _fold_blocks(asked, blocks, ranks, folder)
    discard(asked)
    shared = spark.sparkContext.broadcast((ranks, blocks))

    def lay_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, units, (ranks, blocks) = make_split(pattern), Units(block_chars), shared.value
        block, codes, known, own, own_at = None, None, Numbers(), [], np.zeros(1, np.int64)
        place_of = np.zeros(0, np.int64)  # of each numbered word

        def learn() -> None:
            nonlocal own_at, place_of
            words = [w.encode() for w in known.fresh]
            at = codes.find(words) if codes else np.full(len(words), -1)
            for k in np.flatnonzero(at < 0).tolist():
                at[k] = -len(own) - 1
                own.append(merge_word(words[k], ranks))
            own_at = np.cumsum([0, *map(len, own)])
            place_of = np.concatenate((place_of, at))
            known.fresh.clear()

        def ids_of(found: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
            """The ids of some documents, one after another, and how many each has."""
            numbers = np.fromiter(map(known.__getitem__, chain.from_iterable(found)), np.int64, sum(map(len, found)))
            if known.fresh:
                learn()
            places = place_of[numbers]
            mine = places < 0
            there = np.where(mine, 0, places)
            if codes is None or not len(codes.ids):
                sizes, first, ids = np.zeros(len(places), np.int64), np.zeros(len(places), np.int64), np.zeros(1, np.int32)
            else:
                sizes, first, ids = codes.sizes[there].astype(np.int64), codes.first[there].astype(np.int64), codes.ids
            if mine.any():
                k = -places[mine] - 1
                sizes[mine], first[mine] = own_at[k + 1] - own_at[k], own_at[k] + len(ids)
            ends = np.concatenate(([0], np.cumsum(sizes)))
            at = np.repeat(first - ends[:-1], sizes) + np.arange(ends[-1])
            if not mine.any():
                flat = ids[at].astype(np.int32)
            else:
                flat = ids[np.minimum(at, len(ids) - 1)].astype(np.int32)
                merged = at >= len(ids)
                flat[merged] = np.array([i for x in own for i in x], np.int32)[at[merged] - len(ids)]
            return flat, ends[np.cumsum([0, *map(len, found)])]

        for batch in batches:
            keys, texts = batch.column(0), [x or "" for x in batch.column(1).to_pylist()]
            begin = 0
            while begin < len(texts):
                unit, stop, held = units.take(texts[begin]), begin + 1, len(texts[begin])
                while stop < len(texts) and held < 1 << 20 and (units.first + units.seen // units.chars) == unit:
                    units.take(texts[stop])
                    held, stop = held + len(texts[stop]), stop + 1
                now = blocks.get(unit)
                if now != block or len(known) > 200_000:
                    known, own, place_of = Numbers(), [], np.zeros(0, np.int64)
                if now != block:
                    block, codes = now, None
                    codes = None if now is None else BlockCodes(folder, now)
                found = [split(x) for x in texts[begin:stop]]
                flat, ends = ids_of(found)
                listed = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat))
                yield pa.RecordBatch.from_arrays([keys.slice(begin, stop - begin), listed], ["id", "ids"])
                begin = stop

    return rows.mapInArrow(lay_out, f"id {id_type}, ids array<int>").withColumnRenamed("id", id_col)


def decode(coded: DataFrame, ranks: dict[bytes, int], id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """One row (``id_col``, ``ids_col``, bytes binary) for each row of ``coded``: the pieces of the ids, concatenated.
    Null or no ids give no bytes; an id without a piece fails.  The pieces are a literal array of strings in which each
    character stands for one byte (ISO 8859-1)."""
    pieces = {rank: token.decode("latin-1") for token, rank in ranks.items()}
    table = F.from_json(F.lit(json.dumps([pieces.get(i) for i in range(max(pieces, default=-1) + 1)])), "array<string>")
    piece = lambda t: lambda i: F.coalesce(F.get(t, i), F.raise_error(F.concat(F.lit("no piece has the id "), i.cast("string"))))
    joined = _let(table, lambda t: F.array_join(F.transform(ids_col, piece(t)), ""))
    return coded.select(id_col, ids_col, F.encode(F.coalesce(joined, F.lit("")), "ISO-8859-1").alias("bytes"))


def digests(decoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of what ``decode`` returns."""
    return decoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("bytes", 256).alias("decoded_sha256"),
    )
