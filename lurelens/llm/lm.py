"""Language-model scores by deleted interpolation.

The model mixes the maximum-likelihood estimates of all orders up to ``order`` and a uniform one.  The weights of
the mixture depend on the bucket of the context's frequency (its binary logarithm) and are learned by expectation
maximisation on documents that are deleted from the counts for that purpose.

Counting and looking up go by blocks.  Documents are packed, in the order of the scan, into chunks of bounded size.
A chunk sends the distinct hashes of its n-grams, sorted and cut into parts of the hash space, with its counts; a
part sums what all chunks sent and answers each with counts in the order of its request, so that the answer needs
no keys.  A chunk then scores its own documents.  So each n-gram crosses the network once for a chunk, not once for
each time it stands there; a frequent one loads no task more than a rare one.  N-grams are told apart by 64-bit
hashes.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, keep, tune
from .shingles import mix

FOLDS, TEST_FOLD, DELETED_FOLD = 7, 2, 3
BUCKETS = 24  #: of context frequencies; the last one is open
BIN = 4  #: bins to an octave in the histogram of probability ratios that EM works on
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_U = np.uint64
END, BEGIN = _U(0x6C6D2D656E640001), _U(0x6C6D2D6265670002)


def _fold(doc_id: int | None) -> int:
    return -1 if doc_id is None else zlib.crc32(str(doc_id).encode()) % FOLDS


def _pack(x: np.ndarray) -> bytes:
    """Bytes of equal place together, compressed: what is always zero costs nothing."""
    planes = np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T if len(x) else x.view(np.uint8)
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def _unpack(data: bytes, kind: str) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(size, -1).T).view(kind).ravel() if len(raw) else np.zeros(0, kind)


class Tokens:
    """text -> hashes of its tokens: its lower-cased words (A-Z only) and an end."""

    def __init__(self):
        self.known = Memo(xxhash.xxh3_64_intdigest)

    def __call__(self, text: bytes) -> np.ndarray:
        words = text.translate(_FOLD).split()
        out = np.empty(len(words) + 1, np.uint64)
        out[:-1] = np.fromiter(map(self.known.__getitem__, words), np.uint64, len(words))
        out[-1] = END
        return out


def _chunk_tokens(blob: bytes, lengths: np.ndarray, tokens: Tokens) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of all documents of a chunk, and the first place of each document and the end."""
    raw = zstandard.ZstdDecompressor().decompress(blob)
    ends = np.cumsum(lengths)
    runs = [tokens(raw[e - n : e]) for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
    return np.concatenate(runs), np.concatenate(([0], np.cumsum([len(x) for x in runs])))


def _grams(tokens: np.ndarray, starts: np.ndarray, order: int) -> list[np.ndarray]:
    """For each order the hash of the n-gram that ends at each token; texts begin with BEGIN."""
    out, key, before = [mix(tokens)], tokens, tokens
    with np.errstate(over="ignore"):
        for k in range(2, order + 1):
            before = np.concatenate(([BEGIN], before[:-1]))
            before[starts[:-1]] = BEGIN
            key = mix(key * _U(0x9E3779B97F4A7C15) + before)
            out.append(mix(key + _U(k)))
    return out


def _contexts(counts: list[np.ndarray], starts: np.ndarray, documents: float, tokens: float) -> list[np.ndarray]:
    """For each order the count of the context of each token: that of the n-gram one shorter before it."""
    out = [np.full(len(counts[0]), float(tokens))]
    for lower in counts[:-1]:
        c = np.concatenate(([documents], lower[:-1]))
        c[starts[:-1]] = documents
        out.append(c)
    return out


def _chunks(docs: DataFrame, id_col: str, text_col: str, chunk_bytes: int) -> DataFrame:
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zip_ = zstandard.ZstdCompressor(level=3)
        part, seq = TaskContext.get().partitionId(), 0
        held: dict[bool, tuple[list, list]] = {False: ([], []), True: ([], [])}
        size = {False: 0, True: 0}

        def flush(deleted: bool) -> pa.RecordBatch:
            ids, texts = held[deleted]
            lengths = np.array([len(x) for x in texts], np.int64)
            row = [
                pa.array([(part << 32) + seq], pa.int64()), pa.array([deleted]), pa.array([ids], pa.list_(pa.int64())),
                pa.array([lengths.tobytes()], pa.binary()), pa.array([zip_.compress(b"".join(texts))], pa.binary()),
            ]
            return pa.RecordBatch.from_arrays(row, ["chunk", "deleted", "ids", "lengths", "blob"])

        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                data = (text or "").encode()
                deleted = _fold(key) == DELETED_FOLD
                if held[deleted][0] and size[deleted] + len(data) > chunk_bytes:
                    yield flush(deleted)
                    held[deleted], size[deleted], seq = ([], []), 0, seq + 1
                held[deleted][0].append(key)
                held[deleted][1].append(data)
                size[deleted] += len(data)
        for deleted in (False, True):
            if held[deleted][0]:
                yield flush(deleted)
                seq += 1

    return keep(rows.mapInArrow(pack, "chunk bigint, deleted boolean, ids array<bigint>, lengths binary, blob binary"), "lm-chunks")


def _answers(chunks: DataFrame, order: int, parts: int) -> DataFrame:
    """(chunk, gram, part, every, deleted): the counts of the chunk's n-grams of the order ``gram`` in the part, packed;
    chunk -1 has the totals of the part."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens()
        for batch in batches:
            for chunk, ids, lengths, blob in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                found, starts = _chunk_tokens(blob, np.frombuffer(lengths, np.int64), tokens)
                folds = np.repeat([_fold(x) for x in ids], np.diff(starts))
                train, gone = folds != TEST_FOLD, folds == DELETED_FOLD
                for k, keys in enumerate(_grams(found, starts, order), 1):
                    unique, inverse = np.unique(keys, return_inverse=True)
                    every = np.bincount(inverse, train, len(unique)).astype(np.uint32)
                    deleted = np.bincount(inverse, gone, len(unique)).astype(np.uint32)
                    place = ((unique >> _U(40)) * _U(parts)) >> _U(24)
                    cuts = np.searchsorted(place, np.arange(parts + 1))
                    for p in np.flatnonzero(np.diff(cuts)).tolist():
                        here = slice(cuts[p], cuts[p + 1])
                        steps = np.diff(unique[here], prepend=_U(0))
                        yield pa.RecordBatch.from_pydict(
                            {"chunk": [chunk], "gram": [k], "part": [p], "keys": [_pack(steps)], "every": [_pack(every[here])], "deleted": [_pack(deleted[here]) if gone.any() else b""]}
                        )

    def answer(rows: pa.Table) -> pa.Table:
        asked = [np.cumsum(_unpack(x, "<u8"), dtype=np.uint64) for x in rows["keys"].to_pylist()]
        every = np.concatenate([_unpack(x, "<u4") for x in rows["every"].to_pylist()])
        deleted = np.concatenate([_unpack(x, "<u4") if x else np.zeros(len(a), np.uint32) for x, a in zip(rows["deleted"].to_pylist(), asked, strict=True)])
        unique, inverse = np.unique(np.concatenate(asked), return_inverse=True)
        total = np.bincount(inverse, every, len(unique))
        gone = np.bincount(inverse, deleted, len(unique))
        out: dict[str, list] = {"chunk": [], "gram": [], "part": [], "every": [], "deleted": []}
        at, gram, part = 0, rows["gram"][0].as_py(), rows["part"][0].as_py()
        for chunk, keys, had in zip(rows["chunk"].to_pylist(), asked, rows["deleted"].to_pylist(), strict=True):
            here = inverse[at : at + len(keys)]
            at += len(keys)
            for name, value in (("chunk", chunk), ("gram", gram), ("part", part), ("every", _pack(total[here].astype(np.uint64))), ("deleted", _pack(gone[here].astype(np.uint64)) if had else b"")):
                out[name].append(value)
        sums = np.array([total.sum(), (total > 0).sum(), (total - gone).sum(), (total - gone > 0).sum()], np.uint64)
        for name, value in (("chunk", -1), ("gram", gram), ("part", part), ("every", sums.tobytes()), ("deleted", b"")):
            out[name].append(value)
        return pa.Table.from_pydict(out, schema=pa.schema([("chunk", pa.int64()), ("gram", pa.int64()), ("part", pa.int64()), ("every", pa.binary()), ("deleted", pa.binary())]))

    requests = chunks.select("chunk", "ids", "lengths", "blob").mapInArrow(ask, "chunk bigint, gram bigint, part bigint, keys binary, every binary, deleted binary")
    answers = requests.groupBy("gram", "part").applyInArrow(answer, "chunk bigint, gram bigint, part bigint, every binary, deleted binary")
    return keep(answers, "lm-answers")


def _counts(answers: pa.Table, gram: int, field: str) -> np.ndarray:
    found = sorted((p, x) for g, p, x in zip(answers["gram"].to_pylist(), answers["part"].to_pylist(), answers[field].to_pylist(), strict=True) if g == gram)
    return np.concatenate([_unpack(x, "<u8") for _, x in found]) if found else np.zeros(0, np.uint64)


def _bucket(contexts: list[np.ndarray]) -> np.ndarray:
    return np.minimum(np.floor(np.log2(contexts[-1] + 1)).astype(np.int8), BUCKETS - 1)


def _estimates(counts: list[np.ndarray], contexts: list[np.ndarray], distinct: float) -> tuple[np.ndarray, np.ndarray]:
    """The uniform and the maximum-likelihood probabilities (a row for each), and the bucket of each token."""
    p = [np.full(len(counts[0]), 1.0 / (distinct + 1))]
    for c, h in zip(counts, contexts, strict=True):
        p.append(np.divide(c, h, out=np.zeros(len(c)), where=h > 0))
    return np.stack(p), _bucket(contexts)


def expectation_maximisation(bucket: np.ndarray, ratios: np.ndarray, times: np.ndarray, rounds: int = 60, prior: float = 20.0) -> np.ndarray:
    """Mixture weights (BUCKETS x parts) from a histogram: ``ratios`` has each part's probability over the first one's.
    A bucket leans on the weights of all buckets together by ``prior`` tokens."""
    parts = ratios.shape[1] if ratios.ndim == 2 else 1

    def learn(start: np.ndarray, r: np.ndarray, n: np.ndarray, base: np.ndarray | None) -> np.ndarray:
        w = start
        for _ in range(rounds):
            joint = r * w
            post = (joint / joint.sum(1, keepdims=True) * n[:, None]).sum(0)
            w = post / post.sum() if base is None else (post + prior * base) / (n.sum() + prior)
        return w

    if not len(times):
        return np.tile(np.eye(parts)[0] if parts == 1 else np.full(parts, 1 / parts), (BUCKETS, 1))
    every = learn(np.full(parts, 1 / parts), ratios, times, None)
    every = (every + 1e-6) / (every + 1e-6).sum()
    out = []
    for b in range(BUCKETS):
        at = bucket == b
        out.append(learn(every, ratios[at], times[at], every) if at.any() else every)
    return np.array(out)


def _mixture(weights: np.ndarray, p: np.ndarray, contexts: list[np.ndarray], bucket: np.ndarray) -> np.ndarray:
    """The probability of each token.  Orders whose context was never seen are left out of the mixture.  One order at a
    time, so that few arrays of a chunk's length live together."""
    share = weights[bucket, 0]
    mixed = share * p[0]
    for k, h in enumerate(contexts, 1):
        w = np.where(h > 0, weights[bucket, k], 0.0)
        share += w
        mixed += w * p[k]
    return mixed / share


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = 2, chunk_bytes: int = 10 << 20, part_bytes: int = 12 << 20) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for each row of ``docs``.

    It learns from the rows whose crc32(id as text) mod 7 is not 2; of these, remainder 3 is deleted from the counts
    that EM sees, and back in the counts that score.  A null text is empty and has one token, the end.  Rows with a
    null id are learned from; repeated rows count each time; other columns are left out.  Without anything to learn
    from, every probability is uniform.
    """
    tune(docs.sparkSession)
    spark = docs.sparkSession
    chunks = _chunks(docs, id_col, text_col, chunk_bytes)
    n_chunks = chunks.count()
    folds = chunks.select(F.explode("ids").alias("id")).select(F.coalesce(F.crc32(F.col("id").cast("string").cast("binary")) % FOLDS, F.lit(-1)).alias("fold"))
    per_fold = {r["fold"]: r["count"] for r in folds.groupBy("fold").count().collect()}
    documents = float(sum(n for f, n in per_fold.items() if f != TEST_FOLD))
    left_documents = documents - per_fold.get(DELETED_FOLD, 0)

    # A part answers for as many n-grams as ``part_bytes`` of text have, whatever the chunks are.
    sizes = chunks.agg(F.sum(F.octet_length("blob"))).first()[0] or 0
    answers = _answers(chunks, order, max(32, math.ceil(3 * sizes / part_bytes)))
    sums = np.zeros(4)
    totals = answers.where("chunk = -1 and gram = 1").select(F.explode(F.sequence(F.lit(0), F.lit(3))).alias("k"), "every")
    little = F.reverse(F.substring(F.hex("every"), F.col("k") * 16 + 1, F.lit(16)))  # reversed nibbles of a little-endian number
    swapped = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(15), F.lit(2)), lambda i: F.reverse(F.substring(little, i, F.lit(2)))), "")
    for r in totals.groupBy("k").agg(F.sum(F.conv(swapped, 16, 10).cast("long")).alias("n")).collect():
        sums[r["k"]] = r["n"]
    n_all, v_all, n_left, v_left = sums.tolist()

    known = answers.where("chunk >= 0")

    def measure(key: tuple, rows: pa.Table, got: pa.Table) -> pa.Table:
        counted: dict[tuple, int] = {}
        tokens = Tokens()
        for blob, lengths in zip(rows["blob"].to_pylist(), rows["lengths"].to_pylist(), strict=True):
            found, starts = _chunk_tokens(blob, np.frombuffer(lengths, np.int64), tokens)
            counts = []
            for k, keys in enumerate(_grams(found, starts, order), 1):
                _, inverse = np.unique(keys, return_inverse=True)
                left = _counts(got, k, "every").astype(np.float64) - _counts(got, k, "deleted").astype(np.float64)
                counts.append(left[inverse])
            contexts = _contexts(counts, starts, left_documents, n_left)
            p, bucket = _estimates(counts, contexts, v_left)
            with np.errstate(divide="ignore"):
                bins = np.maximum(np.round(np.log2(p[1:] / p[0]) * BIN), -999).astype(np.int64)
            table = np.column_stack((bucket, *bins))
            kinds, n = np.unique(table, axis=0, return_counts=True)
            for row, times in zip(map(tuple, kinds.tolist()), n.tolist(), strict=True):
                counted[row] = counted.get(row, 0) + times
        columns = {"bucket": [r[0] for r in counted], "bins": [list(r[1:]) for r in counted], "times": list(counted.values())}
        return pa.Table.from_pydict(columns, schema=pa.schema([("bucket", pa.int64()), ("bins", pa.list_(pa.int64())), ("times", pa.int64())]))

    asked = chunks.where("deleted").select("chunk", "lengths", "blob")
    measured = asked.groupBy("chunk").cogroup(known.join(asked.select("chunk"), "chunk", "left_semi").groupBy("chunk")).applyInArrow(measure, "bucket bigint, bins array<bigint>, times bigint")
    histogram = measured.groupBy("bucket", "bins").agg(F.sum("times").alias("times")).collect() if n_left else []
    bins = np.array([r["bins"] for r in histogram], np.float64).reshape(len(histogram), order)
    ratios = np.column_stack((np.ones(len(bins)), np.where(bins <= -999, 0.0, 2.0 ** (bins / BIN))))
    weights = expectation_maximisation(np.array([r["bucket"] for r in histogram], np.int64), ratios, np.array([r["times"] for r in histogram], np.float64))

    def score(key: tuple, rows: pa.Table, got: pa.Table) -> pa.Table:
        tokens = Tokens()
        parts = []
        for ids, lengths, blob in zip(rows["ids"].to_pylist(), rows["lengths"].to_pylist(), rows["blob"].to_pylist(), strict=True):
            found, starts = _chunk_tokens(blob, np.frombuffer(lengths, np.int64), tokens)
            counts = [_counts(got, k, "every").astype(np.float64)[np.unique(keys, return_inverse=True)[1]] for k, keys in enumerate(_grams(found, starts, order), 1)]
            contexts = _contexts(counts, starts, documents, n_all)
            p, bucket = _estimates(counts, contexts, v_all)
            logs = np.log10(_mixture(weights, p, contexts, bucket))
            base = np.log10((counts[0] + 1) / (n_all + v_all + 1))
            first = starts[:-1]
            parts.append(
                pa.Table.from_arrays(
                    [
                        pa.array(ids, pa.int64()), pa.array([_fold(x) == TEST_FOLD for x in ids], pa.bool_()), pa.array(np.diff(starts)),
                        pa.array(np.add.reduceat((counts[0] > 0).astype(np.int64), first)), pa.array(np.full(len(ids), int(n_all))),
                        pa.array(np.add.reduceat(base, first)), pa.array(np.add.reduceat(logs, first)),
                    ],
                    ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )
            )
        return pa.concat_tables(parts)

    out = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    if not n_chunks:
        return spark.createDataFrame([], out)
    return chunks.select("chunk", "ids", "lengths", "blob").groupBy("chunk").cogroup(known.groupBy("chunk")).applyInArrow(score, out)
