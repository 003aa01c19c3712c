"""Token-ID output in directly addressable codes.

File format (all little-endian).  A file holds the ids of consecutive documents:

    bytes  content
    8      magic ``LLDAC001``
    4      format version 1
    4      chunk bits (8)
    8      number of documents D
    8      number of ids N
    4      number of levels L
    4      number Z of documents without an id, which come first
    8*D    document ids (int64; 0 where there is none)
    8*(D+1) offsets of the documents' first ids, then N (int64)
    then for each level: 8 bytes count M; M chunks (uint8), padded to 8 bytes; ceil(M/8) bytes of continuation
    bitmap, padded to 8 bytes; rank directory: for each run of 512 chunks the ones before it (uint32), padded.

An id is split into chunks of 8 bits, the least first.  The chunk of level 0 of id i is at i; its continuation bit
tells whether the id goes on, at level 1 at the rank of that bit.  So any id is read with one look per level, by
the rank directory and at most 64 bitmap bytes, and nothing else is decoded.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import filesystem, new_path, put_file, tune
from .tokcount import id_encoder

MAGIC, CHUNK_BITS, RUN = b"LLDAC001", 8, 512
HEADER = "<8sIIqqII"


def _padded(data: bytes) -> bytes:
    return data + b"\0" * (-len(data) % 8)


def pack(doc_ids: np.ndarray, offsets: np.ndarray, ids: np.ndarray, nulls: int = 0) -> Iterator[bytes]:
    """The bytes of a file; the first ``nulls`` documents have no id."""
    levels = []
    rest = ids.astype(np.uint32)
    while len(rest) or not levels:
        goes_on = rest > 0xFF
        bits = np.packbits(goes_on, bitorder="little").tobytes()
        ones = np.add.reduceat(goes_on, np.arange(0, len(rest), RUN), dtype=np.uint32) if len(rest) else np.zeros(0, np.uint32)
        ranks = np.concatenate((np.zeros(1, np.uint32), np.cumsum(ones)[:-1].astype(np.uint32))) if len(ones) else ones
        levels.append((len(rest), (rest & 0xFF).astype(np.uint8).tobytes(), bits, ranks.astype("<u4").tobytes()))
        rest = rest[goes_on] >> CHUNK_BITS
    yield struct.pack(HEADER, MAGIC, 1, CHUNK_BITS, len(doc_ids), len(ids), len(levels), nulls)
    yield doc_ids.astype("<i8").tobytes()
    yield offsets.astype("<i8").tobytes()
    for n, chunks, bits, ranks in levels:
        yield struct.pack("<q", n)
        yield _padded(chunks)
        yield _padded(bits)
        yield _padded(ranks)


class DacFile:
    """Reads the bytes of a file (``bytes``, or a memory map) without decoding it."""

    def __init__(self, data):
        magic, version, bits, docs, self.n, levels, self.nulls = struct.unpack_from(HEADER, data)
        if (magic, version, bits) != (MAGIC, 1, CHUNK_BITS):
            raise ValueError("not a file of directly addressable codes")
        at = struct.calcsize(HEADER)

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal at
            found = np.frombuffer(data, kind, count, at)
            at += found.nbytes + -found.nbytes % 8
            return found

        self.doc_ids, self.offsets, self.levels = take("<i8", docs), take("<i8", docs + 1), []
        for _ in range(levels):
            n = int(take("<i8", 1)[0])
            self.levels.append((take("u1", n), take("u1", -(-n // 8)), take("<u4", -(-n // RUN))))

    def get(self, i: int) -> int:
        """The id at place i."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = shift = 0
        for chunks, bits, ranks in self.levels:
            value |= int(chunks[i]) << shift
            if not bits[i >> 3] >> (i & 7) & 1:
                break
            run = i // RUN
            before = np.unpackbits(bits[run * RUN // 8 : (i >> 3) + 1], bitorder="little")[: i - run * RUN]
            i, shift = int(ranks[run]) + int(before.sum()), shift + CHUNK_BITS
        return value

    def ids(self, start: int = 0, stop: int | None = None) -> np.ndarray:
        """The ids from start to stop (all), as uint32."""
        return self._level(0, start, self.n if stop is None else stop)

    def _level(self, level: int, start: int, stop: int) -> np.ndarray:
        chunks, bits, ranks = self.levels[level]
        value = chunks[start:stop].astype(np.uint32)
        first = start // RUN * RUN
        on = np.unpackbits(bits[first // 8 : -(-stop // 8)], bitorder="little")
        goes_on = on[start - first : stop - first].astype(bool)
        if goes_on.any():
            begin = int(ranks[start // RUN]) + int(on[: start - first].sum())
            value[goes_on] |= self._level(level + 1, begin, begin + int(goes_on.sum())) << CHUNK_BITS
        return value

    def document(self, k: int) -> np.ndarray:
        """The ids of the k-th document of the file."""
        return self.ids(int(self.offsets[k]), int(self.offsets[k + 1]))


def write_ids(docs: DataFrame, tokenizer_path: str, folder: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2, file_ids: int = 4 << 20) -> DataFrame:
    """Encode the documents, append ``end_id`` to each, and write the ids in ascending order of ``id_col``.

    Returns the table of files, one row each: part, seq, path, n_docs, n_ids; (part, seq) is the order of the
    files.  A file holds at most ``file_ids`` ids, or one document.  A null text is empty (only the end id);
    documents with equal ids stand together in any order; those with a null id come before all others.  The table is
    written beside the files, so that it never has to be made twice.
    """
    spark = docs.sparkSession
    tune(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    placed = rows.repartitionByRange("id").sortWithinPartitions("id").withColumn("part", F.spark_partition_id())

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = id_encoder(tokenizer_path)
        end = np.array([end_id], np.uint32)
        keys: list[int | None] = []
        runs: list[np.ndarray] = []
        held, part, seq = 0, 0, 0
        attempt = TaskContext.get().taskAttemptId()  # one that runs again leaves the files of another alone

        def flush() -> pa.RecordBatch:
            offsets = np.concatenate(([0], np.cumsum([len(x) for x in runs])))
            path = f"{folder}/ids-{part:06d}-{seq:06d}-{attempt}.dac"
            put_file(path, pack(np.array([k or 0 for k in keys], np.int64), offsets, np.concatenate(runs), keys.count(None)))
            return pa.RecordBatch.from_pydict({"part": [part], "seq": [seq], "path": [path], "n_docs": [len(keys)], "n_ids": [held]})

        for batch in batches:
            for key, text, part in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                ids = np.concatenate((encode(text or ""), end))
                if keys and held + len(ids) > file_ids:
                    yield flush()
                    keys, runs, held, seq = [], [], 0, seq + 1
                keys.append(key)
                runs.append(ids)
                held += len(ids)
        if keys:
            yield flush()

    files = placed.mapInArrow(write, "part bigint, seq bigint, path string, n_docs bigint, n_ids bigint")
    files.write.parquet(f"{folder}/files.parquet")
    return spark.read.schema(files.schema).parquet(f"{folder}/files.parquet")


def read_ids(files: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids array<bigint> of every document in the files."""
    return _read(files, "ids array<bigint>", lambda file, k: file.document(k).astype(np.int64), pa.list_(pa.int64()))


def read_checks(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32, the CRC-32 of the ids as little-endian uint32, from the files."""
    return _read(files, "ids_crc32 bigint", lambda file, k: zlib.crc32(file.document(k).astype("<u4").tobytes()), pa.int64())


def _read(files: DataFrame, field: str, value, kind: pa.DataType) -> DataFrame:
    # One total for each partition comes to the driver; the places of the files within it are summed in a window.
    totals = sorted((r["part"], r["n"], r["files"]) for r in files.groupBy("part").agg(F.sum("n_ids").alias("n"), F.count("*").alias("files")).collect())
    starts, done = [], 0
    for part, n, _ in totals:
        starts.append((part, done))
        done += n
    spark = files.sparkSession
    before = spark.createDataFrame(starts, "part bigint, part_start bigint")
    from pyspark.sql import Window

    within = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    placed = files.withColumn("file_start", F.coalesce(F.sum("n_ids").over(within), F.lit(0))).join(before, "part")
    placed = placed.select("path", (F.col("part_start") + F.col("file_start")).alias("start")).repartition(min(max(sum(f for _, _, f in totals), 1), 20_000), "path")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                store, local = filesystem(path)
                with store.open_input_stream(local) as data:
                    file = DacFile(data.read())
                for a in range(0, len(file.doc_ids), 1024):
                    ks = range(a, min(a + 1024, len(file.doc_ids)))
                    cut = slice(a, ks.stop)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(file.doc_ids[cut], mask=np.arange(a, ks.stop) < file.nulls),
                            pa.array(file.offsets[cut] + start),
                            pa.array(np.diff(file.offsets[a : ks.stop + 1])),
                            pa.array([value(file, k) for k in ks], kind),
                        ],
                        ["doc_id", "start", "n_tokens", field.split(" ")[0]],
                    )

    return placed.mapInArrow(read, f"doc_id bigint, start bigint, n_tokens bigint, {field}")


def new_folder(spark) -> str:
    return new_path(spark, "token-ids")
