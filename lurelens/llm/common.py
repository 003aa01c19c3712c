"""What the operators of this subpackage share: shared storage, materialised tables, Arrow helpers."""

from __future__ import annotations

import os
import posixpath
import sys
import uuid
from collections.abc import Iterable, Iterator
from types import ModuleType
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ARROW_BATCH_BYTES = 4 << 20


def tune(spark: SparkSession) -> None:
    """Bound the Arrow batches by bytes, as texts of very unequal length share a batch, and the printed plans that the driver
    keeps, as some hold a vocabulary."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BATCH_BYTES))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4096")
    spark.conf.set("spark.sql.maxPlanStringLength", "100000")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; where that is unset, a local one, if the master is local
    too, as in tests.  On a cluster a machine's own folder would lose files, so there it must be set."""
    given = spark.conf.get("spark.checkpoint.dir", None)
    if given:
        return given.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = "/tmp/checkpoints/lurelens"
    os.makedirs(own, exist_ok=True)
    spark.sparkContext.setCheckpointDir(own)
    return f"file://{own}"


def new_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def keep(df: DataFrame, what: str) -> DataFrame:
    """Write a table in the shared folder and read it again: lineage ends there, and lost executors cost nothing."""
    path = new_path(df.sparkSession, what)
    df.write.parquet(path)
    kept = df.sparkSession.read.schema(df.schema).parquet(path)
    kept.kept_path = path
    return kept


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``keep`` wrote, when nothing that is still to run reads them.  The driver lets go of finished
    plans then too: only after a collection of its garbage does Spark delete their shuffle files and broadcasts."""
    for kept in tables:
        spark = kept.sparkSession
        spark._jvm.System.gc()
        path = spark._jvm.org.apache.hadoop.fs.Path(kept.kept_path)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def grouped(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """(key, rows) for each run of rows that are equal in the first ``keys`` columns; a run may span batches."""
    now, held = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[:keys] != now:
                if held:
                    yield now, held
                now, held = row[:keys], []
            held.append(row[keys:])
    if held:
        yield now, held


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def filesystem(uri: str):
    """(pyarrow filesystem, path) of a URI in the shared storage; works in executors."""
    from pyarrow import fs

    parts = urlsplit(uri)
    if parts.scheme in ("", "file"):
        return fs.LocalFileSystem(), parts.path or uri
    return fs.FileSystem.from_uri(uri)


def put_file(uri: str, chunks: Iterable[bytes]) -> int:
    """Write a file under a name of its own and move it in place: a task that runs twice leaves one whole file."""
    store, path = filesystem(uri)
    store.create_dir(posixpath.dirname(path), recursive=True)
    part, size = f"{path}.{uuid.uuid4().hex}.part", 0
    with store.open_output_stream(part) as out:
        for chunk in chunks:
            out.write(chunk)
            size += len(chunk)
    store.move(part, path)
    return size


def in_fold(doc_id: str, folds: int, fold: int) -> Column:
    """crc32(doc_id as text) mod folds == fold; false for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds == fold, F.lit(False))


def texts(batches: Iterator[pa.RecordBatch], column: int = 1) -> Iterator[tuple[pa.Array, list[str]]]:
    """(first column, texts with null as empty) of each batch."""
    for batch in batches:
        if batch.num_rows:
            yield batch.column(0), [x or "" for x in batch.column(column).to_pylist()]


def worker_memory() -> dict:
    """A dict that the tasks of one Python worker share; functions that come with a task are new in each, and so are their
    globals.  What is kept there must be bounded, and must not change a result."""
    return vars(sys.modules.setdefault("_lurelens_worker", ModuleType("_lurelens_worker")))


class Memo(dict):
    """A dict that computes what it lacks and starts again when it holds ``most`` entries, so that its size is
    bounded whatever the vocabulary is."""

    def __init__(self, compute, most: int = 400_000, seed: dict | None = None):
        super().__init__(seed or {})
        self.compute, self.most, self.seed = compute, most + len(seed or {}), seed

    def __missing__(self, key):
        if len(self) >= self.most:
            self.clear()
            self.update(self.seed or {})
        value = self[key] = self.compute(key)
        return value
