"""Tables that cut lineage, in the folder that all executors share."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession


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


def delete(*tables: DataFrame) -> None:
    """Delete tables that ``keep`` wrote, when nothing that is still to run reads them."""
    for kept in tables:
        delete_path(kept.sparkSession, kept.kept_path)


def delete_path(spark: SparkSession, uri: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def read_batches(uri: str, columns: list[str], rows: int) -> Iterator[pa.RecordBatch]:
    """The rows of a table that ``keep`` wrote, file by file, ``rows`` at most in a batch; works in executors."""
    parts = urlsplit(uri)
    store, path = (fs.LocalFileSystem(), parts.path or uri) if parts.scheme in ("", "file") else fs.FileSystem.from_uri(uri)
    for info in sorted(store.get_file_info(fs.FileSelector(path)), key=lambda i: i.path):
        if info.path.endswith(".parquet"):
            with store.open_input_file(info.path) as file:
                yield from pq.ParquetFile(file).iter_batches(rows, columns=columns)
