"""Evidence that is kept: the store is read first, only what it lacks is asked for, and the answers are added."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import keep


@dataclass
class Served:
    """Evidence of all keys that have any, and how it came."""

    table: DataFrame
    keys: int = 0  #: distinct keys that were wanted
    hits: int = 0  #: of these, the ones in the store
    asked: int = 0  #: the ones that were asked for
    failed: int = 0  #: of these, the ones whose answer is an error


class EvidenceStore:
    """A folder of Parquet tables, one for each kind of evidence, to which jobs only add.

    A row has the day it was stored; of several rows of a key the last day's counts (the least by its columns, if a day
    has several).  Answers with the status "error" are not kept, so they are asked for again.
    """

    def __init__(self, spark: SparkSession, folder: str, day: str):
        self.spark, self.folder, self.day = spark, folder.rstrip("/"), day

    def path(self, kind: str) -> str:
        return f"{self.folder}/{kind}"

    def read(self, kind: str, key: str, schema: str, days: int | None = None) -> DataFrame:
        """One row for each key of a kind, not older than ``days``."""
        columns = self.spark.createDataFrame([], schema).columns
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(kind))
        if not path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).exists(path):
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(f"{schema}, stored_on date").parquet(self.path(kind))
        if days is not None:
            rows = rows.where(F.datediff(F.to_date(F.lit(self.day)), "stored_on") <= days)
        rest = [c for c in columns if c != key]
        last = rows.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct("stored_on", F.xxhash64(*(F.to_json(F.struct(c)) for c in rest)))).alias("_v"))
        return last.select(*(F.col(key) if c == key else F.col(f"_v.{c}").alias(c) for c in columns))

    def serve(self, keys: DataFrame, kind: str, key: str, schema: str, ask: Callable[[DataFrame], DataFrame], days: int | None = None) -> Served:
        """Evidence of the distinct non-empty keys: an equi-join with the store, and the answers to the others, which are asked
        for once, written, and then both kept and given back."""
        wanted = keep(keys.select(F.col(key)).where(F.coalesce(F.col(key), F.lit("")) != "").distinct(), "wanted")
        known = keep(self.read(kind, key, schema, days).join(wanted, key, "left_semi"), "hits")
        lacking = keep(wanted.join(known.select(key), key, "left_anti"), "lacking")
        served = Served(known, wanted.count(), known.count(), lacking.count())
        if served.asked:
            answers = keep(ask(lacking).select(*known.columns), "answers")
            good = F.coalesce(F.col("status") != "error", F.lit(True)) if "status" in known.columns else F.lit(True)
            answers.where(good).withColumn("stored_on", F.to_date(F.lit(self.day))).write.mode("append").parquet(self.path(kind))
            served.failed = answers.where(~good).count()
            served.table = known.unionByName(answers)
        return served
