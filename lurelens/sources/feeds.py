"""Live feeds: lists of URLs that are downloaded by a task, not by the driver, and stream into rows."""

from __future__ import annotations

import csv
import io
import urllib.request
from collections.abc import Callable, Iterator
from itertools import batched
from typing import IO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AGENT = "Mozilla/5.0"
Open = Callable[[str], IO[bytes]]


def open_address(address: str, timeout: float = 40.0) -> IO[bytes]:
    return urllib.request.urlopen(urllib.request.Request(address, headers={"User-Agent": AGENT}), timeout=timeout)


def keyed_addresses(key: str, keyed: str, *others: str) -> list[str]:
    """The address with a key in place of ``{key}``, where there is a key, before those without."""
    return [*([keyed.format(key=key.strip())] if key.strip() else []), *others]


def read_live_feed(spark: SparkSession, addresses: list[str], column: str = "", opened: Open = open_address) -> DataFrame:
    """(url) of the first address that can be read: its lines, or ``column`` of its CSV; blank values and, of lines, comments
    are left out.  If none can be read, the job fails with the last error.

    An address that breaks off after its first rows is an error too: half a feed is no feed.
    """

    def rows(address: str) -> Iterator[str]:
        with opened(address) as raw:
            text = io.TextIOWrapper(raw, encoding="utf-8", errors="replace", newline="")
            if not column:
                yield from (x for x in map(str.strip, text) if x and not x.startswith("#"))
                return
            table = csv.DictReader(text)
            if column not in (table.fieldnames or ()):
                raise KeyError(column)
            yield from (x.strip() for x in (r[column] for r in table) if x and x.strip())

    def download(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for wanted in batch.column(0).to_pylist():
                last = "no address"
                for address in wanted:
                    begun = False
                    try:
                        for some in batched(rows(address), 4096):
                            begun = True
                            yield pa.RecordBatch.from_pydict({"url": pa.array(some, pa.string())})
                        break
                    except (OSError, KeyError, csv.Error) as error:
                        if begun:
                            raise
                        last = f"{address}: {type(error).__name__}"
                else:
                    raise RuntimeError(f"the feed could not be read; {last}")

    return spark.range(1).select(F.array(*map(F.lit, addresses)).cast("array<string>").alias("addresses")).mapInArrow(download, "url string")
