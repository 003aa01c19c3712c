"""WARC archives with de-duplicated payloads, and their index by an external merge.

Captures are written to gzip'd WARC 1.1 files, a member for each record, with one locally sorted run of index rows for
each file.  The runs are cut at common boundaries of (URL key, time, id), so that each range of the index gets its
slice of every run; there a loser tree merges the slices.  The ranges in order are the capture histories of all URLs.
A hot URL is cut by time and id too, so no range grows with it.
"""

from __future__ import annotations

import base64
import hashlib
import math
import posixpath
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import filesystem, keep, tune

INDEX = "url_key string, captured_at string, page_id bigint, record_type string, digest string, file string, offset bigint, length bigint"
_RUN = f"{INDEX}, run string, place bigint"


def url_key(url: str | None) -> str:
    """Sort-friendly key: host labels reversed, port, then path and query, all lower case; "" without a URL."""
    if not url:
        return ""
    try:
        parts = urlsplit(url.strip().lower())
        host, port = parts.hostname or "", parts.port
    except ValueError:
        return ")" + url.strip().lower()
    labels = ",".join(reversed(re.sub(r"^www\d*\.", "", host).split(".")))
    return labels + (f":{port}" if port and port not in (80, 443) else "") + ")" + (parts.path or "/") + (f"?{parts.query}" if parts.query else "")


def record(page_id: int | None, url: str | None, captured_at: str, payload: bytes, digest: bytes, refers_to: int | None) -> bytes:
    """One WARC record: a response with its payload, or a revisit of the page ``refers_to`` without it."""
    name = lambda x: f"<urn:page:{'' if x is None else x}>"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {name(page_id)}", f"WARC-Date: {captured_at}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(digest).decode()}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}",
    ]
    if url:
        head.insert(4, f"WARC-Target-URI: {quote(url, safe=''.join(map(chr, range(0x21, 0x7F))))}")
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {name(refers_to)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """(WARC headers, HTTP headers, payload) of one record; header names in lower case."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    named = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    block = rest[: int(named["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return named, {k.lower(): v for k, _, v in (x.partition(": ") for x in http.decode().split("\r\n")[1:])}, payload


def _member(data: bytes) -> bytes:
    press = zlib.compressobj(6, zlib.DEFLATED, 31)
    return press.compress(data) + press.flush()


class LoserTree:
    """Merges sorted lists: each inner node keeps the loser of the match played there, so the next row costs one
    match on each level."""

    def __init__(self, runs: list[list]):
        self.runs, self.at, k = runs, [0] * len(runs), max(1, len(runs))
        self.k, self.losers = k, [-1] * k
        winners = [-1] * k + list(range(len(runs))) + [-1] * (k - len(runs))
        for node in range(k - 1, 0, -1):
            a, b = winners[2 * node], winners[2 * node + 1]
            winners[node], self.losers[node] = (a, b) if self._first(a, b) else (b, a)
        self.winner = winners[1] if k > 1 else winners[k]

    def _first(self, a: int, b: int) -> bool:
        if a < 0 or self.at[a] >= len(self.runs[a]):
            return False
        if b < 0 or self.at[b] >= len(self.runs[b]):
            return True
        x, y = self.runs[a][self.at[a]], self.runs[b][self.at[b]]
        return x < y or x == y and a < b

    def __iter__(self) -> Iterator[tuple[int, int]]:
        """(run, place in it) in the order of the rows; ties by run."""
        while self.winner >= 0 and self.at[self.winner] < len(self.runs[self.winner]):
            w = self.winner
            yield w, self.at[w]
            self.at[w] += 1
            node = (w + self.k) // 2
            while node:
                if self._first(self.losers[node], w):
                    w, self.losers[node] = self.losers[node], w
                node //= 2
            self.winner = w


def deduplicated(captures: DataFrame, least_bytes: int) -> DataFrame:
    """``captures`` (page_id, url, captured_at, html) with refers_to: the largest page_id among equal payloads of at
    least ``least_bytes``, where that is another page; else null."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = captures.withColumn("digest", F.sha1(payload))
    owners = rows.where(F.octet_length(payload) >= least_bytes).groupBy("digest").agg(F.max("page_id").alias("owner"), F.count("*").alias("n"))
    owners = keep(owners.where("n > 1 and owner is not null").select("digest", "owner"), "payload-owners")
    joined = rows.join(owners, "digest", "left")
    return joined.select("page_id", "url", "captured_at", "html", F.when(F.col("owner") != F.coalesce("page_id", F.col("owner")), F.col("owner")).alias("refers_to"))


def write_archives(captures: DataFrame, folder: str, least_bytes: int = 1000, file_bytes: int = 64 << 20) -> DataFrame:
    """Write a record for each row of ``captures`` (page_id bigint, url, captured_at as an ISO string, html) and return
    the locally sorted index runs, one for each file.

    A null html is an empty payload; payloads under ``least_bytes`` are never revisits.  A null page_id is a response
    always.  Rows that repeat the largest id of their payload are all responses.  A null url gives a record without a
    target and the key "".  Other columns are left out.  A file is closed beyond ``file_bytes``.
    """
    tune(captures.sparkSession)
    chosen = captures.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("captured_at", F.lit("1970-01-01T00:00:00Z")).alias("captured_at"), "html")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The attempt is in the names: one that runs again leaves the files alone to which the index may point.
        part, seq, out, run = TaskContext.get().partitionId(), 0, None, []
        attempt = TaskContext.get().taskAttemptId()

        def open_file():
            path = f"{folder}/captures-{part:06d}-{seq:06d}-{attempt}.warc.gz"
            store, local = filesystem(path)
            store.create_dir(posixpath.dirname(local), recursive=True)
            own = f"{local}.{uuid.uuid4().hex}.part"
            return path, store, local, own, store.open_output_stream(own)

        def close() -> pa.RecordBatch:
            path, store, local, own, stream = out
            stream.close()
            store.move(own, local)
            run.sort(key=lambda r: (r[0], r[1], -1 if r[2] is None else r[2]))
            columns = list(zip(*run, strict=True))
            kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()]
            found = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
            n = len(run)
            return pa.RecordBatch.from_arrays(
                [*found[:5], pa.array([path] * n), *found[5:], pa.array([posixpath.basename(path)] * n), pa.array(range(n), pa.int64())],
                ["url_key", "captured_at", "page_id", "record_type", "digest", "file", "offset", "length", "run", "place"],
            )

        offset = 0
        for batch in batches:
            for page_id, url, at, html, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                payload = (html or "").encode()
                digest = hashlib.sha1(payload).digest()
                member = _member(record(page_id, url, at, payload, digest, refers_to))
                if out is None:
                    out, offset = open_file(), 0
                out[-1].write(member)
                run.append((url_key(url), at, page_id, "response" if refers_to is None else "revisit", digest.hex(), offset, len(member)))
                offset += len(member)
                if offset >= file_bytes:
                    yield close()
                    seq, out, run = seq + 1, None, []
        if out is not None:
            yield close()

    return keep(deduplicated(chosen, least_bytes).mapInArrow(write, _RUN), "index-runs")


def merge_index(runs: DataFrame, range_rows: int = 50_000) -> DataFrame:
    """The index rows of all runs in the order of (url_key, captured_at, page_id), with ``position`` (range and place in
    it) by which they are in order; equal rows go by run.  Written in the shared folder."""
    ranges = max(1, math.ceil(runs.count() / range_rows))
    cut = runs.repartitionByRange(ranges, "url_key", "captured_at", "page_id").sortWithinPartitions("run", "place")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not held:
            return
        rows = pa.Table.from_batches(held)
        keys = list(zip(rows["url_key"].to_pylist(), rows["captured_at"].to_pylist(), (-1 if x is None else x for x in rows["page_id"].to_pylist()), strict=True))
        slices: list[tuple[int, list]] = []
        names = rows["run"].to_pylist()
        begin = 0
        for i in range(1, len(names) + 1):
            if i == len(names) or names[i] != names[begin]:
                slices.append((begin, keys[begin:i]))
                begin = i
        order = [slices[r][0] + at for r, at in LoserTree([s for _, s in slices])]
        first = TaskContext.get().partitionId() << 32
        merged = rows.take(pa.array(order)).select(["url_key", "captured_at", "page_id", "record_type", "digest", "file", "offset", "length"])
        yield from merged.append_column("position", pa.array(range(first, first + len(order)), pa.int64())).combine_chunks().to_batches(max_chunksize=10_000)

    return keep(cut.mapInArrow(merge, f"{INDEX}, position bigint"), "index")


def read_archives(index: DataFrame) -> DataFrame:
    """One row for each capture of the index, read from its archive: page_id, url, captured_at, record_type,
    payload_bytes and payload_digest (both of the full payload), refers_to, payload (null for a revisit).  A record
    whose payload does not have the digest it states fails."""
    # As many tasks as archives: the index is small, the archives are not.
    files = index.agg(F.count_distinct("file")).first()[0]
    places = index.select("file", "offset", "length").repartition(min(max(files, 1), 20_000), "file").sortWithinPartitions("file", "offset")

    def number(name: str) -> int | None:
        found = re.fullmatch(r"<urn:page:(-?\d*)>", name)
        return int(found[1]) if found and found[1] else None

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, stream = None, None
        for batch in batches:
            rows = []
            for file, offset, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if file != path:
                    if stream:
                        stream.close()
                    store, local = filesystem(file)
                    path, stream = file, store.open_input_file(local)
                named, http, payload = parse(zlib.decompress(stream.read_at(length, offset), 31))
                stated = base64.b32decode(named["warc-payload-digest"].removeprefix("sha1:")).hex()
                revisit = named["warc-type"] == "revisit"
                if not revisit and hashlib.sha1(payload).hexdigest() != stated:
                    raise ValueError(f"{file}, {offset}: the payload has another digest")
                rows.append((number(named["warc-record-id"]), named.get("warc-target-uri"), named["warc-date"], named["warc-type"], int(http["content-length"]), stated, number(named["warc-refers-to"]) if revisit else None, None if revisit else payload))
            if rows:
                kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["page_id", "url", "captured_at", "record_type", "payload_bytes", "payload_digest", "refers_to", "payload"])

    return places.mapInArrow(read, "page_id bigint, url string, captured_at string, record_type string, payload_bytes bigint, payload_digest string, refers_to bigint, payload binary")


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, CAST(strlen(coalesce(html, '')) AS BIGINT) AS n FROM pages),
d AS (SELECT page_id, n, sha1(html) AS h FROM p),
m AS (SELECT h, max(page_id) AS owner FROM d WHERE n >= 1000 GROUP BY h)
SELECT page_id, n AS payload_bytes, d.h AS payload_digest, CASE WHEN owner IS NULL OR owner = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN owner <> page_id THEN owner END AS refers_to
FROM d LEFT JOIN m ON d.h = m.h AND d.n >= 1000
"""
