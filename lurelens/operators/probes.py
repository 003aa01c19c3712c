"""Probers: they fill evidence tables by asking the network, each distinct key once.

A prober is any function of one key that returns a dict of the table's columns; what it raises becomes the row's error.
Each partition asks with a bounded number of threads, so the load on the network is partitions x threads.  Tests use
functions that know the answers.
"""

from __future__ import annotations

import socket
import ssl
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from datetime import date, datetime, timezone
from email.utils import parsedate_to_datetime

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import text as T
from .hosts import registered_domains


def probe(keys: DataFrame, key: str, schema: str, ask: Callable[[str], dict], error_col: str, partitions: int = 32, threads: int = 8, tries: int = 1, wait: float = 0.2) -> DataFrame:
    """The evidence table of the distinct non-empty keys.  A key that fails ``tries`` times has the error's name and the
    status "error"; columns that an answer lacks are null."""
    fields = [f.name for f in StructType.fromDDL(schema).fields]

    def one(value: str) -> dict:
        for attempt in range(tries):
            try:
                return {key: value, **ask(value)}
            except Exception as error:  # whatever a probe meets is evidence, not a failure of the job
                failed = {key: value, error_col: type(error).__name__, "status": "error"}
                if attempt + 1 < tries:
                    time.sleep(wait * (attempt + 1))
        return failed

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(threads) as pool:
            for part in parts:
                rows = [[answer.get(f) for f in fields] for answer in pool.map(one, part[key])]
                yield pd.DataFrame(rows, columns=fields, dtype="object")  # a column of nulls alone would count as numbers

    distinct = keys.select(F.col(key)).where(F.coalesce(F.col(key), F.lit("")) != "").distinct().repartition(partitions, key)
    return distinct.mapInPandas(run, schema)


def ipv4(host: str) -> dict:
    """DNS evidence of the system's resolver."""
    ip = socket.gethostbyname(host)
    return {"dns_check_pass": 1, "dns_resolves_to_ip": 1, "resolved_ips": ip, "cname_exists": 0, "cname_chain_length": 0, "dns_error": "", "status": "success"}


def tls(host: str, observed: date | None = None, timeout: float = 5.0) -> dict:
    """TLS evidence of port 443; a certificate that does not verify is evidence too."""
    try:
        with socket.create_connection((host, 443), timeout=timeout) as raw, ssl.create_default_context().wrap_socket(raw, server_hostname=host) as secure:
            begins = secure.getpeercert().get("notBefore")
    except ssl.SSLError as error:
        return {"https_enabled": 1, "ssl_valid": 0, "cert_age_days": -1, "ct_log_first_seen_days": -1, "tls_error": type(error).__name__, "status": "invalid"}
    today = observed or datetime.now(timezone.utc).date()
    age = max((today - parsedate_to_datetime(begins).date()).days, 0) if begins else -1
    return {"https_enabled": 1, "ssl_valid": 1, "cert_age_days": age, "ct_log_first_seen_days": -1, "tls_error": "", "status": "success"}


AGENT = {"User-Agent": "Mozilla/5.0"}
MOST_IMAGE_BYTES = 128_000


class _Stay(urllib.request.HTTPRedirectHandler):
    """Redirects are answers, not followed."""

    def redirect_request(self, *_):
        return None


def _open(url: str, timeout: float, follow: bool, **headers: str):
    """A response of any status; certificates are not judged here, as they are evidence of another probe."""
    context = ssl.create_default_context()
    context.check_hostname, context.verify_mode = False, ssl.CERT_NONE
    handlers = [urllib.request.HTTPSHandler(context=context), *([] if follow else [_Stay()])]
    try:
        return urllib.request.build_opener(*handlers).open(urllib.request.Request(url, headers=AGENT | headers), timeout=timeout)
    except urllib.error.HTTPError as answer:
        return answer


def hop(url: str, timeout: float = 10.0) -> dict:
    """One request, not followed: a row of ``chains.HOP``."""
    with _open(url, timeout, False) as answer:
        body, kind = answer.read(), answer.headers
        text = body.decode(kind.get_content_charset() or "utf-8", "replace")
        return {"location": kind.get("Location") or "", "status_code": answer.status, "html": text, "content_type": kind.get("Content-Type") or "", "error": ""}


def image(url: str, timeout: float = 5.0, most: int = MOST_IMAGE_BYTES) -> dict:
    """The first ``most`` bytes of an image; none for a status other than 200."""
    with _open(url, timeout, True) as answer:
        return {"data": answer.read(most) if answer.status == 200 else b""}


def registry(server: str, domain: str, timeout: float = 10.0) -> tuple[int, str]:
    """Status and body of a registry's RDAP service, as ``cascade.ask_registries`` wants them."""
    with _open(f"{server}/domain/{domain}", timeout, True, Accept="application/rdap+json") as answer:
        return answer.status, answer.read().decode("utf-8", "replace")


def follow_aliases(host: str, alias_of: Callable[[str], str | None], most: int = 10) -> list[str]:
    """The chain of aliases from a host; it ends at a loop, or after ``most``."""
    chain: list[str] = []
    while len(chain) < most:
        nxt = alias_of(chain[-1] if chain else host)
        nxt = (nxt or "").strip(".").lower()
        if not nxt or nxt in chain:
            break
        chain.append(nxt)
    return chain


def merged_dns(rows: DataFrame, answers: DataFrame) -> DataFrame:
    """DNS evidence from answers (host, ips array, aliases array, errors array; socket_failed, if it is there) and what the
    rows' own columns hosting_ip and dns_records say: their addresses count, and a record text counts its CNAMEs.  Where
    even the system's resolver failed and the row says neither, there is no evidence but the errors."""
    host = T.hostname("detected_domain")
    own = rows.select(host.alias("host"), T.ip_set(F.col("hosting_ip"), F.col("dns_records")).alias("own"), F.lower(T.clean("dns_records")).alias("records"))
    own = own.groupBy("host").agg(F.array_distinct(F.flatten(F.collect_set("own"))).alias("own"), F.max("records").alias("records"))
    empty = F.array().cast("array<string>")
    both = own.join(answers if "socket_failed" in answers.columns else answers.withColumn("socket_failed", F.lit(False)), "host", "left")
    dead = F.coalesce("socket_failed", F.lit(False)) & (F.size("own") == 0) & ~F.col("records").contains("cname")
    ips = F.array_sort(F.array_union("own", F.coalesce("ips", empty)))
    count = F.when(dead, 0).otherwise(F.greatest(F.size(F.array_distinct(F.coalesce("aliases", empty))), T.count_of(F.col("records"), "cname")))
    found = ~dead & ((F.size(ips) > 0) | (count > 0) | (F.col("records") != ""))
    return both.select(
        "host", found.cast("int").alias("dns_check_pass"), (F.size(ips) > 0).cast("int").alias("dns_resolves_to_ip"), F.array_join(ips, ";").alias("resolved_ips"),
        (count > 0).cast("int").alias("cname_exists"), count.alias("cname_chain_length"), F.array_join(F.coalesce("errors", empty), ";").alias("dns_error"),
        F.when(found, "success").when(F.size(F.coalesce("errors", empty)) > 0, "error").otherwise("not_found").alias("status"),
    )


def http_answers(fetched: DataFrame, suffixes: T.Suffixes | DataFrame) -> DataFrame:
    """HTTP evidence from fetches (url, html, chain array of URLs, status_code, content_type, error): a fetch succeeds with a
    2xx or 3xx status and a body that is not blank; redirects across registered domains are counted along the chain."""
    fetched, domains = registered_domains(fetched, "chain", "_domains", suffixes), F.col("_domains")
    changes = F.size(F.filter(F.sequence(F.lit(1), F.size("chain")), lambda i: (i > 1) & (F.get(domains, i - 2) != "") & (F.get(domains, i - 1) != "") & (F.get(domains, i - 1) != F.get(domains, i - 2))))
    fine = F.col("status_code").between(200, 399) & (T.strip(F.coalesce("html", F.lit(""))) != "")
    return fetched.select(
        "url", F.coalesce("html", F.lit("")).alias("html"), F.coalesce(F.get("chain", F.size("chain") - 1), F.col("url")).alias("final_url"), F.coalesce("status_code", F.lit(0)).alias("status_code"),
        F.coalesce(fine, F.lit(False)).cast("int").alias("fetch_success"), F.greatest(F.size("chain") - 1, F.lit(0)).alias("redirect_count"), F.when(F.size("chain") > 1, changes).otherwise(0).alias("redirect_cross_domain_count"),
        F.coalesce("content_type", F.lit("")).alias("content_type"), F.coalesce("error", F.lit("")).alias("error"),
        F.when(F.coalesce("error", F.lit("")) != "", "error").when(fine, "success").otherwise(F.concat(F.lit("http_"), F.coalesce("status_code", F.lit(0)).cast("string"))).alias("status"),
    )


def permutations(brands: DataFrame, generate: Callable[[str], str], partitions: int = 32, threads: int = 1) -> DataFrame:
    """(brand, host) from a generator that gives the JSON text of a domain's permutations."""
    from ..sources.readers import permutations_from

    asked = probe(brands.select(F.col("domain").alias("brand")), "brand", "brand string, json string, error string, status string", lambda d: {"json": generate(d), "error": "", "status": "success"}, "error", partitions, threads)
    return permutations_from(asked.where("status = 'success'"))
