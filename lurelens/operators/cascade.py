"""Registrations by a cascade of services: the registry's own service first, the fallback only for what it did not give.

Domains are placed by the service that answers for them, so that a service is asked from one task, at one pace, whatever
the cluster's size.  A service that may be asked faster gets several lanes.  Clients are functions of a domain, so tests
inject answers and count calls.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import registry as R
from ..storage import keep
from .evidence import REGISTRATION
from .hosts import suffix_lengths

#: What a client of a registry's service gives: the HTTP status and the body; it raises what it cannot do.
Client = Callable[[str, str], tuple[int, str]]
#: What a client of the fallback gives: any of the columns of REGISTRATION.
Fallback = Callable[[str], dict]
TRY_AGAIN = (429, 500, 502, 503, 504)


def services(domains: DataFrame, bootstrap: DataFrame, rules: DataFrame) -> DataFrame:
    """(registered_domain, server): the service of the public suffix, else of its last label, else null."""
    lengths = suffix_lengths(domains, rules, "registered_domain").withColumnRenamed("host", "registered_domain")
    labels, n = F.split("registered_domain", r"\."), F.col("suffix_labels")
    keyed = lengths.select("registered_domain", F.when(n > 0, F.array_join(F.slice(labels, -n, n), ".")).alias("suffix"), F.when(n > 1, F.element_at(labels, -1)).alias("last"))
    one = bootstrap.groupBy("tld").agg(F.min("server").alias("server"))
    named = lambda c: one.select(F.col("tld").alias(c), F.col("server").alias(f"{c}_server"))
    return keyed.join(named("suffix"), "suffix", "left").join(named("last"), "last", "left").select("registered_domain", F.coalesce("suffix_server", "last_server").alias("server"))


def ask_registries(placed: DataFrame, client: Client, lanes: int = 1, pause: float = 0.0, retries: int = 2, backoff: float = 0.5) -> DataFrame:
    """(registered_domain, http_status, answer, error) of domains with a server.

    404 is an answer; 429 and server errors are tried again after a pause that doubles, ``retries`` times; any other
    status, and what the client raises in the end, is an error.
    """

    def one(server: str, domain: str) -> tuple[int | None, str, str]:
        status, body, error = None, "", ""
        for attempt in range(retries + 1):
            try:
                status, body = client(server, domain)
                error = "" if status == 200 else f"RDAP HTTP {status}" if status != 404 else "RDAP 404"
                if status not in TRY_AGAIN:
                    break
            except TimeoutError:
                status, error = None, "RDAP timeout"
            except Exception as raised:  # what a service does is evidence, not a failure of the job
                status, error = None, f"RDAP client error: {type(raised).__name__}"
            if attempt < retries:
                time.sleep(backoff * 2**attempt)
        return status, body if status == 200 else "", error

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for server, domain in zip(part["server"], part["registered_domain"], strict=True):
                rows.append((domain, *one(server, domain)))
                time.sleep(pause)
            yield pd.DataFrame(rows, columns=["registered_domain", "http_status", "answer", "error"]).astype({"http_status": "Int32"})

    lane = F.pmod(F.xxhash64("registered_domain"), F.lit(lanes))
    asked = placed.where("server is not null").withColumn("lane", lane).repartition("server", "lane").sortWithinPartitions("server", "registered_domain")
    return asked.select("server", "registered_domain").mapInPandas(run, "registered_domain string, http_status int, answer string, error string")


def ask_fallback(domains: DataFrame, fallback: Fallback, tasks: int = 2, pause: float = 0.5) -> DataFrame:
    """REGISTRATION rows of the fallback service, which few tasks ask, slowly."""
    fields = ["registered_domain", "creation_date", "expiration_date", "registrant_name", "registrar_name", "nameservers", "error", "whois_status"]

    def one(domain: str) -> dict:
        try:
            return {"error": "", "whois_status": "success"} | fallback(domain)
        except TimeoutError:
            return {"error": "WHOIS timeout", "whois_status": "timeout"}
        except Exception as raised:
            return {"error": str(raised) or type(raised).__name__, "whois_status": "error"}

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for domain in part["registered_domain"]:
                rows.append(one(domain) | {"registered_domain": domain})
                time.sleep(pause)
            out = pd.DataFrame(rows, columns=fields)
            for c in ("creation_date", "expiration_date"):
                out[c] = pd.to_datetime(out[c])
            for c in ("registrant_name", "registrar_name"):
                out[c] = out[c].fillna("")
            out["nameservers"] = [sorted({n.strip(".").lower() for n in ([x] if isinstance(x, str) else x) if n}) if isinstance(x, (list, tuple, str)) else [] for x in out["nameservers"]]
            yield out

    kinds = "registered_domain string, creation_date timestamp, expiration_date timestamp, registrant_name string, registrar_name string, nameservers array<string>, error string, whois_status string"
    return domains.select("registered_domain").repartition(tasks, "registered_domain").mapInPandas(run, kinds)


def registrations(domains: DataFrame, bootstrap: DataFrame, rules: DataFrame, client: Client, fallback: Fallback | None = None, fallback_pause: float = 0.5, **pace) -> DataFrame:
    """REGISTRATION evidence of the distinct non-empty registered domains.

    ``rdap_status`` is success, not_found (404), rate_limited (429), unavailable (no service) or error.  Domains for which no
    date came, and only those, go to ``fallback``; its answer then stands, with the first service's status.
    """
    wanted = keep(domains.select(F.lower("registered_domain").alias("registered_domain")).where("registered_domain <> ''").distinct(), "domains")
    placed = keep(services(wanted, bootstrap, rules), "services")
    answered = keep(ask_registries(placed, client, **pace), "registry-answers")
    a, http = R.answer(F.col("answer")), F.col("http_status")
    status = F.when(F.col("server").isNull(), "unavailable").when(http == 200, "success").when(http == 404, "not_found").when(http == 429, "rate_limited").otherwise("error")
    rows = placed.join(answered, "registered_domain", "left").withColumns({"a": a, "rdap_status": status})
    a, none = F.col("a"), F.array().cast("array<string>")
    error = F.when(F.col("server").isNull(), "No RDAP server").otherwise(F.coalesce("error", F.lit("")))
    first = keep(rows.select(
        "registered_domain", R.created(a).alias("creation_date"), R.expires(a).alias("expiration_date"), F.coalesce(R.registrant(a), F.lit("")).alias("registrant_name"), F.coalesce(R.registrar(a), F.lit("")).alias("registrar_name"),
        F.coalesce(R.nameservers(a), none).alias("nameservers"), F.when(F.col("rdap_status") == "success", "rdap").otherwise("").alias("source"), error.alias("error"), "rdap_status",
        F.when(F.col("rdap_status") == "success", "skipped").otherwise("pending").alias("whois_status"),
    ), "registrations")
    columns = [c.split(" ")[0] for c in REGISTRATION.split(", ")]
    if fallback is None:
        return first.select(*columns)
    dated = F.col("creation_date").isNotNull() | F.col("expiration_date").isNotNull()
    second = keep(ask_fallback(first.where(~dated), fallback, pause=fallback_pause), "fallback-answers")
    mended = second.withColumn("source", F.lit("whois")).join(first.select("registered_domain", "rdap_status"), "registered_domain")
    return first.where(dated).select(*columns).unionByName(mended.select(*columns))
