"""The collector plan: local files, feeds and permutations to labelled candidate rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Settings
from ..functions import text as T
from ..operators import contexts as C
from ..operators.match import match_brands
from ..operators.probes import probe
from ..operators.ranking import positions
from ..sources.readers import ordered_permutations, permutation_sources
from ..sources.writers import candidate_rows
from ..storage import keep

LABELS = {"local": "Unlabeled", "feed": "Phishing", "permutation": "Suspected"}


def matched_rows(urls: DataFrame, brands: DataFrame, settings: Settings, threshold: float) -> DataFrame:
    """(url, host, match_domain, match_name, match_score, ord): the first row of each (host, brand) over the threshold;
    hosts that are brand domains or lie below one are left out."""
    rows = urls.select("url", "ord", T.hostname("url").alias("detected_domain"), F.lit("").alias("target_domain"), F.lit("").alias("cse_name")).where("detected_domain <> ''")
    matched = match_brands(rows, brands, settings).where(F.col("match_domain").isNotNull() & (F.col("match_score") >= threshold))
    own = C.official_or_below(matched, brands).select("host").distinct()
    kept = matched.join(own, "host", "left_anti").select(T.ensure_url("url").alias("url"), "host", "match_domain", "match_name", "match_score", "ord")
    return C.first_of_each(kept, ["host", "match_domain"])


def counts(urls: DataFrame, matched: DataFrame, active: DataFrame | None = None) -> dict[str, int]:
    """Rows that came in, matched and were left out; with the rows that passed the DNS gate, those that did not too."""
    loaded, kept = urls.count(), matched.count()
    found = {"loaded": loaded, "matched": kept, "skipped": loaded - kept}
    if active is not None:
        found["dns_active"] = active.count()
        found["dns_inactive"] = loaded - found["dns_active"]
    return found


def format_counts(found: dict[str, int], limit: int = 0) -> str:
    """"name=count" by falling count, ties by name; at most ``limit``."""
    ordered = sorted(found.items(), key=lambda x: (-x[1], x[0]))
    return ", ".join(f"{k}={v}" for k, v in (ordered[:limit] if limit else ordered)) or "none"


def active_only(rows: DataFrame, dns: DataFrame, host: str = "host") -> DataFrame:
    """Rows whose host has passing DNS evidence."""
    return rows.join(dns.where("dns_check_pass = 1").select(F.col("host").alias("_h")).distinct(), F.col(host) == F.col("_h"), "left_semi")


def collect(sources: list[tuple[str, str, DataFrame]], brands: DataFrame, settings: Settings, day: Column, dns: DataFrame | None = None) -> DataFrame:
    """The candidate file: ``sources`` are (kind, name, urls with url and ord) of kind local, feed or permutation, in order.

    Rows of one (URL, brand) merge to the one of the highest label priority, in the place of the first; then the row cap.
    """
    out = None
    thresholds = {"local": settings.match_threshold, "feed": settings.feed_threshold, "permutation": settings.permutation_threshold}
    for number, (kind, name, urls) in enumerate(sources):
        rows = matched_rows(urls, brands, settings, thresholds[kind])
        if dns is not None:
            rows = active_only(rows, dns)
        rows = rows.withColumn("ord", F.lit(number).cast("long") * (1 << 48) + F.col("ord"))
        keyed = candidate_rows(rows, name, LABELS[kind], day, "ord")
        out = keyed if out is None else C.union_all(out, keyed)
    label = "Phishing/Suspected Domains (i.e. Class Label)"
    keys = ["Identified Phishing/Suspected Domain Name", "Corresponding CSE Domain Name"]
    renamed = out.withColumnRenamed(label, "label")
    merged = C.dedupe_by_priority(renamed, keys).withColumnRenamed("label", label)
    return C.cap(merged, settings.row_cap, "ord", *keys).orderBy("ord").drop("ord")


@dataclass
class Budgeted:
    """Candidate rows (as ``matched_rows`` gives them) and what became of the domains."""

    rows: DataFrame
    counters: dict[str, int]


def budgeted_permutations(brands: DataFrame, generate: Callable[[str], str], settings: Settings, budget: int = 0, wanted: list[str] | None = None, limit: int = 0, dns: Callable[[DataFrame], DataFrame] | None = None, wave: int = 16, tasks: int = 16, threads: int = 1) -> Budgeted:
    """Permutations of the brands' domains until ``budget`` rows are found (0: of all domains).

    Domains are taken in their order, ``wave`` at a time.  A wave's generators run once each, in tasks; what they give goes
    through the DNS gate (``dns`` gives evidence for a table of hosts) and the match, and loses the (host, brand) pairs of
    the waves before.  Rows are counted after that.  The wave that meets the budget is cut in the order of domains and of
    the generator's output; domains after it are never permuted.  A generator that fails costs its domain only; one that
    isn't there is an error.
    """
    sources = permutation_sources(brands, wanted, limit).where("domain <> ''")
    numbered = keep(positions(sources, [F.col("domain")], out="place"), "domains")
    n = numbered.count()
    found = {"domains": n, "domains_processed": 0, "domain_failures": 0, "loaded": 0, "dns_active": 0, "dns_inactive": 0, "matched": 0, "lexical_skipped": 0, "max_rows": budget, "capped": 0}
    held: DataFrame | None = None
    schema = "brand string, json string, error string, status string"
    for first in range(0, n, wave):
        some = numbered.where((F.col("place") >= first) & (F.col("place") < first + wave))
        texts = keep(probe(some.select(F.col("domain").alias("brand")), "brand", schema, lambda d: {"json": generate(d), "error": "", "status": "success"}, "error", min(tasks, wave), threads), "permutations")
        failed = {r["error"]: r["count"] for r in texts.where("status = 'error'").groupBy("error").count().collect()}
        if "FileNotFoundError" in failed:
            raise FileNotFoundError("the permutation generator is not installed")
        placed = some.select(F.col("domain").alias("brand"), "place")
        hosts = keep(ordered_permutations(texts.where("status = 'success'")).join(placed, "brand").select(F.concat(F.lit("http://"), "host").alias("url"), "host", (F.col("place") * (1 << 32) + F.col("at")).alias("ord")), "permuted")
        active = keep(active_only(hosts, keep(dns(hosts.select("host").distinct()), "gate")), "active") if dns else hosts
        matched = matched_rows(active.select("url", "ord"), brands, settings, settings.permutation_threshold)
        if held is not None:
            matched = matched.join(held.select("host", "match_domain"), ["host", "match_domain"], "left_anti").select(*held.columns)
        new = keep(matched, "budgeted")
        loaded, alive, more = hosts.count(), active.count(), new.count()
        over = budget > 0 and found["matched"] + more >= budget
        if over:
            new, more = C.cap(new, budget - found["matched"], "ord", "match_domain"), budget - found["matched"]
        held = keep(new if held is None else held.unionByName(new), "budget")
        steps = {"domains_processed": min(wave, n - first), "domain_failures": sum(failed.values()), "loaded": loaded, "dns_active": alive, "dns_inactive": loaded - alive, "matched": more, "capped": int(over)}
        found |= {k: found[k] + v for k, v in steps.items()}
        if over:
            break
    found["lexical_skipped"] = max(0, found["dns_active"] - found["matched"])
    found["skipped"] = found["dns_inactive"] + found["lexical_skipped"]
    if held is None:
        empty = brands.sparkSession.createDataFrame([], "url string, ord bigint")
        held = matched_rows(empty, brands, settings, settings.permutation_threshold)
    return Budgeted(held, found)
