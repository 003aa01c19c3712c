"""Chains that are followed for all keys at once: aliases of hosts, and redirects of URLs.

A chain is a loop of joins, not of calls: each round asks for the distinct names that its frontier has come to and that
no round before has asked for, and moves the frontier on.  Rounds are bounded, and each ends in the shared folder.
``ask`` is any function from a table of distinct keys to a table of answers: a prober, or a join with known answers.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import html as H
from ..functions import text as T
from ..storage import delete, keep
from .hosts import resolve

Ask = Callable[[DataFrame], DataFrame]
RECORDS = ("A", "AAAA", "CNAME")
MOST_ALIASES = 10
MOST_REDIRECTS = 10
_ANSWER = "name string, kind string, values array<string>, error string"


def _asked(wanted: DataFrame, known: DataFrame, ask: Ask) -> DataFrame:
    """``known`` with the answers for those of ``wanted`` (name, kind) that it lacks, each asked for once."""
    new = keep(wanted.distinct().join(known, ["name", "kind"], "left_anti"), "names")
    if new.isEmpty():
        return known
    answers = new.join(ask(new).select("name", "kind", "values", "error"), ["name", "kind"], "left")
    one = answers.groupBy("name", "kind").agg(F.min(F.struct(F.col("error") != "", "values", "error")).alias("a"))
    return keep(known.unionByName(one.select("name", "kind", "a.values", F.coalesce("a.error", F.lit("NoAnswer")).alias("error"))), "answers")


def alias_chains(hosts: DataFrame, ask: Ask, known: DataFrame | None = None, most: int = MOST_ALIASES) -> tuple[DataFrame, DataFrame]:
    """(chains, answers).  chains: host, aliases (in order), error ("" or why the chain ended) of each distinct host.

    A chain goes by the first CNAME of each name, lower case and without dots around it, until a name has none, an
    answer fails, a name comes again, or it has ``most`` aliases.  Names that several hosts come to are asked for once.
    """
    spark = hosts.sparkSession
    answers = known if known is not None else spark.createDataFrame([], _ANSWER)
    none = F.array().cast("array<string>")
    frontier = hosts.select("host").where("host <> ''").distinct().select("host", F.col("host").alias("name"), none.alias("aliases"))
    ended = []
    for _ in range(most):
        frontier = keep(frontier, "frontier")
        if frontier.isEmpty():
            break
        answers = _asked(frontier.select("name", F.lit("CNAME").alias("kind")), answers, ask)
        first = answers.where("kind = 'CNAME'").select("name", "error", F.lower(F.regexp_replace(F.get("values", F.lit(0)), r"^\.+|\.+$", "")).alias("next"))
        moved = keep(frontier.join(first, "name").withColumn("on", F.coalesce((F.col("next") != "") & ~F.array_contains("aliases", F.col("next")), F.lit(False))), "moved")
        ended.append(moved.where(~F.col("on")).select("host", "aliases", "error"))
        frontier = moved.where("on").select("host", F.col("next").alias("name"), F.array_append("aliases", F.col("next")).alias("aliases"))
    out = frontier.select("host", "aliases", F.lit("").alias("error"))  # as long as they may get
    for part in ended:
        out = out.unionByName(part)
    return out, answers


def resolve_dns(hosts: DataFrame, ask: Ask, fallback: Ask | None = None, retries: int = 1) -> DataFrame:
    """(host, ips, aliases, errors, socket_failed) of each distinct host, as ``probes.merged_dns`` takes them.

    A, AAAA and the alias chain are asked for.  Hosts that came to nothing, with a timeout among the errors, are asked
    again, ``retries`` times at most.  Hosts without an address then go to ``fallback``, which gives (name, values,
    aliases, error) as the system's resolver does.
    """
    spark = hosts.sparkSession
    waiting = keep(hosts.select("host").where("host <> ''").distinct(), "hosts")
    found = spark.createDataFrame([], "host string, ips array<string>, aliases array<string>, errors array<string>")
    for attempt in range(retries + 1):
        wanted = waiting.select(F.col("host").alias("name"), F.explode(F.array(*map(F.lit, RECORDS[:2]))).alias("kind"))
        answers = _asked(wanted, spark.createDataFrame([], _ANSWER), ask)
        chains, answers = alias_chains(waiting, ask, answers)
        said = F.when(F.col("error") != "", F.concat_ws(":", "kind", "error"))
        addresses = answers.where("kind <> 'CNAME'").groupBy("name").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce("values", F.array().cast("array<string>")))))).alias("ips"), F.array_sort(F.collect_list(said)).alias("failed"))
        cname = F.when(F.col("error") != "", F.array(F.concat(F.lit("CNAME:"), "error"))).otherwise(F.array().cast("array<string>"))
        now = chains.join(addresses.withColumnRenamed("name", "host"), "host", "left").select("host", F.coalesce("ips", F.array().cast("array<string>")).alias("ips"), "aliases", F.concat(F.coalesce("failed", F.array().cast("array<string>")), cname).alias("errors"))
        now = keep(now, "dns-round")
        again = (F.size("ips") == 0) & (F.size("aliases") == 0) & F.exists("errors", lambda e: F.lower(e).contains("timeout"))
        held = found.select("host", F.col("errors").alias("_before"))
        found = keep(found.join(now.select("host"), "host", "left_anti").unionByName(now.join(held, "host", "left").withColumn("errors", F.concat(F.coalesce("_before", F.array().cast("array<string>")), "errors")).drop("_before")), "dns")
        waiting = now.where(again).select("host") if attempt < retries else waiting.limit(0)
        if waiting.isEmpty():
            break
    if fallback is None:
        return found.withColumn("socket_failed", F.lit(False))
    lacking = keep(found.where(F.size("ips") == 0).select(F.col("host").alias("name")), "lacking")
    asked = keep(fallback(lacking).select(F.col("name").alias("host"), F.col("values").alias("_ips"), F.col("aliases").alias("_aliases"), F.col("error").alias("_error")), "fallback")
    none = F.array().cast("array<string>")
    failed = F.coalesce(F.col("_error") != "", F.lit(False))
    return found.join(asked, "host", "left").select(
        "host", F.array_union("ips", F.coalesce("_ips", none)).alias("ips"), F.array_union("aliases", F.coalesce("_aliases", none)).alias("aliases"),
        F.when(failed, F.array_append("errors", F.concat(F.lit("socket:"), "_error"))).otherwise(F.col("errors")).alias("errors"), failed.alias("socket_failed"),
    )


HOP = "url string, location string, status_code int, html string, content_type string, error string"


def fetch_hops(urls: DataFrame, ask: Ask, most: int = MOST_REDIRECTS) -> DataFrame:
    """Single hops (HOP, with ``next``, the absolute address of the location) of the distinct URLs and of all that they lead
    to, each asked for once; ``ask`` fetches one URL without following it."""
    known = None
    frontier = urls.select("url").where("url <> ''").distinct()
    for _ in range(most + 1):
        frontier = keep(frontier if known is None else frontier.join(known.select("url"), "url", "left_anti"), "frontier")
        if frontier.isEmpty():
            break
        answers = ask(frontier).select("url", "location", "status_code", "html", "content_type", "error")
        moved = F.col("status_code").isin(301, 302, 303, 307, 308) & (F.coalesce("location", F.lit("")) != "")
        hops = keep(answers.withColumn("next", F.when(moved, H.join_url(F.col("url"), F.col("location")))), "hops")
        known = keep(hops if known is None else known.unionByName(hops), "known")
        frontier = hops.select(F.col("next").alias("url")).where("url is not null").distinct()
    return known if known is not None else urls.sparkSession.createDataFrame([], HOP + ", next string")


def redirect_chains(hops: DataFrame, suffixes: T.Suffixes | DataFrame, most: int = MOST_REDIRECTS) -> DataFrame:
    """HTTP evidence (operators.evidence.HTTP) of each URL of single hops (url, next, status_code, html, content_type, error).

    Pointer jumping: every URL points to the one after it, with the redirects and the changes of registered domain on the
    way; each round doubles the reach, so a few joins find all ends, whatever the length.  More than ``most`` redirects,
    as in a loop, and a URL that was not fetched are errors.
    """
    one = hops.groupBy("url").agg(F.min(F.struct("next", "status_code", "html", "content_type", "error")).alias("h")).select("url", "h.*")
    one = keep(one.withColumns({"_from": T.hostname("url"), "_to": T.hostname("next")}), "hops")
    named, (a, b) = resolve(one, {"_na": F.col("_from"), "_nb": F.col("_to")}, suffixes)
    here, there = T.registered_domain(F.col("_from"), a), T.registered_domain(F.col("_to"), b)
    crossing = F.coalesce((here != "") & (there != "") & (here != there), F.lit(False)).cast("int")
    goes = F.col("next").isNotNull()
    jump = keep(named.select("url", F.coalesce("next", "url").alias("at"), goes.cast("long").alias("hops"), F.when(goes, crossing).otherwise(0).cast("long").alias("crossings")), "jump")
    reach = 1
    while reach <= most:
        ahead = jump.select(F.col("url").alias("at"), F.col("at").alias("_at"), F.col("hops").alias("_hops"), F.col("crossings").alias("_crossings"))
        further = jump.join(ahead, "at", "left")
        new = keep(further.select("url", F.coalesce("_at", "at").alias("at"), *((F.col(c) + F.coalesce(f"_{c}", F.lit(0))).alias(c) for c in ("hops", "crossings"))), "jump")
        delete(jump)
        jump, reach = new, 2 * reach
    end = one.select(F.col("url").alias("at"), "status_code", "html", "content_type", "error", F.lit(True).alias("_there"))
    found = jump.join(end, "at", "left")
    error = F.when(F.col("hops") > most, "TooManyRedirects").when(F.col("_there").isNull(), "NotFetched").otherwise(F.coalesce("error", F.lit("")))
    body, code = F.coalesce("html", F.lit("")), F.coalesce("status_code", F.lit(0))
    ok = code.between(200, 399)
    good = F.col("_error") == ""
    text = lambda c: F.when(good, c).otherwise("")
    count = lambda c: F.when(good, c).otherwise(0).cast("int")
    return found.withColumn("_error", error).select(
        "url", text(body).alias("html"), F.when(good, F.col("at")).otherwise(F.col("url")).alias("final_url"), count(code).alias("status_code"), count((ok & (T.strip(body) != "")).cast("int")).alias("fetch_success"),
        count(F.col("hops")).alias("redirect_count"), count(F.col("crossings")).alias("redirect_cross_domain_count"), text(F.coalesce("content_type", F.lit(""))).alias("content_type"), F.col("_error").alias("error"),
        F.when(~good, "error").when(ok, "success").otherwise(F.concat(F.lit("http_"), code.cast("string"))).alias("status"),
    )
