"""Public suffixes of hosts, by rules.

A rule table (``sources.readers.read_suffix_rules``) has exact rules (``co.uk``), wildcards (``*.ck``) and exceptions
(``!www.ck``).  Each distinct host is exploded into its endings, which meet the rules in one equi-join; the longest rule
is an aggregate, and an exception goes before all others.

Operators that need suffixes take ``suffixes``: a rule table, or a short tuple of suffixes, which becomes a pattern.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..storage import keep

#: A rule table of more rows than this is not broadcast; the join then splits hot endings by itself.
MOST_BROADCAST_RULES = 50_000


def suffix_lengths(hosts: DataFrame, rules: DataFrame, host: str = "host") -> DataFrame:
    """(host, suffix_labels): for each distinct host, the labels of its public suffix; 0 where no rule fits.

    Null and empty hosts are left out.  A wildcard needs one label more than its name; the suffix of an exception is its
    name without the first label.
    """
    asked = hosts.select(F.col(host).alias("host")).where("host <> ''").distinct()
    labels = F.split("host", r"\.")
    ends = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.struct(i.alias("n"), F.array_join(F.slice(labels, -i, i), ".").alias("name")))
    keys = asked.select("host", F.size(labels).alias("all"), F.explode(ends).alias("end")).select("host", "all", "end.*")
    listed = rules.select("name", "more").distinct()
    if listed.count() <= MOST_BROADCAST_RULES:
        listed = F.broadcast(listed)
    met = keys.join(listed, "name").where(F.col("n") + F.col("more") <= F.col("all"))
    longest = met.groupBy("host").agg(F.max(F.struct(F.col("more") < 0, F.col("n") + F.col("more"))).alias("rule"))
    return asked.join(longest.select("host", F.col("rule.col2").alias("suffix_labels")), "host", "left").withColumn("suffix_labels", F.coalesce("suffix_labels", F.lit(0)))


def resolve(rows: DataFrame, hosts: dict[str, Column], suffixes: T.Suffixes | DataFrame) -> tuple[DataFrame, list[T.Suffixes]]:
    """(rows, suffixes for the functions of each of the host columns).  With a rule table, the distinct hosts of all the columns
    are looked up together and written out, and ``rows`` get a column of suffix labels for each, by its name."""
    if not isinstance(suffixes, DataFrame):
        return rows, [suffixes] * len(hosts)
    keyed = rows.withColumns({f"{name}_host": host for name, host in hosts.items()})
    every = keyed.select(F.explode(F.array_distinct(F.array(*(f"{name}_host" for name in hosts)))).alias("host"))
    found = keep(suffix_lengths(every, suffixes), "suffix-lengths")
    for name in hosts:
        one = found.select(F.col("host").alias(f"{name}_host"), F.col("suffix_labels").alias(name))
        keyed = keyed.join(one, f"{name}_host", "left")
    return keyed.select(*rows.columns, *(F.coalesce(name, F.lit(0)).alias(name) for name in hosts)), [F.col(name) for name in hosts]


def registered_domains(rows: DataFrame, urls: str, out: str, suffixes: T.Suffixes | DataFrame) -> DataFrame:
    """``rows`` with ``out``, the registered domains of the hosts of an array of URLs, in order.  With a rule table each
    distinct array is exploded once."""
    if not isinstance(suffixes, DataFrame):
        return rows.withColumn(out, F.transform(urls, lambda u: T.registered_domain(T.hostname(u), suffixes)))
    each = rows.select(F.col(urls).alias("_urls")).where("_urls is not null").distinct().select("_urls", F.posexplode("_urls").alias("_at", "_url"))
    each, (known,) = resolve(each.withColumn("_host", T.hostname("_url")), {"_n": F.col("_host")}, suffixes)
    named = each.groupBy("_urls").agg(F.sort_array(F.collect_list(F.struct("_at", T.registered_domain(F.col("_host"), known).alias("_d")))).alias("_all"))
    joined = rows.join(named, F.col(urls) == F.col("_urls"), "left")
    empty = F.array().cast("array<string>")
    return joined.select(*rows.columns, F.when(F.col(urls).isNotNull(), F.coalesce(F.col("_all._d"), empty)).alias(out))


def host_parts(hosts: DataFrame, rules: DataFrame, host: str = "host") -> DataFrame:
    """(host, subdomain, label, suffix, registered_domain) of each distinct host; without a rule that fits, the last label
    counts as the label and the suffix is empty."""
    found, h, n = suffix_lengths(hosts, rules, host), F.col("host"), F.col("suffix_labels")
    suffix = F.array_join(F.slice(F.split(h, r"\."), -n, n), ".")
    return found.select("host", T.subdomain(h, n).alias("subdomain"), T.domain_label(h, n).alias("label"), F.when(n > 0, suffix).otherwise("").alias("suffix"), T.registered_domain(h, n).alias("registered_domain"))
