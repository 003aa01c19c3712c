"""Text, URL and host functions as Spark columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import HOMOGLYPHS, NULL_TEXTS, PRIVACY_WORDS, REPUTATION, REPUTATION_HIGH, REPUTATION_LOW, REPUTATION_OTHER, STOPWORDS, SUFFIXES, UNKNOWN


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


# Each function names its argument once: nested calls then grow by a sum, not by a product, and stay small enough to
# compile.  Alternatives are therefore alternatives of one pattern, not branches.


def strip(x: Column | str) -> Column:
    return F.regexp_replace(col(x), r"^\s+|\s+$", "")


def clean(x: Column | str) -> Column:
    """The trimmed text; "" for null and for the words that stand for it."""
    return F.regexp_replace(strip(F.coalesce(col(x).cast("string"), F.lit(""))), f"(?i)^(?:{'|'.join(NULL_TEXTS)})$", "")


def first_filled(*columns: Column | str) -> Column:
    """The first column that is not empty after ``clean``, else ""."""
    return F.coalesce(*(F.nullif(clean(c), F.lit("")) for c in columns), F.lit(""))


def _with_scheme(x: Column | str) -> Column:
    return F.regexp_replace(F.lower(clean(x)), "(?s)^(?!.*://)", "http://")


def _net_location(x: Column | str) -> Column:
    return F.regexp_extract(_with_scheme(x), r"^[^:]*://([^/?#]*)", 1)


def url_host(x: Column | str) -> Column:
    """The host part alone: without user, port and brackets, but with www."""
    return F.regexp_replace(F.regexp_extract(_with_scheme(x), r"^[^:]*://(?:[^/?#]*@)?(\[[^\]/]*\]|[^/?#:]*)", 1), r"[\[\]]", "")


def hostname(x: Column | str) -> Column:
    """The lower-case host without dots around it and without one leading "www."."""
    host = F.regexp_extract(_with_scheme(x), r"^[^:]*://(?:[^/?#]*@)?(\[[^\]/]*\]|[^/?#:]+|[^/?#]*)", 1)
    return F.regexp_replace(F.regexp_replace(host, r"^[.\[]+|[.\]]+$", ""), r"^www\.", "")


def ensure_url(x: Column | str) -> Column:
    """The text with "http://" before it unless it begins, in lower case, with a web scheme."""
    return F.regexp_replace(clean(x), "^(?!https?://|$)", "http://")


def url_path(x: Column | str) -> Column:
    return F.regexp_extract(ensure_url(x), r"^[^:]*://[^/?#]*([^?#]*)", 1)


def origin(x: Column | str) -> Column:
    """scheme://host[:port]; "unknown" without a host."""
    url = ensure_url(x)
    port = F.regexp_extract(F.regexp_replace(_net_location(url), "^.*@", ""), r":([0-9]+)$", 1)
    scheme = F.lower(F.regexp_extract(url, "^([^:]*):", 1))
    full = F.concat(scheme, F.lit("://"), url_host(url), F.when(port.isin("", "0"), "").otherwise(F.concat(F.lit(":"), port)))
    return F.when(url_host(url) == "", "unknown").otherwise(full)


def _suffixes(suffixes: tuple[str, ...]) -> str:
    return "|".join(s.replace(".", r"\.") for s in sorted(suffixes, key=lambda s: (-len(s), s)))


def suffix_pattern(suffixes: tuple[str, ...] = SUFFIXES) -> str:
    """Splits a host in subdomain, label and suffix: the lazy first group leaves the longest suffix to the last."""
    return rf"^(?:(.*?)\.)??([^.]+)\.({_suffixes(suffixes)})$"


_ADDRESS = r"\d+(?:\.\d+){3}"


#: What tells a host's public suffix: known suffixes, or a column with the number of its labels (operators.hosts).
Suffixes = tuple[str, ...] | Column


def registered_domain(host: Column, suffixes: Suffixes = SUFFIXES) -> Column:
    """Label and suffix of a host; the host itself if it has no known suffix or nothing before it."""
    if isinstance(suffixes, Column):
        labels = F.split(host, r"\.")
        own = F.array_join(F.slice(labels, -(suffixes + 1), suffixes + 1), ".")
        return F.when((suffixes > 0) & (F.size(labels) > suffixes), own).otherwise(host)
    return F.regexp_replace(host, rf"^(?:.*?\.)??([^.]+\.(?:{_suffixes(suffixes)}))$", "$1")


def domain_label(host: Column, suffixes: Suffixes = SUFFIXES) -> Column:
    """The label before the suffix; without a known suffix the last label; "" if the host is a suffix; an address whole."""
    if isinstance(suffixes, Column):
        labels = F.split(host, r"\.")
        return F.when(host.rlike(f"^{_ADDRESS}$"), host).when(F.size(labels) > suffixes, F.element_at(labels, -(suffixes + 1))).otherwise("")
    known = _suffixes(suffixes)
    return F.regexp_replace(host, rf"^(?:(?:{known})|(?:.*?\.)??([^.]+)\.(?:{known})|({_ADDRESS})|(?:.*\.)?([^.]*))$", "$1$2$3")


def subdomain(host: Column, suffixes: Suffixes = SUFFIXES) -> Column:
    if isinstance(suffixes, Column):
        labels = F.split(host, r"\.")
        before = F.array_join(F.slice(labels, F.lit(1), F.size(labels) - suffixes - 1), ".")
        return F.when((F.size(labels) > suffixes + 1) & ~host.rlike(f"^{_ADDRESS}$"), before).otherwise("")
    known = _suffixes(suffixes)
    return F.regexp_replace(host, rf"^(?:(?:{known})|(?:(.*?)\.)??[^.]+\.(?:{known})|{_ADDRESS}|(.*)\.[^.]*|.*)$", "$1$2")


def subdomain_depth(host: Column, suffixes: Suffixes = SUFFIXES) -> Column:
    return F.size(F.filter(F.split(subdomain(host, suffixes), r"\."), lambda x: x != ""))


def domain_stem(host: Column, suffixes: Suffixes = SUFFIXES) -> Column:
    return F.regexp_replace(F.lower(domain_label(host, suffixes)), "[^a-z0-9]+", "")


def tokens(text: Column) -> Column:
    """The distinct runs of a-z and 0-9 of at least three characters that are no stopwords."""
    return F.array_distinct(F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda t: (F.length(t) >= 3) & ~t.isin(*STOPWORDS)))


def domain_tokens(host: Column, suffixes: Suffixes = SUFFIXES) -> Column:
    return tokens(F.concat_ws(" ", subdomain(host, suffixes), domain_label(host, suffixes)))


def brand_tokens(host: Column, name: Column, suffixes: Suffixes = SUFFIXES) -> Column:
    return F.array_union(domain_tokens(host, suffixes), tokens(clean(name)))


def homoglyphs(x: Column) -> Column:
    return F.translate(F.lower(x), *HOMOGLYPHS)


def alnum(x: Column) -> Column:
    return F.regexp_replace(F.lower(x), "[^a-z0-9]+", "")


def url_alnum(x: Column | str) -> Column:
    """Letters and digits of host (with www) and path."""
    return alnum(F.concat(url_host(ensure_url(x)), F.lit(" "), url_path(x)))


def any_token(needles: Column, *texts: Column) -> Column:
    """Whether a text holds one of the tokens."""
    return F.exists(needles, lambda t: reduce(lambda a, b: a | b, (x.contains(t) for x in texts)))


def count_of(x: Column, pattern: str) -> Column:
    return F.regexp_count(x, F.lit(pattern))


def entropy(x: Column) -> Column:
    """Shannon entropy of the characters in bits, rounded to six places."""
    chars = F.filter(F.split(x, ""), lambda c: c != "")
    n = F.size(chars).cast("double")
    counted = F.transform(F.array_distinct(chars), lambda c: F.size(F.filter(chars, lambda d: d == c)).cast("double") / n)
    total = F.aggregate(counted, F.lit(0.0), lambda s, p: s - p * F.log2(p))
    return F.round(F.when(F.coalesce(F.length(x), F.lit(0)) == 0, F.lit(0.0)).otherwise(total), 6)


def url_shape(url: Column, host: Column) -> dict[str, Column]:
    """The shape features of a URL and its host."""
    flag = lambda c: c.cast("int")
    return {
        "having_ip": flag(url.rlike(r"([0-9]{1,3}\.){3}[0-9]{1,3}")),
        "have_at_symbol": flag(url.contains("@")),
        "url_length": F.length(url),
        "url_depth": count_of(url_path(url), "/"),
        "redirection": flag(F.length(url) - F.length(F.substring_index(url, "//", -1)) - 2 > 7),
        "http_domain": flag(host.contains("http")),
        "tiny_url": flag(F.lower(url).rlike(r"bit\.ly|tinyurl|goo\.gl|t\.co|ow\.ly")),
        "prefix_suffix": flag(host.contains("-")),
        "digit_count": count_of(url, "[0-9]"),
        "special_char_count": count_of(url, "[?=&%_@-]"),
        "entropy": entropy(url),
    }


IPV4 = r"\b((?:[0-9]{1,3}\.){3}[0-9]{1,3})\b"


def ip_list(x: Column) -> Column:
    """The IPv4 addresses of a text in order, each octet at most 255."""
    found = F.regexp_extract_all(F.coalesce(x, F.lit("")), F.lit(IPV4), F.lit(1))
    return F.filter(found, lambda ip: F.forall(F.split(ip, r"\."), lambda o: o.cast("int") <= 255))


def ip_set(*xs: Column) -> Column:
    return F.array_sort(F.array_distinct(F.flatten(F.array(*(ip_list(x) for x in xs)))))


def first_ip(x: Column) -> Column:
    return F.coalesce(F.get(F.filter(F.split(F.coalesce(x, F.lit("")), ";"), lambda p: strip(p) != ""), F.lit(0)), F.lit(""))


def split_hosts(cell: Column) -> Column:
    """The hosts of a cell that may hold several."""
    parts = F.split(clean(cell), r"[\s,;|]+")
    return F.filter(F.transform(parts, lambda p: hostname(F.regexp_replace(p, r"^[()\[\]{}'\"]+|[()\[\]{}'\"]+$", ""))), lambda h: h != "")


def source_label(x: Column | str) -> Column:
    text = F.lower(clean(x))
    named = F.when(text.contains("phish"), "phishing").when(text.contains("suspect"), "suspected").when(text.contains("legit"), "legitimate")
    return named.when(text == "", "unknown").otherwise(text)


def training_label(x: Column | str) -> Column:
    text = F.lower(strip(F.coalesce(col(x).cast("string"), F.lit(""))))
    named = F.when(text.contains("phish"), "phishing").when(text.contains("suspect"), "suspected").when(text.contains("legit"), "legitimate")
    return named.when(text.contains("unlabel") | text.isin("unknown", ""), "unlabeled").otherwise(text)


def label_priority(x: Column) -> Column:
    text = F.lower(F.coalesce(x, F.lit("")))
    return F.when(text.contains("phish"), 3).when(text.contains("suspect"), 2).when(text.contains("legit"), 1).otherwise(0)


def inferred_label(explicit: Column, file: Column) -> Column:
    name = F.lower(F.coalesce(file, F.lit("")))
    return F.when(clean(explicit) != "", clean(explicit)).when(name.contains("openphish") | name.contains("phishtank"), "Phishing").when(name.contains("dnstwist"), "Unlabeled").otherwise("")


def truth(x: Column, numeric: bool = False) -> Column:
    """1, 0 or null: what a ground-truth value says."""
    if numeric:
        return F.when(x.isNotNull() & ~F.isnan(x.cast("double")), (x.cast("double") > 0).cast("int"))
    text = F.lower(strip(x.cast("string")))
    has = lambda *words: reduce(lambda a, b: a | b, (text.contains(w) for w in words))
    unknown = text.isNull() | text.isin("", "nan", "nat", "none", "null", "unknown", "unlabeled", "suspected", "review", "pending")
    return (
        F.when(unknown, F.lit(None).cast("int"))
        .when(text.isin("1", "true", "yes", "y", "positive") | has("phish", "malicious", "fraud"), 1)
        .when(text.isin("0", "false", "no", "n", "negative") | has("legit", "benign", "safe", "clean"), 0)
    )


def status_text(x: Column) -> Column:
    return F.lower(strip(F.coalesce(x.cast("string"), F.lit(""))))


def stage_status(x: Column) -> Column:
    return F.coalesce(F.nullif(x, F.lit("")), F.lit("unknown"))


def reputation(x: Column, kind: str) -> Column:
    text = F.lower(clean(x))
    high, low = REPUTATION.get(kind, ((), ()))
    out = F.when(text == "", UNKNOWN)
    for words, score in ((high, REPUTATION_HIGH), (low, REPUTATION_LOW)):
        for word in words:
            out = out.when(text.contains(word), score)
    return out.otherwise(REPUTATION_OTHER)


def dns_error_bucket(error: Column, status: Column) -> Column:
    text = F.coalesce(F.nullif(error, F.lit("")), F.nullif(status, F.lit("")), F.lit("unknown"))
    low = F.lower(text)
    out = F.when(low.contains("nxdomain"), "nxdomain")
    for word, name in (("timeout", "timeout"), ("nonameservers", "no_nameservers"), ("noanswer", "no_answer"), ("gaierror", "socket_gaierror")):
        out = out.when(low.contains(word), name)
    return out.otherwise(F.substring(text, 1, 80))


def contains_any(x: Column, words: tuple[str, ...]) -> Column:
    text = F.lower(F.coalesce(x, F.lit("")))
    return reduce(lambda a, b: a | b, (text.contains(w) for w in words))


def privacy_protected(name: Column) -> Column:
    return contains_any(name, PRIVACY_WORDS).cast("int")
