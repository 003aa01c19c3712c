"""The library's queries over the test tables, each with its DuckDB SQL.

The tables have no forms, logos or registrations, so some operators run on stand-in columns.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import HOMOGLYPHS, REPUTATION, STOPWORDS, SUFFIXES, Settings, threshold_grid
from .functions import dates as D
from .functions import hashing as H
from .functions import html as P
from .functions import registry as G
from .functions import similarity as S
from .functions import text as T
from .operators import contexts as C
from .operators import counts as N
from .operators import evidence as E
from .operators import metrics as M
from .operators import rules as R
from .operators.cascade import registrations
from .operators.chains import alias_chains, redirect_chains
from .operators.hosts import host_parts
from .operators.match import best_brands, brand_set, match_brands, split_by_match
from .operators.store import EvidenceStore
from .plans import learn, reports
from .plans.collect import active_only
from .plans.enrich import imitation_report
from .sources.readers import suffix_rules
from .storage import new_path

#: With these as suffixes, the label before them varies; all test hosts lie below them.
SETTINGS = Settings(suffixes=(*SUFFIXES, "example.com", "example.net", "example.org"), observation_date="2026-01-01")
BRANDS = ["tiontion.com", "tionsh.org", "theron.net", "therat.co.in", "cheap.bank.in", "casino.gov.in", "spam-farm.io", "freebets.co.uk", "therimg.gov.in", "ththbank.bank.in", "th3rti.com", "adultx.net"]
OFFICIAL = ["thther.example.org", "therin.example.net"]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _brands(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(b, f"Brand {i}") for i, b in enumerate(BRANDS)], "domain string, name string")


# Pieces of SQL.


def _q(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _values(rows: list[tuple], names: str) -> str:
    return "(VALUES " + ", ".join("(" + ", ".join(_q(v) if isinstance(v, str) else repr(v) for v in r) + ")" for r in rows) + f") AS {names}"


def _clean(x: str) -> str:
    s = f"regexp_replace(coalesce({x}, ''), '^\\s+|\\s+$', '', 'g')"
    return f"(CASE WHEN lower({s}) IN ('nan', 'nat', 'none', 'null') THEN '' ELSE {s} END)"


def _host(x: str) -> str:
    u = f"(CASE WHEN contains(lower({x}), '://') THEN lower({x}) ELSE 'http://' || lower({x}) END)"
    location = f"regexp_replace(regexp_extract({u}, '^[^:]*://([^/?#]*)', 1), '^.*@', '')"
    return f"regexp_replace(regexp_replace(regexp_replace({location}, ':.*$', ''), '^\\.+|\\.+$', '', 'g'), '^www\\.', '')"


_P = _q(T.suffix_pattern(SETTINGS.suffixes))


def _label(h: str) -> str:
    return f"regexp_extract({h}, {_P}, 2)"


def _registered(h: str) -> str:
    return f"(CASE WHEN {_label(h)} = '' THEN {h} ELSE {_label(h)} || '.' || regexp_extract({h}, {_P}, 3) END)"


def _stem(h: str) -> str:
    return f"regexp_replace({_label(h)}, '[^a-z0-9]+', '', 'g')"


def _alnum(x: str) -> str:
    return f"regexp_replace(lower({x}), '[^a-z0-9]+', '', 'g')"


def _tokens(x: str) -> str:
    stop = ", ".join(map(_q, STOPWORDS))
    return f"list_distinct(list_filter(regexp_split_to_array(lower({x}), '[^a-z0-9]+'), lambda t: length(t) >= 3 AND t NOT IN ({stop})))"


def _looks(x: str) -> str:
    return f"translate({x}, {_q(HOMOGLYPHS[0])}, {_q(HOMOGLYPHS[1])})"


def _ratio(a: str, b: str) -> str:
    """2 * longest common subsequence / total length, by folds over the rows and columns of its table."""
    row = (
        f"list_reduce(list_prepend([0::BIGINT], list_transform(range(1, length({b}) + 1), lambda j: [j])), "
        f"lambda cur, y: list_append(cur, CASE WHEN substr({a}, x[1], 1) = substr({b}, y[1], 1) THEN acc[y[1]] + 1 ELSE greatest(acc[y[1] + 1], cur[len(cur)]) END))"
    )
    table = f"list_reduce(list_prepend(list_transform(range(0, length({b}) + 1), lambda i: 0::BIGINT), list_transform(range(1, length({a}) + 1), lambda i: [i])), lambda acc, x: {row})"
    return f"(CASE WHEN length({a}) = 0 OR length({b}) = 0 THEN 0.0::DOUBLE ELSE 2.0::DOUBLE * list_last({table}) / (length({a}) + length({b})) END)"


_HOSTS = f"hosts AS (SELECT DISTINCT {_host('url')} AS host FROM pages)"
_BRAND_ROWS = _values([(b, f"Brand {i}") for i, b in enumerate(BRANDS)], "b(domain, name)")

_BEST = f"""
WITH {_HOSTS},
h AS (SELECT host, {_registered('host')} AS hr, {_stem('host')} AS hs, {_alnum('host')} AS al, {_looks(_alnum('host'))} AS pl FROM hosts WHERE host <> ''),
br AS (SELECT domain, {_registered('domain')} AS r, {_stem('domain')} AS s, {_tokens(f"regexp_extract(domain, {_P}, 1) || ' ' || {_label('domain')}")} AS tok FROM {_BRAND_ROWS}),
pairs AS (SELECT h.*, br.*, CASE WHEN len(list_filter(tok, lambda t: contains(al, t) OR contains(pl, t))) > 0 THEN 0.85::DOUBLE ELSE 0.0::DOUBLE END AS tk FROM h, br),
sc AS (SELECT *, greatest(tk, {_ratio('hr', 'r')}, {_ratio('hs', 's')}) AS score FROM pairs),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY host ORDER BY score DESC, domain) AS n FROM sc) WHERE n = 1),
look AS (SELECT *, greatest(tk, {_ratio(_looks('hr'), _looks('r'))}, {_ratio(_looks('hs'), _looks('s'))}) AS lk,
  list_min(list_concat([levenshtein(hr, r), levenshtein(hs, s)], flatten(list_transform(tok, lambda t: list_transform([al, pl], lambda w:
    CASE WHEN contains(w, t) THEN 0 WHEN length(w) <= length(t) THEN levenshtein(w, t)
    ELSE list_min(list_transform(range(1, length(w) - length(t) + 2), lambda i: levenshtein(substr(w, i, length(t)), t))) END))))) AS dist
  FROM best),
fin AS (SELECT host, CASE WHEN score > 0 THEN domain ELSE '' END AS brand, round(score, 6) AS score, CASE WHEN score > 0 THEN dist ELSE -1 END AS distance, CASE WHEN score > 0 THEN round(lk, 6) ELSE 0.0 END AS homoglyph FROM look)
"""


# 2.4 joins: the flagship first.


@query(
    _BEST
    + f""", ov AS (SELECT host, min(domain) AS tb FROM h0, (SELECT domain, {_tokens("regexp_extract(domain, " + _P + ", 1) || ' ' || " + _label('domain') + " || ' ' || name")} AS t2 FROM {_BRAND_ROWS}) WHERE len(list_filter(t2, lambda t: contains({_alnum('host')}, t))) > 0 GROUP BY host)
SELECT fin.host, CASE WHEN tb IS NOT NULL AND 0.86 > greatest(score, homoglyph) THEN tb ELSE brand END AS matched_brand,
  CASE WHEN tb IS NOT NULL AND 0.86 > greatest(score, homoglyph) THEN 0.86::DOUBLE ELSE greatest(score, homoglyph) END AS match_score,
  CAST(distance AS INTEGER) AS distance, fin.host IN ({", ".join(map(_q, OFFICIAL))}) AS is_official
FROM fin LEFT JOIN ov ON ov.host = fin.host""".replace("FROM h0,", "FROM hosts,")
)
def brand_imitation(spark, d):
    """For each distinct page host: the brand it imitates most."""
    official = spark.createDataFrame([(o,) for o in OFFICIAL], "domain string")
    return imitation_report(_t(spark, d, "pages"), _brands(spark), official, SETTINGS)


@query(_BEST + "SELECT host, brand, score, CAST(distance AS INTEGER) AS distance, homoglyph FROM fin")
def lexical_match(spark, d):
    hosts = _t(spark, d, "pages").select(T.hostname("url").alias("host"), F.lit("").alias("target"), F.lit("").alias("cse_name")).where("host <> ''").distinct()
    best = best_brands(hosts, brand_set(_brands(spark), SETTINGS), SETTINGS)
    return best.select("host", "brand", F.round("score", 6).alias("score"), "distance", F.round("homoglyph", 6).alias("homoglyph"))


def _candidates(spark, d):
    pages = _t(spark, d, "pages")
    host = T.hostname("url")
    return pages.select("url", host.alias("detected_domain"), F.lit("").alias("target_domain"), F.lit("").alias("cse_name"), F.lit("").alias("remarks"), F.lit("Unlabeled").alias("source_label"), F.lit("pages").alias("source_file"), F.col("page_id").cast("int").alias("source_row"), F.col("page_id").alias("ord"))


@query(
    _BEST
    + f""", u AS (SELECT page_id, url, {_host('url')} AS host, {_alnum("regexp_replace(regexp_replace(regexp_extract(url, '^[^:]*://([^/?#]*[^?#]*)', 1), '^[^/]*@', ''), '^([^/:]*):[0-9]+', '\\1')")} AS ual FROM pages),
tok AS (SELECT domain, {_tokens("regexp_extract(domain, " + _P + ", 1) || ' ' || " + _label('domain') + " || ' ' || name")} AS t2 FROM {_BRAND_ROWS}),
ov AS (SELECT page_id, min(domain) AS tb FROM u, tok WHERE len(list_filter(t2, lambda t: contains(ual, t))) > 0 GROUP BY page_id),
m AS (SELECT u.page_id, u.url, u.host, fin.brand, CASE WHEN tb IS NOT NULL AND 0.86 > greatest(score, homoglyph) THEN 0.86::DOUBLE ELSE greatest(score, homoglyph) END AS top, tb FROM u JOIN fin ON fin.host = u.host LEFT JOIN ov ON ov.page_id = u.page_id)
SELECT url, host AS domain, '' AS target_brand_domain, '' AS critical_sector_entity_name, 'Unlabeled' AS source_label, 'pages' AS source_file, page_id::INTEGER AS source_row,
  'filtered_below_cse_match_threshold' AS validation_status, 'CSE match score ' || printf('%.6f', top) || ' < 0.75' AS validation_reason
FROM m WHERE NOT (coalesce(tb, '') <> '' OR brand <> '') OR top < 0.75"""
)
def match_threshold_split(spark, d):
    _, unmatched = split_by_match(match_brands(_candidates(spark, d), _brands(spark), SETTINGS), SETTINGS)
    return unmatched


@query(f"""SELECT page_id, {_host('url')} AS host FROM pages WHERE {_host('url')} NOT IN ({', '.join(map(_q, OFFICIAL))})
  AND {_host('url')} NOT IN (SELECT {_host('url')} FROM pages WHERE page_id % 50 = 7)""")
def official_exact_split(spark, d):
    """Official are two domains, and the targets of some rows, which are their own hosts here."""
    rows = _candidates(spark, d).withColumn("target_domain", F.when(F.col("ord") % 50 == 7, F.col("url")).otherwise(""))
    kept, _ = C.official_split(rows, spark.createDataFrame([(o,) for o in OFFICIAL], "domain string"))
    return kept.select(F.col("ord").alias("page_id"), F.col("detected_domain").alias("host"))


@query(f"SELECT page_id FROM pages WHERE {_host('url')} IN (SELECT {_host('url')} FROM pages WHERE page_id % 3 = 0)")
def dns_active_rows(spark, d):
    """Rows whose host has passing DNS evidence, which the hosts of every third page have."""
    pages = _t(spark, d, "pages").select("page_id", T.hostname("url").alias("host"))
    dns = pages.select("host", (F.col("page_id") % 3 == 0).cast("int").alias("dns_check_pass"))
    return active_only(pages, dns).select("page_id")


@query("""SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'net-' || page_id WHEN 1 THEN 'org ' || page_id ELSE '' END AS owner, CASE page_id % 4 WHEN 2 THEN 'not_found' WHEN 3 THEN 'http_429' ELSE 'success' END AS status FROM pages""")
def hosting_answers(spark, d):
    """Owners of address blocks: by the block's name, by an entity's card, by neither; and a service that limits."""
    card = F.concat(F.lit('{"entities":[{"roles":["abuse"],"vcardArray":["vcard",[["version",{},"text","4.0"],["fn",{},"text","org '), "page_id", F.lit('"]]]}]}'))
    answer = F.when(F.col("page_id") % 4 == 0, F.concat(F.lit('{"name":"net-'), "page_id", F.lit('"}'))).when(F.col("page_id") % 4 == 1, card).otherwise("{}")
    answers = _t(spark, d, "pages").select(F.concat(F.lit("10.0.0."), "page_id").alias("ip"), F.when(F.col("page_id") % 4 == 3, 429).otherwise(200).alias("http_status"), answer.alias("answer"), F.lit("").alias("error"))
    return E.hosting_from_answers(answers).select(F.substring_index("ip", ".", -1).cast("long").alias("page_id"), F.col("asn_org").alias("owner"), "status")


@query("""SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'b' || page_id || '.png' WHEN 1 THEN 'a' || page_id || '.png' ELSE '' END AS logo FROM pages""")
def logo_sources(spark, d):
    """The image that is a logo and names the brand; else the first that is or does either; else none."""
    i = F.col("page_id")
    image = lambda name, words: F.concat(F.lit(f'<img src="{name}'), i, F.lit('.png" alt="'), words, F.lit('">'))
    head = F.concat(image("a", F.when(i % 3 == 2, "plain").otherwise("the logo")), image("b", F.when(i % 3 == 0, "brandname logo").otherwise("plain")))
    parts = _t(spark, d, "pages").select("page_id", P.page_parts(F.concat(head, "html")).alias("p"))
    return parts.select("page_id", P.logo_source(F.col("p.images"), F.array(F.lit("brandname"))).alias("logo"))


@query(f"SELECT page_id, {_host('url')} AS host FROM pages WHERE {_host('url')} IN ({', '.join(map(_q, OFFICIAL))}) OR {' OR '.join(f'ends_with({_host(chr(117) + chr(114) + chr(108))}, {_q(chr(46) + o)})' for o in OFFICIAL)}")
def official_suffix_filter(spark, d):
    rows = _t(spark, d, "pages").select("page_id", T.hostname("url").alias("host"))
    return C.official_or_below(rows, spark.createDataFrame([(o,) for o in OFFICIAL], "domain string")).select("page_id", "host")


@query("SELECT o_orderkey, c_name, c_mktsegment FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def memo_lookup_join(spark, d):
    customer = _t(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment")
    return E.lookup(_t(spark, d, "orders"), customer, "c_custkey", F.col("o_custkey"), "").select("o_orderkey", "c_name", "c_mktsegment")


@query("""SELECT c_custkey, coalesce(CASE WHEN c_acctbal > 5000 THEN c_mktsegment END, o.p) AS segment FROM customer
LEFT JOIN (SELECT o_custkey, max(o_orderpriority) AS p FROM orders GROUP BY o_custkey) o ON o_custkey = c_custkey""")
def evidence_fill(spark, d):
    first = _t(spark, d, "customer").select("c_custkey", F.when(F.col("c_acctbal") > 5000, F.col("c_mktsegment")).alias("segment"))
    second = _t(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderpriority").alias("segment"))
    return E.fill(first, second, "c_custkey")


_HEX = "('0x' || substr(md5(%s), %d, %d))::UBIGINT"


@query("""WITH h AS (SELECT doc_id, ('0x' || substr(md5(text), 1, 16))::UBIGINT AS a FROM documents), r AS (SELECT DISTINCT ('0x' || substr(md5(text), 1, 16))::UBIGINT AS b FROM benchmark)
SELECT doc_id, round(max(1.0 - bit_count(xor(a, b)) / 64.0::DOUBLE), 6) AS similarity FROM h, r GROUP BY doc_id""")
def hamming_similarity(spark, d):
    first = lambda df: F.substring(F.md5(F.col("text").cast("binary")), 1, 16)
    rows = _t(spark, d, "documents").select("doc_id", first(None).alias("h"))
    refs = _t(spark, d, "benchmark").select(first(None).alias("hash"))
    return E.nearest_hash(rows, "h", refs, 1000, "similarity").select("doc_id", "similarity")


@query("""WITH h AS (SELECT doc_id, ('0x' || substr(md5(text), 1, 4))::UBIGINT AS a FROM documents), r AS (SELECT DISTINCT ('0x' || substr(md5(text), 1, 4))::UBIGINT AS b FROM benchmark)
SELECT doc_id FROM h WHERE EXISTS (SELECT 1 FROM r WHERE bit_count(xor(a, b)) <= 3)""")
def hamming_range_semi(spark, d):
    first = F.substring(F.md5(F.col("text").cast("binary")), 1, 4)
    return E.hamming_semi(_t(spark, d, "documents").select("doc_id", first.alias("h")), "h", _t(spark, d, "benchmark").select(first.alias("hash")), 3).select("doc_id")


# 2.7 and 2.8 scalar functions.


@query(f"SELECT page_id, {_host('url')} AS host, CASE WHEN starts_with(url, 'http://') OR starts_with(url, 'https://') THEN url ELSE 'http://' || url END AS full_url, regexp_extract(url, '^[^:]*://[^/?#]*([^?#]*)', 1) AS path FROM pages")
def url_hostname(spark, d):
    return _t(spark, d, "pages").select("page_id", T.hostname("url").alias("host"), T.ensure_url("url").alias("full_url"), T.url_path("url").alias("path"))


@query(f"WITH {_HOSTS} SELECT host, {_registered('host')} AS registered, {_stem('host')} AS stem, CAST(len(list_filter(string_split(regexp_extract(host, {_P}, 1), '.'), lambda x: x <> '')) AS INTEGER) AS depth FROM hosts")
def url_registered_domain(spark, d):
    h, s = F.col("host"), SETTINGS.suffixes
    hosts = _t(spark, d, "pages").select(T.hostname("url").alias("host")).distinct()
    return hosts.select("host", T.registered_domain(h, s).alias("registered"), T.domain_stem(h, s).alias("stem"), T.subdomain_depth(h, s).alias("depth"))


@query(f"""SELECT page_id, CAST(regexp_matches(url, '([0-9]{{1,3}}\\.){{3}}[0-9]{{1,3}}') AS INTEGER) AS having_ip, CAST(contains(url, '@') AS INTEGER) AS have_at_symbol, CAST(length(url) AS INTEGER) AS url_length,
  CAST(len(regexp_extract_all(regexp_extract(url, '^[^:]*://[^/?#]*([^?#]*)', 1), '/')) AS INTEGER) AS url_depth, CAST(regexp_matches(substr(url, 9), '//') AS INTEGER) AS redirection,
  CAST(contains({_host('url')}, 'http') AS INTEGER) AS http_domain, CAST(regexp_matches(lower(url), 'bit\\.ly|tinyurl|goo\\.gl|t\\.co|ow\\.ly') AS INTEGER) AS tiny_url, CAST(contains({_host('url')}, '-') AS INTEGER) AS prefix_suffix,
  CAST(len(regexp_extract_all(url, '[0-9]')) AS INTEGER) AS digit_count, CAST(len(regexp_extract_all(url, '[?=&%_@-]')) AS INTEGER) AS special_char_count,
  round(-list_sum(list_transform(list_distinct(string_split(url, '')), lambda c: (len(list_filter(string_split(url, ''), lambda x: x = c)) / length(url)::DOUBLE) * log2(len(list_filter(string_split(url, ''), lambda y: y = c)) / length(url)::DOUBLE))), 6) AS entropy
FROM pages""")
def url_shape_features(spark, d):
    shape = T.url_shape(F.col("url"), T.hostname("url"))
    return _t(spark, d, "pages").select("page_id", *(v.alias(k) for k, v in shape.items()))


@query(f"""SELECT page_id, array_to_string(list_sort({_tokens(f"regexp_extract({_host('url')}, {_P}, 1) || ' ' || {_label(_host('url'))} || ' ' || c_name")}), ' ') AS tokens FROM pages JOIN customer ON c_custkey = page_id""")
def brand_token_sets(spark, d):
    """Tokens of page hosts, as brands, with the names of customers."""
    rows = _t(spark, d, "pages").join(_t(spark, d, "customer"), F.col("c_custkey") == F.col("page_id"))
    return rows.select("page_id", F.array_join(F.array_sort(T.brand_tokens(T.hostname("url"), F.col("c_name"), SETTINGS.suffixes)), " ").alias("tokens"))


@query(f"SELECT page_id, {_looks('lower(url)')} AS plain, {_alnum('url')} AS alnum FROM pages")
def homoglyph_normalize(spark, d):
    return _t(spark, d, "pages").select("page_id", T.homoglyphs(F.col("url")).alias("plain"), T.alnum(F.col("url")).alias("alnum"))


@query(f"""WITH {_HOSTS} SELECT host, CAST(levenshtein({_stem('host')}, 'tiontion') AS INTEGER) AS distance, CAST(CASE WHEN contains({_alnum('host')}, 'theron') THEN 0 WHEN length({_alnum('host')}) <= 6 THEN levenshtein({_alnum('host')}, 'theron')
  ELSE list_min(list_transform(range(1, length({_alnum('host')}) - 4), lambda i: levenshtein(substr({_alnum('host')}, i, 6), 'theron'))) END AS INTEGER) AS window_distance, round({_ratio('host', _q('tiontion.com'))}, 6) AS ratio FROM hosts WHERE host <> ''""")
def edit_distances(spark, d):
    hosts = _t(spark, d, "pages").select(T.hostname("url").alias("host")).distinct().where("host <> ''")
    h = F.col("host")
    return hosts.select("host", F.levenshtein(T.domain_stem(h, SETTINGS.suffixes), F.lit("tiontion")).alias("distance"), S.min_window_distance(T.alnum(h), F.lit("theron")).alias("window_distance"), F.round(S.similarity(h, F.lit("tiontion.com")), 6).alias("ratio"))


_IPS = r"list_filter(regexp_extract_all(text, '\b((?:[0-9]{1,3}\.){3}[0-9]{1,3})\b', 1), lambda ip: list_bool_and(list_transform(string_split(ip, '.'), lambda o: o::INTEGER <= 255)))"


@query(f"SELECT doc_id, array_to_string(list_sort(list_distinct({_IPS})), ';') AS ips FROM documents WHERE len({_IPS}) > 0")
def ip_extract(spark, d):
    ips = T.ip_set(F.col("text"))
    return _t(spark, d, "documents").select("doc_id", ips.alias("i")).where(F.size("i") > 0).select("doc_id", F.array_join("i", ";").alias("ips"))


def _reputation_sql(x: str, kind: str) -> str:
    high, low = REPUTATION[kind]
    cases = " ".join(f"WHEN contains({x}, {_q(w)}) THEN {v}" for words, v in ((high, 8), (low, 4)) for w in words)
    return f"CASE WHEN {x} = '' THEN -1 {cases} ELSE 6 END"


_OWNER = "(CASE s_suppkey % 5 WHEN 0 THEN 'Amazon Technologies Inc.' WHEN 1 THEN 'NameCheap, Inc.' WHEN 2 THEN '' WHEN 3 THEN 'cloudflare' ELSE s_name END)"


@query(f"SELECT s_suppkey, {_reputation_sql(f'lower({_OWNER})', 'registrar')} AS registrar, {_reputation_sql(f'lower({_OWNER})', 'nameserver')} AS nameserver, {_reputation_sql(f'lower({_OWNER})', 'asn')} AS asn FROM supplier")
def reputation_scores(spark, d):
    owner = F.expr(_OWNER)
    return _t(spark, d, "supplier").select("s_suppkey", *(T.reputation(owner, k).alias(k) for k in ("registrar", "nameserver", "asn")))


@query("SELECT o_orderkey, CAST(greatest(date_diff('day', o_orderdate::DATE, DATE '1997-01-01'), 0) AS INTEGER) AS age, CAST(date_diff('day', DATE '1997-01-01', o_orderdate::DATE) AS INTEGER) AS expiry FROM orders")
def date_age_expiry(spark, d):
    day, at = F.to_date(F.lit("1997-01-01")), F.to_date("o_orderdate")
    return _t(spark, d, "orders").select("o_orderkey", D.age_days(at, day).alias("age"), D.expiry_days(at, day).alias("expiry"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 4 THEN DATE '2000-01-01' ELSE o_orderdate::DATE END AS day FROM orders")
def date_multi_format(spark, d):
    k, at = F.col("o_orderkey") % 5, F.col("o_orderdate")
    shown = F.when(k == 4, F.lit("none"))
    for i, f in enumerate(("yyyy-MM-dd", "dd-MM-yyyy", "dd/MM/yyyy", "yyyy/MM/dd")):
        shown = shown.when(k == i, F.date_format(at, f))
    return _t(spark, d, "orders").select("o_orderkey", D.observation_date(shown, F.to_date(F.lit("2000-01-01"))).alias("day"))


@query("""WITH e AS (SELECT CASE event_id % 6 WHEN 0 THEN 'A:NXDOMAIN' WHEN 1 THEN 'CNAME:Timeout' WHEN 2 THEN 'NoAnswer' WHEN 3 THEN 'socket:gaierror' WHEN 4 THEN '' ELSE event_type END AS x FROM events),
b AS (SELECT CASE WHEN x = '' THEN 'unknown' WHEN contains(lower(x), 'nxdomain') THEN 'nxdomain' WHEN contains(lower(x), 'timeout') THEN 'timeout' WHEN contains(lower(x), 'noanswer') THEN 'no_answer' WHEN contains(lower(x), 'gaierror') THEN 'socket_gaierror' ELSE substr(x, 1, 80) END AS bucket FROM e)
SELECT bucket, count(*) AS n FROM b GROUP BY bucket ORDER BY n DESC, bucket LIMIT 8""")
def dns_error_buckets(spark, d):
    x = F.expr("CASE event_id % 6 WHEN 0 THEN 'A:NXDOMAIN' WHEN 1 THEN 'CNAME:Timeout' WHEN 2 THEN 'NoAnswer' WHEN 3 THEN 'socket:gaierror' WHEN 4 THEN '' ELSE event_type END")
    return C.top_counts(_t(spark, d, "events").select(T.dns_error_bucket(x, F.lit("")).alias("bucket")), "bucket")


@query("SELECT doc_id, CASE WHEN contains(lower(text), 'phish') THEN 3 WHEN contains(lower(text), 'suspect') THEN 2 WHEN contains(lower(text), 'legit') THEN 1 ELSE 0 END AS priority, CASE quality WHEN 1 THEN 1 WHEN 0 THEN 0 END AS truth FROM documents LEFT JOIN labels USING (doc_id)")
def label_texts(spark, d):
    rows = _t(spark, d, "documents").join(_t(spark, d, "labels"), "doc_id", "left")
    said = F.when(F.col("quality") == 1, F.lit("Malicious site")).when(F.col("quality") == 0, F.lit("benign"))
    return rows.select("doc_id", T.label_priority(F.col("text")).alias("priority"), T.truth(said).alias("truth"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def json_extract(spark, d):
    return _t(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"))


@query(r"""SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) <> '' AS has_title, len(regexp_extract_all(html, '<a href="')) AS links FROM pages""")
def html_page_parts(spark, d):
    parts = _t(spark, d, "pages").select("page_id", P.page_parts("html").alias("p"))
    return parts.select("page_id", (F.col("p.title") != "").alias("has_title"), F.size("p.links").cast("long").alias("links"))


@query()
def dom_simhash(spark, d):
    return _t(spark, d, "pages").select("page_id", P.dom_hash("html").alias("dom_hash"))


_SUMS = ", ".join(f"sum(CASE WHEN (h >> {i}) & 1 = 1 THEN n ELSE -n END) AS b{i}" for i in range(64))
_BITS = " || ".join(f"CASE WHEN b{i} >= 0 THEN '1' ELSE '0' END" for i in reversed(range(64)))


@query(f"""WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents),
f AS (SELECT doc_id, unnest(w) AS f, 1 AS n FROM w UNION ALL SELECT doc_id, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])), 2 FROM w),
g AS (SELECT doc_id, ('0x' || substr(md5(f), 1, 16))::UBIGINT AS h, sum(n) AS n FROM f GROUP BY doc_id, f),
s AS (SELECT doc_id, {_SUMS} FROM g GROUP BY doc_id)
SELECT doc_id, CASE WHEN b0 IS NULL THEN '' ELSE {_BITS} END AS bits FROM documents LEFT JOIN s USING (doc_id)""")
def simhash_md5(spark, d):
    """Every document, of any length; bits are "" for a text without words."""
    rows = _t(spark, d, "documents").select("doc_id", H.simhash_md5("text").alias("h"))
    return rows.select("doc_id", F.when(F.col("h") == "", "").otherwise(F.lpad(F.conv("h", 16, 2), 64, "0")).alias("bits"))


# 2.5 and 2.6 aggregates, windows and set operators.


@query(f"SELECT {_host('url')} AS detected_domain, min(page_id) AS first_page, arg_min(url, page_id) AS url, arg_max(CASE page_id % 3 WHEN 0 THEN 'Suspected' WHEN 1 THEN 'Phishing' ELSE '' END, (CASE page_id % 3 WHEN 0 THEN 2 WHEN 1 THEN 3 ELSE 0 END) * 1000000000::BIGINT - page_id) AS source_label, coalesce(arg_min('r' || page_id, page_id) FILTER (WHERE page_id % 4 = 3), '') AS remarks FROM pages GROUP BY 1")
def context_merge(spark, d):
    rows = _candidates(spark, d).withColumn("source_label", F.expr("CASE ord % 3 WHEN 0 THEN 'Suspected' WHEN 1 THEN 'Phishing' ELSE '' END")).withColumn("remarks", F.expr("CASE WHEN ord % 4 = 3 THEN concat('r', ord) ELSE '' END"))
    merged = C.merge_contexts(rows)
    return merged.select("detected_domain", F.col("ord").alias("first_page"), "url", "source_label", F.coalesce("remarks", F.lit("")).alias("remarks"))


@query("""WITH r AS (SELECT doc_id, source, lang, CASE doc_id % 3 WHEN 0 THEN 'Unlabeled' WHEN 1 THEN 'Suspected' ELSE 'Phishing' END AS label, CASE doc_id % 3 WHEN 0 THEN 0 WHEN 1 THEN 2 ELSE 3 END AS p FROM documents),
k AS (SELECT source, lang, min(doc_id) AS ord, arg_max(label, p * 1000000000::BIGINT - doc_id) AS label FROM r GROUP BY source, lang)
SELECT * FROM k ORDER BY ord LIMIT 20""")
def collector_dedupe_cap(spark, d):
    rows = _t(spark, d, "documents").select("source", "lang", F.expr("CASE doc_id % 3 WHEN 0 THEN 'Unlabeled' WHEN 1 THEN 'Suspected' ELSE 'Phishing' END").alias("label"), F.col("doc_id").alias("ord"))
    return C.cap(C.dedupe_by_priority(rows, ["source", "lang"]), 20, "ord")


@query("SELECT doc_id AS id, text, lang FROM documents UNION ALL SELECT item_id, text, NULL FROM benchmark")
def union_sources(spark, d):
    return C.union_all(_t(spark, d, "documents").select(F.col("doc_id").alias("id"), "text", "lang"), _t(spark, d, "benchmark").select(F.col("item_id").alias("id"), "text"))


@query("SELECT source, min(doc_id) AS ord FROM documents GROUP BY source")
def distinct_ordered(spark, d):
    return C.first_of_each(_t(spark, d, "documents").select("source", F.col("doc_id").alias("ord")), ["source"])


@query(f"""WITH x AS (SELECT doc_id, source, unnest({_IPS}) AS ip FROM documents), c AS (SELECT ip, count(DISTINCT source) AS n FROM x GROUP BY ip)
SELECT doc_id, coalesce((SELECT max(CASE WHEN n > 1 THEN 1 ELSE 0 END) FROM x JOIN c USING (ip) WHERE x.doc_id = documents.doc_id), -1) AS shared FROM documents""")
def ip_brand_reuse(spark, d):
    rows = _t(spark, d, "documents").select(F.col("doc_id").alias("ord"), F.col("text").alias("resolved_ips"), F.col("source").alias("target_brand_domain"), F.lit("").alias("critical_sector_entity_name"))
    return N.mark_shared_ips(rows).select(F.col("ord").alias("doc_id"), F.col("ip_seen_with_many_brands").alias("shared"))


@query("SELECT doc_id, CAST(n AS INTEGER) AS domains FROM documents JOIN (SELECT md5(text) AS h, count(DISTINCT source) AS n FROM documents GROUP BY 1) ON md5(text) = h")
def campaign_count_batch(spark, d):
    rows = _t(spark, d, "documents").select("doc_id", F.md5(F.col("text").cast("binary")).alias("html_dom_hash"), F.col("source").alias("domain"))
    return N.campaign_counts(rows).select("doc_id", F.col("same_html_hash_domain_count_7d").alias("domains"))


@query("""WITH s AS (SELECT DISTINCT event_type AS hash, user_id AS domain, ts::DATE AS day FROM events)
SELECT a.hash, a.day, count(DISTINCT b.domain) AS domains FROM (SELECT DISTINCT hash, day FROM s) a JOIN s b ON a.hash = b.hash AND abs(date_diff('day', a.day, b.day)) <= 7 GROUP BY a.hash, a.day""")
def campaign_count_7d(spark, d):
    return N.campaign_counts_dated(_t(spark, d, "events"), "event_type", "user_id", "ts")


@query(f"""WITH c AS (SELECT substr(lang, 1, 2) AS k, page_id, {_registered(_host('url'))} AS r FROM (SELECT *, regexp_extract(html, '<html lang="([a-z]*)"', 1) AS lang FROM pages)),
p AS (SELECT k, r, lag(r) OVER (PARTITION BY k ORDER BY page_id) AS q FROM c) SELECT k, CAST(sum(CASE WHEN q <> '' AND r <> '' AND r <> q THEN 1 ELSE 0 END) AS BIGINT) AS changes FROM p GROUP BY k""")
def redirect_cross_domain(spark, d):
    rows = _t(spark, d, "pages").select(F.substring(F.regexp_extract("html", '<html lang="([a-z]*)"', 1), 1, 2).alias("k"), "page_id", "url")
    return C.registered_changes(rows, "k", "page_id", "url", SETTINGS.suffixes)


# 2.2, 2.3, 2.11 sinks, filters and rules.

_LINE = "l_orderkey, l_linenumber"
_FLAGS = {
    "lexical_similarity_score": "l_discount * 10", "dns_check_pass": "CAST(l_partkey % 4 <> 0 AS INT)", "page_fetch_success": "CAST(l_suppkey % 3 <> 0 AS INT)", "has_login_form": "CAST(l_orderkey % 3 = 0 AS INT)",
    "has_password_input": "CAST(l_orderkey % 6 = 0 AS INT)", "brand_token_or_logo_present": "CAST(l_partkey % 3 = 0 AS INT)", "visual_brand_domain_mismatch": "CAST(l_partkey % 9 = 0 AS INT)",
    "same_html_hash_domain_count_7d": "l_linenumber", "source_label": "CASE l_linenumber % 4 WHEN 0 THEN 'Phishing' WHEN 1 THEN 'Suspected' WHEN 2 THEN 'Legit' ELSE '' END",
}


@query(f"""WITH f AS (SELECT {_LINE}, {", ".join(f"{v} AS {k}" for k, v in _FLAGS.items())} FROM lineitem),
g AS (SELECT *, lexical_similarity_score >= 0.75 AS hi, dns_check_pass = 1 AS d, page_fetch_success = 1 AS fe, has_login_form = 1 AS lo, has_password_input = 1 AS pw, brand_token_or_logo_present = 1 AS br, visual_brand_domain_mismatch = 1 AS mi, same_html_hash_domain_count_7d > 2 AS ca, source_label = 'Phishing' AS sp FROM f),
r AS (SELECT *, CASE WHEN NOT hi THEN 'below_high_lexical_threshold' WHEN d AND ca AND pw THEN 'phishing_campaign' WHEN d AND ((pw AND br) OR mi) THEN 'phishing' WHEN sp THEN 'source_verified_phishing' WHEN NOT d AND NOT fe THEN 'suspected_inactive' WHEN d AND NOT fe THEN 'suspected_active_infra' WHEN d AND fe AND NOT lo AND NOT br THEN 'suspected_active_no_phish_evidence' ELSE 'suspected_unconfirmed' END AS validation_status FROM g),
l AS (SELECT *, CASE WHEN NOT hi THEN CAST(sp AS INTEGER) ELSE CAST(validation_status IN ('phishing_campaign', 'phishing', 'source_verified_phishing') AS INTEGER) END AS label FROM r)
SELECT {_LINE}, validation_status, label, CAST(hi AS INTEGER) AS include_in_ml, CAST((sp AND label = 0) OR (NOT sp AND label = 1 AND source_label IN ('Suspected', 'Legit')) AS INTEGER) AS label_conflict FROM l""")
def rule_labels(spark, d):
    rows = _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", *(F.expr(v).alias(k) for k, v in _FLAGS.items()))
    return R.label_rows(rows).select("l_orderkey", "l_linenumber", "validation_status", "label", "include_in_ml", "label_conflict")


_DECIDE = {"standard_prediction": "CAST(l_quantity > 40 AS INT)", "hardened_prediction": "CAST(l_tax > 0.04 AS INT)", "validation_status": "CASE l_linenumber % 3 WHEN 0 THEN 'phishing' WHEN 1 THEN 'suspected_inactive' ELSE 'below_high_lexical_threshold' END"}


@query(f"""WITH f AS (SELECT {_LINE}, {", ".join(f"{v} AS {k}" for k, v in _DECIDE.items())} FROM lineitem)
SELECT {_LINE}, CASE WHEN standard_prediction = 1 OR (validation_status = 'phishing' AND hardened_prediction = 1) THEN 'confirmed_phishing' WHEN hardened_prediction = 1 OR validation_status = 'suspected_inactive' THEN 'suspicious_needs_review' ELSE 'low_risk' END AS final_classification,
  CASE WHEN standard_prediction = 1 OR (validation_status = 'phishing' AND hardened_prediction = 1) THEN 'high' WHEN hardened_prediction = 1 THEN 'medium' ELSE 'low' END AS classification_confidence FROM f""")
def final_decisions(spark, d):
    rows = _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", *(F.expr(v).alias(k) for k, v in _DECIDE.items()))
    return R.final_decision(rows).select("l_orderkey", "l_linenumber", "final_classification", "classification_confidence")


@query(f"""WITH f AS (SELECT {_LINE}, {", ".join(f"{v} AS {k}" for k, v in _DECIDE.items())} FROM lineitem)
SELECT CASE WHEN standard_prediction = 1 OR (validation_status = 'phishing' AND hardened_prediction = 1) THEN 'confirmed_phishing' WHEN hardened_prediction = 1 OR validation_status = 'suspected_inactive' THEN 'suspicious_needs_review' ELSE 'low_risk' END AS final_classification, count(*) AS n FROM f GROUP BY 1""")
def classification_counts(spark, d):
    return reports.per_class(final_decisions(spark, d))


@query(f"SELECT {_LINE}, m AS model, s AS score, CAST(s >= t AS INTEGER) AS prediction FROM (SELECT {_LINE}, unnest(['standard', 'hardened']) AS m, unnest([l_discount, l_tax]) AS s, unnest([0.05, 0.04]) AS t FROM lineitem)")
def unpivot_scores(spark, d):
    rows = _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_discount").alias("standard_score"), F.lit(0.05).alias("standard_threshold"), (F.col("l_discount") >= 0.05).cast("int").alias("standard_prediction"), F.col("l_tax").alias("hardened_score"), F.lit(0.04).alias("hardened_threshold"), (F.col("l_tax") >= 0.04).cast("int").alias("hardened_prediction"))
    return learn.long_scores(rows, ["l_orderkey", "l_linenumber"], {"standard": 1, "hardened": 1}).select("l_orderkey", "l_linenumber", "model", "score", "prediction")


@query("SELECT o_orderkey, CASE WHEN o_orderstatus IN ('F', 'O') AND o_orderpriority LIKE '1%' THEN 'complete' ELSE 'partial' END AS status FROM orders")
def extraction_statuses(spark, d):
    named = F.when(F.col("o_orderstatus").isin("F", "O"), "success").otherwise("error")
    other = F.when(F.col("o_orderpriority").startswith("1"), "skipped").otherwise("timeout")
    return _t(spark, d, "orders").select("o_orderkey", R.extraction_status(named, other).alias("status"))


@query("SELECT o_orderkey, coalesce(c_acctbal > 0, false) AS ssl_valid, coalesce(nullif(c_mktsegment, 'BUILDING'), 'unknown') AS tls_status, coalesce(c_acctbal, -1) AS cert_age_days, false AS phishing, -1 AS label FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_custkey % 2 = 0")
def schema_enforce(spark, d):
    rows = _t(spark, d, "orders").join(_t(spark, d, "customer").where("c_custkey % 2 = 0"), F.col("o_custkey") == F.col("c_custkey"), "left")
    shown = rows.select("o_orderkey", (F.col("c_acctbal") > 0).alias("ssl_valid"), F.when(F.col("c_mktsegment") == "BUILDING", "").otherwise(F.col("c_mktsegment")).alias("tls_status"), F.col("c_acctbal").alias("cert_age_days"))
    wanted = ("ssl_valid", "tls_status", "cert_age_days", "phishing", "label")
    return C.enforce_schema(shown.withColumn("key", F.col("o_orderkey")), ("key", *wanted)).select(F.col("key").cast("long").alias("o_orderkey"), *wanted)


@query("""WITH r AS (SELECT doc_id, CASE WHEN quality = 0 THEN 'phishing' WHEN toxic = 1 THEN 'legitimate' ELSE 'unlabeled' END AS s, CASE WHEN doc_id % 7 = 0 THEN 'phishing_campaign' ELSE '' END AS v, CASE WHEN doc_id % 5 = 0 THEN 0 ELSE 1 END AS h FROM documents LEFT JOIN labels USING (doc_id))
SELECT doc_id, s = 'phishing' OR v = 'phishing_campaign' AS is_positive, h = 1 AND s <> 'legitimate' AND NOT (s = 'phishing' OR v = 'phishing_campaign') AS is_unlabeled FROM r""")
def pu_role_flags(spark, d):
    rows = _t(spark, d, "documents").join(_t(spark, d, "labels"), "doc_id", "left").select(
        "doc_id", F.expr("CASE WHEN quality = 0 THEN 'Phishing' WHEN toxic = 1 THEN 'legit' ELSE 'Unlabeled' END").alias("source_label"),
        F.expr("CASE WHEN doc_id % 7 = 0 THEN 'phishing_campaign' ELSE '' END").alias("validation_status"), F.expr("CASE WHEN doc_id % 5 = 0 THEN 0 ELSE 1 END").alias("high_lexical_similarity"),
    )
    return R.pu_roles(rows).select("doc_id", "is_positive", "is_unlabeled")


@query("SELECT unnest(['l_discount', 'l_linenumber', 'l_quantity', 'l_tax']) AS feature")
def numeric_feature_names(spark, d):
    rows = _t(spark, d, "lineitem").select("l_quantity", "l_discount", "l_tax", "l_linenumber", "l_returnflag", F.lit(3).alias("same"), F.lit(1).alias("label"))
    _, names = M.numeric_features(rows, ("label",))
    return spark.createDataFrame([(n,) for n in sorted(names)], "feature string")


# 2.13 metrics and folds.

_SCORED = "SELECT doc_id, quality AS y, least(n_chars / 4000.0::DOUBLE, 1.0) AS s FROM labels JOIN documents USING (doc_id)"
_GRID = _values([(i, x) for i, x in enumerate(threshold_grid())], "g(k, threshold)").replace("AS g", "g")
_SWEEP = f"""WITH s AS ({_SCORED}), g AS (SELECT * FROM {_GRID}),
c AS (SELECT k, CAST(threshold AS DOUBLE) AS threshold, count(*) FILTER (WHERE y = 1 AND s >= threshold) AS tp, count(*) FILTER (WHERE y = 0 AND s >= threshold) AS fp, count(*) FILTER (WHERE y = 0 AND s < threshold) AS tn, count(*) FILTER (WHERE y = 1 AND s < threshold) AS fn FROM g, s GROUP BY ALL),
m AS (SELECT *, CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp::DOUBLE / (tp + fp) END AS p, CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp::DOUBLE / (tp + fn) END AS r FROM c),
w AS (SELECT *, CASE WHEN p + r = 0 THEN 0.0 ELSE 2 * p * r / (p + r) END AS f1 FROM m) """


def _scored(spark, d):
    rows = _t(spark, d, "labels").join(_t(spark, d, "documents"), "doc_id")
    return rows.select("doc_id", F.col("quality").alias("y"), F.least(F.col("n_chars") / 4000.0, F.lit(1.0)).alias("s"))


@query(f"WITH s AS ({_SCORED}) SELECT count(*) FILTER (WHERE y = 1 AND s >= 0.5) AS tp, count(*) FILTER (WHERE y = 0 AND s >= 0.5) AS fp, count(*) FILTER (WHERE y = 0 AND s < 0.5) AS tn, count(*) FILTER (WHERE y = 1 AND s < 0.5) AS fn, round(count(*) FILTER (WHERE (y = 1) = (s >= 0.5)) / count(*)::DOUBLE, 6) AS accuracy FROM s")
def confusion_counts(spark, d):
    rows = _scored(spark, d).withColumn("p", (F.col("s") >= 0.5).cast("int"))
    return M.confusion(rows, "y", "p").select("tp", "fp", "tn", "fn", F.round("accuracy", 6).alias("accuracy"))


@query(_SWEEP + "SELECT k, tp, fp, tn, fn, round(f1, 6) AS f1 FROM w")
def threshold_sweeps(spark, d):
    return M.threshold_sweep(_scored(spark, d), "y", "s").select("k", "tp", "fp", "tn", "fn", F.round("f1", 6).alias("f1"))


@query(_SWEEP + "SELECT k, tp, fp, tn, fn FROM w ORDER BY (r >= 0.95)::INT DESC, CASE WHEN r >= 0.95 THEN p ELSE f1 END DESC, CASE WHEN r >= 0.95 THEN f1 ELSE r END DESC, CASE WHEN r >= 0.95 THEN 0 ELSE p END DESC, CASE WHEN r >= 0.95 THEN -k ELSE k END LIMIT 1")
def threshold_choice(spark, d):
    return M.choose_threshold(M.threshold_sweep(_scored(spark, d), "y", "s"), 0.95).select("k", "tp", "fp", "tn", "fn")


@query(f"WITH s AS ({_SCORED}), c AS (SELECT least(quantile_cont(s, 0.3), 0.3) AS cutoff FROM s WHERE y = 0) SELECT doc_id FROM s, c WHERE y = 0 AND s <= cutoff")
def reliable_negative_rows(spark, d):
    marked = M.reliable_negatives(_scored(spark, d).where("y = 0"), "s", "doc_id", 0.3, 0.3, 0)
    return marked.where("is_reliable").select("doc_id")


@query(f"WITH s AS ({_SCORED}) SELECT doc_id, CAST((row_number() OVER (PARTITION BY y ORDER BY md5('42:' || doc_id), doc_id) - 1) % 5 AS INTEGER) AS fold FROM s")
def kfold_assign(spark, d):
    return M.assign_folds(_scored(spark, d), "y", "doc_id", 5, 42).select("doc_id", "fold")


@query("""WITH g AS (SELECT DISTINCT coalesce(source, '') AS g FROM documents), r AS (SELECT g, row_number() OVER (ORDER BY md5('42:' || g), g) <= ceil(count(*) OVER () * 0.25) AS is_test FROM g)
SELECT doc_id, is_test FROM documents JOIN r ON coalesce(source, '') = g""")
def group_holdout_split(spark, d):
    return M.group_holdout(_t(spark, d, "documents").select("doc_id", "source"), "source", 0, 42).select("doc_id", "is_test")


@query(f"""WITH s AS ({_SCORED}), f AS (SELECT *, (row_number() OVER (PARTITION BY y ORDER BY md5('42:' || doc_id), doc_id) - 1) % 5 AS fold FROM s),
a AS (SELECT fold, count(*) FILTER (WHERE (y = 1) = (s >= 0.5)) / count(*)::DOUBLE AS accuracy FROM f GROUP BY fold) SELECT round(avg(accuracy), 6) AS accuracy_mean, round(stddev_pop(accuracy), 6) AS accuracy_std FROM a""")
def fold_metric_summary(spark, d):
    rows = M.assign_folds(_scored(spark, d), "y", "doc_id", 5, 42).withColumn("p", (F.col("s") >= 0.5).cast("int"))
    out = M.fold_summary(M.confusion(rows, "y", "p", "fold"))
    return out.select(F.round("accuracy_mean", 6).alias("accuracy_mean"), F.round("accuracy_std", 6).alias("accuracy_std"))


@query()
def pu_train_score(spark, d):
    """Train on document features, with low quality as the positive class, and score all documents."""
    rows = _t(spark, d, "documents").join(_t(spark, d, "labels"), "doc_id", "left").select(
        F.col("doc_id").alias("row_key"), F.expr("CASE WHEN quality = 0 AND doc_id % 4 <> 0 THEN 'phishing' ELSE 'unlabeled' END").alias("source_label"), F.length("text").alias("length"),
        *(F.regexp_count("text", F.lit(p)).alias(n) for n, p in (("uppers", "[A-Z]"), ("signs", "[#$%&*!|]"), ("spaces", " "), ("stops", r"\."))),
    )
    trained = learn.train(rows, Settings(), tries=10)
    return trained.scored.select(F.col("row_key").alias("doc_id"), "pu_training_role", F.round("pu_score", 6).alias("pu_score"), "pu_prediction")


# Functions on texts made of the tables' columns.


@query(r"SELECT page_id, regexp_extract(lower(url), '^([^:]*://[^/?#]*)', 1) || ':8080' AS origin, regexp_replace(regexp_extract(url, '^[^:]*://([^/?#]*[^?#]*)', 1).lower(), '[^a-z0-9]+', '', 'g') AS url_alnum FROM pages")
def url_origins(spark, d):
    """The origin of each URL with a port put in, and the letters and digits of its host and path."""
    ported = F.regexp_replace("url", "^([^:]*://[^/?#]*)", "$1:8080")
    return _t(spark, d, "pages").select("page_id", T.origin(ported).alias("origin"), T.url_alnum("url").alias("url_alnum"))


@query(f"SELECT page_id, CASE page_id % 3 WHEN 0 THEN '10.0.0.' || page_id % 256 WHEN 1 THEN '' ELSE ' 10.1.1.1 ' END AS first_ip, [{_host('url')}, 'b.example.org', 'c.example.org'] AS hosts FROM pages")
def cell_lists(spark, d):
    """The first address of a list and the hosts of a cell with several separators."""
    ips = F.expr("CASE page_id % 3 WHEN 0 THEN concat(' ;10.0.0.', page_id % 256, ';10.9.9.9') WHEN 1 THEN NULL ELSE ' 10.1.1.1 ;' END")
    cell = F.concat("url", F.lit(" ; (b.example.org)|WWW.C.example.org, "))
    return _t(spark, d, "pages").select("page_id", T.first_ip(ips).alias("first_ip"), T.split_hosts(cell).alias("hosts"))


@query("SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'Suspected' WHEN contains(source, '1') THEN 'Phishing' WHEN contains(source, '2') THEN 'Unlabeled' ELSE '' END AS label, CASE doc_id % 7 WHEN 0 THEN 1 WHEN 1 THEN 0 WHEN 3 THEN 1 WHEN 4 THEN 0 END AS truth FROM documents")
def label_inference(spark, d):
    """Labels from file names where none is given, and truths from texts."""
    rows = _t(spark, d, "documents")
    file = F.when(F.col("source").contains("1"), "PhishTank.csv").when(F.col("source").contains("2"), "dnstwist_out.csv").otherwise(F.col("source"))
    said = F.expr("CASE doc_id % 7 WHEN 0 THEN ' Phishing ' WHEN 1 THEN 'legitimate' WHEN 2 THEN 'Suspected' WHEN 3 THEN 'TRUE' WHEN 4 THEN 'no' WHEN 5 THEN '' END")
    return rows.select("doc_id", T.inferred_label(F.expr("CASE WHEN doc_id % 4 = 0 THEN ' Suspected' ELSE 'nan' END"), file).alias("label"), T.truth(said).alias("truth"))


@query("""SELECT doc_id, strftime(TIMESTAMP '2020-01-01' + to_days(CAST(doc_id % 900 AS INTEGER)), '%Y-%m-%d') AS created, 'reg' || doc_id % 5 AS registrar,
  CAST(greatest(datediff('day', TIMESTAMP '2020-01-01' + to_days(CAST(doc_id % 900 AS INTEGER)), TIMESTAMP '2022-01-01'), 0) AS INTEGER) AS age, CAST(CASE WHEN doc_id % 2 = 0 THEN doc_id % 900 - 731 ELSE -1 END AS INTEGER) AS expires_in FROM documents""")
def registry_answers(spark, d):
    """Registration answers, as JSON texts made of ids, and their exact ages."""
    day = F.expr("date_format(date_add(DATE'2020-01-01', cast(doc_id % 900 AS int)), 'yyyy-MM-dd')")
    end = F.when(F.col("doc_id") % 2 == 0, F.concat(day, F.lit("T00:00:00Z"))).otherwise("soon")
    text = F.concat(F.lit('{"events":[{"eventAction":"expiration","eventDate":"'), end, F.lit('"},{"eventAction":"registration","eventDate":"'), day, F.lit('T00:00:00Z"}],"registrarName":"reg'), F.col("doc_id") % 5, F.lit('"}'))
    rows = _t(spark, d, "documents").select("doc_id", G.answer(text).alias("a")).select("doc_id", G.created(F.col("a")).alias("created"), G.expires(F.col("a")).alias("end"), G.registrar(F.col("a")).alias("registrar"))
    now = F.lit("2022-01-01 00:00:00").cast("timestamp")
    created = F.date_format("created", "yyyy-MM-dd").alias("created")
    return rows.select("doc_id", created, "registrar", D.age_exact(F.col("created"), now).alias("age"), D.expiry_exact(F.col("end"), now).alias("expires_in"))


@query(f"WITH s AS ({_SCORED}) SELECT count(*) FILTER (WHERE y = 1 AND s >= 0.4) AS tp, count(*) FILTER (WHERE y = 0 AND s < 0.4) AS tn, min(s) FILTER (WHERE y = 1) AS positive_score_min, max(s) FILTER (WHERE y = 0) AS negative_score_max FROM s")
def metric_summaries(spark, d):
    return M.metric_summary(_scored(spark, d), "y", "s", 0.4).select("tp", "tn", "positive_score_min", "negative_score_max")


@query(f"SELECT page_id FROM pages WHERE {_host('url')} IN (SELECT {_host('url')} FROM pages WHERE page_id % 10 = 3)")
def listed_hosts(spark, d):
    rows = _t(spark, d, "pages").select("page_id", "url")
    return reports.hosts_in(rows, rows.where("page_id % 10 = 3").select(F.col("url").alias("host"))).select("page_id")


@query("""SELECT page_id, 'in-' || page_id AS form, page_id % 2 = 0 AS has_password, 'hello brand ' || page_id AS meta, CASE WHEN page_id % 3 = 0 THEN '/fav.ico' END AS icon, 'logo' || page_id || '.png' AS image, len(regexp_extract_all(html, '<a href="')) AS links FROM pages""")
def html_form_parts(spark, d):
    """Forms, password fields, meta texts, icons and images, in pages with such a head put before them."""
    head = F.concat(F.lit('<form action="in-'), F.col("page_id"), F.lit('"><input type="'), F.expr("CASE WHEN page_id % 2 = 0 THEN 'Password' ELSE 'text' END"), F.lit('"></form><meta name="description" content="Hello Brand '), F.col("page_id"), F.lit('"><img src="logo'), F.col("page_id"), F.lit('.png" alt="x">'), F.expr("""CASE WHEN page_id % 3 = 0 THEN '<link rel="shortcut ICON" href="/fav.ico">' ELSE '' END"""))
    parts = _t(spark, d, "pages").select("page_id", P.page_parts(F.concat(head, "html")).alias("p"))
    return parts.select("page_id", F.get("p.forms", F.lit(0)).alias("form"), "p.has_password", "p.meta", "p.icon", F.get("p.images", F.lit(0))["src"].alias("image"), F.size("p.links").cast("long").alias("links"))


@query(f"SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'active' ELSE 'failed' END AS side, CASE page_id % 3 WHEN 0 THEN '' WHEN 1 THEN 'NXDOMAIN' ELSE 'error' END AS dns_status FROM pages")
def dns_split_rows(spark, d):
    """DNS evidence for two rows of three by host and page: one resolves, one fails, one is not there."""
    rows = _candidates(spark, d).withColumn("detected_domain", F.concat(F.lit("p"), F.col("ord"), F.lit("."), F.col("detected_domain")))
    known = rows.where("ord % 3 <> 2").select(F.col("detected_domain").alias("host"), F.expr("CASE WHEN ord % 3 = 0 THEN 'ok' ELSE 'NXDOMAIN' END").alias("status"), F.expr("CASE WHEN ord % 3 = 0 THEN 1 ELSE 0 END").alias("dns_check_pass"), F.lit(0).alias("dns_resolves_to_ip"), F.lit("").alias("resolved_ips"), F.lit(0).alias("cname_exists"), F.lit(0).alias("cname_chain_length"), F.lit("").alias("dns_error"))
    active, failed = C.dns_split(rows, known)
    both = active.select("source_row", F.lit("active").alias("side"), F.lit("").alias("dns_status")).union(failed.select("source_row", F.lit("failed"), "dns_status"))
    return both.select(F.col("source_row").cast("long").alias("page_id"), "side", "dns_status")


@query(f"WITH s AS ({_SCORED}) SELECT doc_id, CASE WHEN s >= 0.9 THEN 'urgent' WHEN s >= 0.7 THEN 'high' WHEN s >= 0.4 THEN 'medium' ELSE 'low' END AS band FROM s")
def review_bands(spark, d):
    rows = _scored(spark, d).select("doc_id", F.col("s").alias("pu_score"), F.col("doc_id").cast("string").alias("url"))
    return reports.for_review(rows).select("doc_id", "band")


@query(f"WITH s AS ({_SCORED}), n AS (SELECT *, row_number() OVER (ORDER BY s, doc_id) AS k, count(*) OVER () AS c FROM s WHERE y = 0) SELECT doc_id FROM n WHERE k <= 30")
def reliable_negative_fallback(spark, d):
    """A cutoff that no score is under, so that the lowest 30 are taken."""
    marked = M.reliable_negatives(_scored(spark, d).where("y = 0"), "s", "doc_id", 0.3, -1.0, 30)
    return marked.where("is_reliable").select("doc_id")


@query("SELECT 'both' AS agreement, page_id FROM pages WHERE page_id % 6 = 0 UNION ALL SELECT 'hardened', page_id FROM pages WHERE page_id % 6 IN (2, 4)")
def model_agreement(spark, d):
    """Rows that both models accept, and those that only the hardened one accepts."""
    rows = _t(spark, d, "pages").select(F.col("page_id").cast("string").alias("url"), F.lit("").alias("target_brand_domain"), F.lit(0.5).alias("standard_score"), F.lit(0.5).alias("hardened_score"), F.lit("").alias("validation_status"), F.expr("int(page_id % 3 = 0)").alias("standard_prediction"), F.expr("int(page_id % 2 = 0)").alias("hardened_prediction"))
    out = reports.both_models(rows).select(F.lit("both").alias("agreement"), "url").union(reports.hardened_only(rows).select(F.lit("hardened"), "url"))
    return out.select("agreement", F.col("url").cast("long").alias("page_id"))


@query(f"SELECT page_id, CASE WHEN page_id % 3 = 0 THEN regexp_extract(url, '^([^:]*://[^/?#]*)', 1) || '/fav.ico' ELSE regexp_extract(url, '^([^:]*://[^/?#]*)', 1) || '/favicon.ico' END AS icon FROM pages")
def favicon_urls(spark, d):
    return _t(spark, d, "pages").select("page_id", P.favicon_url(F.col("url"), F.expr("CASE WHEN page_id % 3 = 0 THEN '/fav.ico' END")).alias("icon"))


# Rules, chains, stores and cascades, on keys and answers made of the tables' columns.

RULES = ["com", "uk", "co.uk", "nl", "nz", "co.nz", "*.ck", "!www.ck", "jp", "*.kawasaki.jp", "!city.kawasaki.jp"]
ENDINGS = ["com", "co.uk", "uk", "nl", "co.nz", "geek.nz", "shop.ck", "www.ck", "other.kawasaki.jp", "city.kawasaki.jp", "local"]
_ENDING = "(CASE page_id % 11 " + " ".join(f"WHEN {i} THEN {_q(e)}" for i, e in enumerate(ENDINGS)) + " END)"
_RULED = f"""
WITH rules AS (SELECT regexp_replace(rule, '^(\\*\\.|!)', '') AS name, CASE WHEN rule LIKE '*.%' THEN 1 WHEN rule LIKE '!%' THEN -1 ELSE 0 END AS more FROM {_values([(r,) for r in RULES], "r(rule)")}),
hosts AS (SELECT page_id, {_label(_host('url'))} || '.p' || page_id || '.' || {_ENDING} AS host FROM pages),
parts AS (SELECT page_id, host, string_split(host, '.') AS l FROM hosts),
ends AS (SELECT page_id, host, l, unnest(range(1, len(l) + 1)) AS n FROM parts),
fits AS (SELECT page_id, max_by(n + more, (more < 0)::INT * 1000 + n + more) AS k FROM ends JOIN rules ON name = array_to_string(l[len(l) - n + 1:], '.') WHERE n + more <= len(l) GROUP BY page_id)
"""


def _ruled_hosts(spark, d):
    ending = F.expr(_ENDING)
    label = T.domain_label(T.hostname("url"), SETTINGS.suffixes)
    return _t(spark, d, "pages").select("page_id", F.concat(label, F.lit(".p"), "page_id", F.lit("."), ending).alias("host"))


@query(_RULED + "SELECT page_id, host, array_to_string(l[greatest(1, len(l) - k):], '.') AS registered_domain, greatest(0, len(l) - k - 1)::INTEGER AS depth FROM parts JOIN (SELECT page_id, coalesce(k, len(l)) AS k FROM parts LEFT JOIN fits USING (page_id)) USING (page_id) WHERE k < len(l) UNION ALL SELECT page_id, host, host, greatest(0, len(l) - 1)::INTEGER FROM parts WHERE page_id NOT IN (SELECT page_id FROM fits)")
def public_suffixes(spark, d):
    """Registered domains by rules with wildcards and exceptions, of hosts with endings of every kind."""
    rules = suffix_rules(spark.createDataFrame([("\n".join(RULES),)], "value string"))
    hosts = _ruled_hosts(spark, d)
    parts = host_parts(hosts, rules)
    depth = F.size(F.filter(F.split("subdomain", r"\."), lambda x: x != "")).alias("depth")
    return hosts.join(parts, "host").select("page_id", "host", "registered_domain", depth)


@query("""WITH RECURSIVE chain AS (SELECT page_id AS id, page_id AS cur, [page_id] AS seen, 0 AS n FROM pages WHERE page_id > 0
  UNION ALL SELECT id, CASE WHEN cur % 13 = 0 THEN cur + 1 ELSE cur // 2 END, list_append(seen, CASE WHEN cur % 13 = 0 THEN cur + 1 ELSE cur // 2 END), n + 1
  FROM chain WHERE cur > 1 AND cur % 7 <> 0 AND n < 10 AND NOT list_contains(seen[2:], CASE WHEN cur % 13 = 0 THEN cur + 1 ELSE cur // 2 END))
SELECT id AS page_id, max(n)::INTEGER AS aliases, max_by(cur, n) AS last FROM chain GROUP BY id""")
def alias_chain_ends(spark, d):
    """Each page's host is an alias of that of half its number (or of the next, which may close a loop); multiples of 7 fail."""
    ids = _t(spark, d, "pages").select("page_id").where("page_id > 0")
    target = F.when(F.col("id") % 13 == 0, F.col("id") + 1).otherwise(F.floor(F.col("id") / 2))

    def ask(names: DataFrame) -> DataFrame:
        rows = names.withColumn("id", F.substring_index("name", "h", -1).cast("long"))
        goes = (F.col("id") > 1) & (F.col("id") % 7 != 0)
        return rows.select("name", "kind", F.when(goes, F.array(F.concat(F.lit("H"), target, F.lit(".")))).alias("values"), F.when(goes, "").otherwise(F.when(F.col("id") % 7 == 0, "LifetimeTimeout").otherwise("NoAnswer")).alias("error"))

    chains, _ = alias_chains(ids.select(F.concat(F.lit("h"), "page_id").alias("host")), ask)
    last = F.when(F.size("aliases") > 0, F.element_at("aliases", -1)).otherwise(F.col("host"))
    return chains.select(F.substring_index("host", "h", -1).cast("long").alias("page_id"), F.size("aliases").alias("aliases"), F.substring_index(last, "h", -1).cast("long").alias("last"))


@query("""SELECT page_id, CASE WHEN (page_id // 4) % 5 = 4 AND page_id // 4 * 4 + 3 <= n THEN page_id WHEN page_id // 4 * 4 + 3 > n THEN page_id ELSE page_id // 4 * 4 + 3 END AS final,
  CASE WHEN page_id // 4 * 4 + 3 > n THEN 'NotFetched' WHEN (page_id // 4) % 5 = 4 THEN 'TooManyRedirects' ELSE '' END AS error,
  CASE WHEN page_id // 4 * 4 + 3 > n OR (page_id // 4) % 5 = 4 THEN 0 ELSE 3 - page_id % 4 END::INTEGER AS hops, CASE WHEN page_id // 4 * 4 + 3 > n OR (page_id // 4) % 5 = 4 THEN 0 ELSE 3 - page_id % 4 END::INTEGER AS crossings
FROM pages, (SELECT max(page_id) AS n FROM pages)""")
def redirect_ends(spark, d):
    """Pages in fours: each leads to the next by another domain, up to the fourth; every fifth four is a loop; the last may be cut."""
    url = lambda i: F.concat(F.lit("http://w.site"), i % 3, F.lit(".com/"), i)
    i = F.col("page_id")
    goes = F.when(i % 4 != 3, url(i + 1)).when(F.floor(i / 4) % 5 == 4, url(i - 3))
    hops = _t(spark, d, "pages").select(url(i).alias("url"), goes.alias("next"), F.when(goes.isNull(), 200).otherwise(302).alias("status_code"), "html", F.lit("text/html").alias("content_type"), F.lit("").alias("error"))
    ends = redirect_chains(hops, SETTINGS.suffixes)
    number = lambda c: F.substring_index(c, "/", -1).cast("long")
    return ends.select(number("url").alias("page_id"), number("final_url").alias("final"), "error", F.col("redirect_count").alias("hops"), F.col("redirect_cross_domain_count").alias("crossings"))


@query(f"""WITH {_HOSTS}, n AS (SELECT count(*) FILTER (WHERE length(host) % 2 = 0) AS half, count(*) AS all_ FROM hosts WHERE host <> '')
SELECT host, 'ip-' || length(host) AS ips, half AS first_asked, all_ - half AS then_asked, half AS then_hits, 0::BIGINT AS last_asked FROM hosts, n WHERE host <> ''""")
def evidence_from_store(spark, d):
    """Hosts of even length are asked for and stored; then all hosts, which asks for the others only; then all again."""
    schema = "host string, resolved_ips string, status string"
    hosts = _t(spark, d, "pages").select(T.hostname("url").alias("host"))
    store = EvidenceStore(spark, new_path(spark, "evidence"), "2026-01-01")
    ask = lambda keys: keys.select("host", F.concat(F.lit("ip-"), F.length("host")).alias("resolved_ips"), F.lit("success").alias("status"))
    first = store.serve(hosts.where(F.length("host") % 2 == 0), "dns", "host", schema, ask)
    then = store.serve(hosts, "dns", "host", schema, ask)
    last = store.serve(hosts, "dns", "host", schema, ask)
    counts = {"first_asked": first.asked, "then_asked": then.asked, "then_hits": then.hits, "last_asked": last.asked}
    return last.table.select("host", F.col("resolved_ips").alias("ips"), *(F.lit(n).cast("long").alias(k) for k, n in counts.items()))


@query("""SELECT page_id, CASE WHEN page_id % 5 = 4 THEN 'unavailable' WHEN page_id % 7 = 0 THEN 'not_found' WHEN page_id % 7 = 1 THEN 'rate_limited' WHEN page_id % 7 = 2 THEN 'error' ELSE 'success' END AS rdap_status,
  CASE WHEN page_id % 5 <> 4 AND page_id % 7 > 2 THEN 'rdap' ELSE 'whois' END AS source,
  CASE WHEN page_id % 5 <> 4 AND page_id % 7 > 2 THEN 'skipped' WHEN page_id % 2 = 0 THEN 'success' ELSE 'error' END AS whois_status,
  CASE WHEN page_id % 5 <> 4 AND page_id % 7 > 2 THEN 2000 + page_id % 20 WHEN page_id % 2 = 0 THEN 1999 ELSE 0 END::INTEGER AS created FROM pages""")
def registration_cascade(spark, d):
    """Registries that answer, know nothing, limit or fail by page number; the fallback knows even numbers."""
    tld = F.expr("CASE page_id % 5 WHEN 0 THEN 'com' WHEN 1 THEN 'co.uk' WHEN 2 THEN 'nl' WHEN 3 THEN 'co.nz' ELSE 'jp' END")
    domains = _t(spark, d, "pages").select(F.concat(F.lit("d"), "page_id", F.lit("."), tld).alias("registered_domain"))
    bootstrap = spark.createDataFrame([("com", "https://a"), ("uk", "https://b"), ("nl", "https://c"), ("co.nz", "https://d")], "tld string, server string")

    def client(server: str, domain: str) -> tuple[int, str]:
        n = int(domain[1:].split(".")[0])
        if n % 7 == 2:
            raise ConnectionError
        return {0: 404, 1: 429}.get(n % 7, 200), '{"events":[{"eventAction":"registration","eventDate":"%d-05-01T00:00:00Z"}]}' % (2000 + n % 20)

    def fallback(domain: str) -> dict:
        if int(domain[1:].split(".")[0]) % 2:
            raise ValueError("no match")
        return {"creation_date": datetime(1999, 1, 2), "nameservers": "NS1.a."}

    rules = suffix_rules(spark.createDataFrame([("\n".join(RULES),)], "value string"))
    found = registrations(domains, bootstrap, rules, client, fallback, fallback_pause=0.0, lanes=4, backoff=0.0)
    return found.select(F.regexp_extract("registered_domain", r"^d(\d+)\.", 1).cast("long").alias("page_id"), "rdap_status", "source", "whois_status", F.coalesce(F.year("creation_date"), F.lit(0)).alias("created"))
