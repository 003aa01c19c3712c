"""Joins with evidence tables and the wide feature rows.

What other systems find out by asking the network comes in as tables, one for each kind of probe, keyed by host,
registered domain, URL, origin or address.  A missing table or row gives the defaults of a probe that failed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import LOGIN_TERMS as LOGIN
from ..config import UNKNOWN, Settings
from ..functions import dates as D
from ..functions import html as H
from ..functions import registry as R
from ..functions import text as T
from ..functions.hashing import hash_number, hash_similarity, image_hashes
from ..storage import keep
from .hosts import registered_domains, resolve

DNS = "host string, dns_check_pass int, dns_resolves_to_ip int, resolved_ips string, cname_exists int, cname_chain_length int, dns_error string, status string"
TLS = "host string, https_enabled int, ssl_valid int, cert_age_days int, ct_log_first_seen_days int, tls_error string, status string"
REGISTRATION = "registered_domain string, creation_date timestamp, expiration_date timestamp, registrant_name string, registrar_name string, nameservers array<string>, source string, error string, rdap_status string, whois_status string"
HTTP = "url string, html string, final_url string, status_code int, fetch_success int, redirect_count int, redirect_cross_domain_count int, content_type string, error string, status string"
HOSTING = "ip string, asn_org string, status string, error string"
ASSETS = "origin string, favicon_url string, favicon binary, logo binary"
LEXICAL = (
    "lexical_similarity_score", "min_edit_distance_to_brand_domain", "homoglyph_similarity_score", "brand_token_in_subdomain", "brand_token_in_path",
    "brand_not_in_registered_domain", "subdomain_depth", "matched_brand_domain", "registered_domain",
)
TABLES = {"dns": DNS, "tls": TLS, "registration": REGISTRATION, "http": HTTP, "hosting": HOSTING, "assets": ASSETS}


def evidence(spark, given: dict[str, DataFrame] | None) -> dict[str, DataFrame]:
    """Every table of evidence; those that are not given are empty."""
    given = given or {}
    return {k: given[k] if k in given else spark.createDataFrame([], v) for k, v in TABLES.items()}


def lookup(rows: DataFrame, table: DataFrame, key: str, on: Column, prefix: str) -> DataFrame:
    """``rows`` with the table's columns under a prefix, by one row for each key of the table (the least by its columns, of
    which maps and variants are ordered by their JSON text).  The memo of a prober is this: an equi-join on the key,
    each key once."""
    rest = [c for c in table.columns if c != key]
    ordered = [F.to_json(F.struct(c)) if "map<" in kind or "variant" in kind else F.col(c) for c, kind in table.dtypes if c != key]
    one = table.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(*ordered)).alias("_v"))
    named = one.select(F.col(key).alias(f"_{prefix}key"), *(F.col(f"_v.{c}").alias(f"{prefix}{c}") for c in rest))
    return rows.join(named, on == F.col(f"_{prefix}key"), "left").drop(f"_{prefix}key")


def fill(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """A row for each key of ``first``; its null columns are filled from ``second``, as a fallback source does."""
    rest = [c for c in first.columns if c != key]
    joined = first.join(second.select(key, *(F.col(c).alias(f"_{c}") for c in rest)), key, "left")
    return joined.select(key, *(F.coalesce(c, f"_{c}").alias(c) for c in rest))


def registration_from_answers(answers: DataFrame) -> DataFrame:
    """Registration evidence from (registered_domain, http_status, answer JSON) of a registry's RDAP service."""
    a = R.answer(F.col("answer"))
    rows = answers.withColumn("a", a)
    status = F.when(F.col("http_status") == 404, "not_found").when(F.col("http_status") == 429, "rate_limited").when(F.col("http_status") == 200, "success").otherwise(F.concat(F.lit("http_"), F.col("http_status").cast("string")))
    a = F.col("a")
    return rows.select(
        "registered_domain", R.created(a).alias("creation_date"), R.expires(a).alias("expiration_date"), R.registrant(a).alias("registrant_name"), R.registrar(a).alias("registrar_name"),
        R.nameservers(a).alias("nameservers"), F.lit("rdap").alias("source"), F.lit("").alias("error"), status.alias("rdap_status"), F.lit("skipped").alias("whois_status"),
    )


def hosting_from_answers(answers: DataFrame) -> DataFrame:
    """Hosting evidence from (ip, http_status, answer JSON, error) of an address registry's RDAP service."""
    rows = answers.where("ip <> ''").withColumn("a", R.answer(F.col("answer")))
    owner, http = F.coalesce(R.address_owner(F.col("a")), F.lit("")), F.col("http_status")
    wrong = F.concat(F.lit("http_"), http.cast("string"))
    status = F.when(F.coalesce("error", F.lit("")) != "", "error").when(http != 200, wrong).when(owner != "", "success").otherwise("not_found")
    said = F.when(F.coalesce("error", F.lit("")) != "", F.col("error")).when(http != 200, F.concat(F.lit("HTTP "), http.cast("string"))).otherwise("")
    return rows.select("ip", F.when(http == 200, owner).otherwise("").alias("asn_org"), F.coalesce(status, F.lit("error")).alias("status"), said.alias("error"))


def hash_references(references: DataFrame, hash_col: str, suffixes: T.Suffixes | DataFrame) -> DataFrame:
    """(key, hash) of brand references: under the host and under its registered domain."""
    host = F.col("_host")
    references, (known,) = resolve(references.withColumn("_host", T.hostname("domain")), {"_sh": host}, suffixes)
    keyed = references.where(F.coalesce(F.col(hash_col), F.lit("")) != "").select(F.explode(F.array_distinct(F.array(host, T.registered_domain(host, known)))).alias("key"), F.lower(T.clean(hash_col)).alias("hash"))
    return keyed.where("key <> '' and hash <> ''").distinct()


def _hash_score(rows: DataFrame, value: str, keys: Column, references: DataFrame, out: str) -> DataFrame:
    """The best similarity of the hash to the references under any of the row's keys.  It is found for each distinct hash
    and keys and comes back by them, so it does not matter in which order rows arrive when a task runs again."""
    rows = rows.withColumn("_keys", F.array_distinct(keys))
    asked = rows.select(F.col(value).alias("_h"), F.col("_keys").alias("_k")).distinct()
    wanted = asked.withColumn("key", F.explode("_k")).where("_h <> '' and key <> ''")
    best = wanted.join(references, "key").groupBy("_h", "_k").agg(F.max(hash_similarity(F.col("_h"), F.col("hash"))).alias(out))
    joined = rows.join(best, (F.col(value) == F.col("_h")) & (F.col("_keys") == F.col("_k")), "left").drop("_h", "_k", "_keys")
    return joined.withColumn(out, F.round(F.coalesce(out, F.lit(0.0)), 6))


def nearest_hash(rows: DataFrame, hash_col: str, references: DataFrame, limit: int, out: str) -> DataFrame:
    """``rows`` with the best similarity of a hash to a set of hashes.  A set of up to ``limit`` is one array in each task;
    a larger one is met block by block."""
    listed = references.select(F.lower(T.clean("hash")).alias("hash")).where("hash <> ''").distinct()
    n = listed.count()
    if n == 0:
        return rows.withColumn(out, F.lit(0.0))
    blocks = max(1, -(-n // limit))
    # Hex hashes are compared as numbers, read once on either side; any other text can only be equal.
    number = hash_number(F.col("hash"))
    grouped = listed.groupBy(F.pmod(F.xxhash64("hash"), F.lit(blocks)).alias("block")).agg(F.collect_list(number).alias("numbers"), F.collect_list(F.when(number.isNull(), F.col("hash"))).alias("texts"))
    keyed = rows.select(F.lower(T.clean(hash_col)).alias("_h")).where("_h <> ''").distinct().withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    keyed = keyed.withColumn("_n", hash_number(F.col("_h")))
    apart = F.array_min(F.transform("numbers", lambda r: F.bit_count(F.col("_n").bitwiseXOR(r))))
    near = F.when(F.col("_n").isNull(), F.array_contains("texts", F.col("_h")).cast("double")).otherwise(1.0 - apart / 64.0)
    # A block is one row of at most about ``limit`` numbers; few blocks are sent to all tasks, many are met by the join.
    if n <= 4 * limit:
        grouped = F.broadcast(grouped)
    found = keyed.join(grouped, "block").select("_h", F.coalesce(near, F.lit(0.0)).alias("_s"))
    best = found.groupBy("_h").agg(F.max("_s").alias(out))
    joined = rows.join(best, F.lower(T.clean(hash_col)) == F.col("_h"), "left").drop("_h")
    return joined.withColumn(out, F.round(F.coalesce(out, F.lit(0.0)), 6))


def hamming_semi(rows: DataFrame, hash_col: str, references: DataFrame, most: int) -> DataFrame:
    """Rows whose 64-bit hex hash is within ``most`` (under 4) bits of a reference: some 16-bit quarter is then equal, which
    is an equi-join; the distance is checked after it."""
    if most > 3:
        raise ValueError("four quarters find distances up to 3; use nearest_hash for more")
    quarters = lambda c: F.explode(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.concat(i.cast("string"), F.lit(":"), F.substr(F.lpad(c, 16, "0"), i * 4 + 1, F.lit(4)))))
    own = rows.select(F.lower(T.clean(hash_col)).alias("_h")).distinct().select("_h", quarters(F.col("_h")).alias("q"))
    from ..functions.hashing import hamming

    theirs = references.select(F.lower(T.clean("hash")).alias("_r")).distinct().select("_r", quarters(F.col("_r")).alias("q"))
    near = own.join(theirs, "q").where(hamming(F.col("_h"), F.col("_r")) <= most).select("_h").distinct()
    return rows.join(near, F.lower(T.clean(hash_col)) == F.col("_h"), "left_semi")


def page_evidence(rows: DataFrame, s: Settings) -> DataFrame:
    """The page columns of rows with html, fetch_success, final_url, url, host, matched_brand_domain, target_domain and
    cse_name.  Where a brand is claimed but the target or the page has no domain, all of it is the default of an error."""
    columns = rows.columns
    named = T.hostname(F.coalesce(F.nullif("matched_brand_domain", F.lit("")), T.hostname("target_domain")))
    rows, (of_named, of_host) = resolve(rows.withColumn("_named", named), {"_sn": F.col("_named"), "_sh": F.col("host")}, s.suffixes)
    tokens = T.brand_tokens(F.col("_named"), F.col("cse_name"), of_named)
    rows = rows.withColumn("_page", F.when(F.coalesce("html", F.lit("")) != "", H.page_parts("html"))).withColumn("_tokens", tokens)
    p, tok = F.col("_page"), F.col("_tokens")
    target, own = T.registered_domain(F.col("_named"), of_named), T.registered_domain(F.col("host"), of_host)
    actions = F.filter(F.transform(p["forms"], lambda a: T.clean(a)), lambda a: (a != "") & ~a.startswith("#") & ~a.startswith("javascript:"))
    rows = rows.withColumn("_actions", H.join_urls(F.coalesce(F.nullif("final_url", F.lit("")), F.col("url")), actions))
    rows = registered_domains(rows, "_actions", "_domains", s.suffixes)
    external = F.exists("_domains", lambda d: (d != "") & (d != own))
    login = p["has_password"] | T.contains_any(p["text"], LOGIN) | (F.size(p["forms"]) > 0)
    logo_brand = F.exists(p["images"], lambda i: F.exists(tok, lambda t: i["attrs"].contains(t)))
    logo = logo_brand | F.exists(p["images"], lambda i: i["attrs"].contains("logo"))
    claim = T.any_token(tok, p["text"], p["meta"], p["title"]) | logo_brand
    broken = claim & ((target == "") | (own == ""))
    mismatch = claim & (target != own)
    there = p.isNotNull() & ~F.coalesce(broken, F.lit(False))
    flag = lambda c: F.when(there, c.cast("int")).otherwise(0)
    out = {
        "page_render_success": flag((F.col("fetch_success") == 1) & (T.strip("html") != "")), "has_login_form": flag(login), "has_password_input": flag(p["has_password"]),
        "form_action_external": flag(external), "brand_token_or_logo_present": flag(claim), "logo_detected": flag(logo), "logo_brand_matches_target_brand": flag(logo_brand),
        "logo_brand_domain_mismatch": flag(mismatch), "visual_brand_domain_mismatch": flag(mismatch), "_there": there,
        "page_status": F.when(p.isNull(), "empty").when(there, "success").otherwise("error"),
    }
    return rows.select(*columns, *(v.alias(k) for k, v in out.items())).withColumn("html_dom_hash", F.when(F.col("_there"), H.dom_hash("html")).otherwise(""))


def feature_rows(rows: DataFrame, brands: DataFrame, s: Settings, given: dict[str, DataFrame] | None = None, references: dict[str, DataFrame] | None = None) -> DataFrame:
    """One wide feature row for each candidate row: lexical, URL, DNS, registration, TLS, hosting, page and hash features.

    ``references``: favicons and logos (domain, hash) of brands, phish_dom (hash) of known phishing pages.
    """
    from .match import lexical_features

    spark = rows.sparkSession
    tables = evidence(spark, given)
    references = references or {}
    today = F.to_date(F.lit(s.observation_date))
    base = rows.withColumn("url", T.ensure_url("url")).drop("host", "target", "brand_token_list", *LEXICAL)  # of the match before
    base = lexical_features(base, brands, s)
    base = lookup(base, tables["dns"], "host", F.col("host"), "d_")
    base = lookup(base, tables["registration"], "registered_domain", F.col("registered_domain"), "r_")
    base = lookup(base, tables["tls"], "host", F.col("host"), "t_")
    base = lookup(base, tables["http"], "url", F.col("url"), "h_")
    base = lookup(base, tables["assets"], "origin", T.origin(F.coalesce(F.nullif("h_final_url", F.lit("")), F.col("url"))), "a_")
    base = lookup(base, tables["hosting"], "ip", T.first_ip(F.col("d_resolved_ips")), "o_")
    text, zero, unknown = F.lit(""), F.lit(0), F.lit(UNKNOWN)
    base = base.withColumns({
        "html": F.coalesce("h_html", text), "final_url": F.coalesce("h_final_url", text), "fetch_success": F.coalesce("h_fetch_success", zero),
        "resolved_ips": F.coalesce("d_resolved_ips", text), "favicon_hash": F.coalesce(image_hashes("a_favicon"), text), "logo_hash": F.coalesce(image_hashes("a_logo"), text),
    })
    if isinstance(s.suffixes, DataFrame):
        base = keep(base, "evidence")
    base = page_evidence(base, s)
    named = F.coalesce(F.nullif("matched_brand_domain", text), F.col("target"))
    if isinstance(s.suffixes, DataFrame):  # pages are parsed once, not for the look-up too
        base = keep(base, "pages")
    base, (of_named, of_target) = resolve(base.withColumn("_named", T.hostname(named)), {"_sn": F.col("_named"), "_st": F.col("target")}, s.suffixes)
    keys = F.array(*(k for h, n in ((F.col("_named"), of_named), (F.col("target"), of_target)) for k in (h, T.registered_domain(h, n))))
    for kind in ("favicon", "logo"):
        if kind in references:
            base = _hash_score(base, f"{kind}_hash", keys, hash_references(references[kind], "hash", s.suffixes), f"{kind}_similarity_score")
        else:
            base = base.withColumn(f"{kind}_similarity_score", F.lit(0.0))
    if "phish_dom" in references:
        base = nearest_hash(base, "html_dom_hash", references["phish_dom"], s.broadcast_rows, "html_dom_similarity_score")
    else:
        base = base.withColumn("html_dom_similarity_score", F.lit(0.0))
    names = F.coalesce(F.nullif(F.array_join(F.coalesce("r_nameservers", F.array().cast("array<string>")), ";"), text), F.col("nameservers"))
    registrar = F.coalesce(F.nullif("r_registrar_name", text), F.col("registrar_name"))
    owner = F.coalesce(F.nullif("o_asn_org", text), F.col("hosting_isp"))
    ips = T.ip_list(F.col("resolved_ips"))
    statuses = {
        "dns_status": F.coalesce("d_status", F.lit("error")), "http_status": F.coalesce("h_status", F.lit("unknown")), "tls_status": F.coalesce("t_status", F.lit("error")),
        "rdap_status": F.coalesce("r_rdap_status", F.lit("unknown")), "whois_status": F.coalesce("r_whois_status", F.lit("unknown")), "page_status": F.col("page_status"),
    }
    out = {
        "url": F.col("url"), "domain": F.col("host"), "target_brand_domain": F.col("target"), "critical_sector_entity_name": F.col("cse_name"),
        "source_label": T.source_label("source_label"), "source_file": F.col("source_file"), "source_row": F.col("source_row"),
        **T.url_shape(F.col("url"), F.col("host")),
        **{c: F.col(c) for c in LEXICAL},
        "dns_check_pass": F.coalesce("d_dns_check_pass", zero), "dns_resolves_to_ip": F.coalesce("d_dns_resolves_to_ip", zero), "resolved_ips": F.col("resolved_ips"),
        "cname_exists": F.coalesce("d_cname_exists", zero), "cname_chain_length": F.coalesce("d_cname_chain_length", zero),
        "nameserver_reputation_score": T.reputation(names, "nameserver"), "passive_dns_first_seen_days": unknown,
        "domain_age_days": D.age_days(F.col("r_creation_date"), today), "domain_expiry_days": D.expiry_days(F.col("r_expiration_date"), today),
        "registrar_reputation_score": T.reputation(registrar, "registrar"), "asn_reputation_score": T.reputation(owner, "asn"),
        "ip_seen_with_many_brands": F.when(F.size(ips) == 0, UNKNOWN).otherwise(0),
        "https_enabled": F.coalesce("t_https_enabled", zero), "ssl_valid": F.coalesce("t_ssl_valid", zero), "cert_age_days": F.coalesce("t_cert_age_days", unknown), "ct_log_first_seen_days": unknown,
        "url_fetch_success": F.col("fetch_success"), "page_fetch_success": F.col("fetch_success"), "redirect_count": F.coalesce("h_redirect_count", zero), "redirect_cross_domain_count": F.coalesce("h_redirect_cross_domain_count", zero),
        **{c: F.col(c) for c in ("page_render_success", "has_login_form", "has_password_input", "form_action_external", "brand_token_or_logo_present", "logo_detected", "logo_brand_matches_target_brand", "logo_brand_domain_mismatch", "visual_brand_domain_mismatch", "favicon_hash", "favicon_similarity_score", "logo_hash", "logo_similarity_score", "html_dom_hash", "html_dom_similarity_score")},
        "fetch_status_code": F.coalesce("h_status_code", zero), "fetch_error": F.coalesce("h_error", text), "dns_error": F.coalesce("d_dns_error", text), "tls_error": F.coalesce("t_tls_error", text),
        **statuses,
    }
    from .rules import extraction_status

    also = [c for c in ("ord",) if c in rows.columns]
    return base.select(*also, *(v.alias(k) for k, v in out.items()), extraction_status(*statuses.values()).alias("extraction_status"))
