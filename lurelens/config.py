"""Settings and fixed values."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import DataFrame

# Results are only right with exactly these.

HIGH_LEXICAL = 0.75
CAMPAIGN_DOMAINS = 2
CAMPAIGN_DAYS = 7
TOKEN_SCORE = 0.85
TOKEN_OVERRIDE_SCORE = 0.86
UNKNOWN = -1
TEXT_HASH_DISTANCE = 3
IMAGE_HASH_DISTANCE = 6

NULL_TEXTS = ("nan", "nat", "none", "null")

STOPWORDS = (
    "and", "bank", "co", "com", "corp", "corporate", "gov", "http", "https", "in", "india", "limited", "login", "ltd",
    "net", "online", "org", "portal", "public", "services", "the", "www",
)

#: Look-alike characters and what they stand for: digits, signs, and Cyrillic letters.
HOMOGLYPHS = ("013457@$аеорсху", "oleastasaeopcxy")

REPUTATION = {
    "registrar": (
        ("markmonitor", "csc", "network solutions", "tucows", "godaddy"),
        ("namecheap", "dynadot", "spaceship", "porkbun", "nicenic"),
    ),
    "nameserver": (
        ("cloudflare", "akamai", "awsdns", "azure-dns", "googledomains"),
        ("namecheaphosting", "dnspod", "parking", "sedoparking"),
    ),
    "asn": (
        ("amazon", "google", "microsoft", "cloudflare", "akamai", "oracle"),
        ("bulletproof", "hostinger", "namecheap", "digitalocean"),
    ),
}
REPUTATION_HIGH, REPUTATION_LOW, REPUTATION_OTHER = 8, 4, 6

LOGIN_TERMS = ("login", "signin", "sign in", "password", "username", "user id", "otp")

POSITIVE_STATUSES = ("phishing", "phishing_campaign", "source_verified_phishing")

PRIVACY_WORDS = ("privacy", "redacted", "withheld", "not disclosed", "data protected", "contact privacy", "domain protection", "whoisguard", "domains by proxy")

TRUTH_COLUMNS = (
    "ground_truth", "ground_truth_label", "actual_label", "true_label", "manual_label", "test_label", "expected_label",
    "Phishing/Suspected Domains (i.e. Class Label)", "Class Label", "source_label",
)

COMPACT_COLUMNS = (
    "lexical_similarity_score", "min_edit_distance_to_brand_domain", "homoglyph_similarity_score", "brand_token_in_subdomain",
    "brand_token_in_path", "brand_not_in_registered_domain", "subdomain_depth", "dns_check_pass", "dns_resolves_to_ip",
    "cname_exists", "cname_chain_length", "nameserver_reputation_score", "passive_dns_first_seen_days", "domain_age_days",
    "domain_expiry_days", "registrar_reputation_score", "asn_reputation_score", "ip_seen_with_many_brands", "https_enabled",
    "ssl_valid", "cert_age_days", "ct_log_first_seen_days", "url_fetch_success", "redirect_count", "redirect_cross_domain_count",
    "page_render_success", "has_login_form", "has_password_input", "form_action_external", "logo_detected",
    "logo_brand_matches_target_brand", "logo_brand_domain_mismatch", "favicon_similarity_score", "logo_similarity_score",
    "html_dom_similarity_score", "high_lexical_similarity", "page_fetch_success", "no_login_form", "no_brand_visual_claim",
    "brand_token_or_logo_present", "visual_brand_domain_mismatch", "same_html_hash_domain_count_7d", "suspected_inactive",
    "suspected_active_infra", "suspected_active_no_phish_evidence", "phishing", "phishing_campaign", "validation_status",
    "validation_reason", "extraction_status", "dns_status", "rdap_status", "whois_status", "http_status", "tls_status",
    "page_status", "label",
)

COMPACT_TEXT = ("dns_status", "extraction_status", "http_status", "page_status", "rdap_status", "tls_status", "validation_reason", "validation_status", "whois_status")

COMPACT_BOOLEAN = (
    "brand_not_in_registered_domain", "brand_token_in_path", "brand_token_in_subdomain", "brand_token_or_logo_present",
    "cname_exists", "dns_check_pass", "dns_resolves_to_ip", "form_action_external", "has_login_form", "has_password_input",
    "high_lexical_similarity", "https_enabled", "ip_seen_with_many_brands", "logo_brand_domain_mismatch",
    "logo_brand_matches_target_brand", "logo_detected", "no_brand_visual_claim", "no_login_form", "page_fetch_success",
    "page_render_success", "phishing", "phishing_campaign", "ssl_valid", "suspected_active_infra",
    "suspected_active_no_phish_evidence", "suspected_inactive", "url_fetch_success", "visual_brand_domain_mismatch",
)

DNS_FAILED_COLUMNS = (
    "url", "domain", "target_brand_domain", "critical_sector_entity_name", "source_label", "source_file", "source_row",
    "dns_status", "dns_check_pass", "dns_resolves_to_ip", "resolved_ips", "cname_exists", "cname_chain_length", "dns_error",
    "validation_status", "validation_reason",
)

CANDIDATE_COLUMNS = (
    "Application_ID", "Source of detection", "Identified Phishing/Suspected Domain Name", "Corresponding CSE Domain Name",
    "Critical Sector Entity Name", "Phishing/Suspected Domains (i.e. Class Label)", "Date of detection (DD-MM-YYYY)",
    "Time of detection (HH-MM-SS)", "Remarks",
)

#: Columns that say the label, or only what a reviewer needs; never model features.
LEAK_COLUMNS = (
    "url", "domain", "target_brand_domain", "critical_sector_entity_name", "source_label", "source_file", "source_row",
    "remarks", "matched_brand_domain", "registered_domain", "resolved_ips", "favicon_hash", "logo_hash", "html_dom_hash",
    "fetch_error", "dns_error", "tls_error", "dns_status", "http_status", "rdap_status", "whois_status", "tls_status",
    "page_status", "extraction_status", "validation_status", "validation_reason", "label", "label_conflict", "include_in_ml",
    "phishing", "phishing_campaign", "suspected_inactive", "suspected_active_infra", "suspected_active_no_phish_evidence",
)

#: What the rule labeller looks at; the hardened model goes without.
HARDENED_COLUMNS = (
    "lexical_similarity_score", "high_lexical_similarity", "url_fetch_success", "page_fetch_success", "page_render_success",
    "fetch_status_code", "has_login_form", "has_password_input", "form_action_external", "no_login_form",
    "brand_token_or_logo_present", "logo_detected", "logo_brand_matches_target_brand", "logo_brand_domain_mismatch",
    "visual_brand_domain_mismatch", "no_brand_visual_claim", "same_html_hash_domain_count_7d",
)

#: Headers of raw candidate files by field, the first non-empty one counts.
HEADERS = {
    "detected": ("Identified Phishing/Suspected Domain Name", "Identified Phishing Domain Name", "Identified Suspected Domain Name", "Domain Name", "domain", "url"),
    "target_domain": ("Corresponding CSE Domain Name", "CSE Domain", "Legitimate Domain"),
    "cse_name": ("Critical Sector Entity Name", "Cooresponding CSE", "Corresponding CSE", "Application Name", "cse"),
    "source_label": ("Phishing/Suspected Domains (i.e. Class Label)", "Class Label", "label", "source_label"),
    "registrar_name": ("Registrar Name",),
    "registrant_name": ("Registrant Name or Registrant Organisation",),
    "registrant_country": ("Registrant Country",),
    "nameservers": ("Name Servers",),
    "hosting_ip": ("Hosting IP",),
    "hosting_isp": ("Hosting ISP",),
    "hosting_country": ("Hosting Country",),
    "dns_records": ("DNS Records (if any)", "DNS Records"),
    "remarks": ("Remarks",),
}
BRAND_DOMAIN_HEADERS = ("domains", "domain", "Legitimate Domains", "Public URL", "CSE Domain", "Domain", "URL")
BRAND_NAME_HEADERS = ("cse", "CSE", "Cooresponding CSE", "Application Name", "Critical Sector Entity Name", "Corresponding CSE")
ASN_HEADERS = ("asn_org", "organization", "org", "network_name", "name")

# End of the fixed values.

#: A short choice of suffixes, for small work without a rule table; with it a host's suffix is found by a pattern.
SUFFIXES = (
    "com", "net", "org", "in", "co.in", "gov.in", "bank.in", "nic.in", "ac.in", "net.in", "org.in", "res.in", "gen.in", "firm.in",
    "edu.in", "mil.in", "ind.in", "io", "co", "co.uk", "org.uk", "ac.uk", "gov.uk", "uk", "us", "info", "biz", "online", "site",
    "xyz", "top", "shop", "live", "app", "dev", "me", "ai", "gov", "edu", "club", "store", "tech", "page", "link", "icu", "cc",
    "tk", "ml", "ga", "cf", "gq", "ru", "cn", "com.cn", "de", "fr", "eu", "ca", "au", "com.au", "jp", "co.jp", "br", "com.br",
)


@dataclass(frozen=True)
class Settings:
    """Parameters of the plans; nothing is read from the environment."""

    #: Known suffixes, or a rule table (sources.readers.read_suffix_rules).
    suffixes: tuple[str, ...] | DataFrame = SUFFIXES
    match_threshold: float = 0.75
    feed_threshold: float = 0.82
    permutation_threshold: float = 0.75
    require_match: bool = False
    row_cap: int = 5000
    observation_date: str = "1970-01-01"
    min_positives: int = 10
    min_unlabeled: int = 50
    reliable_quantile: float = 0.30
    reliable_max_score: float = 0.30
    min_reliable: int = 50
    target_recall: float = 0.95
    trees: int = 300
    seed: int = 42
    folds: int = 5
    #: A dimension of more rows than this is not broadcast.
    broadcast_rows: int = 20_000


def number(value: object, default: float, least: float = 0):
    """A setting's text as a number of the default's kind, ``least`` at least; the default for what is no number."""
    try:
        return max(type(default)(least), type(default)(value))
    except (TypeError, ValueError, OverflowError):
        return default


@dataclass(frozen=True)
class Pace:
    """How many keys probers ask for at a time, and how long they wait."""

    io: int = 12
    dns: int = 32
    http: int = 12
    registry: int = 20
    fallback: int = 2
    fallback_pause: float = 0.5
    tls: int = 6
    owner: int = 6
    http_timeout: int = 10
    dns_timeout: float = 3.0
    dns_lifetime: float = 6.0
    dns_retries: int = 1

    @staticmethod
    def of(texts: dict[str, object]) -> Pace:
        """From texts: counts are 1 at least, retries and times 0 at least; what is missing or no number has its default,
        which for most counts goes by ``io``."""
        io = number(texts.get("io"), Pace.io, 1)
        defaults = {"dns": max(32, 2 * io), "http": io, "registry": max(20, io), "tls": max(4, io // 2), "owner": max(4, io // 2)}
        every = {f.name: defaults.get(f.name, f.default) for f in fields(Pace)} | {"io": io}
        at_least_1 = ("io", "dns", "http", "registry", "fallback", "tls", "owner", "http_timeout")
        return Pace(**{k: number(texts.get(k), v, int(k in at_least_1)) for k, v in every.items()})


#: Grid of decision thresholds: 181 points from 0.05 to 0.95, as a linear space gives them.
def threshold_grid() -> list[float]:
    import numpy as np

    return np.linspace(0.05, 0.95, 181).tolist()
