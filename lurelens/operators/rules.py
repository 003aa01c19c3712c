"""The ordered rules, as CASE expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import CAMPAIGN_DOMAINS, HIGH_LEXICAL, POSITIVE_STATUSES
from ..functions import text as T


def _chain(*cases: tuple[Column, object], otherwise: object) -> Column:
    out = None
    for condition, value in cases:
        value = value if isinstance(value, Column) else F.lit(value)
        out = F.when(condition, value) if out is None else out.when(condition, value)
    return out.otherwise(otherwise)


def label_rows(rows: DataFrame) -> DataFrame:
    """The rule labels of feature rows; missing columns count as 0 or "".  Rows with extraction_status "failed" keep what
    they have."""

    def number(c: str) -> Column:
        return F.coalesce(F.col(c).cast("double"), F.lit(0.0)) if c in rows.columns else F.lit(0.0)

    flag = lambda c: number(c) == 1
    high = number("lexical_similarity_score") >= HIGH_LEXICAL
    dns, fetch, login, password = map(flag, ("dns_check_pass", "page_fetch_success", "has_login_form", "has_password_input"))
    brand, mismatch, icon = map(flag, ("brand_token_or_logo_present", "visual_brand_domain_mismatch", "favicon_hash_matches_known_phish"))
    source = T.source_label("source_label" if "source_label" in rows.columns else F.lit(""))
    campaign = high & dns & (number("same_html_hash_domain_count_7d") > CAMPAIGN_DOMAINS) & password
    phishing = high & dns & ((password & brand) | mismatch | icon)
    inactive, infra, quiet = high & ~dns & ~fetch, high & dns & ~fetch, high & dns & fetch & ~login & ~brand
    trusted = source == "phishing"
    status = _chain(
        (~high, "below_high_lexical_threshold"), (campaign, "phishing_campaign"), (phishing, "phishing"), (trusted, "source_verified_phishing"),
        (inactive, "suspected_inactive"), (infra, "suspected_active_infra"), (quiet, "suspected_active_no_phish_evidence"), otherwise="suspected_unconfirmed",
    )
    reason = _chain(
        (~high, f"lexical_similarity_score < {HIGH_LEXICAL}"),
        (campaign, "same DOM hash appears across multiple domains in 7 days and password input exists"),
        (phishing & password & brand, "password input plus brand token/logo evidence"), (phishing & mismatch, "visual brand-domain mismatch"),
        (phishing, "favicon hash matches known phishing hash"), (trusted, "source label is trusted historical phishing"),
        (inactive, "high lexical similarity but no DNS and no page fetch"), (infra, "DNS active but page fetch failed"),
        (quiet, "active page without login form or brand visual claim"), otherwise="high lexical similarity but insufficient phishing evidence",
    )
    label = F.when(~high, trusted.cast("int")).otherwise((campaign | phishing | trusted).cast("int"))
    out = {
        "high_lexical_similarity": high.cast("int"), "no_login_form": (~login).cast("int"), "no_brand_visual_claim": (~brand).cast("int"),
        "suspected_inactive": inactive.cast("int"), "suspected_active_infra": infra.cast("int"), "suspected_active_no_phish_evidence": quiet.cast("int"),
        "phishing": phishing.cast("int"), "phishing_campaign": campaign.cast("int"), "validation_status": status, "validation_reason": reason,
        "label_conflict": ((trusted & (label == 0)) | (~trusted & (label == 1) & source.isin("suspected", "legitimate"))).cast("int"),
        "include_in_ml": high.cast("int"), "label": label,
    }
    if "extraction_status" in rows.columns:
        failed = F.coalesce(F.col("extraction_status") == "failed", F.lit(False))
        out = {k: F.when(failed, F.col(k) if k in rows.columns else F.lit(None)).otherwise(v) for k, v in out.items()}
    return rows.withColumns(out)


def final_decision(rows: DataFrame) -> DataFrame:
    """What the two models and the rule status come to."""
    standard, hardened = F.col("standard_prediction") == 1, F.col("hardened_prediction") == 1
    status = T.status_text(F.col("validation_status"))
    proved, suspected = status.isin(*POSITIVE_STATUSES), status.startswith("suspected")
    confirmed = standard | (proved & hardened)
    review = hardened | suspected
    return rows.withColumns(
        {
            "final_classification": _chain((confirmed, "confirmed_phishing"), (review, "suspicious_needs_review"), otherwise="low_risk"),
            "classification_confidence": _chain((confirmed, "high"), (hardened, "medium"), otherwise="low"),
            "recommended_action": _chain((confirmed, "block_or_escalate_as_phishing"), (review, "manual_review_or_monitor"), otherwise="no_phishing_action"),
            "classification_reason": _chain(
                (standard, "standard model exceeds conservative high-confidence threshold"),
                (proved & hardened, "rule evidence is phishing and hardened model also exceeds threshold"),
                (hardened, "hardened model flags suspicious infrastructure but standard model is below threshold"),
                (suspected, F.concat(F.lit("pipeline status is "), status, F.lit(" but both models are below threshold"))),
                otherwise="both models are below threshold and pipeline status is not suspicious",
            ),
        }
    )


def extraction_status(*statuses: Column) -> Column:
    """"complete" if every stage succeeded or was skipped, else "partial"."""
    fine = reduce(lambda a, b: a & b, (s.isin("success", "skipped") for s in statuses))
    return F.when(fine, "complete").otherwise("partial")


def pu_roles(rows: DataFrame) -> DataFrame:
    """is_positive and is_unlabeled; missing columns count as unlabeled, without status, lexically fine."""
    has = lambda c, default: F.col(c) if c in rows.columns else F.lit(default)
    source = T.training_label(has("source_label", "unknown"))
    positive = (source == "phishing") | F.lower(F.coalesce(has("validation_status", "").cast("string"), F.lit("nan"))).isin(*POSITIVE_STATUSES)
    fine = F.coalesce(F.expr("try_cast(high_lexical_similarity AS double)") if "high_lexical_similarity" in rows.columns else F.lit(1.0), F.lit(1.0)) == 1
    return rows.withColumn("is_positive", positive).withColumn("is_unlabeled", fine & (source != "legitimate") & ~positive)


def training_role(rows: DataFrame) -> Column:
    """The role of a row in training; a later use of it hides an earlier one."""
    return _chain(
        (F.col("in_negative_validation"), "reliable_negative_validation"), (F.col("in_positive_validation"), "positive_validation"),
        (F.col("in_reliable_negative"), "reliable_negative"), (F.col("is_positive"), "positive"), (F.col("is_unlabeled"), "unlabeled"), otherwise="ignored",
    )


def review_band(score: Column) -> Column:
    return _chain((score >= 0.90, "urgent"), (score >= 0.70, "high"), (score >= 0.40, "medium"), otherwise="low")
