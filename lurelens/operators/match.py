"""Which brand a host imitates.

The best brand of a host is found without comparing it with all brands.  The length of two texts and the characters
that they share bound their similarity from above (no common subsequence is longer than the characters in common), and
a host meets the brands in order of that bound until none can reach the best found; brands whose token the host
holds are looked up by the host's substrings.  The outcome is that of the whole loop.

Few brands go to the tasks with the code, and nothing is shuffled or joined.  More than ``Settings.broadcast_rows`` are
dealt in blocks of about that many rows; distinct hosts meet each block in a task of its own, and the best is an
aggregate.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from ..config import HOMOGLYPHS, TOKEN_OVERRIDE_SCORE, TOKEN_SCORE, UNKNOWN, Settings
from ..functions import text as T
from ..functions.similarity import indel_ratio
from ..storage import keep
from .hosts import resolve

#: ``compared``: the brands whose similarity was worked out.
BEST = "brand string, score double, distance int, homoglyph double, compared bigint"
_LOOKS = str.maketrans(*HOMOGLYPHS)


def edit_distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        corner, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            corner, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, corner + (x != y))
    return row[-1]


def window_distance(text: str, needle: str) -> int | None:
    if not text or not needle:
        return None
    if needle in text:
        return 0
    if len(text) <= len(needle):
        return edit_distance(text, needle)
    return min(edit_distance(text[i : i + len(needle)], needle) for i in range(len(text) - len(needle) + 1))


class Brand:
    """What is compared of a brand."""

    def __init__(self, domain: str, registered: str, stem: str, tokens: list[str]):
        self.domain, self.registered, self.stem, self.tokens = domain, registered, stem, tokens
        self.looks = (registered.lower().translate(_LOOKS), stem.lower().translate(_LOOKS))


class TokenIndex:
    """Texts by the tokens that occur in them: a text's substrings are looked up, at the lengths that tokens have."""

    def __init__(self, tokens: list[list[str]]):
        self.holders: dict[str, list[int]] = {}
        for k, some in enumerate(tokens):
            for t in some:
                self.holders.setdefault(t, []).append(k)
        self.lengths = sorted({len(t) for t in self.holders})

    def found(self, *texts: str) -> set[int]:
        """The places of the lists with a token in one of the texts."""
        out: set[int] = set()
        for text in set(texts):
            for n in self.lengths:
                for i in range(len(text) - n + 1):
                    out.update(self.holders.get(text[i : i + n], ()))
        return out


class BrandIndex:
    """Brands in order of domain, with what bounds a similarity to them."""

    def __init__(self, brands: list[Brand]):
        self.brands = brands
        self.tokens = TokenIndex([b.tokens for b in brands])
        self.bags = [self._bags([getattr(b, kind) for b in brands]) for kind in ("registered", "stem")]

    @staticmethod
    def _bags(texts: list[str]) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """(how often each text has a character, by character; lengths)."""
        bags: dict[str, np.ndarray] = {}
        for k, text in enumerate(texts):
            for c, n in Counter(text).items():
                if c not in bags:
                    bags[c] = np.zeros(len(texts), np.int32)
                bags[c][k] = n
        return bags, np.array([len(t) for t in texts], np.int32)

    def bounds(self, kind: int, text: str) -> np.ndarray:
        """For each brand what the similarity of ``text`` to it cannot exceed."""
        bags, lengths = self.bags[kind]
        shared = np.zeros(len(self.brands), np.int32)
        for c, n in Counter(text).items():
            if c in bags:
                shared += np.minimum(bags[c], n)
        return 2.0 * shared / np.maximum(lengths + len(text), 1)


class Host:
    def __init__(self, registered: str, stem: str, alnum: str):
        self.registered, self.stem, self.alnum = registered, stem, alnum
        self.plain = alnum.lower().translate(_LOOKS)
        self.looks = (registered.lower().translate(_LOOKS), stem.lower().translate(_LOOKS))

    def score(self, brand: Brand, token: float, enough: float) -> float:
        """The score of a brand; less than ``enough`` may be given as any lesser number."""
        score = token
        for mine, theirs in ((self.registered, brand.registered), (self.stem, brand.stem)):
            if mine and theirs and 2.0 * min(len(mine), len(theirs)) / (len(mine) + len(theirs)) >= max(score, enough):
                score = max(score, indel_ratio(mine, theirs))
        return score

    def best(self, index: BrandIndex, own: Brand | None, extra: list[str]) -> tuple[str, float, int, float, int]:
        """(brand, score, distance, homoglyph score, compared) of the first brand of the highest score, ``own`` before all
        others; ("", 0, -1, 0, compared) if none is over 0.  ``extra``: tokens of the row's own entity, which count for
        every brand."""
        holds = lambda tokens: any(t in self.alnum or t in self.plain for t in tokens)
        shared = holds(extra)
        found, place, top, token, compared = None, len(index.brands), 0.0, 0.0, 0
        if own is not None:
            token = TOKEN_SCORE if shared or holds(own.tokens) else 0.0
            top, compared = self.score(own, token, 0.0), 1
            found, place = (own, -1) if top > 0 else (None, place)
        tokens = np.full(len(index.brands), TOKEN_SCORE if shared else 0.0)
        if not shared:
            tokens[list(index.tokens.found(self.alnum, self.plain))] = TOKEN_SCORE
        bounds = np.maximum(tokens, np.maximum(index.bounds(0, self.registered), index.bounds(1, self.stem)))
        near = np.flatnonzero((bounds >= top) & (bounds > 0))
        for k in near[np.argsort(-bounds[near], kind="stable")].tolist():
            if bounds[k] < top:
                break
            if bounds[k] == top and k > place:
                continue
            compared += 1
            score = self.score(index.brands[k], float(tokens[k]), top)
            if score > top or score == top and k < place:
                found, place, top, token = index.brands[k], k, score, float(tokens[k])
        if found is None:
            return "", 0.0, UNKNOWN, 0.0, compared
        apart = [edit_distance(self.registered, found.registered), edit_distance(self.stem, found.stem)]
        for x in {*found.tokens, *extra}:
            apart += [d for d in (window_distance(self.alnum, x), window_distance(self.plain, x)) if d is not None]
        look = max(token, *(indel_ratio(a, b) for a, b in zip(self.looks, found.looks, strict=True)))
        return found.domain, top, min(apart), look, compared


def brand_table(brands: DataFrame, settings: Settings) -> DataFrame:
    """(domain, name, registered, stem, tokens, own_tokens) of brands (domain, name); own_tokens has those of the name too."""
    host = F.col("domain")
    brands, (s,) = resolve(brands.select("domain", "name"), {"_sb": host}, settings.suffixes)
    return brands.select("domain", "name", T.registered_domain(host, s).alias("registered"), T.domain_stem(host, s).alias("stem"), T.domain_tokens(host, s).alias("tokens"), T.brand_tokens(host, F.col("name"), s).alias("own_tokens"))


@dataclass
class BrandSet:
    """The brand dimension: its table, and its rows by domain where they are few enough to go with the tasks."""

    table: DataFrame
    rows: list | None
    blocks: int


def brand_set(brands: DataFrame, settings: Settings) -> BrandSet:
    table = brand_table(brands, settings)
    n = brands.count()
    few = n <= settings.broadcast_rows
    return BrandSet(table, table.orderBy("domain").collect() if few else None, max(1, math.ceil(n / settings.broadcast_rows)))


def _own(target: Column, s: T.Suffixes) -> Column:
    return F.struct(target.alias("domain"), T.registered_domain(target, s).alias("registered"), T.domain_stem(target, s).alias("stem"), T.domain_tokens(target, s).alias("tokens"))


_KEY = ["host", "target", "cse_name"]
#: Rows of distinct keys that meet a block of brands in one task.
HOSTS_IN_TASK = 100_000


def _compare_all(index: BrandIndex, frame: pd.DataFrame, seen: dict) -> pd.DataFrame:
    """BEST for each row of inputs; types are set, as an empty frame has none of its own."""
    out = []
    for r, st, al, ex, domain, own_r, own_s, own_t in frame.itertuples(index=False):
        key = (r, st, al, tuple(ex), domain)
        if key not in seen:
            if len(seen) > 100_000:
                seen.clear()
            seen[key] = Host(r, st, al).best(index, Brand(domain, own_r, own_s, list(own_t)) if domain else None, list(ex))
        out.append(seen[key])
    kinds = {"brand": "object", "score": "float64", "distance": "int32", "homoglyph": "float64", "compared": "int64"}
    return pd.DataFrame({c: pd.Series([r[k] for r in out], index=frame.index, dtype=kind) for k, (c, kind) in enumerate(kinds.items())})


def _comparer(listed: list[tuple]):
    def compare(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index, seen = BrandIndex([Brand(*b) for b in listed]), {}
        for part in parts:
            yield _compare_all(index, part, seen)

    return pandas_udf(compare, BEST)


def _first_holder(listed: list[tuple]):
    def first(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        index = TokenIndex([tokens for _, tokens in listed])
        for part in parts:
            yield part.map(lambda x: min((listed[k][0] for k in index.found(x or "")), default=None)).astype("object")

    return pandas_udf(first, "string")


def _in_blocks(keys: DataFrame, brands: BrandSet, columns: list[str], work, schema: str) -> DataFrame:
    """What ``work`` makes of the distinct keys and each block of brands, in tasks of a bounded number of both."""
    salts = max(1, math.ceil(keys.count() / HOSTS_IN_TASK))
    many = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = keys.withColumns({"_salt": F.pmod(F.xxhash64(*keys.columns[:1]), F.lit(salts))}).withColumn("_block", many(brands.blocks))
    right = brands.table.select(*columns, F.pmod(F.xxhash64("domain"), F.lit(brands.blocks)).alias("_block")).withColumn("_salt", many(salts))
    return left.groupBy("_block", "_salt").cogroup(right.groupBy("_block", "_salt")).applyInPandas(work, schema)


def best_brands(rows: DataFrame, brands: BrandSet, settings: Settings) -> DataFrame:
    """``rows`` (host, target, cse_name, ...) with brand, score, distance, homoglyph, unrounded, and compared.

    The row's own target is compared first, then the brands by domain; a later one wins only with a higher score.
    """
    host, columns = F.col("host"), rows.columns
    asked = rows if brands.rows is not None else rows.select(*_KEY).distinct()
    asked, (s, of_target) = resolve(asked, {"_sh": host, "_st": F.col("target")}, settings.suffixes)
    own = _own(F.col("target"), of_target)
    inputs = F.struct(T.registered_domain(host, s).alias("registered"), T.domain_stem(host, s).alias("stem"), T.alnum(host).alias("alnum"), T.tokens(T.clean("cse_name")).alias("extra"), *(own[c].alias(f"own_{c}") for c in ("domain", "registered", "stem", "tokens")))
    if brands.rows is not None:
        listed = [(b["domain"], b["registered"], b["stem"], list(b["tokens"])) for b in brands.rows]
        return asked.withColumn("_best", _comparer(listed)(inputs)).select(*columns, "_best.*")
    names = ["registered", "stem", "alnum", "extra", "own_domain", "own_registered", "own_stem", "own_tokens"]

    def work(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        right = right.sort_values("domain")
        index = BrandIndex([Brand(d, r, s, list(t)) for d, r, s, t in zip(right["domain"], right["registered"], right["stem"], right["tokens"], strict=True)])
        return pd.concat([left[_KEY], _compare_all(index, left[names], {})], axis=1)

    keys = asked.select(*_KEY, inputs.alias("i")).select(*_KEY, "i.*")
    found = _in_blocks(keys, brands, ["domain", "registered", "stem", "tokens"], work, f"host string, target string, cse_name string, {BEST}")
    # Of equal scores the row's own target comes first, then the least domain; no brand comes last.
    order = F.struct(-F.col("score"), F.col("brand") != F.col("target"), "brand")
    best = found.groupBy(*_KEY).agg(F.min_by(F.struct("brand", "score", "distance", "homoglyph"), order).alias("_best"), F.sum("compared").alias("compared"))
    same = [F.col(f"_k.{c}").eqNullSafe(F.col(c)) for c in _KEY]
    return rows.join(best.select(F.struct(*_KEY).alias("_k"), "_best", "compared"), same, "left").select(*columns, "_best.*", "compared")


def first_token_brand(rows: DataFrame, url_alnum: Column, brands: BrandSet, out: str) -> DataFrame:
    """``rows`` with the first brand by domain that has a token, of its domain or name, in a text; else null."""
    if brands.rows is not None:
        return rows.withColumn(out, _first_holder([(b["domain"], list(b["own_tokens"])) for b in brands.rows])(url_alnum))

    def work(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        domains = right["domain"].tolist()
        index = TokenIndex([list(t) for t in right["own_tokens"]])
        return pd.DataFrame([(x, min((domains[k] for k in index.found(x)), default=None)) for x in left["_text"]], columns=["_text", "_first"])

    keyed = rows.withColumn("_text", url_alnum)
    found = _in_blocks(keyed.select("_text").where("_text is not null").distinct(), brands, ["domain", "own_tokens"], work, "_text string, _first string")
    best = found.groupBy("_text").agg(F.min("_first").alias(out))
    return keyed.join(best, "_text", "left").select(*rows.columns, out)


def lexical_features(rows: DataFrame, brands: DataFrame, settings: Settings, known: BrandSet | None = None) -> DataFrame:
    """``rows`` (url, detected_domain, target_domain, cse_name, ...) with the lexical feature columns."""
    keyed = rows.withColumn("host", T.hostname(F.when(T.clean("detected_domain") == "", F.col("url")).otherwise(F.col("detected_domain"))))
    keyed = keyed.withColumn("target", T.hostname("target_domain")).withColumn("cse_name", F.coalesce("cse_name", F.lit("")))
    joined = best_brands(keyed, known or brand_set(brands, settings), settings).drop("compared")
    host = F.col("host")
    named = F.when(F.col("brand") == "", F.col("target")).otherwise(F.col("brand"))
    columns = joined.columns
    if isinstance(settings.suffixes, DataFrame):  # the match is worked out once, not for the look-up too
        joined = keep(joined, "matched")
    joined, (s, of_named) = resolve(joined, {"_sh": host, "_sn": named}, settings.suffixes)
    joined = joined.withColumn("brand_token_list", T.brand_tokens(named, F.col("cse_name"), of_named))
    tokens, registered = F.col("brand_token_list"), T.registered_domain(host, s)
    return joined.select(
        *columns,
        "brand_token_list",
        F.round("score", 6).alias("lexical_similarity_score"),
        F.col("distance").alias("min_edit_distance_to_brand_domain"),
        F.round("homoglyph", 6).alias("homoglyph_similarity_score"),
        T.any_token(tokens, F.lower(T.subdomain(host, s))).cast("int").alias("brand_token_in_subdomain"),
        T.any_token(tokens, F.lower(T.url_path("url"))).cast("int").alias("brand_token_in_path"),
        ((F.size(tokens) > 0) & ~T.any_token(tokens, F.lower(registered))).cast("int").alias("brand_not_in_registered_domain"),
        T.subdomain_depth(host, s).alias("subdomain_depth"),
        F.col("brand").alias("matched_brand_domain"),
        registered.alias("registered_domain"),
    ).drop("brand", "score", "distance", "homoglyph")


def match_brands(rows: DataFrame, brands: DataFrame, settings: Settings) -> DataFrame:
    """``rows`` with match_domain, match_name (null if no brand of the list) and match_score: the lexical winner, unless a
    brand token in host and path scores more."""
    known = brand_set(brands, settings)
    lexical = lexical_features(rows, brands, settings, known)
    url = T.url_alnum(F.when(T.clean("url") == "", F.col("detected_domain")).otherwise(F.col("url")))
    lexical = first_token_brand(lexical, url, known, "token_brand")
    base = F.greatest("lexical_similarity_score", "homoglyph_similarity_score")
    override = F.col("token_brand").isNotNull() & (F.lit(TOKEN_OVERRIDE_SCORE) > base)
    picked = lexical.withColumn("match_score", F.when(override, F.lit(TOKEN_OVERRIDE_SCORE)).otherwise(base)).withColumn(
        "picked", F.when(override, F.col("token_brand")).otherwise(F.col("matched_brand_domain"))
    )
    named = brands.select(F.col("domain").alias("picked"), F.col("domain").alias("match_domain"), F.col("name").alias("match_name"))
    return picked.join(named, "picked", "left").drop("picked", "token_brand")


def split_by_match(matched: DataFrame, settings: Settings, threshold: float | None = None) -> tuple[DataFrame, DataFrame]:
    """(kept, unmatched).  Kept rows over the threshold get the brand as target and name where they had none, and a remark.
    Rows below it are described in ``unmatched``, and stay in ``kept`` too unless a match is required."""
    limit = settings.match_threshold if threshold is None else threshold
    over = F.col("match_domain").isNotNull() & (F.col("match_score") >= limit)
    note = F.concat(F.lit("pipeline_cse_match="), F.col("match_domain"), F.lit(";pipeline_cse_match_score="), F.format_string("%.6f", "match_score"))
    remarks = F.coalesce(F.col("remarks"), F.lit(""))
    kept = matched if not settings.require_match else matched.where(over)
    kept = kept.withColumn("target_domain", F.when(over & (F.col("target") == ""), F.col("match_domain")).otherwise(F.col("target_domain")))
    kept = kept.withColumn("cse_name", F.when(over & (F.col("cse_name") == ""), F.col("match_name")).otherwise(F.col("cse_name")))
    kept = kept.withColumn("remarks", F.when(over, F.when(remarks == "", note).otherwise(F.concat(remarks, F.lit(";"), note))).otherwise(remarks))
    unmatched = matched.where(~over).select(
        "url", F.col("detected_domain").alias("domain"), F.col("target").alias("target_brand_domain"), F.col("cse_name").alias("critical_sector_entity_name"),
        "source_label", "source_file", "source_row", F.lit("filtered_below_cse_match_threshold").alias("validation_status"),
        F.concat(F.lit("CSE match score "), F.format_string("%.6f", "match_score"), F.lit(f" < {limit}")).alias("validation_reason"),
    )
    return kept, unmatched
