"""Reference hashes of brands: their official pages' favicon, logo and structure."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Settings
from ..functions import html as H
from ..functions import text as T
from ..functions.hashing import image_hashes
from ..operators.chains import Ask
from ..operators.evidence import HTTP, lookup
from ..operators.hosts import resolve
from ..storage import keep

IMAGE_ALGORITHM, TEXT_ALGORITHM = "phash64", "simhash64"


@dataclass
class References:
    favicons: DataFrame  #: domain, favicon_hash, hash_algorithm, status, final_url
    pages: DataFrame  #: domain, html_dom_hash, ...
    logos: DataFrame  #: domain, logo_hash, ...


def brand_references(brands: DataFrame, settings: Settings, fetch: Ask, fetch_binary: Ask) -> References:
    """The references of the distinct brand hosts.

    ``fetch`` gives HTTP evidence for a table of URLs: each host is fetched by https, and by http where that fails.
    ``fetch_binary`` gives (url, data) for URLs of images, each asked for once.  The status is "success" with a hash,
    "image_hash_failed" where only the image failed, else the fetch's; a page that was not fetched is "fetch_failed".
    """
    hosts = keep(brands.select(T.hostname("domain").alias("host")).where("host <> ''").distinct(), "hosts")
    columns = [c.split(" ")[0] for c in HTTP.split(", ")]
    url = lambda scheme: F.concat(F.lit(f"{scheme}://"), "host")
    first = keep(fetch(hosts.select(url("https").alias("url"))).select(*columns), "https")
    failed = keep(lookup(hosts, first, "url", url("https"), "h_").where("coalesce(h_fetch_success, 0) = 0").select("host"), "failed")
    second = keep(fetch(failed.select(url("http").alias("url"))).select(*columns), "http")
    pages = lookup(lookup(hosts, first, "url", url("https"), "a_"), second, "url", url("http"), "b_")
    better = F.coalesce(F.col("a_fetch_success") == 1, F.lit(False))
    rest = [c for c in columns if c != "url"]
    pages = pages.select("host", *(F.when(better, F.col(f"a_{c}")).otherwise(F.coalesce(f"b_{c}", f"a_{c}")).alias(c) for c in rest))
    pages = pages.withColumns({"page": H.page_parts(F.coalesce("html", F.lit(""))), "base": F.coalesce(F.nullif("final_url", F.lit("")), url("https"))})
    pages, (known,) = resolve(keep(pages, "parsed"), {"_sh": F.col("host")}, settings.suffixes)
    logo = H.logo_source(F.col("page.images"), T.brand_tokens(F.col("host"), F.lit(""), known))
    pages = keep(pages.select("host", "html", "fetch_success", "status", "final_url", "base", "page.icon", logo.alias("logo")), "pages")
    address = F.when(F.col("logo") != "", H.join_url(F.col("base"), F.col("logo"))).otherwise("")
    pages = keep(pages.withColumns({"icon": H.favicon_url(F.col("base"), F.col("icon")), "logo": address}), "image-addresses")
    wanted = pages.select(F.explode(F.array("icon", "logo")).alias("url")).where("url <> ''").distinct()
    images = keep(fetch_binary(wanted).select("url", "data"), "images").withColumn("hash", F.coalesce(image_hashes("data"), F.lit(""))).select("url", "hash")
    images = keep(images, "image-hashes")
    hashed = lookup(lookup(pages, images, "url", F.col("icon"), "i_"), images, "url", F.col("logo"), "l_")
    fetched = F.coalesce(F.col("fetch_success") == 1, F.lit(False))
    told = F.when(fetched, F.coalesce("status", F.lit("error"))).otherwise("fetch_failed")
    hashed = hashed.withColumn("dom", F.when(fetched, H.dom_hash("html")).otherwise(""))

    def table(name: str, hash_, algorithm: str, image: bool) -> DataFrame:
        value = F.coalesce(hash_, F.lit(""))
        status = F.when(value != "", "success").when(fetched & F.lit(image), "image_hash_failed").otherwise(told)
        return hashed.select(F.col("host").alias("domain"), value.alias(name), F.lit(algorithm).alias("hash_algorithm"), status.alias("status"), F.coalesce(F.nullif("final_url", F.lit("")), F.lit("unknown")).alias("final_url"))

    return References(table("favicon_hash", F.col("i_hash"), IMAGE_ALGORITHM, True), table("html_dom_hash", F.col("dom"), TEXT_ALGORITHM, False), table("logo_hash", F.col("l_hash"), IMAGE_ALGORITHM, True))
