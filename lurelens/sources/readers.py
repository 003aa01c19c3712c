"""Readers of candidate files, brand lists, feeds, hash sets and evidence files.

Files are read by Spark's own sources; which headers a file has decides its projection on the driver, before any row is
read.  ``ord`` numbers rows by file name and place in the file.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import ASN_HEADERS, BRAND_DOMAIN_HEADERS, BRAND_NAME_HEADERS, HEADERS, SUFFIXES
from ..functions import text as T
from ..functions.udf import vectorized
from ..storage import keep
from .workbook import read_workbook

CONTEXT = ("url", "detected_domain", "target_domain", "cse_name", "source_label", "registrar_name", "registrant_name", "registrant_country", "nameservers", "hosting_ip", "hosting_isp", "hosting_country", "dns_records", "remarks", "source_file", "source_row")
SKIPPED_NAMES = ("audit", "dns_failed", "failed_urls")
PREFERRED = HEADERS["detected"] + ("Domain", "URL")


def _files(spark: SparkSession, folder: str) -> list[str]:
    """Paths of the files of a folder, by name, through Hadoop's file systems."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [fs.getFileStatus(path)] if fs.getFileStatus(path).isFile() else list(fs.listStatus(path))
    return sorted((str(f.getPath().toString()) for f in found if f.isFile()), key=lambda p: p.rsplit("/", 1)[-1])


def _name(path: str) -> str:
    return path.rsplit("/", 1)[-1]


def candidate_files(spark: SparkSession, folder: str) -> list[str]:
    """Files that a collector reads: tables that are no lock files and no results of ours."""
    found = [p for p in _files(spark, folder) if _name(p).lower().endswith((".csv", ".xlsx", ".xls"))]
    return [p for p in found if not _name(p).startswith("~$") and not any(s in _name(p).lower() for s in SKIPPED_NAMES)]


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(url): the lines that are neither blank nor comments, trimmed."""
    return spark.read.text(path).select(T.strip("value").alias("url")).where("url <> '' and not startswith(url, '#')")


def read_csv(spark: SparkSession, path: str, encoding: str | None = None) -> DataFrame:
    """All columns as text.  UTF-8 with or without a mark; a file that is no UTF-8 is read as Latin-1.

    A first pass over the lines finds the encoding and whether any line has an odd number of quotes: only then can a
    value go over lines, and the file is read as a whole; any other file is read in splits."""
    odd = F.col("value").isNotNull() & (F.length(F.regexp_replace("value", '[^"]', "")) % 2 == 1)
    seen = spark.read.text(path).agg(F.count_if(~F.expr("is_valid_utf8(value)")).alias("broken"), F.count_if(odd).alias("odd")).first()
    encoding = encoding or ("ISO-8859-1" if seen["broken"] else "UTF-8")
    df = spark.read.csv(path, header=True, encoding=encoding, multiLine=seen["odd"] > 0, escape='"', enforceSchema=False)
    return df.toDF(*(c.lstrip("﻿") for c in df.columns))


def read_table(spark: SparkSession, path: str) -> DataFrame:
    low = path.lower()
    if low.endswith(".txt"):
        return read_lines(spark, path)
    return read_workbook(spark, path) if low.endswith((".xlsx", ".xls")) else read_csv(spark, path)


def aliased(df: DataFrame, headers: tuple[str, ...]) -> Column:
    """The first filled one of the headers that the table has."""
    there = [F.col(f"`{h}`") for h in headers if h in df.columns]
    return T.first_filled(*there) if there else F.lit("")


def row_number_in_file(df: DataFrame) -> Column:
    """The place, from 0, of each row of a table that is read from one file.  The rows of a split count on from those of
    the splits before it; one count for each split comes to the driver, where there are several."""
    within = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    if df.rdd.getNumPartitions() < 2:
        return within
    counts = sorted(map(tuple, df.groupBy(F.spark_partition_id().alias("p")).count().collect()))
    starts, before = [], 0
    for part, n in counts:
        starts += [F.lit(part), F.lit(before)]
        before += n
    return within + F.coalesce(F.create_map(*starts)[F.spark_partition_id()], F.lit(0)) if starts else within


def to_contexts(df: DataFrame, file: str) -> DataFrame:
    """Candidate rows of a raw table; rows without a host are left out.  source_row counts the header line as 1."""
    host = T.hostname(aliased(df, HEADERS["detected"]))
    numbered = df.withColumn("_n", row_number_in_file(df))
    one = lambda k: aliased(df, HEADERS[k]).alias(k)
    out = numbered.select(
        T.ensure_url(aliased(df, HEADERS["detected"])).alias("url"), host.alias("detected_domain"), one("target_domain"), one("cse_name"),
        T.inferred_label(aliased(df, HEADERS["source_label"]), F.lit(file)).alias("source_label"), *map(one, CONTEXT[5:14]),
        F.lit(file).alias("source_file"), (F.col("_n") + 2).alias("source_row"),
    )
    return out.where("detected_domain <> ''")


def read_contexts(spark: SparkSession, folder: str) -> DataFrame:
    """Candidate rows of all tables and lists of a folder, in the order of file names; a file that cannot be read is left
    out with a warning, and a folder without files is an error."""
    found = [p for p in _files(spark, folder) if p.lower().endswith((".csv", ".xlsx", ".txt"))]
    if not found:
        raise FileNotFoundError(f"no .csv, .xlsx or .txt files in {folder}")
    out = None
    for number, path in enumerate(found):
        try:
            rows = to_contexts(read_table(spark, path), _name(path))
        except Exception as error:  # one bad file must not stop the others
            import warnings

            warnings.warn(f"{_name(path)} cannot be read: {error}", stacklevel=2)
            continue
        rows = rows.withColumn("ord", F.lit(number).cast("long") * (1 << 40) + F.col("source_row"))
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        raise FileNotFoundError(f"no readable files in {folder}")
    return out


def candidate_column(df: DataFrame) -> str:
    """The column that holds the candidates: a preferred header, else the first that names a domain or URL."""
    for name in PREFERRED:
        if name in df.columns:
            return name
    for name in df.columns:
        if "domain" in name.lower() or "url" in name.lower():
            return name
    raise ValueError(f"no usable column in {df.columns}")


def brands_from(df: DataFrame) -> DataFrame:
    """(domain, name): the hosts of each cell; of equal hosts the name of the first."""
    rows = df.select(aliased(df, BRAND_NAME_HEADERS).alias("name"), F.posexplode(T.split_hosts(aliased(df, BRAND_DOMAIN_HEADERS))).alias("pos", "domain"), F.monotonically_increasing_id().alias("row"))
    return rows.groupBy("domain").agg(F.min_by("name", F.struct("row", "pos")).alias("name"))


def read_brands(spark: SparkSession, path: str) -> DataFrame:
    return brands_from(read_table(spark, path))


@vectorized("string")
def idna(names: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """The ASCII form of host names; a name that has none stays as it is."""

    def one(name: str) -> str:
        try:
            return name.encode("idna").decode()
        except UnicodeError:
            return name

    for part in names:
        yield part.map(one)


def suffix_rules(texts: DataFrame, column: str = "value", private: bool = False) -> DataFrame:
    """The rule table (name, more) of texts in the format of public suffix lists: a rule a line, up to the first white space;
    lines that begin with // are comments; rules after the line that begins the private domains only if they are
    wanted.  ``more`` is 1 for a wildcard, -1 for an exception, else 0; names come in Unicode and in their ASCII form."""
    mark = "===BEGIN PRIVATE DOMAINS==="
    public = F.col(column) if private else F.substring_index(F.col(column), mark, 1)
    lines = texts.select(F.explode(F.split(public, r"\r?\n")).alias("line")).select(F.lower(F.regexp_extract("line", r"^\s*(\S+)", 1)).alias("rule"))
    rules = lines.where("rule <> '' and not startswith(rule, '//')")
    more = F.when(F.col("rule").startswith("*."), 1).when(F.col("rule").startswith("!"), -1).otherwise(0)
    named = rules.select(F.regexp_replace("rule", r"^(?:\*\.|!)", "").alias("name"), more.alias("more"))
    return named.select(F.explode(F.array("name", idna("name"))).alias("name"), "more").where("name <> ''").distinct()


def read_suffix_rules(spark: SparkSession, path: str | None = None, private: bool = False) -> DataFrame:
    """The rule table of a list file; without a path, of the list that comes with Spark's HTTP client, some 250 kB of text on
    the driver's class path, and of SUFFIXES, some of which are younger than it."""
    if path:
        return keep(suffix_rules(spark.read.text(path, wholetext=True), private=private), "suffix-rules")
    jvm = spark._jvm
    stream = jvm.java.lang.Thread.currentThread().getContextClassLoader().getResourceAsStream("mozilla/public-suffix-list.txt")
    if stream is None:
        raise FileNotFoundError("no public suffix list on the class path; give a path")
    text = jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    stream.close()
    text = "\n".join((*SUFFIXES, text))
    return keep(suffix_rules(spark.createDataFrame([(text,)], "value string"), private=private), "suffix-rules")  # many joins read it


def read_feed(spark: SparkSession, path: str) -> DataFrame:
    """(url) of a saved feed: text, CSV (a url column, else the first), or JSON list of texts or of objects with url; bz2
    and gzip are unpacked by Spark."""
    plain = path.lower().removesuffix(".bz2").removesuffix(".gz")
    if plain.endswith(".json"):
        whole = spark.read.text(path, wholetext=True)
        items = whole.select(F.explode(F.coalesce(F.from_json("value", "array<string>"), F.array().cast("array<string>"))).alias("item"))
        out = items.select(T.clean(F.coalesce(F.get_json_object("item", "$.url"), F.when(~F.col("item").startswith("{"), F.col("item")))).alias("url"))
    elif plain.endswith(".csv"):
        df = read_csv(spark, path)
        name = next((c for c in ("url", "URL") if c in df.columns), df.columns[0])
        out = df.select(T.clean(F.col(f"`{name}`")).alias("url"))
    else:
        return read_lines(spark, path)
    return out.where("url <> ''")


PERMUTATION_KEYS = ("domain-name", "domain", "hostname", "url", "URL")


def ordered_permutations(texts: DataFrame, column: str = "json", brand: str = "brand") -> DataFrame:
    """(brand, host, at) from the JSON output of a permutation generator, which may stand among other text, with the first
    place of each host; the brand's own domain and what lies below it are left out."""
    begin, end = F.locate("[", F.col(column)), F.length(F.col(column)) - F.locate("]", F.reverse(F.col(column))) + 1
    sliced = F.when((begin > 0) & F.col(column).contains("]"), F.substr(F.col(column), begin, end - begin + 1)).otherwise(F.concat(F.lit("["), F.col(column), F.lit("]")))
    items = texts.select(brand, F.posexplode(F.from_json(sliced, "array<map<string,string>>")).alias("at", "item"))
    host = T.hostname(T.first_filled(*(F.col("item")[k] for k in PERMUTATION_KEYS)))
    own = T.hostname(brand)
    found = items.select(brand, host.alias("host"), "at").where((F.col("host") != "") & (F.col("host") != own) & ~F.col("host").endswith(F.concat(F.lit("."), own)))
    return found.groupBy(brand, "host").agg(F.min("at").alias("at"))


def permutations_from(texts: DataFrame, column: str = "json", brand: str = "brand") -> DataFrame:
    """(brand, host): the distinct permutations."""
    return ordered_permutations(texts, column, brand).drop("at")


def permutation_sources(brands: DataFrame, wanted: list[str] | None = None, limit: int = 0) -> DataFrame:
    """The brands to permute: those named, or all; by domain; at most ``limit``."""
    chosen = brands.select("domain").distinct()
    if wanted:
        chosen = chosen.where(F.col("domain").isin(*wanted))
    chosen = chosen.orderBy("domain")
    return chosen.limit(limit) if limit else chosen


def read_hashes(spark: SparkSession, path: str) -> DataFrame:
    """(hash): one on each line, lower case."""
    return spark.read.text(path).select(F.lower(T.strip("value")).alias("hash")).where("hash <> ''").distinct()


def read_references(spark: SparkSession, path: str, hash_col: str) -> DataFrame:
    """(domain, hash) of a file of brand hashes."""
    df = read_csv(spark, path)
    return df.select("domain", F.col(hash_col).alias("hash")).where("hash <> ''")


def references_valid(df: DataFrame, hash_col: str, algorithm: str) -> bool:
    """Whether a reference table is of one algorithm and has a hash."""
    if not {hash_col, "hash_algorithm"} <= set(df.columns):
        return False
    seen = df.agg(F.count_if(T.clean("hash_algorithm") != algorithm).alias("other"), F.count_if(T.clean(hash_col) != "").alias("hashes")).first()
    return seen["other"] == 0 and seen["hashes"] > 0


def read_asn_cache(spark: SparkSession, path: str) -> DataFrame:
    df = read_csv(spark, path)
    return df.select(T.clean("ip").alias("ip"), aliased(df, ASN_HEADERS).alias("asn_org"), F.lit("cache").alias("status"), F.lit("").alias("error")).where("ip <> '' and asn_org <> ''")


def bootstrap_from(texts: DataFrame, column: str = "json") -> DataFrame:
    """(tld, server) of a registry bootstrap file."""
    services = F.from_json(F.get_json_object(column, "$.services"), "array<array<array<string>>>")
    one = texts.select(F.explode(services).alias("s")).select(F.explode(F.get("s", F.lit(0))).alias("tld"), F.get(F.get("s", F.lit(1)), F.lit(0)).alias("server"))
    return one.select(F.lower("tld").alias("tld"), F.regexp_replace("server", "/+$", "").alias("server"))


def read_features(spark: SparkSession, path: str, fallback: str | None = None, schema: str | None = None) -> DataFrame:
    """A feature file; the fallback if it is missing; an empty file is an empty table of ``schema``."""
    for one in filter(None, (path, fallback)):
        try:
            if schema and not spark.read.text(one).limit(1).count():
                return spark.createDataFrame([], schema)
            return read_csv(spark, one)
        except Exception as error:
            if "PATH_NOT_FOUND" not in str(error):
                raise
    raise FileNotFoundError(path)
