"""URL filters by a temporal list join, in DataFrame operations only.

Dated list entries (a pattern is listed or taken off) become validity intervals; a capture is evaluated against
the entries that are active at its fetch time, by an as-of merge of captures and changes on the patterns that can match
its URL: its host, the parent domains of its host, and the prefixes of host and path.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import keep

HOST = r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"
PATH = r"^[^:]+://[^/?#]*(/[^?#]*)"


def host(url: Column) -> Column:
    """The lower-cased host of a URL, without user, port and trailing dot; empty if there is none."""
    return F.regexp_replace(F.coalesce(F.regexp_extract(F.lower(url), HOST, 1), F.lit("")), r"\.+$", "")


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, PATH, 1), F.lit(""))


def match_keys(url: Column) -> Column:
    """The patterns that match a URL: "host", its parents, and "host/a", "host/a/b" for each leading path segment,
    however many labels and segments there are."""
    h = host(url)
    labels = F.split(h, r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, -i, i), "."))
    segments = F.filter(F.split(path(url), "/"), lambda x: x != "")
    places = F.sequence(F.lit(0), F.size(segments))
    prefixes = F.transform(F.filter(places, lambda i: i > 0), lambda i: F.concat(h, F.lit("/"), F.array_join(F.slice(segments, F.lit(1), i), "/")))
    return F.when(h == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.concat(domains, prefixes)))


def states(entries: DataFrame) -> DataFrame:
    """(pattern, category, effective, listed): the changes of entries (pattern, category, listed boolean, effective timestamp).

    Of changes of one time, listing wins.  Entries with a null pattern, listed or time are left out; a null category is "".
    """
    known = entries.where("pattern is not null and listed is not null and effective is not null")
    known = known.select("pattern", F.coalesce("category", F.lit("")).alias("category"), "listed", "effective")
    return known.groupBy("pattern", "category", "effective").agg(F.max("listed").alias("listed"))


def intervals(entries: DataFrame) -> DataFrame:
    """(pattern, category, valid_from, valid_to): from each listing until the next change of the same pattern and category; the
    last one has no end (null)."""
    history = Window.partitionBy("pattern", "category").orderBy("effective")
    dated = states(entries).withColumn("valid_to", F.lead("effective").over(history))
    return dated.where("listed").select("pattern", "category", F.col("effective").alias("valid_from"), "valid_to")


def as_of(captures: DataFrame, entries: DataFrame, slice_days: int = 16) -> DataFrame:
    """(row, category) for each capture (row, at, pattern) and category in which its pattern is listed at the time ``at``.

    The changes and the captures of a (pattern, category) are merged once, in order of time, and each capture takes the last
    change up to its own time.  Time is cut in slices, so that no pattern, however many captures it has, is merged in one
    task; a slice begins with the listings that are valid when it begins.
    """
    length = slice_days * 86400
    of_time = lambda c: F.floor(F.unix_timestamp(c) / length)
    listed = keep(intervals(entries), "intervals")
    names = listed.select("pattern", "category").distinct()
    asked = captures.where("at is not null").join(names, "pattern")
    last = F.coalesce(of_time(F.col("valid_to")), F.lit(captures.agg(F.max(of_time(F.col("at")))).first()[0]))
    first = of_time(F.col("valid_from")) + 1
    carried = listed.where(first <= last).select("pattern", "category", F.explode(F.sequence(first, last)).alias("slice"))
    event = lambda df, slice_, at, kind, on, row: df.select("pattern", "category", slice_.alias("slice"), at.alias("at"), F.lit(kind).alias("kind"), on.cast("boolean").alias("on"), row.cast("bigint").alias("row"))
    none, slice_ = F.lit(None), F.col("slice")
    changes = states(entries)
    events = (
        event(carried, slice_, F.timestamp_seconds(slice_ * length), 0, F.lit(True), none)
        .union(event(changes, of_time(F.col("effective")), F.col("effective"), 1, F.col("listed"), none))
        .union(event(asked, of_time(F.col("at")), F.col("at"), 2, none, F.col("row")))
    )
    merged = Window.partitionBy("pattern", "category", "slice").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return events.withColumn("on", F.last("on", True).over(merged)).where("kind = 2 and on").select("row", "category")


def evaluate(captures: DataFrame, entries: DataFrame, id_col: str = "page_id", url_col: str = "url", time_col: str = "fetched_at") -> DataFrame:
    """(``id_col``, host, fetched_at, blocked, n_active, categories) for each row of ``captures``.

    n_active counts the listed (pattern, category) that match the URL and are active at fetch time (from valid_from
    on, before valid_to); categories are theirs, sorted and joined by commas.  A null or malformed URL matches
    nothing, and neither does a capture without a time.  Repeated rows come back as they are; other columns are left
    out.  The captures are written once with a number of each, so that it stays the same if a task runs again.  Only keys
    that are listed at all go on to the as-of merge.
    """
    rows = keep(captures.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(time_col).alias("at")), "captures")
    keyed = rows.select("row", "at", F.explode(match_keys(F.col("url"))).alias("pattern"))
    active = as_of(keyed, entries)
    summed = active.groupBy("row").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("category")), ",").alias("categories"))
    out = rows.select("row", "id", host(F.col("url")).alias("host"), "at").join(summed, "row", "left")
    return out.select(
        F.col("id").alias(id_col), "host", F.col("at").alias("fetched_at"), F.col("n").isNotNull().alias("blocked"),
        F.coalesce("n", F.lit(0)).cast("long").alias("n_active"), F.coalesce("categories", F.lit("")).alias("categories"),
    )


# The test tables have no list and no fetch times; both are made from the pages by rule.


def page_times(pages: DataFrame) -> DataFrame:
    """Pages with fetched_at, in the year 2024: page_id * 97 minutes, within a year."""
    minutes = F.pmod(F.col("page_id") * 97, F.lit(366 * 24 * 60))
    return pages.select("page_id", "url", F.timestamp_seconds(F.lit(1704067200) + minutes * 60).alias("fetched_at"))


def host_list(pages: DataFrame) -> DataFrame:
    """A dated list over the hosts of the pages: by the first bytes of the host's MD5, three eighths are listed on a
    day, taken off up to 127 days later, and half of those listed again after 90 days more; example.net is listed
    for June and, as another category, its path "fr" of each host all year."""
    hosts = pages.select(host(F.col("url")).alias("pattern")).where("pattern <> ''").distinct()
    byte = lambda k: F.conv(F.substring(F.md5(F.col("pattern").cast("binary")), 2 * k + 1, 2), 16, 10).cast("int")
    day = lambda n: F.timestamp_seconds(F.lit(1704067200) + n * 86400)
    some = hosts.select("pattern", byte(0).alias("a"), byte(1).alias("b"), byte(2).alias("c"))
    chosen = some.where("a < 96")
    off = F.col("b") + F.pmod(F.col("c"), F.lit(128))
    category = F.concat(F.lit("c"), F.pmod(F.col("a"), F.lit(3)).cast("string"))
    parts = [
        chosen.select("pattern", category.alias("category"), F.lit(True).alias("listed"), day(F.col("b")).alias("effective")),
        chosen.select("pattern", category.alias("category"), F.lit(False).alias("listed"), day(off).alias("effective")),
        chosen.where("a < 48").select("pattern", category.alias("category"), F.lit(True).alias("listed"), day(off + 90).alias("effective")),
        some.where("a >= 128").select(F.concat("pattern", F.lit("/fr")).alias("pattern"), F.lit("path").alias("category"), F.lit(True).alias("listed"), day(F.lit(0)).alias("effective")),
        pages.sparkSession.sql(
            "SELECT 'example.net' AS pattern, 'net' AS category, listed, timestamp_seconds(1704067200 + d * 86400) AS effective"
            " FROM VALUES (true, 152), (false, 182) AS t(listed, d)"
        ),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out


ORACLE = r"""
WITH pg AS (
  SELECT row_number() OVER () AS r, page_id, url,
    regexp_replace(coalesce(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1), ''), '\.+$', '') AS host,
    string_split(coalesce(regexp_extract(url, '^[^:]+://[^/?#]*(/[^?#]*)', 1), ''), '/') AS seg,
    make_timestamp((1704067200 + ((page_id * 97) % 527040) * 60) * 1000000) AS fetched_at
  FROM pages),
hs AS (
  SELECT host, CAST('0x' || substr(md5(host), 1, 2) AS INTEGER) AS a, CAST('0x' || substr(md5(host), 3, 2) AS INTEGER) AS b, CAST('0x' || substr(md5(host), 5, 2) AS INTEGER) AS c
  FROM (SELECT DISTINCT host FROM pg WHERE host <> '')),
entries AS (
  SELECT host AS pattern, 'c' || (a % 3) AS category, true AS listed, b AS d FROM hs WHERE a < 96
  UNION ALL SELECT host, 'c' || (a % 3), false, b + c % 128 FROM hs WHERE a < 96
  UNION ALL SELECT host, 'c' || (a % 3), true, b + c % 128 + 90 FROM hs WHERE a < 48
  UNION ALL SELECT host || '/fr', 'path', true, 0 FROM hs WHERE a >= 128
  UNION ALL SELECT 'example.net', 'net', true, 152
  UNION ALL SELECT 'example.net', 'net', false, 182),
states AS (SELECT pattern, category, make_timestamp((1704067200 + CAST(d AS BIGINT) * 86400) * 1000000) AS t, bool_or(listed) AS listed FROM entries GROUP BY ALL),
spans AS (SELECT *, lead(t) OVER (PARTITION BY pattern, category ORDER BY t) AS until FROM states),
act AS (
  SELECT r, category FROM pg JOIN spans s ON s.listed AND s.t <= pg.fetched_at AND (s.until IS NULL OR pg.fetched_at < s.until)
    AND pg.host <> '' AND (s.pattern = pg.host OR ends_with(pg.host, '.' || s.pattern)
      OR starts_with(pg.host || '/' || array_to_string(list_filter(seg, lambda x: x <> ''), '/') || '/', s.pattern || '/') AND contains(s.pattern, '/'))),
g AS (SELECT r, count(*) AS n, array_to_string(list_sort(list(DISTINCT category)), ',') AS categories FROM act GROUP BY r)
SELECT page_id, host, fetched_at, n IS NOT NULL AS blocked, CAST(coalesce(n, 0) AS BIGINT) AS n_active, coalesce(categories, '') AS categories
FROM pg LEFT JOIN g USING (r)
"""
