"""Benchmark decontamination as a prefix-filtered set join, in DataFrame operations only.

Each window of a benchmark item is a set of word shingles.  The shingles are ordered by their rarity in the whole
corpus; as a window must be contained whole, its rarest shingle alone is a necessary prefix.  Documents are joined
on that one; the place of the shingle gives the only place where the window can lie (positional bound), which must
lie within the document (length bound); there the words themselves are compared.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keep

#: Words of text that is not lower-cased yet: all but ASCII control, space and punctuation.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
MOST_BROADCAST_ROWS = 500_000  #: rows of a few dozen to a few hundred bytes; a larger table is joined by shuffle


def word_array(text: Column) -> Column:
    return F.coalesce(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def folded(text: Column) -> Column:
    """A-Z to lower case, nothing else."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def small(df: DataFrame, rows: int | None = None) -> DataFrame:
    """The table marked for broadcast if it is counted to be small, else as it is."""
    return F.broadcast(df) if (df.count() if rows is None else rows) <= MOST_BROADCAST_ROWS else df


def _key(words: Column, at: Column, size: int) -> Column:
    return F.xxhash64(F.lit(size), *(F.lower(F.get(words, at + k)) for k in range(size)))


def item_windows(items: DataFrame, window: int, shingle: int) -> DataFrame:
    """(item, window, length, words, q, off, key): each shingle of each distinct window of the items."""
    worded = items.where("item_id is not null and text is not null").select(F.col("item_id").cast("string").alias("item"), word_array(F.col("text")).alias("w")).where(F.size("w") > 0)
    cut = worded.select("item", "w", F.explode(F.sequence(F.lit(0), F.greatest(F.size("w") - window, F.lit(0)))).alias("at"))
    cut = cut.select("item", F.slice("w", F.col("at") + 1, F.lit(window)).alias("w")).withColumn("words", folded(F.array_join("w", " ")))
    cut = cut.dropDuplicates(["item", "words"]).withColumn("length", F.size("w")).withColumn("q", F.least("length", F.lit(shingle)))
    placed = cut.select("*", F.explode(F.sequence(F.lit(0), F.col("length") - F.col("q"))).alias("off"))
    key = F.coalesce(*(F.when(F.col("q") == k, _key(F.col("w"), F.col("off"), k)) for k in range(1, shingle + 1)))
    return placed.select("item", "words", "length", "q", "off", key.alias("key"))


def find_windows(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 10, shingle: int = 4) -> DataFrame:
    """(doc_id, n_words, spans, items) for each row of ``docs``: the spans (start, length) of words, counted from 0,
    at which windows of items occur, and the ids of those items, as text; both sorted, both empty if none occurs.

    A window is ``window`` consecutive words of an item; an item of fewer words, but not none, is one window.  Words
    are compared after A-Z became a-z.  Null texts have no words; items without an id or words are left out; rows
    with equal or null ids stay apart; other columns are left out, so their names cannot clash.
    """
    shingles = keep(item_windows(items, window, shingle), "item-windows")
    sizes = sorted(r["q"] for r in shingles.select("q").distinct().collect())
    keys = keep(shingles.select("key").distinct(), "item-keys").withColumn("known", F.lit(True))

    numbered = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    n_keys = keys.count()
    if n_keys > MOST_BROADCAST_ROWS:  # rows are met again by their numbers
        numbered = keep(numbered, "numbered")
    source = numbered.select("row", "doc_id", word_array(F.col("text")).alias("w"))
    # Each row also has a place behind its last word, which stays whatever the items are.
    placed = source.select("row", "doc_id", "w", F.size("w").alias("n"), F.explode(F.sequence(F.lit(0), F.size("w"))).alias("pos"))
    here = [F.when(F.col("pos") + q <= F.col("n"), _key(F.col("w"), F.col("pos"), q)) for q in sizes]
    if len(here) > 1:
        placed = placed.select("*", F.explode(F.array(*here)).alias("key"))
    else:
        placed = placed.withColumn("key", here[0] if here else F.lit(None).cast("bigint"))
    before = F.least("pos", F.lit(window - 1))
    if n_keys <= MOST_BROADCAST_ROWS:
        marked = placed.join(small(keys, n_keys), "key", "left").where(F.col("known") | (F.col("pos") == F.col("n")))
    else:
        # Keys are shuffled alone, with the places they stand at; the words come back, by row, to those places that are left.
        met = placed.where("pos < n").select("row", "pos", "key").join(keys, "key").select("row", "pos", "key", "known").distinct()
        marked = source.withColumn("n", F.size("w")).join(met, "row")
        marked = marked.unionByName(source.select("row", "doc_id", "w", F.size("w").alias("n"), F.size("w").alias("pos")), allowMissingColumns=True)
    found = marked.select(
        "row", "doc_id", "n", "pos", F.when(F.col("known"), F.col("key")).alias("key"), before.alias("before"),
        F.when(F.col("known"), F.slice("w", F.col("pos") - before + 1, before + window)).alias("around"),
    )
    found = keep(found, "item-shingles")

    rarity = found.where("key is not null").groupBy("key").agg(F.count("*").alias("times"))
    prefix = shingles.join(rarity, "key", "left").groupBy("item", "words", "length").agg(
        F.min(F.struct(F.coalesce("times", F.lit(0)).alias("times"), "off", "key")).alias("p")
    )
    prefix = keep(prefix.where("p.times > 0").select("item", "words", "length", "p.off", "p.key"), "item-prefixes")

    joined = found.where("key is not null").join(small(prefix), "key")
    start = F.col("pos") - F.col("off")
    joined = joined.where((start >= 0) & (start + F.col("length") <= F.col("n")))
    exact = folded(F.array_join(F.slice("around", F.col("before") - F.col("off") + 1, F.col("length")), " ")) == F.col("words")
    hits = joined.where(exact).select("row", "item", start.alias("start"), "length")
    spans = hits.groupBy("row").agg(
        F.array_sort(F.collect_set(F.struct("start", "length"))).alias("spans"), F.array_sort(F.collect_set("item")).alias("items")
    )
    rows = found.where("pos = n and key is null").select("row", "doc_id", F.col("n").alias("n_words"))
    if len(here) > 1:
        rows = rows.distinct()
    return rows.join(spans, "row", "left").select(
        "doc_id", F.col("n_words").cast("long").alias("n_words"),
        F.coalesce("spans", F.array().cast("array<struct<start:int,length:int>>")).alias("spans"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
    )


def covered(spans: Column) -> Column:
    """How many words the sorted spans cover."""
    start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("total"))

    def add(s: Column, x: Column) -> Column:
        end = x["start"] + x["length"]
        return F.struct(
            F.greatest(s["end"], end).alias("end"),
            (s["total"] + F.greatest(end - F.greatest(s["end"], x["start"]), F.lit(0))).alias("total"),
        )

    return F.aggregate(spans, start, add, lambda s: s["total"])


def contamination(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated for each row of ``docs``."""
    found = find_windows(docs, items, **options).withColumn("n_hit", covered(F.col("spans")))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


ORACLE = r"""
WITH iw AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL),
ip AS (SELECT item_id, w, unnest(range(0, greatest(len(w) - 10, 0) + 1)) AS s FROM iw WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, array_to_string(w[s + 1 : s + 10], ' ') AS t, len(w[s + 1 : s + 10]) AS n FROM ip),
sizes AS (SELECT DISTINCT n FROM win),
dw AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
  FROM documents),
dp AS (SELECT r, w, n, unnest(range(0, len(w) - n + 1)) AS s FROM dw, sizes WHERE len(w) >= n),
dt AS (SELECT r, s, n, array_to_string(w[s + 1 : s + n], ' ') AS t FROM dp),
h AS (SELECT r, s, dt.n, item_id FROM dt JOIN win ON dt.t = win.t AND dt.n = win.n),
p AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(s, s + n)) AS q FROM h) GROUP BY r),
i AS (SELECT r, count(DISTINCT item_id) AS n_items, array_to_string(list_sort(list(DISTINCT CAST(item_id AS VARCHAR))), ',') AS ids FROM h GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN p USING (r) LEFT JOIN i USING (r)
"""
