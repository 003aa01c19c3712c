"""Robust outliers, hard negatives and collocations against brute force, with nulls, odd texts, ties and repeated rows."""

import math
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from lurelens.llm import negatives, outliers, phrases

# Quality rules: 11.


def counts_of(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    seen = Counter(windows)
    repeated = {i + k for i, w in enumerate(windows) if seen[w] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeated)


def test_base_counts(spark):
    long = " ".join(f"w{i % 700}" for i in range(5000))
    texts = [None, "", " \n\t ", "a b c d", "a b c d e", "a b c d e a b c d e", "x " * 30, "a\nb\na\n \n \nb", "é𝄞 #*$ <b>|%&", "\x1ca\x85b c", long, "q w e r t q w e r t q w e r", "\x0ba\x0cb\rc"]
    docs = spark.createDataFrame([(i, t, "en", "s", 1, "x") for i, t in enumerate(texts)], "doc_id bigint, text string, lang string, source string, n_words int, words string")
    found = {r["doc_id"]: r for r in outliers.quality_rules(docs).collect()}
    assert len(found) == len(texts)
    for i, t in enumerate(texts):
        n, chars, symbols, lines, repeated = want = counts_of(t)
        r = found[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want, t
        failed = n < 10 or 100 * repeated > 20 * n
        assert (r["base_failed"], r["kept"]) == (failed, not failed)  # too few texts for an estimate


def test_chi_square():
    assert outliers.chi_square_quantile(0.95, 2) == pytest.approx(-2 * math.log(0.05))
    assert outliers.chi_square_quantile(0.95, 6) == pytest.approx(12.5916, abs=1e-3)


def brute_mcd(x, share=0.5):
    """The procedure in numpy: medians, concentration on whole bins until the determinant stays, the reweighted estimate."""
    floors = np.square(np.array(outliers.FLOORS) * outliers.UNIT)
    centre = np.median(x, axis=0)
    cov = np.diag(np.maximum(1.4826 * np.median(np.abs(x - centre), axis=0), np.sqrt(floors)) ** 2)

    def distance(centre, cov):
        return np.einsum("ij,jk,ik->i", x - centre, np.linalg.inv(cov), x - centre)

    def estimate(rows, factor):
        return rows.mean(0), factor * np.cov(rows.T, bias=True) + np.diag(floors)

    was = None
    for _ in range(12):
        bins = np.floor(64 * np.log2(distance(centre, cov) + 2.0**-20))
        last = np.sort(bins)[math.ceil(share * len(x)) - 1]
        centre, cov = estimate(x[bins <= last], outliers.consistency(share))
        now = np.linalg.slogdet(cov)[1]
        if was is not None and abs(now - was) < 0.02:
            break
        was = now
    near = distance(centre, cov) <= outliers.chi_square_quantile(0.975, outliers.P)
    return distance(*estimate(x[near], outliers.consistency(0.975)))


def test_outliers_by_lang_and_source(spark):
    rng = np.random.default_rng(3)
    word = lambda: "".join(rng.choice(list("abcdefghijkl"), rng.integers(2, 9)))
    clean = lambda: " ".join(word() for _ in range(int(rng.integers(30, 300)))) + "."
    rows, junk = [], []
    for k in range(900):
        text = clean()
        if k % 10 == 0:
            text = " ".join(w + "###" for w in text.split())
            junk.append(k)
        # A hot source, one of its own size, sources to pool, and nulls.
        source = "hot" if k % 3 == 0 else "mid" if k % 3 == 1 else None if k % 2 else f"s{k}"
        rows.append((k, text, "en" if k % 2 else None, source))
    docs = spark.createDataFrame(rows + rows[:5], "doc_id bigint, text string, lang string, source string").repartition(5)
    out = outliers.quality_rules(docs, least_rows=100).collect()
    assert len(out) == 905
    assert {r["doc_id"] for r in out if not r["kept"] and not r["base_failed"]} == set(junk)
    assert all(r["distance"] is not None for r in out if not r["base_failed"])
    one = [r for r in rows if r[3] == "hot" and r[2] == "en"]
    docs = spark.createDataFrame(one, docs.schema)
    found = {r["doc_id"]: r["distance"] for r in outliers.quality_rules(docs, least_rows=100).where("not base_failed").collect()}
    measured = outliers.base_counts(docs.where(docs.doc_id.isin(list(found))), "text", docs.doc_id).select("doc_id", *outliers._vector()).toPandas()
    want = dict(zip(measured["doc_id"], brute_mcd(measured[[f"x{k}" for k in range(outliers.P)]].to_numpy(float)), strict=True))
    assert all(found[k] == pytest.approx(want[k], rel=1e-6) for k in want)
    assert outliers.quality_rules(docs.limit(0)).count() == 0


# Hard negatives: 12.


def brute_negatives(rows, anchors, percent=80, k=5):
    whole = [(i, lab, [math.floor(256 * x) for x in v]) for i, lab, v in rows if i is not None and lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, lab, v in [r for r in whole if r[0] in anchors]:
        scored = sorted((-sum(p * q for p, q in zip(v, w, strict=True)), i, other) for i, other, w in whole if i != a and len(w) == len(v))
        for ps, p, _ in [x for x in scored if x[2] == lab][:k]:
            fits = [x for x in scored if x[2] != lab and percent * -ps <= 100 * -x[0] <= 100 * -ps][:k]
            out += [(a, p, r, i, -ps, -ns) for r, (ns, i, _) in enumerate(fits, 1)]
    return sorted(out)


@pytest.mark.parametrize("buckets,blocks", [(16, 4), (5000, 512)])
def test_hard_negatives(spark, buckets, blocks):
    rng = np.random.default_rng(5)
    rows = [(i, int(rng.integers(3)), (rng.standard_normal(6) * rng.choice([0.1, 1.0, 4.0])).round(2).tolist()) for i in range(300)]
    rows += [(300 + i, rows[7][1], rows[7][2]) for i in range(40)]  # a hot group of equal vectors
    rows += [(400, None, [1.0] * 6), (401, 1, None), (402, 1, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (403, 1, [math.nan] * 6), (404, 2, [math.inf] * 6), (None, 1, [1.0] * 6)]
    rows += [(405, 1, [0.0] * 6), (406, 2, [0.0] * 6), (407, 1, [1.0, 2.0]), (408, 2, [0.9, 2.0]), (409, 1, [1.1, 1.9]), (410, 9, [3.0] * 6)]
    anchors = {*range(0, 300, 10), 305, 405, 407, 410}
    schema = "vec_id bigint, label int, embedding array<double>"
    vectors = spark.createDataFrame(rows, schema).repartition(4)
    chosen = vectors.where(vectors.vec_id.isin(list(anchors)))
    found = negatives.hard_negatives(vectors, chosen, bucket_rows=buckets, block_rows=blocks)
    got = sorted(map(tuple, found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()))
    assert got == brute_negatives(rows, anchors)
    assert negatives.hard_negatives(vectors.limit(0), chosen.limit(0)).count() == 0
    assert negatives.hard_negatives(vectors, chosen.limit(0)).count() == 0


def test_products_stay_exact():
    a, b = np.array([[2.0**30, 3.0]]), np.array([[2.0**30 + 1, 5.0], [-(2.0**30), 1.0]])
    assert negatives.products(a, b).tolist() == [[2**30 * (2**30 + 1) + 15, -(2**60) + 3]]
    with pytest.raises(OverflowError):
        negatives.products(np.array([[2.0**40]]), np.array([[2.0**40]]))


def test_short_buckets_are_left_unread():
    """A block whose anchors have found enough does not reach buckets of shorter vectors."""
    x = np.array([[10.0, 0.0]])
    wanted = negatives.Windows.of_positives(1, 1)
    state = np.array([[[[90, 5]]]], np.int64)
    assert wanted.reach(state, np.array([10.0]))[0] == pytest.approx(9.0)
    block, short = (np.array([1]), np.array([0]), x, np.array([10.0])), (np.array([2]), np.array([0]), np.array([[8.0, 0.0]]), np.array([8.0]))
    assert (wanted.visit(state, block, short)[0, 0, 0] == (negatives.NO_SCORE, negatives.NO_ID)).all()


# Collocations: 13.


def brute_collocations(rows, least, top=2000):
    f, total = Counter(), Counter()
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(fold)):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            f.update((lang, tuple(words[i : i + m])) for m in range(1, 5) for i in range(len(words) - m + 1))
    longer = Counter()
    for (lang, w), a in f.items():
        if a >= least and len(w) > 2:
            for m in range(2, len(w)):
                for i in range(len(w) - m + 1):
                    longer[lang, w[i : i + m]] = max(longer[lang, w[i : i + m]], a)
    out = {}
    for (lang, w), a in f.items():
        if a >= least and len(w) > 1 and 100 * longer[lang, w] < 80 * a:
            score, _, left, right = min((2000000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w)))
            out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), left, right))
    return [(lang, r, p.decode(), -a, left, right, total[lang], -s) for lang, some in sorted(out.items()) for r, (s, a, p, left, right) in enumerate(sorted(some)[:top], 1)]


COLUMNS = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def corpus():
    rng = np.random.default_rng(2)
    words = [f"w{i}" for i in range(12)] + ["É", "été", "Zoë", "\x01x", "𝄞", "ab-c", "x" * 300]
    text = lambda n: "".join(rng.choice(words) + rng.choice([" ", " ", " ", "\t", "  ", ". ", "\n", ",;"]) for _ in range(n))
    rows = [(str(rng.choice(["en", "de"])), text(int(rng.integers(1, 120)))) for _ in range(150)]
    rows += [(None, text(60)), ("en", None), ("de", ""), ("en", " \t\n"), ("en", "Deep Hot Pair here " * 400), ("fr", "only once")]
    return rows + rows[:20]


@pytest.mark.parametrize("range_words,share", [(2_000_000, 64), (150, 1)])
def test_collocations(spark, range_words, share):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, lang, "a", 1) for i, (lang, t) in enumerate(rows)], "doc_id bigint, text string, lang string, phrase string, n int").repartition(6)
    found = phrases.collocations(docs, least=5, range_words=range_words, share=share)
    got = sorted((tuple(r[c] for c in COLUMNS) for r in found.collect()), key=lambda r: r[:2])
    assert got == brute_collocations(rows, 5)
    few = phrases.collocations(docs, least=5, top=3, range_words=range_words, share=share).collect()
    assert sorted((tuple(r[c] for c in COLUMNS) for r in few), key=lambda r: r[:2]) == brute_collocations(rows, 5, 3)
    assert phrases.collocations(docs.limit(0)).count() == 0


def test_collocation_sql_says_the_same():
    rows = corpus()
    db = duckdb.connect()
    db.execute("CREATE TABLE documents (lang VARCHAR, text VARCHAR)")
    db.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    got = db.sql(phrases.ORACLE.replace(">= 30", ">= 5")).fetchall()
    assert sorted(got, key=lambda r: r[:2]) == brute_collocations(rows, 5)


def test_tries_of_large_vocabularies():
    """More words than four ids fit into 64 bits: paths are ranked in pairs, and merged tries are those of all paths."""
    rng = np.random.default_rng(4)
    vocabulary = [phrases.STOP, *(f"v{i:06d}".encode() for i in rng.permutation(70_000))]
    streams = [rng.integers(0, 70_001, 90_000).astype(np.uint32), np.arange(1, 70_001, dtype=np.uint32)]
    parts = [phrases.Trie.of_stream(s, vocabulary) for s in streams]
    read = [phrases.Trie.read(*t.serialised()) for t in parts]
    merged = phrases.Trie.merge(read)
    paths = Counter()
    for s in streams:
        padded = np.concatenate((s, np.zeros(4, np.uint32)))
        for i in np.flatnonzero(s):
            path = padded[i : i + 4].tolist()
            paths[tuple(vocabulary[x] for x in (path[: path.index(0)] if 0 in path else path))] += 1
    assert [merged.path(k) for k in range(len(merged.ids))] == sorted(paths)
    assert merged.counts.tolist() == [paths[p] for p in sorted(paths)]
    bounds = [merged.path(len(merged.ids) // 3), merged.path(len(merged.ids) // 2)]
    cut = list(merged.slices(bounds))
    assert [t.path(0) for _, t in cut[1:]] == bounds and sum(int(t.counts.sum()) for _, t in cut) == int(merged.counts.sum())
