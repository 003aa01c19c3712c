"""The ten operators against brute force, on small tables with nulls, empty and long texts, ties and repeated rows."""

import hashlib
import math
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lurelens.llm import ann, bpe, dac, decontam, lm, neardup, quality, tokcount, urlfilter, warc
from lurelens.llm.graph import components
from lurelens.llm.pretokens import make_split
from lurelens.llm.shingles import Shingler

DOC = "doc_id bigint, text string, id string, ids string, key string, bucket string, row string, words string"
ODD = ["", None, "   ", "Hello world", "Hello world", "don't stop! 1234 ½ naïve ÀÉ\t\n  x\n", "日本語テキスト <|endoftext|> end", "\x1c\x85 \xa0a", "a" * 3000, "word " * 2000, "é́   fin", "I'll we're 's 't"]


def docs_of(spark, texts, start=0):
    return spark.createDataFrame([(i + start, t, "x", "x", "x", "x", "x", "x") for i, t in enumerate(texts)], DOC)


@pytest.fixture(scope="module")
def ranks():
    return bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


def test_pretokens_join_to_the_text():
    split = make_split(public_tokenizers.PATTERN)
    for t in filter(None, ODD):
        assert "".join(split(t)) == t


def test_bpe_round_trip(spark, ranks):
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = ODD + ["zażółć gęślą jaźń Anblewh sttible", "xqzjkvw"]
    coded = bpe.encode(docs_of(spark, texts), ranks, public_tokenizers.PATTERN, block_chars=2500)
    found = {r["doc_id"]: r for r in bpe.decode(coded, ranks).collect()}
    assert len(found) == len(texts)
    for i, t in enumerate(texts):
        assert list(found[i]["ids"]) == encoding.encode_ordinary(t or ""), t
        assert bytes(found[i]["bytes"]) == (t or "").encode()
    assert bpe.encode(docs_of(spark, []), ranks, public_tokenizers.PATTERN).count() == 0


def test_fold_gives_the_ids_of_the_library(spark, ranks):
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    words = ["a", "aa", " the", " sttible", "zażółć", "!!!!!!!", "aaaaaaaaaaaaaaaaa", "xqzjkvw", "\u3042\u3044", "Anblewh" * 30]
    rows = [(w, [ranks[bytes([b])] for b in w.encode()]) for w in words]
    spelled = spark.createDataFrame(rows, "word string, spelled array<int>")
    coded = spelled.select("word", bpe._let(bpe.pair_table(ranks), lambda t: bpe.fold_word(F.col("spelled"), t)).alias("ids"))
    assert {r["word"]: r["ids"] for r in coded.collect()} == {w: encoding.encode_ordinary(w) for w in words}


def test_words_that_no_merges_give(spark):
    ranks = {bytes([b]): b for b in range(256)} | {b"ab": 256, b"wxyz": 257}  # no pair of tokens makes the last
    coded = bpe.encode(docs_of(spark, ["wxyz", "wxyzab", "abab", None]), ranks, r"\w+")
    assert {r["doc_id"]: r["ids"] for r in coded.collect()} == {0: [257], 1: [*b"wxyz", 256], 2: [256, 256], 3: []}


def test_token_counts(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    found = {r["doc_id"]: r for r in tokcount.count_tokens(docs_of(spark, ODD), path).collect()}
    for i, t in enumerate(ODD):
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        assert (found[i]["n_tokens"], found[i]["n_bytes"], found[i]["over_limit"]) == (n, len((t or "").encode()), n > 512), t
    whole = tokcount.ByteBpe(path).whole_tokens()
    assert all(library.encode(w, add_special_tokens=False).ids == [i] for w, i in list(whole.items())[:500])
    pieces = public_tokenizers.path("piece_bpe_32k.model")
    assert tokcount.count_tokens(docs_of(spark, ["Hello world", None]), pieces).where("n_tokens > 0").count() == 1


def test_token_id_files(spark, tmp_path):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    texts = ODD * 2
    files = dac.write_ids(docs_of(spark, texts).repartition(3), path, f"file://{tmp_path}/ids", file_ids=2000)
    want, start = {}, 0
    for i, t in enumerate(texts):
        ids = library.encode(t or "", add_special_tokens=False).ids + [2]
        want[i] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in dac.read_checks(files).collect()} == want
    assert sum(len(r["ids"]) for r in dac.read_ids(files).collect()) == start
    empty = dac.write_ids(docs_of(spark, []), path, f"file://{tmp_path}/none")
    assert dac.read_checks(empty).count() == 0
    # Documents without an id come first; equal ids stand together.
    odd = spark.createDataFrame([(5, "b c"), (None, "a"), (2, "Hello world"), (5, "b c"), (None, "")], "doc_id bigint, text string")
    read = sorted((r["start"], r["doc_id"], r["n_tokens"]) for r in dac.read_checks(dac.write_ids(odd, path, f"file://{tmp_path}/odd", file_ids=3)).collect())
    assert [r[1] for r in read] == [None, None, 2, 5, 5] and sum(r[2] for r in read) == 2 + 1 + 3 + 3 + 3
    assert [r[0] for r in read] == np.cumsum([0, *(r[2] for r in read[:-1])]).tolist()


def test_unsupported_settings_are_errors(tmp_path):
    import json

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as file:
        said = json.load(file)
    for change in ({"normalizer": {"type": "Lowercase"}}, {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": True}}):
        (tmp_path / "odd.json").write_text(json.dumps(said | change))
        with pytest.raises(ValueError, match=next(iter(change))):
            tokcount.ByteBpe(str(tmp_path / "odd.json"))
    with pytest.raises(ValueError, match="model"):
        tokcount.ByteBpe(public_tokenizers.path("word_bpe_49k.json"))


def test_counts_of_null_ids_repeated_rows_and_empty_tables(spark, ranks):
    path = public_tokenizers.path("byte_bpe_50k.json")
    odd = spark.createDataFrame([(None, "a b"), (3, "c"), (3, "c"), (None, None)], "doc_id bigint, text string")
    assert sorted((r["doc_id"] or 0, r["n_tokens"]) for r in tokcount.count_tokens(odd, path).collect()) == [(0, 0), (0, 2), (3, 1), (3, 1)]
    coded = bpe.decode(bpe.encode(odd, ranks, public_tokenizers.PATTERN), ranks).collect()
    assert sorted((r["doc_id"] or 0, bytes(r["bytes"])) for r in coded) == [(0, b""), (0, b"a b"), (3, b"c"), (3, b"c")]
    assert tokcount.count_tokens(odd.limit(0), path).count() == 0
    scored = lm.score_texts(odd).collect()
    assert len(scored) == 4 and sorted(r["n_tokens"] for r in scored) == [1, 2, 2, 3]


def test_directly_addressable_codes():
    rng = np.random.default_rng(1)
    ids = rng.choice(np.array([0, 5, 255, 256, 70_000, 2**24, 2**32 - 1], np.uint32), 5000)
    file = dac.DacFile(b"".join(dac.pack(np.array([7, 9]), np.array([0, 10, 5000]), ids)))
    assert (file.ids() == ids).all() and (file.document(1) == ids[10:]).all()
    assert all(file.get(i) == ids[i] for i in range(0, 5000, 37))
    with pytest.raises(IndexError):
        file.get(5000)
    assert len(dac.DacFile(b"".join(dac.pack(np.zeros(0, int), np.zeros(1, int), np.zeros(0, np.uint32)))).ids()) == 0


def brute_classes(texts, threshold=0.8):
    shingler = Shingler()
    sets = [set(shingler(t or "").tolist()) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= threshold:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(texts))]


def test_near_duplicates(spark):
    rng = np.random.default_rng(3)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 5))
    base = [[word() for _ in range(120)] for _ in range(4)]
    texts = list(ODD)
    for b in base:
        for edits in (0, 0, 1, 2, 3, 4, 6, 8, 12):
            copy = list(b)
            for k in rng.choice(120, edits, replace=False):
                copy[k] = word()
            texts.append(" ".join(copy))
    texts += ["two words", "Two, words!", " ".join(base[0] * 30)]
    want = brute_classes(texts)
    rows = neardup.near_duplicates(docs_of(spark, texts).unionByName(docs_of(spark, ["x y"]).withColumn("doc_id", F.lit(None).cast("bigint")))).collect()
    assert {r["doc_id"]: r["class_id"] for r in rows if r["doc_id"] is not None} == dict(enumerate(want))
    assert all(r["is_kept"] == (r["doc_id"] == r["class_id"]) for r in rows if r["doc_id"] is not None) and len(rows) == len(texts) + 1
    assert neardup.near_duplicates(docs_of(spark, [])).count() == 0


def test_near_duplicates_of_repeated_rows(spark):
    rng = np.random.default_rng(4)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 5))
    texts = []
    for _ in range(8):
        base = [word() for _ in range(60)]
        texts += [" ".join(base), " ".join([*base[:-1], word()]), " ".join([word(), *base[1:]])]
    table = docs_of(spark, texts)
    for repeated in (table.union(table), table.union(table.where("doc_id % 3 = 0"))):  # {A, A, B, B}, {A, A, B}
        rows = neardup.near_duplicates(repeated).collect()
        assert len(rows) == repeated.count()
        assert {(r["doc_id"], r["class_id"]) for r in rows} == set(enumerate(brute_classes(texts)))


def test_dart_signature_estimates_weighted_similarity():
    rng = np.random.default_rng(5)
    with np.errstate(over="ignore"):
        e = rng.integers(1, 2**63, 60).astype(np.uint64)
        x, y = rng.integers(0, 6, 60).astype(float), rng.integers(0, 6, 60).astype(float)
        a, b = (neardup.dart_signature(e[w > 0], w[w > 0], 4000) for w in (x, y))
    want = np.minimum(x, y).sum() / np.maximum(x, y).sum()
    assert abs((a == b).mean() - want) < 0.04


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(100, 101), (101, 100), (5, 5), (None, 1)], "a bigint, b bigint")
    found = {r["node"]: r["component"] for r in components(edges).collect()}
    assert found == {**{i: 0 for i in range(31)}, 100: 100, 101: 100}


def test_quality(spark):
    good = ["The quick brown fox jumps over the lazy dog. It was a fine day in the park. " * (1 + i % 3) for i in range(60)]
    bad = ["BUY!! NOW!! CHEAP!! PILLS!! WINNER!! " * (1 + i % 3) for i in range(60)]
    texts = good + bad + ["", None]
    labels = spark.createDataFrame([(i, int(i < 60)) for i in range(120)] + [(500, 1), (None, 1), (3, None)], "doc_id bigint, quality int")
    rows = {r["doc_id"]: r for r in quality.score_quality(docs_of(spark, texts), labels).collect()}
    assert len(rows) == 122 and all(0 <= r["score"] <= 1 for r in rows.values())
    assert all(rows[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i in rows)
    assert all(rows[i]["predicted"] == int(i < 60) for i in range(120))
    none = quality.score_quality(docs_of(spark, texts[:3]), labels.limit(0)).collect()
    assert {r["score"] for r in none} == {0.5}


def test_rules_as_columns_score_like_numpy(spark):
    rng = np.random.default_rng(0)
    x = rng.random((400, len(quality.STATS)))
    y = ((x[:, 3] > 0.5) & (x[:, 7] < 0.6)).astype(int)
    model = quality.fit(x, y)
    table = spark.createDataFrame(x.tolist(), quality.STATS)
    got = np.array([r["s"] for r in table.select(model.column().alias("s")).collect()])
    assert np.allclose(got, model.score(x)) and ((got > 0.5) == y).mean() > 0.97


def test_nearest(spark):
    rng = np.random.default_rng(2)
    centre = rng.standard_normal((20, 16))
    v = (centre[rng.integers(0, 20, 900)] + 0.2 * rng.standard_normal((900, 16))).astype(np.float32)
    v[100:110] = v[0]  # ties
    rows = [(i, x.tolist(), "x", "x") for i, x in enumerate(v)] + [(2000, None, "", ""), (2050, [0.0] * 16, "", ""), (2100, [float("nan")] * 16, "", ""), (2101, [None] + [1.0] * 15, "", ""), (2150, [1.0], "", "")]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, id string, cell string")
    found = ann.nearest(table, table.where("vec_id % 50 = 0"), block_rows=300).collect()
    got = {}
    for r in sorted(found, key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert set(got) == set(range(0, 900, 50))
    x = v.astype(np.float64)
    norm = np.sqrt((x * x).sum(1))
    hits = 0
    for q, near in got.items():
        s = (x * x[q]).sum(1) / (norm * norm[q])
        s[q] = -9
        order = np.lexsort((np.arange(900), -s))[:5]
        hits += len({a for a, _ in near} & set(order.tolist()))
        assert all(abs(c - s[a]) < 1e-12 for a, c in near)
    assert hits / (5 * len(got)) >= 0.9
    assert [a for a, _ in got[0]] == [100, 101, 102, 103, 104]
    few = table.where("vec_id in (0, 1, 2)")
    assert [r["vec_id"] for r in ann.nearest(few, few.where("vec_id = 0")).orderBy("rank").collect()] in ([1, 2], [2, 1])
    assert ann.nearest(table.limit(0), table.limit(0)).count() == 0


def test_warc(spark, tmp_path):
    long = "ü" * 600
    pages = [(1, "http://b.com/x", long), (2, "http://a.com/y?q", long), (3, None, "short"), (4, "not a url\n", "short"), (5, "http://a.com/y?q", None), (6, "http://a.com/", "z" * 999), (7, "http://a.com/", "z" * 999), (7, "http://a.com/", long), (7, "http://a.com/", long), (None, "http://c.com", long)]
    table = spark.createDataFrame([(*p[:2], f"2024-01-01T00:00:{i:02d}Z", p[2], "x", "x") for i, p in enumerate(pages)], "page_id bigint, url string, captured_at string, html string, digest string, owner string")
    index = warc.merge_index(warc.write_archives(table.repartition(3), f"file://{tmp_path}/warc", file_bytes=400), range_rows=3)
    rows = index.orderBy("position").collect()
    keys = [(r["url_key"], r["captured_at"]) for r in rows]
    assert keys == sorted(keys) and len(rows) == len(pages)
    got = Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.read_archives(index).collect())
    want = Counter()
    for i, _, html in pages:
        data = (html or "").encode()
        revisit = html == long and i is not None and i != 7
        want[(i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", 7 if revisit else None)] += 1
    assert got == want
    assert warc.read_archives(warc.merge_index(warc.write_archives(table.limit(0), f"file://{tmp_path}/none"))).count() == 0


def test_loser_tree():
    rng = np.random.default_rng(0)
    for k in range(7):
        runs = [sorted(rng.integers(0, 9, rng.integers(0, 6)).tolist()) for _ in range(k)]
        merged = [runs[r][i] for r, i in warc.LoserTree(runs)]
        assert merged == sorted(x for r in runs for x in r)


def test_decontamination(spark, monkeypatch):
    items = ["One two three four five six seven eight nine ten eleven twelve", "short item", "x", "", None, "one two three four five six seven eight nine ten"]
    texts = list(ODD) + ["ONE two, three-four five six seven eight nine ten eleven! twelve and one two three", "a short ITEM x", "one two three four five six seven eight nine", "ten " * 40, "a one two three four five six seven eight nine ten eleven b short item c"]
    words = lambda t: [] if t is None else [w.decode() for w in Shinglerless(t)]
    table = docs_of(spark, texts)
    bench = spark.createDataFrame([(i, t, "z", 1) for i, t in enumerate(items)], "item_id bigint, text string, words string, q int")
    found = {r["doc_id"]: r for r in decontam.contamination(table, bench).collect()}
    assert len(found) == len(texts)
    for i, t in enumerate(texts):
        w = words(t)
        hit, names = set(), set()
        for n, item in enumerate(items):
            iw = words(item)
            for s in range(max(len(iw) - 10, 0) + 1) if iw else ():
                win = iw[s : s + 10]
                for p in range(len(w) - len(win) + 1):
                    if w[p : p + len(win)] == win:
                        hit |= set(range(p, p + len(win)))
                        names.add(str(n))
        want = (len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit))
        r = found[i]
        assert (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) == want, t
    assert decontam.contamination(table, bench.limit(0)).where("contaminated").count() == 0
    assert decontam.contamination(table.limit(0), bench).count() == 0
    # A list too large to send to all tasks: its keys are met without the words.
    monkeypatch.setattr(decontam, "MOST_BROADCAST_ROWS", 0)
    large = decontam.contamination(table.unionByName(table.limit(3)), bench)
    again = [tuple(r) for r in large.collect()]
    assert len(again) == len(texts) + 3 and set(again) == set(map(tuple, found.values()))
    assert decontam.contamination(table, bench.limit(0)).count() == len(texts) and decontam.contamination(table.limit(0), bench).count() == 0


def Shinglerless(text):
    from lurelens.llm.shingles import words

    return words(text)


def test_language_model(spark):
    texts = ODD + ["the cat sat on the mat", "The cat sat", "the dog sat on the cat"] * 15 + ["unseen words here"]
    rows = {r["doc_id"]: r for r in lm.score_texts(docs_of(spark, texts).repartition(3), chunk_bytes=500).collect()}
    lower = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
    tokens = [[*(t or "").encode().translate(lower).split(), None] for t in texts]
    fold = [zlib.crc32(str(i).encode()) % 7 for i in range(len(texts))]
    count = Counter(w for t, f in zip(tokens, fold, strict=True) if f != 2 for w in t)
    n, v = sum(count.values()), len(count)
    assert len(rows) == len(texts)
    for i, t in enumerate(tokens):
        base = sum(math.log10((count[w] + 1) / (n + v + 1)) for w in t)
        r = rows[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (fold[i] == 2, len(t), sum(count[w] > 0 for w in t), n)
        assert r["base_score"] == pytest.approx(base) and r["score"] < 0
    held = [r for r in rows.values() if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
    assert lm.score_texts(docs_of(spark, [])).count() == 0


def test_bigram_probabilities_sum_to_one():
    """Over every word and the unknown one, after a seen context, the mixture is a distribution."""
    tokens = {w: i for i, w in enumerate("abc")}
    follow = np.array([[2, 1, 1], [0, 3, 1], [1, 1, 2]], float)
    uni, v = follow.sum(0), len(tokens)
    weights = np.tile([0.2, 0.3, 0.5], (lm.BUCKETS, 1))
    counts = [np.append(uni, 0.0), np.append(follow[0], 0.0)]
    contexts = [np.full(v + 1, uni.sum()), np.full(v + 1, follow[0].sum())]
    p, bucket = lm._estimates(counts, contexts, v)
    assert lm._mixture(weights, p, contexts, bucket).sum() == pytest.approx(1.0)


def test_expectation_maximisation_finds_the_weights():
    rng = np.random.default_rng(0)
    p = rng.dirichlet(np.ones(50), 3)
    draw = rng.choice(50, 200_000, p=np.array([0.2, 0.5, 0.3]) @ p)
    values, times = np.unique(draw, return_counts=True)
    w = lm.expectation_maximisation(np.zeros(len(values), int), (p[:, values] / p[0, values]).T, times.astype(float), rounds=400)
    assert np.abs(w[0] - [0.2, 0.5, 0.3]).max() < 0.03


def test_url_filters(spark):
    at = "timestamp '2024-01-%02d 00:00:00'"
    entries = spark.sql("SELECT * FROM VALUES " + ", ".join(f"('{p}', {c}, {on}, {at % d})" for p, c, on, d in (("bad.com", "'m'", "true", 5), ("bad.com", "'m'", "false", 10), ("bad.com", "'m'", "true", 20), ("x.bad.com", "'s'", "true", 1), ("ok.org/a", "NULL", "true", 1), ("tie.com", "'t'", "true", 3), ("tie.com", "'t'", "false", 3))) + " AS t(pattern, category, listed, effective)")
    urls = [(1, "http://x.bad.com/p", 4), (2, "http://y.bad.com", 5), (3, "http://bad.com", 10), (4, "http://notbad.com", 6), (5, "http://u@BAD.com:80/?q", 25), (6, "http://ok.org/a/b", 2), (7, "http://ok.org/ab", 2), (8, None, 2), (9, "nonsense", 2), (10, "http://tie.com", 3), (11, "http://bad.com", None), (1, "http://x.bad.com/p", 4)]
    pages = spark.createDataFrame([(i, u, d, "c", "p") for i, u, d in urls], "page_id bigint, url string, day int, category string, pattern string").withColumn("fetched_at", F.expr("timestamp '2023-12-31 00:00:00' + make_dt_interval(day)"))
    found = Counter((r["page_id"], r["n_active"], r["categories"]) for r in urlfilter.evaluate(pages, entries).collect())
    assert found == Counter({(1, 1, "s"): 2, (2, 1, "m"): 1, (3, 0, ""): 1, (4, 0, ""): 1, (5, 1, "m"): 1, (6, 1, ""): 1, (7, 0, ""): 1, (8, 0, ""): 1, (9, 0, ""): 1, (10, 1, "t"): 1, (11, 0, ""): 1})
    assert urlfilter.evaluate(pages, entries.limit(0)).where("blocked").count() == 0 and urlfilter.evaluate(pages.limit(0), entries).count() == 0


def test_url_filters_of_many_parts(spark):
    deep, far = ".".join(["a"] * 40) + ".com", "ok.org/" + "/".join(["p"] * 40)
    entries = spark.createDataFrame([(deep, "host"), (far, "path")], "pattern string, category string").selectExpr("*", "true AS listed", "timestamp '2024-01-01 00:00:00' AS effective")
    urls = [(1, f"http://{deep}/"), (2, f"http://b.{deep}/"), (3, f"http://{deep[2:]}/"), (4, f"http://{far}/x"), (5, f"http://{far[:-2]}"), (6, f"http://{far}")]
    pages = spark.createDataFrame(urls, "page_id bigint, url string").withColumn("fetched_at", F.expr("timestamp '2024-01-02 00:00:00'"))
    found = {r["page_id"]: r["categories"] for r in urlfilter.evaluate(pages, entries).collect()}
    assert found == {1: "host", 2: "host", 3: "", 4: "path", 5: "", 6: "path"}


def test_mixture_against_plain_python(spark):
    """The score of each text by counters, the same EM on exact tokens, and one token at a time."""
    rng = np.random.default_rng(5)
    texts = [" ".join(rng.choice(["the", "Cat", "sat", "on", "a", "mat", f"w{i % 17}"], int(rng.integers(0, 40)))) for i in range(150)] + [None, "", "new words only"]
    found = {r["doc_id"]: r for r in lm.score_texts(docs_of(spark, texts)).collect()}
    tokens = [["<s>"] + [w.translate({c: c + 32 for c in range(65, 91)}) for w in (t or "").split()] + ["</s>"] for t in texts]
    fold = [zlib.crc32(str(i).encode()) % 7 for i in range(len(texts))]

    def counted(rows):
        one, two = Counter(), Counter()
        for t in rows:
            one.update(t[1:])
            two.update(zip(t[:-1], t[1:], strict=True))
        return one, two, len(rows)

    def parts(t, i, one, two, documents):
        h = documents if i == 1 else one[t[i - 1]]
        return [1 / (len(one) + 1), one[t[i]] / sum(one.values()), two[t[i - 1], t[i]] / h if h else 0.0], h

    left = counted([t for t, f in zip(tokens, fold, strict=True) if f not in (lm.TEST_FOLD, lm.DELETED_FOLD)])
    seen = Counter()
    for t, f in zip(tokens, fold, strict=True):
        if f == lm.DELETED_FOLD:
            for i in range(1, len(t)):
                p, h = parts(t, i, *left)
                seen[min(int(math.log2(h + 1)), lm.BUCKETS - 1), *(round(math.log2(x / p[0]) * lm.BIN) if x else -999 for x in p[1:])] += 1
    kinds = np.array(list(seen), float)
    ratios = np.column_stack((np.ones(len(kinds)), np.where(kinds[:, 1:] <= -999, 0.0, 2.0 ** (kinds[:, 1:] / lm.BIN))))
    weights = lm.expectation_maximisation(kinds[:, 0].astype(int), ratios, np.array(list(seen.values()), float))
    every = counted([t for t, f in zip(tokens, fold, strict=True) if f != lm.TEST_FOLD])
    for n, t in enumerate(tokens):
        total = 0.0
        for i in range(1, len(t)):
            p, h = parts(t, i, *every)
            w = weights[min(int(math.log2(h + 1)), lm.BUCKETS - 1)]
            known = [0, 1, 2] if h else [0, 1]
            total += math.log10(sum(w[k] * p[k] for k in known) / sum(w[k] for k in known))
        assert math.isclose(found[n]["score"], total, rel_tol=1e-6), n


def test_near_duplicates_in_blocks(spark):
    """A group of many blocks has the classes of one block, and those of all pairs within the group."""
    rng = np.random.default_rng(9)
    base = [f"w{i}" for i in range(120)]
    texts = []
    for i in range(160):
        own = list(base)
        for at in rng.choice(120, int(rng.integers(0, 9)), replace=False):
            own[at] = f"x{int(rng.integers(0, 30))}"
        texts.append(" ".join(own))
    signed = neardup.signatures(docs_of(spark, texts)).cache()
    shingler = Shingler(5)
    sets = [set(shingler(t).tolist()) for t in texts]
    classes = {}
    for rows in (8192, 10):
        members, edges = neardup.links(signed, docs_of(spark, texts), block_rows=rows)
        for r in edges.collect():
            assert math.isclose(r["similarity"], len(sets[r["a"]] & sets[r["b"]]) / len(sets[r["a"]] | sets[r["b"]])) and r["similarity"] >= 0.8
        joined = {r["node"]: r["component"] for r in components(edges).collect()}
        classes[rows] = {r["doc_id"]: joined.get(r["node"], r["node"]) for r in members.collect()}
    linked = neardup.Linked()
    for i in range(160):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                linked.join(i, j)
    # All of these texts share buckets with text 0 or with one another often enough that no link is missed.
    assert classes[8192] == {i: linked.root(i) for i in range(160)} == classes[10]


def test_long_words_are_merged_like_others(ranks):
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for word in ("a", "Anblewh" * 300, "x" * 1500, "zażółć" * 200, "éü" * 77):
        assert bpe.merge_word(word.encode(), ranks) == encoding.encode_ordinary(word)


def test_words_are_numbered_in_one_look_up_each():
    from lurelens.llm.pretokens import make_split, wide_splitter

    import public_tokenizers

    known = bpe.Numbers()
    words = ["a", " b", "a", "ü", " b", "文"]
    assert list(map(known.__getitem__, words)) == [0, 1, 0, 2, 1, 3] and known.fresh == ["a", " b", "ü", "文"]
    known.fresh.clear()
    assert known["a"] == 0 and known["c"] == 4 and known.fresh == ["c"]
    split = make_split(public_tokenizers.PATTERN)
    for text in ("", "plain a1", "na\xefve \xff\xa0 x", "Ā", "x ’s \U0001f600 \x85", "\x1c\x1d 1\xb2"):
        assert "".join(split(text)) == text and split(text) == wide_splitter(public_tokenizers.PATTERN)(text)
