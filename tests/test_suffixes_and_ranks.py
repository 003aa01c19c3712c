"""Public suffix rules, the exact brand search, exact positions and quantiles, and training as a whole."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lurelens.config import Settings
from lurelens.operators import evidence as E
from lurelens.operators import hosts as H
from lurelens.operators import match as X
from lurelens.operators import metrics as M
from lurelens.operators import ranking as K
from lurelens.plans import learn
from lurelens.sources import readers as S

LIST = """// a comment
com
co.uk // with a remark
uk

*.ck
!www.ck
kawasaki.jp
*.kawasaki.jp
!city.kawasaki.jp
jp
COM.SG
sg
香港
// ===BEGIN PRIVATE DOMAINS===
blogspot.com
"""


@pytest.fixture(scope="module")
def rules(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("rules") / "list.dat"
    path.write_text(LIST)
    return S.read_suffix_rules(spark, str(path))


#: host, subdomain, label, suffix, registered domain
PARTS = [
    ("login.bank.co.uk", "login", "bank", "co.uk", "bank.co.uk"),
    ("bank.uk", "", "bank", "uk", "bank.uk"),
    ("a.b.shop.ck", "a", "b", "shop.ck", "b.shop.ck"),
    ("shop.ck", "", "", "shop.ck", "shop.ck"),
    ("ck", "", "ck", "", "ck"),
    ("www.ck", "", "www", "ck", "www.ck"),
    ("x.www.ck", "x", "www", "ck", "www.ck"),
    ("a.b.city.kawasaki.jp", "a.b", "city", "kawasaki.jp", "city.kawasaki.jp"),
    ("a.b.other.kawasaki.jp", "a", "b", "other.kawasaki.jp", "b.other.kawasaki.jp"),
    ("x.y.com.sg", "x", "y", "com.sg", "y.com.sg"),
    ("me.blogspot.com", "me", "blogspot", "com", "blogspot.com"),
    ("co.uk", "", "", "co.uk", "co.uk"),
    ("a.b.local", "a.b", "local", "", "a.b.local"),
    ("10.0.0.1", "", "10.0.0.1", "", "10.0.0.1"),
    ("www.a.xn--j6w193g", "www", "a", "xn--j6w193g", "a.xn--j6w193g"),
]


def test_host_parts(spark, rules):
    hosts = spark.createDataFrame([(h,) for h, *_ in PARTS] * 2 + [("",), (None,)], "host string")
    found = {r["host"]: tuple(r)[1:] for r in H.host_parts(hosts, rules).collect()}
    assert found == {h: tuple(rest) for h, *rest in PARTS}
    assert H.host_parts(hosts.limit(0), rules).count() == 0
    private = S.suffix_rules(spark.createDataFrame([(LIST,)], "value string"), private=True)
    assert H.host_parts(hosts, private).where("host = 'me.blogspot.com'").first()["registered_domain"] == "me.blogspot.com"


def test_list_of_the_class_path(spark):
    rules = S.read_suffix_rules(spark)
    hosts = spark.createDataFrame([(h,) for h in ("login.bank.nl", "a.b.co.nz", "x.y.com.sg", "www.axis.bank.in", "a.www.ck")], "host string")
    found = {r["host"]: r["registered_domain"] for r in H.host_parts(hosts, rules).collect()}
    assert found == {"login.bank.nl": "bank.nl", "a.b.co.nz": "b.co.nz", "x.y.com.sg": "y.com.sg", "www.axis.bank.in": "axis.bank.in", "a.www.ck": "www.ck"}


def test_registered_domains_of_arrays(spark, rules):
    rows = spark.createDataFrame([(1, ["http://a.b.co.uk/x", "http://c.shop.ck"]), (2, []), (3, None), (4, ["http://a.b.co.uk/x", "http://c.shop.ck"])], "k int, urls array<string>")
    found = {r["k"]: r["d"] for r in H.registered_domains(rows, "urls", "d", rules).collect()}
    assert found == {1: ["b.co.uk", "c.shop.ck"], 2: [], 3: None, 4: ["b.co.uk", "c.shop.ck"]}


def test_features_with_rules(spark, rules):
    """The whole lexical and page features go by the rules: with a short list the wildcard's label would be the brand's."""
    s = Settings(suffixes=rules)
    rows = spark.createDataFrame([("http://paypa1.shop.ck/x", "paypa1.shop.ck", "", ""), ("http://pay.example.co.uk", "pay.example.co.uk", "paypal.co.uk", "Paypal")], "url string, detected_domain string, target_domain string, cse_name string")
    brands = spark.createDataFrame([("paypal.shop.ck", "Paypal"), ("other.com", "Other")], "domain string, name string")
    found = {r["host"]: r for r in X.lexical_features(rows, brands, s).collect()}
    first = found["paypa1.shop.ck"]
    assert (first["matched_brand_domain"], first["registered_domain"], first["subdomain_depth"]) == ("paypal.shop.ck", "paypa1.shop.ck", 0)
    assert found["pay.example.co.uk"]["subdomain_depth"] == 1
    paged = rows.withColumns({"html": F.lit("<form action='http://x.shop.ck/in'></form><form action='http://paypa1.shop.ck'></form>"), "fetch_success": F.lit(1), "final_url": F.lit(""), "host": F.col("detected_domain"), "matched_brand_domain": F.lit("paypal.shop.ck")})
    assert {r["host"]: r["form_action_external"] for r in E.page_evidence(paged, s).collect()} == {"paypa1.shop.ck": 1, "pay.example.co.uk": 1}


# The brand search.


def every_brand(host, brands, own, extra):
    """The loop over all brands."""
    found, top = None, 0.0
    for b in ([own] if own else []) + brands:
        t = 0.85 if any(x in host.alnum or x in host.plain for x in [*b.tokens, *extra]) else 0.0
        score = max(t, X.indel_ratio(host.registered, b.registered), X.indel_ratio(host.stem, b.stem))
        if score > top:
            found, top = b, score
    return (found.domain, top) if found else ("", 0.0)


def made_up(rng, n):
    part = lambda: "".join(rng.choice("abcdeiost013") for _ in range(rng.randint(2, 9)))
    out = []
    for _ in range(n):
        stem = part() + rng.choice(["", "", "bank", "pay"])
        out.append((f"{stem}.{rng.choice(['com', 'co.in', 'net'])}", stem))
    return out


def test_search_is_the_whole_loop():
    rng = random.Random(7)
    brands = [X.Brand(d, d, s, [s] if len(s) > 3 and rng.random() < 0.3 else []) for d, s in sorted(set(made_up(rng, 20_000)))]
    index = X.BrandIndex(brands)
    compared = 0
    for d, s in made_up(rng, 60):
        host = X.Host(d, s, d.replace(".", ""))
        own = brands[rng.randrange(len(brands))] if rng.random() < 0.3 else None
        extra = ["zzz"] if rng.random() < 0.8 else [s[:3]]
        best = host.best(index, own, extra)
        assert best[:2] == every_brand(host, brands, own, extra)
        compared += best[4]
    assert compared < 0.2 * 60 * len(brands)  # most brands are never compared
    assert X.Host("", "", "").best(index, None, [])[0] == ""


def test_blocks_of_brands_say_the_same(spark):
    rng = random.Random(8)
    brands = spark.createDataFrame([(d, s) for d, s in sorted(set(made_up(rng, 300)))], "domain string, name string")
    rows = spark.createDataFrame([(f"http://{d}/{s}", d, rng.choice(["", "", "abc.com"]), rng.choice(["", "Bank of abc", None])) for d, s in made_up(rng, 80)], "url string, detected_domain string, target_domain string, cse_name string")
    once, blocks = (X.match_brands(rows, brands, Settings(broadcast_rows=n)) for n in (20_000, 40))
    columns = sorted(once.columns)
    assert sorted(map(str, once.select(columns).collect())) == sorted(map(str, blocks.select(columns).collect()))


# Positions and quantiles.


def test_positions(spark):
    rows = spark.range(5000).select("id", F.when(F.col("id") % 7 == 0, None).otherwise(F.col("id") % 3).alias("g"), F.md5(F.col("id").cast("string")).alias("h")).repartition(7)
    found = K.positions(rows, [F.col("h")], ["g"]).toPandas()
    want = found.sort_values("h").groupby("g", dropna=False).cumcount().sort_index()
    assert len(found) == 5000 and (found["position"] == want).all()
    whole = K.positions(rows, [F.col("h").desc()]).toPandas().sort_values("position")
    assert whole["position"].tolist() == list(range(5000)) and whole["h"].is_monotonic_decreasing
    assert K.positions(rows.limit(0), [F.col("h")]).count() == 0


@pytest.mark.parametrize("kind", ["normal", "ties", "tiny", "huge", "one"])
def test_quantiles(spark, kind):
    rng = np.random.default_rng(6)
    x = {"normal": rng.standard_normal(3001), "ties": rng.integers(0, 4, 2000) / 3, "tiny": 5e-324 * rng.integers(0, 9, 500), "huge": np.concatenate((rng.standard_normal(500), [1e308, -1e308])), "one": np.array([2.5])}[kind]
    rows = spark.createDataFrame([(float(v),) for v in x] + [(None,), (float("nan"),), (float("inf"),)], "x double").repartition(3)
    for share in (0.0, 0.3, 0.5, 0.95, 1.0):
        assert K.quantile(rows, "x", share) == pytest.approx(float(np.quantile(x, share)), rel=1e-12, abs=0)
    place = len(x) // 3
    found, ordered = K.nth_value(rows, "x", place), np.sort(x)
    assert (found.value, found.below, found.equal) == (ordered[place], (x < ordered[place]).sum(), (x == ordered[place]).sum())
    assert K.nth_value(rows, "x", len(x)) is None and K.quantile(rows.limit(0), "x", 0.5) is None


def test_lowest_with_ties(spark):
    rows = spark.createDataFrame([(i, (i * 7 % 5) / 4) for i in range(200)], "k int, x double").repartition(3)
    want = sorted((x, k) for k, x in ((r["k"], r["x"]) for r in rows.collect()))
    for n in (0, 1, 55, 199, 200, 500):
        assert sorted((r["x"], r["k"]) for r in K.lowest(rows, "x", "k", n).collect()) == want[:n]
    marked = M.reliable_negatives(rows, "x", "k", 0.3, -1.0, 55)
    assert {r["k"] for r in marked.where("is_reliable").collect()} == {k for _, k in want[:55]} and marked.first()["cutoff"] == want[54][0]


# Training.


def test_training_query_runs_the_whole_procedure(spark, tmp_path):
    from lurelens import queries

    rng = random.Random(3)
    texts = ["".join(rng.choice("abc. ") for _ in range(rng.randint(40, 90))) for _ in range(150)] + ["".join(rng.choice("AB#$!") for _ in range(rng.randint(40, 90))) for _ in range(60)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i < 150)) for i in range(210)], "doc_id bigint, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    rows = queries.QUERIES["pu_train_score"](spark, str(tmp_path)).collect()
    assert len(rows) == 210
    good = [r["pu_prediction"] == int(r["doc_id"] >= 150) for r in rows]
    assert sum(good) > 200
    # Positives for validation are set aside before negatives are mined: a quarter of 45.
    roles = [r["pu_training_role"] for r in rows]
    assert roles.count("positive_validation") == 11 and roles.count("positive") == 34
    assert roles.count("reliable_negative_validation") == round(0.25 * (roles.count("reliable_negative") + roles.count("reliable_negative_validation")))


def test_bins_tell_rare_values_apart(spark):
    rows = spark.range(20_000).select((F.col("id") % 5000 == 0).cast("double").alias("f0"), F.log1p("id").alias("f1"), (F.col("id") % 3 - 1).cast("double").alias("f2"))
    found = dict(zip(["f0", "f1", "f2"], learn.binning(rows, ["f0", "f1", "f2"]).getSplitsArray(), strict=True))
    assert found["f0"][1:-1] == [1.0] and found["f2"][1:-1] == [0.0, 1.0] and 60 < len(found["f1"]) < 80
    assert len(learn.GRID) == 5 and np.prod([len(v) for v in learn.GRID.values()]) == 72


def test_trees_against_brute_force():
    from lurelens.plans.forest import Growth, grow, walk

    rng = np.random.default_rng(5)
    x, n = rng.integers(0, 9, (400, 5)).astype(np.uint8), rng.integers(0, 4, (2, 400))
    for how in (Growth(1, leaf=3), Growth(1, depth=4, split=5, weights="balanced_subsample"), Growth(1)):
        together = grow(x, n, how, 7, list(range(6)))
        for k, tree in enumerate(together):
            assert all(np.array_equal(tree[f], v) for f, v in grow(x, n, how, 7, [k])[0].items())  # whichever task grows it
            sample = np.random.default_rng([7, k]).poisson(n)
            w = (sample if how.weights == "balanced_subsample" else n).sum(1)
            w = w.sum() / (2 * w)
            purity = lambda c, w=w: ((w * c) ** 2).sum() / max((w * c).sum(), 1e-300)
            cells, depth = {0: np.arange(400)}, {0: 0}
            for i, (f, cut, child) in enumerate(zip(tree["feature"], tree["cut"], tree["child"], strict=True)):
                mine = cells[i]
                c = sample[:, mine].sum(1)
                assert tree["value"][i] == pytest.approx((w * c)[1] / (w * c).sum(), abs=1e-6) and c.sum() >= how.leaf
                scores = {}
                for g in range(5):
                    for b in range(8):
                        sides = [sample[:, mine[(x[mine, g] <= b) == s]].sum(1) for s in (True, False)]
                        if min(s.sum() for s in sides) >= how.leaf:
                            scores[g, b] = sum(map(purity, sides))
                if f < 0:  # pure, too small, too deep, or without a cut
                    assert c.min() == 0 or c.sum() < max(how.split, 2 * how.leaf) or depth[i] == how.depth or not scores
                    continue
                assert depth[i] < (how.depth or 99) and c.sum() >= how.split
                assert scores[f, cut] == pytest.approx(max(v for (g, _), v in scores.items() if g == f))
                for s in (0, 1):
                    cells[child + s], depth[child + s] = mine[(x[mine, f] > cut) == s], depth[i] + 1
            leaf_of = {int(m): i for i, v in cells.items() if tree["feature"][i] < 0 for m in v}
            assert np.array_equal(walk(x, *(tree[f] for f in ("feature", "cut", "child", "value"))), tree["value"][[leaf_of[m] for m in range(400)]])


def test_a_fit_takes_few_jobs_at_any_depth(spark):
    """And its trees stay in shared storage, as rows."""
    from lurelens.config import Settings

    rows = spark.range(6000).select("id", F.col("id").cast("double").alias("f0"), (F.xxhash64("id") % 5).cast("double").alias("f1"), F.abs(F.hash("id") % 2).alias("y"))
    bins = learn.binning(rows, ["f0", "f1"])
    packed = bins.transform(rows).select("id", "y", learn.forest.bin_vector(bins).alias("x")).cache()
    packed.count()
    forests = learn.Forests(bins, Settings(trees=40))
    spark.sparkContext.setJobGroup("one-fit", "one fit")
    model = forests.fit(packed, 3)
    spark.sparkContext.setJobGroup("after", "after")
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("one-fit")) <= 6
    trees = model.trees(spark).collect()
    assert sorted(t["tree"] for t in trees) == list(range(40)) and max(len(t["cut"]) for t in trees) > 50
    from lurelens.plans.forest import walk

    scored = forests.predict(model, packed).collect()
    x = np.array([r["x"] for r in scored], np.uint8)
    want = np.mean([walk(x, *(np.frombuffer(t[c], k) for c, k in (("feature", "<i2"), ("cut", "u1"), ("child", "<i4"), ("value", "<f4")))) for t in sorted(trees)], axis=0)
    assert len(scored) == 6000 and np.allclose([r["score"] for r in scored], want)
    again = forests.predict(forests.fit(packed.repartition(7), 3), packed)
    assert {r["id"]: r["score"] for r in again.collect()} == pytest.approx({r["id"]: r["score"] for r in scored})
    packed.unpersist()
