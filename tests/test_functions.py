import pytest
from pyspark.sql import functions as F

from lurelens.config import SUFFIXES
from lurelens.functions import dates as D
from lurelens.functions import hashing as H
from lurelens.functions import html as P
from lurelens.functions import registry as R
from lurelens.functions import similarity as S
from lurelens.functions import text as T


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'string' if v is None or isinstance(v, str) else 'int'}" for k, v in values.items()) or "x int"
    return spark.createDataFrame([tuple(values.values()) or (1,)], schema).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    "url, host",
    [
        ("http://WWW.Foo.com:80/a?b", "foo.com"),
        ("user:p@x.co.in/q", "x.co.in"),
        ("www.www.x.com.", "www.x.com"),
        ("None", ""),
        (None, ""),
        ("http://[::1]:8/", "::1"),
        ("", ""),
        ("  A.b ", "a.b"),
    ],
)
def test_hostname(spark, url, host):
    assert one(spark, T.hostname("u"), u=url) == host


@pytest.mark.parametrize(
    "host, registered, stem, depth",
    [
        ("a.b.x.co.in", "x.co.in", "x", 2),
        ("x.bank.in", "x.bank.in", "x", 0),
        ("co.in", "co.in", "", 0),
        ("foo.unknowntld", "foo.unknowntld", "unknowntld", 1),
        ("1.2.3.4", "1.2.3.4", "1234", 0),
        ("", "", "", 0),
    ],
)
def test_registered_domain(spark, host, registered, stem, depth):
    h = F.col("h")
    found = one(spark, F.struct(T.registered_domain(h), T.domain_stem(h), T.subdomain_depth(h)), h=host)
    assert tuple(found) == (registered, stem, depth)


def test_scheme_is_case_sensitive(spark):
    assert one(spark, T.ensure_url("u"), u="HTTP://x") == "http://HTTP://x"
    assert one(spark, T.ensure_url("u"), u="https://x") == "https://x"


def test_entropy_and_shape(spark):
    assert one(spark, T.entropy(F.col("u")), u="http://bsnlportal.com") == pytest.approx(3.784942, abs=1e-6)
    shape = one(spark, F.struct(*(v.alias(k) for k, v in T.url_shape(F.col("u"), F.lit("microsoft.com")).items())), u="http://microsoft.com/a//b?x=1")
    assert shape["tiny_url"] == 1 and shape["redirection"] == 1 and shape["special_char_count"] == 2 and shape["url_depth"] == 3
    assert one(spark, T.entropy(F.col("u")), u="") == 0.0


def test_homoglyphs_and_tokens(spark):
    assert one(spark, T.homoglyphs(F.col("u")), u="P@yPа1") == "paypal"
    assert sorted(one(spark, T.brand_tokens(F.col("h"), F.lit("Axis Bank Limited"), SUFFIXES), h="netbanking.hdfcbank.com")) == ["axis", "hdfcbank", "netbanking"]


def test_indel_ratio(spark):
    assert round(S.indel_ratio("icicilombards.com", "icicilombard.com"), 6) == 0.969697
    assert S.indel_ratio("", "x") == 0.0
    for a, b in (("kitten", "sitting"), ("ab", "ba"), ("abc", "abc"), ("x", "")):
        native = one(spark, S.similarity_native(F.col("a"), F.col("b")), a=a, b=b)
        assert native == pytest.approx(S.indel_ratio(a, b))
        assert one(spark, S.similarity(F.col("a"), F.col("b")), a=a, b=b) == pytest.approx(native)


def test_window_distance(spark):
    d = lambda a, b: one(spark, S.min_window_distance(F.col("a"), F.col("b")), a=a, b=b)
    assert d("xxpaypalxx", "paypal") == 0 and d("xxpaypelxx", "paypal") == 1 and d("pay", "paypal") == 3 and d("", "x") == -1


def test_labels_and_truth(spark):
    assert one(spark, T.source_label("x"), x="Suspected site") == "suspected"
    assert one(spark, T.training_label("x"), x="Unlabeled") == "unlabeled"
    truth = lambda x: one(spark, T.truth(F.col("x")), x=x)
    assert [truth(x) for x in ("not phishing", "legit", "review", "other", None, "1", "n")] == [1, 0, None, None, None, 1, 0]


def test_reputation(spark):
    r = lambda x, k: one(spark, T.reputation(F.col("x"), k), x=x)
    assert (r("NameCheap, Inc.", "registrar"), r("ns.cloudflare.com", "nameserver"), r("Amazon Technologies Inc.", "asn"), r("", "asn"), r("Foo", "asn")) == (4, 8, 8, -1, 6)


def test_ips(spark):
    assert one(spark, T.ip_set(F.col("x")), x="a 10.0.0.1, 999.1.1.1 and 9.9.9.9") == ["10.0.0.1", "9.9.9.9"]
    assert one(spark, T.first_ip(F.col("x")), x=" ;1.1.1.1;2.2.2.2") == "1.1.1.1"


def test_hashes(spark):
    assert H.simhash("") == "" and len(H.simhash("one two three")) == 16
    assert H.simhash("a") == f"{H.blake_token('a'):016x}"
    h = lambda a, b: one(spark, H.hamming(F.col("a"), F.col("b")), a=a, b=b)
    assert (h("ff", "fe"), h("zz", "zz"), h("zz", "yy"), h("", "1"), h("ffffffffffffffff", "0")) == (1, 0, None, None, 64)
    assert one(spark, H.hash_similarity(F.col("a"), F.col("b")), a="f0", b="f1") == 1 - 1 / 64
    assert H.image_hash(None) == "" and H.bits_to_hex([1] * 64) == "f" * 16


def test_page_parts(spark):
    html = """<html><head><title>Axis Login</title><meta content="Axis bank"><link rel="shortcut icon" href="/i.ico"><script>var a</script></head>
    <body><form action="http://evil.example/x"><input type="PassWord"></form><img src="l.png" class="site logo"><noscript>no</noscript>Hi<!-- c --></body></html>"""
    p = one(spark, P.page_parts("h"), h=html)
    assert p["title"] == "axis login" and p["meta"] == "axis bank" and p["has_password"] and p["forms"] == ["http://evil.example/x"]
    assert p["icon"] == "/i.ico" and "no" in p["text"] and "var a" not in p["text"] and "no" not in p["dom_text"].split() and "['site', 'logo']" in p["images"][0]["attrs"]
    assert one(spark, P.favicon_url(F.lit("http://a.b/c"), F.lit(None).cast("string")), h="") == "http://a.b/favicon.ico"
    assert one(spark, P.dom_hash("h"), h=None) == ""


def test_page_parts_hold_few_pages_at_once(spark):
    import pandas as pd

    htmls = [None, "", *(f"<title>{i}</title>" + "<a href='x'>y z</a>" * (i * 400) for i in range(30)), "<p>" + "w " * 900_000, "<title>end</title>"]
    whole = pd.concat([next(P.page_parts.__wrapped__(iter([pd.Series([h], dtype="object")]))) for h in htmls], ignore_index=True)
    pieces = list(P.page_parts.__wrapped__(iter([pd.Series(htmls, dtype="object")])))
    at = 0
    for piece in pieces:
        assert len(piece) == 1 or sum(len(h or "") for h in htmls[at : at + len(piece)]) <= P.PARSED_CHARS
        at += len(piece)
    assert len(pieces) > 3 and at == len(htmls)
    pd.testing.assert_frame_equal(pd.concat(pieces, ignore_index=True), whole)
    found = spark.createDataFrame(list(enumerate(htmls)), "i int, h string").coalesce(1).select("i", "h", P.page_parts("h").alias("p")).collect()
    assert [(r["i"], r["h"], r["p"]["title"]) for r in found] == [(i, h, t) for i, (h, t) in enumerate(zip(htmls, whole["title"], strict=True))]
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").lower().removesuffix("b")) <= 4 << 20


def test_dates(spark):
    today = F.to_date(F.lit("2020-01-02"))
    d = lambda x: str(one(spark, D.observation_date(F.col("x"), today), x=x))
    assert [d(x) for x in ("2026-03-22", "22-03-2026", "22/03/2026 10:00", "2026/03/22", "", "soon")] == ["2026-03-22"] * 4 + ["2020-01-02"] * 2
    at = lambda x: F.to_date(F.lit(x))
    assert one(spark, D.age_days(at("2026-03-01"), at("2026-03-22"))) == 21 and one(spark, D.expiry_days(at("2027-03-01"), at("2026-03-22"))) == 344
    assert one(spark, D.age_days(F.lit(None).cast("date"), today)) == -1
    assert one(spark, D.registry_time(F.col("x")), x="nonsense") is None


def test_registry_answers(spark):
    answer = """{"events":[{"eventAction":"registration","eventDate":"2026-03-01T00:00:00Z"},{"eventAction":"expiration","eventDate":"2027-03-01"}],
    "entities":[{"roles":["registrar"],"vcardArray":["vcard",[["version",{},"text","4.0"],["fn",{},"text","NameCheap, Inc."]]]},{"roles":["registrant"],"handle":"H1"}],
    "nameservers":[{"ldhName":"NS2.X.COM."},{"ldhName":"ns1.x.com"}]}"""
    a = R.answer(F.col("j"))
    v = one(spark, F.struct(R.created(a).alias("c"), R.expires(a).alias("e"), R.registrar(a).alias("r"), R.registrant(a).alias("o"), R.nameservers(a).alias("n")), j=answer)
    assert str(v["c"]) == "2026-03-01 00:00:00" and str(v["e"]) == "2027-03-01 00:00:00"
    assert (v["r"], v["o"], v["n"]) == ("NameCheap, Inc.", "H1", ["ns1.x.com", "ns2.x.com"])
    assert one(spark, R.registrar(R.answer(F.col("j"))), j="broken") == ""


def test_simhash_of_whole_table(spark, tmp_path):
    import hashlib
    import re

    from lurelens.queries import QUERIES

    texts = ["one two three", "Two words", "", None, "!!", "a b c d " * 600, " ".join(f"w{i % 700}" for i in range(3000)), "x" * 2000]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")

    def brute(text):
        words = re.findall("[a-z0-9]+", (text or "").lower())
        parts = [(w, 1) for w in words] + [(" ".join(words[i : i + 3]), 2) for i in range(len(words) - 2)]
        hashed = [(int(hashlib.md5(p.encode()).hexdigest()[:16], 16), n) for p, n in parts]
        return "".join("1" if sum(n if h >> i & 1 else -n for h, n in hashed) >= 0 else "0" for i in range(63, -1, -1)) if words else ""

    found = QUERIES["simhash_md5"](spark, str(tmp_path)).collect()
    assert {r["doc_id"]: r["bits"] for r in found} == {i: brute(t) for i, t in enumerate(texts)} and len(found) == len(texts)
