import pytest
from pyspark.sql import functions as F

from lurelens.config import COMPACT_COLUMNS, Settings
from lurelens.operators import contexts as C
from lurelens.operators import counts as N
from lurelens.operators import evidence as E
from lurelens.operators import metrics as M
from lurelens.operators import rules as R
from lurelens.operators.match import Brand, BrandIndex, Host, edit_distance, match_brands, split_by_match
from lurelens.plans import learn
from lurelens.plans.collect import collect
from lurelens.plans.enrich import enrich
from lurelens.sources import readers as S
from lurelens.sources import writers as W

SET = Settings(observation_date="2026-03-22")
COLUMNS = "url string, detected_domain string, target_domain string, cse_name string, source_label string, remarks string, source_file string, source_row int, ord bigint"


def rows_of(spark, *rows):
    full = [(u, u.split("//")[-1].split("/")[0], t, n, lab, "", "f.csv", i, i) for i, (u, t, n, lab) in enumerate(rows)]
    return spark.createDataFrame(full, COLUMNS)


def brands_of(spark, *brands):
    return spark.createDataFrame(list(brands), "domain string, name string")


def test_best_brand_rules():
    host = Host("bsnlportal.com", "bsnlportal", "bsnlportalcom")
    brand = Brand("bsnl.co.in", "bsnl.co.in", "bsnl", ["bsnl"])
    assert host.best(BrandIndex([brand]), None, [])[:3] == ("bsnl.co.in", 0.85, 0)
    assert host.best(BrandIndex([]), None, []) == ("", 0.0, -1, 0.0, 0)
    # The first of equal brands wins; a token of the row's own name counts for every brand.
    first, second = Brand("a.com", "a.com", "a", []), Brand("b.com", "b.com", "b", [])
    assert host.best(BrandIndex([first, second]), None, ["portal"])[0] == "a.com"
    assert host.best(BrandIndex([first]), second, ["portal"])[0] == "b.com"
    assert edit_distance("kitten", "sitting") == 3


def test_match_and_split(spark):
    brands = brands_of(spark, ("icicilombard.com", "ICICI Lombard"), ("hdfc.bank.in", "HDFC Bank"), ("netbanking.hdfcbank.com", "HDFC Bank"))
    rows = rows_of(spark, ("http://icicilombards.com", "", "", "Phishing"), ("http://hdfcbanksale.com", "", "", ""), ("http://zzqqy.org", "", "", ""))
    found = {r["url"]: r for r in match_brands(rows, brands, SET).collect()}
    assert found["http://icicilombards.com"]["match_domain"] == "icicilombard.com" and round(found["http://icicilombards.com"]["match_score"], 6) == 0.969697
    assert found["http://hdfcbanksale.com"]["match_domain"] == "hdfc.bank.in" and found["http://hdfcbanksale.com"]["match_score"] == 0.86
    kept, unmatched = split_by_match(match_brands(rows, brands, SET), SET)
    assert kept.count() == 3 and [r["validation_reason"][:16] for r in unmatched.collect()] == ["CSE match score "]
    strict = Settings(require_match=True)
    assert split_by_match(match_brands(rows, brands, strict), strict)[0].count() == 2


def test_match_without_brands_and_in_blocks(spark):
    rows = rows_of(spark, ("http://x.com", "", "", ""))
    assert match_brands(rows, brands_of(spark).limit(0), SET).first()["match_domain"] is None
    many = brands_of(spark, *[(f"b{i}.com", "") for i in range(5)], ("xx.com", ""))
    one, blocks = (match_brands(rows, many, Settings(broadcast_rows=n)).first().asDict() for n in (100, 2))
    assert one["match_domain"] == blocks["match_domain"] and one["match_score"] == blocks["match_score"]


def test_merge_keeps_first_url_and_best_label(spark):
    rows = rows_of(spark, ("http://a.com/1", "t.com", "", "Suspected"), ("http://a.com/2", "t.com", "Name", "Phishing"), ("http://b.com", "", "", ""))
    found = {r["detected_domain"]: r for r in C.merge_contexts(rows).collect()}
    assert found["a.com"]["url"] == "http://a.com/1" and found["a.com"]["source_label"] == "Phishing" and found["a.com"]["cse_name"] == "Name" and len(found) == 2


def test_official_hosts(spark):
    rows = rows_of(spark, ("http://sbi.co.in", "", "", ""), ("http://x.sbi.co.in", "", "", ""), ("http://t.com", "t.com", "", ""))
    kept, removed = C.official_split(rows, brands_of(spark, ("sbi.co.in", "")))
    assert [r["url"] for r in kept.collect()] == ["http://x.sbi.co.in"] and removed.count() == 2
    below = C.official_or_below(rows.withColumn("host", F.col("detected_domain")), brands_of(spark, ("sbi.co.in", "")))
    assert below.count() == 2


def test_dns_gate(spark):
    rows = rows_of(spark, ("http://a.com", "", "", ""), ("http://b.com", "", "", ""), ("http://c.com", "", "", ""))
    dns = spark.createDataFrame([("a.com", 1, 1, "1.1.1.1", 0, 0, "", "success"), ("b.com", 0, 0, "", 0, 0, "A:NXDOMAIN", "error")], E.DNS)
    active, failed = C.dns_split(rows, dns)
    assert active.count() == 1 and sorted(r["dns_error"] for r in failed.collect()) == ["", "A:NXDOMAIN"]
    assert C.dns_counts(active, failed).first().asDict() == {"source": "f.csv", "active": 1, "skipped": 2}


def test_dedupe_keeps_place_of_first(spark):
    rows = spark.createDataFrame([("k", "Unlabeled", 1, "x"), ("k", "Phishing", 5, "y"), ("m", "", 3, "z")], "key string, label string, ord bigint, v string")
    found = C.cap(C.dedupe_by_priority(rows, ["key"]), 1, "ord").collect()
    assert [(r["key"], r["label"], r["ord"], r["v"]) for r in found] == [("k", "Phishing", 1, "y")]
    assert C.cap(rows, 0, "ord").count() == 3


def test_schema_defaults(spark):
    row = C.enforce_schema(spark.createDataFrame([(0.88, "")], "lexical_similarity_score double, dns_status string")).first()
    assert row["lexical_similarity_score"] == 0.88 and row["ssl_valid"] is False and row["label"] == -1 and row["dns_status"] == "unknown" and tuple(row.asDict()) == COMPACT_COLUMNS
    assert C.failed_rows(spark.range(1)).first()["validation_status"] == "extraction_failed"


def test_shared_ips(spark):
    rows = spark.createDataFrame([(1, "203.0.113.5", "a", ""), (2, "203.0.113.5", "b", ""), (3, "203.0.113.6", "a", ""), (4, "", "a", "")], "ord int, resolved_ips string, target_brand_domain string, critical_sector_entity_name string")
    assert [r["ip_seen_with_many_brands"] for r in N.mark_shared_ips(rows).orderBy("ord").collect()] == [1, 1, 0, -1]


def label(spark, **values):
    kinds = ", ".join(f"{k} {'string' if isinstance(v, str) else 'double' if isinstance(v, float) else 'int'}" for k, v in values.items())
    return R.label_rows(spark.createDataFrame([tuple(values.values())], kinds)).first()


def test_rule_labels(spark):
    base = {"lexical_similarity_score": 0.91, "dns_check_pass": 1, "page_fetch_success": 1}
    assert label(spark, **base)["validation_status"] == "suspected_active_no_phish_evidence"
    low = label(spark, lexical_similarity_score=0.2, source_label="Phishing")
    assert (low["validation_status"], low["include_in_ml"], low["label"]) == ("below_high_lexical_threshold", 0, 1)
    hit = label(spark, **base, has_login_form=1, has_password_input=1, brand_token_or_logo_present=1)
    assert (hit["validation_status"], hit["label"]) == ("phishing", 1)
    assert label(spark, **base, has_password_input=1, has_login_form=1)["validation_status"] == "suspected_unconfirmed"
    assert label(spark, **base, has_password_input=1, same_html_hash_domain_count_7d=4)["phishing_campaign"] == 1
    assert label(spark, **base, favicon_hash_matches_known_phish=1)["validation_reason"] == "favicon hash matches known phishing hash"
    assert label(spark, lexical_similarity_score=0.9, extraction_status="failed")["validation_status"] is None


@pytest.mark.parametrize(
    "standard, hardened, status, final, confidence",
    [
        (1, 0, "", "confirmed_phishing", "high"),
        (0, 1, "phishing", "confirmed_phishing", "high"),
        (0, 1, "x", "suspicious_needs_review", "medium"),
        (0, 0, "suspected_inactive", "suspicious_needs_review", "low"),
        (0, 0, None, "low_risk", "low"),
    ],
)
def test_final_decision(spark, standard, hardened, status, final, confidence):
    rows = spark.createDataFrame([(standard, hardened, status)], "standard_prediction int, hardened_prediction int, validation_status string")
    found = R.final_decision(rows).first()
    assert (found["final_classification"], found["classification_confidence"]) == (final, confidence)


def test_thresholds(spark):
    rows = spark.createDataFrame([(1, 0.9), (1, 0.8), (1, 0.4), (0, 0.6), (0, 0.1), (0, None)], "y int, s double")
    sweep = {r["k"]: r for r in M.threshold_sweep(rows, "y", "s").collect()}
    assert len(sweep) == 181
    for k, r in sweep.items():
        t = r["threshold"]
        assert (r["tp"], r["fp"]) == (sum(s >= t for s in (0.9, 0.8, 0.4)), sum(s >= t for s in (0.6, 0.1))), k
    chosen = M.choose_threshold(M.threshold_sweep(rows, "y", "s"), 1.0).first()
    assert chosen["recall"] == 1.0 and chosen["threshold"] <= 0.4
    assert M.choose_threshold(M.threshold_sweep(rows.where("y = 0"), "y", "s"), 0.5).first()["k"] == 0


def test_reliable_negatives(spark):
    rows = spark.createDataFrame([(i, x) for i, x in enumerate((0.1, 0.2, 0.4, 1.0))], "id int, s double")
    under = M.reliable_negatives(rows, "s", "id", 0.3, 0.9, 1).where("is_reliable").collect()
    assert sorted(r["id"] for r in under) == [0] and under[0]["cutoff"] == pytest.approx(0.19)
    lowest = M.reliable_negatives(rows, "s", "id", 0.3, 0.05, 3).where("is_reliable").collect()
    assert sorted(r["id"] for r in lowest) == [0, 1, 2] and lowest[0]["cutoff"] == pytest.approx(0.4)


def test_numeric_features_and_truth_column(spark):
    rows = spark.createDataFrame([("1", "True", "x", 5.0, None), ("2", "False", "y", 5.0, "phish")], "a string, b string, c string, d double, ground_truth string")
    table, names = M.numeric_features(rows, ())
    assert names == ["a", "b"] and table.orderBy("a").first()["b"] == 1.0
    assert M.truth_column(rows, ("manual_label", "ground_truth")) == "ground_truth" and M.truth_column(rows, ("x",)) == ""


def test_hash_joins(spark):
    rows = spark.createDataFrame([(1, "ff"), (2, "f0"), (3, ""), (4, None)], "id int, h string")
    refs = spark.createDataFrame([("fe",), ("zz",)], "hash string")
    found = {r["id"]: r["s"] for r in E.nearest_hash(rows, "h", refs, 1, "s").collect()}
    assert found == {1: round(1 - 1 / 64, 6), 2: round(1 - 3 / 64, 6), 3: 0.0, 4: 0.0}
    assert sorted(r["id"] for r in E.hamming_semi(rows, "h", refs, 2).collect()) == [1]


def test_enrich(spark):
    page = '<html><title>Axis Bank</title><form action="http://other.org/p"><input type="password"></form>axis</html>'
    rows = rows_of(spark, ("http://axisbnk.com", "", "", "Phishing"), ("http://axis.bank.in", "", "", ""), ("http://axisbonk.com/x", "", "", ""))
    rows = rows.select("*", *(F.lit("").alias(c) for c in ("registrar_name", "registrant_name", "registrant_country", "nameservers", "hosting_ip", "hosting_isp", "hosting_country", "dns_records")))
    given = {
        "dns": spark.createDataFrame([(h, 1, 1, "9.9.9.9", 0, 0, "", "success") for h in ("axisbnk.com", "axisbonk.com")], E.DNS),
        "http": spark.createDataFrame([("http://axisbnk.com", page, "http://axisbnk.com", 200, 1, 0, 0, "text/html", "", "success")], E.HTTP),
        "registration": E.registration_from_answers(spark.createDataFrame([("axisbnk.com", 200, '{"events":[{"eventAction":"registration","eventDate":"2026-03-01T00:00:00Z"}],"registrar":"GoDaddy"}')], "registered_domain string, http_status int, answer string")),
    }
    result = enrich(rows, brands_of(spark, ("axis.bank.in", "Axis Bank")), SET, given)
    found = {r["domain"]: r for r in result.features.collect()}
    a = found["axisbnk.com"]
    assert a["has_password_input"] == 1 and a["form_action_external"] == 1 and a["brand_token_or_logo_present"] == 1 and a["domain_age_days"] == 21 and a["registrar_reputation_score"] == 8
    assert a["validation_status"] == "phishing" and a["extraction_status"] == "partial" and len(a["html_dom_hash"]) == 16
    assert found["axisbonk.com"]["validation_status"] == "suspected_active_infra" and set(found) == {"axisbnk.com", "axisbonk.com"}
    assert result.official.count() == 1 and result.compact.columns == list(COMPACT_COLUMNS) and result.compact.count() == 2


def test_collect(spark):
    urls = spark.createDataFrame([("http://paypa1.com/x", 1), ("paypa1.com/y", 2), ("http://paypal.com", 3), ("http://login.paypal.com", 4), ("other.org", 5)], "url string, ord bigint")
    out = collect([("local", "list", urls), ("feed", "feed", urls.limit(1))], brands_of(spark, ("paypal.com", "PayPal")), SET, F.to_date(F.lit("2026-03-22")))
    found = out.collect()
    assert len(found) == 1 and found[0]["Phishing/Suspected Domains (i.e. Class Label)"] == "Phishing" and found[0]["Date of detection (DD-MM-YYYY)"] == "22-03-2026"


def test_readers_and_writers(spark, tmp_path):
    (tmp_path / "a.txt").write_text("# c\n\n http://one.com \n")
    (tmp_path / "openphish.csv").write_bytes("Domain Name,Remarks,Critical Sector Entity Name\nhttp://two.com/ü,\"a,b\",\n,x,\n".encode("latin1"))
    (tmp_path / "brands.json").write_text('["http://f.com", {"url": "http://g.com"}]')
    rows = S.read_contexts(spark, str(tmp_path)).orderBy("ord").collect()
    assert [(r["detected_domain"], r["source_label"], r["source_row"]) for r in rows] == [("one.com", "", 2), ("two.com", "Phishing", 2)] and rows[1]["remarks"] == "a,b"
    assert sorted(r["url"] for r in S.read_feed(spark, str(tmp_path / "brands.json")).collect()) == ["http://f.com", "http://g.com"]
    brands = S.brands_from(spark.createDataFrame([("www.A.com/x; b.in", "First"), ("a.com", "Second")], "domains string, cse string"))
    assert {r["domain"]: r["name"] for r in brands.collect()} == {"a.com": "First", "b.in": "First"}
    found = S.permutations_from(spark.createDataFrame([("a.com", 'log [{"domain-name":"aa.com"},{"domain":"x.a.com"},{"domain":"a.com"}] end')], "brand string, json string"))
    assert [r["host"] for r in found.collect()] == ["aa.com"]
    boot = S.bootstrap_from(spark.createDataFrame([('{"services":[[["com","net"],["https://r.example/"]]]}',)], "json string"))
    assert sorted((r["tld"], r["server"]) for r in boot.collect()) == [("com", "https://r.example"), ("net", "https://r.example")]
    W.write_csv(spark.createDataFrame([("x", 1)], "a string, b int"), str(tmp_path / "out"), ["b", "missing"])
    assert S.read_csv(spark, str(tmp_path / "out")).columns == ["b", "missing"]
    assert S.candidate_files(spark, str(tmp_path)) and S.candidate_column(spark.createDataFrame([("x",)], "my_url string")) == "my_url"
    with pytest.raises(FileNotFoundError):
        (tmp_path / "none").mkdir()
        S.read_contexts(spark, str(tmp_path / "none"))


def test_train_and_score(spark, tmp_path):
    rows = spark.range(120).select(F.col("id").alias("row_key"), F.when(F.col("id") < 30, "Phishing").otherwise("").alias("source_label"), F.when(F.col("id") < 40, F.col("id") % 5 + 10).otherwise(F.col("id") % 7).alias("strength"), (F.col("id") % 3).alias("noise"), (F.col("id") % 4).cast("string").alias("group"))
    s = Settings(trees=5, min_reliable=10)
    trained = learn.train(rows, s, group_columns=["group", "nope"], group_splits=1)
    scored = trained.scored.collect()
    assert len(scored) == 120 and all(0 <= r["pu_score"] <= 1 for r in scored) and {"positive", "reliable_negative", "positive_validation"} <= {r["pu_training_role"] for r in scored}
    assert trained.importances()[0][0] == "strength" and trained.summary["group_holdout"]["nope"]["skipped"].startswith("Column")
    trained.save(str(tmp_path / "m"))
    again = learn.Trained.load(spark, str(tmp_path / "m"))
    classified, long = learn.score(rows.withColumn("validation_status", F.lit("phishing")), again, trained)
    assert long.count() == 240 and classified.where("standard_prediction = 1 and final_classification <> 'confirmed_phishing'").count() == 0
    report = learn.evaluate(classified.withColumn("ground_truth", (F.col("row_key") < 40).cast("int")))
    assert report["models"]["standard"]["recall"] > 0.9 and len(report["threshold_sweeps"]["hardened"]) == 181
    assert learn.evaluate(classified.drop("source_label"))["skipped"]
    wide, tall = learn.empty_scores(rows.limit(0).select("row_key"))
    assert wide.count() == 0 and "hardened_score" in wide.columns and "model" in tall.columns
    with pytest.raises(ValueError):
        learn.train(rows.limit(5), s)


def test_streaming_campaigns(spark, tmp_path):
    from lurelens.streaming.campaigns import campaign_windows

    spark.createDataFrame([("2024-01-01 00:00:00", "h", "a"), ("2024-01-02 00:00:00", "h", "b"), ("2024-03-01 00:00:00", "h", "c")], "ts string, hash string, domain string").write.json(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, hash string, domain string").json(str(tmp_path / "in"))
    q = campaign_windows(stream).writeStream.format("memory").queryName("campaigns").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("SELECT max(domains) AS n FROM campaigns").first()["n"] == 2


def test_probes(spark):
    from lurelens.operators import probes as P

    def ask(host):
        if host == "bad.com":
            raise TimeoutError
        return {"dns_check_pass": 1, "resolved_ips": "1.1.1.1", "status": "success"}

    hosts = spark.createDataFrame([("a.com",), ("a.com",), ("bad.com",), ("",), (None,)], "host string")
    found = {r["host"]: r for r in P.probe(hosts, "host", E.DNS, ask, "dns_error", 2, 2, 2, 0.0).collect()}
    assert set(found) == {"a.com", "bad.com"} and found["a.com"]["resolved_ips"] == "1.1.1.1" and found["bad.com"]["dns_error"] == "TimeoutError"
    assert P.follow_aliases("a", {"a": "b.", "b": "C", "c": "b"}.get) == ["b", "c"]
    rows = spark.createDataFrame([("a.com", "9.9.9.9", "CNAME x; cname y"), ("b.com", "", ""), ("c.com", "", "")], "detected_domain string, hosting_ip string, dns_records string")
    answers = spark.createDataFrame([("a.com", ["1.1.1.1"], ["x"], []), ("c.com", [], [], ["A:NXDOMAIN"])], "host string, ips array<string>, aliases array<string>, errors array<string>")
    dns = {r["host"]: r for r in P.merged_dns(rows, answers).collect()}
    assert (dns["a.com"]["resolved_ips"], dns["a.com"]["cname_chain_length"], dns["b.com"]["status"], dns["c.com"]["status"]) == ("1.1.1.1;9.9.9.9", 2, "not_found", "error")
    fetched = spark.createDataFrame([("http://a.com", "<p>x", ["http://a.com", "http://www.a.com", "http://b.org"], 200, "t", ""), ("http://c.com", " ", [], 204, None, None)], "url string, html string, chain array<string>, status_code int, content_type string, error string")
    http = {r["url"]: r for r in P.http_answers(fetched, SET.suffixes).collect()}
    assert (http["http://a.com"]["redirect_cross_domain_count"], http["http://a.com"]["redirect_count"], http["http://c.com"]["fetch_success"], http["http://c.com"]["status"]) == (1, 2, 0, "http_204")
    made = P.permutations(brands_of(spark, ("a.com", "")), lambda d: '[{"domain": "aa.com"}]', 1)
    assert [r["host"] for r in made.collect()] == ["aa.com"]


def test_reports(spark):
    from lurelens.plans import reports

    rows = spark.createDataFrame([("http://www.a.com", "t", 0.9, 0.9, "phishing", 1, 1, "confirmed_phishing", 0.95), ("http://b.com", "t", 0.1, 0.9, "x", 0, 1, "suspicious_needs_review", 0.5)], "url string, target_brand_domain string, standard_score double, hardened_score double, validation_status string, standard_prediction int, hardened_prediction int, final_classification string, pu_score double")
    assert reports.per_class(rows).count() == 2 and reports.both_models(rows).count() == 1 and reports.hardened_only(rows).count() == 1
    assert [r["band"] for r in reports.for_review(rows).collect()] == ["urgent", "medium"]
    assert reports.hosts_in(rows, spark.createDataFrame([("a.com",)], "host string")).count() == 1


def test_command_line(spark, tmp_path):
    from lurelens.__main__ import main

    (tmp_path / "brands.csv").write_text("domains,cse\npaypal.com,PayPal\n")
    (tmp_path / "feed.txt").write_text("http://paypa1.com/x\nhttp://other.org\n")
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("http://paypa1.com/x\n")
    p = str(tmp_path)
    main(["collect", "--brands", f"{p}/brands.csv", "--feed", f"{p}/feed.txt", "--output", f"{p}/out"], spark)
    assert S.read_csv(spark, f"{p}/out").count() == 1
    main(["enrich", "--input", f"{p}/in", "--brands", f"{p}/brands.csv", "--output", f"{p}/rich"], spark)
    assert S.read_csv(spark, f"{p}/rich/features").first()["validation_status"] == "suspected_inactive"
