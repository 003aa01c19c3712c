"""Chains, the evidence store, the registration cascade, the permutation budget, references, workbooks and images."""

import struct
import threading
import zipfile
import zlib
from datetime import datetime
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import numpy as np
import pytest
from pyspark.sql import functions as F

from lurelens.config import Pace, Settings, number
from lurelens.functions import hashing, images
from lurelens.operators import cascade, chains
from lurelens.operators import evidence as E
from lurelens.operators import probes
from lurelens.operators.probes import merged_dns
from lurelens.operators.store import EvidenceStore
from lurelens.plans import collect, references
from lurelens.sources import feeds, generators
from lurelens.sources import readers as S

SET = Settings()


def calls(path):
    return sorted(path.read_text().split()) if path.exists() else []


# DNS.


def answers_of(spark, known, log=None):
    """An ask function over known answers {(name, kind): values or error}; each call notes what it was asked for."""
    rows = [(n, k, v if isinstance(v, list) else None, "" if isinstance(v, list) else v) for (n, k), v in known.items()]
    table = spark.createDataFrame(rows, "name string, kind string, values array<string>, error string")

    def ask(names):
        if log is not None:
            log.extend((r["name"], r["kind"]) for r in names.collect())
        return names.join(table, ["name", "kind"], "left").select("name", "kind", "values", F.coalesce("error", F.lit("NXDOMAIN")).alias("error"))

    return ask


def test_alias_chains(spark):
    known = {("a", "CNAME"): ["B."], ("b", "CNAME"): ["c", "ignored"], ("c", "CNAME"): "NoAnswer", ("x", "CNAME"): ["y"], ("y", "CNAME"): ["x"], ("t", "CNAME"): "LifetimeTimeout", ("z", "CNAME"): ["b"]}
    known |= {(f"n{i}", "CNAME"): [f"n{i + 1}"] for i in range(12)}
    log = []
    hosts = spark.createDataFrame([(h,) for h in ("a", "x", "t", "z", "n0", "none", "a", "", None)], "host string")
    found, _ = chains.alias_chains(hosts, answers_of(spark, known, log))
    got = {r["host"]: (r["aliases"], r["error"]) for r in found.collect()}
    assert got == {"a": (["b", "c"], "NoAnswer"), "x": (["y", "x"], ""), "t": ([], "LifetimeTimeout"), "z": (["b", "c"], "NoAnswer"), "n0": ([f"n{i}" for i in range(1, 11)], ""), "none": ([], "NXDOMAIN")}
    assert len(log) == len(set(log))  # two hosts come to "b", which is asked for once
    assert chains.alias_chains(hosts.limit(0), answers_of(spark, known))[0].count() == 0


def test_resolve_dns(spark):
    known = {("a", "A"): ["1.1.1.1"], ("a", "CNAME"): ["b"], ("slow", "A"): "LifetimeTimeout", ("slow", "AAAA"): "LifetimeTimeout"}
    log = []
    hosts = spark.createDataFrame([("a",), ("slow",), ("gone",)], "host string")
    fallback = lambda names: names.select("name", F.when(F.col("name") == "slow", F.array(F.lit("2.2.2.2"))).alias("values"), F.array().cast("array<string>").alias("aliases"), F.when(F.col("name") == "slow", "").otherwise("gaierror").alias("error"))
    out = chains.resolve_dns(hosts, answers_of(spark, known, log), fallback, retries=2)
    found = {r["host"]: r for r in out.collect()}
    assert log.count(("slow", "A")) == 3 and log.count(("gone", "A")) == 1 and log.count(("a", "A")) == 1
    assert (found["a"]["ips"], found["a"]["aliases"]) == (["1.1.1.1"], ["b"])
    assert found["slow"]["ips"] == ["2.2.2.2"] and found["slow"]["errors"].count("A:LifetimeTimeout") == 3
    assert found["gone"]["errors"][-1] == "socket:gaierror" and found["gone"]["socket_failed"]
    rows = spark.createDataFrame([("a", "", ""), ("gone", "", ""), ("slow", "9.9.9.9", "")], "detected_domain string, hosting_ip string, dns_records string")
    dns = {r["host"]: r for r in merged_dns(rows, out).collect()}
    assert [dns[h]["status"] for h in ("a", "gone", "slow")] == ["success", "error", "success"]
    assert dns["slow"]["resolved_ips"] == "2.2.2.2;9.9.9.9" and dns["a"]["cname_chain_length"] == 1


# Redirects.


def test_redirects(spark, tmp_path):
    web = {"http://a.com/": ("http://b.com/x", 302), "http://b.com/x": ("/y", 301), "http://b.com/y": ("", 200), "http://loop.com/": ("/2", 302), "http://loop.com/2": ("/", 302), "http://dead.com/": ("", 404)}
    web |= {f"http://n.com/{i}": (f"http://n.com/{i + 1}", 302) for i in range(14)} | {"http://n.com/14": ("", 200)}
    table = spark.createDataFrame([(u, loc, code, f"body of {u}", "text/html", "") for u, (loc, code) in web.items()], chains.HOP)
    asked = []

    def ask(urls):
        asked.extend(r["url"] for r in urls.collect())
        return urls.join(table, "url", "left").withColumn("error", F.coalesce("error", F.lit("ConnectionError")))

    starts = spark.createDataFrame([(u,) for u in ("http://a.com/", "http://b.com/x", "http://loop.com/", "http://dead.com/", "http://n.com/0", "http://n.com/4", "http://none.com/")], "url string")
    hops = chains.fetch_hops(starts, ask)
    assert len(asked) == len(set(asked))
    found = {r["url"]: r for r in chains.redirect_chains(hops, SET.suffixes).collect()}
    a = found["http://a.com/"]
    assert (a["final_url"], a["redirect_count"], a["redirect_cross_domain_count"], a["fetch_success"], a["html"], a["status"]) == ("http://b.com/y", 2, 1, 1, "body of http://b.com/y", "success")
    assert found["http://loop.com/"]["error"] == "TooManyRedirects" and found["http://loop.com/"]["final_url"] == "http://loop.com/"
    assert (found["http://dead.com/"]["status"], found["http://dead.com/"]["fetch_success"]) == ("http_404", 0)
    assert found["http://n.com/0"]["error"] == "TooManyRedirects" and found["http://n.com/4"]["redirect_count"] == 10
    assert found["http://none.com/"]["error"] == "ConnectionError" and found["http://none.com/"]["status"] == "error"


# The store.


def test_store_is_read_first(spark, tmp_path):
    schema, log = "host string, resolved_ips string, status string", tmp_path / "log"

    def ask(keys):
        with open(log, "a") as out:
            out.write("".join(f"{r['host']} " for r in keys.collect()))
        return keys.select("host", F.concat(F.lit("ip of "), "host").alias("resolved_ips"), F.when(F.col("host") == "bad", "error").otherwise("success").alias("status"))

    hosts = lambda *h: spark.createDataFrame([(x,) for x in h], "host string")
    store = EvidenceStore(spark, f"file://{tmp_path}/store", "2026-01-01")
    first = store.serve(hosts("a", "b", "bad", "a", "", None), "dns", "host", schema, ask)
    assert (first.keys, first.hits, first.asked, first.failed) == (3, 0, 3, 1) and first.table.count() == 3
    second = EvidenceStore(spark, f"file://{tmp_path}/store", "2026-01-03").serve(hosts("a", "b", "bad", "c"), "dns", "host", schema, ask)
    assert (second.hits, second.asked) == (2, 2) and calls(log) == ["a", "b", "bad", "bad", "c"]
    assert {r["host"]: r["resolved_ips"] for r in second.table.collect()} == {h: f"ip of {h}" for h in ("a", "b", "bad", "c")}
    third = EvidenceStore(spark, f"file://{tmp_path}/store", "2026-01-03").serve(hosts("a", "c"), "dns", "host", schema, ask, days=1)
    assert (third.hits, third.asked) == (1, 1)  # the answer for "a" is too old
    assert store.serve(hosts("a", "b", "c"), "dns", "host", schema, ask).asked == 0
    assert store.serve(hosts(), "tls", "host", schema, ask).table.count() == 0


# Registrations.


def test_cascade(spark, tmp_path):
    log, fell = tmp_path / "rdap", tmp_path / "whois"
    rules = S.suffix_rules(spark.createDataFrame([("com\nuk\nco.uk\njp",)], "value string"))
    bootstrap = spark.createDataFrame([("com", "https://com"), ("uk", "https://uk")], "tld string, server string")
    path, fell_path = str(log), str(fell)

    def client(server, domain):
        with open(path, "a") as out:
            out.write(f"{server}|{domain} ")
        name = domain.split(".")[0]
        if name == "slow":
            raise TimeoutError
        if name == "odd":
            raise OSError
        code = {"gone": 404, "limit": 429, "down": 503, "forbidden": 403}.get(name, 200)
        date = '{"eventAction":"registration","eventDate":"2020-01-02T00:00:00Z"}' if name != "undated" else ""
        return code, '{"events":[%s],"nameservers":[{"ldhName":"NS1.X."}]}' % date

    def fallback(domain):
        with open(fell_path, "a") as out:
            out.write(f"{domain} ")
        if domain.startswith("gone"):
            raise TimeoutError
        if domain.startswith("limit"):
            raise ValueError("refused")
        return {"creation_date": datetime(2001, 2, 3), "registrar_name": "R", "nameservers": ["NS2.Y.", "ns1.y"]}

    names = ["good.com", "a.co.uk", "gone.com", "limit.com", "down.uk", "slow.com", "odd.com", "undated.com", "x.jp", "forbidden.com"]
    domains = spark.createDataFrame([(n,) for n in [*names, "GOOD.com", "", None]], "registered_domain string")
    found = {r["registered_domain"]: r for r in cascade.registrations(domains, bootstrap, rules, client, fallback, fallback_pause=0.0, retries=2, backoff=0.0).collect()}
    assert set(found) == set(names)
    status = {n: (r["rdap_status"], r["whois_status"], r["source"]) for n, r in found.items()}
    assert status["good.com"] == status["a.co.uk"] == ("success", "skipped", "rdap")
    assert status["gone.com"] == ("not_found", "timeout", "whois") and status["limit.com"] == ("rate_limited", "error", "whois")
    assert status["down.uk"] == status["slow.com"] == status["odd.com"] == status["forbidden.com"] == ("error", "success", "whois")
    assert status["x.jp"] == ("unavailable", "success", "whois") and status["undated.com"] == ("success", "success", "whois")
    assert found["good.com"]["creation_date"] == datetime(2020, 1, 2) and found["good.com"]["nameservers"] == ["ns1.x"]
    assert found["slow.com"]["nameservers"] == ["ns1.y", "ns2.y"] and found["limit.com"]["error"] == "refused"
    made = calls(log)
    assert {m: made.count(m) for m in set(made)} == {"https://com|good.com": 1, "https://uk|a.co.uk": 1, "https://com|gone.com": 1, "https://com|limit.com": 3, "https://uk|down.uk": 3, "https://com|slow.com": 3, "https://com|odd.com": 3, "https://com|undated.com": 1, "https://com|forbidden.com": 1}
    assert calls(fell) == sorted(set(names) - {"good.com", "a.co.uk"})  # only what had no dates, once each


def test_hosting_from_answers(spark):
    rows = spark.createDataFrame([("1.1.1.1", 200, '{"name":"NET-1"}', ""), ("2.2.2.2", 404, None, ""), ("3.3.3.3", None, None, "TimeoutError"), ("4.4.4.4", 200, "{}", "")], "ip string, http_status int, answer string, error string")
    found = {r["ip"]: tuple(r)[1:] for r in E.hosting_from_answers(rows).select("ip", "asn_org", "status", "error").collect()}
    assert found == {"1.1.1.1": ("NET-1", "success", ""), "2.2.2.2": ("", "http_404", "HTTP 404"), "3.3.3.3": ("", "error", "TimeoutError"), "4.4.4.4": ("", "not_found", "")}


# The budget.


def test_budget_ends_early(spark, tmp_path):
    log = str(tmp_path / "log")

    def generate(domain):
        with open(log, "a") as out:
            out.write(f"{domain} ")
        if domain == "bankb.com":
            raise RuntimeError("exit code 1")
        stem = domain.split(".")[0]
        return "note [" + ", ".join('{"domain-name": "%s"}' % h for h in (domain, f"{stem}1.com", f"www.{domain}", f"{stem}1.com", f"{stem}2.com", f"{stem}-x.net")) + "]"

    brands = spark.createDataFrame([(f"bank{c}.com", f"Bank {c}") for c in "abcdefgh"], "domain string, name string")
    found = collect.budgeted_permutations(brands, generate, SET, budget=4, wave=2)
    rows = [r["host"] for r in found.rows.orderBy("ord").collect()]
    assert rows == ["banka1.com", "banka2.com", "banka-x.net", "bankc1.com"]
    assert calls(tmp_path / "log") == ["banka.com", "bankb.com", "bankc.com", "bankd.com"]  # the waves after the second never run
    c = found.counters
    assert (c["domains"], c["domains_processed"], c["domain_failures"], c["loaded"], c["matched"], c["capped"]) == (8, 4, 1, 9, 4, 1)
    gate = lambda hosts: hosts.select("host", F.col("host").endswith(".com").cast("int").alias("dns_check_pass"))
    every = collect.budgeted_permutations(brands, generate, SET, dns=gate, wanted=["banka.com", "bankh.com"])
    assert sorted(r["host"] for r in every.rows.collect()) == ["banka1.com", "banka2.com", "bankh1.com", "bankh2.com"]
    assert (every.counters["dns_inactive"], every.counters["capped"]) == (2, 0)
    with pytest.raises(FileNotFoundError):
        collect.budgeted_permutations(brands, generators.command_generator("no-such-program"), SET, budget=1)
    assert collect.format_counts({"a": 1, "b": 3, "c": 3}, 2) == "b=3, c=3"
    script = tmp_path / "generator"
    script.write_text('#!/bin/sh\n[ "$4" = bad.com ] && { echo broken >&2; exit 3; }\n[ "$4" = slow.com ] && exec sleep 9\necho "[{\\"domain\\": \\"x-$4\\"}]"\n')
    script.chmod(0o755)
    run = generators.command_generator(str(script), timeout=2)
    assert run("a.com") == '[{"domain": "x-a.com"}]\n'
    with pytest.raises(RuntimeError, match="broken"):
        run("bad.com")
    with pytest.raises(Exception, match="timed out"):
        run("slow.com")


# Workbooks.

_NS = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'


def workbook(path, sheet, shared="", styles=""):
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {_NS} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="S" sheetId="1" r:id="rId7"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId7" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {_NS}><sheetData>{sheet}</sheetData></worksheet>")
        z.writestr("xl/sharedStrings.xml", f"<sst {_NS}>{shared}</sst>")
        z.writestr("xl/styles.xml", f'<styleSheet {_NS}><numFmts><numFmt numFmtId="170" formatCode="yyyy/mm"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="170"/></cellXfs></styleSheet>')


def test_workbook(spark, tmp_path):
    shared = "<si><t>Domain Name</t></si><si><r><t>bad</t></r><r><t xml:space='preserve'>.com</t></r></si><si><t>Remarks</t></si>"
    sheet = (
        '<row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>2</v></c><c r="D1" t="s"><v>2</v></c><c r="E1" t="inlineStr"><is><t>Day</t></is></c></row>'
        '<row r="2"><c r="A2" t="s"><v>1</v></c><c r="D2"><v>7</v></c><c r="E2" s="1"><v>45292.5</v></c></row>'
        '<row r="4"><c r="B4" t="b"><v>1</v></c><c r="A4" t="str"><v>x.org</v></c><c r="D4"><v>1.25</v></c><c r="E4" s="2"><v>1</v></c></row>'
        '<row><c t="e"><v>#N/A</v></c></row>'
    )
    workbook(tmp_path / "a.xlsx", sheet, shared)
    table = S.read_table(spark, f"file://{tmp_path}/a.xlsx")
    assert table.columns == ["Domain Name", "Remarks", "Unnamed: 2", "Remarks.1", "Day"]
    rows = [tuple(r) for r in table.collect()]
    assert rows == [("bad.com", "", "", "7", "2024-01-01 12:00:00"), ("",) * 5, ("x.org", "True", "", "1.25", "1899-12-31 00:00:00"), ("",) * 5]
    contexts = S.read_contexts(spark, f"file://{tmp_path}").orderBy("ord").collect()
    assert [(r["detected_domain"], r["source_row"]) for r in contexts] == [("bad.com", 2), ("x.org", 4)]
    workbook(tmp_path / "none.xlsx", "")
    assert S.read_table(spark, f"file://{tmp_path}/none.xlsx").columns == []
    many = "".join(f'<row r="{i}"><c r="A{i}" t="inlineStr"><is><t>{"h" if i == 1 else i}</t></is></c></row>' for i in range(1, 9001))
    workbook(tmp_path / "many.xlsx", many)
    assert [r["h"] for r in S.read_table(spark, f"file://{tmp_path}/many.xlsx").collect()] == [str(i) for i in range(2, 9001)]


# Images.


def png(pixels, colour, depth=8, filters=(0,), palette=None, interlaced=False):
    """A PNG of (rows, columns, channels) samples, each line filtered as told."""
    height, width, channels = pixels.shape
    step = max(1, channels * depth // 8)

    def packed(line):
        flat = line.reshape(-1).astype(np.uint32)
        if depth == 16:
            return b"".join(struct.pack(">H", int(v) * 257) for v in flat)
        if depth == 8:
            return flat.astype(np.uint8).tobytes()
        bits = "".join(f"{int(v):0{depth}b}" for v in flat)
        return bytes(int(bits[i : i + 8].ljust(8, "0"), 2) for i in range(0, len(bits), 8))

    def filtered(rows):
        out, above = b"", None
        for y, line in enumerate(rows):
            raw, kind = packed(line), filters[y % len(filters)]
            above = above or bytes(len(raw))
            done = bytearray()
            for x, v in enumerate(raw):
                a, b, c = raw[x - step] if x >= step else 0, above[x], above[x - step] if x >= step else 0
                p = a + b - c
                guess = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
                done.append((v - (0, a, b, (a + b) // 2, guess)[kind]) % 256)
            out, above = out + bytes([kind]) + bytes(done), raw
        return out

    if interlaced:
        body = b"".join(filtered(pixels[y::dy, x::dx]) for x, y, dx, dy in images._PASSES if pixels[y::dy, x::dx].size)
    else:
        body = filtered(pixels)
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    head = struct.pack(">IIBBBBB", width, height, depth, colour, 0, 0, int(interlaced))
    plte = chunk(b"PLTE", bytes(palette)) if palette is not None else b""
    squeezed = zlib.compress(body)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + plte + chunk(b"IDAT", squeezed[:9]) + chunk(b"IDAT", squeezed[9:]) + chunk(b"IEND", b"")


@pytest.mark.parametrize("interlaced", [False, True])
@pytest.mark.parametrize("colour,channels", [(0, 1), (2, 3), (4, 2), (6, 4)])
def test_png_pixels(colour, channels, interlaced):
    rng = np.random.default_rng(colour)
    x = rng.integers(0, 256, (13, 11, channels))
    want = images.luminance(x[..., :3]) if channels > 2 else x[..., 0]
    assert (images.png_gray(png(x, colour, 8, (0, 1, 2, 3, 4), interlaced=interlaced)) == want).all()
    assert (images.png_gray(png(x, colour, 16, (4, 3, 1), interlaced=interlaced)) == want).all()


def test_png_of_few_bits_palettes_and_icons():
    x = np.arange(48).reshape(6, 8, 1)
    for depth in (1, 2, 4):
        levels = x % (1 << depth)
        assert (images.png_gray(png(levels, 0, depth, (0, 2))) == levels[..., 0] * (255 // ((1 << depth) - 1))).all()
    palette = np.random.default_rng(1).integers(0, 256, (16, 3)).astype(np.uint8)
    data = png(x % 16, 3, 4, palette=palette.tobytes())
    assert (images.png_gray(data) == images.luminance(palette[x[..., 0] % 16])).all()
    small = png(x % 2, 0, 1)[:]
    icon = struct.pack("<HHH", 0, 1, 2) + struct.pack("<BBBBHHII", 8, 6, 0, 0, 1, 8, len(small), 38) + struct.pack("<BBBBHHII", 8, 6, 0, 0, 1, 8, len(data), 38 + len(small)) + small + data
    assert images.gray_pixels(icon).shape == (6, 8)


def test_lanczos_and_hash():
    flat = np.full((50, 70), 77, np.uint8)
    assert (images.resized(flat) == 77).all() and images._weights(70, 32).sum(1).max() - (1 << 22) < 40
    same = np.arange(1024).reshape(32, 32).astype(np.uint8)
    assert (images.resized(same) == same).all()
    ramp = np.tile(np.arange(64, dtype=np.uint8) * 4, (64, 1))
    assert np.abs(images.resized(ramp)[:, 4:-4].astype(int) - (np.arange(4, 28) * 8 + 2)).max() <= 1
    left = np.zeros((40, 40, 1), int)
    left[:, :20] = 255
    first, second = hashing.image_hash(png(left, 0)), hashing.image_hash(png(255 - left, 0))
    assert len(first) == 16 and first != second and first == hashing.perceptual_bits(images.resized(left[..., 0].astype(np.uint8)))
    good = png(left, 0)
    assert hashing.image_hash(good[:60]) == hashing.image_hash(b"GIF89a") == hashing.image_hash(None) == hashing.image_hash(good.replace(b"IDAT", b"IDAX")) == ""


# References.


def test_brand_references(spark):
    logo = np.zeros((40, 40, 1), int)
    logo[:, :20] = 255
    icon = png(logo, 0)
    web = {
        "https://good.com": ("<title>Good</title><link rel='icon' href='/i.png'><img src='l.png' alt='good logo'>text of good", 1, "https://good.com/home/"),
        "http://old.com": ("words of old", 1, "http://old.com/"),
    }
    table = spark.createDataFrame([(u, h, f, ok, "success") for u, (h, ok, f) in web.items()], "url string, html string, final_url string, fetch_success int, status string")
    columns = [c.split(" ")[0] for c in E.HTTP.split(", ")]

    def fetch(urls):
        found = urls.join(table, "url", "left").withColumns({"fetch_success": F.coalesce("fetch_success", F.lit(0)), "status": F.coalesce("status", F.lit("error"))})
        return found.select(*(F.col(c) if c in found.columns else F.lit(None).cast("int" if c in ("status_code", "redirect_count", "redirect_cross_domain_count") else "string").alias(c) for c in columns))

    binary = lambda urls: urls.select("url", F.when(F.col("url").isin("https://good.com/i.png", "https://good.com/home/l.png"), F.lit(icon)).alias("data"))
    brands = spark.createDataFrame([("good.com", "Good"), ("old.com", "Old"), ("dead.com", "Dead"), ("www.good.com", "Good")], "domain string, name string")
    found = references.brand_references(brands, SET, fetch, binary)
    favicons, pages, logos = ({r["domain"]: r for r in t.collect()} for t in (found.favicons, found.pages, found.logos))
    assert favicons["good.com"]["favicon_hash"] == logos["good.com"]["logo_hash"] == hashing.image_hash(icon)
    assert {d: r["status"] for d, r in favicons.items()} == {"good.com": "success", "old.com": "image_hash_failed", "dead.com": "fetch_failed"}
    assert {d: r["status"] for d, r in pages.items()} == {"good.com": "success", "old.com": "success", "dead.com": "fetch_failed"}
    assert pages["old.com"]["html_dom_hash"] and pages["dead.com"]["final_url"] == "unknown" and pages["old.com"]["final_url"] == "http://old.com/"


def test_lookup_with_maps(spark):
    rows = spark.createDataFrame([("a",), ("b",)], "k string")
    table = spark.createDataFrame([("a", {"x": 1}, 1), ("a", {"x": 0}, 1), ("c", {}, 2)], "k string, m map<string,int>, n int")
    found = {r["k"]: r["t_m"] for r in E.lookup(rows, table, "k", F.col("k"), "t_").collect()}
    assert found == {"a": {"x": 0}, "b": None}


def test_live_feeds(spark, tmp_path):
    (tmp_path / "feed.txt").write_text("# comment\nhttp://a.com/1\n\n http://b.com \n")
    (tmp_path / "feed.csv").write_text('id,url\n1,http://c.com\n2,\n3,"http://d.com/x,y"\n')
    (tmp_path / "odd.csv").write_text("id,address\n1,http://c.com\n")
    at = lambda n: f"file://{tmp_path}/{n}"
    assert [r["url"] for r in feeds.read_live_feed(spark, [at("feed.txt")]).collect()] == ["http://a.com/1", "http://b.com"]
    found = feeds.read_live_feed(spark, feeds.keyed_addresses("K", at("{key}.csv"), at("odd.csv"), at("feed.csv")), "url")
    assert [r["url"] for r in found.collect()] == ["http://c.com", "http://d.com/x,y"]
    assert feeds.keyed_addresses(" ", at("{key}.csv"), "b") == ["b"]
    with pytest.raises(Exception, match="could not be read"):
        feeds.read_live_feed(spark, [at("none"), at("odd.csv")], "url").collect()


def test_pace_is_clamped():
    assert Pace.of({}) == Pace() and number("x", 3, 1) == 3
    odd = Pace.of({"io": "40", "tls": "-3", "fallback": "none", "fallback_pause": "-1", "dns_retries": "-5", "http_timeout": "2.5"})
    assert (odd.io, odd.dns, odd.http, odd.registry, odd.tls, odd.owner) == (40, 80, 40, 40, 1, 20)
    assert (odd.fallback, odd.fallback_pause, odd.dns_retries, odd.http_timeout) == (2, 0.0, 0, 10)


class Site(BaseHTTPRequestHandler):
    def do_GET(self):  # noqa: N802
        code, headers, body = {"/a": (302, {"Location": "/b"}, b""), "/b": (200, {"Content-Type": "text/html; charset=latin-1"}, "<p>caf\xe9".encode("latin-1")), "/big": (200, {}, b"x" * 200_000)}.get(self.path, (404, {}, b"gone"))
        self.send_response(code)
        for k, v in headers.items():
            self.send_header(k, v)
        self.send_header("Content-Length", str(len(body)))
        self.end_headers()
        self.wfile.write(body)

    def log_message(self, *_):
        pass


def test_clients(spark):
    with ThreadingHTTPServer(("127.0.0.1", 0), Site) as server:
        threading.Thread(target=server.serve_forever, daemon=True).start()
        at = f"http://127.0.0.1:{server.server_port}"
        assert probes.hop(f"{at}/a") == {"location": "/b", "status_code": 302, "html": "", "content_type": "", "error": ""}
        assert probes.hop(f"{at}/b")["html"] == "<p>café"
        assert len(probes.image(f"{at}/big")["data"]) == 128_000 and probes.image(f"{at}/none") == {"data": b""}
        assert probes.registry(at, "x.com") == (404, "gone")
        urls = spark.createDataFrame([(f"{at}/a",), (f"{at}/none",), ("http://127.0.0.1:1/",)], "url string")
        hops = chains.fetch_hops(urls, lambda u: probes.probe(u, "url", chains.HOP, probes.hop, "error", 2))
        found = {r["url"].removeprefix(at): r for r in chains.redirect_chains(hops, SET.suffixes).collect()}
        server.shutdown()
    assert (found["/a"]["final_url"], found["/a"]["html"], found["/a"]["redirect_count"]) == (f"{at}/b", "<p>café", 1)
    assert found["/none"]["status"] == "http_404" and found["http://127.0.0.1:1/"]["error"] == "URLError"
