"""URL rules, revisits and main texts of pages."""

from __future__ import annotations

import random
import re

from oracle import compare, duck

from gaugeworks.llm import htmltext, urlfilter, warc

PAGES = "page_id long, url string, html string, host string, path string, row string, text string, wrapper string"


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "h", "p", "r", "t", "w") for i, u, h in rows], PAGES)


def rules(spark, rows):
    return spark.createDataFrame(rows, "verdict string, host string, path string")


def split(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match("[^/?#]*", rest)[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), re.match("[^?#]*", rest[len(host) :])[0]


def test_equal_to_sql(spark, sf_dir):
    assert compare(urlfilter.op6_url_filter(spark, sf_dir), duck(sf_dir), urlfilter.ORACLES["op6_url_filter"]) == []
    assert compare(warc.op5_warc_revisits(spark, sf_dir), duck(sf_dir), warc.ORACLES["op5_warc_revisits"]) == []


def test_url_filter_runs_no_python(spark, sf_dir):
    plan = urlfilter.op6_url_filter(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_rules_against_brute_force(spark):
    rng = random.Random(2)
    hosts = ["com", "a.com", "b.a.com", "xa.com", "org", "c.b.a.com", "A.Com", ""]
    paths = ["", "/", "/a", "/a/", "/a/b", "/a/bc", "/ab", "/b/", "/é"]
    some = [(rng.choice(["allow", "block"]), rng.choice(hosts[:6]), rng.choice(paths)) for _ in range(30)]
    urls = [None, "", "x", "://", "://a.com", "http://?q", "HTTP://A.COM:80/a", "s://a.com/a?x://b.org/"] + [
        f"http://{rng.choice(['', 'www.', 'z.'])}{rng.choice(hosts)}{rng.choice(paths)}{rng.choice(['', 'q', '/x', '?u=/a', '#/a'])}" for _ in range(300)
    ]
    rows = [(n, u, None) for n, u in enumerate(urls)] + [(5, urls[20], None), (None, urls[30], None)]
    merged = {}
    for verdict, host, path in some:
        merged[host, path] = max(verdict, merged.get((host, path), ""))
    want = []
    for key, url, _ in rows:
        host, path = split(url)
        fit = [(len(h + p), len(h), h + p, v) for (h, p), v in merged.items() if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fit, default=None)
        want.append((key, host, path, best and best[2], best[3] if best else "allow"))
    got = urlfilter.judge(pages(spark, rows), rules(spark, some)).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_no_rules_and_no_pages(spark):
    got = urlfilter.judge(pages(spark, [(1, "http://a.com/", None)]), rules(spark, [])).collect()
    assert [tuple(r) for r in got] == [(1, "a.com", "/", None, "allow")]
    assert urlfilter.judge(pages(spark, []), rules(spark, [("block", "com", "/")])).collect() == []


CAPTURE = f"id string, type string, url string, date timestamp, status int, http {warc.HEADERS}, digest string"


def head(**values):
    return [(k.replace("_", "-"), v) for k, v in values.items()]


def test_revisits_over_many_slices(spark):
    rng = random.Random(9)
    rows = []
    for n in range(400):
        kind = rng.choice(["response", "revisit", "revisit"])
        status = 304 if kind == "revisit" else rng.choice([200, 200, 404])
        tag = rng.choice([None, "t1", "W/t1", "t2"])
        http = ([("etag", tag)] if tag else []) + [("x-own", str(n)), ("cache-control", str(n))]
        url = rng.choice(["hot", "hot", "hot", "b", "c"]) if n % 50 else None
        rows.append((f"r{n:03}", kind, url, rng.randrange(100), status, http, rng.choice(["d1", "d2"])))
    rows.append(rows[1])
    text = ", ".join(f"{k}" for k in ("id", "type", "url", "timestamp_seconds(s) date", "status", "http", "digest"))
    source = spark.createDataFrame(rows, CAPTURE.replace("date timestamp", "s long")).selectExpr(*[c.strip() for c in text.split(",")])
    want = []
    for own, kind, url, s, _, http, digest in rows:
        if kind != "revisit":
            continue
        before = [r for r in rows if r[1] == "response" and 200 <= r[4] <= 299 and r[2] == url and url and r[3] <= s]
        base = max(before, key=lambda r: (r[3], r[0]), default=None)
        outcome, headers = "no_response", None
        if base:
            mine, theirs = (next((v.removeprefix("W/") for k, v in h if k == "etag"), None) for h in (http, base[5]))
            same = mine == theirs if mine and theirs else digest == base[6]
            outcome = "resolved" if same else "validators_differ"
            if same:
                fresh = {k: v for k, v in http if k in warc.PERMITTED}
                headers = sorted([(k, v) for k, v in base[5] if k not in fresh] + list(fresh.items()))
        want.append((own, outcome, base[0] if outcome == "resolved" else None, headers))
    for slices in (1, 7):
        got = warc.resolve(source, slices).collect()
        got = [(r["id"], r["outcome"], r["refers_to"], None if r["headers"] is None else [tuple(h) for h in r["headers"]]) for r in got]
        assert sorted(got, key=repr) == sorted(want, key=repr)


def test_records_that_are_not_whole(spark):
    raw = [None, "", "WARC/1.0", "WARC/1.0\r\nWARC-Type: revisit\r\nWARC-Record-ID: a\r\n\r\n", "WARC/1.0\r\nWARC-Type: warcinfo\r\n\r\nx",
           "WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: b\r\nWARC-Target-URI: http://X.com:80/a/?utm_a=1&z=2#f\r\nWARC-Date: bad\r\n\r\nHTTP/1.1 200 OK\r\nA: b:c\r\n\r\nbody\r\n\r\nmore"]
    frame = spark.createDataFrame([(r, 1) for r in raw], "record string, url int")
    parsed = warc.parse(frame).collect()
    assert len(parsed) == len(raw) and parsed[5]["body"] == "body\r\n\r\nmore" and parsed[5]["status"] == 200 and tuple(parsed[5]["http"][0]) == ("a", "b:c")
    found = {r["id"]: r for r in warc.captures(frame).collect()}
    assert set(found) == {"a", "b"} and found["b"]["url"] == "x.com/a?z=2" and found["b"]["date"] is None
    assert [tuple(r)[:5] for r in warc.resolve(warc.captures(frame)).collect()] == [("a", "", None, "no_response", None)]
    assert warc.resolve(warc.captures(frame.limit(0))).collect() == []


SHELL = (
    '<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body class="with-sidebar"><header>Site</header>'
    '<nav><ul><li><a href="/a">A</a><li><a href="/b">B</a></ul></nav><!-- c --><div class="cookie-notice">Ok?</div><div class="ad">Buy</div>{}'
    '<aside>Side</aside><section id="comments"><article class="comment"><p>Nice</p></article></section><form><input><button>Go</button></form><footer>&copy; x</footer></body></html>'
)


def test_articles_without_what_surrounds_them(spark):
    body = "<article><header><h1>Head &amp; line</h1></header><p>One <b>two</b>\n three<p>Four&nbsp;<a href='x'>five</a><br>six<ul><li>s<li>t</ul>{}<div class='ad'>no</div></article>"
    want = "Head & line\n\nOne two three\n\nFour five six\n\ns\n\nt"
    rows = [(n, f"http://a.com/{n}", SHELL.format(body.format("" if n % 2 else f"<p>{n}</p>"))) for n in range(20)]
    rows += [(30, "http://a.com/cut", rows[0][2][:600]), (31, None, SHELL.format("")), (32, "http://a.com/", None), (33, "http://b.com/", ""), (None, "http://a.com/1", rows[1][2]), (1, "http://a.com/1", rows[1][2]),
             (34, "http://a.com/", "<div>" * 3000 + "deep" + "</div>" * 3000), (35, "http://a.com/", "a < b <p"), (36, "http://c.com", "<article>" + "<p>x y</p>" * 20_000)]
    got = [(r["page_id"], r["text"], r["n_chars"]) for r in htmltext.extract(pages(spark, rows)).collect()]
    assert len(got) == len(rows) and all(len(t) == n for _, t, n in got)
    by_id = {i: t for i, t, _ in got}
    assert by_id[1] == by_id[None] == want and by_id[2] == want + "\n\n2"
    assert by_id[31] == by_id[32] == by_id[33] == "" and by_id[34] == "deep" and by_id[35] == "a < b" and by_id[36].count("x y") == 20_000
    assert (want + "\n\n0").startswith(by_id[30])
    assert htmltext.extract(pages(spark, [])).collect() == []


def test_text_without_a_marked_article(spark):
    body = "<div class='page'><div class='text'><h2>T{0}</h2><p>{1}</p><p>{1}</p></div><div class='links'><p><a href='x'>one link of many</a></p></div></div>"
    rows = [(n, f"http://a.com/{n}", SHELL.format(body.format(n, f"long words {n} " * 20))) for n in range(6)]
    got = {r["page_id"]: r["text"] for r in htmltext.extract(pages(spark, rows)).collect()}
    assert all(got[n] == "\n\n".join([f"T{n}"] + [(f"long words {n} " * 20).strip()] * 2) for n in range(6))


def test_wrappers_have_optional_and_repeated_groups():
    one = htmltext.stream(htmltext.blocks("<div><h1>a</h1><p>b</p><p>c</p></div>"))
    other = htmltext.stream(htmltext.blocks("<div><p>b</p></div><hr><span>x</span>"))
    assert htmltext.expression(htmltext.aligned(one, other)) == "<div>(<h1>(#)? <p>(#)+)"
    assert htmltext.aligned(one, one) == one


def test_text_after_and_in_blocks_nested_deeper_than_recorded(spark):
    deep, out = "<div>" * 70, "</div>" * 70
    page = f"<html><body><div><article><p>first</p>{deep}in<nav>menu</nav>{out}<p>last</p></article></div><p>foot</p></body></html>"
    bare = f"<html><body>{deep}<nav>menu</nav><article><p>main</p></article>aside{out}</body></html>"
    rows = [(1, "http://a.com/1", page), (2, "http://b.com/1", bare)]
    got = {r["page_id"]: r["text"] for r in htmltext.extract(pages(spark, rows)).collect()}
    assert got == {1: "first\n\nin\n\nlast", 2: "main"}
    found = {text: path for path, text, _ in htmltext.blocks(page)}
    assert found["last"] == ("html", "body", "div", "article", "p") and found["foot"] == ("html", "body", "p")


def test_pages_nested_very_deeply_stay_cheap():
    assert len(htmltext.blocks("<p>a<x>" * 100_000 + "<li>b</li>" * 100_000)) == 200_000


def test_fractions_of_seconds_folded_lines_and_many_headers(spark):
    line = "\r\n"

    def record(kind, key, date, status, headers):
        top = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {key}", "WARC-Target-URI: http://a.com/x", f"WARC-Date: {date}"]
        return line.join(top) + line * 2 + line.join([f"HTTP/1.1 {status} S", *headers]) + line * 2 + "body"

    many = [f"X-{k}: {k}" for k in range(12_000)] + ['ETag: "one"']
    raw = [
        record("response", "r1", "2024-01-01T00:00:00.5Z", 200, many),
        record("response", "r2", "2024-01-01T02:00:00.25+01:00", 200, ["ETag:", '\t"two"', "X-Long: a", "  b", "\tc"]),
        record("revisit", "v1", "2024-01-01T00:00:00.123456789Z", 304, ['ETag: "one"']),
        record("revisit", "v2", "2024-01-01T00:00:00.75Z", 304, ['ETag: "one"']),
        record("revisit", "v3", "2024-01-01T01:00:01Z", 304, ['ETag: W/"two"']),
        record("revisit", "v4", "yesterday", 304, ['ETag: "two"']),
    ]
    found = {r["id"]: r for r in warc.resolve(warc.captures(spark.createDataFrame([(t,) for t in raw], "record string"))).collect()}
    assert {k: (r["outcome"], r["refers_to"]) for k, r in found.items()} == {
        "v1": ("no_response", None), "v2": ("resolved", "r1"), "v3": ("resolved", "r2"), "v4": ("no_response", None)
    }
    assert len(found["v2"]["headers"]) == 12_001
    assert ("x-long", "a b c") in [tuple(h) for h in found["v3"]["headers"]]


def made_site(rng, host, count, marked, order=1):
    """Pages of one host with template texts under names that tell nothing, and the text each should give."""
    fixed = {"w1": "Kaufen Sie jetzt zwei zum Preis von einem", "w2": "Start Kontakt Impressum", "w3": "Alle Rechte bei uns"}
    rows = []
    for n in range(count):
        parts = [" ".join(f"x{rng.randrange(10_000)}" for _ in range(rng.randrange(25, 60))) for _ in range(rng.randrange(1, 6))]
        inner = "".join(f"<p>{p}</p>" + f"<div class=w1><b>{fixed['w1']}</b></div>" * (k == 0) for k, p in enumerate(parts))
        article = f"<article>{inner}</article>" if marked else f"<div class=k7><div class=z>{inner}</div></div>"
        here = "".join(f"<li>{w}</li>" for w in rng.sample(["Alpha", "Beta", "Gamma"], 2)) if n % 2 else ""
        page = f"<html><body><div class=w2>{fixed['w2']}</div><div class=q>{here}</div>{article}<div class=w3>{fixed['w3']}</div></body></html>"
        rows.append((order * 1000 + n, f"http://{host}/{n}", page, "\n\n".join(parts)))
    return rows


def test_texts_that_most_pages_of_a_host_share_are_template(spark, monkeypatch):
    # The names of classes decide nothing here.
    for words in ("DROPPED_NAMES", "REACTIONS", "OUTER_ONLY"):
        monkeypatch.setattr(htmltext, words, frozenset())
    htmltext.label.cache_clear()
    rng = random.Random(21)
    sites = [made_site(rng, "a.de", 9, True, 1), made_site(rng, "b.de", 5, False, 2), made_site(rng, "c.de", 30, True, 3)]
    rows = [r[:3] for site in sites for r in site]
    copies = [(9000 + k, "http://c.de/copy", sites[2][0][2]) for k in range(200)]
    got = {r["page_id"]: r["text"] for r in htmltext.extract(pages(spark, rows + copies)).collect()}
    htmltext.label.cache_clear()
    for site in sites:
        for key, _, _, text in site:
            assert got[key] == text
    # Copies of one page are no template.
    assert all(got[9000 + k] == sites[2][0][3] for k in range(200))


def test_constants_equal_counting_by_hand(spark):
    rng = random.Random(22)
    rows = [(rng.choice(["a", "b", None]), sorted(rng.sample(range(12), rng.randrange(0, 7)))) for _ in range(120)] + [("small", [1, 2])] * 9 + [("four", [1, k]) for k in range(4)]
    found = {r["host"]: r["constants"] for r in htmltext.constants(spark.createDataFrame(rows, "host string, hashes array<bigint>")).collect()}
    want = {}
    for host in {h for h, _ in rows}:
        different = {tuple(x) for h, x in rows if h == host}
        often = [k for k in range(12) if sum(k in x for x in different) > 0.5 * len(different)]
        if len(different) >= 5 and often:
            want[host] = often
    assert found == want
