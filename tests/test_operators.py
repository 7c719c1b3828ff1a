"""Operators on small tables written by hand, with nulls, empty texts, ties and empty tables."""

import datetime as dt

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sightline.functions import addresses
from sightline.functions import text as tx
from sightline.functions import urls as ux
from sightline.operators import claims, content, drift, markets, markup, pages, rules, scores, series, sites
from sightline.sources import shared, vendors
from sightline.streaming import windows


def one(spark, value, expr, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(expr(F.col("v")).alias("x")).first().x


def many(spark, values, expr):
    rows = spark.createDataFrame(list(enumerate(values)), "i int, v string").select("i", expr(F.col("v")).alias("x")).collect()
    return [r.x for r in sorted(rows, key=lambda r: r.i)]


def test_normalized_urls(spark):
    urls = ["HTTP://Example.com:80/a/?b=2&a=1&utm_source=x#f", "https://example.com:443/", "example.com/a//", "https://e.com/?utm_term=1", "not a url", None]
    assert many(spark, urls, ux.normalized) == ["http://example.com/a?a=1&b=2", "https://example.com/", "https://example.com/a", "https://e.com/", "https://not a url/", None]
    twice = many(spark, many(spark, urls, ux.normalized), ux.normalized)
    assert twice == many(spark, urls, ux.normalized)


def test_url_parts(spark):
    assert many(spark, ["https://a.example/x/y", "https://a.example", "https://a.example//b"], ux.section) == ["/x/", "/", "/b/"]
    assert many(spark, ["www.b.a.example", "a.example"], ux.reversed_host) == ["example.a.b", "example.a"]
    assert many(spark, [" http://WWW.A.example/x ", "a.example"], ux.domain) == ["www.a.example", "a.example"]
    assert one(spark, "a b*~/", ux.encoded) == "a%20b%2A~%2F"
    assert many(spark, ["192.168.1.1", "8.8.8.8", "256.1.1.1", "x", "1234.1.1.1"], addresses.ipv4) == [3232235777, 134744072, None, None, None]


@settings(max_examples=15, deadline=None)
@given(texts=st.lists(st.text(alphabet="ab -'.\n1é", max_size=40), min_size=1, max_size=8))
def test_token_measures(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    for r in content.quality(rows).collect():
        assert 0 <= r.overall <= 100 and 0 <= r.density <= 1 and r.unique_tokens <= r.n_tokens
    for r in content.citability(rows).collect():
        assert 0 <= r.total <= 100 and r.word_count == len([w for w in texts[r.i].split() if w])


def test_quality_of_padded_prose(spark):
    text = "It's important to note that we delve into the rich tapestry of ideas. Moreover, at the end of the day it is a testament to progress."
    r = content.quality(spark.createDataFrame([(text,), (None,), ("  ",)], "text string")).collect()
    assert r[0].filler == 50 and r[0].generated == 75 and "ai-patterns" in r[0].flags and not r[0].passed
    assert r[1].flags == ["empty-input"] and r[2].overall == 0


def test_citability_of_a_good_passage(spark):
    good = "A widget is a small tool that people use. According to Gartner, 45% of companies saved $3 million in 2024. " + " ".join("Teams using Widgets report clear results across every Market they serve today." for _ in range(9)) + "\nFirst, we found that 30 companies agreed. For example, step 2 matters."
    rows = spark.createDataFrame([(1, "What is a widget?", good), (2, None, "It was this."), (3, None, None)], "i int, h string, text string")
    got = {r.i: r for r in content.citability(rows, "text", "h").collect()}
    assert got[1].total >= 65 and got[1].grade in "AB"
    assert got[2].total < 50 and got[3].word_count == 0


def test_outline_and_links(spark):
    html = '<title>A &amp; B</title><script>var a="<p>"</script><h1>Top <b>x</b></h1><p>one two<a href="/x">In</a><a href="#t">t</a><a href="http://b.example/">Out</a><!-- hidden words -->'
    rows = spark.createDataFrame([(1, "http://a.example/p", html), (2, "http://a.example/q", None)], "page_id long, url string, html string")
    got = {r.page_id: r for r in pages.outline(rows).collect()}
    assert got[1].h1 == "Top x" and got[1].links == 3 and got[1].words == 9
    assert got[2].title is None and got[2].words == 0
    links = {(r.target, r.is_internal) for r in pages.links(rows).collect()}
    assert links == {("http://a.example/x", True), ("http://b.example/", False)}


def test_section_risk_levels(spark):
    rows = [("http://a.example/ads/1", "Sponsored by X"), ("http://a.example/shop/1", "Buy now! Shop now!"), ("http://a.example/ok/1", "nothing"), ("http://a.example/ok/2", None)]
    got = {r.section: r for r in pages.section_risk(spark.createDataFrame(rows, "url string, html string")).collect()}
    assert (got["/ads/"].risk, got["/shop/"].risk, got["/ok/"].risk) == ("high", "medium", "low")
    assert got["/shop/"].flags == ["commercial-intent-skew", "commercial-intent-drift"]


def test_markup_walk(spark):
    html = '<html><head><title>T</title><meta name="Robots" content="noindex"><link rel="canonical" href="/c"><link rel="alternate" hreflang="de" href="/de"></head><body><p>one two three four five six<h2>Next</h2><ul><li>a b c<li>d e f</ul><img src="a.png" alt=""><img src="b.png">'
    rows = spark.createDataFrame([("u", html), ("v", None)], "url string, html string")
    got = [(r.kind, r.name, r.value, dict(r.extra)) for r in markup.elements(rows).orderBy("pos").collect()]
    assert ("meta", "robots", "noindex", {}) in got and ("link", "alternate", "/de", {"hreflang": "de"}) in got
    assert [e for k, _, _, e in got if k == "image"] == [{"alt": ""}, {}]
    blocks = [(r.heading, r.word_count) for r in markup.blocks(rows, 3).orderBy("pos").collect()]
    assert blocks == [("Introduction", 6), ("Next", 6)]


def test_similarity_of_headings():
    assert drift.ratio("", "") == 1 and drift.ratio("abc", "abc") == 1 and drift.ratio("abc", "xyz") == 0
    assert drift.ratio("abcd", "bcde") == 0.75


def test_latest_and_history(spark):
    rows = spark.createDataFrame([(i, f"h{i % 2}") for i in range(9)], "id long, url_hash string")
    assert sorted(r.id for r in drift.latest(rows).collect()) == [7, 8]
    assert drift.history(rows, 2).count() == 4


def test_merchant_and_backlink_rules(spark):
    block = '{"@type":"Product","name":"n","image":"i","sku":"1","offers":[{"price":1,"priceCurrency":"EUR","availability":"https://schema.org/Nowhere"},{}]}'
    got = {(r.path, r.issue) for r in rules.merchant_issues(spark.createDataFrame([("u", 0, block), ("v", 0, '{"@type":"Person"}')], "url string, pos int, json string")).collect()}
    assert ("product 0 offer 0", "availability value") in got and ("product 0 offer 1", "price") in got and ("product 0", "name") not in got
    rows = [(0, "http://s", "http://t", True, True, True, ["nofollow"]), (1, "http://s", None, None, None, None, None)]
    found = {(r.row, r.issue) for r in rules.backlink_report(spark.createDataFrame(rows, "row int, source string, target string, link_found boolean, verified boolean, followed boolean, rel array<string>")).collect()}
    assert found == {(0, "followed and nofollow"), (0, "duplicate source"), (1, "target"), (1, "verified"), (1, "duplicate source")}
    links = spark.createDataFrame([("p", "http://www.t.example/", ["nofollow"]), ("q", "http://t.example/x", None), ("r", "http://u.example/", None)], "page_url string, href string, rel array<string>")
    assert {r.page_url: (r.found, r.followed) for r in rules.link_status(links, "t.example").collect()} == {"p": (1, False), "q": (1, True), "r": (0, False)}


def test_series(spark):
    pts = spark.createDataFrame([("a", 1, 10.0), ("a", 2, None), ("a", 3, 12.0), ("b", 1, 0.0), ("b", 2, 1.0), ("c", 1, None)], "k string, t int, v double")
    got = {r.k: (r.change_pct, r.direction) for r in series.trend(pts, ["k"], "t", "v").collect()}
    assert got == {"a": (20.0, "worse"), "b": (None, None)}
    pts = spark.createDataFrame([("a", 1, 3000.0), ("a", 2, 2999.0), ("b", 1, 2999.0), ("b", 2, 3000.0), ("c", 1, -5.0)], "k string, t int, v double")
    assert {r.k: str(r.change_pct) for r in series.trend(pts, ["k"], "t", "v").collect()} == {"a": "-0.0", "b": "0.0", "c": "-0.0"}  # as SQL rounds
    assert many(spark, ["5", "1", "0", "-3", "-9"], lambda c: series.trend_band(c.cast("double"))) == ["strong growth", "growth", "stable", "decline", "strong decline"]


def test_trend_from_zero_as_in_sql(spark, tmp_path):
    import duckdb

    from sightline import registry
    from sightline.plans import catalog  # noqa: F401

    ends = [(0.0, 1.0), (0.0, -1.0), (0.0, 0.0), (0.0, None), (-0.0, 1.0), (-0.0, -1.0), (-0.0, 0.0), (0.0, "nan"), (-0.0, "nan"), (0.0, "inf"), ("inf", 0.0), ("nan", 0.0), (2.0, "nan"), (2.0, "inf"), (2.0, 0.0), (2.0, 2.1), (2.0, 2.2), (None, 0.0)]
    with duckdb.connect() as c:
        c.execute("create table events (event_id bigint, ts timestamp, user_id bigint, event_type varchar, value double, props varchar)")
        c.executemany("insert into events values (?, timestamp '2024-01-01' + ? * interval 1 hour, ?, 'view', ?, '{}')", [(2 * i + j, j, i, v) for i, pair in enumerate(ends) for j, v in enumerate(pair)])
        c.execute(f"copy events to '{tmp_path}/events.parquet' (format parquet)")
        want = c.execute(registry.ORACLE_SQL["metric_trend"])
        order = [d[0] for d in want.description]
        want = sorted(map(repr, want.fetchall()))
    assert sorted(repr(tuple(r)) for r in registry.QUERIES["metric_trend"](spark, str(tmp_path)).select(*order).collect()) == want


def test_sites(spark):
    files = spark.createDataFrame([("a", "Sitemap: x\nUser-agent: A\n\nUser-agent: b\nDisallow: /p # c\nUser-agent: C\nAllow: /")], "site string, text string")
    got = sorted((r.agent, r.directive, r.path) for r in sites.robots_rules(files).collect())
    assert got == [("a", "disallow", "/p"), ("b", "disallow", "/p"), ("c", "allow", "/")]
    kinds = spark.createDataFrame([("i", "<sitemapindex>"), ("u", "<urlset>"), ("h", "<!DOCTYPE html>"), ("t", "https://a\n"), ("n", None)], "site string, text string")
    assert {r.site: r.kind for r in sites.sitemap_kind(kinds).collect()} == {"i": "index", "u": "urlset", "h": "refused", "t": "text", "n": "unknown"}
    edges = spark.createDataFrame([("r", "a"), ("a", "b"), ("b", "r"), ("x", "y")], "parent string, child string")
    assert {r.node: r.depth for r in sites.sitemap_crawl(edges, spark.createDataFrame([("r",)], "node string")).collect()} == {"r": 0, "a": 1, "b": 2}
    text = sites.llms_text(spark.createDataFrame([("a", "Docs", "T", "u"), ("a", "Blog", "B", "v")], "site string, section string, title string, url string")).first().text
    assert text == "## Blog\n- [B](v)\n\n## Docs\n- [T](u)"
    assert sites.llms_report(spark.createDataFrame([("a", "# T\n> d\n\n" + text), ("b", None)], "site string, text string")).orderBy("site").collect()[0].format_valid


def test_markets(spark):
    pairs = spark.createDataFrame([(1, 2), (2, 3), (7, 9)], "a long, b long")
    assert {r.node: r.cluster for r in markets.clusters(pairs).collect()} == {1: 1, 2: 1, 3: 1, 7: 7, 9: 7}
    serp = spark.createDataFrame([("k1", "w"), ("k2", "w"), ("k1", "x")], "k string, d string")
    assert [r.d for r in markets.without_ubiquitous(serp, "k", "d", 1).collect()] == ["x"]
    ranks = spark.createDataFrame([("p", "NE", 1), ("p", "SW", None), ("p", "NE", 5)], "place string, quadrant string, rank int")
    r = markets.share_of_local_voice(ranks).first()
    assert (r.solv, r.average_rank, r.absent, r.worst_quadrant) == (33.3, 3.0, 1, "SW")
    kinds = spark.createDataFrame([("Best Boots",), ("best boots now",), ("Acme",), ("http://x",), (None,)], "anchor string")
    assert {r.kind: r.share for r in markets.anchors(kinds, "acme", "best boots").collect()} == {"exact": 0.2, "partial": 0.2, "brand": 0.2, "url": 0.2, "generic": 0.2}
    calls = spark.createDataFrame([("a", 3), ("b", 1)], "endpoint string, n int")
    assert {r.endpoint: r.tier for r in markets.estimate(calls, spark.createDataFrame([("a", 0.1)], "endpoint string, unit_cost double")).collect()} == {"a": "confirm", "b": "unknown"}


def test_sources(spark, tmp_path):
    (tmp_path / "urls.txt").write_text("# c\n\n https://a \nhttps://b\n")
    assert [r.url for r in shared.url_list(spark, str(tmp_path / "urls.txt")).collect()] == ["https://a", "https://b"]
    (tmp_path / "env.json").write_text('{"status_code": 1, "tasks": [{"cost": 0.5, "result": [{"items": [{"kw": "a", "v": 1}, {"kw": "b", "v": 2}]}, {"kw": "c", "v": 3}]}]}')
    got = shared.vendor_items(spark, str(tmp_path / "env.json"), "struct<kw: string, v: int>").collect()
    assert [(r.kw, r.v, r.cost) for r in got] == [("a", 1, 0.5), ("b", 2, 0.5), ("c", 3, 0.5)]
    (tmp_path / "img").mkdir()
    for n in ("a.png", "a.png.xmp", "b.jpg"):
        (tmp_path / "img" / n).write_bytes(b"x")
    assert sorted((r.path[-5:], r.has_sidecar) for r in shared.sidecars(spark, str(tmp_path / "img")).collect()) == [("a.png"[-5:], True), ("b.jpg"[-5:], False)]
    bodies = spark.createDataFrame([(bytearray("é".encode("latin1")), "text/html; charset=ISO-8859-1"), (bytearray("é".encode()), None), (bytearray(b"\xef\xbb\xbfa"), None), (None, None)], "body binary, content_type string")
    assert [r.text for r in shared.decoded(bodies).collect()] == ["é", "é", "a", None]


def test_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").orderBy("ts").coalesce(1)
    events.write.parquet(str(tmp_path / "in"))
    stream = windows.replay(spark, str(tmp_path / "in"))
    q = windows.counts(stream, "1 hour").writeStream.format("memory").queryName("hours").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    batch = windows.counts(events.withColumn("ts", F.col("ts").cast("timestamp")), "1 hour")
    rows = lambda df: sorted((r.start, r.event_type, r.n) for r in df.collect())
    assert rows(spark.table("hours")) == rows(batch)


def test_after_updates(spark):
    days = spark.createDataFrame([(dt.date(2024, 1, d), float(d < 10) + 1) for d in range(1, 20)], "day date, value double")
    got = series.after_updates(days, spark.createDataFrame([("u", dt.date(2024, 1, 10))], "name string, date date")).first()
    assert (got.before, got.after, got.change_pct) == (2.0, 1.0, -50.0)


def test_rounding_and_text(spark):
    assert many(spark, ["2.5", "-2.5", "0.125"], lambda c: tx.half_up(c.cast("double"))) == [3.0, -3.0, 0.0]
    assert many(spark, ["a<b>&\"", None], tx.escaped) == ["a&lt;b&gt;&amp;&quot;", None]
    assert many(spark, ["a_b c-d é1", "", None], tx.word_count) == [4, 0, 0]


def test_claims_and_citations(spark):
    far = "x " * 250
    texts = {1: f"Sales rose 45% of users [1]. {far} It cost $3 million in 2019.", 2: '<style>a{width:93%}</style> <a href="%E5%93%81">2,000 people</a> twice as good', 3: None, 4: "商 50 % 商"}
    rows = spark.createDataFrame(list(texts.items()), "doc_id int, text string")
    got = [(r.doc_id, r.kind, r.claim, r.citation is not None) for r in claims.claims(rows).orderBy("doc_id", "position").collect()]
    assert got == [(1, "statistic", "45% of users", True), (1, "quantity", "$3 million", False), (1, "temporal", "in 2019", False), (2, "quantity", "2,000 people", False), (2, "comparative", "twice as good", False), (4, "statistic", "50 %", False)]
    assert all(len(claims.prose_only(t)) == len(t) for t in texts.values() if t)
    per = {r.doc_id: (r.claims, r.uncited_ratio, r.passed) for r in claims.verified(rows).collect()}
    assert per == {1: (3, 0.667, False), 2: (2, 1.0, False), 3: (0, 0.0, True), 4: (1, 1.0, False)}


def test_plainer_wording(spark):
    rows = spark.createDataFrame([("Delve into this rich tapestry. Moreover, it's worth noting that we delve into X .", 1), (None, 2), ("plain  text", 3)], "text string, n int")
    got = {r.n: (r.cleaned, r.changes) for r in claims.plainer(rows).collect()}
    assert got == {1: ("Explore this range. note: we explore X.", 5), 2: ("", 0), 3: ("plain text", 0)}


def test_scores(spark):
    f = [("a", k, 80.0, 1.0) for k in ("domains", "anchors", "toxic")] + [("a", "follow", 20.0, 0.5), ("b", "domains", 90.0, 1.0)]
    got = {r.site: (r.factors, r.score, r.state) for r in scores.link_health(spark.createDataFrame(f, "site string, factor string, score double, confidence double")).collect()}
    assert got == {"a": (4, 77.4, "scored"), "b": (1, None, "insufficient data")}
    page = [("red boots", "Red Boots", "Our RED BOOTS", "https://a/red-boots", None, "About red boots.", ["red boots"]), ("x", None, None, None, None, None, None)]
    assert [r.placed for r in scores.placement(spark.createDataFrame(page, "keyword string, title string, h1 string, url string, description string, body string, alts array<string>")).collect()] == [5, 0]
    day = dt.date
    rows = [("p", "en", 3, 1, 100, True, True, day(2024, 3, 1)), ("p", "de", 4, 1, 130, True, False, day(2024, 2, 10))]
    pages_ = spark.createDataFrame(rows, "page string, lang string, sections int, images int, words int, titled boolean, described boolean, updated date")
    got = {r.lang: (r.exists, r.score, r.freshness, r.length_ok) for r in scores.parity(pages_, spark.createDataFrame([("en",), ("de",), ("fr",)], "lang string")).collect()}
    assert got == {"de": (True, 80, "aging", True), "fr": (False, 0, None, None)}
    r = scores.personas(spark.createDataFrame([("p", "a", 3, 20, 20, 20, 20), ("p", "b", 1, 10, 10, 10, 10)], "page string, persona string, volume int, relevance int, clarity int, trust int, action int")).first()
    assert (r.score, r.weakest, r.weakest_score) == (70.0, "b", 40)
    assert scores.crawler_score(spark.createDataFrame([("a", 5, 5, False, True, True)], "site string, tier1 int, tier2 int, blanket_block boolean, llms_file boolean, sitemap_file boolean")).first().score == 100


def test_reviews_wins_and_sitemaps(spark):
    t = dt.datetime(2024, 1, 1, 10)
    rows = [("p", i, t, 5, 1, "Great place") for i in range(3)] + [("p", 9, dt.datetime(2024, 2, 1), 3, 50, "ok")]
    got = {r.review_id: (r.signals, r.suspicious) for r in scores.review_flags(spark.createDataFrame(rows, "place string, review_id int, ts timestamp, rating int, author_reviews int, text string")).collect()}
    assert got == {0: (3, True), 1: (3, True), 2: (3, True), 9: (0, False)}
    wins = spark.createDataFrame([("a", 1.0, 100.0, 5.0), ("b", 1.0, 10.0, 5.0), ("c", 1.0, 200.0, 1.0), ("d", 0.0, 1.0, 20.0)], "query string, clicks double, impressions double, position double")
    assert [r.query for r in scores.quick_wins(wins).collect()] == ["a"]
    entries = spark.createDataFrame([("s", "http://a", "d"), ("s", "https://b", "d")], "sitemap string, loc string, lastmod string")
    facts = spark.createDataFrame([("http://a", 404, False, False), ("https://b", 200, True, False)], "loc string, status int, noindex boolean, redirected boolean")
    assert {r.issue for r in scores.sitemap_quality(entries, facts).collect()} == {"not 200", "noindexed", "not https", "identical lastmod"}


def test_vendor_payloads(spark):
    one_row = lambda c, text: spark.createDataFrame([("k", text), ("bad", "{")], f"{c} string, payload string")
    lab = '{"lighthouseResult":{"categories":{"performance":{"score":0.905},"best-practices":{"score":1}},"audits":{"speed-index":{"numericValue":12.5},"a":{"title":"A","details":{"type":"opportunity","overallSavingsMs":10}},"b":{"title":"B","details":{"type":"opportunity","overallSavingsMs":20}},"c":{"details":{"type":"table"}}}}}'
    r = {x.url: x for x in vendors.lab_audit(one_row("url", lab)).collect()}
    assert (r["k"].performance, r["k"].best_practices, r["k"].speed_index_ms, [o.id for o in r["k"].opportunities]) == (91.0, 100.0, 12.5, ["b", "a"])
    assert r["bad"].performance is None
    field = '{"record":{"metrics":{"lcp":{"percentiles":{"p75":2100},"percentilesTimeseries":{"p75s":[1,null,"0.5"]}}}}}'
    assert [(x.metric, x.p75) for x in vendors.field_metrics(one_row("url", field)).collect()] == [("lcp", 2100.0)]
    assert [x.p75 for x in vendors.field_history(one_row("url", field)).orderBy("period").collect()] == [1.0, None, 0.5]
    search = '{"rows":[{"keys":["q","p"],"clicks":1,"impressions":2,"ctr":0.5,"position":3}]}'
    assert [(x["query"], x.page, x.clicks) for x in vendors.search_rows(one_row("property", search), ["query", "page"]).collect()] == [("q", "p", 1.0)]
    report = '{"rows":[{"dimensionValues":[{"value":"d"}],"metricValues":[{"value":"7"}]}]}'
    assert [(x.day, x.users) for x in vendors.report_rows(one_row("property", report), ["day"], ["users"]).collect()] == [("d", 7.0)]
    nlp = '{"entities":[{"name":"a","type":"T","salience":0.1,"mentions":[{}]},{"name":"b","type":"T","salience":0.9,"mentions":[{},{}]}]}'
    assert [(x["name"], x.mentions) for x in vendors.entities(one_row("id", nlp)).orderBy("rank").collect()] == [("b", 2), ("a", 1)]
    who = spark.createDataFrame([("a", "Domain: a\nCreation Date: 2001-02-03T00:00:00Z\nRegistrar: R Inc\n"), ("b", "created: 03-Feb-2001\n"), ("c", None)], "domain string, text string")
    assert {x.domain: (str(x.created), x.registrar) for x in vendors.whois(who).collect()} == {"a": ("2001-02-03", "R Inc"), "b": ("2001-02-03", None), "c": ("None", None)}


def test_links_resolve_like_a_browser(spark):
    html = """<nav><a href="b.html"><b>bold</b> text</a></nav><a class=x href='../c'>one</a><a href=?q=1>two</a><a data-href="no" href="/d/./e/../f#t">three<a href="//o.org/x">four</a>
      <a href="#top">no</a><a href="JavaScript:x()">no</a><a name="n">no</a><a href="mailto:a@b.c">five</a>"""
    rows = pages.links(spark.createDataFrame([(1, "http://S.org/x/y/z.html?p=2", html), (2, "http://s.org", '<a href="b">u</a>'), (3, "http://s.org", None)], "page_id long, url string, html string")).collect()
    assert [(r.anchor, r.target) for r in rows if r.page_id == 1] == [("bold text", "http://s.org/x/y/b.html"), ("one", "http://s.org/x/c"), ("two", "http://s.org/x/y/z.html?q=1"), ("three", "http://s.org/d/f#t"), ("four", "http://o.org/x"), ("five", "mailto:a@b.c")]
    assert [r.target for r in rows if r.page_id != 1] == ["http://s.org/b"]


def test_blocks_and_words_leave_out_what_surrounds_content(spark):
    around = "menu words " * 30
    html = f"<header><h2>Site</h2><p>{around}</p></header><nav><ul><li>{around}</li></ul></nav><h2>Head</h2><p>{'real words here ' * 10}</p><form><p>{around}</p></form><aside><p>{around}</p></aside><footer><p>{around}</p></footer>"
    table = spark.createDataFrame([("u", html), ("v", f"<nav><p>{around}</p></nav>"), ("w", None)], "url string, html string")
    assert [(r.url, r.heading, r.word_count) for r in markup.blocks(table).collect()] == [("u", "Head", 30)]
    words = {r.url: r.n for r in table.select("url", tx.word_count(pages.visible(F.col("html"))).alias("n")).collect()}
    assert words["v"] == 0 and words["w"] == 0 and words["u"] == 1 + 30 + 120


def test_llms_report_reads_lines(spark):
    rows = [("a", "intro\n# late title\n> d\n## S\n- [t](u)"), ("b", "# T\n\n> d\n## S\nsee [t](u)"), ("c", "")]
    got = {r.site: r for r in sites.llms_report(spark.createDataFrame(rows, "site string, text string")).collect()}
    assert not got["a"].has_title and got["a"].links == 1 and not got["a"].format_valid
    assert got["b"].has_title and got["b"].links == 0 and got["b"].issues == ["no link in a list"]
    assert len(got["c"].issues) == 4 and got["c"].exists


def test_claims_own_their_characters_and_windows_are_bytes(spark):
    text = "About 40% of all users agree, in 2021. <style>p{width:100%}</style><script>5 % x"
    assert [(text[s:e], k) for s, e, k in claims.found_in(claims.prose_only(text))] == [("40% of all users agree", "statistic"), ("in 2021", "temporal")]
    wide = "é" * 120
    assert claims.cited_near(f"[1] {wide} 40%", len(f"[1] {wide} ")) is None  # 241 bytes before, 125 characters
    assert claims.cited_near(f"[1] {wide[:90]} 40%", len(f"[1] {wide[:90]} ")) == "[1]"


def test_audit_functions_at_their_edges(spark):
    from sightline.operators import audits

    images = [({"loading": "Lazy", "data-src": "x"}, "native"), ({"class": "a lazyload-eio lazy"}, "ewww"), ({"data-src": ""}, "none"), ({"class": "perfmatters-lazy", "data-eio": "1"}, "perfmatters"), ({"data-srcset": "a"}, "js-generic"), ({}, "none"), (None, "none")]
    got = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(images)], "i int, a map<string,string>").select("i", audits.lazy_method(F.col("a")).alias("m"), audits.security_headers(F.col("a")).alias("h")).orderBy("i").collect()
    assert [r.m for r in got] == [m for _, m in images]
    assert all(set(r.h) == set(audits.SECURITY_HEADERS) and set(r.h.values()) == {None} for r in got)
    heads = ["ab", " 12,000+ ", "1.5 %", "1st", "Four", "12 x", "- - - -", None]
    got = spark.createDataFrame([(i, h) for i, h in enumerate(heads)], "i int, h string").select("i", audits.suspicious(F.col("h")).alias("s")).orderBy("i").collect()
    assert [r.s for r in got] == [True, True, True, True, False, False, False, None]
    one = spark.createDataFrame([(None, None), ("# A b \n# c\n 7/100", "Home – x"), ("x# y\n107/1000 a8/100", "- z")], "md string, t string")
    got = one.select(audits.first_heading(F.col("md")).alias("h"), audits.report_score(F.col("md")).alias("s"), audits.site_name(F.col("t"), F.lit("host")).alias("n"), audits.geo_target(F.col("t")).alias("g")).collect()
    assert [(r.h, r.s, r.n) for r in got] == [(None, None, "host"), ("A b", 7, "Home – x"), (None, None, "host")]
    assert {r.g for r in got} == {"geoTargetConstants/2840"}
    row = spark.range(1).select(audits.redacted(F.lit("a?key=1&b=2&key=3 AIzaXy-_0.")).alias("r"), audits.humanized(F.lit("first-seen_at")).alias("k"), audits.section_of(F.lit("/help/products")).alias("s")).first()
    assert (row.r, row.k, row.s) == ("a?key=REDACTED&b=2&key=REDACTED GOOGLE_API_KEY_REDACTED.", "First seen at", "Products & Services")


def test_preload_and_landmarks_of_empty_and_odd_pages(spark):
    from sightline.operators import audits

    rows = [(1, None, None), (2, "<script type='speculationrules'>{broken</script><h1> <b></b></h1><!-- <nav> --><DIV ROLE=search></DIV><video fetchpriority='HIGH'>", {"cache-control": "no-store"}), (2, "", {})]
    pages = spark.createDataFrame(rows, "page_id long, html string, headers map<string,string>")
    got = audits.preload_audit(pages).orderBy("score").collect()
    assert [r.score for r in got] == [50, 50, 75] and got[2].rule_blocks == 1 and got[2].actions == [] and got[2].advice == ["kept for the way back"]
    outline = audits.landmark_outline(pages).orderBy("page_id", F.size("landmarks").desc()).collect()
    assert [(r.landmarks, r.h1s, r.issues) for r in outline] == [([], 0, ["no main landmark", "no H1"]), (["role=search"], 0, ["no main landmark", "no H1"]), ([], 0, ["no main landmark", "no H1"])]
    assert audits.preload_audit(pages.limit(0)).count() == 0
    events = spark.createDataFrame([(1, 1, None), (1, 2, None), (1, 3, "a"), (1, 4, "a"), (1, 5, None), (2, 1, "a")], "u int, t int, v string")
    assert sorted((r.u, r.t) for r in audits.without_adjacent_repeats(events, ["u"], ["t"], "v").collect()) == [(1, 1), (1, 3), (1, 5), (2, 1)]


def test_framework_roots_intents_and_radius(spark):
    import math

    from sightline.operators import audits

    pages = spark.createDataFrame([(1, "https://a.example/", '<div id="Root"><p>' + "x" * 60 + "</p></div><p id=app-x></b><br> y </p>"), (2, "https://a.example/b", None), (3, "https://a.example/c", "<div id=__next>")], "page_id long, url string, html string")
    assert sorted((r.url, r.pos, r.id, r.characters) for r in markup.framework_roots(pages).collect()) == [("https://a.example/", 0, "root", 60), ("https://a.example/", 1, "app-x", 1), ("https://a.example/c", 0, "__next", 0)]
    got = audits.agent_readability(pages).orderBy("page_id").collect()
    assert [r.client_only for r in got] == [True, False, True] and got[1].score == 10 and got[1].words == 0 and audits.agent_readability(pages.limit(0)).count() == 0
    words = spark.createDataFrame([("Log in, LOGIN to buy",), ("price-list",), ("topology",), (None,)], "k string").select(audits.intent(F.col("k")).alias("i")).collect()
    assert [r.i for r in words] == ["navigational", "transactional", None, None]
    spots = [(i, (i * 37 % 100) * 0.4 - 20, (i * 61 % 100) * 0.5 - 25) for i in range(60)] + [(99, 85.0, 1.0), (98, None, 2.0)]
    a = spark.createDataFrame(spots, "place int, lat double, lng double")
    b = a.withColumnRenamed("place", "other")

    def km(p, q):
        x = math.sin(math.radians(q[1] - p[1]) / 2) ** 2 + math.cos(math.radians(p[1])) * math.cos(math.radians(q[1])) * math.sin(math.radians(q[2] - p[2]) / 2) ** 2
        return 2 * 6371.0 * math.asin(math.sqrt(x))

    want = {(p[0], q[0]) for p in spots[:60] for q in spots[:60] if km(p, q) <= 800}
    assert len(want) > 60 and {(r.place, r.other) for r in audits.within_radius(a, b, 800.0).collect()} == want


def test_huge_tags_and_open_links_cost_no_stack(spark):
    """100,000 tags after a link that isn't closed, a tag of a megabyte, and one of 100,000 quoted values."""
    from sightline.operators import audits

    links = "<a href=y>" + "<b>x</b>" * 100_000
    rows = [(1, links), (2, "<div " + "z" * 1_000_000 + " role=main>t</div>" + links * 2), (3, "<div " + 'z="q>" ' * 100_000 + "role=navigation>t</div><a href='q'>A<i>b</i></A><a href=\"r\">c<"), (4, None)]
    pages = spark.createDataFrame([(i, "https://a.example/", h) for i, h in rows], "page_id long, url string, html string")
    from sightline.operators import pages as pg

    got = sorted((r.page_id, r.pos, r.href, r.anchor[:5], r.target) for r in pg.links(pages).collect())
    assert got == [(1, 0, "y", "x x x", "https://a.example/y"), (2, 0, "y", "x x x", "https://a.example/y"), (2, 1, "y", "x x x", "https://a.example/y"), (3, 0, "q", "A b", "https://a.example/q"), (3, 1, "r", "c", "https://a.example/r")]
    assert {r.page_id: r.links for r in pg.outline(pages).collect()} == {1: 1, 2: 2, 3: 2, 4: 0}
    assert {r.page_id: r.landmarks for r in audits.landmark_outline(pages).collect()} == {1: [], 2: ["role=main"], 3: ["role=navigation"], 4: []}


def test_structured_data_that_is_no_json_does_not_count(spark):
    from sightline.operators import audits

    page = lambda body: f"<SCRIPT id=x TYPE='application/ld+json'>{body}</script>"
    rows = [(1, page("{not json")), (2, page('{"a": 1}')), (3, page("{") + page(" [] ")), (4, "<script>{}</script>")]
    pages = spark.createDataFrame([(i, "https://a.example/", h) for i, h in rows], "page_id long, url string, html string")
    assert {r.page_id: "structured-data" in r.failed for r in audits.agent_readability(pages).collect()} == {1: True, 2: False, 3: False, 4: True}


def test_link_months_of_odd_links(spark):
    """Silent months, more lost than half, endings that are null, links without site or date, lost before found, beyond the end."""
    day = lambda t: None if t is None else dt.date.fromisoformat(t)
    rows = [("a", "2024-01-05", "2024-02-01", "com"), ("a", "2024-01-31", None, "com"), ("a", "2024-06-10", "2024-05-01", "net"), ("a", "2024-06-11", "2025-01-01", None), ("a", "2025-03-01", None, "com"), ("b", "2024-06-30", None, None), (None, "2024-01-01", None, "com"), ("c", None, "2024-01-01", "com")]
    links = spark.createDataFrame([(s, day(f), day(x), t) for s, f, x, t in rows], "site string, found date, lost date, tld string")
    got = [(r.site, r.month.month, r.gained, r.lost, r.live_before, r.lost_share, r.lost_many, r.silent, r.one_tld) for r in series.link_months(links, F.to_date(F.lit("2024-07-20"))).collect()]
    assert sorted(got, key=lambda r: r[:2]) == [
        ("a", 1, 2, 0, 0, None, False, False, True),
        ("a", 2, 0, 1, 2, 0.5, True, False, False),
        ("a", 3, 0, 0, 1, 0.0, False, False, False),
        ("a", 4, 0, 0, 1, 0.0, False, True, False),
        ("a", 5, 0, 0, 1, 0.0, False, True, False),
        ("a", 6, 2, 1, 1, 1.0, True, False, False),
        ("a", 7, 0, 0, 2, 0.0, False, False, False),
        ("b", 6, 1, 0, 0, None, False, False, False),
        ("b", 7, 0, 0, 1, 0.0, False, False, False),
    ]
    assert series.link_months(links.limit(0), F.to_date(F.lit("2024-07-20"))).count() == 0


def test_nearby_counts_copies_of_a_position(spark):
    """Places and others of few positions: each pair of positions is measured once, however many stand there."""
    from sightline.operators import audits

    spots = ("cast(id % 5 as double) * 0.01 as lat", "cast(id % 3 as double) * 0.01 as lng")
    places = spark.range(40).selectExpr("id as place", *spots).unionByName(spark.createDataFrame([(99, None, 1.0), (98, 70.0, 1.0)], "place long, lat double, lng double"))
    others = spark.range(600).selectExpr("id as other", *spots).unionByName(spark.createDataFrame([(-1, None, None)], "other long, lat double, lng double"))
    want = audits.within_radius(places, others, 1.2).groupBy("place").agg(F.count(F.lit(1)).alias("n"), F.min("km").alias("km"))
    got = audits.nearby(places, others, 1.2)
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in want.collect()} and got.count() == 40
    many = audits.nearby(spark.range(2_000_000).selectExpr("id as place", *spots), spark.range(2_000_000).selectExpr("id as other", *spots), 1.2)
    assert many.agg(F.max("competitors")).first()[0] > 133_333  # some 10^12 pairs of rows


def test_overlap_deals_its_pairs_out(spark, monkeypatch):
    """As many tasks as the pairs need, whatever spark.sql.shuffle.partitions says; null keys and items meet nothing."""
    monkeypatch.setattr(markets, "PAIRS", 100)
    rows = [(k, i) for i in range(40) for k in range(8) if (i + k) % 3] + [(None, 1), (1, None), (2, None), (0, 1), (0, 1)]
    got = markets.overlap(spark.createDataFrame(rows, "k int, i int"), "k", "i")
    have = {k: {i for x, i in rows if x == k and i is not None} for k in range(8)}
    assert {tuple(r) for r in got.collect()} == {(a, b, len(have[a] & have[b])) for a in range(8) for b in range(a + 1, 8) if have[a] & have[b]}
    assert got.rdd.getNumPartitions() > 4


def test_markup_walks_hold_few_rows_in_python(spark):
    from sightline.operators import markup

    made = list(markup._tables(((str(i), i) for i in range(2 * markup.HELD + 1)), ["url", "pos"]))
    assert [len(t) for t in made] == [markup.HELD, markup.HELD, 1] and made[2]["pos"].tolist() == [2 * markup.HELD]
    assert list(markup._tables([], ["url"])) == []
    pages = spark.range(50).selectExpr("cast(id as string) as url", f"concat('<h1>t</h1>', repeat('<img src=a>', {markup.HELD})) as html")
    got = markup.elements(pages).groupBy("kind").count().collect()
    assert {(r.kind, r["count"]) for r in got} == {("heading", 50), ("image", 50 * markup.HELD)}
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 1_000
