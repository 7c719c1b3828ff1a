"""Crawls against a sequential one over random files; kinds, locations and candidates of odd ones."""

import html
import random
import re

from pyspark.sql import functions as F

from sightline.operators import sitemaps

FILES = "url string, status int, content_type string, text string"


def one_by_one(files, robots, site, max_pages, most):
    held = {u: (s, t) for u, s, _, t in files}
    told = [x.strip()[8:].strip() for x in (robots.get(site) or "").splitlines() if x.strip().lower().startswith("sitemap:")]
    queue, visited, pages = [*dict.fromkeys(x for x in told if x), *[site + p for p in sitemaps.COMMON_PATHS]], [], []
    while queue:
        url = queue.pop(0)
        if url in visited or len(visited) == most:
            continue
        visited.append(url)
        status, text = held.get(url, (None, None))
        if status != 200:
            continue
        locs = [html.unescape(x).strip() for x in re.findall(r"<loc>([^<]*)", text)]
        if text.startswith("<sitemapindex"):
            queue += locs
            continue
        for x in locs:
            if x not in pages:
                pages.append(x)
            if len(pages) >= max_pages:
                return pages
    return pages


def random_site(draw, site, n):
    urls = [f"{site}/f{i}.xml" for i in range(n)] + [site + p for p in sitemaps.COMMON_PATHS]
    files = []
    for u in urls:
        if draw.random() < 0.15:
            continue
        root, pool = draw.choice([("sitemapindex", urls), ("urlset", [f"{site}/p{i}?x=1&y=2" for i in range(40)])])
        text = f"<{root}>" + "".join(f"<loc> {html.escape(x)}\n</loc>" for x in draw.choices(pool, k=draw.randrange(8))) + f"</{root}>"
        files.append((u, draw.choice([200, 200, 200, 200, 404]), None, text))
    return files, "\n".join(draw.choice(["Sitemap: ", " sitemap:", "Allow: "]) + u for u in draw.choices(urls, k=draw.randrange(4)))


def test_crawl_is_sequential(spark):
    draw = random.Random(8)
    files, robots = [], {}
    for i in range(25):
        site = f"https://s{i}.example"
        made, robots[site] = random_site(draw, site, draw.choice([3, 20, 90]))
        files += made
    robots["https://none.example"] = None
    table = spark.createDataFrame(files, FILES)
    of = spark.createDataFrame(list(robots.items()), "site string, text string")
    for max_pages, most in ((1000, 65), (7, 65), (1000, 5), (0, 65)):
        got = {s: [] for s in robots}
        for r in sitemaps.pages(table.unionByName(table.limit(5)), of, max_pages, most).orderBy("site", "pos").collect():
            assert r.pos == len(got[r.site])
            got[r.site].append(r.url)
        assert got == {s: one_by_one(files, robots, s, max_pages, most) for s in robots}
    assert sitemaps.pages(table.limit(0), of, 5).count() == 0
    assert sitemaps.pages(table, of.limit(0), 5).count() == 0


def test_crawl_of_indexes_that_list_each_other(spark):
    index = lambda *urls: "<sitemapindex>" + "".join(f"<loc>{u}</loc>" for u in urls) + "</sitemapindex>"
    site = "https://a.example"
    files = [(f"{site}/sitemap.xml", 200, None, index(f"{site}/b", f"{site}/sitemap.xml")), (f"{site}/b", 200, None, index(f"{site}/sitemap.xml", f"{site}/b", f"{site}/c")), (f"{site}/c", 200, None, "<urlset><loc>x</loc></urlset>")]
    robots = spark.createDataFrame([(site, None)], "site string, text string")
    assert [r.url for r in sitemaps.pages(spark.createDataFrame(files, FILES), robots, 10).collect()] == ["x"]


def test_locations(spark):
    held = {
        "<urlset><loc>a</loc><LOC x='1'> b\n</LOC><image:loc>c</image:loc><location>d</location><loc/><loc /><loc></loc></urlset>": ["a", "b", "c"],
        "<loc>x?a=1&amp;b=&lt;&#38;&#x1F600;&#65;</loc><loc>bad &nbsp; one</loc><loc>a & b</loc><loc>&amp;lt;</loc>": ["x?a=1&b=<&\U0001f600A", "&lt;"],
        "<!-- <loc>no</loc> --><loc>yes</loc><loc><![CDATA[z]]></loc>": ["yes"],
        "": [],
        "<loc>" + "x" * 200_000: ["x" * 200_000],
    }
    rows = spark.createDataFrame([(i, t) for i, t in enumerate([*held, None])], "i int, t string").select("i", sitemaps.locations(F.col("t")).alias("l"))
    assert {r.i: r.l for r in rows.collect()} == dict(enumerate([*held.values(), []]))


def test_kinds(spark):
    rows = [
        ("  <urlset/>", None, "u", "urlset", None), ("<?xml version='1'?><!-- <a> --><s:SitemapIndex>", "", "u", "sitemapindex", None), ("<rss>", None, "u", "rss", None), ("<feed x='1'>", None, "u", "feed", None),
        ("<html>", None, "u", None, "unsupported XML root"), ("<!-- -->", None, "u", None, "invalid XML"), ("<!doctype html><urlset>", None, "u", None, "DOCTYPE is not allowed in sitemap XML"), (" \n", None, "u", None, "empty response"), (None, None, "u", None, "empty response"),
        ("https://a/\n\n http://b/x y \r\n", "Text/Plain; charset=x", "u", "text", None), ("https://a/", None, "https://x/Map.TXT", "text", None), ("https://a/", None, "u", None, "response is not a supported sitemap format"),
        ("https://a/\nnot", "text/plain", "u", None, "invalid text sitemap"), ("https://u:p@a/", "text/plain", "u", None, "invalid text sitemap"),
        ("https://a/\n" * 50_000, "text/plain", "u", "text", None), ("https://a/\n" * 50_001, "text/plain", "u", None, "text sitemap exceeds the 50,000 URL protocol limit"),
    ]
    table = spark.createDataFrame([(i, *r[:3]) for i, r in enumerate(rows)], "i int, text string, content_type string, url string")
    got = {r.i: (r.k["kind"], r.k["error"]) for r in table.select("i", sitemaps.kind(F.col("text"), F.col("content_type"), F.col("url")).alias("k")).collect()}
    assert got == {i: r[3:] for i, r in enumerate(rows)}


def test_candidates(spark):
    site = "https://a.example"
    told = "User-agent: *\nSITEMAP: https://B.example/m?k=1\nsitemap:\nSitemap: not a url\nSitemap: https://u:p@a.example#f\n Sitemap: https://B.example/m?k=1\nSitemap: https://a.example/sitemap.xml"
    many = "\r\n".join(f"Sitemap: https://m.example/{i}" for i in range(20))
    robots = spark.createDataFrame([(site, told), ("https://m.example", many), ("https://n.example", None)], "site string, text string")
    files = spark.createDataFrame([("https://B.example/m?k=1", 200, None, "<urlset/>"), (f"{site}/sitemap.xml", 503, None, "<urlset/>"), (f"{site}/wp-sitemap.xml", 204, None, ""), ("https://m.example/15", None, None, None), (None, 200, None, "<rss/>")], FILES)
    rows = sitemaps.candidates(robots, files).orderBy("site", "pos").collect()
    of = [tuple(r)[1:] for r in rows if r.site == site]
    assert of == [
        (0, "https://B.example/m", True, "robots.txt", True, 4, 200, "urlset", True, None),
        (1, "not a url", True, "robots.txt", True, 4, None, None, False, "not fetched"),
        (2, "https://a.example/", True, "robots.txt", False, 4, None, None, False, "not fetched"),
        (3, f"{site}/sitemap.xml", False, "robots.txt", False, 4, 503, None, False, "HTTP 503"),
        (4, f"{site}/sitemap_index.xml", False, "common_path", False, 4, None, None, False, "not fetched"),
        (5, f"{site}/sitemap-index.xml", False, "common_path", False, 4, None, None, False, "not fetched"),
        (6, f"{site}/wp-sitemap.xml", False, "common_path", False, 4, 204, None, False, "empty response"),
    ]
    m = [r for r in rows if r.site == "https://m.example"]
    assert len(m) == 20 and {r.n_declared for r in m} == {20} and m[15].error == "HTTP ?" and m[16].source == "common_path"
    assert len([r for r in rows if r.site == "https://n.example"]) == 4


def test_a_files_root_is_worked_out_once(spark):
    files = spark.createDataFrame([], "text string, content_type string, url string")
    plan = files.select(sitemaps.kind(F.col("text"), F.col("content_type"), F.col("url")).alias("k"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("regexp_extract(") == 1
