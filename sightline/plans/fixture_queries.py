"""Operators over small tables written here, with their results as SQL: tests, not queries of the entry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.functions import addresses
from sightline.operators import drift, markets, rules, sites
from sightline.registry import fixture

ROBOTS = "User-agent: GPTBot\nUser-agent: CCBot\nDisallow: /\n\nUser-agent: ClaudeBot\nDisallow: /private # not yet\nAllow: /\n\nUser-agent: *\nDisallow: /tmp\nSitemap: https://a.example/s.xml"
SITEMAP = '<?xml version="1.0"?><urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><url><loc>https://a.example/</loc><lastmod>2024-01-01</lastmod></url><url><loc>https://a.example/b?x=1&amp;y=2</loc></url></urlset>'


def _sites(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("a.example", ROBOTS), ("b.example", "User-agent: *\nDisallow: /"), ("c.example", "")], "site string, text string")


@fixture("""select * from (values ('a.example', 'BLOCKED', 2), ('a.example', 'PARTIALLY_BLOCKED', 1), ('a.example', 'ALLOWED_BY_DEFAULT', 15), ('b.example', 'BLOCKED_BY_WILDCARD', 18), ('c.example', 'NOT_MENTIONED', 18), ('d.example', 'NO_ROBOTS_TXT', 18)) t(site, verdict, crawlers)""")
def crawler_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = spark.createDataFrame([("a.example", True), ("b.example", True), ("c.example", True), ("d.example", False)], "site string, found boolean")
    out = sites.crawler_access(sites.robots_rules(_sites(spark)), known)
    return out.groupBy("site", "verdict").agg(F.count(F.lit(1)).cast("int").alias("crawlers"))


@fixture("""select * from (values ('a.example', 0, 'https://a.example/', '2024-01-01'), ('a.example', 1, 'https://a.example/b?x=1&y=2', null)) t(site, pos, loc, lastmod)""")
def sitemap_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sites.sitemap_urls(spark.createDataFrame([("a.example", SITEMAP)], "site string, text string"))


_SNAPSHOT = "url string, status_code int, title string, meta_description string, canonical string, robots string, h1 string, h2 array<string>, schema_types array<string>, schema_hash string, og map<string,string>, html_hash string, metrics map<string,double>, perf_score double"


@fixture("""select * from (values ('canonical_removed', 'CRITICAL'), ('cwv_regressed', 'WARNING'), ('h1_changed', 'CRITICAL'), ('h2_structure_changed', 'INFO'), ('noindex_added', 'CRITICAL'), ('schema_removed', 'WARNING'), ('status_code_error', 'CRITICAL'), ('title_changed', 'WARNING'), ('content_hash_changed', 'INFO'), ('og_tags_removed', 'WARNING'), ('perf_score_dropped', 'WARNING')) t(rule, severity)""")
def drift_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = [(1, "https://a.example/x/?utm_source=q", 200, "Stale", "d", None, None, "h", [], [], None, {}, "0", {}, None), (2, "https://a.example/x", 200, "Old title", "d", "https://a.example/x", None, "Winter boots for snow", ["a"], ["FAQPage"], "s", {"og:title": "t"}, "1", {"lcp": 1000.0}, 90.0)]
    new = [("HTTPS://A.example:443/x#top", 500, "New title", "d", None, "noindex", "Zzz qqq", ["b"], [], None, {}, "2", {"lcp": 1300.0}, 70.0)]
    found = drift.findings(spark.createDataFrame(new, _SNAPSHOT), spark.createDataFrame(old, "id long, " + _SNAPSHOT))
    return found.where("triggered").select("rule", "severity")


@fixture("""select * from (values (0, 'Product', 'error', 'name'), (0, 'Product', 'warning', 'aggregateRating'), (0, 'Product', 'warning', 'brand'), (0, 'Product', 'warning', 'description'), (0, 'Product', 'warning', 'image'), (0, 'Product', 'warning', 'review'), (1, 'Person', 'warning', 'image'), (1, 'Person', 'warning', 'jobTitle'), (1, 'Person', 'warning', 'knowsAbout'), (1, 'Person', 'warning', 'sameAs'), (1, 'Person', 'warning', 'url'), (2, null, 'error', '@type')) t(pos, type, severity, property)""")
def structured_data_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    html = '<script type="application/ld+json">{"@context":"x","@graph":[{"@context":"x","@type":"https://schema.org/Product","offers":{}},{"@type":["Person"],"name":"n"}]}</script><script type="application/ld+json">{"a":1}</script><script type="application/ld+json">{broken</script>'
    pages = spark.createDataFrame([("https://a.example/", html)], "url string, html string")
    return rules.jsonld_issues(rules.jsonld_blocks(pages)).drop("url")


@fixture("""select * from (values ('en_GB', 'error', 'language subtag'), ('en_GB', 'error', 'underscore'), ('en_GB', 'warning', 'language case'), ('DE', 'warning', 'language case'), ('en-UK', 'error', 'not a region'), ('fr', 'error', 'no href'), ('es', 'error', 'relative href'), ('de', 'error', 'duplicate'), (null, 'warning', 'no x-default')) t(lang, severity, issue)""")
def locale_link_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    page, a = "https://a.example/en/", "https://www.a.example/en"
    rows = [(page, "en_GB", a), (page, "DE", a), (page, "de", a), (page, "en-UK", a), (page, "fr", None), (page, "es", "/es")]
    return rules.hreflang_issues(spark.createDataFrame(rows, "page_url string, lang string, href string")).drop("page_url")


@fixture("""select * from (values ('http://127.0.0.1/', false), ('http://10.1.2.3/a', false), ('https://a.example/', true), ('ftp://a.example/', false), ('http://u@a.example/', false), ('http://0177.0.0.1/', false), ('http://8.8.8.8/', true), ('http://localhost:80/', false), ('http://2130706433/', false)) t(url, is_safe)""")
def url_safety(spark: SparkSession, sf_dir: str) -> DataFrame:
    urls = ["http://127.0.0.1/", "http://10.1.2.3/a", "https://a.example/", "ftp://a.example/", "http://u@a.example/", "http://0177.0.0.1/", "http://8.8.8.8/", "http://localhost:80/", "http://2130706433/"]
    return spark.createDataFrame([(u,) for u in urls], "url string").select("url", addresses.safe(F.col("url")).alias("is_safe"))


@fixture("""with s as (select unnest(range(0, 7)) as k), p as (select a.k as r, b.k as c, (3 - a.k) * 1.0 as dy, (b.k - 3) * 1.0 as dx from s a, s b) select r::int as row, c::int as col, round(48.0 + dy / 111.32, 6) as lat, round(2.0 + dx / (111.32 * cos(radians(48.0))), 6) as lng, if(dy >= 0, 'N', 'S') || if(dx >= 0, 'E', 'W') as quadrant from p""")
def rank_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markets.grid(spark.createDataFrame([("p", 48.0, 2.0)], "place string, lat double, lng double")).drop("place")


@fixture("""select * from (values (3, 1, 1, 1, 2, 0, false, 27)) t(images, missing_alt, empty_alt, missing_size, lazy, modern, first_lazy, score)""")
def image_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [("p", 0, "a.png", None, "1", "1", "none"), ("p", 1, "b.jpg", "", "1", None, "native"), ("p", 2, "c.gif", "c", "1", "1", "native")]
    return rules.image_scores(spark.createDataFrame(rows, "page_url string, pos int, src string, alt string, width string, height string, lazy_method string")).drop("page_url")
