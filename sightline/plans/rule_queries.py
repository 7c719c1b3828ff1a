"""Scores, reports and vendor payloads over small tables written here, each with its rows as SQL (tests); llms files as a query."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.operators import claims, markets, rules, scores, sites
from sightline.registry import fixture, query
from sightline.sources import vendors


@fixture("select * from (values ('a', 4, 77.4, 'scored'), ('b', 1, null, 'insufficient data')) t(site, factors, score, state)")
def link_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [("a", k, 80.0, 1.0) for k in ("domains", "anchors", "toxic")] + [("a", "follow", 20.0, 0.5), ("b", "domains", 90.0, 1.0)]
    return scores.link_health(spark.createDataFrame(rows, "site string, factor string, score double, confidence double"))


@fixture("select * from (values ('red boots', true, true, true, false, true, true, 5), ('x', false, false, false, false, false, false, 0)) t(keyword, in_title, in_h1, in_url, in_description, in_start, in_alt, placed)")
def keyword_placement(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [("red boots", "Red Boots", "Our RED BOOTS", "https://a/red-boots", None, "About red boots.", ["red boots"]), ("x", None, None, None, None, None, None)]
    out = scores.placement(spark.createDataFrame(rows, "keyword string, title string, h1 string, url string, description string, body string, alts array<string>"))
    return out.select("keyword", "in_title", "in_h1", "in_url", "in_description", "in_start", "in_alt", "placed")


@fixture("select * from (values ('p', 'de', true, 80, 'aging', true), ('p', 'fr', false, 0, null, null)) t(page, lang, \"exists\", score, freshness, length_ok)")
def locale_parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.sql("select * from values ('p', 'en', 3, 1, 100, true, true, date '2024-03-01'), ('p', 'de', 4, 1, 130, true, false, date '2024-02-10') as t(page, lang, sections, images, words, titled, described, updated)")
    return scores.parity(rows, spark.createDataFrame([("en",), ("de",), ("fr",)], "lang string"))


@fixture("select * from (values ('p', 0, 3, true), ('p', 1, 3, true), ('p', 2, 3, true), ('p', 9, 0, false)) t(place, review_id, signals, suspicious)")
def review_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.sql("""select * from values ('p', 0, timestamp '2024-01-01 10:00:00', 5, 1, 'Great place'), ('p', 1, timestamp '2024-01-01 10:05:00', 5, 1, 'great  place'), ('p', 2, timestamp '2024-01-01 10:59:00', 5, 1, 'Great place'),
      ('p', 9, timestamp '2024-02-01 00:00:00', 3, 50, 'ok') as t(place, review_id, ts, rating, author_reviews, text)""")
    return scores.review_flags(rows)


@fixture("select * from (values ('s', 'not 200', 'high', 1), ('s', 'noindexed', 'high', 1), ('s', 'not https', 'medium', 1), ('s', 'identical lastmod', 'low', 2)) t(sitemap, issue, severity, urls)")
def sitemap_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = spark.createDataFrame([("s", "http://a", "d"), ("s", "https://b", "d")], "sitemap string, loc string, lastmod string")
    return scores.sitemap_quality(entries, spark.createDataFrame([("http://a", 404, False, False), ("https://b", 200, True, False)], "loc string, status int, noindex boolean, redirected boolean"))


@fixture("select * from (values ('a', 100), ('b', 40)) t(site, score)")
def crawler_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [("a", 5, 5, False, True, True), ("b", 3, 1, True, False, True)]
    return scores.crawler_score(spark.createDataFrame(rows, "site string, tier1 int, tier2 int, blanket_block boolean, llms_file boolean, sitemap_file boolean"))


@fixture("select * from (values ('p', 70.0, 'b', 40)) t(page, score, weakest, weakest_score)")
def persona_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores.personas(spark.createDataFrame([("p", "a", 3, 20, 20, 20, 20), ("p", "b", 1, 10, 10, 10, 10)], "page string, persona string, volume int, relevance int, clarity int, trust int, action int"))


@fixture("select * from (values ('a'), ('e')) t(query)")
def quick_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [("a", 1.0, 100.0, 5.0), ("b", 1.0, 10.0, 5.0), ("c", 1.0, 200.0, 1.0), ("d", 0.0, 1.0, 20.0), ("e", 2.0, 150.0, 10.0)]
    return scores.quick_wins(spark.createDataFrame(rows, "query string, clicks double, impressions double, position double"), 0.5).select("query")


@fixture("""select * from (values ('product 0', 'warning', 'brand'), ('product 0', 'warning', 'description'), ('product 0', 'warning', 'rating'), ('product 0 offer 0', 'error', 'availability value'), ('product 0 offer 0', 'warning', 'priceValidUntil'), ('product 0 offer 0', 'warning', 'shippingDetails'), ('product 0 offer 0', 'warning', 'hasMerchantReturnPolicy'),
 ('product 0 offer 1', 'error', 'price'), ('product 0 offer 1', 'error', 'priceCurrency'), ('product 0 offer 1', 'error', 'availability'), ('product 0 offer 1', 'warning', 'priceValidUntil'), ('product 0 offer 1', 'warning', 'shippingDetails'), ('product 0 offer 1', 'warning', 'hasMerchantReturnPolicy')) t(path, severity, issue)""")
def merchant_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    block = '{"@type":"Product","name":"n","image":"i","sku":"1","offers":[{"price":1,"priceCurrency":"EUR","availability":"https://schema.org/Nowhere"},{}]}'
    return rules.merchant_issues(spark.createDataFrame([("u", 0, block)], "url string, pos int, json string")).drop("url")


@fixture("select * from (values (0, 'error', 'followed and nofollow'), (0, 'warning', 'duplicate source'), (1, 'error', 'target'), (1, 'warning', 'verified'), (1, 'warning', 'duplicate source')) t(row, severity, issue)")
def backlink_lint(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(0, "http://s", "http://t", True, True, True, ["nofollow"]), (1, "http://s", None, None, None, None, None)]
    return rules.backlink_report(spark.createDataFrame(rows, "row int, source string, target string, link_found boolean, verified boolean, followed boolean, rel array<string>"))


@fixture("select * from (values ('p', 1, false, false, false), ('q', 1, true, true, false), ('r', 0, false, false, false)) t(page_url, found, followed, sponsored, ugc)")
def backlink_verification(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [("p", "http://www.t.example/", ["nofollow"]), ("q", "http://t.example/x", ["sponsored"]), ("r", "http://u.example/", None)]
    return rules.link_status(spark.createDataFrame(rows, "page_url string, href string, rel array<string>"), "t.example")


@fixture("select * from (values ('exact', 2, 0.4), ('brand', 1, 0.2), ('url', 1, 0.2), ('generic', 1, 0.2)) t(kind, links, share)")
def anchor_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markets.anchors(spark.createDataFrame([("Boots",), ("boots ",), ("Acme",), ("http://x",), (None,)], "anchor string"), "acme", "boots")


@fixture("select * from (values ('p', 33.3, 3.0, 1, 'SW')) t(place, solv, average_rank, absent, worst_quadrant)")
def local_voice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markets.share_of_local_voice(spark.createDataFrame([("p", "NE", 1), ("p", "SW", None), ("p", "NE", 5)], "place string, quadrant string, rank int"))


@fixture("select * from (values ('a', 3, 0.3, true, 'confirm'), ('b', 1, null, false, 'unknown')) t(endpoint, n, estimate, known, tier)")
def cost_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markets.estimate(spark.createDataFrame([("a", 3), ("b", 1)], "endpoint string, n int"), spark.createDataFrame([("a", 0.1)], "endpoint string, unit_cost double"))


@fixture("select * from (values (1, 0, 'statistic', '45% of users', true), (1, 1, 'quantity', '$3 million', false), (1, 2, 'temporal', 'in 2019', false), (2, 0, 'quantity', '2,000 people', false), (2, 1, 'comparative', 'twice as good', false)) t(doc_id, n, kind, claim, cited)")
def claim_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    texts = [(1, f"Sales rose 45% of users [1]. {'x ' * 250} It cost $3 million in 2019."), (2, '<style>a{width:93%}</style> <a href="%E5%93%81">2,000 people</a> twice as good'), (3, None)]
    found = claims.claims(spark.createDataFrame(texts, "doc_id int, text string"))
    n = F.row_number().over(Window.partitionBy("doc_id").orderBy("position")) - 1
    return found.select("doc_id", n.alias("n"), "kind", "claim", F.col("citation").isNotNull().alias("cited"))


@fixture("select * from (values (1, 'Explore this range. note: we explore X.', 5), (2, '', 0)) t(n, cleaned, changes)")
def plainer_fixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [("Delve into this rich tapestry. Moreover, it's worth noting that we delve into X .", 1), (None, 2)]
    return claims.plainer(spark.createDataFrame(rows, "text string, n int")).drop("text")


# llms.txt files of the pages, with and without each part by the page's number
_FILE = """case when page_id % 11 = 0 then null else concat(case when page_id % 3 = 0 then 'Site' else '# Site' end, chr(10), case when page_id % 2 = 0 then '> About it' else 'plain' end, chr(10),
 repeat(concat('## Part', chr(10)), cast(page_id % 4 as int)), repeat(concat('- [Page](', url, '): text', chr(10)), cast(page_id % 7 as int)), case when page_id % 5 = 0 then '## Contact' else 'see [x](y)' end) end"""


@query(f"""with f as (select cast(page_id as varchar) as site, {_FILE.replace(" int)", " bigint)")} as text from pages), l as (select site, text, string_split(coalesce(text, ''), chr(10)) as x from f),
m as (select site, text is not null as exists, starts_with(x[1], '# ') as has_title, len(list_filter(x, lambda y: starts_with(y, '> '))) > 0 as has_description, len(list_filter(x, lambda y: starts_with(y, '## '))) as sections,
 len(list_filter(x, lambda y: starts_with(y, '- [') and contains(y, ']('))) as links, lower(coalesce(text, '')) as low from l)
select site, exists, has_title, has_description, sections, links, has_title and has_description and sections > 0 and links > 0 as format_valid,
 case when not exists then 'no file' else array_to_string(list_filter([if(has_title, null, 'no title in the first line'), if(has_description, null, 'no description'), if(sections = 0, 'no section', null), if(links = 0, 'no link in a list', null)], lambda y: y is not null), ',') end as issues,
 case when not exists then '' else array_to_string(list_filter([if(links < 5, 'more key pages', null), if(sections < 2, 'more sections', null), if(contains(low, 'contact'), null, 'a contact section'), if(contains(low, 'key fact') or contains(low, 'about'), null, 'key facts')], lambda y: y is not null), ',') end as suggestions from m""")
def llms_file_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = spark.read.parquet(f"{sf_dir}/pages.parquet").selectExpr("cast(page_id as string) as site", f"{_FILE} as text")
    return sites.llms_report(files).withColumns({c: F.array_join(c, ",") for c in ("issues", "suggestions")})


@fixture("select * from (values ('r', 0), ('a', 1), ('b', 2)) t(node, depth)")
def sitemap_crawl(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = spark.createDataFrame([("r", "a"), ("a", "b"), ("b", "r"), ("x", "y")], "parent string, child string")
    return sites.sitemap_crawl(edges, spark.createDataFrame([("r",)], "node string"))


@fixture("select * from (values ('x', 'both'), ('y', 'only listed'), ('z', 'only crawled')) t(url, state)")
def sitemap_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sites.sitemap_coverage(spark.createDataFrame([("x",), ("y",), ("y",)], "url string"), spark.createDataFrame([("x",), ("z",)], "url string"))


@fixture("select * from (values ('k', 'lcp', 0, 1.0), ('k', 'lcp', 1, null), ('k', 'lcp', 2, 0.5)) t(url, metric, period, p75)")
def field_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    payload = '{"record":{"metrics":{"lcp":{"percentilesTimeseries":{"p75s":[1,null,"0.5"]}}}}}'
    return vendors.field_history(spark.createDataFrame([("k", payload), ("bad", "{")], "url string, payload string"))


@fixture("select * from (values ('k', 'q', 'p', 1.0, 2.0, 0.5, 3.0)) t(property, query, page, clicks, impressions, ctr, position)")
def search_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    payload = '{"rows":[{"keys":["q","p"],"clicks":1,"impressions":2,"ctr":0.5,"position":3}]}'
    return vendors.search_rows(spark.createDataFrame([("k", payload)], "property string, payload string"), ["query", "page"])


@fixture("select * from (values ('a', date '2001-02-03', null, 'R Inc'), ('b', date '2001-02-03', null, null), ('c', null, null, null)) t(domain, created, expires, registrar)")
def domain_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [("a", "Domain: a\nCreation Date: 2001-02-03T00:00:00Z\nRegistrar: R Inc\n"), ("b", "created: 03-Feb-2001\n"), ("c", None)]
    return vendors.whois(spark.createDataFrame(rows, "domain string, text string"))
