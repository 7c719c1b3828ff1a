"""Queries of the audits over whole tables; markup and headers that the pages lack are added by rule from page_id."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.functions import urls as ux
from sightline.operators import audits, markets, markup, rules
from sightline.plans.page_queries import _LINKS, _WORDS
from sightline.registry import query, table

def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages")


def _where(ok, text: str):
    return F.when(ok, text).otherwise("")


def _joined(df: DataFrame, *lists: str) -> DataFrame:
    return df.withColumns({c: F.array_join(c, ",") for c in lists})


_IMAGES = (
    '<img src="a.png" alt="x" loading="LAZY" width="1" height="2">',
    '<img src="a.webp" class="Lazy-Loaded other">',
    "<img src='b.png' data-perfmatters-src='c' class='lazyload' alt=''>",
    '<img src="a.png" data-eio="p" data-src="q" alt="y">',
    '<img data-original="q" alt="y" width="3">',
    '<img src="a.png" class="lazyish" data-src="">',
)


def _with_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    image = F.element_at(F.array(*[F.lit(i) for i in _IMAGES]), (F.col("page_id") % len(_IMAGES) + 1).cast("int"))
    return _pages(spark, sf_dir).select(F.col("page_id").cast("string").alias("url"), F.concat("html", image).alias("html"))


@query("""select cast(page_id as varchar) as page_url, ['native', 'js-generic', 'perfmatters', 'ewww', 'js-generic', 'none'][page_id % 6 + 1] as lazy_method,
 ['x', null, '', 'y', 'y', null][page_id % 6 + 1] as alt from pages""")
def image_lazy_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audits.image_methods(markup.elements(_with_images(spark, sf_dir))).select("page_url", "lazy_method", "alt")


@query("""select lazy_method, count(*) as images, count(*) filter (alt is null) as without_alt from (select ['native', 'js-generic', 'perfmatters', 'ewww', 'js-generic', 'none'][page_id % 6 + 1] as lazy_method,
 ['x', null, '', 'y', 'y', null][page_id % 6 + 1] as alt from pages) group by 1""")
def lazy_method_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    images = audits.image_methods(markup.elements(_with_images(spark, sf_dir)))
    return images.groupBy("lazy_method").agg(F.count(F.lit(1)).alias("images"), F.count_if(F.col("alt").isNull()).alias("without_alt"))


@query("""select cast(page_id as varchar) as page_url, cast(1 as bigint) as images, cast((page_id % 6 in (1, 5))::int as bigint) as missing_alt from pages""")
def page_image_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rules.image_scores(audits.image_methods(markup.elements(_with_images(spark, sf_dir))))
    return out.select("page_url", F.col("images").cast("long").alias("images"), F.col("missing_alt").cast("long").alias("missing_alt"))


@query("""with l as (select doc_id, unnest(string_split(text, chr(10))) as line from documents), t as (select doc_id, trim(line, ' ') as t from l)
select doc_id, count(*) as n_lines, count(*) filter (length(t) <= 3 or regexp_full_match(translate(t, ',.+-% ', ''), '[0-9]+')) as n_suspicious from t group by 1""")
def suspicious_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return lines.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_lines"), F.count_if(audits.suspicious(F.col("line"))).alias("n_suspicious"))


@query("""select page_id, if(page_id % 2 = 0, 'max-age=1', null) as transport, if(page_id % 3 = 0, 'DENY', null) as frames, (page_id % 2 = 0)::int + (page_id % 3 = 0)::int + (page_id % 5 = 0)::int as n_present from pages""")
def security_header_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = F.create_map(F.lit("strict-transport-security"), F.when(F.col("page_id") % 2 == 0, "max-age=1"), F.lit("x-frame-options"), F.when(F.col("page_id") % 3 == 0, "DENY"), F.lit("referrer-policy"), F.when(F.col("page_id") % 5 == 0, "no-referrer"), F.lit("server"), F.lit("s"))
    known = _pages(spark, sf_dir).select("page_id", audits.security_headers(given).alias("h"))
    return known.select("page_id", F.col("h")["strict-transport-security"].alias("transport"), F.col("h")["x-frame-options"].alias("frames"), F.size(F.filter(F.map_values("h"), lambda v: v.isNotNull())).alias("n_present"))


@query("""select page_id, (page_id % 4 = 0)::int as rule_blocks, page_id % 7 = 0 as rule_header, if(page_id % 4 = 0, 'prerender', '') as actions, (page_id % 2 = 0)::int * 2 as preloads, (page_id % 3 = 0)::int as prerenders,
 (page_id % 5 = 0)::int as high_priority, page_id % 5 = 0 as media_priority, page_id % 11 = 0 as no_store, page_id % 13 = 0 as unload, page_id % 2 = 1 as beforeunload,
 25 * ((page_id % 4 = 0 or page_id % 7 = 0)::int + (page_id % 5 = 0)::int + (page_id % 11 <> 0 and page_id % 13 <> 0)::int + (page_id % 3 <> 0)::int) as score,
 array_to_string(list_filter([if(page_id % 4 <> 0 and page_id % 7 <> 0, 'speculation rules', null), if(page_id % 5 <> 0, 'media priority', null), if(page_id % 11 = 0 or page_id % 13 = 0, 'kept for the way back', null), if(page_id % 3 = 0, 'no prerender link', null)], lambda x: x is not null), ',') as advice from pages""")
def page_preload_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [
        _where(F.col("page_id") % 4 == 0, '<script type="speculationrules"> {"prerender": [{"source": "list"}], "prefetch": 1} </script>'),
        _where(F.col("page_id") % 2 == 0, "<link rel='preload' href=a><LINK href=b rel = \"preload\">"),
        _where(F.col("page_id") % 3 == 0, '<link rel="prerender" href="c">'),
        _where(F.col("page_id") % 5 == 0, '<img src="a"\n fetchpriority="high">'),
        _where(F.col("page_id") % 13 == 0, "<script>addEventListener('unload', f)</script>"),
        _where(F.col("page_id") % 2 == 1, '<script>$(w).on ( "beforeunload", f)</script>'),
    ]
    headers = F.create_map(F.lit("cache-control"), F.when(F.col("page_id") % 11 == 0, "No-Store, private").otherwise("max-age=3"), F.when(F.col("page_id") % 7 == 0, "speculation-rules").otherwise("server"), F.lit("s"))
    made = _pages(spark, sf_dir).select("page_id", F.concat("html", *parts).alias("html"), headers.alias("headers"))
    return _joined(audits.preload_audit(made), "actions", "advice")


# tags are found by splitting at < here
_BARE = r"regexp_replace(regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', ' ', 'g'), '(?is)<script\b.*?</script\s*>', ' ', 'g'), '(?is)<style\b.*?</style\s*>', ' ', 'g')"


@query(rf"""with t as (select page_id, html, string_split({_BARE}, '<')[2:] as t from pages),
n as (select page_id, html, list_transform(t, lambda x: lower(regexp_extract(x, '^([A-Za-z][A-Za-z0-9]*)[\s>]', 1))) as n from t),
k as (select page_id, array_to_string(list_filter(n, lambda x: x in ('main', 'nav', 'header', 'footer', 'aside', 'section', 'article', 'form')), ',') as landmarks, cast(len(list_filter(n, lambda x: x = 'h1')) as int) as h1s, contains(html, '<main') or contains(html, 'role="main"') as has_main from n)
select page_id, landmarks, h1s, array_to_string(list_filter([if(has_main, null, 'no main landmark'), case when h1s = 0 then 'no H1' when h1s > 1 then 'multiple H1s' end], lambda x: x is not null), ',') as issues from k""")
def page_landmarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _joined(audits.landmark_outline(_pages(spark, sf_dir)), "landmarks", "issues")


@query("select section, count(*) as pages from (select ['Products & Services', 'Resources & Blog', 'Company', 'Support', 'Main Pages', 'Products & Services'][page_id % 6 + 1] as section from pages) group by 1")
def llms_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = F.array(*[F.lit(p) for p in ("/pricing", "/x/guides/a", "/about-us", "/faq", "/other", "/blog/product")])
    path = F.concat(ux.part(F.col("url"), 3), F.element_at(paths, (F.col("page_id") % 6 + 1).cast("int")))
    return _pages(spark, sf_dir).groupBy(audits.section_of(path).alias("section")).agg(F.count(F.lit(1)).alias("pages"))


@query("""with t as (select page_id, url, trim(regexp_replace(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title\\s*>', 1), '<[^>]*>', ' ', 'g'), '[ \\t\\n\\f\\r]+', ' ', 'g')) || [' | Site', '', ' — x', ' · y'][page_id % 4 + 1] as title from pages)
select page_id, if(page_id % 9 = 0, lower(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1)), trim(regexp_extract(title, '^([^|—·-]*)', 1))) as name from t""")
def site_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sightline.operators import pages as pg

    ends = F.element_at(F.array(*[F.lit(e) for e in (" | Site", "", " — x", " · y")]), (F.col("page_id") % 4 + 1).cast("int"))
    title = F.when(F.col("page_id") % 9 == 0, " - nothing before").otherwise(F.concat(pg.element_text(F.col("html"), "title"), ends))
    return _pages(spark, sf_dir).select("page_id", audits.site_name(title, ux.host(F.col("url"))).alias("name"))


@query("""select page_id, split_part(url, '#', 1) || '&key=REDACTED&k=GOOGLE_API_KEY_REDACTED' as shown from pages""")
def redacted_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.concat(F.substring_index("url", "#", 1), F.lit("&key=s3cret%20"), F.col("page_id").cast("string"), F.lit("&k=AIza-x_"), F.col("page_id").cast("string"))
    return _pages(spark, sf_dir).select("page_id", audits.redacted(url).alias("shown"))


@query("""select doc_id, 'Report ' || doc_id as heading, cast(if(doc_id % 7 = 0, null, doc_id % 101) as int) as score, 'Lang ' || lang as label from documents""")
def report_headlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id").cast("string")
    score = F.when(F.col("doc_id") % 7 == 0, "12/1000").otherwise(F.concat((F.col("doc_id") % 101).cast("string"), F.lit(" / 100")))
    report = F.concat(F.lit("intro 1/10\n## no\n# Report "), d, F.lit("  \n# Other\nScore: "), score, F.lit(". Before: 7/100x"))
    return table(spark, sf_dir, "documents").select("doc_id", audits.first_heading(report).alias("heading"), audits.report_score(report).alias("score"), audits.humanized(F.concat(F.lit("lang_"), F.col("lang"))).alias("label"))


@query("""select lang, 'geoTargetConstants/' || case lang when 'de' then 2276 when 'fr' then 2250 when 'es' then 2724 else 2840 end as target, count(*) as docs from documents group by 1, 2""")
def geo_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy("lang", audits.geo_target(F.col("lang")).alias("target")).agg(F.count(F.lit(1)).alias("docs"))


@query("""with o as (select o_custkey, cast(min(o_orderdate) as date) as first_day from orders group by 1), c as (select c_custkey, round(date_diff('day', first_day, date '1998-08-02') / 365.25, 2) as years, c_custkey % 3 as m from customer left join o on c_custkey = o_custkey)
select c_custkey, years, case when years is null or m = 0 then 'unknown' when m = 2 then if(years < 2 or years >= 5, 'high', 'medium') when years >= 1 then 'low' else 'unknown' end as risk from c""")
def domain_history_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.min("o_orderdate").cast("date").alias("first_day"))
    rows = table(spark, sf_dir, "customer").join(first, F.col("c_custkey") == F.col("o_custkey"), "left")
    m, topic = F.col("c_custkey") % 3, F.col("c_mktsegment")
    earlier = F.when(m == 1, F.concat(F.lit(" "), F.lower(topic))).when(m == 2, F.lit("elsewhere"))
    rows = rows.withColumn("years", audits.years_between(F.col("first_day"), F.lit("1998-08-02").cast("date")))
    return rows.select("c_custkey", "years", audits.domain_risk(F.col("years"), topic, earlier).alias("risk"))


@query("""with e as (select event_type, cast(ts as date) as day, value from events), m as (select event_type, max(day) as last from e group by 1)
select event_type, cast(last - 7 as varchar) as first_day, cast(last - 2 as varchar) as last_day, count(*) filter (day between last - 7 and last - 2) as events from e join m using (event_type) group by 1, 2, 3""")
def lagged_window_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    first, last = audits.lagged_window(F.col("newest"), 5)
    kinds = e.groupBy("event_type").agg(F.max("day").alias("newest")).select("event_type", first.alias("first_day"), last.alias("last_day"))
    out = e.join(kinds, "event_type").groupBy("event_type", "first_day", "last_day").agg(F.sum(F.when(F.col("day").between(F.col("first_day"), F.col("last_day")), F.col("n")).otherwise(0)).alias("events"))
    return out.withColumns({"first_day": F.col("first_day").cast("string"), "last_day": F.col("last_day").cast("string")})


@query("""select event_id, user_id, event_type from events window w as (partition by user_id order by ts, event_id) qualify event_type is distinct from lag(event_type) over w or row_number() over w = 1""")
def events_without_adjacent_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audits.without_adjacent_repeats(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "event_type").select("event_id", "user_id", "event_type")


_SETS = {"report": markets.REPORT, "health": markets.HEALTH, "brand": markets.BRAND, "blocks": markets.BLOCKS, "product page": markets.PRODUCT_PAGE, "local": markets.LOCAL, "technical": markets.TECHNICAL}


def _score_sql(name: str, weights: dict[str, float]) -> str:
    # parts are multiples of ten, so that scores have one decimal and none is halfway between two
    total = " + ".join(f"{w} * 10 * ((c_custkey * {2 * i + 3}) % 11)" for i, w in enumerate(weights.values()))
    return f"select c_custkey, '{name}' as kind, cast({total} as double) as score from customer"


@query(" union all ".join(_score_sql(n, w) for n, w in _SETS.items()))
def composite_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, k, out = table(spark, sf_dir, "customer"), F.col("c_custkey"), None
    for name, weights in _SETS.items():
        parts = rows.select("c_custkey", *[((k * (2 * i + 3)) % 11 * 10).alias(c) for i, c in enumerate(weights)])
        one = markets.weighted(parts, weights).select("c_custkey", F.lit(name).alias("kind"), "score")
        out = one if out is None else out.unionByName(one)
    return out


@query("""select page_id, unnest(case page_id % 4 when 0 then ['Critical'] when 1 then ['Critical', 'Medium'] when 2 then ['Medium'] else [] end) as severity,
 unnest(case page_id % 4 when 0 then ['Google-Business Message'] when 1 then ['chat with google maps', 'https://a.business.site'] when 2 then ['http://b.business.site/x'] else [] end) as match from pages""")
def discontinued_profile_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("page_id") % 4
    added = F.when(k == 0, " Google-Business Message; Google-Business Message").when(k == 1, ' chat with google maps <a href="https://a.business.site">').when(k == 2, " http://b.business.site/x Message us").otherwise(" chat with us")
    return audits.profile_findings(_pages(spark, sf_dir).select("page_id", F.concat("html", added).alias("html"))).select("page_id", "severity", "match")


_AGENT = """select page_id, url, html || if(page_id % 2 = 0, '<main id="App">x</main>', '') || if(page_id % 3 = 0, '<script type="application/ld+json">' || if(page_id % 9 = 0, '{not json', '{}') || '</script>', '')
 || if(page_id % 5 = 0, '<img src="a">', '') || if(page_id % 7 = 0, '<meta name="Description" content="' || repeat('word ', 12) || '">', '') || if(page_id % 11 = 0, '<h1>again</h1>', '') as html from pages"""


@query(f"""{_LINKS.replace("with c as", f"with q as materialized ({_AGENT}), c as", 1).replace("x from pages)", "x from q)")},
inner_ as (select distinct page_id from g where is_internal),
facts as (select page_id, {_WORDS} as words, regexp_extract(html, '(?is)<title[^>]*>(.*?)</title', 1) <> '' as has_title, regexp_matches(html, '(?i)<meta name="description" content="[^"]{{50,}}"') as has_description,
 len(regexp_extract_all(html, '(?i)<h1[\\s>]')) = 1 as one_h1, len(list_filter(regexp_extract_all(html, '(?is)<script type="application/ld.json">(.*?)</script', 1), lambda x: json_valid(x))) > 0 as has_data,
 contains(html, '<main') as has_main, not regexp_matches(html, '<img src="a">') as has_alt, page_id in (select page_id from inner_) as has_links from q),
scored as (select *, 25 * (words >= 200)::int + 10 * (has_title::int + has_description::int + one_h1::int + has_main::int + has_alt::int + has_links::int) + 15 * has_data::int as score from facts)
select *, score >= 70 as passes, words < 200 and page_id % 2 = 0 as client_only from scored""")
def agent_readability_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("page_id")
    data = F.when(k % 9 == 0, '<script type="application/ld+json">{not json</script>').when(k % 3 == 0, '<script type="application/ld+json">{}</script>').otherwise("")
    parts = [_where(k % 2 == 0, '<main id="App">x</main>'), data, _where(k % 5 == 0, '<img src="a">'), _where(k % 7 == 0, f'<meta name="Description" content="{"word " * 12}">'), _where(k % 11 == 0, "<h1>again</h1>")]
    out = audits.agent_readability(_pages(spark, sf_dir).select("page_id", "url", F.concat("html", *parts).alias("html")))
    names = {"title": "has_title", "meta-description": "has_description", "single-h1": "one_h1", "structured-data": "has_data", "main-landmark": "has_main", "image-alt": "has_alt", "internal-links": "has_links"}
    return out.select("page_id", "words", *[(~F.array_contains("failed", name)).alias(c) for name, c in names.items()], "score", "passes", "client_only")



@query("""select p_partkey, ['transactional', 'commercial', 'informational', 'navigational', null, 'transactional'][p_partkey % 6 + 1] as intent from part""")
def keyword_intents(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = (F.col("p_partkey") % 6 + 1).cast("int")
    cues = F.array(*[F.lit(c) for c in ("Sign-up", "A vs. B", "how", "the login", "bestow laptops", "best price")])
    return table(spark, sf_dir, "part").select("p_partkey", audits.intent(F.concat_ws(" ", F.element_at(cues, k), F.col("p_brand"))).alias("intent"))


@query("""with c as (select c_custkey as k, c_custkey % 97 * 0.01 as lat, c_custkey % 89 * 0.01 as lng from customer), s as (select s_suppkey as k, s_suppkey % 83 * 0.01 as lat, s_suppkey % 79 * 0.01 as lng from supplier),
d as (select s.k as place, c.k as other, 2 * 6371.0 * asin(sqrt(power(sin(radians(c.lat - s.lat) / 2), 2) + cos(radians(s.lat)) * cos(radians(c.lat)) * power(sin(radians(c.lng - s.lng) / 2), 2))) as km from s, c)
select place, count(*) as competitors, round(min(km), 3) as nearest from d where km <= 3 group by 1""")
def competitors_in_radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = lambda k, a, b: (((F.col(k) % a) * 0.01).alias("lat"), ((F.col(k) % b) * 0.01).alias("lng"))
    places = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("place"), *at("s_suppkey", 83, 79))
    others = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("other"), *at("c_custkey", 97, 89))
    return audits.nearby(places, others, 3.0)


@query("select page_id from pages where regexp_matches(url, '^[a-z]+://([^/?#:@]+\\.)?example\\.com([:/?#]|$)')")
def web_graph_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _pages(spark, sf_dir).select("page_id", F.concat_ws("\t", F.lit("7"), F.lower(ux.host(F.col("url")))).alias("value"))
    return audits.graph_rows(lines, "example.com").select("page_id")
