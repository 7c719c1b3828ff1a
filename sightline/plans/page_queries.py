"""Queries over pages: extraction, links, section risk, URLs and the link graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.functions import text as tx
from sightline.functions import urls as ux
from sightline.operators import content, markup, pages
from sightline.registry import query, table

_PARTS = r"'^([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?(#.*)?$'"
_HOST = rf"lower(regexp_replace(regexp_replace(regexp_extract(url, {_PARTS}, 2), '^.*@', ''), ':\d*$', ''))"
_STRIP = "regexp_replace(coalesce(html, ''), '(?s)<!--.*?-->', ' ', 'g')"
for _tag in ("script", "style", "nav", "footer", "header", "noscript", "template"):
    _STRIP = f"regexp_replace(regexp_replace({_STRIP}, '(?is)<{_tag}\\b[^>]*>.*?</{_tag}\\s*>', ' ', 'g'), '(?i)<{_tag}\\b[^>]*>', ' ', 'g')"
_VISIBLE = f"regexp_replace({_STRIP}, '<[^>]*>', ' ', 'g')"
for _a, _b in pages.ENTITIES:
    _VISIBLE = "replace(" + _VISIBLE + ", '" + _a + "', '" + _b.replace("'", "''") + "')"
_VISIBLE = f"trim(regexp_replace({_VISIBLE}, '[ \\t\\n\\f\\r]+', ' ', 'g'))"


def _element(tag: str) -> str:
    return f"if(regexp_matches(html, '(?i)<{tag}[\\s>]'), trim(regexp_replace(regexp_replace(regexp_extract(html, '(?is)<{tag}(?:\\s[^>]*)?>(.*?)</{tag}\\s*>', 1), '<[^>]*>', ' ', 'g'), '[ \\t\\n\\f\\r]+', ' ', 'g')), null)"


_WORDS = f"len(list_filter(regexp_split_to_array({_VISIBLE}, '[^\\p{{L}}\\p{{N}}_]+'), lambda x: x <> ''))"


@query(f"""select page_id, url, {_element("title")} as title, {_element("h1")} as h1, {_WORDS} as words, len(list_filter(string_split_regex(html, '(?i)<a\\s')[2:], lambda x: regexp_matches(x, '(?i)^(?:[^>]*?\\s)?href\\s*='))) as links,
 len(regexp_extract_all(html, '(?i)<p[\\s>]')) as paragraphs, len(regexp_extract_all(html, '(?i)<script')) as scripts, {_WORDS} < 100 and len(regexp_extract_all(html, '(?i)<script')) >= 3 as is_spa from pages""")
def page_outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.outline(table(spark, sf_dir, "pages"))


# hrefs are cut out of whole opening tags here, and anchors end where any tag of a link follows
_TAG = r"'(?i)<a\s[^>]*>'"
_LINKS = rf"""with c as (select page_id, url, unnest(range(1, len(x))) as i, x from (select page_id, url, string_split_regex(html, '(?i)<a\s') as x from pages)),
l as (select page_id, url, row_number() over (partition by page_id order by i) - 1 as pos, regexp_extract(x[i + 1], '(?i)^(?:[^>]*?\s)?href\s*=\s*["'']?([^"''\s>]*)', 1) as href, string_split_regex(regexp_replace(x[i + 1], '^[^>]*>', ''), '(?i)</a[\s>]')[1] as anchor from c where regexp_matches(x[i + 1], '(?i)^(?:[^>]*?\s)?href\s*=')),
k as (select page_id, url, pos, trim(href) as href, substring(trim(regexp_replace(regexp_replace(anchor, '<[^>]*>', ' ', 'g'), '[ \t\n\f\r]+', ' ', 'g')), 1, 100) as anchor from l),
f as (select *, lower(regexp_extract(url, {_PARTS}, 1)) as scheme, lower(regexp_extract(url, {_PARTS}, 2)) as auth, regexp_extract(url, {_PARTS}, 3) as path from k where href <> '' and not starts_with(href, '#') and not starts_with(lower(href), 'javascript:')),
t as (select *, case when regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.\-]*:') then href when starts_with(href, '//') then scheme || ':' || href when starts_with(href, '/') then scheme || '://' || auth || href
 else scheme || '://' || auth || if(path = '', '/', regexp_extract(path, '^(.*/)', 1)) || href end as target from f),
g as (select page_id, url, pos, href, anchor, target, {_HOST.replace("(url,", "(target,")} = {_HOST} as is_internal from t)"""


@query(_LINKS + " select * exclude (url) from g")
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.links(table(spark, sf_dir, "pages"))


@query(_LINKS + """, e as (select distinct url as src, target as dst from g where is_internal and url <> target), n as (select dst, count(*) as incoming from e group by dst),
o as (select url as node from pages union select target from g where is_internal)
select node, coalesce(incoming, 0) as incoming, incoming is null as is_orphan, coalesce(incoming, 0) >= 3 as well_linked from o left join n on node = dst""")
def link_in_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = table(spark, sf_dir, "pages")
    rows = pages.links(every).where("is_internal").join(every.select("page_id", "url"), "page_id")
    edges = rows.select(F.col("url").alias("src"), F.col("target").alias("dst"))
    return pages.in_degrees(edges, edges.select(F.col("dst").alias("node")).union(every.select("url")).distinct())


def _first(url: str) -> str:
    return f"regexp_extract(regexp_extract({url}, {_PARTS}, 3), '^/+([^/]+)', 1)"


_SECTION = f"if({_first('url')} = '', '/', '/' || {_first('url')} || '/')"
# wording that the driver's pages have, so that every branch of the rules is seen
_WORDING = ("(?i)(?:class=.ad.|Sponsored)", "(?i)(?:track|var t)", "(?i)(?:ref=|page=|id=)")


def _risk_sql(third: str, commerce: str, affiliate: str) -> str:
    return f"""with h as (select {_SECTION} as section, url, len(regexp_extract_all(html, '{third}')) as tp, len(regexp_extract_all(html, '{commerce}')) as cm, len(regexp_extract_all(html, '{affiliate}')) as af from pages),
s as (select section, list_sort(list(url)) as sample_urls from (select distinct section, url from h qualify dense_rank() over (partition by section order by url) <= 3) group by section),
r as (select section, count(*) as page_count, avg(tp) as tp, avg(cm) as cm, avg(af) as af from h group by section), m as (select *, avg(cm) over () as mean, round(cm * 100) / 100 as rcm from r),
f as (select *, list_filter([if(tp >= 1, 'third-party-authorship-density', null), if(cm >= 2, 'commercial-intent-skew', null), if(af >= 3, 'affiliate-density', null), if(mean > 0 and rcm > 2 * mean, 'commercial-intent-drift', null)], lambda x: x is not null) as flags from m),
o as (select section, page_count, round(tp * 100) / 100 as third_party_per_page, rcm as commerce_per_page, round(af * 100) / 100 as affiliate_per_page, array_to_string(flags, ',') as flags,
 case when tp >= 1 or (cm >= 2 and af >= 3) then 'high' when len(flags) > 0 then 'medium' else 'low' end as risk, array_to_string(sample_urls, ' ') as sample_urls from f join s using (section))"""


def _risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    third, commerce, affiliate = _WORDING
    return pages.section_risk(table(spark, sf_dir, "pages"), third, commerce, affiliate, bounded=False)


@query(_risk_sql(*_WORDING) + " select * from o")
def section_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _risk(spark, sf_dir).withColumn("flags", F.array_join("flags", ",")).withColumn("sample_urls", F.array_join("sample_urls", " "))


@query(_risk_sql(*_WORDING) + " select count(*) filter (risk = 'high') as high, count(*) filter (risk = 'medium') as medium, count(*) filter (risk = 'low') as low, case when count(*) filter (risk = 'high') > 0 then 'high' when count(*) filter (risk = 'medium') > 0 then 'medium' else 'low' end as overall from o")
def section_risk_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.risk_summary(_risk(spark, sf_dir))


@query()
def section_risk_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fixed wording with whole words."""
    return pages.section_risk(table(spark, sf_dir, "pages"))


_NORMAL = f"""with p as (select page_id, url, lower(regexp_extract(url, {_PARTS}, 1)) as scheme, lower(regexp_replace(regexp_extract(url, {_PARTS}, 2), '^.*@', '')) as auth, regexp_replace(regexp_extract(url, {_PARTS}, 3), '/+$', '') as path,
 list_sort(list_filter(string_split(regexp_replace(regexp_extract(url, {_PARTS}, 4), '^\\?', ''), '&'), lambda x: x <> '' and not list_contains({list(ux.TRACKING)}, string_split(x, '=')[1]))) as q from pages),
n as (select page_id, url, scheme || '://' || case scheme when 'http' then regexp_replace(auth, ':80$', '') when 'https' then regexp_replace(auth, ':443$', '') else auth end || if(path = '', '/', path) || if(len(q) > 0, '?' || array_to_string(q, '&'), '') as normalized from p)"""


@query(_NORMAL + f" select page_id, normalized, substring(sha256(normalized), 1, 16) as url_hash, {_HOST} as host, {_SECTION} as section, regexp_extract(url, '^(https?://[^/?#]+)', 1) as origin, array_to_string(list_reverse(string_split(regexp_replace({_HOST}, '^www\\.', ''), '.')), '.') as reversed_host from n")
def url_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", ux.normalized(u).alias("normalized"), ux.url_hash(u).alias("url_hash"), ux.host(u).alias("host"), ux.section(u).alias("section"), ux.origin(u).alias("origin"), ux.reversed_host(ux.host(u)).alias("reversed_host"))


@query(f"select {_element('title')} as title, count(*) as pages, min(page_id) as first_page from pages group by 1 having count(*) > 1")
def duplicate_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    titles = table(spark, sf_dir, "pages").select("page_id", pages.element_text(F.col("html"), "title").alias("title"))
    return titles.groupBy("title").agg(F.count(F.lit(1)).alias("pages"), F.min("page_id").alias("first_page")).where("pages > 1")


@query(f"select page_id, length({_element('title')}) as title_length, length({_element('title')}) between 30 and 60 as title_ok, {_WORDS} >= 300 as words_ok from pages")
def page_quality_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = pages.element_text(F.col("html"), "title")
    return table(spark, sf_dir, "pages").select("page_id", F.length(title).alias("title_length"), F.length(title).between(30, 60).alias("title_ok"), (tx.word_count(pages.visible(F.col("html"))) >= 300).alias("words_ok"))


@query()
def page_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markup.elements(table(spark, sf_dir, "pages"))


@query()
def page_block_citability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks between headings, scored as passages and averaged for each page."""
    blocks = markup.blocks(table(spark, sf_dir, "pages")).drop("word_count")
    scored = content.citability(blocks, "content", "heading")
    return content.page_citability(scored, "url", "pos")
