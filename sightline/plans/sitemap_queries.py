"""Queries of sitemaps: files that orders and their lines make, five customers a site, found and crawled."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.operators import sitemaps
from sightline.registry import query, table

#: A site's budget of pages.
MAX_PAGES = 40

# both engines read these: an order's site and file, whether it is an index, what a line of it is listed as, and a line's own file
_SITE = "'https://c' || cast(floor(o_custkey / 5) as int) || '.example'"
_ORDER = f"{_SITE} || '/o' || o_orderkey || '.xml'"
_LINE = f"{_SITE} || '/l' || l_orderkey || '-' || l_partkey || '-' || l_suppkey || '.xml'"
_PAGE = f"{_SITE} || '/p' || l_partkey || '?a=1&b=' || l_linenumber % 2"
_OWN = f"{_SITE} || '/p' || l_partkey", f"{_SITE} || '/s' || l_suppkey"
_INDEX = "o_orderpriority = '1-URGENT'"


def _xml(root: str, locs) -> F.Column:
    entries = F.transform(locs, lambda x: F.concat(F.lit("<x:url><x:loc>\n "), F.replace(x, F.lit("&"), F.lit("&amp;")), F.lit(" </x:loc></x:url>")))
    return F.concat(F.lit(f'<?xml version="1.0"?><!-- <loc>https://no.example/</loc> --><x:{root} xmlns:x="urn:x"><x:loc/>'), F.array_join(entries, "\n"), F.lit(f"</x:{root}>"))


def _fetched(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """files(url, status, content_type, text) and robots(site, text)."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    listed = F.struct("l_linenumber", "l_partkey", "l_suppkey", F.when(F.expr(_INDEX), F.expr(_LINE)).otherwise(F.expr(_PAGE)).alias("u"))
    of_order = lines.groupBy(F.expr(_ORDER).alias("url"), F.expr(_INDEX).alias("i"), "o_orderkey").agg(F.transform(F.array_sort(F.collect_list(listed)), lambda x: x["u"]).alias("locs"))
    order_files = of_order.select("url", F.expr("if(o_orderkey % 11 = 0, 404, 200)").alias("status"), F.when(F.col("i"), _xml("SitemapIndex", F.col("locs"))).otherwise(_xml("urlset", F.col("locs"))).alias("text"))
    line_files = lines.where(f"{_INDEX} and l_linenumber <> 3").select(F.expr(_LINE).alias("url"), F.lit(200).alias("status"), _xml("urlset", F.array(*[F.expr(e) for e in _OWN])).alias("text"))
    of_site = orders.groupBy(F.expr(_SITE).alias("site")).agg(F.array_sort(F.collect_list("o_orderkey")).alias("keys"))
    file = lambda k: F.concat("site", F.lit("/o"), k.cast("string"), F.lit(".xml"))
    site_files = of_site.select(F.concat("site", F.lit("/sitemap.xml")).alias("url"), F.lit(200).alias("status"), _xml("sitemapindex", F.transform(F.reverse("keys"), file)).alias("text"))
    files = order_files.unionByName(line_files).unionByName(site_files).withColumn("content_type", F.lit("application/xml"))
    told = F.transform(F.filter("keys", lambda k: k % 8 == 0), lambda k: F.concat(F.lit(" SITEMAP: "), file(k), F.lit(" ")))
    return files, of_site.select("site", F.concat(F.lit("User-agent: *\r\n"), F.array_join(told, "\n")).alias("text"))


_TRIED = f"""with o as (select {_SITE} as site, {_ORDER} as url, {_INDEX} as i, * from orders),
paths as (select unnest({list(sitemaps.COMMON_PATHS)}) as path, unnest(range(4)) as n), sites as (select distinct site from o),
told as (select site, url, row_number() over (partition by site order by o_orderkey) - 1 as k, count(*) over (partition by site) as n from o where o_orderkey % 8 = 0)"""


@query(f"""{_TRIED}, n as (select s.site, coalesce(max(t.n), 0) as n from sites s left join told t using (site) group by 1),
c as (select site, k as pos, url, 'robots.txt' as source from told where k < 16 union all select site, least(n.n, 16) + paths.n, site || path, 'common_path' from n, paths),
f as (select o.url, case when o_orderkey % 11 = 0 then 404 else 200 end as status, case when i then 'sitemapindex' else 'urlset' end as kind from o where o_orderkey in (select l_orderkey from lineitem)
 union all select site || '/sitemap.xml', 200, 'sitemapindex' from sites)
select site, cast(pos as int) as pos, c.url, false as query_redacted, source, false as cross_host, cast(n.n as int) as n_declared, status, case when status = 200 then kind end as kind, coalesce(status = 200, false) as valid,
 case when status is null then 'not fetched' when status <> 200 then 'HTTP ' || status end as error from c join n using (site) left join f on c.url = f.url""")
def sitemap_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each site's robots.txt and the common paths hold."""
    files, robots = _fetched(spark, sf_dir)
    return sitemaps.candidates(robots, files)


# levels as joins of their own: the first queue, what its indexes list, and what those list; places are numbered at the end
_CRAWLED = f"""{_TRIED}, l as (select o.site, o.url as parent, o.i, o.o_orderkey, l_linenumber, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey) as pos, {_LINE} as line, {_PAGE} as page, {_OWN[0]} as own0, {_OWN[1]} as own1 from lineitem join o on l_orderkey = o_orderkey),
entries as (select parent, i, pos, case when i then line else page end as loc from l where o_orderkey % 11 <> 0
 union all select line, false, 0, own0 from l where i and l_linenumber <> 3 union all select line, false, 1, own1 from l where i and l_linenumber <> 3
 union all select site || '/sitemap.xml', true, -o_orderkey, url from o),
v0 as (select site, url, k from told union all select site, site || path, 1000000 + n from sites, paths),
w1 as (select v.site, e.loc as url, min((v.k, e.pos)) as q from v0 v join entries e on v.url = e.parent and e.i group by 1, 2),
v1 as (select site, url, row_number() over (partition by site order by q) as k from w1 where not exists (select 1 from v0 where v0.site = w1.site and v0.url = w1.url)),
w2 as (select v.site, e.loc as url, min((v.k, e.pos)) as q from v1 v join entries e on v.url = e.parent and e.i group by 1, 2),
v2 as (select site, url, row_number() over (partition by site order by q) as k from w2 where not exists (select 1 from (from v0 union all from v1) x where x.site = w2.site and x.url = w2.url)),
v as (select site, url, row_number() over (partition by site order by level, k) as place from (select *, 0 as level from v0 union all select *, 1 from v1 union all select *, 2 from v2) qualify place <= {sitemaps.MAX_FILES}),
p as (select v.site, e.loc as url, min((place, pos)) as q from v join entries e on v.url = e.parent and not e.i group by 1, 2)"""


@query(f"{_CRAWLED} select site, cast(row_number() over (partition by site order by q) - 1 as int) as pos, url from p qualify pos < {MAX_PAGES}")
def sitemap_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first pages of each site in the order in which its sitemaps are read."""
    files, robots = _fetched(spark, sf_dir)
    return sitemaps.pages(files, robots, MAX_PAGES)
