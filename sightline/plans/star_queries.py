"""Queries over the star schema: every kind of join, grouping, window, set operation and top-k, on the analytics' terms.

Segments stand for pipeline stages, order priorities for endpoints, orders for keywords and parts for results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sightline.functions import text as tx
from sightline.operators import markets, series
from sightline.registry import query, table

STAGES = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY", "WON", "LOST")


@query("""with dim as (select unnest(range(0, 7))::int as pos, unnest(['AUTOMOBILE','BUILDING','FURNITURE','HOUSEHOLD','MACHINERY','WON','LOST']) as stage)
select pos, stage, count(c_custkey) as deals, round(coalesce(sum(c_acctbal), 0) * 1e5) / 1e5 as value, stage not in ('WON', 'LOST') as is_open from dim left join customer on c_mktsegment = stage group by pos, stage""")
def pipeline_by_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    deals = table(spark, sf_dir, "customer").select(F.col("c_name").alias("domain"), F.col("c_mktsegment").alias("stage"), F.col("c_acctbal").alias("value"))
    return markets.pipeline(deals, STAGES, "WON", "LOST")


@query("""select o_orderpriority as endpoint, count(*) as calls, round(sum(o_totalprice) * 1e5) / 1e5 as cost, grouping(o_orderpriority)::int as is_total from orders group by rollup (o_orderpriority)""")
def spend_by_endpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markets.spend(table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("endpoint"), F.col("o_totalprice").alias("cost")))


@query("""select round(sum(o_totalprice) * 1e5) / 1e5 as spent, round((1000000 - round(sum(o_totalprice) * 1e5) / 1e5) * 1e5) / 1e5 as remaining, sum(o_totalprice) > 1000000 as over_budget from orders""")
def budget_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markets.budget(table(spark, sf_dir, "orders").select(F.col("o_totalprice").alias("cost")), 1_000_000.0)


@query("""with s as (select p_brand, count(p_retailprice) as n, min(p_retailprice) as low, quantile_cont(p_retailprice, 0.25) as p25, median(p_retailprice) as median, quantile_cont(p_retailprice, 0.75) as p75, max(p_retailprice) as high, avg(p_retailprice) as m, stddev_samp(p_retailprice) as sd from part group by p_brand)
select s.p_brand, n, low, p25, median, p75, high, o.outliers from s join (select p_brand, count(*) filter (abs(p_retailprice - m) > 2 * sd) as outliers from part join s using (p_brand) group by p_brand) o using (p_brand)""")
def price_stats_by_brand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markets.price_stats(table(spark, sf_dir, "part"), ["p_brand"], "p_retailprice")


_SERP = "with s as (select distinct l_suppkey as k, l_partkey as i from lineitem)"


@query(_SERP + " select a.k as a, b.k as b, count(*) as shared, case when count(*) >= 7 then 'same page' when count(*) >= 4 then 'same cluster' when count(*) >= 2 then 'interlink' else 'separate' end as band from s a join s b on a.i = b.i and a.k < b.k group by 1, 2 having count(*) >= 2")
def keyword_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    serp = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey")
    return markets.overlap(serp, "l_suppkey", "l_partkey", 2).withColumn("band", markets.overlap_band(F.col("shared")))


@query(_SERP.replace("with s", "with recursive s") + """, p as (select a.k as a, b.k as b from s a join s b on a.i = b.i and a.k < b.k group by 1, 2 having count(*) >= 4),
e as (select a, b from p union select b, a from p), r as (select a as node, a as c from e union select e.b, r.c from r join e on e.a = r.node) select node, min(c) as cluster from r group by node""")
def keyword_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    serp = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey")
    return markets.clusters(markets.overlap(serp, "l_suppkey", "l_partkey", 4).select("a", "b"))


@query("""with o as (select distinct s_nationkey as d from supplier where s_acctbal > 5000), t as (select distinct c_nationkey as d from customer where c_acctbal > 9000)
select coalesce(o.d, t.d) as domain, case when o.d is null then 'competitor only' when t.d is null then 'ours only' else 'both' end as state from o full join t on o.d = t.d""")
def referring_domain_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    ours = table(spark, sf_dir, "supplier").where("s_acctbal > 5000").select(F.lit("us").alias("site"), F.col("s_nationkey").alias("domain"))
    theirs = table(spark, sf_dir, "customer").where("c_acctbal > 9000").select(F.lit("them").alias("site"), F.col("c_nationkey").alias("domain"))
    return markets.domain_gap(ours.unionByName(theirs), "us", "them")


@query("""with m as (select o_orderpriority as priority, date_trunc('month', o_orderdate)::date as month, round(sum(o_totalprice) * 100) / 100 as spend from orders group by 1, 2), l as (select *, lag(spend) over (partition by priority order by month) as previous from m)
select priority, month, spend, previous, spend - previous as delta, if(previous <> 0, round((spend - previous) / previous * 100 * 10) / 10, null) as delta_pct, case when spend > previous then 'up' when spend < previous then 'down' else 'flat' end as direction from l where previous is not null""")
def month_over_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    month = F.date_trunc("month", F.col("o_orderdate")).cast("date")
    sums = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("priority"), month.alias("month")).agg(tx.half_up(F.sum("o_totalprice"), 2).alias("spend"))
    return series.deltas(sums, ["priority"], "month", "spend")


@query("""select o_custkey, o_orderkey, o_orderdate from orders qualify row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) = 1""")
def latest_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("o_custkey").orderBy(F.col("o_orderdate").desc(), F.col("o_orderkey").desc())
    return table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate").withColumn("r", F.row_number().over(order)).where("r = 1").drop("r")


@query("""select n_name, r_name, count(*) as orders, round(sum(o_totalprice) * 100) / 100 as spend from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by 1, 2""")
def spend_by_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: table(spark, sf_dir, n)
    joined = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.groupBy("n_name", "r_name").agg(F.count(F.lit(1)).alias("orders"), tx.half_up(F.sum("o_totalprice"), 2).alias("spend"))


@query("""select l_returnflag, l_linestatus, sum(l_quantity) as sum_qty, round(sum(l_extendedprice * (1 - l_discount)) * 100) / 100 as revenue, round(avg(l_discount) * 1e5) / 1e5 as avg_disc, count(*) as n from lineitem where l_shipdate <= timestamp '1998-09-02' group by 1, 2""")
def pricing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").where("l_shipdate <= timestamp_ntz '1998-09-02'")
    revenue = F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount")))
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), tx.half_up(revenue, 2).alias("revenue"), tx.half_up(F.avg("l_discount"), 5).alias("avg_disc"), F.count(F.lit(1)).alias("n"))


@query("""select p_brand, p_size, count(*) as n, grouping(p_brand)::int as g_brand, grouping(p_size)::int as g_size from part group by cube (p_brand, p_size)""")
def price_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").cube("p_brand", "p_size").agg(F.count(F.lit(1)).alias("n"), F.grouping("p_brand").cast("int").alias("g_brand"), F.grouping("p_size").cast("int").alias("g_size"))


@query("""select p_brand, p_type, count(*) as n from part group by grouping sets ((p_brand), (p_type), ())""")
def parts_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    return part.groupingSets([[part.p_brand], [part.p_type], []], part.p_brand, part.p_type).agg(F.count(F.lit(1)).alias("n"))


@query("""select c_custkey, c_name from customer where not exists (select 1 from orders where o_custkey = c_custkey)""")
def customers_without_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders"), F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("c_custkey", "c_name")


@query("""select s_suppkey from supplier where exists (select 1 from lineitem where l_suppkey = s_suppkey and l_returnflag = 'R' and l_quantity > 45)""")
def suppliers_with_large_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    large = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R' and l_quantity > 45")
    return table(spark, sf_dir, "supplier").join(large, F.col("l_suppkey") == F.col("s_suppkey"), "left_semi").select("s_suppkey")


@query("""select c_nationkey as nationkey from customer intersect select s_nationkey from supplier""")
def nations_of_both(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nationkey")).intersect(table(spark, sf_dir, "supplier").select("s_nationkey"))


@query("""select c_nationkey as nationkey from customer except all select s_nationkey from supplier""")
def nations_left_over(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nationkey")).exceptAll(table(spark, sf_dir, "supplier").select("s_nationkey"))


@query("""select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 20""")
def top_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").orderBy(F.col("o_totalprice").desc(), "o_orderkey").limit(20)


@query("""select p_partkey, rank() over w as rnk, dense_rank() over w as dense, ntile(4) over (partition by p_brand order by p_retailprice, p_partkey) as quartile, round(percent_rank() over w * 1e6) / 1e6 as pct from part window w as (partition by p_brand order by p_retailprice)""")
def price_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("p_brand").orderBy("p_retailprice")
    four = F.ntile(4).over(Window.partitionBy("p_brand").orderBy("p_retailprice", "p_partkey"))
    return table(spark, sf_dir, "part").select("p_partkey", F.rank().over(w).alias("rnk"), F.dense_rank().over(w).alias("dense"), four.alias("quartile"), tx.half_up(F.percent_rank().over(w), 6).alias("pct"))


@query("""select l_suppkey, l_returnflag, round(sum(l_extendedprice) * 100) / 100 as value, round(sum(l_extendedprice) / sum(sum(l_extendedprice)) over (partition by l_suppkey) * 1e6) / 1e6 as share, sum(l_extendedprice) / sum(sum(l_extendedprice)) over (partition by l_suppkey) >= 0.4 as dominant from lineitem group by 1, 2""")
def value_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_returnflag").agg(F.sum("l_extendedprice").alias("value"))
    out = series.shares(sums, ["l_suppkey"], "value")
    return out.select("l_suppkey", "l_returnflag", tx.half_up(F.col("value"), 2).alias("value"), tx.half_up(F.col("share"), 6).alias("share"), "dominant")


_PARTS = "with s as (select s_suppkey, case when s_suppkey % 5 = 0 then null else s_suppkey % 101 end::double as citability, (s_suppkey * 7 % 101)::double as brand, (s_suppkey * 11 % 101)::double as eeat, (s_suppkey * 13 % 101)::double as technical, (s_suppkey * 17 % 101)::double as schema, (s_suppkey * 19 % 101)::double as platform from supplier)"


@query(_PARTS + """, k as (select s_suppkey, round((coalesce(citability, 0) * 0.25 + brand * 0.2 + eeat * 0.2 + technical * 0.15 + schema * 0.1 + platform * 0.1) / (if(citability is null, 0.0, 0.25) + 0.2 + 0.2 + 0.15 + 0.1 + 0.1) * 10) / 10 as score from s)
select s_suppkey, score, case when score >= 90 then 'excellent' when score >= 75 then 'good' when score >= 60 then 'fair' when score >= 40 then 'poor' else 'critical' end as band from k""")
def visibility_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    part = lambda m: ((k * m) % 101).cast("double")
    parts = table(spark, sf_dir, "supplier").select("s_suppkey", F.when(k % 5 != 0, part(1)).alias("citability"), part(7).alias("brand"), part(11).alias("eeat"), part(13).alias("technical"), part(17).alias("schema"), part(19).alias("platform"))
    return markets.weighted(parts, markets.VISIBILITY, markets.VISIBILITY_BANDS).select("s_suppkey", "score", "band")


@query("""with f as (select l_suppkey, count(distinct l_partkey) as n from lineitem group by 1 having count(distinct l_partkey) > 50), e as (select distinct l_suppkey as src, l_partkey as dst from lineitem)
select 'link farm' as pattern, l_suppkey as subject, n from f union all
select 'reciprocal', a.src * 1000000 + a.dst, 1 from e a join e b on a.src = b.dst and a.dst = b.src where a.src < a.dst""")
def toxic_link_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"), F.lit("").alias("anchor"))
    out = markets.toxic_patterns(links)
    return out.select("pattern", F.split("subject", " ").alias("subject"), "n").select("pattern", F.aggregate("subject", F.lit(0).cast("long"), lambda a, x: a * 1_000_000 + x.cast("long")).alias("subject"), "n")
