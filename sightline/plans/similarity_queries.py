"""Queries of near-duplicate pages, unique content and near-duplicate records over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.operators import pages, similarity
from sightline.plans.page_queries import _VISIBLE
from sightline.registry import query, table

# shingles as texts, and sets by joins of all pages that share one
_SETS = f"""with w as (select page_id, list_filter(regexp_split_to_array(lower({_VISIBLE}), '[^\\p{{L}}\\p{{N}}_]+'), lambda x: x <> '') as w from pages),
s as materialized (select distinct page_id, unnest(list_transform(range(1, greatest(len(w) - 2, 1) + 1), lambda i: array_to_string(w[i:i + 2], ' '))) as t from w where len(w) > 0),
n as (select w.page_id, len(w) as words, count(t) as n, coalesce(string_agg(t, '|' order by t), cast(w.page_id as varchar)) as k from w left join s using (page_id) group by w.page_id, w.w),
c as materialized (select *, min(page_id) over (partition by k) as class_id, count(*) over (partition by k) as copies from n)"""


def _sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.content_sets(table(spark, sf_dir, "pages"), pages.visible(F.col("html")))


@query(f"""{_SETS}, p as (select a.page_id as a, b.page_id as b, count(*) as shared from s a join s b on a.t = b.t and a.page_id <> b.page_id group by 1, 2),
l as (select a as class_id, count(*) as links, max(shared / (x.n + y.n - shared)) as closest from p join c x on x.page_id = a and x.class_id = a join c y on y.page_id = b and y.class_id = b
  where x.k <> y.k and shared / (x.n + y.n - shared) > 0.8 group by 1)
select page_id, class_id, copies, coalesce(links, 0) as links, closest from c left join l using (class_id)""")
def near_duplicate_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with over 80 % of their three-word shingles in common."""
    return similarity.copies(_sets(spark, sf_dir))


@query(f"""{_SETS}, o as (select page_id, count(*) as own from (select t, min(page_id) as page_id from s group by t having count(*) = 1) group by 1)
select page_id, words, n as shingles, coalesce(own, 0) as own, if(n > 0, coalesce(own, 0) / n, null) as share,
 array_to_string(list_filter([if(coalesce(coalesce(own, 0) / nullif(n, 0), 0) < 0.4, 'thin', null), if(words < 300, 'short', null)], lambda x: x is not null), ',') as flags from c left join o using (page_id)""")
def page_unique_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of each page that stands on no other, with the flags of thin and short pages."""
    out = similarity.unique_content(_sets(spark, sf_dir))
    return out.withColumn("shingles", F.col("shingles").cast("long")).withColumn("flags", F.array_join("flags", ","))


_FIELDS = ("split_part(p_name, ' ', 1)", "split_part(p_name, ' ', 2)", "p_brand", "p_type", "p_size", "cast(floor(p_retailprice / 500) as int)")
_AS = ", ".join(f"{f} as f{i}" for i, f in enumerate(_FIELDS))
_AGREE = " + ".join(f"(x.f{i} is not distinct from y.f{i})::int" for i in range(6))


def _records_sql(differ: int) -> str:
    return f"""with r as (select p_partkey, {_AS} from part), g as (select *, min(p_partkey) over (partition by f0, f1, f2, f3, f4, f5) as class_id, count(*) over (partition by f0, f1, f2, f3, f4, f5) as copies from r),
k as (select * from g where p_partkey = class_id), l as (select x.class_id, count(*) as links from k x join k y on x.class_id <> y.class_id and {_AGREE} >= {6 - differ} group by 1)
select p_partkey, class_id, copies, coalesce(links, 0) as links from g left join l using (class_id)"""


def _near_parts(spark: SparkSession, sf_dir: str, share: float) -> DataFrame:
    rows = table(spark, sf_dir, "part").selectExpr("p_partkey", *[f"{f} as f{i}" for i, f in enumerate(_FIELDS)])
    return similarity.near_records(rows, "p_partkey", [f"f{i}" for i in range(6)], share)


@query(_records_sql(1))
def near_duplicate_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that agree in over 80 % of six fields: one may differ."""
    return _near_parts(spark, sf_dir, similarity.COPY)


@query(_records_sql(2))
def loosely_duplicate_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that agree in over 60 % of six fields: two may differ."""
    return _near_parts(spark, sf_dir, 0.6)
