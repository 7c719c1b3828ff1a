"""Queries of name, address and phone against listings: customers, and listings that Spark makes of them with changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.operators import listings
from sightline.registry import query, table

PLATFORMS = ["maps", "bing", "osm"]
# both engines read these; p is the platform's number
_OWN = "c_custkey as business, c_name || ' Ltd.' as name, (c_custkey % 7) || ' ' || c_mktsegment || ' Street, N' || c_nationkey as address, case when c_custkey % 13 = 0 then null else '+49 30 ' || (1000000 + c_custkey * 37) end as phone"
_LISTING = """c_custkey * 3 + p as listing, p, case (c_custkey + p) % 5 when 0 then c_name || ' ltd' when 1 then lower(substring(c_name, 2)) when 2 then 'Other ' || c_custkey when 3 then upper(c_name) else c_name || 'x' end as name,
 case (c_custkey + p) % 4 when 0 then (c_custkey % 7) || ' ' || c_mktsegment || ' St N' || c_nationkey when 1 then (c_custkey % 7) || ' ' || c_mktsegment || ' st, N' || c_nationkey || '.' when 2 then 'Elsewhere ' || c_nationkey else (c_custkey % 7) || ' ' || c_mktsegment || ' Strt N' || c_nationkey end as address,
 case (c_custkey * 7 + p) % 6 when 0 then '0049/30/' || (1000000 + c_custkey * 37) when 1 then null when 2 then '030 ' || (1000001 + c_custkey * 37) else '(030) ' || (1000000 + c_custkey * 37) end as phone"""
_WHERE = "(c_custkey + p * 5) % 11 <> 0"


def _words(text: str, kept: str) -> str:
    return f"list_filter(regexp_split_to_array(lower({text}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '' {kept})"


_NAME = f"nullif(array_to_string({_words('name', 'and w not in (' + ', '.join(repr(x) for x in listings.LEGAL_FORMS) + ')')}, ' '), '')"
_SHORT = "case w " + " ".join(f"when '{a}' then '{b}'" for a, b in listings.SHORT_FORMS.items()) + " else w end"
_ADDRESS = f"nullif(array_to_string(list_transform({_words('address', '')}, lambda w: {_SHORT}), ' '), '')"
_PHONE = "nullif(right(regexp_replace(phone, '[^0-9]+', '', 'g'), 9), '')"
_NORMAL = f"{_NAME} as n, {_ADDRESS} as a, {_PHONE} as t"


def _near(c: str) -> str:
    return f"levenshtein(x.{c}, y.{c}) <= 1"


def _state(c: str, within: bool) -> str:
    inside = f" or contains(x.{c}, y.{c}) or contains(y.{c}, x.{c})" if within else ""
    return f"case when x.{c} is null or y.{c} is null then 'missing' when x.{c} = y.{c} then 'exact' when {_near(c)}{inside} then 'partial' else 'conflicting' end"


_COMPARED = f"""with own as (select {_OWN} from customer), lst as (select {_LISTING} from customer, (select unnest([0, 1, 2]) as p) where {_WHERE}),
x as materialized (select business, {_NORMAL} from own), y as materialized (select listing, p, {_NORMAL} from lst),
pairs as (select business, listing from x join y on x.n = y.n and ({_near("a")} or {_near("t")}) union select business, listing from x join y on x.a = y.a and ({_near("n")} or {_near("t")})
 union select business, listing from x join y on x.t = y.t and ({_near("n")} or {_near("a")})),
s as (select business, listing, ['maps', 'bing', 'osm'][p + 1] as platform, {_state("n", True)} as name, {_state("a", True)} as address, {_state("t", False)} as phone from pairs join x using (business) join y using (listing))"""


def _tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, sf_dir, "customer")
    each = rows.withColumn("p", F.explode(F.sequence(F.lit(0), F.lit(2)))).where(_WHERE)
    platform = F.element_at(F.array(*[F.lit(p) for p in PLATFORMS]), F.col("p") + 1)
    return spark.sql(f"select {_OWN} from {{rows}}", rows=rows), spark.sql(f"select {_LISTING} from {{each}}", each=each).withColumn("platform", platform)


@query(f"{_COMPARED} select *, array_to_string(list_filter([if(name = 'conflicting', 'Critical: name', null), if(address = 'conflicting', 'High: address', null), if(phone = 'conflicting', 'Medium: phone', null)], lambda v: v is not null), ',') as issues from s")
def listing_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's listings, with the state of name, address and phone."""
    return listings.compared(*_tables(spark, sf_dir)).withColumn("issues", F.array_join("issues", ","))


@query(f"""{_COMPARED}, g as (select business, count(*) as listings, sum((name = 'exact')::int + (address = 'exact')::int + (phone = 'exact')::int) as e, sum((name <> 'missing')::int + (address <> 'missing')::int + (phone <> 'missing')::int) as k, list(distinct platform) as on_ from s group by 1)
select business, coalesce(listings, 0) as listings, e / k as share, array_to_string(list_filter(['maps', 'bing', 'osm'], lambda v: not coalesce(list_contains(on_, v), false)), ',') as unclaimed from own left join g using (business)""")
def listing_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each customer how many listings there are, how consistent they are, and which platforms have none."""
    own, made = _tables(spark, sf_dir)
    return listings.consistency(listings.compared(own, made), own, PLATFORMS).withColumn("unclaimed", F.array_join("unclaimed", ","))
