"""Queries of vendor payloads and structured data: texts that Spark makes of whole tables, read back by the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.operators import jsonld
from sightline.registry import query, table
from sightline.sources import envelopes
from sightline.sources.shared import spread

# an item of a vendor for each part; both engines read these expressions. The second item has other keys
_K = "cast(p_partkey as string)"
_ITEM = f"""'{{"title":"' || p_name || '","type":"' || p_type || '","rank_absolute":' || if(p_partkey % 2 = 0, 'null', {_K}) || ',"rank_group":' || {_K} || ',"link":"https://x.example/' || {_K} || '","snippet":"a \\\\"b\\\\" {{"'
 || ',"keyword":null,"se_keyword":"' || p_brand || '","keyword_info.search_volume":' || cast(p_size as string) || ',"keyword_info":{{"search_volume":-1}},"cpc":1.25,"keyword_properties":{{"a":[1,null],"b":null}},"dofollow":' || if(p_size > 25, 'true', 'false')
 || ',"shop_name":"s' || {_K} || '","domain":"d.example","current_price":' || cast(p_size as string) || ',"asin":"A' || {_K} || '","meta.title":null,"status_code":200,"checks":{{"is_https":true}}}}'"""
_OTHER = f"""'{{"url":"https://y.example/","url_from":"https://z.example/' || {_K} || '","anchor":"' || p_name || '","rank":"' || p_brand || '","first_seen":null,"price":0,"rating":{{"value":4.5}},"product_id":' || {_K} || ',"search_volume":0,"meta.title":"m","items":null}}'"""
_PAYLOAD = f"""case p_partkey % 7 when 0 then '{{"status_code":20000,"tasks":[{{"cost":0.5,"result":[{{"items":[' || {_ITEM} || ',' || {_OTHER} || ']}},' || {_OTHER} || ']}},{{"cost":"1","result":null}},{{"cost":2,"result":[{{"items":[]}}]}}]}}'
 when 1 then '{{"tasks":[{{"result":[' || {_ITEM} || ']}}],"status_code":"20000"}}' when 2 then '[' || {_ITEM} || ',3,' || {_OTHER} || ']' when 3 then {_ITEM} when 4 then '{{broken' when 5 then '{{"tasks":[],"cost":9}}' end"""

_PARSED = f"with p as (select p_partkey, case when json_valid({_PAYLOAD}) then cast({_PAYLOAD} as json) end as v from part)".replace('\\\\"', '\\"')
_LIST = """case when json_type(v, '$.tasks') = 'ARRAY' then flatten(list_transform(json_extract(v, '$.tasks[*]'), lambda t: flatten(list_transform(json_extract(t, '$.result[*]'), lambda r: if(json_type(r, '$.items') = 'ARRAY', json_extract(r, '$.items[*]'), [r])))))
 when json_type(v) = 'ARRAY' then json_extract(v, '$[*]') when v is not null then [v] else [] end"""


def _taken(keys: tuple[str, ...]) -> str:
    return "coalesce(" + ", ".join(f"""case when json_type(item, '$."{k}"') <> 'NULL' then cast(json_extract(item, '$."{k}"') as varchar) end""" for k in keys) + ", null)"


def _module_sql(module: str) -> str:
    named = ", ".join(f"{_taken(keys)} as {name}" for name, keys in envelopes.MODULES[module].items())
    return f"{_PARSED}, i as (select p_partkey, unnest(l) as item, unnest(range(len(l))) as pos from (select p_partkey, {_LIST} as l from p)) select p_partkey, cast(pos as int) as pos, {named} from i"


def _payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = spread(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size"))
    return parts.select("p_partkey", F.expr(_PAYLOAD).alias("payload"))


def _module(module: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return envelopes.written(envelopes.normalized(_payloads(spark, sf_dir), module))

    run.__name__ = f"vendor_{module}"
    run.__doc__ = f"Items of payloads of each shape as rows of the module {module}."
    return query(_module_sql(module))(run)


vendor_serp, vendor_keywords, vendor_backlinks, vendor_merchant, vendor_onpage = (_module(m) for m in envelopes.MODULES)


@query(f"""{_PARSED} select p_partkey, case when json_type(v, '$.status_code') in ('BIGINT', 'UBIGINT') then cast(json_extract(v, '$.status_code') as bigint) end as status_code,
 coalesce(list_sum(list_transform(json_extract(v, '$.tasks[*]'), lambda t: case when json_type(t, '$.cost') in ('BIGINT', 'UBIGINT', 'DOUBLE') then cast(json_extract(t, '$.cost') as double) else 0 end)), 0) as cost_usd,
 cast(len({_LIST}) as int) as row_count from p""")
def vendor_envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status, cost and number of items of each payload."""
    return envelopes.envelopes(_payloads(spark, sf_dir))


@query(f"""{_PARSED}, k as (select p_partkey, unnest(json_keys(v)) as key, unnest(range(len(json_keys(v)))) as i from p where json_type(v) = 'OBJECT'),
f as (select key, min((p_partkey, i)) as seen from k group by 1) select cast(row_number() over (order by seen) - 1 as int) as position, key from f""")
def vendor_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All top-level keys of the payloads, in first-seen order."""
    return envelopes.key_union(_payloads(spark, sf_dir), "p_partkey", "payload")


@query(f"""{_PARSED}, i as (select p_partkey, unnest(l) as item, unnest(range(len(l))) as pos from (select p_partkey, {_LIST} as l from p)),
m as (select p_partkey, pos, e.key, e.value, e.id, e.type from i, lateral (select unnest(map_entries(cast(item as map(varchar, json)))) as kv) u, lateral (select u.kv.key as key, u.kv.value as value, 0 as id, json_type(u.kv.value) as type) e where json_type(item) = 'OBJECT')
select p_partkey, cast(pos as int) as pos, cast(count(*) as int) as members, sum(cast(replace(cast(value as varchar), '"b":null', '') <> cast(value as varchar) as int))::int as nested from m where type <> 'NULL' group by 1, 2""")
def vendor_items_without_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of each item that are left when nulls go, and how many of them had a null further down."""
    found = envelopes.items(_payloads(spark, sf_dir)).select("p_partkey", "pos", F.to_json("item").alias("j")).withColumn("s", envelopes.without_nulls(F.col("j")))
    found = found.where(F.col("j").startswith("{"))
    nested = F.contains("j", F.lit('"b":null')).cast("int") - F.contains("s", F.lit('"b":null')).cast("int")
    return found.select("p_partkey", "pos", F.size(F.json_object_keys("s")).alias("members"), nested.alias("nested"))


def _opt(name: str, value: str) -> str:
    return f"""coalesce(',"{name}":' || {value}, '')"""


def _text(value: str) -> str:
    return f"""'"' || {value} || '"'"""


_PHONE, _CITY, _LAT, _MAIL = "case when c_custkey % 3 = 0 then null else 'T' || c_custkey end", "case when c_custkey % 2 = 0 then n_name end", "case when c_custkey % 5 = 0 then null else c_nationkey + 0.5 end", "case when c_custkey % 4 = 0 then 'm' || c_custkey end"


@query(f"""select c_custkey, '{{"@context":"https://schema.org","@type":"Store","name":"' || c_name || '"' || {_opt("url", _text("case when c_custkey % 7 <> 0 then 'https://' || c_custkey || '.example/' end"))} || {_opt("telephone", _text(_PHONE))}
 || case when c_custkey % 2 = 0 then ',"address":{{"@type":"PostalAddress","addressLocality":"' || n_name || '","addressCountry":"C' || c_nationkey || '"}}' else '' end
 || case when c_custkey % 5 <> 0 then ',"geo":{{"@type":"GeoCoordinates","latitude":' || c_nationkey || '.5,"longitude":-' || (c_nationkey + 1) || '.5}}' else '' end
 || case when c_custkey % 6 = 0 then '' else ',"openingHours":["Mo","' || c_mktsegment || '"]' end || '}}' as json from customer join nation on n_nationkey = c_nationkey""")
def generated_local_business(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A shop's block for each customer; members of what it lacks are left out."""
    rows = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    made = rows.selectExpr("c_custkey", "'Store' as business_type", "c_name as name", "case when c_custkey % 7 <> 0 then 'https://' || c_custkey || '.example/' end as url", f"{_PHONE} as telephone", f"{_CITY} as city", "'C' || c_nationkey as country", f"{_LAT} as latitude", "-1.5D - c_nationkey as longitude", "if(c_custkey % 6 = 0, array(), array('Mo', c_mktsegment)) as hours")
    return jsonld.generated(made, "local_business").select("c_custkey", "json")


@query("""select s_suppkey, '{"@context":"https://schema.org","@type":"Organization","name":"' || s_name || '"' || case when s_suppkey % 2 = 0 then ',"sameAs":["https://' || s_nationkey || '.example"]' else '' end
 || case when s_suppkey % 3 <> 0 then ',"contactPoint":{"@type":"ContactPoint","contactType":"customer support"' || case when s_suppkey % 3 = 1 then ',"telephone":"T"' else '' end || case when s_suppkey % 3 = 2 then ',"email":"E"' else '' end || '}' else '' end || '}' as json from supplier""")
def generated_organization(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An organisation's block for each supplier."""
    made = table(spark, sf_dir, "supplier").selectExpr("s_suppkey", "s_name as name", "if(s_suppkey % 2 = 0, array('https://' || s_nationkey || '.example'), array()) as same_as", "if(s_suppkey % 3 = 1, 'T', null) as telephone", "if(s_suppkey % 3 = 2, 'E', null) as email")
    return jsonld.generated(made, "organization").select("s_suppkey", "json")


@query("""select o_orderkey, '{"@context":"https://schema.org","@type":"' || case when o_custkey % 2 = 0 then 'FoodEstablishmentReservation' else 'LodgingReservation' end || '","reservationStatus":"https://schema.org/ReservationConfirmed","provider":{"@type":"Organization","name":"P' || o_custkey || '"},"reservationFor":{"@type":"'
 || case when o_custkey % 2 = 0 then 'FoodEstablishment' else 'Place' end || '","name":"' || case when o_orderkey % 3 = 0 then 'Hall' else 'P' || o_custkey end || '"},"startTime":"' || strftime(o_orderdate, '%Y-%m-%d') || '"' || case when o_orderstatus = 'F' then ',"partySize":' || (o_custkey % 9) else '' end || ',"reservationId":"' || o_orderkey || '"'
 || case when o_orderkey % 4 = 0 then ',"underName":{"@type":"Person","email":"E"}' else '' end || '}' as json from orders""")
def generated_reservation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A booking's block for each order."""
    made = table(spark, sf_dir, "orders").selectExpr("o_orderkey", "if(o_custkey % 2 = 0, 'FoodEstablishmentReservation', 'LodgingReservation') as reservation_kind", "'P' || o_custkey as provider", "if(o_orderkey % 3 = 0, 'Hall', null) as reservation_for_name", "date_format(o_orderdate, 'yyyy-MM-dd') as start", "if(o_orderstatus = 'F', o_custkey % 9, null) as party_size", "cast(o_orderkey as string) as reservation_id", "if(o_orderkey % 4 = 0, 'E', null) as customer_email")
    return jsonld.generated(made, "reservation").select("o_orderkey", "json")
