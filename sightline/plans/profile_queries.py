"""Queries of commerce profiles: texts made from parts, with every kind of error, and read back by their JSON alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.operators import profiles
from sightline.registry import query, table

_K = "cast(p_partkey as string)"
_KINDS = [k.rsplit(".", 1)[1] for k in profiles.CAPABILITIES]
# members by remainders that have no common factor, so that errors of all kinds meet; both engines read these
_VERSION = f"""case p_partkey % 5 when 0 then '' when 1 then '"version":null,' when 2 then '"version":2,' else '"version":"v' || {_K} || '",' end"""
_MERCHANT = f"""case p_partkey % 7 when 0 then '' when 1 then '"merchant":null,' when 2 then '"merchant":{{"name":"","id":' || {_K} || '}},' when 3 then '"merchant":{{"name":7,"id":null}},' when 4 then '"merchant":[],'
 else '"merchant":{{"id":"m' || {_K} || '","name":"' || p_name || '"}},' end"""
_CAP = f"""'{{"id":"dev.ucp.shopping.' || case p_size % {len(_KINDS) + 1} {" ".join(f"when {i} then '{k}'" for i, k in enumerate(_KINDS))} else 'gift' end || '",' || if(p_size % 3 = 0, '', '"version":"' || p_size || '",') || '"endpoint":' || if(p_size % 4 = 0, 'null', '"https://e.example/' || {_K} || '"') || '}}'"""
_LIST = f"""case p_partkey % 11 when 0 then '"x":0' when 1 then '"capabilities":null' when 2 then '"capabilities":{{}}' when 3 then '"capabilities":[]' when 4 then '"capabilities":[3,' || {_CAP} || ',null,[1]]'
 when 5 then '"capabilities":[{{"id":"","version":1}},{{"id":4,"endpoint":"e"}},{{}}]' when 6 then '"capabilities":[' || {_CAP} || ',{{"id":"own.' || p_size || '","version":"1","endpoint":{{"a":1}}}},' || {_CAP} || ']' else '"capabilities":[' || {_CAP} || ']' end"""
_PAYLOAD = f"case p_partkey % 13 when 0 then '{{broken' when 1 then '[1]' when 2 then '\"text\"' when 3 then 'null' when 4 then null else '{{' || {_VERSION} || {_MERCHANT} || {_LIST} || '}}' end"
_STATUS = "case p_partkey % 17 when 0 then 404 when 1 then 503 when 2 then null else 200 end"

_SQL = f"""with t as (select p_partkey, {_PAYLOAD} as t, {_STATUS} as status from part), p as (select p_partkey, status, case when json_valid(t) then cast(t as json) end as v from t),
m as (select *, json_type(v) = 'OBJECT' as ok, json_type(v, '$.version') as tv, json_type(v, '$.merchant') as tm, json_type(v, '$.merchant.name') as tn, json_type(v, '$.capabilities') as tc from p),
c as (select *, case when tc = 'ARRAY' then json_extract(v, '$.capabilities[*]') else [] end as l from m),
x as (select p_partkey, unnest(l) as x, unnest(range(len(l))) as idx from c),
y as (select p_partkey, cast(idx as int) as idx, json_type(x) = 'OBJECT' as ok, x ->> '$.id' as id, x ->> '$.version' as version, x ->> '$.endpoint' as endpoint, json_type(x, '$.id') = 'VARCHAR' and x ->> '$.id' <> '' as named,
 concat_ws(',', if(coalesce(json_type(x, '$.id') = 'VARCHAR' and x ->> '$.id' <> '', false), null, 'missing-id'), if(json_type(x, '$.version') is null, 'missing-version', null), if(json_type(x, '$.endpoint') is null, 'missing-endpoint', null)) as issues from x),
g as (select p_partkey, count(*) filter (ok) as n, count(*) filter (not ok) as n_bad, string_agg('capability-' || idx || '-not-object', ',' order by idx) filter (not ok) as bad, string_agg(id, ',' order by idx) filter (ok and named and id not in {tuple(profiles.CAPABILITIES)}) as unknown from y group by 1)"""


def _profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles.parsed(table(spark, sf_dir, "part").select("p_partkey", F.expr(_STATUS).alias("status"), F.expr(_PAYLOAD).alias("payload")))


@query(f"""{_SQL}, i as (select c.*, g.n, g.n_bad, g.unknown, concat_ws(',', case when v is null then 'invalid-json' when not ok then 'profile-not-object' end, case when ok and tv is null then 'missing-version' when tv <> 'VARCHAR' then 'version-not-string' end,
 case when ok and tm is null then 'missing-merchant' when tm <> 'OBJECT' then 'merchant-not-object' when tm = 'OBJECT' and not coalesce(tn = 'VARCHAR' and v ->> '$.merchant.name' <> '', false) then 'merchant-name-empty' end,
 case when ok and tc is null then 'missing-capabilities' when tc <> 'ARRAY' then 'capabilities-not-array' end, g.bad) as issues from c left join g using (p_partkey))
select p_partkey, v is not null as valid_json, case when tv = 'VARCHAR' then v ->> '$.version' end as version, case when tm = 'OBJECT' then v ->> '$.merchant.name' end as merchant_name, case when tm = 'OBJECT' then v ->> '$.merchant.id' end as merchant_id,
 cast(coalesce(n, 0) as int) as n_capabilities, issues, coalesce(unknown, '') as unknown_capabilities, case when status is null then 'fetch-failed' when status = 404 then 'no-ucp-profile (forward-looking opportunity)' when status >= 400 then 'http-' || status || ' on discovery'
 else 'profile-found: ' || coalesce(n, 0) || ' capabilities, ' || (if(issues = '', 0, len(string_split(issues, ',')))) || ' structural issues' end as summary from i""")
def commerce_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each profile holds and lacks."""
    joined = lambda c: F.array_join(c, ",").alias(c)
    out = _profiles(spark, sf_dir).withColumn("summary", profiles.summary(F.col("status"), F.col("capabilities"), F.col("issues")))
    return out.select("p_partkey", "valid_json", "version", "merchant_name", "merchant_id", F.size("capabilities").alias("n_capabilities"), joined("issues"), joined("unknown_capabilities"), "summary")


_PURPOSE = " ".join("when '" + k + "' then '" + d + "'" for k, d in profiles.CAPABILITIES.items())


@query(f"{_SQL} select p_partkey, idx, id, version, endpoint, case id {_PURPOSE} else '{profiles.UNKNOWN}' end as purpose, issues from y where ok")
def profile_capabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each capability of each profile with what it is for."""
    return profiles.capabilities(_profiles(spark, sf_dir)).withColumn("issues", F.array_join("issues", ",")).drop("status")
