"""Addresses in URLs that both engines write from customers' numbers in eight notations; the SQL knows the numbers and parses nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.functions import addresses
from sightline.registry import query, table

#: The first two parts of an address, of which each network that isn't public has some and borders on others.
_PAIRS = ((127, 0), (10, 1), (100, 64), (100, 128), (169, 254), (172, 31), (172, 32), (192, 168), (192, 0), (198, 19), (198, 51), (203, 0), (8, 8), (239, 1), (0, 0), (1, 1))
_A = "case c_custkey % 16 " + " ".join(f"when {i} then {a}" for i, (a, _) in enumerate(_PAIRS)) + " end"
_B = "case c_custkey % 16 " + " ".join(f"when {i} then {b}" for i, (_, b) in enumerate(_PAIRS)) + " end"
_NUMBERS = f"select cast(c_custkey as bigint) as k, cast({_A} as bigint) as a, cast({_B} as bigint) as b, cast(case c_custkey % 5 when 0 then 0 when 1 then 2 when 2 then 100 when 3 then 113 else 7 end as bigint) as c, cast(c_custkey * 31 % 256 as bigint) as d from customer"
_N = "(a * 16777216 + b * 65536 + c * 256 + d)"


def _octal(x: str) -> str:
    return f"'0' || cast(cast(floor({x} / 64) as int) as varchar(9)) || cast(cast(floor({x} / 8) as int) % 8 as varchar(9)) || cast({x} % 8 as varchar(9))"


_DOTTED = "a || '.' || b || '.' || c || '.' || d"
_SIX = "case d % 5 when 0 then 'fc12' when 1 then 'FE8' || hex(c % 16) when 2 then 'ff02' when 3 then '2001:db8' else '2606:4700' end"
_NOTATION = "(k - k % 16) % 128 / 16"
_URLS = f"""select k, a, b, c, d, {_NOTATION} as f, 'http://' || case {_NOTATION} when 0 then {_DOTTED} when 1 then '0X' || hex({_N}) when 2 then cast({_N} as varchar(20)) when 3 then {" || '.' || ".join(_octal(x) for x in "abcd")}
 when 4 then a || '.' || b || '.' || (c * 256 + d) || '.' when 5 then '[::ffff:' || {_DOTTED} || ']' when 6 then '[0:0::FFFF:' || hex(a * 256 + b) || ':' || hex(c * 256 + d) || ']' else '[' || {_SIX} || '::' || hex(c) || ':' || hex(d) || ']' end || ':8080/p' as url from n"""
_CLOSED = f"""a in (10, 127) or a >= 224 or {_N} = 0 or (a = 100 and b between 64 and 127) or (a = 169 and b = 254) or (a = 172 and b between 16 and 31) or (a = 192 and (b = 168 or (b = 0 and c in (0, 2)))) or (a = 198 and (b in (18, 19) or (b = 51 and c = 100))) or (a = 203 and b = 0 and c = 113)"""


@query(f"""with n as ({_NUMBERS}), u as ({_URLS})
select k, url, case when f < 7 and not ({_CLOSED}) or f = 7 and d % 5 >= 3 then true else false end as is_safe, case when f < 5 then {_DOTTED} end as quad, case when f in (5, 6) then {_N} end as mapped, case when f = 7 then c * 65536 + d end as low from u""")
def url_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a server may fetch each URL, and the address that its host means."""
    rows = _written(spark, table(spark, sf_dir, "customer"))
    url = F.col("url")
    host, six = addresses.host(url), addresses.ipv6(addresses.host(url))
    mapped = addresses.mapped_ipv4(six)
    return rows.select("k", "url", addresses.safe(url).alias("is_safe"), F.when(~host.startswith("["), host).alias("quad"), mapped.alias("mapped"), F.when(mapped.isNull(), six["low"]).alias("low"))


def _written(spark: SparkSession, customer: DataFrame) -> DataFrame:
    n = spark.sql(_NUMBERS.replace("from customer", "from {customer}"), customer=customer)
    return spark.sql(_URLS.replace("from n", "from {n}"), n=n).select("k", "url")
