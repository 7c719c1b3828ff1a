"""Queries over rank files that Spark writes from customers, read again by the rank sources."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.registry import query, table
from sightline.sources import ranks, shared

#: Customers as ranked hosts, one rank file for so many of them: both engines read these.
_PART = 500
_HOSTS = """cast(c_custkey as double) as harmonic_rank, c_acctbal as harmonic_value, cast(c_custkey * 7 % 1009 as double) as pagerank_rank, cast(c_nationkey as double) as pagerank_value,
 case when c_custkey % 9 = 0 then 'example.shop' when c_custkey % 4 = 0 then 'example.n' || c_nationkey || '.example.shop' when c_custkey % 4 = 1 then 'example.shop.c' || c_custkey else 'test.shop' || c_nationkey end as host_reversed"""


def _written(spark: SparkSession, sf_dir: str) -> str:
    """A folder with a folder part=n for each _PART customers, which holds their lines in one gzip file, by rank."""
    rows = table(spark, sf_dir, "customer")
    lines = spark.sql(f"select c_custkey div {_PART} as part, {_HOSTS} from {{rows}}", rows=rows)
    path = f"{shared.folder(spark)}/sightline-{uuid.uuid4().hex}-ranks"
    held = lines.select("part", "harmonic_rank", F.concat_ws("\t", "harmonic_rank", "harmonic_value", "pagerank_rank", "pagerank_value", "host_reversed").alias("line"))
    held.repartition("part").sortWithinPartitions("part", "harmonic_rank").select("part", "line").write.partitionBy("part").text(path, compression="gzip")
    return path


def _part(file: str = "file") -> F.Column:
    return F.regexp_extract(file, r"part=(\d+)/", 1).cast("long").alias("part")


@query(f"""with h as (select c_custkey // {_PART} as part, {_HOSTS} from customer), m as (select *, row_number() over (partition by part order by harmonic_rank) as place from h where host_reversed = 'example.shop' or ends_with(host_reversed, '.example.shop'))
select p.part, m.place::int - 1 as pos, m.harmonic_rank, m.harmonic_value, m.pagerank_rank, m.pagerank_value, m.host_reversed, false as truncated_scan from (select distinct part from h) p left join m on m.part = p.part and place <= 10""")
def rank_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each rank file's first ten lines of a domain, which end its scan; a file without one has a row of nulls."""
    found = ranks.scans(spark, _written(spark, sf_dir), "www.Shop.example")
    return found.select(_part(), "truncated_scan", F.posexplode_outer("matches").alias("pos", "m")).select("part", "truncated_scan", "pos", "m.*")


@query(f"""with h as (select c_custkey // {_PART} as part, {_HOSTS} from customer)
select part, count(*) as hosts, min(harmonic_rank) as best_rank, sum(pagerank_rank) as pagerank_ranks, max(harmonic_value) as value from h where starts_with(host_reversed, 'example.shop') group by part""")
def rank_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts of a domain and below it in each rank file; lines of others end in the reader where filters are pushed."""
    own = ranks.rows(spark, _written(spark, sf_dir)).where(F.col("host_reversed").startswith("example.shop"))
    return own.groupBy(_part()).agg(F.count(F.lit(1)).alias("hosts"), F.min("harmonic_rank").alias("best_rank"), F.sum("pagerank_rank").alias("pagerank_ranks"), F.max("harmonic_value").alias("value"))
