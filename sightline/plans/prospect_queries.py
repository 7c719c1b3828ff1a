"""Queries of prospects: events of the table as adds, updates, notes and audits of each user's domain, folded at once and as a stream."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.operators import prospects
from sightline.registry import query, table
from sightline.sources import shared
from sightline.streaming import prospects as stream
from sightline.streaming import windows

#: Both engines read these; domains and stages come in several forms, errors have a stage that is unknown.
_EVENTS = {
    "version": "event_id",
    "domain": "case user_id % 3 when 0 then 'https://www.U' || user_id || '.Example/' when 1 then ' http://u' || user_id || '.example//' else 'U' || user_id || '.EXAMPLE' end",
    "kind": "case event_type when 'signup' then 'add' when 'view' then 'note' when 'purchase' then 'audit' else 'update' end",
    "name": "case when event_id % 2 = 0 then 'N' || event_id end",
    "email": "case when event_id % 3 = 0 then 'e' || event_id || '@mail.example' end",
    "stage": "case event_type when 'signup' then 'Lead' when 'error' then 'Closed' else case event_id % 4 when 0 then 'Qualified' when 1 then 'proposal-Sent' when 2 then ' WON ' end end",
    "value": "case when event_id % 5 < 3 then value end",
    "text": "props",
    "score": "case when event_id % 11 > 0 then value end",
    "report": "case when event_id % 7 = 0 then 'r' || event_id end",
}


def events(rows: DataFrame) -> DataFrame:
    """events of the table as prospects.EVENT."""
    made = rows.select(F.col("ts").cast("timestamp").alias("ts"), *[F.expr(e).alias(c) for c, e in _EVENTS.items()])
    return made.select(*[F.col(f.split()[0]).cast(f.split()[1]) for f in prospects.EVENT.split(", ")])


_BY_SQL = f"""with e as (select ts, {", ".join(f"{e} as {c}" for c, e in _EVENTS.items() if c not in ("domain", "stage"))}, 'u' || user_id || '.example' as domain,
 case trim(lower({_EVENTS["stage"]})) when 'lead' then 'lead' when 'qualified' then 'qualified' when 'proposal-sent' then 'proposal_sent' when 'won' then 'won' end as stage from events where event_type <> 'error'),
a as (select domain, min(version) as first from e where kind = 'add' group by domain),
k as (select e.* from e join a using (domain) where version > first and kind <> 'add'), b as (select e.* from e join a on e.domain = a.domain and version = first)"""
_SHOW = "strftime({}, '%Y-%m-%d %H:%M:%S')"
_LATEST_SQL = f"""{_BY_SQL}, g as (select domain, arg_max(stage, version) filter (kind = 'update' and stage is not null) as stage, arg_max(value, version) filter (kind = 'update' and value is not null) as value, max_by(ts, version) as ts,
 arg_max(text, version) filter (kind = 'note') as text, least(count(*) filter (kind = 'audit'), 2) as audits from k group by domain)
select b.domain, coalesce(b.name, b.domain) as name, b.email, coalesce(g.stage, b.stage) as stage, coalesce(g.value, b.value) as deal_value, {_SHOW.format("b.ts")} as created_at, {_SHOW.format("coalesce(g.ts, b.ts)")} as updated_at, g.text as last_note, coalesce(g.audits, 0)::int as audits
from b left join g using (domain)"""


def _shown(latest: DataFrame) -> DataFrame:
    day = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return latest.select("domain", "name", "email", "stage", "deal_value", day("created_at"), day("updated_at"), "last_note", F.size("audits").alias("audits"))


def _latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prospects.latest(prospects.merged(prospects.partial(events(table(spark, sf_dir, "events")))))


@query(_LATEST_SQL)
def prospect_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each prospect's latest state from its events."""
    return _shown(_latest(spark, sf_dir))


@query(f"select * from ({_LATEST_SQL}) where stage = 'proposal_sent'")
def prospects_with_proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(prospects.in_stage(_latest(spark, sf_dir), "Proposal sent"))


@query(f"""{_BY_SQL}, r as (select *, row_number() over (partition by domain order by version desc) as place from k where kind = 'audit'),
d as (select c.domain, p.ts as pt, c.ts as ct, coalesce(p.score, 0) as previous, coalesce(c.score, 0) as "current" from r c join r p on c.domain = p.domain and c.place = 1 and p.place = 2)
select domain, {_SHOW.format("pt")} as previous_at, {_SHOW.format("ct")} as current_at, previous, "current", round(("current" - previous) * 100) / 100 as delta, round(case when previous > 0 then ("current" - previous) / previous * 100 else 0 end * 10) / 10 as delta_pct,
 case when "current" > previous then 'improved' when "current" < previous then 'regressed' else 'flat' end as direction from d""")
def prospect_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last two audits of each prospect."""
    day = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return prospects.deltas(_latest(spark, sf_dir)).withColumn("previous_at", day("previous_at")).withColumn("current_at", day("current_at"))


@query(_LATEST_SQL)
def prospect_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a stream into a stored table of prospects, read again."""
    store = f"{shared.folder(spark)}/sightline-{uuid.uuid4().hex}-prospects"
    stream.upsert(events(windows.table_stream(spark, f"{sf_dir}/events.parquet", windows.EVENTS)), store, f"{store}-checkpoint")
    return _shown(prospects.latest(stream.state(spark, store)))
