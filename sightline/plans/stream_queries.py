"""Queries that run a stream over whole tables to its end."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.registry import query
from sightline.sources import shared
from sightline.streaming import drift, windows

#: Events as snapshots of a page for each user: what is compared follows from type, value and properties.
_SNAPSHOTS = {
    "status_code": "if(event_type = 'error', 500, 200)",
    "title": "nullif(event_type, 'view')",
    "meta_description": "substring(props, 1, 7)",
    "canonical": "if(value < 20, null, concat('https://x.example/', event_type))",
    "robots": "if(event_type = 'signup', 'NoIndex, follow', null)",
    "h1": "case when event_type in ('click', 'view') then 'abcd' when event_type = 'error' then 'wxyz' end",
    "schema_hash": "if(event_type in ('click', 'view'), md5(event_type), null)",
    "html_hash": "md5(props)",
    "perf_score": "value",
}


def snapshots(events: DataFrame) -> DataFrame:
    """events as snapshots of the stream's schema."""
    lists = {
        "h2": F.array(F.substring("props", 1, 8)),
        "schema_types": F.expr("case event_type when 'click' then array('Product') when 'view' then array('FAQPage') else array() end").cast("array<string>"),
        "og": F.expr("if(event_type = 'click', map('og:title', props), map())").cast("map<string,string>"),
        "metrics": F.create_map(F.lit("lcp"), F.col("value")),
    }
    made = events.select(F.col("event_id").alias("id"), F.expr("concat('HTTPS://u', user_id, '.Example:443/p/?utm_source=', event_type)").alias("url"), F.col("ts").cast("timestamp").alias("ts"), *[F.expr(e).alias(c) for c, e in _SNAPSHOTS.items()], *[e.alias(c) for c, e in lists.items()])
    return made.select(*[F.col(f.split()[0]).cast(f.split(" ", 1)[1]) for f in drift.SNAPSHOT.split(", ")])


_NOT_EMPTY = "coalesce({0}, '') <> ''"
_RULES = [
    ("schema_removed", "if(o.types = ['FAQPage'], 'WARNING', 'CRITICAL')", "len(o.types) > 0 and len(n.types) = 0"),
    ("canonical_changed", "'CRITICAL'", "o.canonical <> n.canonical"),
    ("canonical_removed", "'CRITICAL'", "o.canonical is not null and n.canonical is null"),
    ("noindex_added", "'CRITICAL'", "o.robots is null and n.robots is not null"),
    ("h1_removed", "'CRITICAL'", "o.h1 is not null and n.h1 is null"),
    ("h1_changed", "'CRITICAL'", "o.h1 <> n.h1"),
    ("title_removed", "'CRITICAL'", "o.title is not null and n.title is null"),
    ("status_code_error", "'CRITICAL'", "o.status_code = 200 and n.status_code = 500"),
    ("title_changed", "'WARNING'", "o.title <> n.title"),
    ("meta_description_changed", "'WARNING'", "o.meta_description <> n.meta_description"),
    ("cwv_regressed", "'WARNING'", "o.perf_score > 0 and n.perf_score > o.perf_score * 1.2"),
    ("perf_score_dropped", "'WARNING'", "o.perf_score - n.perf_score >= 10"),
    ("og_tags_removed", "'WARNING'", "o.event_type = 'click' and n.event_type <> 'click'"),
    ("schema_modified", "'WARNING'", "o.schema_hash <> n.schema_hash"),
    ("schema_added", "'INFO'", "len(o.types) = 0 and len(n.types) > 0"),
    ("h2_structure_changed", "'INFO'", "substring(o.props, 1, 8) is distinct from substring(n.props, 1, 8)"),
    ("content_hash_changed", "'INFO'", "o.html_hash is not null and o.html_hash is distinct from n.html_hash"),
]


@query(f"""with s as (select *, {", ".join(f"{e} as {c}" for c, e in _SNAPSHOTS.items())}, case event_type when 'click' then ['Product'] when 'view' then ['FAQPage'] else [] end as types from events),
p as (select s as n, lag(s) over (partition by user_id order by event_id) as o from s)
select substring(sha256('https://u' || n.user_id || '.example/p'), 1, 16) as url_hash, o.event_id as baseline_id, n.event_id as snapshot_id, r.rule, r.severity
from p, lateral (values {", ".join(f"('{rule}', {severity}, {test})" for rule, severity, test in _RULES)}) r(rule, severity, triggered) where o is not null and r.triggered""")
def drift_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events replayed as a stream of snapshots, each judged against the page's last one, which is state."""
    events = windows.table_stream(spark, f"{sf_dir}/events.parquet", windows.EVENTS)
    base = f"{shared.folder(spark)}/sightline-{uuid.uuid4().hex}-drift-stream"
    drift.run(drift.findings(drift.pairs(snapshots(events))).where("triggered").drop("triggered"), f"{base}/out", f"{base}/state")
    return spark.read.parquet(f"{base}/out")
