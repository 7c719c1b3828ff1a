"""Vendor payloads, one JSON text a row, as flat tables. A payload that isn't JSON gives a row of nulls or none."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

METRICS = {"first_contentful_paint_ms": "first-contentful-paint", "largest_contentful_paint_ms": "largest-contentful-paint", "total_blocking_time_ms": "total-blocking-time", "cumulative_layout_shift": "cumulative-layout-shift", "speed_index_ms": "speed-index", "time_to_first_byte_ms": "server-response-time"}
SCORES = {"performance": "performance", "seo": "seo", "accessibility": "accessibility", "best_practices": "best-practices"}


def lab_audit(rows: DataFrame) -> DataFrame:
    """rows(url, payload) of lab audits -> url, four scores of 100, six metrics, opportunities (the ten largest savings)."""
    v = F.try_parse_json("payload")
    score = lambda k: F.round(F.try_variant_get(v, f"$.lighthouseResult.categories['{k}'].score", "double") * 100)
    number = lambda k: F.try_variant_get(v, f"$.lighthouseResult.audits['{k}'].numericValue", "double")
    kind = "map<string,struct<title:string,details:struct<type:string,overallSavingsMs:double>>>"
    audits = F.map_entries(F.from_json(F.get_json_object("payload", "$.lighthouseResult.audits"), kind))
    useful = F.filter(audits, lambda e: (e["value"]["details"]["type"] == "opportunity") & (e["value"]["details"]["overallSavingsMs"] > 0))
    ranked = F.array_sort(F.transform(useful, lambda e: F.struct((-e["value"]["details"]["overallSavingsMs"]).alias("minus"), e["key"].alias("id"), e["value"]["title"].alias("title"))))
    best = F.transform(F.slice(ranked, 1, 10), lambda e: F.struct(e["id"].alias("id"), e["title"].alias("title"), (-e["minus"]).alias("savings_ms")))
    return rows.select("url", *[score(k).alias(n) for n, k in SCORES.items()], *[number(k).alias(n) for n, k in METRICS.items()], best.alias("opportunities"))


def field_metrics(rows: DataFrame) -> DataFrame:
    """rows(url, payload) of field records -> (url, metric, p75), p75 from a number or a text that is one."""
    kind = "map<string,struct<percentiles:struct<p75:string>>>"
    metrics = F.from_json(F.get_json_object("payload", "$.record.metrics"), kind)
    return rows.select("url", F.explode(metrics).alias("metric", "m")).select("url", "metric", F.col("m.percentiles.p75").try_cast("double").alias("p75"))


def field_history(rows: DataFrame) -> DataFrame:
    """rows(url, payload) of field histories -> (url, metric, period, p75), nulls kept."""
    kind = "map<string,struct<percentilesTimeseries:struct<p75s:array<string>>>>"
    metrics = F.from_json(F.get_json_object("payload", "$.record.metrics"), kind)
    per = rows.select("url", F.explode(metrics).alias("metric", "m"))
    return per.select("url", "metric", F.posexplode("m.percentilesTimeseries.p75s").alias("period", "v")).select("url", "metric", "period", F.col("v").try_cast("double").alias("p75"))


def search_rows(rows: DataFrame, dimensions: list[str]) -> DataFrame:
    """rows(property, payload) of search analytics -> property, the named dimensions, clicks, impressions, ctr, position."""
    kind = "array<struct<keys:array<string>,clicks:double,impressions:double,ctr:double,position:double>>"
    each = rows.select("property", F.explode(F.from_json(F.get_json_object("payload", "$.rows"), kind)).alias("r"))
    return each.select("property", *[F.get("r.keys", F.lit(i)).alias(d) for i, d in enumerate(dimensions)], "r.clicks", "r.impressions", "r.ctr", "r.position")


def report_rows(rows: DataFrame, dimensions: list[str], metrics: list[str]) -> DataFrame:
    """rows(property, payload) of analytics reports -> property, the named dimensions and metrics (as numbers)."""
    kind = "array<struct<dimensionValues:array<struct<value:string>>,metricValues:array<struct<value:string>>>>"
    each = rows.select("property", F.explode(F.from_json(F.get_json_object("payload", "$.rows"), kind)).alias("r"))
    return each.select("property", *[F.get("r.dimensionValues", F.lit(i))["value"].alias(d) for i, d in enumerate(dimensions)], *[F.get("r.metricValues", F.lit(i))["value"].try_cast("double").alias(m) for i, m in enumerate(metrics)])


def entities(rows: DataFrame) -> DataFrame:
    """rows(id, payload) of language analysis -> (id, name, kind, salience, mentions), the most salient first in `rank`."""
    kind = "array<struct<name:string,type:string,salience:double,mentions:array<string>>>"
    each = F.from_json(F.get_json_object("payload", "$.entities"), kind)
    order = F.array_sort(F.transform(each, lambda e: F.struct((-e["salience"]).alias("minus"), e["name"].alias("name"), e["type"].alias("kind"), F.size(e["mentions"]).alias("mentions"))))
    return rows.select("id", F.posexplode(order).alias("rank", "e")).select("id", "rank", "e.name", "e.kind", (-F.col("e.minus")).alias("salience"), "e.mentions")


def whois(rows: DataFrame) -> DataFrame:
    """rows(domain, text) -> domain, created, expires (dates), registrar: the first line of each label that has a value."""
    field = lambda names: F.nullif(F.trim(F.regexp_extract(F.coalesce("text", F.lit("")), rf"(?im)^\s*(?:{names})\s*:[ \t]*(\S.*)$", 1)), F.lit(""))
    day = lambda c: F.coalesce(F.try_to_date(F.substring(c, 1, 10), "yyyy-MM-dd"), F.try_to_date(F.regexp_extract(c, r"(\d{2}-[A-Za-z]{3}-\d{4})", 1), "dd-MMM-yyyy"), F.try_to_date(F.regexp_extract(c, r"(\d{2}\.\d{2}\.\d{4})", 1), "dd.MM.yyyy"))
    return rows.select("domain", day(field("creation date|created on|created|registered on")).alias("created"), day(field("registry expiry date|expiry date|expires on|paid-till")).alias("expires"), field("registrar|sponsoring registrar").alias("registrar"))
