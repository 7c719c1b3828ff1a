"""Prospects as a log of events folded to their latest state: the same state in whatever order events come, however often.

A state is mergeable: the first add by version, and for each field the last change by version. Which changes count (those after
the add) is settled when it is read, so an add that comes late needs no replay.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Stages in their order (fixed values).
STAGES = ("lead", "qualified", "proposal_sent", "won", "lost")
KINDS = ("add", "update", "note", "audit")
#: A domain's versions order its events; update may set stage and value, note has text, audit has score and report.
EVENT = "version long, ts timestamp, domain string, kind string, name string, email string, stage string, value double, text string, score double, report string"
_LAST = ("stage", "value", "touched", "note")


def domain(raw: Column) -> Column:
    """A domain as it is stored: trimmed, without scheme, www. and slashes at its end, A-Z in lower case."""
    steps = [r"^(?:https://)+", r"^(?:http://)+", r"^(?:www\.)+", r"/+$"]
    bare = reduce(lambda c, pattern: F.regexp_replace(c, pattern, ""), steps, F.regexp_replace(raw, r"^\s+|\s+$", ""))
    return F.translate(bare, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def stage(raw: Column) -> Column:
    """A stage as it is stored (blanks and hyphens are underscores); null if it is none."""
    held = F.translate(F.lower(F.trim(raw)), " -", "__")
    return F.when(held.isin(*STAGES), held)


def _valid(events: DataFrame) -> DataFrame:
    """Events that may count: a version, a domain, a known kind, an add's stage known, an update's stage known or absent."""
    named = events.select("version", "ts", domain(F.col("domain")).alias("domain"), "kind", "name", "email", F.col("stage").alias("raw"), stage(F.col("stage")).alias("stage"), "value", "text", "score", "report")
    known = F.when(F.col("kind") == "add", F.col("stage").isNotNull()).when(F.col("kind") == "update", F.col("raw").isNull() | F.col("stage").isNotNull()).otherwise(F.col("kind").isin(*KINDS))
    return named.where(F.col("version").isNotNull() & F.col("domain").isNotNull() & known)


def partial(events: DataFrame) -> DataFrame:
    """Events (EVENT) -> states of one event each, which merged() brings together. Refused events are left out."""
    kind = F.col("kind")
    one = lambda test, *cols: F.when(test, F.struct("version", *cols))
    audit = F.struct("version", "ts", "score", "report")
    return _valid(events).select(
        "domain",
        one(kind == "add", "ts", "name", "email", "stage", "value").alias("added"),
        one((kind == "update") & F.col("stage").isNotNull(), F.col("stage").alias("set")).alias("stage"),
        one((kind == "update") & F.col("value").isNotNull(), F.col("value").alias("set")).alias("value"),
        one(kind != "add", "ts").alias("touched"),
        one(kind == "note", "ts", "text").alias("note"),
        F.when(kind == "audit", F.array(audit)).alias("audits"),
    )


def merged(states: DataFrame) -> DataFrame:
    """States of any number for a domain -> one for each: first add, last changes, the last two audits (latest first).

    Least and greatest values by version, then by content, so that repeated rows and versions that clash change nothing.
    A domain's audits are cut to two within each task before they meet.
    """
    fields = states.groupBy("domain").agg(F.min("added").alias("added"), *[F.max(c).alias(c) for c in _LAST])
    each = states.select("domain", F.explode("audits").alias("a")).groupBy("domain", F.col("a.version").alias("version")).agg(F.max("a").alias("a"))
    place = F.row_number().over(Window.partitionBy("domain").orderBy(F.desc("version")))
    two = each.withColumn("place", place).where("place <= 2").groupBy("domain").agg(F.sort_array(F.collect_list("a"), asc=False).alias("audits"))
    return fields.join(two, "domain", "left")


def latest(states: DataFrame) -> DataFrame:
    """merged() -> each prospect that was added: what its last accepted events left. A name that is missing is the domain.

    Changes at or before the add are refused, as are later adds.
    """
    after = lambda c: F.when(F.col(f"{c}.version") > F.col("added.version"), F.col(c))
    audits = F.filter(F.coalesce("audits", F.array()), lambda a: a["version"] > F.col("added.version"))
    return states.where("added is not null").select(
        "domain",
        F.coalesce("added.name", "domain").alias("name"),
        F.col("added.email").alias("email"),
        F.coalesce(after("stage")["set"], "added.stage").alias("stage"),
        F.coalesce(after("value")["set"], "added.value").alias("deal_value"),
        F.col("added.ts").alias("created_at"),
        F.when(F.col("touched.version") > F.col("added.version"), F.col("touched.ts")).otherwise(F.col("added.ts")).alias("updated_at"),
        after("note")["text"].alias("last_note"),
        audits.alias("audits"),
    )


def in_stage(prospects: DataFrame, wanted: str) -> DataFrame:
    """Prospects of a stage, written in any of its forms; a stage that is unknown is an error."""
    held = wanted.strip().lower().replace(" ", "_").replace("-", "_")
    if held not in STAGES:
        raise ValueError(f"unknown stage {wanted!r}; expected one of {', '.join(STAGES)}")
    return prospects.where(F.col("stage") == held)


def deltas(prospects: DataFrame) -> DataFrame:
    """latest() -> for each prospect of two audits or more the last two scores, their difference and direction. No score is 0."""
    both = prospects.where(F.size("audits") >= 2).select("domain", F.col("audits")[1].alias("p"), F.col("audits")[0].alias("c"))
    both = both.select("domain", F.col("p.ts").alias("previous_at"), F.col("c.ts").alias("current_at"), F.coalesce("p.score", F.lit(0.0)).alias("previous"), F.coalesce("c.score", F.lit(0.0)).alias("current"))
    delta = F.col("current") - F.col("previous")
    share = F.when(F.col("previous") > 0, delta / F.col("previous") * 100).otherwise(0.0)
    direction = F.when(delta > 0, "improved").when(delta < 0, "regressed").otherwise("flat")
    return both.select("*", (F.round(delta * 100) / 100).alias("delta"), (F.round(share * 10) / 10).alias("delta_pct"), direction.alias("direction"))
