"""Change detection: snapshots of pages against the latest one stored before, as findings of seventeen rules."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sightline.functions import urls as ux

#: Structured-data types without rich results any more; losing only these is a warning (fixed values).
RETIRED = ("FAQPage", "HowTo", "Dataset")
#: Least share by which a metric must grow to count as regressed, and points by which a score must drop.
REGRESSION, DROP = 0.2, 10


def latest(baselines: DataFrame) -> DataFrame:
    """The row with the largest id for each url_hash."""
    order = Window.partitionBy("url_hash").orderBy(F.col("id").desc())
    return baselines.withColumn("r_", F.row_number().over(order)).where("r_ = 1").drop("r_")


def history(rows: DataFrame, n: int = 10) -> DataFrame:
    """The last n rows for each url_hash, the newest first, with their rank."""
    order = Window.partitionBy("url_hash").orderBy(F.col("id").desc())
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def ratio(a: str, b: str) -> float:
    """Twice the matched characters over all: the longest common run, and so on left and right of it."""
    if not a and not b:
        return 1.0
    total, todo = 0, [(0, len(a), 0, len(b))]
    while todo:
        alo, ahi, blo, bhi = todo.pop()
        best, at, bt = 0, alo, blo
        runs: dict[int, int] = {}
        for i in range(alo, ahi):
            new = {}
            for j in range(blo, bhi):
                if a[i] == b[j]:
                    new[j] = k = runs.get(j - 1, 0) + 1
                    if k > best:
                        best, at, bt = k, i - k + 1, j - k + 1
            runs = new
        if best:
            total += best
            todo += [(alo, at, blo, bt), (at + best, ahi, bt + best, bhi)]
    return 2 * total / (len(a) + len(b))


@F.pandas_udf(T.DoubleType())
def similarity(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """ratio() of two columns of short texts; null counts as empty."""
    for a, b in pairs:
        yield pd.Series([ratio(x or "", y or "") for x, y in zip(a, b)], dtype="float64")


#: What findings compare, in a page's current and earlier state.
COLUMNS = ("status_code", "title", "meta_description", "canonical", "robots", "h1", "h2", "schema_types", "schema_hash", "og", "html_hash", "metrics", "perf_score")


def findings(current: DataFrame, baselines: DataFrame) -> DataFrame:
    """current and baselines (id, url and the columns below) -> (url_hash, baseline_id, rule, severity, triggered).

    Columns of both: url, status_code, title, meta_description, canonical, robots, h1, h2 array, schema_types array,
    schema_hash, og map, html_hash, metrics map of p75 values, perf_score. Each current page meets the latest baseline
    of its normalized URL; pages without one give no rows.
    """
    keyed = lambda df, p, *more: df.select(ux.url_hash(F.col("url")).alias("url_hash"), *more, *[F.col(c).alias(p + c) for c in COLUMNS])
    old = latest(keyed(baselines, "o_", "id"))
    return judged(keyed(current, "n_").join(old, "url_hash"))


def replayed(snapshots: DataFrame) -> DataFrame:
    """snapshots(id, url, COLUMNS) -> findings of each snapshot against the one before it of the same normalized URL, with
    snapshot_id: what streaming.drift gives for them as they come in the order of their ids."""
    rows = snapshots.select(ux.url_hash(F.col("url")).alias("url_hash"), F.col("id").alias("snapshot_id"), F.struct(F.col("id").alias("b_id"), *COLUMNS).alias("now")).where("url_hash is not null")
    rows = rows.withColumn("old", F.lag("now").over(Window.partitionBy("url_hash").orderBy("snapshot_id"))).where("old is not null")
    both = rows.select("url_hash", "snapshot_id", F.col("old.b_id").alias("id"), *[F.col(f"old.{c}").alias(f"o_{c}") for c in COLUMNS], *[F.col(f"now.{c}").alias(f"n_{c}") for c in COLUMNS])
    return judged(both, "snapshot_id")


def judged(both: DataFrame, *more: str) -> DataFrame:
    """both(url_hash, id, o_ and n_ COLUMNS, more) -> (url_hash, baseline_id, more, rule, severity, triggered), by all rules."""
    o, n = (lambda c: F.col("o_" + c)), (lambda c: F.col("n_" + c))
    empty = lambda c: F.coalesce(c, F.lit("")) == ""
    none = lambda c: F.coalesce(F.size(c), F.lit(0)) <= 0
    trimmed = lambda c: F.trim(F.coalesce(c, F.lit("")))
    noindex = lambda c: F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lit("noindex"))
    changed = lambda c: ~empty(trimmed(o(c))) & ~empty(trimmed(n(c))) & (trimmed(o(c)) != trimmed(n(c)))
    retired = ~none(o("schema_types")) & F.forall(o("schema_types"), lambda t: t.isin(*RETIRED))
    gone = ~none(o("schema_types")) & none(n("schema_types"))
    worse = F.exists(F.map_keys(o("metrics")), lambda k: (F.element_at(o("metrics"), k) > 0) & (F.element_at(n("metrics"), k) > F.element_at(o("metrics"), k) * (1 + REGRESSION)))
    rules: list[tuple[str, str | Column, Column]] = [
        ("schema_removed", F.when(gone & retired, "WARNING").otherwise("CRITICAL"), gone),
        ("canonical_changed", "CRITICAL", o("canonical") != n("canonical")),
        ("canonical_removed", "CRITICAL", o("canonical").isNotNull() & empty(n("canonical"))),
        ("noindex_added", "CRITICAL", ~noindex(o("robots")) & noindex(n("robots"))),
        ("h1_removed", "CRITICAL", ~empty(o("h1")) & empty(n("h1"))),
        ("h1_changed", "CRITICAL", ~empty(o("h1")) & ~empty(n("h1")) & (F.col("h1_ratio") < 0.5)),
        ("title_removed", "CRITICAL", ~empty(o("title")) & empty(n("title"))),
        ("status_code_error", "CRITICAL", o("status_code").between(200, 399) & (n("status_code") >= 400)),
        ("title_changed", "WARNING", changed("title")),
        ("meta_description_changed", "WARNING", changed("meta_description")),
        ("cwv_regressed", "WARNING", worse),
        ("perf_score_dropped", "WARNING", o("perf_score") - n("perf_score") >= DROP),
        ("og_tags_removed", "WARNING", ~none(F.map_keys(o("og"))) & none(F.map_keys(n("og")))),
        ("schema_modified", "WARNING", o("schema_hash") != n("schema_hash")),
        ("schema_added", "INFO", none(o("schema_types")) & ~none(n("schema_types"))),
        ("h2_structure_changed", "INFO", ~o("h2").eqNullSafe(n("h2"))),
        ("content_hash_changed", "INFO", o("html_hash").isNotNull() & ~o("html_hash").eqNullSafe(n("html_hash"))),
    ]
    row = [F.struct(F.lit(name).alias("rule"), (F.lit(s) if isinstance(s, str) else s).alias("severity"), F.coalesce(t, F.lit(False)).alias("triggered")) for name, s, t in rules]
    return both.withColumn("h1_ratio", similarity(o("h1"), n("h1"))).select("url_hash", F.col("id").alias("baseline_id"), *more, F.inline(F.array(*row)))


def severity_counts(found: DataFrame) -> DataFrame:
    """(url_hash, baseline_id, critical, warning, info, passed) of what was triggered."""
    count = lambda s: F.count_if(F.col("triggered") & (F.col("severity") == s))
    out = found.groupBy("url_hash", "baseline_id").agg(count("CRITICAL").alias("critical"), count("WARNING").alias("warning"), count("INFO").alias("info"))
    return out.withColumn("passed", F.col("critical") == 0)
