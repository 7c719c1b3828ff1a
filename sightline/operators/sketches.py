"""Mergeable sketches of a day's rows, stored once and merged into any longer period: distinct ids, ids seen again, quantiles.

A day of a key is one row of bounded size, whatever the number of its rows and ids; weeks and months never read the rows again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sightline.sources.shared import stored

#: Ids that a set holds exactly, as a power of two (beyond them its standard error is 1.6 %), size of the counter (1.6 % too) and of quantiles (1.3 % in rank).
SET_BITS, COUNTER_BITS, QUANTILE_SIZE = 12, 12, 200


def daily(rows: DataFrame, keys: list[str], ts: str, of: str, value: str) -> DataFrame:
    """rows -> keys, day, n, ids, counter, quantiles: one row for each key and day. Null ids and values leave no trace but in n."""
    made = (F.theta_sketch_agg(of, SET_BITS).alias("ids"), F.hll_sketch_agg(of, COUNTER_BITS).alias("counter"), F.kll_sketch_agg_double(F.col(value).cast("double"), QUANTILE_SIZE).alias("quantiles"))
    return rows.groupBy(*keys, F.to_date(ts).alias("day")).agg(F.count(F.lit(1)).alias("n"), *made)


def merged(days: DataFrame, keys: list[str], unit: str = "week") -> DataFrame:
    """daily() -> keys, period (its first day), n, ids, counter, quantiles. Days may come in parts that were added later."""
    period = F.to_date(F.date_trunc(unit, "day")).alias("period")
    made = (F.theta_union_agg("ids", SET_BITS).alias("ids"), F.hll_union_agg("counter").alias("counter"), F.kll_merge_agg_double("quantiles", QUANTILE_SIZE).alias("quantiles"))
    return days.groupBy(*keys, period).agg(F.sum("n").alias("n"), *made)


def quantile(sketch: Column, share: float) -> Column:
    """A quantile of what the sketch saw; null if it saw nothing."""
    return F.when(F.kll_sketch_get_n_double(sketch) > 0, F.kll_sketch_get_quantile_double(sketch, F.lit(share)))


def ids(rows: DataFrame, keys: list[str], ts: str, of: str, unit: str = "week") -> DataFrame:
    """rows -> keys, period, id: the different ids of each period, nulls left out."""
    return rows.where(F.col(of).isNotNull()).select(*keys, F.to_date(F.date_trunc(unit, F.col(ts))).alias("period"), F.col(of).alias("id")).distinct()


def returning(periods: DataFrame, keys: list[str], unit: str = "week", exact: DataFrame | None = None) -> DataFrame:
    """merged() -> keys, period, n, distinct, returned (seen in the period before as well) and new (not seen in it).

    A period that no row of the key precedes has no returned ids. Counts are exact while both sets have at most 2^SET_BITS ids;
    with ids() as `exact` those of larger sets are exact too, and only their periods' ids are counted.
    """
    step = F.expr({"day": "interval 1 day", "week": "interval 7 days", "month": "interval 1 month"}[unit])
    before = periods.select(*keys, F.to_date(F.col("period") + step).alias("period"), F.col("ids").alias("before"))
    out = periods.join(before, [*keys, "period"], "left")
    both = F.when(F.col("before").isNotNull(), F.theta_sketch_estimate(F.theta_intersection("ids", "before")))
    gone = F.when(F.col("before").isNotNull(), F.theta_sketch_estimate(F.theta_difference("ids", "before")))
    distinct = F.theta_sketch_estimate("ids")
    counts = [distinct.alias("distinct"), F.coalesce(both, F.lit(0)).alias("returned"), F.coalesce(gone, distinct).alias("new")]
    if exact is None:
        return out.select(*keys, "period", "n", *counts)
    # an estimate of half the size can't come of a set beyond it
    most = F.greatest(distinct, F.coalesce(F.theta_sketch_estimate("before"), F.lit(0)))
    out = stored(out.select(*keys, "period", "n", *counts, (most > 2 ** (SET_BITS - 1)).alias("large")), "periods")
    large = out.where("large").select(*keys, "period")
    need = large.unionByName(large.select(*keys, F.to_date(F.col("period") - step).alias("period"))).distinct()
    again = F.lag("period").over(Window.partitionBy(*keys, "id").orderBy("period")) + step
    seen = exact.join(need, [*keys, "period"], "left_semi").withColumn("again", F.coalesce(F.to_date(again) == F.col("period"), F.lit(False)))
    sums = seen.groupBy(*keys, "period").agg(F.count(F.lit(1)).alias("d_"), F.count_if("again").alias("r_"))
    both = out.join(sums, [*keys, "period"], "left")
    pick = lambda c, x: F.when(F.col("large"), F.coalesce(x, F.lit(0))).otherwise(F.col(c)).alias(c)
    return both.select(*keys, "period", "n", pick("distinct", F.col("d_")), pick("returned", F.col("r_")), pick("new", F.col("d_") - F.col("r_")))
