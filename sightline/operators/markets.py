"""Spend, pipelines, prices, keyword overlap and clusters, link profiles."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sightline.functions import text as tx
from sightline.sources.shared import stored

#: Pairs that one task of overlap() makes.
PAIRS = 2_000_000


def money(x: Column) -> Column:
    """Five decimals, and no negative zero."""
    return tx.half_up(x, 5)


def spend(ledger: DataFrame) -> DataFrame:
    """ledger(endpoint, cost) -> endpoint, calls, cost and, with a null endpoint, the total of all."""
    return ledger.rollup("endpoint").agg(F.count(F.lit(1)).alias("calls"), money(F.sum("cost")).alias("cost"), F.grouping("endpoint").cast("int").alias("is_total"))


def budget(ledger: DataFrame, limit: float) -> DataFrame:
    """ledger(cost) -> spent, remaining, over_budget."""
    spent = ledger.agg(money(F.coalesce(F.sum("cost"), F.lit(0.0))).alias("spent"))
    return spent.select("spent", money(F.lit(limit) - F.col("spent")).alias("remaining"), (F.col("spent") > limit).alias("over_budget"))


def estimate(calls: DataFrame, prices: DataFrame) -> DataFrame:
    """calls(endpoint, n), prices(endpoint, unit_cost) -> endpoint, n, estimate, known; approval tier by the cost.

    prices is a price list of fixed size. Unknown endpoints have a null estimate.
    """
    out = calls.join(F.broadcast(prices), "endpoint", "left").select("endpoint", "n", money(F.col("n") * F.col("unit_cost")).alias("estimate"), F.col("unit_cost").isNotNull().alias("known"))
    return out.withColumn("tier", F.expr("case when estimate is null then 'unknown' when estimate < 0.1 then 'auto' when estimate < 1 then 'confirm' else 'approve' end"))


def pipeline(deals: DataFrame, stages: tuple[str, ...], won: str, lost: str) -> DataFrame:
    """deals(domain, stage, value) -> each of the stages, empty ones too: deals, value, and whether it is open."""
    spark = deals.sparkSession
    dim = spark.createDataFrame([(i, s) for i, s in enumerate(stages)], "pos int, stage string")
    sums = deals.groupBy("stage").agg(F.count(F.lit(1)).alias("deals"), F.sum("value").alias("value"))
    out = F.broadcast(dim).join(sums, "stage", "left")
    return out.select("pos", "stage", F.coalesce("deals", F.lit(0)).alias("deals"), money(F.coalesce("value", F.lit(0.0))).alias("value"), (~F.col("stage").isin(won, lost)).alias("is_open"))


def price_stats(prices: DataFrame, keys: list[str], price: str) -> DataFrame:
    """count, min, max, exact quartiles, and how many lie over two standard deviations from the mean."""
    p = F.col(price)
    stats = prices.groupBy(*keys).agg(F.count(p).alias("n"), F.min(p).alias("low"), F.percentile(p, F.lit(0.25)).alias("p25"), F.median(p).alias("median"), F.percentile(p, F.lit(0.75)).alias("p75"), F.max(p).alias("high"), F.avg(p).alias("mean_"), F.stddev_samp(p).alias("sd_"))
    odd = prices.join(stats.select(*keys, "mean_", "sd_"), keys).groupBy(*keys).agg(F.count_if(F.abs(p - F.col("mean_")) > 2 * F.col("sd_")).alias("outliers"))
    return stats.drop("mean_", "sd_").join(odd, keys)


def overlap(serp: DataFrame, key: str, item: str, least: int = 1) -> DataFrame:
    """serp(key, item) -> (a, b, shared), a < b, for keys that share items.

    An item that so many keys have that its pairs would grow with their square belongs to without_ubiquitous(), first.
    Pairs are counted before they are made and dealt out in parts of some PAIRS, so that a task holds no more at any size.
    """
    rows = stored(serp.select(F.col(key).alias("k"), F.col(item).alias("i")).distinct(), "serp")
    c = F.col("c")
    made = rows.groupBy("i").agg(F.count(F.lit(1)).alias("c")).agg(F.sum(c * (c - 1) / 2).alias("n")).first()["n"] or 0
    parts = max(1, math.ceil(made / PAIRS))
    dealt = rows.where("i is not null and k is not null").repartition(parts, "i")
    pairs = dealt.select(F.col("k").alias("a"), "i").join(dealt.select(F.col("k").alias("b"), "i"), "i").where("a < b")
    return pairs.select("a", "b").repartition(parts, "a", "b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared")).where(F.col("shared") >= least)


def overlap_band(shared: Column) -> Column:
    """What a number of shared results out of ten means for two keywords."""
    return F.when(shared >= 7, "same page").when(shared >= 4, "same cluster").when(shared >= 2, "interlink").otherwise("separate")


def without_ubiquitous(serp: DataFrame, key: str, domain: str, top: int = 5) -> DataFrame:
    """serp without the `top` domains that the most keys have (ties by name)."""
    most = serp.groupBy(domain).agg(F.count_distinct(key).alias("n_")).orderBy(F.col("n_").desc(), domain).limit(top)
    return serp.join(F.broadcast(most.select(domain)), domain, "left_anti")


def clusters(pairs: DataFrame) -> DataFrame:
    """pairs(a, b) -> (node, cluster): the smallest node that a node is linked with over any number of links.

    Labels halve their chains in each round, so the rounds grow with the logarithm of the longest chain.
    """
    edges = stored(pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = stored(edges.groupBy(F.col("a").alias("node")).agg(F.min(F.least("a", "b")).alias("cluster")), "clusters")
    while True:
        near = edges.join(labels.select(F.col("node").alias("b"), "cluster"), "b").groupBy(F.col("a").alias("node")).agg(F.min("cluster").alias("near"))
        step = labels.join(near, "node").select("node", F.col("cluster").alias("was"), F.least("cluster", "near").alias("to"))
        jump = labels.select(F.col("node").alias("to"), F.col("cluster").alias("next"))
        new = stored(step.join(jump, "to", "left").select("node", "was", F.least("to", F.coalesce("next", "to")).alias("cluster")), "clusters")
        labels = new.select("node", "cluster")
        if not new.where("was <> cluster").limit(1).count():
            return labels


def domain_gap(links: DataFrame, ours: str, theirs: str) -> DataFrame:
    """links(site, domain) -> (domain, state): which of two sites a domain links to."""
    of = lambda s, c: links.where(F.col("site") == s).select("domain").distinct().withColumn(c, F.lit(1))
    both = of(ours, "o").join(of(theirs, "t"), "domain", "full")
    return both.select("domain", F.expr("case when o is null then 'competitor only' when t is null then 'ours only' else 'both' end").alias("state"))


def anchors(links: DataFrame, brand: str, phrase: str) -> DataFrame:
    """links(anchor) -> kind, links, share (3 decimals): exact, partial, brand, url, generic or other."""
    a = F.lower(F.trim(F.coalesce("anchor", F.lit(""))))
    kind = F.when(a == phrase, "exact").when(F.contains(a, F.lit(phrase)), "partial").when(F.contains(a, F.lit(brand)), "brand").when(a.rlike(r"^(https?://|www\.)|\.(com|org|net)$"), "url").when(a.isin("click here", "here", "read more", "this", "website", "link", "more", ""), "generic").otherwise("other")
    per = links.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("links"))
    return per.withColumn("share", tx.half_up(F.col("links") / F.sum("links").over(Window.partitionBy(F.lit(1))), 3))


def toxic_patterns(links: DataFrame, outbound: int = 50, same_anchor: int = 5) -> DataFrame:
    """links(src, dst, anchor) of domains -> (pattern, subject, n): link farms, repeated anchors, reciprocal pairs."""
    farms = links.groupBy("src").agg(F.count_distinct("dst").alias("n")).where(F.col("n") > outbound).select(F.lit("link farm").alias("pattern"), F.col("src").cast("string").alias("subject"), "n")
    same = links.where("anchor <> ''").groupBy("dst", F.lower("anchor").alias("anchor")).agg(F.count_distinct("src").alias("n")).where(F.col("n") >= same_anchor).select(F.lit("repeated anchor").alias("pattern"), F.concat_ws(" ", "dst", "anchor").alias("subject"), "n")
    pairs = links.select("src", "dst").distinct()
    back = pairs.join(pairs.select(F.col("src").alias("dst"), F.col("dst").alias("src")), ["src", "dst"]).where("src < dst").select(F.lit("reciprocal").alias("pattern"), F.concat_ws(" ", "src", "dst").alias("subject"), F.lit(1).cast("long").alias("n"))
    return farms.unionByName(same).unionByName(back)


def weighted(parts: DataFrame, weights: dict[str, float], bands: tuple[tuple[float, str], ...] = ()) -> DataFrame:
    """parts(subject and a column for each weight, 0 to 100) with score (1 decimal) and its band.

    A part that is null takes its weight with it: what is left is scaled up; without any part the score is null.
    """
    known = sum((F.when(F.col(c).isNotNull(), F.lit(w)).otherwise(0.0) for c, w in weights.items()), F.lit(0.0))
    total = sum((F.coalesce(F.col(c), F.lit(0.0)) * w for c, w in weights.items()), F.lit(0.0))
    out = parts.withColumn("score", tx.half_up(F.when(known > 0, total / known), 1))
    if not bands:
        return out
    band = F.lit(None).cast("string")
    for least, name in sorted(bands):
        band = F.when(F.col("score") >= least, name).otherwise(band)
    return out.withColumn("band", band)


# The weights and bands of the composite scores.
VISIBILITY = {"citability": 0.25, "brand": 0.20, "eeat": 0.20, "technical": 0.15, "schema": 0.10, "platform": 0.10}
VISIBILITY_BANDS = ((90, "excellent"), (75, "good"), (60, "fair"), (40, "poor"), (0, "critical"))
REPORT = {"platform": 0.25, "content": 0.25, "technical": 0.20, "schema": 0.15, "brand": 0.15}
HEALTH = {"technical": 0.22, "content": 0.23, "onpage": 0.20, "schema": 0.10, "performance": 0.10, "answer_ready": 0.10, "images": 0.05}
BRAND = {"video": 0.25, "forum": 0.25, "encyclopedia": 0.20, "network": 0.15, "other": 0.15}
BLOCKS = {"answer": 0.30, "self_contained": 0.25, "structure": 0.20, "statistics": 0.15, "uniqueness": 0.10}
PRODUCT_PAGE = {"schema": 0.25, "title": 0.15, "images": 0.20, "content": 0.20, "links": 0.10, "technical": 0.10}
LOCAL = {"profile": 0.25, "reviews": 0.20, "onpage": 0.20, "citations": 0.15, "schema": 0.10, "authority": 0.10}
TECHNICAL = {"crawling": 0.15, "indexing": 0.12, "security": 0.10, "urls": 0.08, "mobile": 0.10, "vitals": 0.15, "server_rendering": 0.15, "speed": 0.15}
BRAND_BANDS = ((85, "dominant"), (70, "strong"), (50, "moderate"), (30, "weak"), (0, "minimal"))


def grid(places: DataFrame, size: int = 7, spacing_km: float = 1.0) -> DataFrame:
    """places(place, lat, lng) -> a lattice of size x size points around each: place, row, col, lat, lng, quadrant."""
    half = (size - 1) / 2
    steps = F.sequence(F.lit(0), F.lit(size - 1))
    points = places.select("place", "lat", "lng", F.explode(steps).alias("row")).select("*", F.explode(steps).alias("col"))
    dy, dx = (F.lit(half) - F.col("row")) * spacing_km, (F.col("col") - F.lit(half)) * spacing_km
    quadrant = F.concat(F.when(dy >= 0, "N").otherwise("S"), F.when(dx >= 0, "E").otherwise("W"))
    return points.select("place", "row", "col", F.round(F.col("lat") + dy / 111.32, 6).alias("lat"), F.round(F.col("lng") + dx / (111.32 * F.cos(F.radians("lat"))), 6).alias("lng"), quadrant.alias("quadrant"))


def share_of_local_voice(ranks: DataFrame) -> DataFrame:
    """ranks(place, quadrant, rank nullable) -> share of points in the first three, mean rank, worst quadrant."""
    quad = ranks.groupBy("place", "quadrant").agg(F.avg(F.coalesce("rank", F.lit(21))).alias("q"))
    worst = quad.groupBy("place").agg(F.max(F.struct("q", "quadrant")).alias("w"))
    per = ranks.groupBy("place").agg(tx.half_up(F.count_if(F.col("rank") <= 3) / F.count(F.lit(1)) * 100, 1).alias("solv"), tx.half_up(F.avg("rank"), 2).alias("average_rank"), F.count_if(F.col("rank").isNull()).alias("absent"))
    return per.join(worst, "place").select("place", "solv", "average_rank", "absent", F.col("w.quadrant").alias("worst_quadrant"))
