"""Scores with rules of their own: link health, keyword placement, locale parity, reviews, quick wins, sitemap quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sightline.functions import text as tx

# Weights of the link-health factors, and how many of them a score needs.
LINK_HEALTH = {"domains": 0.20, "domain_quality": 0.20, "anchors": 0.15, "toxic": 0.20, "velocity": 0.10, "follow": 0.05, "geography": 0.10}
ENOUGH_FACTORS = 4
# How much longer than the English text a translation may be.
EXPANSION = {"de": (1.10, 1.50), "fr": (1.00, 1.40), "es": (1.00, 1.40), "ja": (0.60, 1.00), "zh": (0.55, 0.95)}


def link_health(factors: DataFrame) -> DataFrame:
    """factors(site, factor, score 0 to 100, confidence) -> site, factors, score (1 decimal), state.

    Weights times confidence, spread over the factors that are there; fewer than four give no score.
    """
    table = factors.sparkSession.createDataFrame(list(LINK_HEALTH.items()), "factor string, weight double")
    known = factors.where("score is not null").join(F.broadcast(table), "factor")
    part = F.col("weight") * F.coalesce("confidence", F.lit(1.0))
    out = known.groupBy("site").agg(F.count_distinct("factor").alias("factors"), (F.sum(part * F.col("score")) / F.sum(part)).alias("s"))
    enough = F.col("factors") >= ENOUGH_FACTORS
    return out.select("site", "factors", F.when(enough, tx.half_up(F.col("s"), 1)).alias("score"), F.when(enough, "scored").otherwise("insufficient data").alias("state"))


def placement(pages: DataFrame, keyword: str = "keyword") -> DataFrame:
    """pages(keyword, title, h1, url, description, body, alts array) -> where the keyword stands, and how many of the six."""
    k = F.lower(F.trim(F.col(keyword)))
    has = lambda c: F.coalesce(F.contains(F.lower(c), k), F.lit(False))
    start = F.array_join(F.slice(tx.spaced_words(F.col("body")), 1, 100), " ")
    slug = F.coalesce(F.contains(F.lower("url"), F.regexp_replace(k, r"\s+", "-")), F.lit(False))
    places = {"in_title": has(F.col("title")), "in_h1": has(F.col("h1")), "in_url": slug, "in_description": has(F.col("description")), "in_start": has(start), "in_alt": F.coalesce(F.exists("alts", has), F.lit(False))}
    return pages.withColumns(places).withColumn("placed", sum((F.col(c).cast("int") for c in places), F.lit(0)))


def freshness(days: Column) -> Column:
    """What a number of days between a source's update and its translation's means."""
    return F.when(days <= 7, "fresh").when(days <= 30, "aging").when(days <= 90, "stale").otherwise("outdated")


def expansion_ok(lang: Column, ratio: Column) -> Column:
    """Whether a translation's length against the English one is as expected; null for languages without bounds."""
    out = F.lit(None).cast("boolean")
    for name, (low, high) in EXPANSION.items():
        out = F.when(lang == name, ratio.between(low, high)).otherwise(out)
    return out


def parity(pages: DataFrame, declared: DataFrame, source: str = "en") -> DataFrame:
    """pages(page, lang, sections, images, words, titled boolean, described boolean, updated date), declared(lang) ->
    page, lang, exists, score: existence 30, title and description 30, structure 25, freshness 15; and freshness, length_ok.

    declared is the list of a site's languages. Pages without a source version are left out.
    """
    base = pages.where(F.col("lang") == source).select("page", *[F.col(c).alias("s_" + c) for c in ("sections", "images", "words", "updated")])
    want = base.join(F.broadcast(declared.select("lang").where(F.col("lang") != source)))
    both = want.join(pages, ["page", "lang"], "left")
    there = F.col("words").isNotNull()
    days = F.greatest(F.lit(0), F.date_diff("s_updated", "updated"))
    same = F.when(F.abs(F.col("sections") - F.col("s_sections")) <= 1, 15).otherwise(0) + F.when(F.col("images") == F.col("s_images"), 10).otherwise(0)
    age = F.when(days <= 7, 15).when(days <= 30, 10).when(days <= 90, 5).otherwise(0)
    elements = F.when(F.col("titled"), 15).otherwise(0) + F.when(F.col("described"), 15).otherwise(0)
    score = F.when(there, 30 + elements + same + age).otherwise(0)
    ratio = F.col("words") / F.when(F.col("s_words") > 0, F.col("s_words"))
    return both.select("page", "lang", there.alias("exists"), score.alias("score"), F.when(there, freshness(days)).alias("freshness"), expansion_ok(F.col("lang"), ratio).alias("length_ok"))


def review_flags(reviews: DataFrame) -> DataFrame:
    """reviews(place, review_id, ts, rating, author_reviews, text) -> place, review_id, signals, suspicious (two or more).

    Signals: three reviews of the place in one hour, an author with one review, a text that stands twice, a five-star
    review in a month with five times the place's mean of five-star reviews a month.
    """
    hour = Window.partitionBy("place", F.date_trunc("hour", F.col("ts")))
    same = Window.partitionBy("place", F.lower(tx.collapsed(F.coalesce("text", F.lit("")))))
    month = F.date_trunc("month", F.col("ts"))
    five = reviews.where("rating = 5").groupBy("place", month.alias("m")).agg(F.count(F.lit(1)).alias("n"))
    high = five.withColumn("mean", F.avg("n").over(Window.partitionBy("place"))).where("n >= 5 * mean").select("place", "m", F.lit(1).alias("spike"))
    made = reviews.select("*", month.alias("m"), (F.count(F.lit(1)).over(hour) >= 3).alias("h"), ((F.count(F.lit(1)).over(same) > 1) & (F.trim(F.coalesce("text", F.lit(""))) != "")).alias("t")).join(high, ["place", "m"], "left")
    signals = F.col("h").cast("int") + F.coalesce((F.col("author_reviews") <= 1).cast("int"), F.lit(0)) + F.col("t").cast("int") + F.coalesce(((F.col("rating") == 5) & (F.col("spike") == 1)).cast("int"), F.lit(0))
    return made.select("place", "review_id", signals.alias("signals"), (signals >= 2).alias("suspicious"))


def quick_wins(rows: DataFrame, share: float = 0.75) -> DataFrame:
    """rows(query, clicks, impressions, position) at positions 4 to 10 whose impressions reach that quantile of all rows."""
    bound = rows.agg(F.percentile_approx("impressions", share, 10_000).alias("bound_"))
    return rows.join(F.broadcast(bound)).where(F.col("position").between(4, 10) & (F.col("impressions") >= F.col("bound_"))).drop("bound_")


def sitemap_quality(entries: DataFrame, pages: DataFrame, most: int = 50_000) -> DataFrame:
    """entries(sitemap, loc, lastmod), pages(loc, status, noindex, redirected) -> (sitemap, issue, severity, urls)."""
    joined = entries.join(pages, "loc", "left")
    sums = joined.groupBy("sitemap").agg(
        F.count(F.lit(1)).alias("urls"), F.count_if(F.col("status") != 200).alias("bad"), F.count_if("noindex").alias("hidden"), F.count_if("redirected").alias("moved"),
        F.count_if(F.col("loc").startswith("http://")).alias("plain"), F.count_distinct("lastmod").alias("dates"), F.count("lastmod").alias("dated"),
    )
    issue = lambda test, n, name, severity: F.when(test, F.struct(F.lit(name).alias("issue"), F.lit(severity).alias("severity"), n.alias("urls")))
    c = F.col
    found = F.array(issue(c("urls") > most, c("urls"), "too many urls", "critical"), issue(c("bad") > 0, c("bad"), "not 200", "high"), issue(c("hidden") > 0, c("hidden"), "noindexed", "high"), issue(c("moved") > 0, c("moved"), "redirected", "medium"), issue(c("plain") > 0, c("plain"), "not https", "medium"), issue((c("dates") == 1) & (c("dated") > 1), c("dated"), "identical lastmod", "low"))
    return sums.select("sitemap", F.inline(F.array_compact(found)))


def crawler_score(sites: DataFrame) -> DataFrame:
    """sites(site, tier1 allowed of 5, tier2 allowed of 5, blanket_block, llms_file, sitemap_file) -> site, score of 100."""
    yes = lambda name, points: F.when(F.coalesce(name, F.lit(False)), points).otherwise(0)
    total = F.least(F.lit(100), F.col("tier1") * 10) + F.least(F.lit(25), F.col("tier2") * 5) + yes(~F.col("blanket_block"), 15) + yes(F.col("llms_file"), 5) + yes(F.col("sitemap_file"), 5)
    return sites.select("site", F.least(F.lit(100), total).alias("score"))


def personas(scores: DataFrame) -> DataFrame:
    """scores(page, persona, volume, relevance, clarity, trust, action; 0 to 25 each) -> page, weighted mean, weakest persona."""
    total = F.col("relevance") + F.col("clarity") + F.col("trust") + F.col("action")
    per = scores.withColumn("total", total).groupBy("page")
    mean = F.sum(F.col("total") * F.col("volume")) / F.when(F.sum("volume") > 0, F.sum("volume"))
    return per.agg(tx.half_up(mean, 1).alias("score"), F.min(F.struct("total", "persona")).alias("w")).select("page", "score", F.col("w.persona").alias("weakest"), F.col("w.total").alias("weakest_score"))
