"""Quality classifier: an interpolated modified Kneser-Ney model of trusted text, and each document's perplexity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.llm import kneser_ney as kn
from sightline.llm.common import crc_mod, fresh, small, stored

#: Of trusted documents of a language that the model has not seen, the share whose perplexity is under its threshold.
QUANTILE = 0.995
#: Documents of a language from which on it has a threshold of its own; else that of all languages holds.
LEAST = 50
#: One in so many trusted documents is kept from the model, to set the thresholds.
HOLDOUT = 5


def fit(docs: DataFrame, trusted: DataFrame, order: int = kn.ORDER, shard_rows: int = kn.SHARD_ROWS) -> kn.Model:
    """The model of the texts of docs(doc_id, text) whose id is in trusted(doc_id), all of them. Texts move only if there
    are more ids than may be broadcast."""
    texts = docs.join(small(trusted.select("doc_id").distinct()), "doc_id", "left_semi").select("text", F.lit(0).alias("cls"))
    top = stored(kn.gram_counts(texts, order).select("g", "n"), "kn-top")
    grams, contexts, unseen = kn.interpolated(kn.lower_orders(top, order), order)
    log = lambda c: F.log(F.col(c)).alias("v")
    return kn.sharded(grams.select("g", log("p")), contexts.select("g", log("w")), order, unseen, shard_rows)


def perplexities(docs: DataFrame, model: kn.Model, text: str = "text", out: str = "perplexity") -> DataFrame:
    """docs with the perplexity of each text by character; null if it has none."""
    total, chars = fresh(docs, "kn_sum", "kn_chars")
    scored = kn.summed(docs, model, text, total, chars)
    return scored.withColumn(out, F.when(F.col(chars) > 0, F.exp(-F.col(total) / F.col(chars)))).drop(total, chars)


def thresholds(scored: DataFrame, quantile: float = QUANTILE, least: int = LEAST) -> DataFrame:
    """scored(lang, perplexity) -> (lang, threshold); the row with null lang is that of all languages."""
    pick = F.percentile_approx("perplexity", quantile, 10_000)
    own = scored.where("lang is not null and perplexity is not null").groupBy("lang").agg(pick.alias("threshold"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    return own.select("lang", "threshold").unionByName(scored.agg(F.lit(None).cast("string").alias("lang"), pick.alias("threshold")))


def judged(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE, order: int = kn.ORDER, least: int = LEAST, shard_rows: int = kn.SHARD_ROWS) -> DataFrame:
    """docs (doc_id, text, lang and any others) with perplexity and keep.

    Trusted is what labels(doc_id, quality) marks with quality 1; a fifth of it (by crc32 of the id) is not in the
    model and sets the thresholds, a quantile for each language. A text over its language's threshold goes. Null or
    empty texts have perplexity null and stay, as nothing speaks against them. Without trusted documents all stay.
    A null or rare language has the threshold of all. Rows with equal ids are judged each by its own text.
    """
    good = stored(labels.where("quality = 1 and doc_id is not null").select("doc_id").distinct(), "trusted")
    held = crc_mod(F.col("doc_id"), HOLDOUT) == 0
    ids = docs.select("doc_id", "text")
    model = fit(ids, good.where(~held), order, shard_rows)
    sample = docs.select("doc_id", "text", F.col("lang").cast("string").alias("lang")).join(small(good.where(held)), "doc_id", "left_semi")
    limits = stored(thresholds(perplexities(sample, model).select("lang", "perplexity"), quantile, least), "limits")
    ppl, limit, lang, all_limit = fresh(docs, "perplexity", "kn_limit", "kn_lang", "kn_all")
    every = limits.where("lang is null").select(F.col("threshold").alias(all_limit))
    own = small(limits.where("lang is not null").select(F.col("lang").alias(lang), F.col("threshold").alias(limit)))
    scored = perplexities(docs, model, out=ppl)
    joined = scored.join(own, F.col("lang").cast("string") == F.col(lang), "left").crossJoin(F.broadcast(every))  # one row
    keep = F.coalesce(F.col(ppl) <= F.coalesce(F.col(limit), F.col(all_limit)), F.lit(True))
    return joined.withColumn(fresh(docs, "keep")[0], keep).drop(lang, limit, all_limit)
