"""Quality rules whose cutoffs carry a guarantee, set on labelled documents with exact binomial bounds.

Base measures are fixed by contract; on top of them each rule (a share of symbols, of repeated lines, ...) has a grid of
cutoffs in each stratum. Of the labelled good documents of a stratum a cutoff rejects k of n; it is admitted if the
binomial probability of k or fewer, were the true share of rejections as high as allowed, is at most the error level
divided by the number of rules and strata. Along a grid the tests go in a fixed order, from mild to strict, and end with the
first that fails, so a rule's whole grid costs no more than one test. The strictest admitted cutoff holds; without one the
rule rejects nothing.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.llm.common import fresh, let, small, stored

#: White space, and what lies between; symbols.
SPACE, SYMBOLS = r"[\x20\x09-\x0D]+", "#*$%&|<>"
#: Share of the good documents of a stratum that all rules together may reject, and the chance that a bound is wrong.
RISK, ERROR = 0.02, 0.05
#: Cutoffs from strict to mild; a document whose value is over the cutoff in force goes.
GRID = {
    "symbol_share": (0.02, 0.05, 0.1, 0.15, 0.2, 0.3, 0.4, 0.6),
    "repeat_share": (0.02, 0.05, 0.1, 0.15, 0.2),
    "dup_line_share": (0.05, 0.1, 0.2, 0.3, 0.5, 0.7, 0.9),
    "upper_share": (0.1, 0.2, 0.3, 0.5, 0.7, 0.9),
    "word_length": (7.0, 8.0, 9.0, 10.0, 12.0, 15.0),
}


def repeat_words(w: Column) -> Column:
    """Words of the array w in windows of five words that stand twice or more."""
    hashes = F.transform(F.sequence(F.lit(0), F.size(w) - 5), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(5)]))
    sums = F.struct(F.lit(0).alias("sum"), F.lit(-5).alias("last"))

    def covered(s: Column) -> Column:
        # neighbours in the order of hashes are equal; the places of those, in order
        again = F.filter(s, lambda e, j: ((j > 0) & (F.get(s, j - 1)["h"] == e["h"])) | ((j < F.size(s) - 1) & (F.get(s, j + 1)["h"] == e["h"])))
        places = F.array_sort(F.transform(again, lambda e: e["i"]))
        return F.aggregate(places, sums, lambda a, x: F.struct((a["sum"] + F.least(x - a["last"], F.lit(5))).alias("sum"), x.alias("last")), lambda a: a["sum"])

    def some(h: Column) -> Column:
        placed = F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(let(F.sort_array(placed), covered))

    return F.when(F.size(w) < 6, 0).otherwise(let(hashes, some)).cast("long")


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (of null as of an empty text), n_lines and
    n_upper (A to Z)."""
    t = F.coalesce(F.col(text), F.lit(""))
    words, = fresh(docs, "rule_words")
    made = docs.withColumn(words, F.filter(F.split(t, SPACE), lambda x: x != ""))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    names = fresh(docs, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper")
    values = (
        F.size(words).cast("long"),
        F.length(F.regexp_replace(t, SPACE, "")).cast("long"),
        F.length(F.regexp_replace(t, f"[^{SYMBOLS}]+", "")).cast("long"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        repeat_words(F.col(words)),
        F.size(lines).cast("long"),
        F.length(F.regexp_replace(t, "[^A-Z]+", "")).cast("long"),
    )
    # a generator of one row keeps the optimizer from writing these expressions out wherever a measure is used
    row = F.inline(F.array(F.struct(*[v.alias(n) for n, v in zip(names, values)])))
    return made.select("*", row).drop(words)


def shares() -> dict[str, Column]:
    part = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    return {"symbol_share": part("n_symbols", "word_chars"), "repeat_share": part("n_repeat_words", "n_words"), "dup_line_share": part("n_dup_lines", "n_lines"), "upper_share": part("n_upper", "word_chars"), "word_length": part("word_chars", "n_words")}


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """Log of the probability of k or fewer of n, each with probability p: exact, term by term in logarithms."""
    first = n * math.log1p(-p)
    odds = math.log(p) - math.log1p(-p)

    def add(a: Column, i: Column) -> Column:
        term = a["term"] + F.log((n - i + 1) / i) + odds
        high, low = F.greatest(a["sum"], term), F.least(a["sum"], term)
        return F.struct(term.alias("term"), (high + F.log1p(F.exp(low - high))).alias("sum"))

    start = F.struct(first.cast("double").alias("term"), first.cast("double").alias("sum"))
    return F.when(k <= 0, first.cast("double")).otherwise(F.aggregate(F.sequence(F.lit(1).cast("long"), F.greatest(k, F.lit(1)).cast("long")), start, add, lambda a: a["sum"]))


def cutoffs(measures: DataFrame, risk: float = RISK, error: float = ERROR) -> DataFrame:
    """measures(stratum and the shares) of good documents -> (stratum, rule, cutoff): the strictest that the sequence admits.

    Chance that in any stratum all rules together reject more than `risk` of the good documents: at most `error`. Strata with
    under some ln(rules * strata / error) * rules / risk good documents (1,500 for four strata) admit nothing.
    """
    tests = [(rule, c) for rule, grid in GRID.items() for c in grid]
    counts = measures.groupBy("stratum").agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col(rule) > c).alias(f"k{i}") for i, (rule, c) in enumerate(tests)])
    counts = stored(counts, "rule-counts")
    strata = max(1, counts.count())
    level = math.log(error / (len(GRID) * strata))
    allowed = risk / len(GRID)
    row = [F.struct(F.lit(rule).alias("rule"), F.lit(c).alias("cutoff"), F.col(f"k{i}").alias("k")) for i, (rule, c) in enumerate(tests)]
    each = counts.select("stratum", "n", F.explode(F.array(*row)).alias("t")).select("stratum", "n", "t.*")
    # k only grows towards the strict end, and the tail with it: what passes is a run of the mild end, and its last one the smallest.
    # Above the mean the tail is over a half; no sum is needed there
    passes = (F.col("k") <= F.col("n") * allowed) & (binomial_tail(F.col("k"), F.col("n"), allowed) <= level)
    return each.where(passes).groupBy("stratum", "rule").agg(F.min("cutoff").alias("cutoff"))


def judged(docs: DataFrame, labels: DataFrame, stratum: str = "lang", risk: float = RISK, error: float = ERROR) -> DataFrame:
    """docs (doc_id, text, the stratum and any others) with the base measures, base_failed and kept.

    base_failed: fewer than 10 words, or over a fifth of them in repeated five-word windows. kept: not base_failed and
    over no admitted cutoff of its stratum. labels(doc_id, quality) mark good documents with quality 1; null labels and
    ids are not used, documents that fail the base rules are not counted as good. Null strata are one of their own. A
    stratum without enough labels has no cutoffs: all that pass the base rules are kept.
    """
    plain = docs.select("doc_id", "text", F.coalesce(F.col(stratum).cast("string"), F.lit("")).alias("stratum"))
    good = stored(labels.where("quality = 1 and doc_id is not null").select("doc_id").distinct(), "good")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    # measures are joined with the labels, not texts: they are a hundredth of the size
    known = measured(plain).where(~failed).select("doc_id", "stratum", *[v.alias(k) for k, v in shares().items()]).join(good, "doc_id")
    limits = stored(cutoffs(known, risk, error).groupBy("stratum").agg(*[F.min(F.when(F.col("rule") == r, F.col("cutoff"))).alias(f"cut_{r}") for r in GRID]), "cutoffs")
    base = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    extra = ["n_lines", "n_upper"]
    inner = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "text", F.coalesce(F.col(stratum).cast("string"), F.lit("")).alias("stratum"))
    out = measured(inner).join(small(limits), "stratum", "left")
    over = [F.coalesce(v > F.col(f"cut_{k}"), F.lit(False)) for k, v in shares().items()]
    bad = over[0]
    for o in over[1:]:
        bad = bad | o
    names = fresh(docs, *base, "base_failed", "kept")
    out = out.withColumn("bf", failed).withColumn("kp", ~failed & ~bad).drop(*extra)
    return out.select("row.*", *[F.col(c).alias(n) for c, n in zip([*base, "bf", "kp"], names)])
