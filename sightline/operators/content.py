"""Scores of prose: content quality and how quotable a passage is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.functions import text as tx

# Phrases that pad, and phrases that generated prose overuses.
FILLER = (
    "it's important to note that", "it is important to note that", "in this article, we'll explore", "in this article we will explore",
    "in today's fast-paced world", "in today's digital age", "in today's competitive landscape", "needless to say", "at the end of the day",
    "when it comes to", "when all is said and done", "in the realm of", "in the world of", "the bottom line is", "without further ado",
    "first and foremost", "last but not least", "for what it's worth", "it goes without saying", "as we all know", "the truth is that",
    "the fact of the matter is", "more often than not", "let's dive in", "let's dive into", "let's take a closer look", "let's take a deeper look",
)
GENERATED = (
    "delve into", "delve deeper into", "in the ever-evolving", "ever-evolving landscape", "ever-changing landscape", "in the dynamic landscape",
    "navigating the", "navigate the complexities", "tapestry of", "rich tapestry", "intricate tapestry", "embark on a journey", "embarking on this",
    "a testament to", "a beacon of", "the cornerstone of", "a cornerstone of", "at the heart of", "at its core", "in essence,", "in conclusion,",
    "ultimately,", "moreover,", "furthermore,", "however, it's worth noting", "it's worth noting that", "it is worth noting that", "by leveraging",
    "leverage the power of", "leveraging the power of", "harness the power of", "unlock the potential", "unlock the full potential",
    "the realm of possibilities", "open up a world of", "a world of possibilities", "elevate your", "transform your", "revolutionize the way",
    "game-changer", "game-changing", "cutting-edge", "state-of-the-art", "in summary,", "to summarize,", "to put it simply,", "in a nutshell,",
)


def quality(docs: DataFrame, text: str = "text", threshold: int = 60) -> DataFrame:
    """docs with n_tokens, unique_tokens, filler, generated, density, repetition, overall, passed and flags.

    Scores are 0 to 100, density 0 to 1 with three decimals. A null or blank text has zeros and the flag empty-input.
    """
    t = tx.text_or_empty(F.col(text))
    blank = ~t.rlike(r"\S")
    measured = docs.select(
        "*",
        F.inline(F.array(F.struct(
            tx.let(tx.tokens(t), lambda w: F.struct(F.size(w).alias("n"), F.size(F.array_distinct(w)).alias("u"), tx.bigram_repetition(w).alias("r"))).alias("w_"),
            (tx.matches(t, tx.ENTITY) + tx.matches(t, tx.NUMBER)).alias("facts_"),
            tx.phrases_in(t, FILLER + GENERATED).alias("ph_"),
            blank.alias("blank_"),
        ))),
    )
    n = F.col("w_.n")
    of = lambda phrases: F.size(F.array_intersect("ph_", F.array(*[F.lit(p) for p in phrases])))
    scale = F.greatest(F.lit(1.0), n / 1000)
    density = F.least(F.lit(1.0), F.col("facts_") * 100 / F.greatest(F.lit(1), n) / 10)
    capped = lambda hits, by: F.least(F.lit(100.0), F.round(hits / scale * by)).cast("long")
    base = measured.select(
        *docs.columns, "blank_", n.cast("long").alias("n_tokens"), F.col("w_.u").cast("long").alias("unique_tokens"), capped(of(FILLER), 25).alias("filler"),
        capped(of(GENERATED), 15).alias("generated"), density.alias("dens_"), F.round(F.col("w_.r") * 100).cast("long").alias("repetition"),
    )
    overall = F.round(0.25 * (100 - F.col("filler")) + 0.25 * (100 - F.col("generated")) + 25 * F.col("dens_") + 0.15 * (100 - F.col("repetition")) + 0.1 * F.least(F.lit(100.0), F.col("n_tokens") / 10))
    tests = (("filler", F.col("filler") >= 50), ("ai-patterns", F.col("generated") >= 40), ("low-density", F.col("dens_") < 0.2), ("repetitive", F.col("repetition") >= 30), ("thin-content", F.col("n_tokens") < 300))
    flags = F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in tests]))
    zero = lambda c, kind="long": F.when(F.col("blank_"), F.lit(0).cast(kind)).otherwise(c)
    score = zero(overall.cast("long"))
    return base.select(
        *docs.columns, zero(F.col("n_tokens")).alias("n_tokens"), zero(F.col("unique_tokens")).alias("unique_tokens"), zero(F.col("filler")).alias("filler"), zero(F.col("generated")).alias("generated"),
        zero(tx.half_up(F.col("dens_"), 3), "double").alias("density"), zero(F.col("repetition")).alias("repetition"), score.alias("overall"), (score >= threshold).alias("passed"),
        F.when(F.col("blank_"), F.array(F.lit("empty-input"))).otherwise(flags).alias("flags"),
    )


# The patterns of the citability score. (?U) makes \w and \b those of Unicode. Most begin with a look at one character
# that the rest needs anyway, or end in a look back: that changes no match and spares the rest in nearly all places of a text.
DEFINITION = r"(?iU)\b\w+\s+is\s+(?:a|an|the)\s|\b\w+\s+refers?\s+to\s|\b\w+\s+means?\s|\b\w+\s+(?:can be |are )?defined\s+as\s|\bin\s+(?:simple|other)\s+(?:terms|words)\s*,"
EARLY = r"(?iU)\b(?:is|are|was|were|means?|refers?)\b|\d+%|\$[\d,]+|\d+\s+(?:million|billion|thousand)"
#: Stands in every text that has a DEFINITION, and in few others. The first letters are those that (?iU) takes for them.
DEFINING = r"(?=[iIİırRmMdDcCaA])(?<![A-Za-z])(?iU)(?:is\s+(?:a|an|the)\s|refers?\s+to\s|means?\s|(?:can be |are )?defined\s+as\s|in\s+(?:simple|other)\s+(?:terms|words)\s*,)"
RESEARCH = r"(?i)(?=[arsd])(?:according to|research shows|studies? (?:show|indicate|suggest|found)|data (?:shows|indicates|suggests))"
PRONOUN = r"(?iU)\b(?:it|they|them|their|this|that|these|those|he|she|his|her)\b"
PROPER = r"(?=[A-Z])\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*\b"
SEQUENCE = r"(?i)(?=[fstam])(?:first|second|third|finally|additionally|moreover|furthermore)"
ENUMERATED = r"(?=[.)sSſtTpP])(?iU)(?:(?<=\d)[.)]\s|\b(?:step|tip|point)\s+\d)"
PERCENT = r"\d+(?:\.\d+)?%"
DOLLAR = r"(?i)\$[\d,]+(?:\.\d+)?(?:\s*(?:million|billion|M|B|K))?"
COUNTED = r"(?=\p{Nd})(?iU)\b\d+(?:,\d{3})*(?:\.\d+)?\s+(?:users|customers|pages|sites|companies|businesses|people|percent|times|x\b)"
RECENT = r"(?=2)\b20(?:2[3-9]|3\d|1\d)\b"
SOURCES = (r"[ormy](?=\s+[A-Z])(?<=according to|per|from|by)", r"(?=[GFMHSOA])(?:Gartner|Forrester|McKinsey|Harvard|Stanford|MIT|Google|Microsoft|OpenAI|Anthropic)", r"\([A-Z][a-z]+(?:\s+\d{4})?\)")
ORIGINAL = r"(?i)(?=[ow])(?:our (?:research|study|data|analysis|survey|findings)|we (?:found|discovered|analyzed|surveyed|measured))"
CASE_STUDY = r"(?i)(?=[cfirh])(?:case study|for example|for instance|in practice|real-world|hands-on)"
TOOL = r"[gha](?=\s+[A-Z][a-z])(?<=using|with|via|through)"


def grade(total: Column) -> Column:
    return F.when(total >= 80, "A").when(total >= 65, "B").when(total >= 50, "C").when(total >= 35, "D").otherwise("F")


def sentence_counts(text: Column) -> Column:
    """How many sentences a text has, and how many of them have 5 to 25 words (n, clear). They end at . ! or ?, decimals included."""
    sizes = F.transform(F.split(text, "[.!?]"), lambda x: F.size(tx.spaced_words(x)))
    return tx.let(sizes, lambda s: F.struct(F.size(F.filter(s, lambda n: n > 0)).alias("n"), F.size(F.filter(s, lambda n: n.between(5, 25))).alias("clear")))


def containment(words: Column, pronouns: Column, proper: Column) -> Column:
    """How well a passage stands alone, 0 to 25, by its numbers of words, pronouns and names."""
    band = F.when(words.between(134, 167), 10).when(words.between(100, 200), 7).when(words.between(80, 250), 4).when(~words.between(30, 400), 0).otherwise(2)
    ratio = pronouns / F.greatest(words, F.lit(1))
    own = F.when(words == 0, 0).when(ratio < 0.02, 8).when(ratio < 0.04, 5).when(ratio < 0.06, 3).otherwise(0)
    return F.least(F.lit(25), band + own + F.when(proper >= 3, 7).when(proper >= 1, 4).otherwise(0))


def citability(passages: DataFrame, text: str = "text", heading: str | None = None) -> DataFrame:
    """passages with word_count, answer, self_contained, structure, statistics, unique, total, grade and preview.

    A null text counts as an empty one. Sentences end at . ! or ?, decimals included.
    """
    t = tx.text_or_empty(F.col(text))
    has = lambda pattern, n: F.when(t.rlike(pattern), n).otherwise(0)
    count = lambda pattern: tx.matches(t, pattern)
    asks = F.rtrim(F.coalesce(F.col(heading), F.lit(""))).endswith("?") if heading else F.lit(False)
    words = tx.spaced_words(t)
    # one generated row: each expression is computed once, however often its column is used
    made = passages.select("*", F.inline(F.array(F.struct(
        tx.let(words, lambda w: F.struct(F.size(w).alias("n"), F.array_join(F.slice(w, 1, 60), " ").alias("first"), F.array_join(F.slice(w, 1, 30), " ").alias("start"))).alias("w_"),
        sentence_counts(t).alias("s_"),
        (F.when(t.rlike(DEFINING), has(DEFINITION, 15)).otherwise(0) + F.when(asks, 10).otherwise(0) + has(RESEARCH, 10)).alias("abq_"),
        count(PRONOUN).alias("pronouns_"), count(PROPER).alias("proper_"),
        (has(SEQUENCE, 4) + has(ENUMERATED, 4) + F.when(F.contains(t, F.lit("\n")), 4).otherwise(0)).alias("sr_"),
        (F.least(F.lit(6), 3 * count(PERCENT)) + F.least(F.lit(5), 3 * count(DOLLAR)) + F.least(F.lit(4), 2 * count(COUNTED)) + has(RECENT, 2) + has(SOURCES[0], 2) + has(SOURCES[1], 2) + has(SOURCES[2], 2)).alias("sd_"),
        (has(ORIGINAL, 5) + has(CASE_STUDY, 3) + has(TOOL, 2)).alias("us_"),
    ))))
    n, s = F.col("w_.n"), F.col("s_.n")
    answer = F.least(F.lit(30), F.col("abq_") + F.when(F.col("w_.first").rlike(EARLY), 15).otherwise(0) + F.when(s > 0, F.floor(F.col("s_.clear") / s * 10)).otherwise(0))
    contained = containment(n, F.col("pronouns_"), F.col("proper_"))
    average = n / F.greatest(s, F.lit(1))
    structure = F.least(F.lit(20), F.col("sr_") + F.when(s == 0, 0).when(average.between(10, 20), 8).when(average.between(8, 25), 5).otherwise(2))
    parts = {"answer": answer, "self_contained": contained, "structure": structure, "statistics": F.least(F.lit(15), F.col("sd_")), "unique": F.least(F.lit(10), F.col("us_"))}
    total = sum(parts.values(), F.lit(0))
    out = made.select(*passages.columns, n.cast("long").alias("word_count"), *[p.cast("long").alias(k) for k, p in parts.items()], total.cast("long").alias("total"), F.concat(F.col("w_.start"), F.when(n > 30, "...").otherwise("")).alias("preview"))
    return out.withColumn("grade", grade(F.col("total")))


def page_citability(scored: DataFrame, page: str, order: str, top: int = 5) -> DataFrame:
    """Per page: blocks, mean total, blocks of 134 to 167 words, grades, and the mean of the `top` best blocks."""
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy(page).orderBy(F.col("total").desc(), order))
    grades = [F.count_if(F.col("grade") == g).alias(f"grade_{g.lower()}") for g in "ABCDF"]
    best = F.avg(F.when(F.col("r_") <= top, F.col("total")))
    return scored.withColumn("r_", rank).groupBy(page).agg(F.count(F.lit(1)).alias("blocks"), tx.half_up(F.avg("total"), 1).alias("average"), F.count_if(F.col("word_count").between(134, 167)).alias("optimal_length"), *grades, tx.half_up(best, 1).alias("best_average"))
