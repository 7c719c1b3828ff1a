"""Patterns and measures that were made cheaper take the same texts as the plain ones they stand for."""

import random

import pytest
from pyspark.sql import functions as F

from sightline.functions import text as tx
from sightline.operators import claims, content
from sightline.plans.text_queries import passage_self_containment

PLAIN = {
    "RESEARCH": r"(?i)(?:according to|research shows|studies? (?:show|indicate|suggest|found)|data (?:shows|indicates|suggests))",
    "PROPER": r"\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*\b",
    "SEQUENCE": r"(?i)(?:first|second|third|finally|additionally|moreover|furthermore)",
    "ENUMERATED": r"(?iU)(?:\d+[.)]\s|\b(?:step|tip|point)\s+\d+)",
    "COUNTED": r"(?iU)\b\d+(?:,\d{3})*(?:\.\d+)?\s+(?:users|customers|pages|sites|companies|businesses|people|percent|times|x\b)",
    "RECENT": r"\b20(?:2[3-9]|3\d|1\d)\b",
    "ORIGINAL": r"(?i)(?:our (?:research|study|data|analysis|survey|findings)|we (?:found|discovered|analyzed|surveyed|measured))",
    "CASE_STUDY": r"(?i)(?:case study|for example|for instance|in practice|real-world|hands-on)",
    "TOOL": r"(?:using|with|via|through)\s+[A-Z][a-z]+",
    "SOURCES0": r"(?:according to|per|from|by)\s+[A-Z]",
    "SOURCES1": r"(?:Gartner|Forrester|McKinsey|Harvard|Stanford|MIT|Google|Microsoft|OpenAI|Anthropic)",
    "ENTITY": r"\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)+\b",
    "NUMBER": r"\b\d+(?:[.,]\d+)?(?:%|st|nd|rd|th)?\b",
}
COUNTS = ("PROPER", "COUNTED", "ENTITY", "NUMBER")
PIECES = [
    "is a", "ıs an", "İS the", "refers to", "means", "can be defined as", "in simple terms ,", "In other wordſ,", "according  to", "From", "by", "BY", "via", "using", "Spark", "Élan", "x", "X", "12", "٣٤", "2024", "12024",
    "3)", "4.", "٣. ", "ſtep", "step 2", "tip 3", "point", "1,200", "users", "uſers", "times", "percent", "5%", "first", "FINALLY", "thİrd", "our data", "we found", "Case Study", "hands-on", "studies show", "studie found", "data indicates",
    "MIT", "Google", "McKinsey", "It", "ıt", "thiſ", "their", "the", "á", "_it_", "it́", "delve into", "Ultimately,", "the cornerstone of", "a cornerstone of", "it's worth noting that", "itſ worth noting that", "unlocK potential",
    "let's dive in", "game-changer", "gamechanger", "in essence,", "rich tapestry", "needless to say", "when it comes to",
]


@pytest.fixture(scope="module")
def texts(spark):
    rng = random.Random(5)
    rows = ["".join(rng.choice(PIECES) + rng.choice([" ", " ", " ", "\n", "  ", " ", "\xa0", ". ", "! ", "", "?", ", "]) for _ in range(rng.randint(0, 9))) for _ in range(3000)]
    # each code point but surrogates beside letters of the patterns
    every = [chr(k) for k in range(1, 0x3000) if not 0xD800 <= k < 0xE000] + [chr(k) for k in range(0xFB00, 0x10400, 7)]
    rows += [f"{c} {c}t {c}s a b {c}t's {c}2023 {c}1 pages x{c}is the y t{c}p 3 {c}eferred Ab{c}Cd" for c in every] + ["", " ", "\n\t"]
    return spark.createDataFrame([(t,) for t in rows], "text string").repartition(4).cache()


def same(texts, a, b):
    assert texts.where(~a.eqNullSafe(b)).limit(3).collect() == []


@pytest.mark.parametrize("name", PLAIN)
def test_patterns_take_the_same(texts, name):
    new = content.SOURCES[int(name[-1])] if name.startswith("SOURCES") else getattr(content, name, None) or getattr(tx, name)
    t = F.col("text")
    if name in COUNTS:
        same(texts, F.regexp_extract_all(t, F.lit(PLAIN[name]), F.lit(0)), F.regexp_extract_all(t, F.lit(new), F.lit(0)))
    same(texts, t.rlike(PLAIN[name]), t.rlike(new))
    assert texts.where(t.rlike(new)).limit(1).count() == 1


def test_definitions_have_what_is_looked_for_first(texts):
    t = F.col("text")
    assert texts.where(t.rlike(content.DEFINITION)).limit(1).count() == 1
    assert texts.where(t.rlike(content.DEFINITION) & ~t.rlike(content.DEFINING)).limit(3).collect() == []


def test_padded_texts_are_those_that_a_rule_matches(texts):
    t = F.col("text")
    same(texts, t.rlike("(?iU)" + "|".join(p for p, _ in claims.PLAINER)), t.rlike(claims.PADDED))
    assert texts.where(t.rlike(claims.PADDED)).limit(1).count() == 1


def test_phrases_are_those_that_stand_in_a_text(spark, texts):
    t = F.col("text")
    for phrases in (content.FILLER, content.GENERATED, ("plain", "in essence,")):
        rows = spark.createDataFrame([(f"un{p}x {p.upper()}",) for p in phrases], "text string").unionByName(texts)
        plain = F.filter(F.array(*[F.lit(p) for p in phrases]), lambda p: F.contains(F.lower(t), p))
        same(rows, plain, tx.phrases_in(t, phrases))


def test_sentences_and_words(texts):
    t = F.col("text")
    words = lambda x: F.filter(F.split(x, r"\s+"), lambda w: w != "")
    same(texts, words(t), tx.spaced_words(t))
    sentences = F.filter(F.split(t, "[.!?]"), lambda x: x.rlike(r"\S"))
    both = content.sentence_counts(t)
    same(texts, F.size(sentences), both["n"])
    same(texts, F.size(F.filter(sentences, lambda x: F.size(words(x)).between(5, 25))), both["clear"])


def test_self_containment_measures_only_what_it_shows(spark, sf):
    plan = passage_self_containment(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "Gartner" not in plan and "defined" not in plan
