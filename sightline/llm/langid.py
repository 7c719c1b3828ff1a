"""Language identification: known words by their frequency in each language, unseen ones by ever shorter n-grams.

Every distinct word of the corpus gets its log frequencies once, in Spark: a learnt word its own, an unseen one the mean
of its longest known n-grams. Tasks hold a table of the most frequent words, of a bounded size; all other words of a text
leave its task as hashes and are joined. So no word is dropped, whatever the size of the vocabulary.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sightline.llm import wordhash
from sightline.llm.common import crc_mod, fresh, small, stored

#: Letters make words; anything else parts them.
NON_LETTER = r"[^\p{L}]+"
#: Bytes of the table of frequent words that goes to tasks; words outside it are joined.
TABLE_BYTES = 16 << 20
#: Longest n-gram for unseen words.
LONGEST = 4
#: Learnt n-grams that may be broadcast (some 100 bytes each); beyond that all n-grams of unseen words leave their tasks.
GRAM_ROWS = 500_000
#: Words of a text from which on more of them don't sharpen the score.
FULL_WORDS = 20


def letters_text(text):
    return F.trim(F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), NON_LETTER, " ")))


def counted(docs: DataFrame) -> DataFrame:
    """docs(text, lang) as (lang, g, n): how often each word stands in the texts of each lang, null ones too."""
    w = docs.select("lang", F.explode(F.split(letters_text(F.col("text")), " ")).alias("g")).where("g <> ''")
    return stored(w.groupBy("lang", "g").agg(F.count(F.lit(1)).alias("n")), "lang-words")


def ngrams(word: Column) -> Column:
    """The n-grams of a word with a mark at either end, each with its length."""
    marked = F.concat(F.lit("^"), word, F.lit("$"))

    def of_size(n: int) -> Column:  # a lambda with a second parameter would get the index
        return F.transform(F.sequence(F.lit(1), F.length(marked) - n + 1), lambda i: F.struct(F.lit(n).alias("size"), F.substring(marked, i, F.lit(n)).alias("gram")))

    none = F.array().cast("array<struct<size:int,gram:string>>")
    return F.concat(*[F.when(F.length(marked) >= n, of_size(n)).otherwise(none) for n in range(1, LONGEST + 1)])


def summed(rows: DataFrame, key: str, columns: int) -> DataFrame:
    return rows.groupBy(key).agg(F.array(*[F.sum(F.col("ns")[j]) for j in range(columns)]).alias("ns"))


def logs_of(rows: DataFrame, columns: int) -> Column:
    """Log frequencies of ns among the sums of all rows, smoothed by half a count; floats, so that tables are small."""
    total = rows.agg(*[F.sum(F.col("ns")[j]) for j in range(columns)]).first()
    return F.array(*[F.log((F.col("ns")[j] + 0.5) / float((total[j] or 0) + 1)).cast("float") for j in range(columns)])


class Model(NamedTuple):
    """Languages in the order of names; log frequencies of all learnt words (g, logs) and n-grams (gram, logs)."""

    langs: list[str]
    words: DataFrame
    grams: DataFrame


def fit(docs: DataFrame) -> Model:
    """docs(text, lang): learns from all words of all texts with a non-null lang."""
    return fit_counts(counted(docs.where("lang is not null")))


def fit_counts(counts: DataFrame) -> Model:
    """counts(lang, g, n), of which the rows without a lang are left out. A language costs four bytes a word."""
    known = counts.where("lang is not null")
    langs = sorted(r[0] for r in known.select("lang").distinct().collect())
    k = len(langs)
    if not k:
        none = known.select("g", F.array().cast("array<float>").alias("logs"))
        return Model([], none, none.withColumnRenamed("g", "gram"))
    by_lang = F.array(*[F.when(F.col("lang") == x, F.col("n")).otherwise(F.lit(0)) for x in langs])
    words = stored(summed(known.select("g", by_lang.alias("ns")), "g", k), "lang-vocabulary")
    grams = words.select("ns", F.explode(ngrams(F.col("g"))).alias("x")).select("ns", F.col("x.gram").alias("gram"))
    grams = stored(summed(grams, "gram", k), "lang-grams")
    return Model(langs, words.select("g", logs_of(words, k).alias("logs")), grams.select("gram", logs_of(grams, k).alias("logs")))


@F.pandas_udf(T.LongType())
def word_hash(words: pd.Series) -> pd.Series:
    return pd.Series(wordhash.Words([w.encode("utf-8", "surrogatepass") for w in words]).hashes()[1].view(np.int64))


def valued(vocabulary: DataFrame, model: Model) -> DataFrame:
    """vocabulary(g, n) as (h, n, logs): a word's log frequencies, or the mean of those of its longest known n-grams.

    A word of which no n-gram is known has no row. n-grams are looked up for distinct words that weren't learnt alone;
    where the learnt ones are broadcast, a word's n-grams stay in the task that has the word.
    """
    k = len(model.langs)
    learnt = vocabulary.join(model.words, "g").select("g", "n", "logs")
    unseen = vocabulary.join(model.words, "g", "left_anti")
    parts = unseen.select("g", "n", F.explode(ngrams(F.col("g"))).alias("x")).select("g", "n", "x.*").join(small(model.grams, GRAM_ROWS), "gram")
    means = parts.groupBy("g", "n", "size").agg(F.array(*[F.avg(F.col("logs")[j]).cast("float") for j in range(k)]).alias("logs"))
    longest = means.groupBy("g", "n").agg(F.max_by("logs", "size").alias("logs"))
    return stored(learnt.unionByName(longest).select(word_hash("g").alias("h"), "n", "logs"), "lang-values")


def parted(values: DataFrame, rows: int) -> tuple[DataFrame, DataFrame]:
    """The words more frequent than a bound that at most `rows` words pass, and the others."""
    step = F.floor(F.log2(F.col("n")) * 8)
    left, cut = rows, None
    for r in values.groupBy(step.alias("step")).count().orderBy(F.col("step").desc()).collect():  # under 512 steps
        left -= r["count"]
        if left < 0:
            break
        cut = r["step"]
    return (values.limit(0), values) if cut is None else (values.where(step >= cut), values.where(step < cut))


def partial(docs: DataFrame, frequent: DataFrame, langs: int, text: str, names: list[str]) -> DataFrame:
    """docs without the text, with a row number, sums of the logs of its frequent words, how many these are, the hashes of
    the others, and whether it has a word: the columns of names."""
    number, total, used, rare, some = names
    table = frequent.select("h", "logs").toArrow()
    h = table["h"].to_numpy().view(np.uint64)
    logs = table["logs"].combine_chunks().flatten().to_numpy().reshape(len(h), langs) if len(h) else np.zeros((0, langs), np.float32)
    order = np.argsort(h)
    sent = docs.sparkSession.sparkContext.broadcast((h[order], logs[order]))
    kept = [c for c in docs.columns if c != text]
    made = docs.withColumns({text: letters_text(F.col(text)), number: F.monotonically_increasing_id()})
    into = T.StructType([*[docs.schema[c] for c in kept], T.StructField(number, T.LongType()), T.StructField(total, T.ArrayType(T.DoubleType())), T.StructField(used, T.LongType()), T.StructField(rare, T.ArrayType(T.LongType())), T.StructField(some, T.BooleanType())])

    def add(batches):
        known, value = sent.value
        for pdf in batches:
            out = pdf[[*kept, number]].copy()
            sums, uses, others, has = np.zeros((len(pdf), langs)), np.zeros(len(pdf), np.int64), [np.zeros(0, np.int64)] * len(pdf), np.zeros(len(pdf), bool)
            for first, w in wordhash.chunks(list(pdf[text])):
                size, last = len(w.count), first + len(w.count)
                hashes = w.hashes()[1]
                at = np.minimum(np.searchsorted(known, hashes), max(len(known) - 1, 0))
                hit = known[at] == hashes if len(known) else np.zeros(len(hashes), bool)
                of, at = w.text[hit], at[hit]
                uses[first:last] = np.bincount(of, minlength=size)
                for j in range(langs):
                    sums[first:last, j] = np.bincount(of, value[at, j].astype(np.float64), size)
                missed = np.split(hashes[~hit].view(np.int64), np.cumsum(np.bincount(w.text[~hit], minlength=size))[:-1])
                others[first:last] = missed
                has[first:last] = w.count > 0
            out[total], out[used], out[rare], out[some] = list(sums), uses, pd.Series(others, out.index, object), has
            yield out

    return stored(made.mapInPandas(add, into), "lang-sums")


def predicted(docs: DataFrame, model: Model, text: str = "text", table_bytes: int = TABLE_BYTES) -> DataFrame:
    """docs without their text, with lang_pred and score (the probability of that language).

    A text's words speak with equal weight; the mean of their log frequencies, times their number (FULL_WORDS at
    most), makes the probabilities. Null texts and texts without a letter are 'und' with score 0, as are all if the
    model knows no language; a text of which no n-gram is known has the first language with an even score. Ties go to
    the first language in the order of names. Repeated rows each keep their own row.
    """
    return judged(docs, model, counted(docs.select(F.col(text).alias("text"), F.lit(None).cast("string").alias("lang"))), text, table_bytes)


def judged(docs: DataFrame, model: Model, counts: DataFrame, text: str, table_bytes: int) -> DataFrame:
    """predicted() with the counts of the words of docs."""
    k, (lang, score) = len(model.langs), fresh(docs, "lang_pred", "score")
    if not k:
        return docs.drop(text).withColumns({lang: F.lit("und"), score: F.lit(0.0)})
    number, total, used, rare, some, more, many = names = fresh(docs, "lang_row", "lang_sums", "lang_used", "lang_rare", "lang_some", "lang_more", "lang_many")
    frequent, others = parted(valued(counts.groupBy("g").agg(F.sum("n").alias("n")), model), table_bytes // (8 + 4 * k))
    sums = partial(docs, frequent, k, text, names[:5])
    joined = sums.select(number, F.explode(rare).alias("h")).join(others.select("h", "logs"), "h")
    joined = joined.groupBy(number).agg(F.array(*[F.sum(F.col("logs")[j]) for j in range(k)]).alias(more), F.count(F.lit(1)).alias(many))
    n = F.col(used) + F.coalesce(F.col(many), F.lit(0))
    scale = F.least(n, F.lit(FULL_WORDS)) / F.greatest(n, F.lit(1))
    none = F.array(*[F.lit(0.0)] * k)
    out = sums.join(joined, number, "left").withColumn(total, F.zip_with(total, F.coalesce(F.col(more), none), lambda a, b: (a + b) * scale))
    out = out.withColumn(total, F.transform(total, lambda x: F.exp(x - F.array_max(total))))
    best = F.element_at(F.array(*[F.lit(x) for x in model.langs]), F.array_position(total, F.array_max(total)).cast("int"))
    sure = F.array_max(total) / F.aggregate(total, F.lit(0.0), lambda a, x: a + x)
    out = out.withColumns({lang: F.when(F.col(some), best).otherwise(F.lit("und")), score: F.when(F.col(some), sure).otherwise(F.lit(0.0))})
    return out.drop(*names)


def identified(docs: DataFrame, table_bytes: int = TABLE_BYTES) -> DataFrame:
    """docs (doc_id, text, lang and any others) without their text, with held_out, lang_pred and score.

    Learnt from texts and langs of rows whose crc32(doc_id as text) mod 4 is not 2 (a null id counts as an empty text).
    """
    held = crc_mod(F.col("doc_id"), 4) == 2
    counts = counted(docs.select("text", F.when(~held, F.col("lang").cast("string")).alias("lang")))
    out = judged(docs, fit_counts(counts), counts, "text", table_bytes)
    return out.withColumn(fresh(docs, "held_out")[0], held)
