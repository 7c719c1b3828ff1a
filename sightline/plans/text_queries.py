"""Queries over documents: content quality, citability, phrase and overlap measures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.functions import text as tx
from sightline.operators import claims, content
from sightline.registry import query, table

# Word characters as a class: what \b stands between in the operators' patterns.
_W = r"\p{L}\p{Nd}_"
# In SQL a word boundary is one character that isn't of a word; separators are doubled so that neighbours share none.
_DOUBLED = rf"regexp_replace(text, '([^{_W}])', '\1\1', 'g')"
_ENTITY = rf"len(regexp_extract_all(dt, '(?:^|[^{_W}])[A-Z][a-z]+(?:\s+[A-Z][a-z]+)+(?:[^{_W}]|$)'))"
_NUMBER = rf"len(regexp_extract_all(dt, '(?:^|[^{_W}])\d+(?:(?:\.\.|,,)\d+)?(?:st|nd|rd|th)?(?:[^{_W}]|$)'))"


def _sql_list(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


_QUALITY = f"""
with d as (select doc_id, lang, source, coalesce(text, '') as text from documents),
w as (select *, {_DOUBLED} as dt, list_transform(regexp_extract_all(text, '[A-Za-z][A-Za-z''\\-]*'), lambda x: lower(x)) as t from d),
b as (select doc_id, pair, count(*) as c from (select doc_id, unnest(list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])) as pair from w where len(t) >= 4) group by all),
r as (select doc_id, count(*) filter (c > 1) / count(*) as rep from b group by doc_id),
m as (select w.*, len(t) as n, {_ENTITY} + {_NUMBER} as facts, coalesce(rep, 0) as rep,
  len(list_filter({_sql_list(content.FILLER)}, lambda p: contains(lower(text), p))) as pad,
  len(list_filter({_sql_list(content.GENERATED)}, lambda p: contains(lower(text), p))) as gen from w left join r using (doc_id)),
s as (select *, greatest(1.0, n / 1000) as scale, least(1.0, facts * 100 / greatest(1, n) / 10) as dens from m),
q as (select *, cast(least(100, round(pad / scale * 25)) as bigint) as filler, cast(least(100, round(gen / scale * 15)) as bigint) as generated, cast(round(rep * 100) as bigint) as repetition from s),
o as (select *, cast(round(0.25 * (100 - filler) + 0.25 * (100 - generated) + 25 * dens + 0.15 * (100 - repetition) + 0.1 * least(100, n / 10)) as bigint) as overall, trim(regexp_replace(text, '\\s+', ' ', 'g')) = '' as blank from q)
"""


@query(_QUALITY + """select doc_id, if(blank, 0, n) as n_tokens, if(blank, 0, len(list_distinct(t))) as unique_tokens, if(blank, 0, filler) as filler, if(blank, 0, generated) as generated,
 if(blank, 0, round(dens * 1000) / 1000) as density, if(blank, 0, repetition) as repetition, if(blank, 0, overall) as overall, if(blank, false, overall >= 60) as passed,
 if(blank, 'empty-input', concat_ws(',', if(filler >= 50, 'filler', null), if(generated >= 40, 'ai-patterns', null), if(dens < 0.2, 'low-density', null), if(repetition >= 30, 'repetitive', null), if(n < 300, 'thin-content', null))) as flags from o""")
def content_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = content.quality(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    return out.withColumn("flags", F.array_join("flags", ","))


@query(_QUALITY + """select lang, source, count(*) as docs, round(avg(if(blank, 0, overall)) * 100) / 100 as mean_overall, count(*) filter (not blank and overall >= 60) as passed, count(*) filter (n < 300 and not blank) as thin from o group by lang, source""")
def content_quality_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = content.quality(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))
    thin = F.array_contains("flags", "thin-content")
    return out.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("docs"), tx.half_up(F.avg("overall"), 2).alias("mean_overall"), F.count_if("passed").alias("passed"), F.count_if(thin).alias("thin"))


_CITABLE = f"""
with d as (select doc_id, coalesce(text, '') as text from documents),
w as (select *, {_DOUBLED} as dt, list_filter(regexp_split_to_array(text, '[ \\t\\n\\f\\r\\x0B]+'), lambda x: x <> '') as ws, list_filter(regexp_split_to_array(text, '[.!?]'), lambda x: regexp_matches(x, '[^ \\t\\n\\f\\r\\x0B]')) as ss from d),
m as (select *, len(ws) as n, len(ss) as s, len(list_filter(ss, lambda x: len(list_filter(regexp_split_to_array(x, '[ \\t\\n\\f\\r\\x0B]+'), lambda y: y <> '')) between 5 and 25)) as clear,
  len(regexp_extract_all(dt, '(?i)(?:^|[^{_W}])(?:it|they|them|their|this|that|these|those|he|she|his|her)(?:[^{_W}]|$)')) as pronouns,
  len(regexp_extract_all(dt, '(?:^|[^{_W}])[A-Z][a-z]+(?:\\s+[A-Z][a-z]+)*(?:[^{_W}]|$)')) as proper from w)
"""


@query(_CITABLE + """select doc_id, n as word_count, s as sentences, clear, pronouns, proper, least(25, case when n between 134 and 167 then 10 when n between 100 and 200 then 7 when n between 80 and 250 then 4 when n not between 30 and 400 then 0 else 2 end
 + case when n = 0 then 0 when pronouns / n < 0.02 then 8 when pronouns / n < 0.04 then 5 when pronouns / n < 0.06 then 3 else 0 end + case when proper >= 3 then 7 when proper >= 1 then 4 else 0 end) as self_contained from m""")
def passage_self_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tx.text_or_empty(F.col("text"))
    parts = F.struct(F.size(tx.spaced_words(t)).cast("long").alias("word_count"), content.sentence_counts(t).alias("s"), tx.matches(t, content.PRONOUN).alias("pronouns"), tx.matches(t, content.PROPER).alias("proper"))
    out = table(spark, sf_dir, "documents").select("doc_id", F.inline(F.array(parts)))
    contained = content.containment(F.col("word_count"), F.col("pronouns"), F.col("proper")).cast("long")
    return out.select("doc_id", "word_count", F.col("s.n").alias("sentences"), F.col("s.clear").alias("clear"), "pronouns", "proper", contained.alias("self_contained"))


@query()
def citability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All five parts of the score for every document as one passage; checked by fixtures in the tests."""
    return content.citability(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


@query(r"""with d as (select lang, regexp_split_to_array(text, '[^\p{L}\p{N}_]+') as w from documents)
select lang, sum(len(list_filter(w, lambda x: x <> ''))) as words, count(*) as docs from d group by lang""")
def words_by_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("lang", "text")
    return docs.groupBy("lang").agg(F.sum(tx.word_count(F.col("text"))).alias("words"), F.count(F.lit(1)).alias("docs"))


@query("""select source, doc_id, n_chars from documents qualify row_number() over (partition by source order by n_chars desc, doc_id) <= 3""")
def longest_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    order = Window.partitionBy("source").orderBy(F.col("n_chars").desc(), "doc_id")
    return table(spark, sf_dir, "documents").select("source", "doc_id", "n_chars").withColumn("r", F.row_number().over(order)).where("r <= 3").drop("r")


@query("""select coalesce(d.lang, '') as lang, count(*) as docs, count(l.doc_id) as labelled, count(*) filter (l.quality = 1) as good, count(*) filter (l.toxic = 1) as toxic, count(*) filter (l.doc_id is null) as unlabelled
from documents d left join labels l on d.doc_id = l.doc_id group by 1""")
def label_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("lang", F.lit("")).alias("lang"))
    both = docs.join(table(spark, sf_dir, "labels").withColumn("has", F.lit(1)), "doc_id", "left")
    return both.groupBy("lang").agg(F.count(F.lit(1)).alias("docs"), F.count("has").alias("labelled"), F.count_if(F.col("quality") == 1).alias("good"), F.count_if(F.col("toxic") == 1).alias("toxic"), F.count_if(F.col("has").isNull()).alias("unlabelled"))


@query("""with s as (select source, doc_id, substring(sha256(coalesce(text, '')), 1, 16) as h from documents) select h as text_hash, count(*) as copies, count(distinct source) as sources, min(doc_id) as first_id from s group by h having count(*) > 1""")
def exact_duplicate_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = F.substring(F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256), 1, 16)
    rows = table(spark, sf_dir, "documents").select("doc_id", "source", h.alias("text_hash"))
    return rows.groupBy("text_hash").agg(F.count(F.lit(1)).alias("copies"), F.count_distinct("source").alias("sources"), F.min("doc_id").alias("first_id")).where("copies > 1")


@query()
def document_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims and uncited claims of every document; checked by fixtures in the tests."""
    return claims.verified(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("""select doc_id, trim(regexp_replace(regexp_replace(coalesce(text, ''), '[ \\t]{2,}', ' ', 'g'), ' ([,.;:!?])', '\\1', 'g')) as cleaned, 0 as changes from documents""")
def plainer_wording(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The test data has none of the wording, so its texts are only tidied; the rules are tested on fixtures."""
    out = claims.plainer(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    return out.withColumn("cleaned", F.trim("cleaned"))
