"""The queries of the thirteen operators over their whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.llm import bagminhash, bpe, centroids, chat, compact_windows, decontamination, hard_negatives, langid, licenses, quality_lm, quality_rules, simhash, toxicity

#: Vocabulary of op4 and of the pipeline's last stage.
VOCABULARY = "byte_bpe_50k.tiktoken"


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "documents").select("doc_id", "text")


def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contained(_documents(spark, sf_dir), _read(spark, sf_dir, "benchmark"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compact_windows.repeated(_documents(spark, sf_dir)).drop("text_key")


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = quality_lm.judged(docs, _read(spark, sf_dir, "labels"))
    return out.select("doc_id", "lang", F.round("perplexity", 4).alias("perplexity"), "keep")


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.digests(_documents(spark, sf_dir), bpe.read_ranks(public_tokenizers.path(VOCABULARY)), public_tokenizers.PATTERN)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = langid.identified(_read(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    return out.select("doc_id", "held_out", "lang_pred", "score")


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = licenses.scanned(_documents(spark, sf_dir))
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op7_chat_preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = chat.paired(chat.neighbours(_read(spark, sf_dir, "conversations")))
    written = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws("-", s["start"], s["end"])), ",").alias(c)
    return out.select("pair_id", "n_chosen", "n_rejected", "n_common", "prompt", "chosen", "rejected", written("chosen_spans"), written("rejected_spans"))


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bagminhash.classes(_documents(spark, sf_dir)).drop("k")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scored(_documents(spark, sf_dir), _read(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return quality_rules.judged(docs, _read(spark, sf_dir, "labels")).drop("text", "lang")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    noisy = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mined(_read(spark, sf_dir, "embeddings").withColumn("label", noisy), F.col("vec_id") % 50 == 0)


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.inertias(*centroids.clustered(_read(spark, sf_dir, "embeddings")))


def op13_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.linked(_documents(spark, sf_dir))


QUERIES = {f.__name__: f for f in (op1_benchmark_decontamination, op2_substring_dedup, op3_quality_classifier, op4_byte_bpe, op5_language_id, op6_license_scan, op7_chat_preference, op8_minhash_near_dedup, op9_toxicity, op10_quality_rules, op11_hard_negatives, op12_centroid_clustering, op13_simhash_near_dedup)}

_KEPT = """select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) v from embeddings
  where {where} and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0"""


def _rounds(n: int) -> str:
    """The rounds of op12, each one's assignment and its centroids as tables of their own."""
    nearest = "select vec_id, v, arg_min(k, (d, k)) cluster, min(d) distance from (select vec_id, v, k, list_sum(list_transform(list_zip(v, c), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) d from kept, c{i}) group by vec_id, v"
    floor = "cast((s - ((s % n) + n) % n) // n as bigint)"
    out = []
    for i in range(n + 1):
        out.append(f"a{i} as materialized ({nearest.format(i=i)})")
        if i < n:
            means = f"select cluster k, list(m order by i) c from (select cluster, i, {floor} m from (select cluster, i, sum(x) s, count(*) n from (select cluster, unnest(v) x, unnest(range(len(v))) i from a{i}) group by 1, 2)) group by 1"
            out.append(f"c{i + 1} as materialized (with m as ({means}) select k, coalesce(m.c, c{i}.c) c from c{i} left join m using (k))")
    return ",\n".join(out)


ORACLE_SQL = {
    "op1_benchmark_decontamination": """
with d as (select doc_id, string_split(trim(lower(regexp_replace(text, '[^\\p{L}\\p{N}]+', ' ', 'g'))), ' ') w from documents),
ds as (select distinct doc_id, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) s from d where len(w) >= 5),
b as (select item_id, string_split(trim(lower(regexp_replace(text, '[^\\p{L}\\p{N}]+', ' ', 'g'))), ' ') w from benchmark),
bs as (select distinct item_id, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) s from b where len(w) >= 5),
n as (select item_id, count(*) n from bs group by item_id)
select doc_id, item_id, cast(any_value(n) as int) n_shingles, cast(count(*) as int) n_shared, count(*) / any_value(n) containment
from ds join bs using (s) join n using (item_id) group by doc_id, item_id having count(*) >= 0.8 * any_value(n) - 1e-9""",
    "op7_chat_preference": """
with t as (select distinct conv_id // 2 pair_id, conv_id % 2 side, turn, role, text from conversations where conv_id is not null),
o as (select *, row_number() over (partition by pair_id, side order by turn nulls first, role nulls first, text nulls first) i,
  '<|' || coalesce(role, '') || '|>' || chr(10) head, coalesce(text, '') || chr(10) || '<|end|>' || chr(10) body from t),
n as (select pair_id, count(*) filter (side = 0) n_chosen, count(*) filter (side = 1) n_rejected from o group by 1),
m as (select a.pair_id, min(a.i) i from o a left join o b on a.pair_id = b.pair_id and a.side <> b.side and a.i = b.i
  and a.role is not distinct from b.role and a.text is not distinct from b.text where b.i is null group by 1),
c as (select n.*, coalesce(m.i - 1, least(n_chosen, n_rejected)) n_common from n left join m using (pair_id)),
p as (select o.*, n_common, sum(length(head) + length(body)) over (partition by o.pair_id, side, i > n_common order by i) till from o join c using (pair_id)),
s as (select pair_id, side, coalesce(string_agg(head || body, '' order by i) filter (i > n_common), '') done,
  coalesce(string_agg(head || body, '' order by i) filter (i <= n_common), '') prompt,
  coalesce(string_agg((till - length(body)) || '-' || till, ',' order by i) filter (i > n_common and role = 'assistant'), '') spans from p group by 1, 2)
select c.pair_id, cast(n_chosen as int) n_chosen, cast(n_rejected as int) n_rejected, cast(n_common as int) n_common, coalesce(x.prompt, y.prompt) prompt,
  coalesce(x.done, '') chosen, coalesce(y.done, '') rejected, coalesce(x.spans, '') chosen_spans, coalesce(y.spans, '') rejected_spans
from c left join s x on x.pair_id = c.pair_id and x.side = 0 left join s y on y.pair_id = c.pair_id and y.side = 1""",
    "op11_hard_negatives": f"""
with e as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end label, v
  from ({_KEPT.format(where="embedding is not null and label is not null").replace("select vec_id,", "select vec_id, label,")})),
s as materialized (select a.vec_id a, b.vec_id b, a.label = b.label same, cast(list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2])) as bigint) s
  from e a join e b on a.vec_id % 50 = 0 and a.vec_id <> b.vec_id),
p as (select a, b, s from s where same qualify row_number() over (partition by a order by s desc, b) <= 5),
n as (select p.a, p.b p, p.s ps, s.b n, s.s ns, row_number() over (partition by p.a, p.b order by s.s desc, s.b) r
  from p join s on p.a = s.a and not s.same and 50 * p.s <= 100 * s.s and 100 * s.s <= 95 * p.s)
select a anchor_id, p positive_id, cast(r as int) rank, n negative_id, ps positive_score, ns negative_score from n where r <= 3""",
    "op12_centroid_clustering": f"""
with kept as materialized ({_KEPT.format(where="len(embedding) = 64")}),
c0 as (select row_number() over (order by sha256('2:' || vec_id)) - 1 k, v c from kept order by sha256('2:' || vec_id) limit 40),
{_rounds(5)},
t as (select cluster, sum(distance) n from a5 group by 1)
select vec_id, cast(cluster as int) cluster, cast(distance as bigint) distance, cast(t.n as bigint) cluster_inertia,
  cast((select sum(distance) from a5) as bigint) inertia, sha256(array_to_string(c5.c, ',')) centroid_sha256
from a5 join t using (cluster) join c5 on c5.k = a5.cluster""",
}
