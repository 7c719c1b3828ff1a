"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

An item of n shingles of which a document holds a share of `least` or more has at most n - ceil(least n) shingles that
the document lacks; so of any n - ceil(least n) + 1 of its shingles the document holds one. The signature of an item is
that many of its smallest hashes, with the number set by its size partition (the powers of two), and no document that
must be found is missed. A signature on the documents' side would have to be long in proportion to the document, as an
item is a thousandth of it; there all shingles are looked up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.llm.common import SHINGLE, SIMILARITY, small, stored, words


def _hashes(w: Column, m: int) -> Column:
    """Hash of each m consecutive words of the array w; null entries don't occur."""
    at = lambda i: F.xxhash64(F.lit(m), *[w[i + j] for j in range(m)])
    return F.when(F.size(w) >= m, F.transform(F.sequence(F.lit(0), F.size(w) - m), at)).otherwise(F.array().cast("array<bigint>"))


def _strings(w: Column, m: Column) -> Column:
    """The different strings of m consecutive words."""
    made = F.transform(F.sequence(F.lit(1), F.size(w) - m + 1), lambda i: F.array_join(F.slice(w, i, m), " "))
    return F.when(F.size(w) >= m, F.array_distinct(made)).otherwise(F.array().cast("array<string>"))


def contained(docs: DataFrame, items: DataFrame, least: float = SIMILARITY, n: int = SHINGLE) -> DataFrame:
    """docs(doc_id, text), items(item_id, text) -> doc_id, item_id, n_shingles, n_shared, containment.

    A row for each item of whose different n-word shingles a document holds a share of `least` or more. An item of
    fewer words is one shingle of all its words. Null and empty items and texts match nothing; rows with a null id
    are left out. Of several texts with one id that with the most shared shingles counts, repeated rows count once.
    """
    kept = items.where("item_id is not null").select("item_id", words(F.col("text")).alias("w")).where("size(w) > 0").distinct()
    kept = kept.withColumn("m", F.least(F.size("w"), F.lit(n)))
    kept = kept.withColumn("s", _strings(F.col("w"), F.col("m"))).withColumn("n_shingles", F.size("s"))
    lengths = range(1, n + 1)
    by_length = F.coalesce(*[F.when(F.col("m") == m, _hashes(F.col("w"), m)) for m in lengths])
    kept = stored(kept.withColumn("h", F.array_sort(F.array_distinct(by_length))).select("item_id", "m", "s", "n_shingles", "h"), "items")
    used = sorted(r[0] for r in kept.select("m").distinct().collect())  # at most n numbers
    top = F.pow(F.lit(2), F.ceil(F.log2("n_shingles"))).cast("int")
    length = F.least(F.col("n_shingles"), top - F.ceil(top * least - 1e-9).cast("int") + 1)
    keys = stored(kept.select("item_id", F.explode(F.slice("h", 1, length)).alias("h"), F.ceil(F.col("n_shingles") * least - 1e-9).cast("int").alias("need")), "signatures")
    texts = docs.where("doc_id is not null").select("doc_id", words(F.col("text")).alias("w"))
    shingles = F.concat(*[_hashes(F.col("w"), m) for m in used]) if used else F.array().cast("array<bigint>")
    # a document shorter than the share that an item needs can't hold it
    probes = texts.select("doc_id", F.size("w").alias("size"), F.explode(shingles).alias("h"))
    found = stored(probes.join(small(keys), "h").where("size >= need").select("doc_id", "item_id").distinct(), "candidates")
    both = texts.join(small(found), "doc_id").join(small(kept.select("item_id", "m", "s", "n_shingles")), "item_id")
    shared = F.size(F.array_intersect("s", _strings(F.col("w"), F.col("m"))))
    out = both.groupBy("doc_id", "item_id", "n_shingles").agg(F.max(shared).alias("n_shared"))
    return out.where(F.col("n_shared") >= F.col("n_shingles") * least - 1e-9).select("doc_id", "item_id", "n_shingles", "n_shared", (F.col("n_shared") / F.col("n_shingles")).alias("containment"))


def decontaminated(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """docs without the documents that hold an item; rows with a null id stay."""
    bad = stored(contained(docs.select("doc_id", "text"), items, **options).select("doc_id").distinct(), "contaminated")
    return docs.join(small(bad), "doc_id", "left_anti")
