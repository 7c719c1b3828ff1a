"""Near-duplicate pages and records, exactly: a set-similarity join with prefix, length and position filters, and
records that differ in few fields by keys that leave those fields out."""

from __future__ import annotations

from itertools import combinations
from math import comb

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sightline.functions import text as tx
from sightline.sources.shared import stored

#: Words in a shingle, the similarity over which content counts as a copy, and the share under which it counts as thin.
SHINGLE, COPY, THIN, THIN_WORDS = 3, 0.8, 0.4, 300
#: A token with more than a hundred-thousandth of all rows is frequent: there are 100,000 of them at most.
FREQUENT = 100_000
#: Rows of one token's prefix index that meet in a task; tokens with more are cut by salts.
MEET = 5_000


def shingles(words: Column, n: int = SHINGLE) -> Column:
    """The distinct hashes of n neighbouring words; fewer words are one shingle, none (and null) have none."""
    text = lambda i: F.array_join(F.slice(words, i, n), " ")
    many = F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - n + 1, F.lit(1))), lambda i: F.xxhash64(text(i)))
    return F.when(F.coalesce(F.size(words), F.lit(0)) > 0, F.array_distinct(many)).otherwise(F.array().cast("array<bigint>"))


def content_sets(pages: DataFrame, visible: Column, n: int = SHINGLE) -> DataFrame:
    """pages(page_id, ...) -> (page_id, words, tokens): the words of the visible text, and its shingles as a set."""
    words = F.filter(F.split(F.lower(tx.text_or_empty(visible)), r"[^\p{L}\p{N}_]+"), lambda w: w != "")
    # the words are bound to a variable: as an expression they would be worked out again for each shingle
    made = F.transform(F.array(words), lambda w: F.struct(F.size(w).alias("words"), shingles(w, n).alias("tokens")))[0]
    return pages.select("page_id", made.alias("m")).select("page_id", "m.words", "m.tokens")


def representatives(sets: DataFrame) -> DataFrame:
    """sets(page_id, tokens) -> (page_id, class_id): pages with the same set have the smallest page_id of them.

    Sets without tokens are alone: each page is its own class.
    """
    key = F.when(F.size("tokens") > 0, F.xxhash64(F.array_sort("tokens"))).otherwise(F.xxhash64(F.lit("empty"), "page_id"))
    keyed = sets.select("page_id", key.alias("k"), F.size("tokens").alias("n"))
    first = keyed.groupBy("k", "n").agg(F.min("page_id").alias("class_id"))  # a class of any size is one row a task
    return keyed.join(first, ["k", "n"]).select("page_id", "class_id")


def ordered_sets(sets: DataFrame) -> DataFrame:
    """sets(id unique, tokens distinct) -> (id, n, tokens): how many tokens the set has, and those that stand in another
    set too, rarest first, ties by the token. Sets that share no token are left out.

    A token of one set alone can't be shared, so that its number is enough. Frequencies come back to the rows by token.
    Frequent tokens, whose number is bounded, are broadcast, so that no token's rows are more than a hundred-thousandth
    of all in the join that shuffles the rest.
    """
    rows = sets.select("id", F.size("tokens").alias("n"), F.explode("tokens").alias("token"))
    counts = stored(rows.groupBy("token").agg(F.count(F.lit(1)).alias("df")).where("df > 1"), "token-counts")
    least = max(counts.agg(F.sum("df")).first()[0] or 0, 1) / FREQUENT
    frequent = F.broadcast(counts.where(F.col("df") > least).withColumnRenamed("df", "often"))
    marked = rows.join(frequent, "token", "left")
    rare = marked.where("often is null").join(counts.where(F.col("df") <= least), "token").select("id", "n", "df", "token")
    every = rare.unionByName(marked.where("often is not null").select("id", "n", F.col("often").alias("df"), "token"))
    # one set's own tokens
    return every.groupBy("id", "n").agg(F.transform(F.array_sort(F.collect_list(F.struct("df", "token"))), lambda x: x["token"]).alias("tokens"))


def prefix_pairs(ordered: DataFrame, least: float) -> DataFrame:
    """ordered_sets(), with a column `kin` or without -> (a, b), a < b: all pairs that may have a Jaccard similarity of
    `least` or more; none of the same kin.

    Two such sets share a token among the first n - ceil(least * n) + 1 of each when both are ordered alike. The order
    puts rare tokens first, so common ones are hardly ever in a prefix, and tokens of one set alone take its first
    places. Lengths and the place of a shared token must leave room for enough shared ones. A token in very many prefixes
    is cut by salts.
    """
    alone = F.col("n") - F.size("tokens")
    size = F.col("n") - F.ceil(F.lit(least) * F.col("n") - 1e-9).cast("int") + 1
    kept = ["id", "n", *(c for c in ordered.columns if c == "kin")]
    rows = ordered.select(*kept, alone.alias("alone"), F.posexplode(F.slice("tokens", 1, F.greatest(size - alone, F.lit(0)))).alias("at", "token"))
    rows = rows.select("token", *kept, (F.col("alone") + F.col("at")).alias("at"))
    met = stored(rows.groupBy("token").agg(F.count(F.lit(1)).alias("sets")).where("sets > 1").withColumn("salts", F.ceil(F.col("sets") / MEET).cast("int")), "prefix-tokens")
    rows = rows.join(met.select("token", "salts"), "token")
    side = lambda p, salt: rows.select("token", salt.alias("salt"), *[F.col(c).alias(f"{c}_{p}") for c in [*kept, "at"]])
    left = side("a", F.pmod(F.xxhash64("id"), F.col("salts")))
    right = side("b", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts").cast("long") - 1)))
    # of both, how many tokens must be shared, and how many can be from this one on
    need = F.ceil(F.lit(least / (1 + least)) * (F.col("n_a") + F.col("n_b")) - 1e-9)
    room = F.least(F.col("n_a") - F.col("at_a"), F.col("n_b") - F.col("at_b"))
    long_enough = (F.col("n_a") >= least * F.col("n_b") - 1e-9) & (F.col("n_b") >= least * F.col("n_a") - 1e-9)
    strangers = F.col("kin_a") != F.col("kin_b") if "kin" in kept else F.lit(True)
    found = left.join(right, ["token", "salt"]).where((F.col("id_a") < F.col("id_b")) & strangers & long_enough & (room >= need))
    return found.select(F.col("id_a").alias("a"), F.col("id_b").alias("b")).distinct()


def near_pairs(sets: DataFrame, least: float = COPY, strict: bool = True) -> DataFrame:
    """sets(id unique, tokens distinct) -> (a, b, shared, similarity), a < b: all pairs with a Jaccard similarity over
    `least` (from `least` on if not strict). Sets without tokens have no partner.
    """
    ordered = stored(ordered_sets(sets), "ordered-sets")
    whole = lambda p: ordered.select(F.col("id").alias(p), F.col("n").alias(f"n_{p}"), F.col("tokens").alias(f"t_{p}"))
    shared = F.size(F.array_intersect("t_a", "t_b"))
    scored = prefix_pairs(ordered, least).join(whole("a"), "a").join(whole("b"), "b").select("a", "b", shared.alias("shared"), (shared / (F.col("n_a") + F.col("n_b") - shared)).alias("similarity"))
    return scored.where(F.col("similarity") > least if strict else F.col("similarity") >= least)


def copies(sets: DataFrame, least: float = COPY) -> DataFrame:
    """sets(page_id, tokens) -> (page_id, class_id, copies, links, closest): a row for each page.

    class_id: the smallest page with the same set; copies: pages of that class; links: classes with other sets whose
    similarity is over `least`; closest: the largest of those similarities, null without links. Copies are one set of
    the join, so a group of copies of any size costs a row. page_id must be unique; an empty table gives an empty one.
    """
    sets = stored(sets.select("page_id", "tokens"), "sets")
    named = stored(representatives(sets), "classes")
    firsts = sets.join(named.where("page_id = class_id").select("page_id"), "page_id").select(F.col("page_id").alias("id"), "tokens")
    pairs = stored(near_pairs(firsts, least), "near-pairs")
    both = pairs.select(F.col("a").alias("class_id"), "similarity").unionByName(pairs.select(F.col("b").alias("class_id"), "similarity"))
    links = both.groupBy("class_id").agg(F.count(F.lit(1)).alias("links"), F.max("similarity").alias("closest"))
    sizes = named.groupBy("class_id").agg(F.count(F.lit(1)).alias("copies"))
    return named.join(sizes.join(links, "class_id", "left"), "class_id").select("page_id", "class_id", "copies", F.coalesce("links", F.lit(0)).alias("links"), "closest")


def unique_content(sets: DataFrame, thin: float = THIN, words: int = THIN_WORDS) -> DataFrame:
    """sets(page_id, words, tokens) -> (page_id, words, shingles, own, share, flags): how much of a page no other has.

    own: shingles that stand on this page alone; share: own of all, null without any. flags: "thin" under the share,
    "short" under the number of words. Counting needs one row a token and task, however common it is.
    """
    rows = sets.select("page_id", F.explode("tokens").alias("token"))
    alone = rows.groupBy("token").agg(F.count(F.lit(1)).alias("df"), F.min("page_id").alias("page_id")).where("df = 1")
    own = alone.groupBy("page_id").agg(F.count(F.lit(1)).alias("own"))
    out = sets.join(own, "page_id", "left").select("page_id", "words", F.size("tokens").alias("shingles"), F.coalesce("own", F.lit(0)).alias("own"))
    out = out.withColumn("share", F.when(F.col("shingles") > 0, F.col("own") / F.col("shingles")))
    flags = F.array(F.when(F.coalesce(F.col("share"), F.lit(0.0)) < thin, "thin"), F.when(F.col("words") < words, "short"))
    return out.withColumn("flags", F.array_compact(flags))


def near_records(records: DataFrame, ident: str, fields: list[str], share: float = COPY) -> DataFrame:
    """records(ident unique, fields) -> (ident, class_id, copies, links): records that agree in more than `share` of the fields.

    class_id: the smallest ident with the same fields (null is a value like others); copies: records of that class;
    links: classes that differ from it in one field or more, and agree in enough. Two classes that agree in all but j
    of the d fields that may differ share one key for each way to leave out d - j more, so counts of keys give the
    links of each j without any pair: a value that a third of all records have costs a row a task. Keys are 64-bit
    hashes of the fields that stay.
    """
    n = len(fields)
    may_differ = n - (int(share * n + 1e-9) + 1)
    same = records.groupBy(*fields).agg(F.min(ident).alias("class_id"), F.count(F.lit(1)).alias("copies"))
    classes = stored(same, "record-classes")
    matches = None
    for d in range(1, may_differ + 1):
        keys = F.array(*[F.xxhash64(F.lit(",".join(kept)), *[x for c in kept for x in (F.isnull(c), F.col(c))]) for kept in combinations(fields, n - d)])
        rows = classes.select("class_id", F.explode(keys).alias("key"))
        sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
        one = rows.join(sizes, "key").groupBy("class_id").agg((F.sum("m") - F.count(F.lit(1))).alias(f"g{d}"))
        matches = one if matches is None else matches.join(one, "class_id", "full")
    if matches is None:
        linked = classes.select("class_id", "copies", *fields, F.lit(0).cast("long").alias("links"))
    else:
        got = classes.join(matches, "class_id", "left")
        exactly: list[Column] = []  # classes that differ in exactly 1, 2, ... fields
        for d in range(1, may_differ + 1):
            less = sum((exactly[j - 1] * comb(n - j, d - j) for j in range(1, d)), F.lit(0))
            exactly.append(F.coalesce(f"g{d}", F.lit(0)) - less)
        linked = got.select("class_id", "copies", *fields, sum(exactly, F.lit(0)).cast("long").alias("links"))
    on = [F.col(f"r.{c}").eqNullSafe(F.col(f"l.{c}")) for c in fields]
    return records.alias("r").join(linked.alias("l"), on).select(f"r.{ident}", "class_id", "copies", "links")


def near_duplicate_classes(found: DataFrame) -> DataFrame:
    """found of copies() or near_records() -> (classes, repeated, linked): how many, with copies, and with near ones."""
    one = found.groupBy("class_id").agg(F.first("copies").alias("copies"), F.first("links").alias("links"))
    return one.agg(F.count(F.lit(1)).alias("classes"), F.count_if(F.col("copies") > 1).alias("repeated"), F.count_if(F.col("links") > 0).alias("linked"))


def ranked_copies(found: DataFrame, n: int = 10) -> DataFrame:
    """The n pages of copies() with the most copies and links: a report, closest and smallest id last."""
    order = [F.desc("copies"), F.desc("links"), F.desc_nulls_last("closest"), F.asc("page_id")]
    return found.withColumn("rank", F.row_number().over(Window.orderBy(*order))).where(F.col("rank") <= n)
