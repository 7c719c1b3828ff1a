"""MinHash near-duplicates: BagMinHash signatures of shingle multisets, banded, then verified by exact overlap.

Each shingle with count c is a bag of unit weights 1..c, cut into the levels 1, 2, 3-4, 5-8, ... . A Poisson process
runs over each level; a point has a time, a component of the signature and a unit of the level, and counts if the bag
reaches that unit. A component holds the earliest point that fell into it, so two texts agree in a component with a
probability equal to their weighted Jaccard similarity. Points later than the time by which all components are full
are never made.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.llm import wordhash
from sightline.llm.common import SHINGLE, SIMILARITY, fresh, released, small, stored, words_text
from sightline.llm.wordhash import mix
from sightline.operators import similarity

#: Bands of so many components: at similarity 0.8 a pair shares no band in 1 of 10^5 cases.
BANDS, ROWS = 50, 7
#: Texts of a bucket from which on texts are drawn before its pairs are measured, and how many a text is measured against.
FULL, DRAWN = 24, 8
_U = np.uint64
_STEP, _LEVEL = _U(0xD1B54A32D192ED03), _U(0x8CB92BA72F3D8DD7)


def bags(w: wordhash.Words, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, hash and count of each different shingle, in order of text and hash."""
    text, h = wordhash.shingles(w, n)
    order = np.lexsort((h, text))
    text, h = text[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
    at = np.flatnonzero(new)
    return text[at], h[at], np.diff(np.append(at, len(h)))


def signatures(text: np.ndarray, h: np.ndarray, count: np.ndarray, texts: int, m: int) -> np.ndarray:
    """texts x m; a text without shingles has zeros. Times are in units of 1 / m."""
    best, who = np.full(texts * m, np.inf), np.zeros(texts * m, np.uint64)
    weight = np.bincount(text, count, texts)
    todo, slack = weight > 0, 5.0
    while todo.any():
        limit = np.where(todo, (np.log(m) + slack) / np.maximum(weight, 1), 0.0)
        of, seed, low, width, top = [], [], [], [], []
        k, lo, wide = 0, 0, 1
        here = np.flatnonzero(todo[text])
        while len(here):
            of.append(text[here]), seed.append(mix(h[here] + _U((k + 1) * int(_LEVEL) % 2**64))), top.append(count[here])
            low.append(np.full(len(here), lo)), width.append(np.full(len(here), wide))
            k, lo, wide = k + 1, lo + wide, max(1, lo + wide)
            here = here[count[here] > lo]
        of, seed, low, width, top = map(np.concatenate, (of, seed, low, width, top))
        time = np.zeros(len(of))
        while len(of):
            seed = seed + _STEP
            a = mix(seed)
            time = time - np.log(((a >> _U(11)).astype(np.float64) + 0.5) * 2.0**-53) / width
            go = time < m * limit[of]
            of, seed, low, width, top, time, a = (x[go] for x in (of, seed, low, width, top, time, a))
            b = mix(a ^ _LEVEL)
            real = low + (b % width.astype(np.uint64)).astype(np.int64) < top
            cell, t, mark = (of * m + (mix(b) % _U(m)).astype(np.int64))[real], time[real], b[real]
            np.minimum.at(best, cell, t)
            first = best[cell] == t
            who[cell[first]] = mark[first]
        full = np.isfinite(best).reshape(texts, m).all(axis=1)
        todo, slack = todo & ~full, slack + 15
    return who.reshape(texts, m)


def band_keys(texts: list, n: int, bands: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the bands of each text, and its number of shingles."""
    keys, weights = np.zeros((len(texts), bands), np.uint64), np.zeros(len(texts), np.int64)
    for first, w in wordhash.chunks(texts):
        text, h, count = bags(w, n)
        size = len(w.count)
        sig = signatures(text, h, count, size, bands * rows).reshape(size, bands, rows)
        out = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * _LEVEL, (size, bands)).copy()
        for r in range(rows):
            out = mix(out * _STEP + sig[:, :, r])
        keys[first : first + size] = out
        weights[first : first + size] = np.bincount(text, count, size)
    return keys, weights


def bag_members(texts: list, n: int) -> list[np.ndarray]:
    """A hash for each member of each text's multiset of shingles: the k-th of equal ones has one of its own for each k,
    so that two of these sets overlap as the multisets do."""
    out = []
    for _, w in wordhash.chunks(texts):
        text, h, count = bags(w, n)
        one = np.repeat(np.arange(len(h)), count)
        nth = (np.arange(len(one)) - np.repeat(np.cumsum(count) - count, count)).astype(np.uint64)
        sizes = np.bincount(text, count, len(w.count)).astype(np.int64)
        out += np.split(mix(h[one] + nth * _STEP).view(np.int64), np.cumsum(sizes)[:-1])
    return out


def overlap(a: list, b: list, n: int) -> np.ndarray:
    """Weighted Jaccard similarity of the shingle multisets of a[i] and b[i]; 0 if either has none."""
    out = np.zeros(len(a))
    both = [x for pair in zip(a, b) for x in pair]
    for first, w in _pairs(both):
        text, h, count = bags(w, n)
        pair = text // 2
        order = np.lexsort((text, h, pair))
        pair, h, count = pair[order], h[order], count[order]
        same = np.flatnonzero((pair[1:] == pair[:-1]) & (h[1:] == h[:-1]))
        shared = np.bincount(pair[same], np.minimum(count[same], count[same + 1]), len(w.count) // 2)
        total = np.bincount(pair, count, len(w.count) // 2)
        out[first : first + len(shared)] = shared / np.maximum(total - shared, 1)
    return out


def _pairs(both: list):
    """chunks() that never part the two texts of a pair."""
    got, size, first = [], 0, 0
    for i in range(0, len(both), 2):
        got += [(x or "").encode("utf-8", "surrogatepass") for x in both[i : i + 2]]
        size += len(got[-1]) + len(got[-2])
        if size > wordhash.CHUNK or i + 2 == len(both):
            yield first, wordhash.Words(got)
            got, size, first = [], 0, i // 2 + 1


def components(edges: DataFrame) -> DataFrame:
    """edges(a, b) -> (k, root): the smallest node that a node is linked with over any number of links."""
    links = stored(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = stored(links.groupBy(F.col("a").alias("k")).agg(F.min(F.least("a", "b")).alias("root")), "labels")
    while True:
        near = links.join(labels.select(F.col("k").alias("b"), "root"), "b").groupBy(F.col("a").alias("k")).agg(F.min("root").alias("near"))
        new = labels.join(near, "k").select("k", F.least("root", "near").alias("to"), F.col("root").alias("was"))
        # each label then takes its own label's label: chains shorten by half each time
        jump = labels.select(F.col("k").alias("to"), F.col("root").alias("next"))
        new = stored(new.join(jump, "to", "left").select("k", F.least("to", F.coalesce("next", "to")).alias("root"), "was"), "labels")
        if new.where("root <> was").limit(1).count() == 0:
            return new.select("k", "root")
        labels = new.select("k", "root")


def verified(pairs: DataFrame, texts: DataFrame, n: int, least: float) -> DataFrame:
    """pairs(a, b) of keys whose texts(k, norm) have a similarity of at least `least`; only texts in pairs move."""

    def measure(batches):
        for pdf in batches:
            sim = overlap(list(pdf["x"]), list(pdf["y"]), n)
            yield pdf.loc[sim >= least, ["a", "b"]].assign(similarity=sim[sim >= least])

    ids = stored(pairs.select(F.col("a").alias("k")).unionByName(pairs.select(F.col("b").alias("k"))).distinct(), "pair-ids")
    texts = texts.join(small(ids), "k", "left_semi")
    # a is often the same; its text comes last
    one = pairs.join(texts.select(F.col("k").alias("b"), F.col("norm").alias("y")), "b")
    two = one.join(texts.select(F.col("k").alias("a"), F.col("norm").alias("x")), "a")
    return two.select("a", "b", "x", "y").mapInPandas(released(measure), "a binary, b binary, similarity double")


def keyed(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs(doc_id, text) -> (doc_id, k, norm): texts with the same words have the same key."""
    norm = words_text(F.col(text))
    return docs.select("doc_id", norm.alias("norm")).select("doc_id", F.unhex(F.md5("norm")).alias("k"), "norm")


def stars(band: DataFrame) -> DataFrame:
    """band(band, k, size) -> (a, b): each text b with the text a that meets most others in the buckets of b.

    The text from which a group of near-copies was made agrees with each of them more than they do with each other,
    so it stands in the largest buckets.
    """
    met = stored(band.groupBy("k").agg(F.sum("size").alias("met")), "met")
    hubs = band.join(met, "k").groupBy("band").agg(F.max(F.struct("met", "k")).alias("hub"))
    best = band.join(hubs, "band").where(F.col("k") != F.col("hub.k")).groupBy("k").agg(F.max("hub").alias("hub"))
    return best.select(F.col("hub.k").alias("a"), F.col("k").alias("b"))


def mixed(rows: DataFrame) -> DataFrame:
    """rows(band, root, ...) of the buckets that hold more than one class."""
    ends = rows.groupBy("band").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("band")
    return rows.join(ends, "band")


def links(docs: DataFrame, n: int = SHINGLE, least: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS) -> tuple[DataFrame, DataFrame]:
    """(members(doc_id, k), edges(a, b, similarity) between keys that connect all near-duplicates).

    Each text of a bucket is measured against the one of its buckets that meets most others; what is linked then needs
    no more pairs. In buckets of more than FULL texts that hold more than one class one text is drawn, and each text of
    another class is measured against the DRAWN texts with which it shares most buckets, which joins most of what is
    left. Texts of buckets that hold more than one class even then go through an exact join of their multisets, whatever
    the size of a bucket: pairs of different classes meet by rare shingles, of which those without enough in common
    mostly share none. So thousands of copies of one text cost a few rows for each of them, and no link between
    different classes is left out but for those that share no band.
    """
    texts = keyed(docs)

    def sign(batches):
        for pdf in batches:
            keys, weight = band_keys(list(pdf["norm"]), n, bands, rows)
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "k": pdf["k"], "weight": weight, "bands": list(keys.view(np.int64))})

    signed = stored(texts.mapInPandas(released(sign), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, k binary, weight long, bands array<long>"), "signed")
    members = signed.select("doc_id", "k", "weight")
    unique = signed.where("weight > 0").groupBy("k").agg(F.first("bands").alias("bands"))
    band = unique.select("k", F.explode("bands").alias("band"))
    sizes = band.groupBy("band").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    band = stored(band.join(sizes, "band"), "bands")
    near = stored(band.select("k").distinct(), "near")
    near_texts = stored(texts.select("k", "norm").join(small(near), "k", "left_semi").dropDuplicates(["k"]), "near-texts")
    tried = stored(stars(band), "stars")
    edges = stored(verified(tried, near_texts, n, least), "edges")
    ordered = lambda df: df.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    tried = ordered(tried)

    def open_buckets():
        rows = band.join(components(edges), "k", "left").select("k", "band", "size", F.coalesce("root", "k").alias("root"))
        return stored(mixed(rows), "rest")

    # large buckets: each text with the texts drawn in its buckets
    rest_bands = open_buckets()
    drawn = mixed(rest_bands.where(F.col("size") > FULL))
    heads = drawn.groupBy("band").agg(F.min(F.struct(F.xxhash64("k", "band").alias("h"), "k", "root")).alias("head"))
    met = drawn.join(heads, "band").where(F.col("root") != F.col("head.root")).groupBy("k", F.col("head.k").alias("c")).agg(F.count(F.lit(1)).alias("n"))
    best = met.groupBy("k").agg(F.slice(F.sort_array(F.collect_list(F.struct("n", "c")), False), 1, DRAWN).alias("best"))  # of `bands` at most
    more = ordered(best.select(F.col("k").alias("a"), F.explode("best.c").alias("b"))).distinct()
    more = stored(more.join(tried, ["a", "b"], "left_anti"), "drawn")
    if more.limit(1).count():
        edges = stored(edges.unionByName(verified(more, near_texts, n, least)), "edges2")
        tried = tried.unionByName(more)
        rest_bands = open_buckets()
    rest = stored(rest_bands.select("k", F.col("root").alias("kin")).distinct(), "rest-classes")

    def members_of(batches):
        for pdf in batches:
            yield pd.DataFrame({"id": pdf["k"], "tokens": bag_members(list(pdf["norm"]), n)})

    bags_ = near_texts.join(small(rest.select("k")), "k", "left_semi").mapInPandas(released(members_of), "id binary, tokens array<long>")
    ordered_bags = similarity.ordered_sets(stored(bags_, "bags")).join(rest.withColumnRenamed("k", "id"), "id")
    pairs = similarity.prefix_pairs(stored(ordered_bags, "ordered-bags"), least)
    pairs = stored(pairs.join(tried, ["a", "b"], "left_anti"), "pairs")
    if pairs.limit(1).count():
        edges = stored(edges.unionByName(verified(pairs, near_texts, n, least)), "edges3")
    return members, edges


def classes(docs: DataFrame, n: int = SHINGLE, least: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row per row of docs: doc_id, class_id (the smallest doc_id of its class), class_size, is_first, and k, the
    digest of the text's words.

    Texts of the same words are one class; so are texts whose multisets of n-word shingles have a weighted Jaccard
    similarity of `least` or more, directly or over others. A text of fewer than n words is one shingle. Texts without
    words (null too) are alone, each in its own class. is_first: true for one row of each class, that with the
    smallest doc_id (of equal rows one, nulls last); class_id is null if no row of the class has an id.
    """
    members, edges = links(docs, n, least, bands, rows)
    labels = components(edges)
    # rows without words, and rows that are alike in all, are told apart by a number
    rows_ = stored(members.withColumn("row", F.monotonically_increasing_id()), "members")
    rows_ = rows_.join(labels, "k", "left")
    alone = F.when(F.col("weight") == 0, F.concat(F.lit("row ").cast("binary"), F.col("row").cast("string").cast("binary")))
    rows_ = stored(rows_.select("doc_id", "row", "k", F.coalesce(alone, "root", "k").alias("root")), "rooted")
    heads = rows_.groupBy("root").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("class_size"), F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("head"))
    return rows_.join(heads, "root").select("doc_id", "class_id", "class_size", (F.col("row") == F.col("head.row")).alias("is_first"), "k")


def deduplicated(docs: DataFrame, **options) -> DataFrame:
    """docs without all but the first row of each class; of equal rows of one id one stays, as do all without words."""
    found = classes(docs.select("doc_id", "text"), **options)
    each = stored(found.groupBy("doc_id", "k").agg(F.max("is_first").alias("first"), F.count(F.lit(1)).alias("rows")), "firsts")
    ident, key, mark = fresh(docs, "dedup_id", "dedup_key", "dedup_mark")
    same = F.col("doc_id").eqNullSafe(F.col(ident)) & (F.col(mark) == F.col(key))
    named = lambda df: df.select(F.col("doc_id").alias(ident), F.col("k").alias(key))
    marked = docs.withColumn(mark, F.unhex(F.md5(words_text(F.col("text")))))
    stay = marked.join(small(stored(named(each.where("not first")), "drop")), same, "left_anti")
    empty = F.unhex(F.md5(F.lit("")))
    again = stored(named(each.where("first and rows > 1").where(F.col("k") != empty)), "again")
    if again.limit(1).count():
        repeated = stay.join(small(again), same, "left_semi").dropDuplicates(["doc_id", mark])
        stay = stay.join(small(again), same, "left_anti").unionByName(repeated)
    return stay.drop(mark)
