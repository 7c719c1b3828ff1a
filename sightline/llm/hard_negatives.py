"""Hard negatives by a dual-tree search over integer vectors.

One tree is cut over anchors, one over candidates: cells by planes that are fitted on a bounded sample, packed blocks of
a cell's rows, and leaves in a block. Each node has a centre and a radius, which give an interval of the inner
products of two nodes. A pair of nodes is dropped when the interval can't meet what any of its anchors still needs, so
whole groups of anchors leave at once; leaves that stay are scored exactly. What anchors need comes from a first block
that is scored before the rest.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sightline.llm.common import stored
from sightline.llm.vectors import known, matrix, products

#: Of op11's contract: components, positives of an anchor, negatives of a positive, and their share of its score in %.
SIZE, POSITIVES, NEGATIVES, LEAST, MOST = 64, 5, 3, 50, 95
#: Vectors on which the planes are fitted, and cells at most.
SAMPLE, CELLS = 8192, 256
#: Rows of a block of candidates and of anchors (dealt by hash, so some more), and of their leaves.
BLOCK, SLICE, LEAF, SLICE_LEAF = 4096, 256, 64, 16
_NODE = "cell int, node long, size int, centre array<double>, radius double, leaves array<int>, leaf_centres binary, leaf_radii array<double>, ids binary, rows binary, labels binary, v binary"


def _halves(v: np.ndarray) -> tuple[np.ndarray, float] | None:
    """A plane between two far points of v, through the median; None if all points are equal."""
    mean = v.mean(0)
    a = v[((v - mean) ** 2).sum(1).argmax()]
    way = v[((v - a) ** 2).sum(1).argmax()] - a
    p = v @ way
    at = float(np.median(p))
    if (p <= at).all():
        at = float(p.min())
    return None if (p <= at).all() else (way, at)


class Planes:
    """A binary tree of planes over sampled vectors, cut until it has `cells` leaves or equal points."""

    def __init__(self, v: np.ndarray, cells: int) -> None:
        self.way, self.at, self.below, self.cells = [], [], [], 0
        todo = [(v, None, 0)]
        leaves = 1
        while todo:
            part, parent, side = todo.pop(0)
            cut = _halves(part) if leaves < cells and len(part) > 1 else None
            if cut is None:
                child, self.cells = -1 - self.cells, self.cells + 1
            else:
                leaves += 1
                child = len(self.way)
                self.way.append(cut[0])
                self.at.append(cut[1])
                self.below.append([0, 0])
                low = part @ cut[0] <= cut[1]
                todo += [(part[low], child, 0), (part[~low], child, 1)]
            if parent is not None:
                self.below[parent][side] = child

    def cell(self, v: np.ndarray) -> np.ndarray:
        """The cell of each row of v."""
        at = np.zeros(len(v), np.int64) if self.way else np.full(len(v), -1)
        while (inner := np.flatnonzero(at >= 0)).size:
            for node in np.unique(at[inner]):
                r = inner[at[inner] == node]
                at[r] = np.where(v[r] @ self.way[node] <= self.at[node], *self.below[node])
        return -1 - at


def leaves(v: np.ndarray, most: int) -> list[np.ndarray]:
    """Row numbers of each leaf of a tree over v that halves at medians down to `most` rows."""
    todo, out = [np.arange(len(v))], []
    while todo:
        r = todo.pop()
        cut = _halves(v[r]) if len(r) > most else None
        if cut is None:  # equal points stay together, in pieces
            out += np.array_split(r, -(-len(r) // most))
        else:
            low = v[r] @ cut[0] <= cut[1]
            todo += [r[low], r[~low]]
    return out


def ball(v: np.ndarray) -> tuple[np.ndarray, float]:
    centre = v.mean(0)
    return centre, float(np.sqrt(((v - centre) ** 2).sum(1).max()) * (1 + 1e-9) + 1e-6)


def interval(a: np.ndarray, ra: np.ndarray, b: np.ndarray, rb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest inner product of points in balls (centres a, radii ra) with points in balls (b, rb)."""
    middle, na, nb = a @ b.T, np.sqrt((a * a).sum(1)), np.sqrt((b * b).sum(1))
    reach = (na[:, None] * rb[None, :] + ra[:, None] * nb[None, :] + ra[:, None] * rb[None, :]) * (1 + 1e-9)
    slack = 1e-9 * np.abs(middle) + 1e-3
    return middle - reach - slack, middle + reach + slack


def _packed(rows: DataFrame, size: int, leaf: int) -> DataFrame:
    """rows(cell, row, id, label, v) as blocks of some `size` rows of a cell, with their balls and leaves."""

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        v = matrix(pdf["v"])
        cut = leaves(v.astype(np.float64), leaf)
        order = np.concatenate(cut)
        balls = [ball(v[r].astype(np.float64)) for r in cut]
        centre, radius = ball(v.astype(np.float64))
        part = pdf.iloc[order]
        bytes_of = lambda x, t: x.to_numpy().astype(t).tobytes()
        node = (int(pdf["cell"].iloc[0]) << 32) + int(pdf["chunk"].iloc[0])
        return pd.DataFrame([[int(pdf["cell"].iloc[0]), node, len(pdf), centre.tolist(), radius, [len(r) for r in cut], np.array([c for c, _ in balls]).tobytes(), [r for _, r in balls], bytes_of(part["id"], "<i8"), bytes_of(part["row"], "<i8"), bytes_of(part["label"], "<i8"), v[order].astype("<i4").tobytes()]], columns=[f.split()[0] for f in _NODE.split(", ")])

    counts = {r["cell"]: r["n"] for r in rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}  # CELLS rows
    if not counts:
        return rows.sparkSession.createDataFrame([], _NODE)
    chunks = F.element_at(F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, -(-n // size))]), F.col("cell"))
    return rows.withColumn("chunk", F.pmod(F.xxhash64("row"), chunks)).groupBy("cell", "chunk").applyInPandas(pack, _NODE)


class _Node:
    """A packed node in a task."""

    def __init__(self, r, prefix: str, size: int) -> None:
        get = lambda c, t: np.frombuffer(r[f"{prefix}{c}"], t)
        self.ids, self.rows, self.labels = get("ids", "<i8"), get("rows", "<i8"), get("labels", "<i8")
        self.v = get("v", "<i4").reshape(-1, size).astype(np.int64)
        self.centres, self.radii = get("leaf_centres", "<f8").reshape(-1, size), np.asarray(r[f"{prefix}leaf_radii"], np.float64)
        stop = np.cumsum(np.asarray(r[f"{prefix}leaves"], np.int64))
        self.spans = list(zip(np.concatenate([[0], stop[:-1]]), stop))


def first(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest scores, ties by the smaller id."""
    if len(scores) > 4 * k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= least)
        return at[np.lexsort((ids[at], -scores[at]))[:k]]
    return np.lexsort((ids, -scores))[:k]


def _positives(anchors: _Node, block: _Node, need: np.ndarray, k: int) -> Iterator[tuple]:
    """(anchor's row, id, score): the first k candidates of its label that an anchor has in this block."""
    _, high = interval(anchors.centres, anchors.radii, block.centres, block.radii)
    for n, (s, e) in enumerate(anchors.spans):
        at = [np.arange(*span) for span, h in zip(block.spans, high[n]) if h >= need[s:e].min()]
        if not at:
            continue
        at = np.concatenate(at)
        for i, scores in zip(range(s, e), products(anchors.v[s:e], block.v[at])):
            fit = (block.labels[at] == anchors.labels[i]) & (block.ids[at] != anchors.ids[i]) & (scores >= need[i])
            fit = np.flatnonzero(fit)
            for j in fit[first(scores[fit], block.ids[at[fit]], k)]:
                yield anchors.rows[i], block.ids[at[j]], scores[j]


def _negatives(anchors: _Node, block: _Node, low: np.ndarray, high: np.ndarray, k: int) -> Iterator[tuple]:
    """(anchor's row, positive, id, score): the first k candidates of another label from low to high, for each positive."""
    under, over = interval(anchors.centres, anchors.radii, block.centres, block.radii)
    some = low <= high
    for n, (s, e) in enumerate(anchors.spans):
        if not some[s:e].any():
            continue
        lo, hi = low[s:e][some[s:e]].min(), high[s:e][some[s:e]].max()
        at = [np.arange(*span) for span, u, o in zip(block.spans, under[n], over[n]) if o >= lo and u <= hi]
        if not at:
            continue
        at = np.concatenate(at)
        for i, scores in zip(range(s, e), products(anchors.v[s:e], block.v[at])):
            other = np.flatnonzero((block.labels[at] != anchors.labels[i]) & (scores >= low[i].min()) & (scores <= high[i].max()))
            for p in np.flatnonzero(some[i]):
                fit = other[(scores[other] >= low[i, p]) & (scores[other] <= high[i, p])]
                for j in fit[first(scores[fit], block.ids[at[fit]], k)]:
                    yield anchors.rows[i], p, block.ids[at[j]], scores[j]


def _pairs(slices: DataFrame, blocks: DataFrame, cells: dict) -> DataFrame:
    """slices(slice, centre, radius, lo, hi) x blocks -> (slice, block): the pairs whose interval meets lo to hi.

    Each slice goes down the candidates' tree: through the cells first (`cells`: their balls, CELLS at most), then
    through the blocks of the cells that stay, which are joined.
    """
    numbers, centres, radii = cells["cell"], cells["centre"], cells["radius"]

    def meets(pdf, b, rb):
        a, ra = np.stack(pdf["centre"].to_numpy()), pdf["radius"].to_numpy()
        low, high = interval(a, ra, b, rb)
        return (high >= pdf["lo"].to_numpy()[:, None]) & (low <= pdf["hi"].to_numpy()[:, None])

    def enter(batches):
        for pdf in batches:
            if len(pdf):
                r, c = np.nonzero(meets(pdf, centres, radii))
                yield pdf.iloc[r].assign(cell=numbers[c].astype(np.int32))

    def stay(batches):
        for pdf in batches:
            if len(pdf):
                a, b = np.stack(pdf["centre"].to_numpy()), np.stack(pdf["b_centre"].to_numpy())
                ra, rb = pdf["radius"].to_numpy(), pdf["b_radius"].to_numpy()
                middle, na, nb = (a * b).sum(1), np.sqrt((a * a).sum(1)), np.sqrt((b * b).sum(1))
                reach = (na * rb + ra * nb + ra * rb) * (1 + 1e-9) + 1e-9 * np.abs(middle) + 1e-3
                yield pdf.loc[(middle + reach >= pdf["lo"]) & (middle - reach <= pdf["hi"]), ["slice", "block"]]

    head = "slice long, centre array<double>, radius double, lo double, hi double"
    entered = slices.select("slice", "centre", "radius", "lo", "hi").mapInPandas(enter, f"{head}, cell int")
    balls = blocks.select("cell", F.col("node").alias("block"), F.col("centre").alias("b_centre"), F.col("radius").alias("b_radius"))
    return entered.join(balls, "cell").drop("cell").mapInPandas(stay, "slice long, block long")


def _cells(blocks: DataFrame) -> dict:
    """The ball of each cell over the balls of its blocks: CELLS rows at most reach the driver."""
    size = len(blocks.select("centre").first()[0])
    mean = blocks.groupBy("cell").agg(F.array(*[F.avg(F.col("centre")[i]) for i in range(size)]).alias("middle"))
    far = F.sqrt(F.aggregate(F.zip_with("centre", "middle", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
    rows = blocks.select("cell", "centre", "radius").join(mean, "cell").groupBy("cell").agg(F.first("middle").alias("middle"), F.max(far * (1 + 1e-9) + F.col("radius")).alias("radius")).collect()
    return {"cell": np.array([r["cell"] for r in rows]), "centre": np.array([r["middle"] for r in rows]), "radius": np.array([r["radius"] for r in rows]) + 1e-6}


def _scored(pairs: DataFrame, slices: DataFrame, blocks: DataFrame, state: list[str], size: int, score: Callable, schema: str) -> DataFrame:
    """score(anchors, block, row) of each pair, with both nodes in the row: two nodes are all that a task holds."""
    packed = ["leaves", "leaf_centres", "leaf_radii", "ids", "rows", "labels", "v"]
    a = slices.select("slice", *state, *[F.col(c).alias(f"a_{c}") for c in packed])
    b = blocks.select(F.col("node").alias("block"), *[F.col(c).alias(f"b_{c}") for c in packed])
    names = [f.split()[0] for f in schema.split(", ")]

    def work(batches):
        for pdf in batches:
            for r in pdf.to_dict("records"):
                got = list(score(_Node(r, "a_", size), _Node(r, "b_", size), r))
                if got:
                    yield pd.DataFrame(got, columns=names)

    return pairs.join(a, "slice").join(b, "block").mapInPandas(work, schema)


def _state(slices: DataFrame, kind: str, values: DataFrame, width: int, *names: str) -> DataFrame:
    """slices with an array for each name: values(row, p, name...) in the order of the slice's rows, `width` a row."""
    where = slices.select("slice", "rows").mapInPandas(lambda batches: (pd.DataFrame({"slice": np.repeat(pdf["slice"].to_numpy(), [len(x) // 8 for x in pdf["rows"]]), "row": np.concatenate([np.frombuffer(x, "<i8") for x in pdf["rows"]]), "place": np.concatenate([np.arange(len(x) // 8) for x in pdf["rows"]])}) for pdf in batches if len(pdf)), "slice long, row long, place int")
    grid = where.withColumn("p", F.explode(F.sequence(F.lit(0), F.lit(width - 1)))).join(values, ["row", "p"], "left")
    # a slice's places, each with `width` values: bounded by SLICE
    rows = grid.groupBy("slice").agg(F.sort_array(F.collect_list(F.struct("place", "p", *names))).alias("all"))
    return slices.drop(*names).join(rows.select("slice", *[F.col("all")[n].cast(kind).alias(n) for n in names]), "slice")


def _best(found: DataFrame, keys: list[str], k: int, rank: str) -> DataFrame:
    """The first k rows of each key by score, ties by the smaller id; each task cuts its own to k before the shuffle."""
    return found.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc("id")))).where(F.col(rank) <= k)


def mined(df: DataFrame, is_anchor: Column, ident: str = "vec_id", label: str = "label", vector: str = "embedding", size: int = SIZE, positives: int = POSITIVES, negatives: int = NEGATIVES, least: int = LEAST, most: int = MOST) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score), all long but for rank.

    Scores are inner products of whole numbers (vectors.whole). Each row for which is_anchor holds has as positives the
    `positives` other rows of its label with the largest scores, and for each of these as negatives the `negatives` rows
    of other labels with the largest scores from `least` to `most` % of the positive's; ties go to the smaller id. A
    positive with a score below zero has no negatives, one of zero those of score zero.

    Rows without id, label or usable vector of `size` components take no part. Rows that repeat in all three count
    once; rows of one id that differ count each, and none of them is a positive of another. Of equal vectors of a label
    only so many with the smallest ids are candidates as could ever be returned, which keeps any group of copies
    small and the result whole. Other columns of df are not read; an empty table gives an empty result.
    """
    spark = df.sparkSession
    id_, label_ = F.col(ident).cast("long"), F.col(label).cast("long")
    rows = known(df.select(F.struct(id_.alias("id"), label_.alias("label"), F.coalesce(is_anchor, F.lit(False)).alias("anchor")).alias("who"), F.col(vector).alias("x")), "who", "x", size)
    rows = rows.select("who.*", "v").where("id is not null and label is not null").dropDuplicates(["id", "label", "v"])
    rows = stored(rows.withColumn("row", F.monotonically_increasing_id()), "rows")
    total = rows.count()
    fit = rows.orderBy(F.xxhash64("row")).select("v").limit(SAMPLE).collect()  # SAMPLE rows
    planes = Planes(np.array([r["v"] for r in fit], np.float64).reshape(len(fit), size), min(CELLS, max(1, total // BLOCK)))

    def place(batches):
        for pdf in batches:
            if len(pdf):
                yield pdf.assign(cell=planes.cell(matrix(pdf["v"]).astype(np.float64)).astype(np.int32))

    celled = stored(rows.mapInPandas(place, "id long, label long, anchor boolean, v array<long>, row long, cell int"), "cells")
    keep = max(positives + 1, negatives)
    few = celled.withColumn("n", F.row_number().over(Window.partitionBy("label", "v").orderBy("id", "row"))).where(F.col("n") <= keep)
    blocks = stored(_packed(few.drop("n"), BLOCK, LEAF), "blocks")
    slices = stored(_packed(celled.where("anchor"), SLICE, SLICE_LEAF).withColumnRenamed("node", "slice"), "slices")
    out = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not slices.limit(1).count():
        return spark.createDataFrame([], out)
    cells = _cells(blocks)

    # the block that each slice meets first: of the cell whose centre it has the largest product with
    def nearest(batches):
        for pdf in batches:
            if len(pdf):
                best = (np.stack(pdf["centre"].to_numpy()) @ cells["centre"].T).argmax(1)
                yield pd.DataFrame({"slice": pdf["slice"], "cell": cells["cell"][best].astype(np.int32)})

    heads = blocks.groupBy("cell").agg(F.min("node").alias("block"))
    seeds = stored(slices.select("slice", "centre").mapInPandas(nearest, "slice long, cell int").join(F.broadcast(heads), "cell").select("slice", "block"), "seeds")  # a row a cell

    def positive(anchors, block, r):
        need = np.array(r["need"], np.float64) if r.get("need") is not None else np.full(len(anchors.ids), -np.inf)
        return _positives(anchors, block, need, positives)

    found = "row long, id long, score long"
    begun = stored(_scored(seeds, slices, blocks, [], size, positive, found), "positives-first")
    enough = _best(begun, ["row"], positives, "n").where(F.col("n") == positives).select("row", F.lit(0).alias("p"), F.col("score").cast("double").alias("need"))
    ready = stored(_state(slices, "array<double>", enough.select("row", "p", "need"), 1, "need"), "needs").withColumn("need", F.transform("need", lambda x: F.coalesce(x, F.lit(float("-inf")))))
    todo = ready.select("slice", "centre", "radius", F.array_min("need").alias("lo"), F.lit(float("inf")).alias("hi"))
    pairs = stored(_pairs(todo, blocks, cells).join(seeds, ["slice", "block"], "left_anti"), "pairs")
    more = _scored(pairs, ready, blocks, ["need"], size, positive, found)
    best = stored(_best(begun.unionByName(more), ["row"], positives, "p").select("row", (F.col("p") - 1).alias("p"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")

    bounds = best.select("row", "p", F.ceil(F.col("positive_score") * least / 100).cast("double").alias("low"), F.floor(F.col("positive_score") * most / 100).cast("double").alias("high"))

    def windowed(slices_: DataFrame, lows: DataFrame) -> DataFrame:
        """slices with low and high of each anchor's positives; where there are none, low is over high."""
        got = _state(slices_, "array<double>", lows, positives, "low", "high")
        fill = lambda c, x: F.transform(c, lambda y: F.coalesce(y, F.lit(x)))
        return stored(got.withColumns({"low": fill("low", float("inf")), "high": fill("high", float("-inf"))}), "windows")

    def negative(anchors, block, r):
        return _negatives(anchors, block, np.array(r["low"], np.float64).reshape(-1, positives), np.array(r["high"], np.float64).reshape(-1, positives), negatives)

    found = "row long, p int, id long, score long"
    begun = stored(_scored(seeds, windowed(slices, bounds), blocks, ["low", "high"], size, negative, found), "negatives-first")
    enough = _best(begun, ["row", "p"], negatives, "n").where(F.col("n") == negatives).select("row", "p", F.col("score").cast("double").alias("third"))
    ready = windowed(slices, bounds.join(enough, ["row", "p"], "left").select("row", "p", F.greatest("low", "third").alias("low"), "high"))
    both = F.filter(F.arrays_zip("low", "high"), lambda s: s["low"] <= s["high"])
    todo = ready.select("slice", "centre", "radius", F.array_min(F.transform(both, lambda s: s["low"])).alias("lo"), F.array_max(F.transform(both, lambda s: s["high"])).alias("hi")).where("lo is not null")
    pairs = stored(_pairs(todo, blocks, cells).join(seeds, ["slice", "block"], "left_anti"), "pairs")
    more = _scored(pairs, ready, blocks, ["low", "high"], size, negative, found)
    ranked = _best(begun.unionByName(more), ["row", "p"], negatives, "rank")
    named = ranked.select("row", "p", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    who = celled.where("anchor").select("row", F.col("id").alias("anchor_id"))
    return named.join(best, ["row", "p"]).join(who, "row").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
