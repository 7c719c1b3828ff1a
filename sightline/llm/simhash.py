"""SimHash fingerprints of word shingles, linked by anchor-point covering.

The 64 bits are cut into blocks, and each block has a threshold, so that two fingerprints within `bits` of each other
are within the threshold in one block at least (the thresholds plus one sum to bits + 1). The anchors of a block are
the words of a covering code: a perfect Hamming code over 15 bits (radius 1) beside all values of the other bits, or
all values (radius 0) where the threshold is 0. Each fingerprint lives at the anchor nearest to it and visits every
anchor within radius plus threshold; whoever lives within the threshold of it is met there. At each anchor residents
are compared with visitors over all 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.llm.bagminhash import components
from sightline.llm.common import small, stored

#: Words in a shingle and differing bits of a link, as the contract of op13 has them.
SHINGLE_WORDS, BITS = 4, 4
#: Bits of the Hamming code, and of its syndrome.
_CODE, _CHECKS = 15, 4
#: Rows of an anchor that one task compares at once; anchors with more are cut into parts, each pair of parts a group.
PART = 4096
#: Pairs of fingerprints that stand in memory at once, and hashes whose bits are counted at once.
SLAB, COUNTED = 1 << 19, 1 << 15
_LOWER = bytes(range(256)).lower()


def fingerprint(text: bytes | None, n: int = SHINGLE_WORDS) -> int:
    """The unsigned fingerprint of one text: A-Z in lower case, words between ASCII spaces, n-word shingles with their
    repeats; a shorter text is one shingle, one without words (or null) has fingerprint zero."""
    words = (text or b"").translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    start, end = [0, *(ends + 1).tolist()], [*ends.tolist(), len(joined)]
    spans = list(zip(start, end[n - 1 :])) or [(0, len(joined))]
    ones = np.zeros(64, np.int64)
    for i in range(0, len(spans), COUNTED):
        h = np.fromiter((xxhash.xxh64_intdigest(joined[a:b], 42) for a, b in spans[i : i + COUNTED]), "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(spans), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, text: str = "text", n: int = SHINGLE_WORDS) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, fp): one row per row, the fingerprint as a signed long."""

    def measure(batches):
        for pdf in batches:
            got = np.fromiter((fingerprint(t, n) for t in pdf["text"]), np.uint64, len(pdf))
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "fp": got.view(np.int64)})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col(text).cast("binary").alias("text")).mapInPandas(measure, f"doc_id {kind}, fp long")


def blocks(bits: int) -> list[tuple[int, int, int]]:
    """(first bit, width, threshold) of each block for links of so many bits; blocks of threshold 1 are five bits wider."""
    ones, zeros = divmod(bits + 1, 2)
    narrow = (64 - 5 * ones) // (ones + zeros)
    widths = [[narrow + 5, 1] for _ in range(ones)] + [[narrow, 0] for _ in range(zeros)]
    for i in range(64 - sum(w for w, _ in widths)):
        widths[i % len(widths)][0] += 1
    out, first = [], 0
    for width, t in widths:
        out.append((first, width, t))
        first += width
    if any(t and width < _CODE for _, width, t in out):
        raise ValueError(f"{bits} bits leave blocks that are narrower than the code")
    return out


def _syndrome(x: int) -> int:
    out = 0
    for i in range(_CODE):
        out ^= (i + 1) * (x >> i & 1)
    return out


def _visits(width: int, t: int) -> tuple[list[int], list[list[int]]]:
    """By syndrome: what leads from a value to its own anchor, and to each anchor within radius plus threshold."""
    if t == 0:
        return [0], [[0]]
    masks: list[list[int]] = [[] for _ in range(1 << _CHECKS)]
    for weight in range(t + 2):
        for at in combinations(range(width), weight):
            m = sum(1 << i for i in at)
            masks[_syndrome(m)].append(m)
    return [0] + [1 << (s - 1) for s in range(1, 1 << _CHECKS)], masks


def replicas(prints: DataFrame, bits: int = BITS) -> DataFrame:
    """prints(fp) -> (block, anchor, fp, lives): a row for each anchor that a fingerprint visits."""
    each = []
    for number, (first, width, t) in enumerate(blocks(bits)):
        value = F.shiftrightunsigned("fp", first).bitwiseAND(F.lit((1 << width) - 1 if width < 64 else -1))
        home, masks = _visits(width, t)
        checks = [sum(1 << i for i in range(_CODE) if (i + 1) >> b & 1) for b in range(_CHECKS)] if t else []
        syndrome = F.lit(0)
        for b, m in enumerate(checks):
            syndrome = syndrome + (F.bit_count(value.bitwiseAND(F.lit(m))) % 2) * (1 << b)
        longs = lambda xs: F.array(*[F.lit(x - (x >> 63 << 64)).cast("long") for x in xs])
        rows = prints.select("fp", value.alias("value"), syndrome.alias("s"))
        rows = rows.select("fp", "value", F.element_at(longs(home), F.col("s") + 1).alias("home"), F.explode(F.element_at(F.array(*[longs(m) for m in masks]), F.col("s") + 1)).alias("m"))
        each.append(rows.select(F.lit(number).alias("block"), F.col("value").bitwiseXOR(F.col("m")).alias("anchor"), "fp", (F.col("m") == F.col("home")).alias("lives")))
    out = each[0]
    for more in each[1:]:
        out = out.unionByName(more)
    return out


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (node, root) that join what the links (a, b) join: fewer than there are nodes."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        np.minimum.at(new, root, new.copy())
        new = new[new]
        if (new == root).all():
            break
        root = new
    moved = root != np.arange(len(nodes))
    return nodes[moved], nodes[root[moved]]


def _met(group: np.ndarray, fp: np.ndarray, role: np.ndarray, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Residents (role 1 or 2) against visitors (0 or 2) of each group, a slab of pairs at a time."""
    home, visit = np.flatnonzero(role >= 1), np.flatnonzero(role != 1)
    number = np.bincount(group[visit], minlength=group[-1] + 1)
    first = np.cumsum(number) - number
    home = home[number[group[home]] > 0]
    pairs = number[group[home]]
    slab = (np.cumsum(pairs) - pairs) // SLAB
    for s in np.unique(slab):
        h = home[slab == s]
        k = pairs[slab == s]
        left = np.repeat(h, k)
        right = visit[np.repeat(first[group[h]], k) + np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)]
        x, y = fp[left], fp[right]
        near = (x != y) & (np.bitwise_count((x ^ y).view(np.uint64)) <= bits)
        if near.any():
            yield forest(x[near], y[near])


def meetings(rows: DataFrame, bits: int = BITS) -> DataFrame:
    """rows(block, anchor, fp, lives) -> links (a, b), of which no more stay than join what is linked at an anchor.

    Anchors of over PART rows are cut by their fingerprints' hash: residents and visitors into parts, each pair of
    parts a group of its own, so that no task holds a whole large anchor.
    """
    sizes = rows.groupBy("block", "anchor").agg(F.count(F.lit(1)).alias("n"), F.count_if("lives").alias("homes"))
    parts = lambda c: F.ceil(F.col(c) / PART).cast("int").alias(f"{c}_parts")
    large = stored(sizes.where((F.col("n") > PART) & (F.col("homes") > 0)).select("block", "anchor", parts("n"), parts("homes")), "large-anchors")
    plain = rows.select("block", "anchor", F.lit(0).alias("part"), "fp", F.when(F.col("lives"), 2).otherwise(0).alias("role"))
    if large.limit(1).count():
        some = small(large)
        plain = plain.join(some, ["block", "anchor"], "left_anti")
        cut = rows.join(some, ["block", "anchor"]).withColumn("h", F.xxhash64("fp"))
        visitor = cut.select("*", F.explode(F.sequence(F.lit(0), F.col("homes_parts") - 1)).alias("i"))
        visitor = visitor.select("block", "anchor", (F.col("i") * F.col("n_parts") + F.pmod("h", F.col("n_parts"))).cast("int").alias("part"), "fp", F.lit(0).alias("role"))
        resident = cut.where("lives").select("*", F.explode(F.sequence(F.lit(0), F.col("n_parts") - 1)).alias("j"))
        resident = resident.select("block", "anchor", (F.pmod("h", F.col("homes_parts")) * F.col("n_parts") + F.col("j")).cast("int").alias("part"), "fp", F.lit(1).alias("role"))
        plain = plain.unionByName(visitor).unionByName(resident)

    def compare(batches):
        rest = None
        for pdf in batches:
            now = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
            if not len(now):
                continue
            keys = [now[c].to_numpy() for c in ("block", "anchor", "part")]
            new = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1
            last = int(new[-1]) if len(new) else 0
            rest = now.iloc[last:]
            if last:
                group = np.zeros(last, np.int64)
                group[new[:-1]] = 1
                yield from links(np.cumsum(group), now.iloc[:last])
        if rest is not None and len(rest):
            yield from links(np.zeros(len(rest), np.int64), rest)

    def links(group, pdf):
        for a, b in _met(group, pdf["fp"].to_numpy(), pdf["role"].to_numpy(), bits):
            yield pd.DataFrame({"a": a, "b": b})

    keys = ["block", "anchor", "part"]
    return plain.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(compare, "a long, b long")


def linked(docs: DataFrame, text: str = "text", n: int = SHINGLE_WORDS, bits: int = BITS) -> DataFrame:
    """One row per row of docs(doc_id, text): doc_id, fingerprint (16 hexadecimal digits), component_id (the smallest
    doc_id that is reached over links of at most `bits` differing bits) and component_size (rows).

    Equal fingerprints are one node, so exact copies cost one row of a count each. Texts without words (null and empty
    ones too) share fingerprint zero and are linked like any other. Rows that repeat come back as often as they stand
    in docs. A null doc_id is no candidate for component_id, which is null where a component has no other id. Other
    columns of docs are not read. An empty table gives an empty one.
    """
    prints = stored(fingerprints(docs, text, n), "fingerprints")
    nodes = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("rows")), "nodes")
    edges = stored(meetings(replicas(nodes, bits), bits), "simhash-links")
    labels = components(edges).select(F.col("k").alias("fp"), "root")
    rooted = stored(nodes.join(labels, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "first", "rows"), "rooted")
    heads = rooted.groupBy("root").agg(F.min("first").alias("component_id"), F.sum("rows").alias("component_size"))
    named = rooted.join(heads, "root").select("fp", "component_id", "component_size")
    return prints.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "component_size")
