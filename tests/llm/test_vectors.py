"""Operators over embeddings, and fingerprints: brute force, odd rows, ties, hot groups."""

import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from sightline.llm import centroids, hard_negatives, simhash
from sightline.llm.vectors import products


def whole(v):
    return [int(np.floor(256 * float(np.float32(x)))) for x in v]


def rows_of(n, size, seed, groups=6):
    draw = np.random.default_rng(seed)
    middle = draw.normal(size=(groups, size))
    return [(i, (middle[i % groups] + draw.normal(size=size) * 0.4).astype(np.float32).tolist(), int(draw.integers(4))) for i in range(n)]


# hard negatives


def mined_by_force(rows, k=5, m=3):
    """rows(id, whole vector, label) whose ids are all different."""
    out = set()
    for a, v, label in rows:
        if a % 50:
            continue
        scores = [(sum(x * y for x, y in zip(v, w)), -i, lab) for i, w, lab in rows if i != a]
        scores.sort(reverse=True)
        for s, p, _ in [x for x in scores if x[2] == label][:k]:
            fit = [x for x in scores if x[2] != label and 50 * s <= 100 * x[0] <= 95 * s][:m]
            out |= {(a, -p, r + 1, -n, s, t) for r, (t, n, _) in enumerate(fit)}
    return out


def mined(df, **options):
    return {tuple(r) for r in hard_negatives.mined(df, F.col("vec_id") % 50 == 0, **options).collect()}


@pytest.mark.parametrize("blocks", [(4096, 256, 64, 16), (90, 7, 8, 2)])
def test_mined_is_brute_force(spark, monkeypatch, blocks):
    """With many small blocks and cells, pairs of nodes are dropped, and nothing is lost."""
    for name, n in zip(("BLOCK", "SLICE", "LEAF", "SLICE_LEAF"), blocks):
        monkeypatch.setattr(hard_negatives, name, n)
    rows = rows_of(1500, 16, 1)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    want = mined_by_force([(i, whole(v), lab) for i, v, lab in rows])
    assert mined(df, size=16) == want and len(want) > 100


def test_mined_ties_and_a_hot_vector(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "BLOCK", 40)
    rows = rows_of(300, 8, 2)
    same = [(i, [1.0, 0.5] * 4, i % 3) for i in range(300, 500)] + [(i, [0.5, 0.5] * 4, i % 3) for i in range(500, 560)]
    df = spark.createDataFrame(rows + same, "vec_id long, embedding array<float>, label int").repartition(7)
    assert mined(df, size=8) == mined_by_force([(i, whole(v), lab) for i, v, lab in rows + same])


def test_mined_odd_rows(spark):
    good = rows_of(120, 8, 3)
    nan, inf = float("nan"), float("inf")
    odd = [(100, None, 1), (150, [nan] * 8, 1), (200, [1.0, None] * 4, 1), (250, [inf] * 8, 1), (300, [1.0] * 8, None), (350, [1.0] * 7, 1), (None, [1.0] * 8, 1)]
    df = spark.createDataFrame(good[:100] + odd + good[:20], "vec_id long, embedding array<double>, label int").withColumns({c: F.lit("x") for c in ("score", "row", "cell", "v", "rank", "anchor_id")})
    want = mined_by_force([(i, [int(np.floor(256 * x)) for x in v], lab) for i, v, lab in good[:100]])
    assert mined(df, size=8) == want and want
    assert mined(df.limit(0)) == set()
    assert mined(df.where("vec_id % 50 <> 0"), size=8) == set()
    with pytest.raises(Exception, match="too large"):
        mined(df.select("vec_id", F.transform("embedding", lambda x: x * 1e9).alias("embedding"), "label"), size=8)


def test_intervals_hold_and_planes_part():
    draw = np.random.default_rng(5)
    for _ in range(50):
        a, b = draw.normal(size=(9, 5)) * 100, draw.normal(size=(11, 5)) * draw.integers(1, 1000)
        (ca, ra), (cb, rb) = hard_negatives.ball(a), hard_negatives.ball(b)
        low, high = hard_negatives.interval(ca[None], np.array([ra]), cb[None], np.array([rb]))
        assert low[0, 0] <= (a @ b.T).min() and (a @ b.T).max() <= high[0, 0]
    v = draw.normal(size=(1000, 5))
    cells = hard_negatives.Planes(v, 32).cell(v)
    assert len(np.unique(cells)) == 32 and np.bincount(cells).max() < 100
    assert set(hard_negatives.Planes(np.zeros((10, 5)), 32).cell(np.zeros((3, 5)))) == {0}
    assert sorted(np.concatenate(hard_negatives.leaves(np.zeros((100, 3)), 16)).tolist()) == list(range(100))


# centroids


def lloyd(rows, k, rounds, seed="2:"):
    """rows(id, whole vector) by plain loops in Python's integers."""
    import hashlib

    order = sorted(rows, key=lambda r: hashlib.sha256(f"{seed}{r[0]}".encode()).hexdigest())
    c = [list(v) for _, v in order[:k]]
    best = lambda v: min((sum((x - y) ** 2 for x, y in zip(v, m)), j) for j, m in enumerate(c))
    for _ in range(rounds):
        at = [best(v)[1] for _, v in rows]
        for j in range(len(c)):
            mine = [v for (_, v), a in zip(rows, at) if a == j]
            if mine:
                c[j] = [sum(x) // len(mine) for x in zip(*mine)]
    return {i: (best(v)[1], best(v)[0]) for i, v in rows}, c


@pytest.mark.parametrize("scale", [1, 0.02])  # the small scale has whole numbers of few values, so many ties
def test_clustered_is_brute_force(spark, scale):
    rows = [(i, [x * scale for x in v], lab) for i, v, lab in rows_of(400, 6, 7)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    found, c = centroids.clustered(df, size=6, centroids=9)
    want, middle = lloyd([(i, whole(v)) for i, v, _ in rows], 9, 5)
    assert {r.vec_id: (r.cluster, r.distance) for r in found.collect()} == want and c.tolist() == middle
    out = centroids.inertias(found, c).collect()
    assert {r.inertia for r in out} == {sum(d for _, d in want.values())}
    for r in out:
        assert r.cluster_inertia == sum(d for k, d in want.values() if k == r.cluster) and r.centroid_sha256 == centroids.digest(c[r.cluster])


def test_bounds_pass_over_most_distances_and_change_nothing():
    v = np.array([whole(x) for _, x, _ in rows_of(3000, 12, 8, groups=20)])
    c = v[:20].copy()
    d = centroids.squares(v, c)
    at = d.argmin(1)
    upper, lower = centroids._up(np.sqrt(d.min(1))), centroids._down(np.sqrt(d))
    for _ in range(4):
        new = np.array([v[at == j].sum(0) // (at == j).sum() for j in range(20)])
        upper, lower = centroids.moved(upper, lower, at, c, new)
        at, best, upper, lower, measured = centroids.nearest(v, new, at, upper, lower)
        d = centroids.squares(v, new)
        assert (at == d.argmin(1)).all() and (best == d.min(1)).all()
        assert (lower <= np.sqrt(d)).all() and (upper >= np.sqrt(best)).all()
        assert measured < len(v) * 20 / 2
        c = new


def test_clustered_odd_rows(spark):
    nan = float("nan")
    rows = [(1, [0.0] * 4), (2, [0.0] * 4), (3, [1.0] * 4), (3, [1.0] * 4), (4, None), (5, [nan] * 4), (6, [1.0] * 3), (7, [None, 1.0, 1.0, 1.0]), (None, [-0.3] * 4), (8, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit("x") for c in ("cluster", "distance", "id", "v", "upper")})
    found, c = centroids.clustered(df, size=4, centroids=40)
    got = sorted((r.vec_id or 0, r.distance) for r in found.collect())
    assert got == [(0, 0), (1, 0), (2, 0), (3, 0), (3, 0)] and len(c) == 5
    assert {r.vec_id: r.cluster for r in found.collect()}[1] == {r.vec_id: r.cluster for r in found.collect()}[2]  # a tie goes to the smaller number
    none = centroids.clustered(df.limit(0), size=4)
    assert none[0].count() == 0 and centroids.inertias(*none).count() == 0


def test_products_of_large_numbers_are_exact():
    a, b = np.array([[(1 << 27) - 1, 3]]), np.array([[(1 << 27) - 5, 7], [1, 1]])
    assert products(a, b).tolist() == [[((1 << 27) - 1) * ((1 << 27) - 5) + 21, (1 << 27) + 2]]
    assert products(a * 16, b * 16)[0, 0] == 256 * (((1 << 27) - 1) * ((1 << 27) - 5) + 21)


# fingerprints


def print_of(text, n=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def components(prints, bits=4):
    """prints {id: fingerprint} -> {id: smallest id that is reached}."""
    up = {i: i for i in prints}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(prints)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            if bin(prints[i] ^ prints[j]).count("1") <= bits:
                a, b = top(i), top(j)
                up[max(a, b)] = min(a, b)
    return {i: top(i) for i in ids}


def test_linked_is_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    prints = {r.doc_id: print_of(r.text) for r in docs.collect()}
    want = {i: (f"{prints[i]:016x}", c) for i, c in components(prints).items()}
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.linked(docs).collect()}
    assert got == want and len({c for _, c in want.values()}) < len(set(prints.values()))


@pytest.mark.parametrize("bits", [0, 1, 2, 3, 4, 5, 6])
def test_meetings_lose_no_link(spark, bits):
    """Fingerprints at each distance up to two beyond the limit, in random places: all links up to the limit are met."""
    draw = random.Random(bits)
    prints = []
    for _ in range(150):
        x = draw.getrandbits(64)
        prints.append(x)
        for _ in range(draw.randrange(3)):
            for k in draw.sample(range(64), draw.randrange(bits + 3)):
                x ^= 1 << k
            prints.append(x)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    nodes = spark.createDataFrame([(signed(x),) for x in set(prints)], "fp long")
    up = components({signed(x): x for x in set(prints)}, bits)
    edges = simhash.meetings(simhash.replicas(nodes, bits), bits).collect()
    for e in edges:
        assert bin((e.a ^ e.b) & (2**64 - 1)).count("1") <= bits or up[e.a] == up[e.b]
    met = {x: x for x in up}

    def top(i):
        while met[i] != i:
            i = met[i]
        return i

    for e in edges:
        a, b = top(e.a), top(e.b)
        met[max(a, b)] = min(a, b)
    assert {x: top(x) for x in up} == up


def test_large_anchors_are_cut(spark, monkeypatch):
    monkeypatch.setattr(simhash, "PART", 20)
    monkeypatch.setattr(simhash, "SLAB", 50)
    draw = random.Random(3)
    base = draw.getrandbits(63)
    prints = {base}
    while len(prints) < 300:  # one ball
        x = base
        for k in draw.sample(range(63), draw.randrange(1, 6)):
            x ^= 1 << k
        prints.add(x)
    want = components({x: x for x in prints})
    labels = {r.k: r.root for r in simhash.components(simhash.meetings(simhash.replicas(spark.createDataFrame([(x,) for x in prints], "fp long")))).collect()}
    assert {x: labels.get(x, x) for x in prints} == want


def test_linked_odd_rows(spark):
    long = " ".join(f"w{i % 977}" for i in range(200_000))
    rows = [(5, None), (3, ""), (4, " \t\n"), (None, "some words stand here and there"), (9, "Some WORDS stand\there and there"), (9, "Some WORDS stand\there and there"), (7, "one"), (8, "ONE"), (10, "Ärger ärger"), (11, long), (12, long + " end"), (None, "alone by itself")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("fp", "fingerprint", "component_id", "first", "rows", "root")})
    got = sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in simhash.linked(docs).collect())
    assert len(got) == len(rows)
    by = {(i, c) for i, _, c in got}
    assert {("5", 3), ("4", 3), ("3", 3), ("7", 7), ("8", 7), ("9", 9), ("None", 9), ("None", None), ("10", 10), ("11", 11), ("12", 11)} == by
    prints = {i: f for i, f, _ in got if i != "None"}
    assert prints["5"] == "0" * 16 and all(prints[str(i)] == f"{print_of(t):016x}" for i, t in rows if i is not None)
    assert simhash.linked(docs.limit(0)).count() == 0
    assert simhash.fingerprint(b"one two three", 2) == print_of("one two three", 2)
