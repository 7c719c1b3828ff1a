"""Set-similarity join and near-duplicate records against brute force, with hot tokens, ties and odd rows."""

import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from sightline.operators import similarity


def sets_of(seed, n=120, words=40):
    """Families of near-copies, some copies, and sets that hold tokens which a third of all have."""
    draw, out = random.Random(seed), []
    while len(out) < n:
        base = {draw.randrange(3000) for _ in range(draw.randrange(1, words))} | (set(range(10_000, 10_000 + draw.randrange(30))) if draw.random() < 0.4 else set())
        for _ in range(draw.choice((1, 1, 2, 5))):
            some = {t for t in base if draw.random() > 0.08} | {draw.randrange(3000) for _ in range(draw.randrange(3))}
            out += [sorted(some or base)] * draw.choice((1, 1, 2))
    return [(i, t) for i, t in enumerate(out[:n])]


def by_force(sets, least, strict):
    out = set()
    for (a, x), (b, y) in combinations(sorted(sets), 2):
        shared, every = len(set(x) & set(y)), len(set(x) | set(y))
        if every and (shared / every > least if strict else shared / every >= least):
            out.add((a, b, shared))
    return out


@pytest.mark.parametrize("least, meet", [(0.8, 5_000), (0.8, 3), (0.5, 4), (1.0, 2)])
def test_near_pairs_is_brute_force(spark, monkeypatch, least, meet):
    monkeypatch.setattr(similarity, "MEET", meet)  # salts
    monkeypatch.setattr(similarity, "FREQUENT", 200)  # both ways to a token's frequency
    sets = sets_of(1)
    df = spark.createDataFrame(sets, "id long, tokens array<bigint>")
    got = [(r.a, r.b, r.shared) for r in similarity.near_pairs(df, least, strict=least < 1).collect()]
    assert len(got) == len(set(got)) and set(got) == by_force(sets, least, least < 1) and got


def test_tokens_of_one_set_alone_are_a_number(spark):
    """They take the first places of a prefix without being sent; rows of the join hold no arrays, and kin don't meet."""
    sets = [(1, [*range(10), 100]), (2, [*range(10), 200]), (3, [*range(10), 300, 301, 302, 303]), (4, [400, 401])]
    ordered = similarity.ordered_sets(spark.createDataFrame(sets, "id long, tokens array<bigint>"))
    assert {(r.id, r.n, tuple(r.tokens)) for r in ordered.collect()} == {(i, len(t), tuple(range(10))) for i, t in sets[:3]}
    pairs = similarity.prefix_pairs(ordered, 0.8)
    assert {(r.a, r.b) for r in pairs.collect()} == {(1, 2)}  # 10 of 12; 10 of 15 have no place left
    assert "prefix" not in pairs._jdf.queryExecution().optimizedPlan().toString()
    assert similarity.prefix_pairs(ordered.withColumn("kin", F.lit("x")), 0.8).count() == 0


def test_copies_and_unique_content(spark):
    rows = [(1, 4, [1, 2, 3, 4]), (2, 400, [4, 3, 2, 1]), (3, 4, []), (4, 0, []), (5, 9, [1, 2, 3, 4, 5, 6]), (6, 9, [1, 2, 3, 4, 5]), (7, 9, [50, 60])]
    sets = spark.createDataFrame(rows, "page_id long, words int, tokens array<bigint>")
    got = {r.page_id: (r.class_id, r.copies, r.links, r.closest) for r in similarity.copies(sets, 0.75).collect()}
    assert got == {1: (1, 2, 1, 0.8), 2: (1, 2, 1, 0.8), 3: (3, 1, 0, None), 4: (4, 1, 0, None), 5: (5, 1, 1, 5 / 6), 6: (6, 1, 2, 5 / 6), 7: (7, 1, 0, None)}
    one = similarity.near_duplicate_classes(similarity.copies(sets, 0.75)).first()
    assert (one.classes, one.repeated, one.linked) == (6, 1, 3)
    assert [r.page_id for r in similarity.ranked_copies(similarity.copies(sets, 0.75), 2).orderBy("rank").collect()] == [1, 2]
    own = {r.page_id: (r.own, r.share, r.flags) for r in similarity.unique_content(sets).collect()}
    assert own[7] == (2, 1.0, ["short"]) and own[2] == (0, 0.0, ["thin"]) and own[3] == (0, None, ["thin", "short"]) and own[5][0] == 1
    assert similarity.copies(sets.limit(0)).count() == 0 and similarity.unique_content(sets.limit(0)).count() == 0


def test_content_sets_of_odd_pages(spark):
    pages = spark.createDataFrame([(1, None), (2, ""), (3, "One two"), (4, "a b c a b c"), (5, "ÄB äb ÄB äb")], "page_id long, t string").withColumns({c: F.lit(1) for c in ("words", "tokens", "w")})
    got = {r.page_id: (r.words, len(r.tokens)) for r in similarity.content_sets(pages, F.col("t")).collect()}
    assert got == {1: (0, 0), 2: (0, 0), 3: (2, 1), 4: (6, 3), 5: (4, 1)}


@pytest.mark.parametrize("share, differ", [(0.8, 1), (0.6, 2), (0.4, 3), (0.99, 0)])
def test_near_records_is_brute_force(spark, share, differ):
    draw = random.Random(4)
    fields = [f"f{i}" for i in range(6)]
    # the first value of each field stands in a third of all records, null in some
    rows = [(i, *[None if draw.random() < 0.1 else 0 if draw.random() < 0.4 else draw.randrange(3) for _ in fields]) for i in range(250)]
    df = spark.createDataFrame(rows, "k long, " + ", ".join(f"{f} int" for f in fields))
    first, size = {}, {}
    for k, *v in rows:
        first.setdefault(tuple(v), k)
        size[tuple(v)] = size.get(tuple(v), 0) + 1
    links = {v: sum(0 < sum(a != b for a, b in zip(v, w)) <= differ for w in first) for v in first}
    want = {(k, first[tuple(v)], size[tuple(v)], links[tuple(v)]) for k, *v in rows}
    got = {(r.k, r.class_id, r.copies, r.links) for r in similarity.near_records(df, "k", fields, share).collect()}
    assert got == want
    assert similarity.near_records(df.limit(0), "k", fields, share).count() == 0
