"""Operators that bring documents together: decontamination, repeated passages, near-duplicates, and the pipeline."""

import re
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from sightline.llm import bagminhash, compact_windows, decontamination
from sightline.llm.common import words_text


def split(text):
    return [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]


def table(spark, folder, name):
    return spark.read.parquet(f"{folder}/{name}.parquet")


def texts_of(rows):
    return [(r.doc_id, r.n.split(" ") if r.n else []) for r in rows.select("doc_id", words_text(F.col("text")).alias("n")).collect()]


def test_contained_is_brute_force(spark):
    folder = "/root/testdata/sf0.01"
    docs, items = table(spark, folder, "documents").select("doc_id", "text"), table(spark, folder, "benchmark")
    got = {(r.doc_id, r.item_id, r.n_shared) for r in decontamination.contained(docs, items).collect()}
    grams = lambda w, n: {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
    have = [(i, grams(w, 5)) for i, w in texts_of(docs)]
    want = set()
    for item, w in texts_of(items.withColumnRenamed("item_id", "doc_id")):
        s = grams(w, 5)
        want |= {(i, item, len(s & g)) for i, g in have if s and len(s & g) >= 0.8 * len(s) - 1e-9}
    assert got == want and want


def test_contained_edge_cases(spark):
    docs = spark.createDataFrame([(1, "One two"), (2, None), (3, ""), (None, "one two"), (1, "zero one two three"), (4, "a b c d e f g"), (4, "a b c d e f g")], "doc_id long, text string")
    items = spark.createDataFrame([(7, "one TWO!"), (8, None), (9, ""), (None, "one"), (10, "a b c d e f"), (10, "a b c d e f")], "item_id long, text string")
    got = sorted((r.doc_id, r.item_id, r.n_shingles, r.n_shared) for r in decontamination.contained(docs, items).collect())
    assert got == [(1, 7, 1, 1), (4, 10, 2, 2)]
    assert decontamination.contained(docs.limit(0), items).count() == 0
    assert decontamination.contained(docs, items.limit(0)).count() == 0
    rest = decontamination.decontaminated(docs.withColumn("item_id", F.lit(1)), items)
    assert sorted(str(r.doc_id) for r in rest.collect()) == ["2", "3", "None"]


def test_every_repeated_window_is_found(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text")
    spans = defaultdict(list)
    for r in compact_windows.repeated(docs).collect():
        assert r.other_id < r.doc_id
        spans[r.doc_id].append((r.start_word, r.end_word))
    first, rows = {}, texts_of(docs)
    for i, w in rows:
        for k in range(len(w) - 49):
            key = tuple(w[k : k + 50])
            first[key] = min(i, first.get(key, i))
    for i, w in rows:
        for k in range(len(w) - 49):
            if first[tuple(w[k : k + 50])] < i:
                assert any(s <= k and k + 50 <= e for s, e in spans[i]), (i, k)


def test_repeats_are_cut_and_the_first_stays(spark):
    passage = " ".join(f"word{i}" for i in range(70))
    rows = [(1, f"Start here. {passage} and an end."), (2, f"Other: {passage}! Rest, of it."), (3, None), (4, ""), (5, "short text"), (2, "nothing shared at all")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"spans": F.lit("s"), "n_chars": F.length("text").cast("long")})
    out = compact_windows.without_repeats(docs).collect()
    assert len(out) == 6 and all(r.spans == "s" for r in out)
    assert sorted(r.text for r in out if r.doc_id == 2) == ["Other: Rest, of it.", "nothing shared at all"]
    assert [r.text for r in out if r.doc_id == 1] == [rows[0][1]]
    assert all(r.n_chars == len(r.text) for r in out if r.text is not None)
    assert compact_windows.repeated(docs.limit(0)).count() == 0


def test_an_excerpt_in_a_smaller_document_hides_no_passage(spark):
    rows = []
    for k in range(20):
        p, own = [f"p{k}x{i}" for i in range(60)], lambda d: [f"o{k}d{d}x{i}" for i in range(40)]  # noqa: B023
        rows += [(3 * k, " ".join(own(0) + p[6:54] + own(3))), (3 * k + 1, " ".join(own(1) + p)), (3 * k + 2, " ".join(p + own(2)))]
    got = {(r.doc_id, r.start_word, r.end_word, r.other_id) for r in compact_windows.repeated(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(3 * k + 2, 0, 60, 3 * k + 1) for k in range(20)}


def test_passages_go_on_after_inserted_words(spark):
    w = [f"w{i}" for i in range(90)]
    rows = []
    for k in range(6):
        own = [f"{x}v{k}" for x in w]
        rows += [(2 * k, " ".join(own)), (2 * k + 1, " ".join([*own[:45], *["new"] * (k % 3), *own[45 + k // 3 :]]))]
    got = {(r.doc_id, r.start_word, r.end_word, r.other_start) for r in compact_windows.repeated(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(2 * k + 1, 0, 90 + k % 3 - k // 3, 0) for k in range(6)}


def test_halves_in_smaller_documents_hide_no_changed_passage(spark):
    rows, want = [], set()
    for k in range(4):
        p, own = [f"p{k}x{i}" for i in range(60)], lambda d: [f"o{k}d{d}x{i}" for i in range(60)]  # noqa: B023
        halves = [(100 * k + d, own(d) + (p[:29] if d % 2 else p[30:]) + own(d + 100)) for d in range(40)]
        rows += [(i, " ".join(w)) for i, w in halves]
        rows += [(100 * k + 50, " ".join(own(50) + p)), (100 * k + 51, " ".join([*p[:29], "changed", *p[30:], *own(51)]))]
        want.add((100 * k + 51, 0, 60, 100 * k + 50, 60))
    got = compact_windows.repeated(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.start_word, r.end_word, r.other_id, r.other_start) for r in got} == want


def test_the_least_run_by_brute_force():
    for least in (0.5, 0.8, 0.9, 1.0):
        best = 10**9
        for runs in range(1, 40):
            for size in range(1, 60):  # all runs of one size, one changed word between two of them
                k, u = runs * size, 9 * (runs - 1)
                if k >= least * (k + u) - 1e-9 and k >= least * 46 - 1e-9:
                    best = min(best, size + 4)
        assert compact_windows.least_run(5, 50, least) <= best
    assert compact_windows.least_run(5, 50, 0.8) == 23 and compact_windows.least_run(5, 50, 1.0) == 50


def test_a_line_that_nothing_goes_on_around_makes_no_pairs(spark):
    line = [f"line{i}" for i in range(30)]
    rows = [(i, " ".join([f"a{i}x{k}" for k in range(60)] + line + ["same"] * (30 + i % 9) + [f"b{i}x{k}" for k in range(60)])) for i in range(30)]
    rows += [(100, " ".join(f"p{k}" for k in range(60))), (101, " ".join("changed" if k == 29 else f"p{k}" for k in range(60)))]
    texts = spark.createDataFrame(rows, "doc_id long, norm string").withColumn("text_key", F.xxhash64("norm"))
    pairs = compact_windows._changed_pairs(None, texts.where("doc_id < 30 and doc_id % 9 < 2 or doc_id >= 100"), 5, 50, 0.8)[0].collect()
    assert {(r.b, r.a) for r in pairs if r.b >= 100} == {(101, 100)}
    texts = spark.createDataFrame([(i, t.replace("same", f"own{i}")) for i, t in rows], "doc_id long, norm string").withColumn("text_key", F.xxhash64("norm"))
    assert {(r.b, r.a) for r in compact_windows._changed_pairs(None, texts, 5, 50, 0.8)[0].collect()} == {(101, 100)}


def test_copies_are_one_passage_and_are_not_compared(spark, monkeypatch):
    monkeypatch.setattr(compact_windows, "_verify", None)
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(i, text) for i in (7, 3, 5, 3)] + [(8, "too short a text"), (9, "too short a text"), (10, None), (11, None), (None, text)]
    got = compact_windows.repeated(spark.createDataFrame(rows, "doc_id long, text string")).drop("text_key").collect()
    assert sorted(map(tuple, got)) == [(i, 0, 60, 3, 0, 1.0) for i in (5, 7)]


def test_tables_on_the_way_do_not_stay(spark, monkeypatch):
    made, real = [], compact_windows.stored
    monkeypatch.setattr(compact_windows, "stored", lambda df, name: made.append((name, real(df, name))) or made[-1][1])
    passage = " ".join(f"w{i}" for i in range(60))
    rows = [(i, f"own{i} {passage} " + " ".join(f"o{i}x{k}" for k in range(40))) for i in range(3)]
    got = compact_windows.repeated(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.start_word, r.end_word, r.other_id) for r in got} == {(1, 1, 61, 0), (2, 1, 61, 0)}
    there = lambda df: any(Path(f.removeprefix("file:")).exists() for f in df.inputFiles())
    assert {name for name, df in made if there(df)} & {"windows", "open", "wide", "short", "runs", "around"} == set()


def test_what_surrounds_the_least_run_by_drawn_passages():
    import random

    shared, reach, far = compact_windows.surroundings(5, 50, 0.8)
    draw, seen = random.Random(3), set()
    for _ in range(30_000):
        k = [draw.choice((1, 5, 19, 25, 40, 120, 400, 900)) + draw.randint(0, 9) for _ in range(draw.randint(1, 5))]
        gaps = [draw.choice((1, 9, 40, 90, 120)) + draw.randint(0, 9) for _ in k[1:]]  # words put into b: it loses 4 shingles more, the other text 4
        if sum(k) < max(37, 4 * sum(g + 8 for g in gaps)) or sum(k) + sum(g + 4 for g in gaps) < 46:
            continue
        hit = np.concatenate([np.concatenate([np.ones(r, bool), np.zeros(g, bool)]) for r, g in zip(k, [g + 4 for g in gaps] + [0])])
        begin = 0
        for i, r in enumerate(k):
            if r >= 19:
                near = [hit[max(0, p - reach) : p + 19 + reach].sum() for p in range(begin, begin + r - 18)]
                rest = sum(x + 4 for j, x in enumerate(k) if j != i and x >= 19)
                assert min(near) >= shared or rest >= far
                seen.add(min(near) >= shared)
            begin += r + ((gaps + [0])[i] + 4)
    assert seen == {True, False}


def test_no_like_text_is_left_out_by_its_hits():
    rng = np.random.default_rng(4)
    for _ in range(400):
        hit = rng.random(rng.integers(0, 120)) < 0.75
        want = any(hit[i:j].mean() >= 0.8 - 1e-9 for i in range(len(hit)) for j in range(i + 46, len(hit) + 1))
        assert compact_windows.may_be_like(hit, 46, 0.8) == want


def test_stretches_are_the_longest_by_brute_force():
    import random

    draw = random.Random(5)
    for _ in range(200):
        runs, i, j = [], 0, 0
        for _ in range(draw.randint(1, 7)):
            i, j, k = i + draw.randint(0, 4), j + draw.randint(0, 4), draw.randint(5, 60)
            runs.append((i, j, k))
            i, j = i + k, j + k
        fit = []
        for p in range(len(runs)):
            for q in range(p, len(runs)):
                s, e = runs[p][0], runs[q][0] + runs[q][2]
                o, f = runs[p][1], runs[q][1] + runs[q][2]
                both = sum(k - 4 for _, _, k in runs[p : q + 1])
                if both >= 0.8 * (e - s - 4 + f - o - 4 - both) - 1e-9:
                    fit.append((p, q))
        fit = [(p, q) for p, q in fit if not any((x, y) != (p, q) and x <= p and q <= y for x, y in fit)]
        want = [(runs[p][0], runs[q][0] + runs[q][2]) for p, q in fit]
        assert [(s, e) for s, e, _, _ in compact_windows.stretches(runs, 5, 1, 0.8)] == want


def test_copies_of_a_long_text_are_one_passage(spark):
    text = " ".join(f"w{i}" for i in range(70_000))
    got = compact_windows.repeated(spark.createDataFrame([(1, text), (2, text)], "doc_id long, text string")).collect()
    assert {(r.doc_id, r.start_word, r.end_word, r.other_id, r.other_start) for r in got} == {(2, 0, 70_000, 1, 0)}


def weighted(a, b):
    both = sum((a & b).values())
    return both / max(1, sum(a.values()) + sum(b.values()) - both)


def bag(w):
    return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])


def test_classes_are_brute_force(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text")
    got = {r.doc_id: r.class_id for r in bagminhash.classes(docs).collect()}
    rows = [(i, w, bag(w)) for i, w in texts_of(docs)]
    parent = {i: i for i, _, _ in rows}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    index = defaultdict(set)
    for i, _, b in rows:
        for s in b:
            index[s].add(i)
    bags = {i: b for i, _, b in rows}
    for i, _, b in rows:
        for j in {j for s in b for j in index[s] if j > i}:
            if weighted(b, bags[j]) >= 0.8:
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    assert got == {i: find(i) for i in parent}


def test_class_edge_cases(spark):
    rows = [(1, "a b c"), (2, "A, b c!"), (3, None), (4, ""), (None, "a b c"), (5, "..."), (6, "a b d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((str(r.doc_id), str(r.class_id), r.class_size, r.is_first) for r in bagminhash.classes(docs).collect())
    assert got == [("1", "1", 3, True), ("2", "1", 3, False), ("3", "3", 1, True), ("4", "4", 1, True), ("5", "5", 1, True), ("6", "6", 1, True), ("None", "1", 3, False)]
    assert bagminhash.classes(docs.limit(0)).count() == 0
    assert sorted(str(r.doc_id) for r in bagminhash.deduplicated(docs.withColumn("first", F.lit(1))).collect()) == ["1", "3", "4", "5", "6"]
    again = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (2, "a b c"), (None, "z y"), (None, "z y"), (1, "other words")], "doc_id long, text string")
    assert sorted((str(r.doc_id), r.text) for r in bagminhash.deduplicated(again.withColumn("k", F.lit(1))).collect()) == [("1", "a b c"), ("1", "other words"), ("None", "z y")]


def test_near_copies_of_one_text_are_one_class(spark):
    """Copies with one word changed each are alike by way of their source alone; those with more changes by no way."""
    import random

    draw = random.Random(3)
    base = [f"w{i}" for i in range(80)]
    rows = []
    for i in range(300):
        w = list(base)
        for k in range(1 + (i % 3 == 0) * draw.randint(1, 3)):
            w[draw.randrange(80)] = f"c{i}x{k}"
        rows.append((i, " ".join(w)))
    rows.append((1000, " ".join(base)))
    got = {r.doc_id: r.class_id for r in bagminhash.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    bags, parent = [(i, bag(t.split())) for i, t in rows], {i: i for i, _ in rows}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for x, (i, a) in enumerate(bags):
        for j, b in bags[:x]:
            if weighted(a, b) >= 0.8:
                p, q = find(i), find(j)
                parent[max(p, q)] = min(p, q)
    assert got == {i: find(i) for i, _ in rows}


def test_signatures_agree_as_often_as_bags_overlap():
    from sightline.llm import wordhash

    a, b = "x y z u v w " * 3 + "p q r s t", "x y z u v w " * 2 + "p q r s t o n"
    w = wordhash.Words([a.encode(), b.encode()])
    sig = bagminhash.signatures(*bagminhash.bags(w, 5), 2, 4000)
    assert (sig[0] == sig[1]).mean() == pytest.approx(weighted(bag(a.split()), bag(b.split())), abs=0.04)


def test_pipeline(spark, sf):
    import corpus_pipeline

    docs = table(spark, sf, "documents")
    assert [n for n, _ in corpus_pipeline.STAGES][1] == "near_duplicates"
    kept = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, sf)
        assert kept.columns == docs.columns
        kept = spark.createDataFrame(kept.collect(), docs.schema)
    assert 0 < kept.count() < docs.count()
    out = corpus_pipeline.run(spark, sf)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert {r.doc_id for r in out.collect()} == {r.doc_id for r in kept.collect()}


def test_links_of_large_buckets_are_all_measured(spark, monkeypatch):
    """Pairs within a template that all texts share, in buckets over the bound and with no text drawn."""
    monkeypatch.setattr(bagminhash, "FULL", 1)
    monkeypatch.setattr(bagminhash, "DRAWN", 0)
    common = " ".join(f"c{i}" for i in range(60))
    rows = [(2 * i + e, f"{common} {' '.join(f'p{i}x{j}' for j in range(25))} e{i}y{e}") for i in range(30) for e in (0, 1)]
    got = {r.doc_id: r.class_id for r in bagminhash.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: i // 2 * 2 for i in range(60)}


def test_unlike_texts_of_a_large_bucket_do_not_meet_in_pairs(spark, monkeypatch):
    """Five words of a template changed in each text, four pairs with the same ones but for one: the others share buckets,
    but hardly any of their pairs has to be measured."""
    import random

    draw, measured, before = random.Random(5), [], bagminhash.verified
    rows, n = [], 160
    for i in range(n):
        w, twin = [f"w{k}" for k in range(200)], i - i % 2 if i < 8 else i
        for j, k in enumerate(random.Random(twin).sample(range(5, 195, 5), 5)):
            w[k] = f"c{i if j == 0 else twin}x{k}"
        rows.append((i, " ".join(w)))

    def counted(pairs, *rest):
        measured.append(pairs.count())
        return before(pairs, *rest)

    monkeypatch.setattr(bagminhash, "verified", counted)
    monkeypatch.setattr(bagminhash, "DRAWN", 0)
    docs = spark.createDataFrame(draw.sample(rows, n), "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in bagminhash.classes(docs).collect()}
    bags = [bag(t.split()) for _, t in rows]
    assert {(b, a) for a in range(n) for b in range(a) if weighted(bags[a], bags[b]) >= 0.8} == {(0, 1), (2, 3), (4, 5), (6, 7)}
    assert got == {i: i - i % 2 if i < 8 else i for i in range(n)}
    assert sum(measured) < 2 * n
