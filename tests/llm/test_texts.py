"""Operators on one text at a time: tokens, licenses, rules, languages, toxicity and perplexity."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sightline.llm import bpe, chat, kneser_ney, langid, licenses, quality_lm, quality_rules, queries, toxicity

ODD = [None, "", " ", "\n\n  x", "it's  can't    end \t\r\n", "naïve café 123456 ٣٤٥ 中文字符テスト", "😀👨‍👩‍👧 zero​width", "a" * 3000, "<|endoftext|> plain", "\u0085x y", "!!!???...   \n"]


def docs(spark, texts, **more):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")


def crc(i, m):
    return zlib.crc32(str(i).encode()) % m


def test_bpe_equals_tiktoken(spark, sf):
    import public_tokenizers
    import tiktoken

    ranks = bpe.read_ranks(public_tokenizers.path(queries.VOCABULARY))
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    long = ["ab" * 30_000, "x" * 200 + " " + "é" * 70, "one two " * 5000]
    some = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()] + ODD + ODD + long
    got = {r.doc_id: r for r in bpe.digests(docs(spark, some), ranks, public_tokenizers.PATTERN).collect()}
    for i, t in enumerate(some):
        ids = enc.encode_ordinary(t or "")
        assert got[i].n_tokens == len(ids), t
        assert got[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), t
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()


def test_bpe_keeps_clashing_columns(spark):
    import public_tokenizers

    ranks = {bytes([b]): b for b in range(256)} | {b"ab": 256, b"abab": 257}
    rows = spark.createDataFrame([(1, "abab ab", "x", 3)], "doc_id int, text string, tokens string, n int")
    out = bpe.encoded(rows, ranks, public_tokenizers.PATTERN).first()
    assert out.ids == [257, 32, 256] and out.tokens == "x" and out.n == 3
    assert bpe.merged_here(b"ab" * 200, ranks) == (257,) * 100
    assert bpe.encoded(rows.limit(0), ranks, public_tokenizers.PATTERN).count() == 0


def test_the_fold_and_the_task_join_alike(spark):
    import public_tokenizers

    ranks = bpe.read_ranks(public_tokenizers.path(queries.VOCABULARY))
    words = [" the", "a", "aaaaaaa", " unbelievabl", "naïveté", "中文字符", "١٢٣", "zzzzqx", "\n\n", "'s", " 12345", "", "ababababab"]
    rows = spark.createDataFrame([(w,) for w in words], "w string").select("w", bpe.merged(F.col("w"), ranks).alias("ids")).collect()
    by_rank = lambda w: bpe.merged_here(w.encode(), ranks) if w else ()
    assert {r.w: tuple(r.ids) for r in rows if r.w.encode() not in ranks} == {w: by_rank(w) for w in words if w.encode() not in ranks}


def brute_license(text):
    low = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    places, labels = [], set()
    for phrase, label in licenses.BASE:
        p = phrase.split()
        for i in range(len(words) - len(p) + 1):
            if words[i : i + len(p)] == p:
                places.append(i)
                labels.add(label)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def test_license_base_is_brute_force(spark):
    texts = ODD + ["Released under the MIT License.", "GNU General Public License, version 3 or any later version", "cc by cc by-sa 4.0 apache license 2.0; MIT license mit license", "SPDX-License-Identifier: Apache-2.0", "éMIT license", "mit licenses", "Cc-BY"]
    got = {r.doc_id: r for r in licenses.scanned(docs(spark, texts)).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute_license(t), t
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(",")))
        assert 0 <= r.score <= 1
    assert "gpl-3-or-later" in got[len(ODD) + 1].labels
    assert "apache-2.0" in got[len(ODD) + 3].labels


def test_license_base_on_documents(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    for r in licenses.scanned(rows).collect():
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute_license(r.text)


def stay(spans):
    kept = []
    for x in sorted(spans, key=lambda x: (x[2], x[0] - x[1], x[0], x[4])):
        if all(k[1] <= x[0] or x[1] <= k[0] for k in kept):
            kept.append(x)
    return sorted(kept)


def test_license_overlaps_are_resolved_by_rank(spark):
    draw = random.Random(6)
    rows = []
    for _ in range(300):
        spans = [(s, s + draw.randrange(1, 9), draw.choice([5, 10, 20]), 0.5, draw.choice("abc")) for s in draw.choices(range(25), k=draw.randrange(9))]
        rows.append((spans + spans[:1],))
    rows += [([(0, 5, 30, 0.5, "a"), (1, 3, 50, 0.5, "b"), (4, 8, 10, 0.5, "c")],), ([],)]  # b lies in a, which goes for c
    table = spark.createDataFrame(list(enumerate(r for r, in rows)), f"i int, spans array<{licenses._SPAN}>").select("i", licenses._resolved(F.col("spans")).alias("out"))
    got = {r.i: [tuple(x) for x in r.out] for r in table.collect()}
    assert got == {i: stay(r) for i, (r,) in enumerate(rows)}
    assert [x[4] for x in got[300]] == ["b", "c"]


def test_license_detections_are_brute_force(spark, sf):
    tried = [(r, re.compile(f"(?<= )(?:{r.regex})(?= )")) for r in licenses.rules()]

    def found(text):
        low = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
        norm = " " + re.sub(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " ", low).strip(" ") + " "
        return stay([(i := norm[: m.start()].count(" ") - 1, i + m.group().count(" ") + 1, r.priority, r.trust, r.label) for r, p in tried for m in p.finditer(norm)])

    texts = ODD + ["Licensed under the Apache License, Version 2.0, or MIT license; SPDX-License-Identifier: GPL-2.0-or-later", "under the terms of the GNU Lesser General Public License version 3 or any later version. " * 200, "CC BY-SA 4.0 cc by nc nd creative commons attribution share alike 4.0 international license all rights reserved", "x " * 50_000 + "mit license", " ".join(sample(r.regex) for r in licenses.rules())]
    texts += [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()]
    more = docs(spark, texts + texts[:20]).select("*", F.lit("mine").alias("labels"), F.lit(1).alias("lic_norm"), F.lit(2).alias("Detections"))
    base = lambda t: set(filter(None, brute_license(t)[4].split(",")))
    for r in licenses.scanned(more).collect():
        text, want = (texts + texts[:20])[r[0]], found((texts + texts[:20])[r[0]])
        assert r[2:5] == ("mine", 1, 2) and [tuple(x) for x in r["detections_"]] == want, text
        assert r["labels_"] == ",".join(sorted(base(text) | {x[4] for x in want})), text
        assert r.score == max([x[3] for x in want] + [0.7] * bool(base(text)) + [0.0]), text
    assert licenses.scanned(more.limit(0)).count() == 0


def test_license_rules_are_hundreds():
    assert len(licenses.rules()) >= 200
    for r in licenses.rules():
        re.compile(r.regex)


def sample(regex):
    """A text that the regex of a rule matches: the first of each choice, no optional part."""
    import re._parser as parser

    def write(parts):
        out = ""
        for op, arg in parts:
            kind = str(op)
            if kind == "LITERAL":
                out += chr(arg)
            elif kind == "SUBPATTERN":
                out += write(arg[3])
            elif kind == "BRANCH":
                out += write(arg[1][0])
            elif kind in ("MAX_REPEAT", "MIN_REPEAT"):
                out += write(arg[2]) * arg[0]
            elif kind == "NOT_LITERAL":
                out += "x"
            elif kind == "IN":
                out += chr(arg[0][1]) if str(arg[0][0]) == "LITERAL" else "x"
            else:
                assert kind == "ASSERT_NOT", kind
        return out

    return write(parser.parse(regex))


def test_each_license_rule_is_reached(spark):
    rules = licenses.rules()
    texts = [sample(r.regex) for r in rules]
    plain = ["Released under the MIT", "distributed under BSD", "Apache-2.0", "MPL 2.0", "EPL-2.0", "OSL 3.0", "BSD 3-clause", "GFDL 1.3", "https://creativecommons.org/publicdomain/zero/1.0/"]
    got = {r.doc_id: r for r in licenses.scanned(docs(spark, texts + plain)).collect()}
    for i, r in enumerate(rules):
        assert re.fullmatch(r.regex, texts[i]) and r.keyword in texts[i], r
        assert got[i].labels and got[i].score > 0, r
    assert [got[len(rules) + i].labels for i in range(len(plain))] == ["mit", "bsd", "apache-2.0", "mpl-2.0", "epl-2.0", "osl-3.0", "bsd-3-clause", "gfdl-1.3", "cc0-1.0"]


def brute_rules(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {j for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_rule_measures_are_brute_force(spark, sf):
    texts = ODD + ["a b c d e a b c d e a b", "x " * 40, "l1\nl1\n\nl1 \nl2\n", "1 2 3 4 5", "1 2 3 4 5 6", "#*$ %&| <> z"]
    texts += [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()]
    for r in quality_rules.measured(docs(spark, texts)).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute_rules(r.text), r.text


def test_binomial_tail_is_exact(spark):
    rows = spark.createDataFrame([(k, n) for n in (1, 30, 400) for k in (0, 1, 5, 30) if k <= n], "k long, n long")
    for r in rows.withColumn("t", quality_rules.binomial_tail(F.col("k"), F.col("n"), 0.01)).collect():
        exact = sum(math.comb(r.n, i) * 0.01**i * 0.99 ** (r.n - i) for i in range(r.k + 1))
        assert math.exp(r.t) == pytest.approx(exact, rel=1e-9)


def test_rules_keep_the_good_and_survive_no_labels(spark, sf):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    out = quality_rules.judged(rows, labels).join(labels, "doc_id").where("quality = 1 and not base_failed")
    assert out.agg(F.avg(F.col("kept").cast("int"))).first()[0] >= 0.97
    few = spark.createDataFrame([(None, None, None), (1, "", "en"), (2, "one two three four five six seven eight nine ten", None)], "doc_id long, text string, lang string")
    got = quality_rules.judged(few, labels.limit(0)).collect()
    assert sorted((r.doc_id or 0, r.base_failed, r.kept) for r in got) == [(0, True, False), (1, True, False), (2, False, True)]


def test_cutoffs_are_brute_force(spark):
    draw = random.Random(10)
    rows = [(s, *[draw.choice([0.0, 0.0, 0.0, draw.random() * 0.1]) if draw.random() < 0.99 else draw.random() for _ in range(4)], draw.uniform(3, 6.99) if draw.random() < 0.997 else draw.uniform(6, 16)) for s, n in (("a", 4000), ("b", 2000), ("c", 300), ("", 1)) for _ in range(n)]
    table = spark.createDataFrame(rows, "stratum string, " + ", ".join(f"{r} double" for r in quality_rules.GRID))
    for risk, error in ((0.02, 0.05), (0.2, 0.05), (0.5, 0.5)):
        want = {}
        for s in {r[0] for r in rows}:
            mine = [r for r in rows if r[0] == s]
            for i, (rule, grid) in enumerate(quality_rules.GRID.items()):
                for cut in sorted(grid, reverse=True):
                    k, p = sum(r[i + 1] > cut for r in mine), risk / len(quality_rules.GRID)
                    tail = sum(math.exp(math.lgamma(len(mine) + 1) - math.lgamma(j + 1) - math.lgamma(len(mine) - j + 1) + j * math.log(p) + (len(mine) - j) * math.log1p(-p)) for j in range(k + 1))
                    if tail > error / (len(quality_rules.GRID) * 4):
                        break
                    want[s, rule] = cut
        assert {(r.stratum, r.rule): r.cutoff for r in quality_rules.cutoffs(table, risk, error).collect()} == want
        assert want


def test_rules_reject_junk_where_labels_suffice(spark):
    draw = random.Random(3)
    word = lambda: "".join(draw.choices("abcdefghij", k=draw.randrange(2, 9)))
    good = [" ".join(word() for _ in range(30)) for _ in range(2500)]
    junk = [" ".join(word() + "#$%" for _ in range(30)) for _ in range(100)]
    odd = [None, "", "one", "x y " * 50, "\n".join(["l one two three four five six seven"] * 9), "A" * 200_000, good[0] + " " + "y" * 100]
    texts = good + junk + odd + good[:3] + junk[:3]
    rows = spark.createDataFrame([(i, t, "en" if i % 2 or i >= 2500 else None, True, "c") for i, t in enumerate(texts)] + [(9000 + i, t, "xx", False, "c") for i, t in enumerate(junk)], "doc_id long, text string, lang string, kept boolean, n_words string")
    labels = spark.createDataFrame([(i, 1) for i in range(2500)] + [(2500, 0), (None, 1), (3, None), (3, 1)], "doc_id long, quality int")
    out = {r[0]: (r["base_failed"], r[-1], r["kept"], r["n_words"]) for r in quality_rules.judged(rows, labels, risk=0.05).collect()}
    assert all(v[2:] == (i < 9000, "c") for i, v in out.items())  # columns of the same names stay as they were
    assert all(out[i][1] for i in range(2500))
    assert not any(out[i][1] for i in range(2500, 2600)) and not any(out[i][0] for i in range(2500, 2600))
    assert all(out[9000 + i][1] for i in range(100))  # a stratum without labels has no cutoffs
    n = 2600
    assert [out[n + i][:2] for i in range(5)] == [(True, False)] * 5 and not out[n + 6][1]
    assert all(out[n + len(odd) + i][1] for i in range(3)) and not any(out[n + len(odd) + 3 + i][1] for i in range(3))
    assert quality_rules.judged(rows.limit(0), labels).count() == 0


def test_language_held_out_accuracy(spark, sf):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang", F.lit("z").alias("score"))
    out = langid.identified(rows)
    got = out.where("held_out and lang is not null and lang_pred <> 'und'").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert got >= 0.98
    assert {r.held_out == (crc(r.doc_id, 4) == 2) for r in out.select("doc_id", "held_out").collect()} == {True}
    odd = docs(spark, [None, "", "123 !!", "qqq"])
    model = langid.fit(rows.select("text", "lang"))
    assert [(r.lang_pred, r.score) for r in langid.predicted(odd, model).orderBy("doc_id").limit(3).collect()] == [("und", 0.0)] * 3
    assert [r.lang_pred for r in langid.predicted(odd, langid.fit(rows.limit(0).select("text", "lang"))).collect()] == ["und"] * 4


def test_language_scores_equal_brute_force_with_any_table(spark):
    texts = ["the cat sat on the mat", "the dog and the catlike dogs", "le chat est sur le tapis", "le chien et les chats", "der Hund und die Katze", "the le der", "xyzzy catty chatte", "žžž 漢字", None, "", "123 !", "cat " * 30_000]
    langs = ["en", "en", "fr", "fr", "de", None, None, None, "en", "fr", None, "en"]
    rows = spark.createDataFrame([(i % 11, t, x, i) for i, (t, x) in enumerate(zip(texts * 2, langs * 2))], "doc_id long, text string, lang string, lang_pred int")
    learn = [(t, x) for i, (t, x) in enumerate(zip(texts * 2, langs * 2)) if x and crc(i % 11, 4) != 2]
    words = lambda t: re.findall(r"[^\W\d_]+", (t or "").lower())
    grams = lambda w, n: [f"^{w}$"[i : i + n] for i in range(len(w) + 3 - n)]
    known = sorted({x for _, x in learn})
    seen = {x: Counter(w for t, y in learn if y == x for w in words(t)) for x in known}
    cut = {x: Counter() for x in known}
    for x in known:
        for w, n in seen[x].items():
            for size in range(1, 5):
                for g in grams(w, size):
                    cut[x][g] += n

    def logs(w):
        if any(w in seen[x] for x in known):
            return [math.log((seen[x][w] + 0.5) / (seen[x].total() + 1)) for x in known]
        for size in range(4, 0, -1):
            some = [g for g in grams(w, size) if any(g in cut[x] for x in known)]
            if some:
                return [sum(math.log((cut[x][g] + 0.5) / (cut[x].total() + 1)) for g in some) / len(some) for x in known]
        return None

    def expected(t):
        ws = words(t)
        if not ws:
            return "und", 0.0
        got = [v for w in ws if (v := logs(w))]
        mean = [sum(v[j] for v in got) / max(len(got), 1) * min(len(got), 20) for j in range(len(known))]
        p = [math.exp(m - max(mean)) for m in mean]
        return known[p.index(max(p))], max(p) / sum(p)

    for size in (langid.TABLE_BYTES, 100, 0):  # all words in the table, some, none
        got = langid.identified(rows, size).orderBy("lang_pred").collect()
        assert len(got) == len(texts) * 2 and got[0].asDict().keys() == {"doc_id", "lang", "lang_pred", "lang_pred_", "score", "held_out"}
        for r in got:
            lang, score = expected(texts[r.lang_pred % len(texts)])
            assert abs(r.score - score) < 1e-4 and r.lang_pred_ == lang and r.held_out == (crc(r.doc_id, 4) == 2), (r, lang, score, known, logs("the"), logs("le"), logs("der"))
    assert langid.identified(rows.limit(0)).count() == 0


def test_learnt_grams_are_broadcast_up_to_a_bound(spark, monkeypatch):
    docs = spark.createDataFrame([("the cat sat", "en"), ("le chat noir", "fr")], "text string, lang string")
    seen = spark.createDataFrame([("catty", 1), ("chatte", 2), ("the", 1)], "g string, n long")
    plans, keep, before = [], langid.stored, spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    monkeypatch.setattr(langid, "stored", lambda df, name: (plans.append((name, df._jdf.queryExecution().sparkPlan().toString())), keep(df, name))[1])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        model, got = langid.fit(docs), []
        for rows in (langid.GRAM_ROWS, 0):
            monkeypatch.setattr(langid, "GRAM_ROWS", rows)
            got.append(sorted((r.h, r.n, r.logs) for r in langid.valued(seen, model).collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert got[0] == got[1] and len(got[0]) == 3
    assert ["BroadcastHashJoin" in plan for name, plan in plans if name == "lang-values"] == [True, False]


def test_toxicity_held_out(spark, sf):
    rows = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    out = toxicity.scored(rows, labels).join(labels, "doc_id").where("held_out").select("score", "predicted", "toxic").toPandas()
    assert out.score.between(0, 1).all()
    good, bad = out[out.toxic == 0].score.to_numpy(), out[out.toxic == 1].score.to_numpy()
    auc = (bad[:, None] > good[None, :]).mean() + 0.5 * (bad[:, None] == good[None, :]).mean()
    assert auc >= 0.95
    assert ((out.score >= 0.5) == (out.predicted == 1)).all()


def test_toxicity_ratios_are_brute_force(spark):
    from sightline.llm import wordhash

    said = [("you rotten liars are bad", 1), ("the rotten liar is bad bad", 1), ("a good day is a good day", 0), ("the liars are not here today", 0), ("rotten apples are on the table", 0), ("", 0), ("you liar you rotten liarly", 1)]
    hashed = lambda x: int(toxicity._hashes(wordhash.Words([x.encode()]).hashes()[1])[0])
    start = int(toxicity._START)
    rows, docs_ = Counter(), [set() for _ in said]
    for i, (t, _) in enumerate(said):
        w = t.split()
        for k, x in enumerate(w):
            docs_[i] |= {(0, 0, hashed(x)), (2, hashed(w[k - 1]) if k else start, hashed(x))}
            docs_[i] |= {(n, hashed(x), hashed(x[:n])) for n in toxicity.STEMS if len(x) > n}
    for found, (_, c) in zip(docs_, said):
        rows.update((*e, c) for e in found)
    n = {e[:3]: (rows[(*e[:3], 0)], rows[(*e[:3], 1)]) for e in rows}

    def cuts(values):
        k = [sum(v == i for v in values) for i in (1, 2, 3, 4)]
        if not k[0] or not k[1]:
            return 0.5, 0.75, 0.9
        y = k[0] / (k[0] + 2 * k[1])
        d1, d2 = 1 - 2 * y * k[1] / k[0], 2 - 3 * y * k[2] / k[1]
        d3 = 3 - 4 * y * k[3] / k[2] if k[2] else d2
        return tuple(min(max(d, 0.1), top) for d, top in ((d1, 0.95), (d2, 1.9), (d3, 2.85)))

    def cut(v, d):
        return d[min(v, 3) - 1] if v else 0.0

    want, shared = {}, {}
    for kind in (0, *toxicity.STEMS):
        total, kinds = {}, Counter()
        for (k, _, w), (a, b) in n.items():
            if k == kind:
                x = total.get(w, (0, 0))
                total[w] = (x[0] + a, x[1] + b)
            if k == (2 if kind == 0 else kind):
                kinds[w] += 1
        d, every = cuts(kinds.values()), sum(kinds.values())
        left = sum(cut(v, d) for v in kinds.values()) / (len(kinds) + 1)
        q = {w: (v - cut(v, d) + left) / every for w, v in kinds.items()}
        shared = q if kind == 0 else shared
        p = []
        for c in (0, 1):
            d = cuts([v[c] for v in total.values() if v[c]])
            size = sum(v[c] for v in total.values()) or 1
            free = sum(cut(v[c], d) for v in total.values()) / size or 1.0
            p.append({w: (v[c] - cut(v[c], d)) / size + free * q[w] for w, v in total.items()})
        want |= {(kind, 0, w): math.log(p[1][w] / p[0][w]) for w in total}
    pairs = {(h, w): (a, b, a + b) for (k, h, w), (a, b) in n.items() if k == 2}
    d = [cuts([v[c] for v in pairs.values() if v[c]]) for c in range(3)]
    after = {h: [(sum(v[c] for (x, _), v in pairs.items() if x == h), sum(cut(v[c], d[c]) for (x, _), v in pairs.items() if x == h)) for c in range(3)] for h, _ in pairs}
    for (h, w), v in pairs.items():
        both = (v[2] - cut(v[2], d[2]) + after[h][2][1] * shared[w]) / after[h][2][0]
        p = [(v[c] - cut(v[c], d[c]) + after[h][c][1] * both) / after[h][c][0] if after[h][c][0] else both for c in (0, 1)]
        want[2, h, w] = math.log(p[1] / p[0])
    counts = toxicity.event_counts(spark.createDataFrame(said, "norm string, cls int"))
    got = {(r.kind, r.h, r.w): r.v for r in toxicity.ratios_of(counts, errors=0.0, least=1).collect()}
    assert {k for k, v in want.items() if abs(v) > 1e-12} <= got.keys()
    assert all(v == pytest.approx(want[k], abs=1e-9) for k, v in got.items())


def test_toxicity_edge_cases_and_shards(spark):
    rows = [(i, t, "x") for i, t in enumerate([None, "", "vile vile words", "fine words here", "vile liar " * 30, "fine day " * 30] * 40)]
    table = spark.createDataFrame([*rows, (None, "vile words", "y"), (3, "fine words here", "z")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, int("vile" in (t or ""))) for i, t, _ in rows] + [(None, 1), (5, None)], "doc_id long, toxic int")
    one = toxicity.scored(table, labels).collect()
    many = toxicity.scored(table, labels, shard_rows=2).collect()
    key = lambda r: (str(r.doc_id), r.text or "", r.score, r["score_"])
    assert len(one) == len(rows) + 2 and [key(r)[:3] for r in sorted(one, key=key)] == [key(r)[:3] for r in sorted(many, key=key)]
    assert all(a["score_"] == pytest.approx(b["score_"], abs=1e-6) for a, b in zip(sorted(one, key=key), sorted(many, key=key)))
    assert all((r["score_"] >= 0.5) == ("vile" in (r.text or "")) for r in one if r.text and len(r.text) > 100)
    assert toxicity.scored(table.limit(0), labels).count() == 0


def test_toxicity_without_labels(spark):
    out = toxicity.scored(docs(spark, [None, "", "a b c"]), spark.createDataFrame([], "doc_id long, toxic int")).collect()
    assert len(out) == 3 and all(0 <= r.score < 0.5 and r.predicted == 0 for r in out)


def test_perplexity_is_a_distribution(spark):
    """The probabilities of all characters after one context, the unseen one with them, sum to one."""
    texts = ["abracadabra", "banana band", "abba", "cab bad"]
    good = spark.createDataFrame([(i,) for i in range(4)], "doc_id long")
    model = quality_lm.fit(docs(spark, texts), good, 3)
    letters = sorted(set("".join(texts)))
    ends = [f"ab{c}" for c in letters] + ["ab☃"]
    rows = {r.text: r.s for r in kneser_ney.summed(docs(spark, [*ends, "ab"]), model, "text", "s", "n").collect()}
    assert sum(math.exp(rows[e] - rows["ab"]) for e in ends) == pytest.approx(1.0, abs=1e-4)


def test_shards_do_not_change_the_sums(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang").limit(60)
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    one = {r.doc_id: r.perplexity for r in quality_lm.judged(rows, labels).collect()}
    many = {r.doc_id: r.perplexity for r in quality_lm.judged(rows, labels, shard_rows=9000).collect()}
    assert one.keys() == many.keys()
    assert all(one[k] == pytest.approx(many[k], rel=1e-5) for k in one if one[k] is not None)


def test_quality_keeps_the_good_and_drops_junk(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text", "lang")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    got = quality_lm.judged(rows, labels).join(labels, "doc_id").groupBy("quality").agg(F.avg(F.col("keep").cast("int")).alias("k")).collect()
    share = {r.quality: r.k for r in got}
    assert share[1] >= 0.98 and share[0] <= 0.3


def test_quality_edge_cases(spark):
    few = spark.createDataFrame([(None, None, None, 1), (1, "", "en", 2), (2, "some text here", None, 3)], "doc_id long, text string, lang string, keep int")
    out = quality_lm.judged(few, spark.createDataFrame([], "doc_id long, quality int")).collect()
    assert len(out) == 3 and all(r["keep_"] for r in out)


def test_chat_pairs(spark):
    rows = [(0, 0, "user", "q"), (0, 1, "assistant", "a"), (1, 0, "user", "q"), (1, 1, "assistant", "b"), (1, 1, "assistant", "b"), (2, 0, None, None), (None, 0, "user", "x")]
    out = {r.pair_id: r for r in chat.paired(chat.neighbours(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()}
    assert set(out) == {0, 1}
    p = out[0]
    assert (p.n_chosen, p.n_rejected, p.n_common) == (2, 2, 1) and p.prompt.count("<|user|>") == 1
    s = p.chosen_spans[0]
    assert p.chosen[s.start : s.end] == "a\n<|end|>\n" and p.rejected[p.rejected_spans[0].start :].startswith("b")
    assert (out[1].n_rejected, out[1].n_common, out[1].rejected) == (0, 0, "")
