"""Toxicity: class-conditional Kneser-Ney bigram models that share their backoff.

In each class, a word's probability after another is its discounted count there plus what the discounts leave, spread
by what follows that other word in both classes together; a word by itself leaves to the continuation counts (after how
many different words it stands) of both. So an expression that is rare in both has much the same probability in both. Counts
are of documents, not of places: a document that says one expression a thousand times is one witness. Of the log ratio
of the two classes only what exceeds its standard error counts, so the less the more witnesses there are. An expression
without such evidence backs off: two words to the second, a word to its first letters. What decides is the sum of these
ratios, which is the difference of the two log-likelihoods, divided by the length.
"""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sightline.llm import kneser_ney as kn
from sightline.llm import wordhash
from sightline.llm.common import crc_mod, fresh, small, stored, words_text

#: Labelled documents (those with the lowest hash of their id) whose scores fit the two numbers of the calibration.
CALIBRATION_ROWS = 20_000
#: An expression of fewer training documents than this has no evidence of its own.
LEAST_DOCUMENTS = 2
#: What a word backs off to: its first letters, the longest first, if it has more.
STEMS = (6, 4)
#: Standard errors by which a log ratio is drawn towards zero. Set on folds 1 to 4.
ERRORS = 3.0
#: Words of average ratio that are added to each text, so that a few words prove little.
PRIOR_WORDS = 100
#: Rows of the model that are sent to a task at once: 12 bytes each, about 5 times that with the table's gaps.
SHARD_ROWS = 2_000_000
#: Bytes of text that are worked on at once.
PART = 400_000
#: Kinds of rows besides stems: a word, and two words.
WORD, PAIR = 0, 2
_START = np.uint64(0x5DEECE66)


def _hashes(h: np.ndarray) -> np.ndarray:
    """The upper 40 bits: of a million different words one shares its hash with another of them."""
    return h >> np.uint64(24)


def _events(w: wordhash.Words) -> list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(kind, at, h, w) of what each word (number at) says: itself (h is 0), with the word before (h), its stems (h is the
    word)."""
    own = _hashes(w.hashes()[1])
    before = np.concatenate([[_START], own[:-1]]) if len(own) else own
    before[w.first[w.count > 0]] = _START
    every = np.arange(len(own))
    out = [(WORD, every, np.zeros(len(own), np.uint64), own), (PAIR, every, before, own)]
    for stem in STEMS:
        longer, h = w.prefixes(stem)
        out.append((stem, np.flatnonzero(longer), own[longer], _hashes(h[longer])))
    return out


def _packed(kind: int, h: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Kind and hashes in a long and an int: half of what they take in a shuffle otherwise."""
    return h << np.uint64(24) | w >> np.uint64(16), (w & np.uint64(0xFFFF)).astype(np.int32) | np.int32(kind << 16)


def _unpacked(rows: DataFrame) -> DataFrame:
    """(a, b, n0, n1) -> (kind, h, w, n0, n1)."""
    h = F.shiftrightunsigned(F.col("a"), 24).alias("h")
    w = F.shiftleft(F.col("a").bitwiseAND(F.lit(0xFFFFFF)), 16).bitwiseOR(F.col("b").bitwiseAND(F.lit(0xFFFF)).cast("long")).alias("w")
    return rows.select(F.shiftright(F.col("b"), 16).cast("byte").alias("kind"), h, w, "n0", "n1")


def _key(kind: int, h: np.ndarray, w: np.ndarray) -> np.ndarray:
    """What tasks look expressions up with; h counts for pairs alone."""
    return wordhash.mix(wordhash.mix(h) + w) if kind == PAIR else wordhash.mix(w + np.uint64(kind)) if kind else w


def _counted(words: wordhash.Words) -> list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """_events() without the words themselves, which the shortest stem's rows name: there w is 0 if a word has no stem."""
    events = {e[0]: e for e in _events(words)}
    _, every, _, own = events.pop(WORD)
    _, at, _, stem = events[STEMS[-1]]
    w = np.zeros(len(own), np.uint64)
    w[at] = stem
    return [*(e for kind, e in events.items() if kind != STEMS[-1]), (STEMS[-1], every, own, w)]


def event_counts(marked: DataFrame) -> DataFrame:
    """marked(norm, cls) -> (kind, h, w, n0, n1): in how many documents of each class each expression stands."""

    def count(batches):
        for pdf in batches:
            cls = pdf["cls"].to_numpy(np.int64)
            for first, words in wordhash.chunks(list(pdf["norm"]), PART):
                for kind, at, h, w in _counted(words):
                    text = words.text[at]
                    order = np.lexsort((text, w, h))
                    text, h, w = text[order], h[order], w[order]
                    new = np.ones(len(w), bool)
                    new[1:] = (h[1:] != h[:-1]) | (w[1:] != w[:-1])
                    once = new.copy()
                    once[1:] |= text[1:] != text[:-1]
                    text, h, w, new = text[once], h[once], w[once], new[once]
                    at, toxic = np.flatnonzero(new), cls[first + text]
                    if len(at):
                        n1, n = np.add.reduceat(toxic, at), np.diff(np.append(at, len(w)))
                        a, b = _packed(kind, h[at], w[at])
                        yield pd.DataFrame({"a": a.view(np.int64), "b": b, "n0": n - n1, "n1": n1})

    made = marked.mapInPandas(count, "a long, b int, n0 long, n1 long").groupBy("a", "b").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    rows = _unpacked(stored(made, "tox-counts"))
    words = rows.where(F.col("kind") == STEMS[-1]).select(F.lit(WORD).cast("byte").alias("kind"), F.lit(0).cast("long").alias("h"), F.col("h").alias("w"), "n0", "n1")
    return rows.where((F.col("kind") != STEMS[-1]) | (F.col("w") != 0)).unionByName(words)


def _shrunk(p0: Column, p1: Column, errors: float) -> Column:
    """log p1 / p0, less `errors` standard errors."""
    ratio = F.log(p1 / p0)
    error = F.sqrt(1 / (F.col("n0") + 0.5) + 1 / (F.col("n1") + 0.5))
    return F.sign(ratio) * F.greatest(F.lit(0.0), F.abs(ratio) - errors * error)


def _class_probabilities(counts: DataFrame, shared: DataFrame, discounts: list) -> DataFrame:
    """counts(w, n0, n1), shared(w, q) -> with p0 and p1: discounted counts, and what they leave, spread by q."""
    off = [kn.discount(F.col(f"n{c}"), discounts[c]) for c in (0, 1)]
    sums = counts.agg(*[F.sum(f"n{c}") for c in (0, 1)], *[F.sum(o) for o in off]).first()
    total = [float(sums[c] or 1) for c in (0, 1)]
    left = [float(sums[2 + c] or 0) / total[c] or 1.0 for c in (0, 1)]
    p = [((F.col(f"n{c}") - off[c]) / total[c] + left[c] * F.col("q")).alias(f"p{c}") for c in (0, 1)]
    return counts.join(shared, "w").select("w", "n0", "n1", *p)


def _continuation(kinds: DataFrame) -> DataFrame:
    """kinds(w, n): in how many different contexts w stands -> (w, q), discounted and interpolated with an even share."""
    d = kn.discounts(kinds)
    total, number, off = (float(x or 0) for x in kinds.agg(F.sum("n"), F.count(F.lit(1)), F.sum(kn.discount(F.col("n"), d))).first())
    return kinds.select("w", ((F.col("n") - kn.discount(F.col("n"), d) + off / (number + 1)) / max(total, 1.0)).alias("q"))


def ratios_of(counts: DataFrame, errors: float = ERRORS, least: int = LEAST_DOCUMENTS) -> DataFrame:
    """counts(kind, h, w, n0, n1) (stored) -> (kind, h, w, v): the expressions with evidence, and their log ratios."""
    seen = (F.col("n0") + F.col("n1") >= least) & (F.col("v") != 0)
    zero = F.lit(0).cast("long").alias("h")
    count_of = F.count(F.lit(1)).alias("n")
    out = None
    pairs = counts.where(F.col("kind") == PAIR).select("h", "w", "n0", "n1")
    for kind in (WORD, *STEMS):
        own = counts.where(F.col("kind") == kind)
        contexts = stored((pairs if kind == WORD else own).groupBy("w").agg(count_of), "tox-contexts")
        sums = stored(own.groupBy("w").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")), "tox-sums")
        d = [kn.discounts(sums.where(f"n{c} > 0"), f"n{c}") for c in (0, 1)]
        shared = _continuation(contexts)
        made = _class_probabilities(sums, shared, d).withColumn("v", _shrunk(F.col("p0"), F.col("p1"), errors)).where(seen).select(F.lit(kind).cast("byte").alias("kind"), zero, "w", "v")
        out = made if out is None else out.unionByName(made)
        if kind == WORD:
            words = shared
    # the same for words after a word: both classes leave to the words after it in both together, those to words anywhere
    pairs = pairs.withColumn("n", F.col("n0") + F.col("n1"))
    parts = ("n0", "n1", "n")
    off = {c: kn.discount(F.col(c), kn.discounts(pairs.where(f"{c} > 0"), c)) for c in parts}
    after = pairs.groupBy("h").agg(*[F.sum(c).alias(f"t_{c}") for c in parts], *[F.sum(off[c]).alias(f"off_{c}") for c in parts])
    joined = pairs.where(F.col("n") >= least).join(after, "h").join(words, "w")
    less = lambda c, q: (F.col(c) - off[c] + F.col(f"off_{c}") * q) / F.col(f"t_{c}")
    joined = joined.withColumn("both", less("n", F.col("q")))
    p = [F.when(F.col(f"t_{c}") > 0, less(c, F.col("both"))).otherwise(F.col("both")) for c in ("n0", "n1")]
    made = joined.withColumn("v", _shrunk(p[0], p[1], errors)).where(seen)
    return out.unionByName(made.select(F.lit(PAIR).cast("byte").alias("kind"), "h", "w", "v"))


def ratio_sums(docs: DataFrame, ratios: DataFrame, norm: str, total: str, count: str, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """docs (without norm) with the sum of the ratios of the words of column norm, and their number. Of a word's
    expressions that with the largest ratio speaks. ratios is stored; each part of shard_rows rows takes a pass."""

    def keyed(batches):
        for pdf in batches:
            k = np.zeros(len(pdf), np.uint64)
            h, w, kind = (pdf[c].to_numpy() for c in ("h", "w", "kind"))
            for one in np.unique(kind):
                at = np.flatnonzero(kind == one)
                k[at] = _key(int(one), h[at].view(np.uint64), w[at].view(np.uint64))
            yield pd.DataFrame({"k": k.view(np.int64), "v": pdf["v"].astype(np.float32)})

    table = stored(ratios.mapInPandas(keyed, "k long, v float"), "tox-model")
    shards = max(1, -(-table.count() // shard_rows))
    best, = fresh(docs, "tox_best")
    out = docs.withColumn(best, F.lit(None).cast("binary"))
    for shard in range(shards):
        out = _pass(out, table.where(F.pmod("k", F.lit(shards)) == shard), norm, best)
        if shard < shards - 1:
            out = stored(out.drop(f"{best}_sum", f"{best}_n"), f"tox-best{shard}")
    # the last pass leaves the sum and the number in the place of the ratios
    return out.withColumns({total: F.col(f"{best}_sum"), count: F.col(f"{best}_n")}).drop(norm, best, f"{best}_sum", f"{best}_n")


def _pass(docs: DataFrame, table: DataFrame, norm: str, best: str) -> DataFrame:
    """docs with the ratio of each word of norm by the surest of its expressions in this and earlier passes (floats, in
    best), their sum and their number."""
    rows = table.toArrow()
    sent = docs.sparkSession.sparkContext.broadcast((rows["k"].to_numpy().view(np.uint64), rows["v"].to_numpy()))
    names, mark = docs.columns, uuid.uuid4().hex
    schema = T.StructType([*docs.schema.fields, T.StructField(f"{best}_sum", T.DoubleType()), T.StructField(f"{best}_n", T.LongType())])

    def add(batches):
        import pyarrow as pa

        try:
            kn._TABLES.clear()
            kn._TABLES[mark] = kn.Table(*sent.value)
            known = kn._TABLES[mark]
            for batch in batches:
                texts, earlier = (batch.column(names.index(c)).to_pylist() for c in (norm, best))
                sums, n, now = np.zeros(len(texts)), np.zeros(len(texts), np.int64), [b""] * len(texts)
                for first, w in wordhash.chunks(texts, PART):
                    value = np.zeros(len(w.start), np.float32)
                    old = [x for x in earlier[first : first + len(w.count)] if x]
                    if old:
                        value = np.frombuffer(b"".join(old), "<f4").copy()
                    for kind, at, h, x in _events(w):
                        _, v = known.get(_key(kind, h, x))
                        value[at] = np.where(np.abs(v) > np.abs(value[at]), v, value[at])
                    end = first + len(w.count)
                    sums[first:end], n[first:end] = np.bincount(w.text, value, len(w.count)), w.count
                    now[first:end] = [value[e - k : e].tobytes() for e, k in zip(np.cumsum(w.count), w.count)]
                columns = dict(zip(names, batch.columns)) | {best: pa.array(now, pa.binary())}
                yield pa.RecordBatch.from_arrays([*[columns[c] for c in names], pa.array(sums), pa.array(n)], names=schema.names)
        finally:
            kn._TABLES.clear()

    return docs.mapInArrow(add, schema)


def fitted(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Logistic regression of one number: centre, slope and offset, by Newton's method with a little shrinkage."""
    if len(x) == 0 or y.min() == y.max():
        return 0.0, 0.0, -6.0 if len(y) == 0 or y.max() == 0 else 6.0
    mid, wide = float(np.median(x)), float(np.std(x)) or 1.0
    z = np.column_stack([(x - mid) / wide, np.ones(len(x))])
    b = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + 1e-3 * np.eye(2), z.T @ (y - p) - 1e-3 * b)
        b += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return mid, float(b[0] / wide), float(b[1])


def marks_of(labels: DataFrame) -> DataFrame:
    """labels(doc_id, toxic) -> (doc_id, cls): one row per id, toxic if any of its labels is."""
    return labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("cls"))


def scored(docs: DataFrame, labels: DataFrame, text: str = "text", shard_rows: int = SHARD_ROWS) -> DataFrame:
    """docs (doc_id, text and any others) with tox_ratio, held_out, score (0 to 1) and predicted.

    labels(doc_id, toxic) are learnt only where crc32(doc_id as text) mod 5 is not 0: remainders 1 to 3 (all their
    texts) make the counts of the two classes, remainder 4 turns the ratio into a probability. A document with labels
    of both kinds counts as toxic; null labels and ids are not used. Null and empty texts have the average ratio.
    Without labels of both kinds the score is one low (or high) number for all.
    """
    fold = crc_mod(F.col("doc_id"), 5)
    marks = stored(marks_of(labels), "tox-labels")
    texts = docs.select("doc_id", words_text(F.col(text)).alias("norm"))
    marked = texts.join(small(stored(marks.where(fold.isin(1, 2, 3)), "tox-train")), "doc_id").select("norm", "cls")
    ratios = stored(ratios_of(event_counts(marked)), "tox-ratios")
    rest = stored(marks.where(fold == 4).orderBy(F.xxhash64("doc_id"), "doc_id").limit(CALIBRATION_ROWS), "tox-rest")
    sample = texts.join(F.broadcast(rest), "doc_id").select("norm", "cls")
    pairs = ratio_sums(sample, ratios, "norm", "s", "n", shard_rows).select("s", "n", "cls").toArrow()
    s, n, cls = (pairs[c].to_numpy().astype(float) for c in ("s", "n", "cls"))
    mean = float(s.sum() / max(n.sum(), 1))
    mid, slope, offset = fitted((s - mean * n) / (n + PRIOR_WORDS), cls)
    norm, total, count, ratio, held, score, predicted = fresh(docs, "tox_words", "tox_sum", "tox_count", "tox_ratio", "held_out", "score", "predicted")
    out = ratio_sums(docs.withColumn(norm, words_text(F.col(text))), ratios, norm, total, count, shard_rows)
    out = out.withColumn(ratio, (F.col(total) - mean * F.col(count)) / (F.col(count) + PRIOR_WORDS)).drop(norm, total, count)
    out = out.withColumn(score, 1 / (1 + F.exp(-(slope * (F.col(ratio) - mid) + offset))))
    return out.withColumns({held: fold == 0, predicted: (F.col(score) >= 0.5).cast("int")})
