"""Character n-gram models with interpolated modified Kneser-Ney smoothing.

Counts are gathered by Spark over every training text (each task sums its own part first), the probabilities are
joined together order by order, and the finished table is cut into shards of a bounded number of rows. One pass over
the corpus per shard adds that shard's part to each text's log-likelihood, so a task never holds more than one shard.
A null text counts as an empty one; it has no characters, and so no grams and a sum of 0.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sightline.llm.common import released, stored

ORDER = 5
#: Stands before the first character of a text.
START = 2
#: Characters that are worked on at once, in a task.
PIECE = 400_000
#: Rows of the model in a shard, and so in a broadcast: 16 bytes a row, about 4 times that with the table's gaps.
SHARD_ROWS = 2_000_000

_rng = np.random.Generator(np.random.PCG64(20240101))
_MULT = _rng.integers(1, 2**63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SALT = _rng.integers(1, 2**63, 16, dtype=np.uint64)


def pieces(texts: list, order: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Code points, number of the text, and whether a position counts; context before a piece doesn't count."""
    got: list[tuple[int, np.ndarray, np.ndarray]] = []
    size = 0

    def out():
        codes = np.concatenate([x for _, before, body in got for x in (before, body)])
        at = np.concatenate([np.full(len(before) + len(body), i, np.int64) for i, before, body in got])
        real = np.concatenate([x for _, before, body in got for x in (np.zeros(len(before), bool), np.ones(len(body), bool))])
        return codes, at, real

    for i, text in enumerate(texts):
        if not isinstance(text, str) or not text:
            continue
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
        before = np.full(order - 1, START, np.uint32)
        for k in range(0, len(codes), PIECE):
            body = np.maximum(codes[k : k + PIECE], 1)
            got.append((i, before, body))
            before = np.concatenate([before, body])[len(body) :][-(order - 1) :] if order > 1 else before
            size += len(body)
            if size >= PIECE:
                yield out()
                got, size = [], 0
    if got:
        yield out()


def keys(codes: np.ndarray, length: int) -> np.ndarray:
    """A hash of the `length` characters that end at each position (of fewer at the first ones)."""
    out = np.full(len(codes), _SALT[length], np.uint64)
    c = codes.astype(np.uint64)
    for j in range(length):
        out[j:] += c[: len(c) - j] * _MULT[j]
    return out


def gram_counts(texts: DataFrame, order: int = ORDER) -> DataFrame:
    """texts(text, cls) -> (g, cls, n): how often each gram of `order` characters stands in the texts of a class."""

    def count(batches):
        for pdf in batches:
            for cls, part in pdf.groupby("cls", dropna=False):
                for codes, _, real in pieces(list(part["text"]), order):
                    at = np.flatnonzero(real)
                    _, first, n = np.unique(keys(codes, order)[at], return_index=True, return_counts=True)
                    ends = at[first]
                    grid = np.ascontiguousarray(codes[ends[:, None] + np.arange(1 - order, 1)].astype("<u4"))
                    yield pd.DataFrame({"g": grid.view(f"<U{order}").ravel().astype(object), "cls": int(cls), "n": n.astype(np.int64)})

    made = texts.select(F.coalesce("text", F.lit("")).alias("text"), F.col("cls").cast("int").alias("cls")).where("text <> ''")
    return made.mapInPandas(count, "g string, cls int, n long").groupBy("g", "cls").agg(F.sum("n").alias("n"))


def discounts(counts: DataFrame, n: str = "n") -> tuple[float, float, float]:
    """Chen and Goodman's three discounts from the numbers of grams seen once to four times."""
    row = counts.agg(*[F.count_if(F.col(n) == k).alias(f"n{k}") for k in (1, 2, 3, 4)]).first()
    n1, n2, n3, n4 = (float(x) for x in row)
    if not n1 or not n2:
        return 0.5, 0.75, 0.9
    y = n1 / (n1 + 2 * n2)
    d1 = 1 - 2 * y * n2 / n1
    d2 = 2 - 3 * y * n3 / n2
    d3 = 3 - 4 * y * n4 / n3 if n3 else d2
    return tuple(min(max(d, 0.1), top) for d, top in ((d1, 0.95), (d2, 1.9), (d3, 2.85)))


def discount(n: Column, d: tuple[float, float, float]) -> Column:
    return F.when(n >= 3, d[2]).when(n == 2, d[1]).when(n == 1, d[0]).otherwise(0.0)


def lower_orders(top: DataFrame, order: int) -> dict[int, DataFrame]:
    """top(g, n) and, for each lower order, in how many different characters' wake a gram stands."""
    out = {order: top}
    for k in range(order - 1, 0, -1):
        out[k] = out[k + 1].groupBy(F.expr("substring(g, 2)").alias("g")).agg(F.count(F.lit(1)).alias("n"))
    return out


@dataclass
class Model:
    """table(k, kind, v, shard), k being the hash of a gram g; kind 0: v is what g adds; kind 1: what an unseen gram after
    g adds first."""

    order: int
    table: DataFrame
    shards: int
    unseen: float


def interpolated(counts: dict[int, DataFrame], order: int) -> tuple[DataFrame, DataFrame, float]:
    """(g, p) of all grams of 1 to `order` characters, (g, w) of all contexts, and p of an unseen character."""
    first = stored(counts[1], "kn1")
    d = discounts(first)
    total, kinds, off = first.agg(F.sum("n"), F.count(F.lit(1)), F.sum(discount(F.col("n"), d))).first()
    total, kinds, off = float(total or 1), int(kinds or 0), float(off or 0)
    uniform = 1.0 / (kinds + 1)
    unseen = (off / total if kinds else 1.0) * uniform
    probs = stored(first.select("g", ((F.col("n") - discount(F.col("n"), d)) / total + unseen).alias("p")), "kn1p")
    grams, contexts = [probs], []
    for k in range(2, order + 1):
        level = stored(counts[k].withColumn("c", F.expr(f"substring(g, 1, {k - 1})")), f"kn{k}")
        d = discounts(level)
        n = F.col("n")
        weights = stored(level.groupBy("c").agg(F.sum("n").alias("t"), F.sum(discount(n, d)).alias("off")).select(F.col("c").alias("g"), "t", (F.col("off") / F.col("t")).alias("w")), f"kn{k}w")
        joined = level.join(weights.withColumnRenamed("g", "c"), "c").withColumn("s", F.expr("substring(g, 2)"))
        probs = joined.join(probs.select(F.col("g").alias("s"), F.col("p").alias("q")), "s").select("g", ((n - discount(n, d)) / F.col("t") + F.col("w") * F.col("q")).alias("p"))
        probs = stored(probs, f"kn{k}p")
        grams.append(probs)
        contexts.append(weights.select("g", "w"))
    return reduce(DataFrame.unionByName, grams), reduce(DataFrame.unionByName, contexts), unseen


def sharded(grams: DataFrame, contexts: DataFrame, order: int, unseen: float, rows: int = SHARD_ROWS) -> Model:
    """A model whose shards have about `rows` rows.

    All grams that one lookup may need end with the same character after the same one, so they are dealt by those two;
    the short ones, of which there are few, are in every shard.
    """
    both = grams.select("g", F.lit(0).alias("kind"), "v").unionByName(contexts.select("g", F.lit(1).alias("kind"), "v"))
    both = stored(both, "kn-model")
    shards = max(1, -(-both.count() // rows))
    tail = F.when(F.col("kind") == 0, F.expr("substring(g, length(g) - 2, 2)")).otherwise(F.expr("substring(g, length(g) - 1, 2)"))
    long_enough = F.length("g") + F.col("kind") >= 3
    shard = F.when(long_enough, F.pmod(F.xxhash64(tail), F.lit(shards)).cast("int")).otherwise(-1)
    return Model(order, stored(hashed(both.withColumn("shard", shard if shards > 1 else F.lit(-1))), "kn-shards"), shards, unseen)


def hashed(table: DataFrame) -> DataFrame:
    """(g, kind, v, shard) -> (k, kind, v, shard): grams by the hash that tasks look them up with, a sixth of the size."""

    def work(batches):
        for pdf in batches:
            k = np.zeros(len(pdf), np.uint64)
            length = pdf["g"].str.len().to_numpy(np.int64) if len(pdf) else np.zeros(0, np.int64)
            for n in np.unique(length):
                of = np.flatnonzero(length == n)
                grid = np.frombuffer("".join(pdf["g"].to_numpy()[of]).encode("utf-32-le", "surrogatepass"), "<u4").reshape(len(of), n).astype(np.uint64)
                k[of] = _SALT[n] + (grid[:, ::-1] * _MULT[:n]).sum(axis=1, dtype=np.uint64)
            yield pd.DataFrame({"k": k.view(np.int64), "kind": pdf["kind"].astype("int8"), "v": pdf["v"].astype("float32"), "shard": pdf["shard"]})

    return table.select("g", "kind", "v", "shard").mapInPandas(work, "k long, kind byte, v float, shard int")


class Table:
    """Open addressing over numpy arrays: hashed keys to values."""

    def __init__(self, k: np.ndarray, v: np.ndarray) -> None:
        self.bits = max(4, int(len(k) * 3).bit_length())
        size = 1 << self.bits
        self.k, self.v, self.used = np.zeros(size, np.uint64), np.zeros(size, np.float32), np.zeros(size, bool)
        self.tries, left, at = 0, np.arange(len(k)), self.slot(k)
        while len(left):
            self.tries += 1
            free = ~self.used[at]
            _, first = np.unique(at[free], return_index=True)
            put = np.flatnonzero(free)[first]
            self.k[at[put]], self.v[at[put]], self.used[at[put]] = k[left[put]], v[left[put]], True
            rest = np.ones(len(left), bool)
            rest[put] = False
            left, at = left[rest], (at[rest] + 1) & (size - 1)

    def slot(self, k: np.ndarray) -> np.ndarray:
        return ((k * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each key is known, and its value (0 if not)."""
        at = self.slot(k)
        known = self.used[at] & (self.k[at] == k)
        out = np.where(known, self.v[at], np.float32(0))
        left = np.flatnonzero(~known & self.used[at])
        at = at[left]
        for _ in range(self.tries):
            if not len(left):
                break
            at = (at + 1) & (len(self.k) - 1)
            hit = self.used[at] & (self.k[at] == k[left])
            known[left[hit]], out[left[hit]] = True, self.v[at[hit]]
            go = ~hit & self.used[at]
            left, at = left[go], at[go]
        return known, out


def packed(rows: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys, values and kinds of a shard's rows, 13 bytes each; the shard's size is bounded."""
    table = rows.select("k", "kind", "v").toArrow()
    return table["k"].to_numpy().view(np.uint64), table["v"].to_numpy(), table["kind"].to_numpy()


def summed(docs: DataFrame, model: Model, text: str, total: str, chars: str, backoff: bool = True) -> DataFrame:
    """docs with two more columns: the sum of what the model says of each character of `text`, and their number.

    backoff: an unseen gram adds its context's weight and then what the next shorter gram adds; if not, only the
    weight of its context (0 if that is unseen too).
    """
    out = docs.withColumns({total: F.lit(0.0), chars: F.lit(0).cast("long")})
    for shard in range(model.shards):
        k, v, kind = packed(model.table.where(F.col("shard").isin(-1, shard)))
        sent = docs.sparkSession.sparkContext.broadcast((k, v, kind))
        out = one_shard(out, sent, model, shard, text, total, chars, backoff)
        if model.shards > 1:
            out = stored(out, f"kn-sum{shard}")
    return out


#: The tables of the shard that a Python worker has used last.
_TABLES: dict[str, tuple[Table, Table]] = {}


def one_shard(docs: DataFrame, sent, model: Model, shard: int, text: str, total: str, chars: str, backoff: bool) -> DataFrame:
    order, shards, unseen = model.order, model.shards, float(np.log(model.unseen)) if model.unseen > 0 else 0.0
    names, mark = docs.columns, uuid.uuid4().hex

    def tables() -> tuple[Table, Table]:
        if mark not in _TABLES:
            _TABLES.clear()
            k, v, kind = sent.value
            _TABLES[mark] = Table(k[kind == 0], v[kind == 0]), Table(k[kind == 1], v[kind == 1])
        return _TABLES[mark]

    def add(batches):
        try:
            grams, contexts = tables()
            for pdf in batches:
                sums, count = np.zeros(len(pdf)), np.zeros(len(pdf), np.int64)
                for codes, at, real in pieces(list(pdf[text]), order):
                    pos = np.flatnonzero(real)
                    if shards > 1:
                        pos = pos[mine(codes, pos, shard, shards)]
                    value, left = np.zeros(len(pos)), np.arange(len(pos))
                    for n in range(order, 0, -1):
                        known, v = grams.get(keys(codes, n)[pos[left]])
                        value[left] += v
                        left = left[~known]
                        if not len(left):
                            break
                        if n == 1:
                            value[left] += unseen * backoff
                        else:
                            seen, w = contexts.get(keys(codes, n - 1)[pos[left] - 1])
                            value[left] += w
                            if not backoff:
                                break
                    np.add.at(sums, at[pos], value) if len(pos) < 1000 else np.add(sums, np.bincount(at[pos], value, len(pdf)), out=sums)
                    count += np.bincount(at[pos], minlength=len(pdf))
                pdf = pdf.copy()
                pdf.columns = names
                pdf[total] = pdf[total].to_numpy(np.float64) + sums
                pdf[chars] = pdf[chars].to_numpy(np.int64) + count
                yield pdf
        finally:
            _TABLES.clear()  # the worker is used again

    return docs.mapInPandas(released(add), T.StructType(docs.schema.fields))


def mine(codes: np.ndarray, pos: np.ndarray, shard: int, shards: int) -> np.ndarray:
    """Which positions are this shard's: by the two characters before them, hashed as Spark's xxhash64 does."""
    import xxhash

    two = codes[pos - 2].astype(np.int64) << 32 | codes[pos - 1]
    kinds, of = np.unique(two, return_inverse=True)
    part = np.array([np.int64(np.uint64(xxhash.xxh64_intdigest((chr(x >> 32) + chr(x & 0xFFFFFFFF)).encode("utf-8", "surrogatepass"), seed=42))) % shards for x in kinds.tolist()], np.int64)
    return part[of] == shard
