"""Byte-level BPE encoding and decoding.

A text is cut by a pattern into words, each of which is encoded by itself: its bytes are the first pieces, and of all
neighbours whose joined bytes have a rank those of the lowest rank are joined (of equals the first), until none has.
All distinct words are counted. The most frequent ones, of a bounded number, are encoded once, by a fold of Spark's
higher-order functions over a word's bytes: pieces are named by their ranks, so the rank map is from two ranks to one,
a literal array of small maps, as Spark searches a map from its start. Tasks then write texts by that table; a word that
it lacks is joined where it stands, as a fold takes some 75 microseconds a word and five times that before it is
compiled. Texts are never shuffled. Decoding joins the hexadecimal bytes of the ids.
"""

from __future__ import annotations

import base64
import heapq
import json
from collections.abc import Iterator
from itertools import chain

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sightline.llm.common import let, stored

#: The most words in the table that is sent to each task: some 60 bytes each.
TABLE_WORDS = 150_000
#: Maps in the literal of pairs.
PAIR_MAPS = 16_381
#: Bytes of a word that is folded; of longer ones, which are joined with a heap, a fold takes time by the square.
LONG = 64
#: Rare words whose ids a task keeps at most, and rows that it hands on at once.
KEPT, ROWS = 100_000, 500
#: Stands for the rank of a pair that has none; ranks are smaller than 2^20 - 1.
NONE, SHIFT = (1 << 20) - 1, 1 << 20
_IDS = "array<bigint>"


def read_ranks(path: str) -> dict[bytes, int]:
    """Bytes and rank of each line of a vocabulary file on the driver."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def _literal(maps: list[dict], key: str, value: str) -> Column:
    """An array of maps as one literal; the optimizer reads the JSON once."""
    return F.from_json(F.lit(json.dumps(maps, separators=(",", ":"))), f"array<map<string,{value}>>").cast(f"array<map<{key},{value}>>")


def pair_maps(ranks: dict[bytes, int]) -> Column:
    """The rank of each two pieces that make a third, by both pieces' ranks."""
    out: list[dict] = [{} for _ in range(PAIR_MAPS)]
    for piece, rank in ranks.items():
        for i in range(1, len(piece)):
            a, b = ranks.get(piece[:i]), ranks.get(piece[i:])
            if a is not None and b is not None:
                out[(a * 127 + b) % PAIR_MAPS][str(a * SHIFT + b)] = rank
    return _literal(out, "bigint", "bigint")


def merged(word: Column, ranks: dict[bytes, int]) -> Column:
    """The ids of one word, an array."""
    byte_ids = F.split(F.lit(",".join(str(ranks[bytes([b])]) for b in range(256))), ",").cast(_IDS)
    none = F.array().cast(_IDS)

    def folded(maps: Column) -> Column:
        def entry(a: Column, b: Column) -> Column:
            """A piece with the rank of what it makes with the next one, as one number."""
            rank = F.try_element_at(F.get(maps, F.pmod(a * 127 + b, F.lit(PAIR_MAPS)).cast("int")), a * SHIFT + b)
            return F.coalesce(rank, F.lit(NONE)) * SHIFT + a

        def step(e: Column, _: Column) -> Column:
            def joined(i: Column) -> Column:
                m, before, after = F.shiftright(F.get(e, i - 1), 20), F.get(e, i - 2), F.get(e, i + 1)
                left = F.when(i > 1, F.array(entry(before % SHIFT, m))).otherwise(none)
                own = F.array(F.when(i + 1 < F.size(e), entry(m, after % SHIFT)).otherwise(NONE * SHIFT + m))
                return F.concat(F.slice(e, 1, F.greatest(i - 2, F.lit(0))), left, own, F.slice(e, i + 2, F.size(e)))

            ranks_ = F.transform(e, lambda x: F.shiftright(x, 20))
            first = let(ranks_, lambda r: F.array_position(r, F.array_min(r)).cast("int"))
            return F.when(F.array_min(e) < NONE * SHIFT, let(first, joined)).otherwise(e)

        def from_bytes(p: Column) -> Column:
            last = F.array(NONE * SHIFT + F.element_at(p, -1))
            e = F.concat(F.zip_with(F.slice(p, 1, F.size(p) - 1), F.slice(p, 2, F.size(p)), entry), last)
            return F.aggregate(F.sequence(F.lit(1), F.size(p)), e, step, lambda e: F.transform(e, lambda x: x % SHIFT))

        digits = F.hex(F.encode(word, "UTF-8"))
        by_hex = let(digits, lambda h: F.transform(F.sequence(F.lit(0), (F.length(h) / 2).cast("int") - 1), lambda i: F.get(byte_ids, F.conv(F.substring(h, 2 * i + 1, F.lit(2)), 16, 10).cast("int"))))
        by_letter = F.transform(F.sequence(F.lit(1), F.length(word)), lambda i: F.get(byte_ids, F.ascii(F.substring(word, i, F.lit(1)))))
        return let(F.when(F.length(word) == F.octet_length(word), by_letter).otherwise(by_hex), from_bytes)

    return F.when(F.length(word) > 0, let(pair_maps(ranks), folded)).otherwise(none)


def merged_here(word: bytes, ranks: dict[bytes, int]) -> tuple[int, ...]:
    """The ids of one word in Python."""
    if word in ranks:
        return (ranks[word],)
    if len(word) > LONG:
        return tuple(_merged_long(word, ranks))
    parts = [word[i : i + 1] for i in range(len(word))]
    pairs = [ranks.get(word[i : i + 2], NONE) for i in range(len(word) - 1)]
    while pairs and (best := min(pairs)) < NONE:
        i = pairs.index(best)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
        del pairs[i]
        if i:
            pairs[i - 1] = ranks.get(parts[i - 1] + parts[i], NONE)
        if i < len(pairs):
            pairs[i] = ranks.get(parts[i] + parts[i + 1], NONE)
    return tuple([ranks[p] for p in parts])


def _merged_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """As merged_here(), in n log n steps: pieces are linked by the place where they start."""
    n = len(word)
    end, after, before = list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1))
    heap: list[tuple[int, int, int]] = []

    def push(i: int) -> None:
        j = after[i]
        if j < n and (r := ranks.get(word[i : end[j]])) is not None:
            heapq.heappush(heap, (r, i, end[j]))

    for i in range(n - 1):
        push(i)
    gone = bytearray(n)
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = after[i]
        if gone[i] or j >= n or end[j] != stop:
            continue  # one of the two has been joined with another since
        gone[j], end[i], after[i] = 1, stop, after[j]
        if after[i] < n:
            before[after[i]] = i
        push(i)
        if before[i] >= 0:
            push(before[i])
    return [ranks[word[i : end[i]]] for i in range(n) if not gone[i]]


def unicode_spaces(pattern: str) -> str:
    r"""The pattern with \s as Unicode's White_Space, which is what tokenizer libraries mean by it."""
    return pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")


def word_counts(docs: DataFrame, pattern: str, text: str = "text") -> DataFrame:
    """(w, n): the distinct matches of the pattern in all texts, and how often they stand there."""
    java = unicode_spaces(pattern).replace("{White_Space}", "{IsWhite_Space}")
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(java), F.lit(0))
    return docs.select(F.explode(found).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n"))


def word_table(counts: DataFrame, ranks: dict[bytes, int], most: int = TABLE_WORDS) -> dict[str, tuple[int, ...]]:
    """counts(w, n) -> the ids of the most frequent words, `most` at most, cut by eighths of powers of two of n."""
    level = F.floor(F.log2("n") * 8).cast("int")
    repeated = counts.where((F.col("n") > 1) & (F.octet_length("w") <= LONG)).select("w", level.alias("level"))
    room, cut = most, None
    for at, size in sorted(repeated.groupBy("level").count().collect(), reverse=True):  # at most eight rows a power of two
        room -= size
        if room < 0:
            break
        cut = at
    if cut is None:
        return {}
    # stored, so that the rank map's literal goes through the optimizer in the smallest of plans
    often = stored(repeated.where(F.col("level") >= cut).select("w").repartition("w"), "bpe-often")
    made = {r.w: tuple(r.ids) for r in often.select("w", merged(F.col("w"), ranks).alias("ids")).collect()}
    # a word that has a rank is one piece, whatever its pairs say
    return {w: (ranks[w.encode()],) if w.encode() in ranks else ids for w, ids in made.items()}


def encoded(docs: DataFrame, ranks: dict[bytes, int], pattern: str, text: str = "text", out: str = "ids", most: int = TABLE_WORDS) -> DataFrame:
    """docs with the ids of each whole text; null and empty texts have none. Special tokens are ordinary text."""
    counts = stored(word_counts(docs, pattern, text), "bpe-words")
    sent = docs.sparkSession.sparkContext.broadcast((ranks, word_table(counts, ranks, most)))
    pattern, at = unicode_spaces(pattern), docs.columns.index(text)

    def encode(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import regex

        find = regex.compile(pattern).findall
        table, known = sent.value
        rare: dict[str, tuple[int, ...]] = {}

        def ids(w: str) -> tuple[int, ...]:
            if (got := known.get(w)) is None and (got := rare.get(w)) is None:
                if len(rare) >= KEPT:
                    rare.clear()
                got = rare[w] = merged_here(w.encode("utf-8", "surrogatepass"), table)
            return got

        for whole in batches:
            for k in range(0, whole.num_rows, ROWS):
                batch = whole.slice(k, ROWS)
                rows = [np.fromiter(chain.from_iterable(map(ids, find(t or ""))), np.int32) for t in batch.column(at).to_pylist()]
                ends = np.cumsum([0, *map(len, rows)])
                kind = pa.list_ if ends[-1] < 2**31 else pa.large_list
                flat = pa.array(np.concatenate(rows) if rows else np.zeros(0, np.int32))
                made = (pa.ListArray if kind is pa.list_ else pa.LargeListArray).from_arrays(pa.array(ends, pa.int32() if kind is pa.list_ else pa.int64()), flat)
                yield pa.RecordBatch.from_arrays([*batch.columns, made], names=[*batch.schema.names, out])

    return docs.mapInArrow(encode, T.StructType([*docs.schema.fields, T.StructField(out, T.ArrayType(T.IntegerType()))]))


def decoded(docs: DataFrame, ranks: dict[bytes, int], ids: str = "ids", out: str = "decoded") -> DataFrame:
    """docs with the joined bytes of each row's ids; null ids give null, an id that has no bytes is an error."""
    pieces = {v: k.hex() for k, v in ranks.items()}
    table = F.split(F.lit(",".join(pieces.get(i, "") for i in range(max(pieces) + 1))), ",")
    piece = lambda t, i: F.coalesce(F.nullif(F.get(t, i), F.lit("")), F.raise_error(F.concat(F.lit("no bytes for id "), i.cast("string"))))
    return docs.withColumn(out, let(table, lambda t: F.unhex(F.array_join(F.transform(ids, lambda i: piece(t, i)), ""))))


def digests(docs: DataFrame, ranks: dict[bytes, int], pattern: str, most: int = TABLE_WORDS) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_tokens, ids_sha256 and decoded_sha256 of its ids and of the bytes they decode to.
    Null and empty texts have no tokens; repeated rows each have a row."""
    both = decoded(encoded(docs.select("doc_id", "text"), ranks, pattern, most=most).drop("text"), ranks)
    joined = F.array_join(F.col("ids").cast("array<string>"), " ")
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(joined.cast("binary"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
