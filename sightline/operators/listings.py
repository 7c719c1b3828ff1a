"""Name, address and phone of a business against its listings: linked by one field that is the same and another that
is the same or one edit away, and compared field by field."""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.sources.shared import stored

# Legal forms that names do without, short forms of words in addresses, and how grave a mismatch is.
LEGAL_FORMS = ("inc", "llc", "ltd", "gmbh", "co", "corp", "plc", "sa", "sarl", "bv")
SHORT_FORMS = {"street": "st", "avenue": "ave", "road": "rd", "boulevard": "blvd", "suite": "ste", "north": "n", "south": "s", "east": "e", "west": "w"}
SEVERITIES = {"name": "Critical", "address": "High", "phone": "Medium"}
FIELDS = tuple(SEVERITIES)
#: Digits of a phone that count, from its end: what stands before them is the way to dial.
DIGITS = 9
#: Rows with the same value that are all compared.
FEW = 32


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def normal(field: str, text: Column) -> Column:
    """A field's form for comparison; null if nothing is left of it."""
    if field == "phone":
        out = F.substring(F.regexp_replace(text, r"[^0-9]+", ""), -DIGITS, DIGITS)
    elif field == "name":
        out = F.array_join(F.filter(_words(text), lambda w: ~w.isin(*LEGAL_FORMS)), " ")
    else:
        short = F.create_map(*[F.lit(x) for pair in SHORT_FORMS.items() for x in pair])
        out = F.array_join(F.transform(_words(text), lambda w: F.coalesce(F.element_at(short, w), w)), " ")
    return F.nullif(out, F.lit(""))


def _variants(text: Column) -> Column:
    """The text and what is left of it without each of its characters: texts one edit apart have one in common."""
    less = F.transform(F.sequence(F.lit(1), F.length(text)), lambda i: F.concat(F.substring(text, F.lit(1), i - 1), F.substring(text, i + 1, F.length(text))))
    return F.concat(F.array(text), F.when(F.length(text) > 0, less).otherwise(F.array().cast("array<string>")))


def within_one_edit(left: DataFrame, right: DataFrame, few: int = FEW) -> DataFrame:
    """left(a, same, text) and right(b, same, text) -> (a, b): equal in `same`, texts at most one edit apart.

    Where `few` rows of one side or fewer have a value of `same`, they meet all of the other that have it. Where both
    sides have more, they meet by the texts without one character, so that the work grows with the rows and not with
    their square; a text of n characters then has n + 1 keys. Nulls meet nothing.
    """
    known = "same is not null and text is not null"
    left, right = left.where(known), right.where(known)
    count = lambda df, c: df.groupBy("same").agg(F.count(F.lit(1)).alias(c))
    sizes = stored(count(left, "l").join(count(right, "r"), "same").select("same", (F.least("l", "r") > few).alias("many")), "sizes")
    keys = lambda text: F.explode(F.array_distinct(F.when(F.col("many"), F.transform(_variants(F.col(text)), lambda v: F.xxhash64("same", v))).otherwise(F.array(F.xxhash64("same"))))).alias("key")
    a = left.join(sizes, "same").select("a", F.col("same").alias("same_a"), F.col("text").alias("text_a"), keys("text"))
    b = right.join(sizes, "same").select("b", F.col("same").alias("same_b"), F.col("text").alias("text_b"), keys("text"))
    met = a.join(b, "key").where((F.col("same_a") == F.col("same_b")) & (F.levenshtein("text_a", "text_b", 1) >= 0))
    return met.select("a", "b").distinct()


def _forms(rows: DataFrame, *kept: str) -> DataFrame:
    """Normal forms, stored once: plans that hold their expressions many times over don't fit a small driver."""
    return stored(rows.select(*kept, *[normal(f, F.col(f)).alias(f) for f in FIELDS]), "forms")


def _linked(own: DataFrame, listings: DataFrame) -> DataFrame:
    """linked() of tables in normal forms. Both fields of a link are told by the first sign of `same`."""
    pairs = list(permutations(FIELDS, 2))
    sides = F.explode(F.array(*[F.struct(F.concat(F.lit(str(i)), F.col(same)).alias("same"), F.col(near).alias("text")) for i, (same, near) in enumerate(pairs)])).alias("s")
    side = lambda df, k, name: df.select(F.col(k).alias(name), sides).select(name, "s.*")
    return within_one_edit(side(own, "business", "a"), side(listings, "listing", "b")).select(F.col("a").alias("business"), F.col("b").alias("listing"))


def linked(own: DataFrame, listings: DataFrame) -> DataFrame:
    """own(business, name, address, phone) and listings(listing, name, address, phone) -> (business, listing): pairs that
    are the same in one field's normal form, and the same or one edit apart in another's. A field that is null in
    either links nothing. Listings may be linked to several businesses, and to none."""
    return _linked(_forms(own, "business"), _forms(listings, "listing"))


def _state(field: str) -> Column:
    x, y = F.col(f"a_{field}"), F.col(f"b_{field}")
    near = (F.levenshtein(x, y, 1) >= 0) | (F.contains(x, y) | F.contains(y, x) if field != "phone" else F.lit(False))
    return F.when(x.isNull() | y.isNull(), "missing").when(x == y, "exact").when(near, "partial").otherwise("conflicting")


def compared(own: DataFrame, listings: DataFrame) -> DataFrame:
    """linked() with the listing's platform, each field's state, and issues: "Severity: field" for each that conflicts.

    States: exact (the same normal form), partial (one edit apart, or for names and addresses one within the other),
    missing (null or empty on either side), conflicting. business and listing must be unique.
    """
    one, two = _forms(own, "business"), _forms(listings, "listing", "platform")
    pairs = stored(_linked(one, two), "links")
    left = one.select("business", *[F.col(f).alias(f"a_{f}") for f in FIELDS])
    right = two.select("listing", "platform", *[F.col(f).alias(f"b_{f}") for f in FIELDS])
    both = pairs.join(left, "business").join(right, "listing")
    states = both.select("business", "listing", "platform", *[_state(f).alias(f) for f in FIELDS])
    issues = F.array_compact(F.array(*[F.when(F.col(f) == "conflicting", f"{s}: {f}") for f, s in SEVERITIES.items()]))
    return states.withColumn("issues", issues)


def consistency(found: DataFrame, own: DataFrame, platforms: list[str]) -> DataFrame:
    """compared() and own -> (business, listings, share, unclaimed): how many listings, the share of their known fields
    that are exact (null without any), and the platforms without a listing, in the order given."""
    known = sum((F.when(F.col(f) != "missing", 1).otherwise(0) for f in FIELDS), F.lit(0))
    exact = sum((F.when(F.col(f) == "exact", 1).otherwise(0) for f in FIELDS), F.lit(0))
    per = found.groupBy("business").agg(F.count(F.lit(1)).alias("listings"), F.sum(exact).alias("e"), F.sum(known).alias("k"), *[F.max(F.col("platform") == p).alias(f"on_{i}") for i, p in enumerate(platforms)])
    out = own.select("business").join(per, "business", "left")
    absent = F.array_compact(F.array(*[F.when(~F.coalesce(f"on_{i}", F.lit(False)), p) for i, p in enumerate(platforms)]))
    return out.select("business", F.coalesce("listings", F.lit(0)).alias("listings"), (F.col("e") / F.nullif("k", F.lit(0))).alias("share"), absent.alias("unclaimed"))
