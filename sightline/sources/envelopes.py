"""Vendor payloads of any shape as rows of a module: nested envelopes, bare arrays and bare objects, read as VARIANT."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Each module's fields, with the keys that may hold them, the first that isn't null. A dot is part of a key.
MODULES: dict[str, dict[str, tuple[str, ...]]] = {
    "serp": {"type": ("type",), "rank": ("rank_absolute", "rank_group"), "title": ("title",), "url": ("url", "link"), "domain": ("domain",), "description": ("description", "snippet")},
    "keywords": {"keyword": ("keyword", "se_keyword"), "search_volume": ("search_volume", "keyword_info.search_volume"), "competition": ("competition",), "cpc": ("cpc",), "difficulty": ("keyword_difficulty", "keyword_properties")},
    "backlinks": {"url_from": ("url_from",), "url_to": ("url_to",), "domain_from": ("domain_from",), "anchor": ("anchor",), "dofollow": ("dofollow",), "rank": ("rank",), "first_seen": ("first_seen",)},
    "merchant": {"title": ("title",), "seller": ("seller", "shop_name", "domain"), "price": ("price", "current_price"), "currency": ("currency",), "rating": ("rating",), "url": ("url", "product_url", "link"), "product_id": ("product_id", "data_asin", "asin")},
    "onpage": {"url": ("url",), "status_code": ("status_code",), "title": ("meta.title", "title"), "issues": ("checks",)},
}


def member(v: Column, key: str) -> Column:
    """What a variant object has under a key, as a variant; null for JSON's null, and for what isn't an object."""
    found = F.try_variant_get(v, f"$['{key}']", "variant")
    return F.when(~F.is_variant_null(found), found)


def _list(v: Column, path: str) -> Column:
    """The array at a path; null if there is none, or something else stands there."""
    return F.try_variant_get(v, path, "array<variant>")


def _number(v: Column, path: str, kinds: str, cast: str) -> Column:
    """A JSON number at a path; null if what stands there is none (a text that looks like one too)."""
    return F.when(F.schema_of_variant(F.try_variant_get(v, path, "variant")).rlike(f"^(?:{kinds})"), F.try_variant_get(v, path, cast))


def _items(v: Column) -> Column:
    none = F.array().cast("array<variant>")
    result = lambda r: F.coalesce(_list(r, "$.items"), F.array(r))
    task = lambda t: F.flatten(F.transform(F.coalesce(_list(t, "$.result"), none), result))
    return F.coalesce(F.flatten(F.transform(_list(v, "$.tasks"), task)), _list(v, "$"), F.when(v.isNotNull(), F.array(v)), none)


def items(rows: DataFrame, payload: str = "payload") -> DataFrame:
    """rows with a payload (JSON text) -> the other columns, pos from 0, and item (a variant): one row for each item.

    tasks[].result[].items[] of an envelope, where a result without items counts as an item itself; else the elements
    of an array; else the payload itself. Null and what isn't JSON have no items. Items are taken out where their payload
    stands: nothing is shuffled.
    """
    others = [c for c in rows.columns if c != payload]
    return rows.select(*others, F.posexplode(_items(F.try_parse_json(payload))).alias("pos", "item"))


def normalized(rows: DataFrame, module: str, payload: str = "payload") -> DataFrame:
    """items() with the fields of a module in place of the item, each a variant of whatever kind the vendor wrote.

    A module that isn't known leaves the item as it is. What isn't an object has null in each field.
    """
    found = items(rows, payload)
    fields = MODULES.get(module)
    if fields is None:
        return found
    named = [F.coalesce(*[member(F.col("item"), k) for k in keys]).alias(name) for name, keys in fields.items()]
    return found.select(*[c for c in found.columns if c != "item"], *named)


def envelopes(rows: DataFrame, payload: str = "payload") -> DataFrame:
    """rows -> the other columns, status_code (a whole number), cost_usd (of all tasks) and row_count, one row for each."""
    v = F.try_parse_json(payload)
    cost = F.transform(_list(v, "$.tasks"), lambda t: F.coalesce(_number(t, "$.cost", "BIGINT|DECIMAL|DOUBLE|FLOAT", "double"), F.lit(0.0)))
    total = F.coalesce(F.aggregate(cost, F.lit(0.0), lambda s, x: s + x), F.lit(0.0))
    others = [c for c in rows.columns if c != payload]
    return rows.select(*others, _number(v, "$.status_code", "BIGINT", "long").alias("status_code"), total.alias("cost_usd"), F.size(_items(v)).alias("row_count"))


def written(df: DataFrame) -> DataFrame:
    """df with its variants as JSON texts."""
    return df.select(*[F.to_json(f.name).alias(f.name) if f.dataType.typeName() == "variant" else F.col(f.name) for f in df.schema])


def key_union(rows: DataFrame, order: str, json: str = "json") -> DataFrame:
    """rows(order, json objects) -> (position, key): all keys of the objects, in the order in which they are first seen.

    First seen: in the row with the smallest order (null last), and there at the first place. What isn't an object has
    no keys. Each task keeps one row a key; the keys themselves, which name columns, are put in order in one.
    """
    keys = rows.select(F.col(order).alias("o"), F.posexplode(F.json_object_keys(json)).alias("p", "key"))
    first = keys.groupBy("key").agg(F.min(F.struct(F.col("o").isNull().alias("n"), "o", "p")).alias("at"))
    ordered = first.agg(F.array_sort(F.collect_list(F.struct("at", "key"))).alias("all"))
    return ordered.select(F.posexplode("all").alias("position", "x")).select("position", F.col("x.key").alias("key"))


def without_nulls(json: Column) -> Column:
    """A JSON text without the members of its objects that are null, at any depth; nulls in arrays stay.

    Each text in it is taken whole, so what looks like a member within a text is left alone. Escapes are set aside
    first, after which a text ends at the next quote: no pattern here repeats a group, whatever the length. Null stays.
    """
    out = F.replace(F.replace(json, F.lit("\\\\"), F.lit("\u0001")), F.lit('\\"'), F.lit("\u0002"))
    out = F.regexp_replace(out, r'"[^"]*+"\s*+:\s*+null\b\s*+,?+\s*+|("[^"]*+")', "$1")
    out = F.regexp_replace(out, r'("[^"]*+")|,\s*+(?=\})', "$1")
    return F.replace(F.replace(out, F.lit("\u0002"), F.lit('\\"')), F.lit("\u0001"), F.lit("\\\\"))
