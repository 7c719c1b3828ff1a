"""Commerce profiles: JSON of any shape judged member by member, with an issue for each that is missing or of another kind."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Capabilities that are known, with what each is for.
CAPABILITIES = {
    "dev.ucp.shopping.checkout": "Initiate checkout, return totals + payment intent",
    "dev.ucp.shopping.fulfillment": "Quote shipping options + delivery windows",
    "dev.ucp.shopping.discount": "Apply promo codes / loyalty discounts",
    "dev.ucp.shopping.cart": "Add / remove / update items in agent-managed carts",
    "dev.ucp.shopping.catalog": "Search / list products via agent queries",
    "dev.ucp.shopping.order": "Order status, lookup, history",
    "dev.ucp.shopping.returns": "Return initiation + status",
}
UNKNOWN = "(unrecognised capability id)"


def _at(v: Column, key: str) -> Column:
    """What stands under a key, JSON's null as a variant of its own; null if the key is missing or v is no object."""
    return F.try_variant_get(v, f"$.{key}", "variant")


def _is(v: Column, kind: str) -> Column:
    """Whether a variant is an OBJECT, an ARRAY or a STRING; false of null."""
    return F.coalesce(F.schema_of_variant(v).startswith(kind), F.lit(False))


def _text(v: Column) -> Column:
    """A JSON text; null for anything else."""
    return F.when(_is(v, "STRING"), v.cast("string"))


def _issues(*tests: tuple[Column, Column | str]) -> Column:
    return F.array_compact(F.array(*[F.when(test, name if isinstance(name, Column) else F.lit(name)) for test, name in tests]))


def parsed(payloads: DataFrame, payload: str = "payload") -> DataFrame:
    """payloads with a column of JSON text -> its other columns, valid_json, version, merchant_name, merchant_id, capabilities,
    issues and unknown_capabilities, a row for each.

    capabilities: an array of (idx, id, version, endpoint, issues), a member for each object of the profile's list; what they hold
    is text, other JSON as it is written. issues: of version, merchant and list in this order. A member that is JSON's null is
    there, but of another kind. Null and what is no JSON (keys that stand twice in an object included) are not valid.
    """
    others = [F.col(f"`{c}`") for c in payloads.columns if c != payload]
    held = payloads.select(F.struct(*others).alias("row"), F.try_parse_json(payload).alias("v"))
    v = F.col("v")
    held = held.select("row", "v", _is(v, "OBJECT").alias("ok"), *[_at(v, k).alias(k) for k in ("version", "merchant", "capabilities")])
    is_shop, is_list = _is(F.col("merchant"), "OBJECT"), _is(F.col("capabilities"), "ARRAY")
    listed = F.when(is_list, F.try_variant_get("capabilities", F.lit("$"), "array<variant>")).otherwise(F.array().cast("array<variant>"))
    held = held.withColumn("list", F.transform(listed, lambda x, i: F.struct(i.alias("idx"), x.alias("x"), _is(x, "OBJECT").alias("ok"))))

    def capability(m: Column) -> Column:
        x = m["x"]
        name = _text(_at(x, "id"))
        issues = _issues((F.coalesce(name, F.lit("")) == "", "missing-id"), (_at(x, "version").isNull(), "missing-version"), (_at(x, "endpoint").isNull(), "missing-endpoint"))
        return F.struct(m["idx"].alias("idx"), *[F.try_variant_get(x, F.lit(f"$.{k}"), "string").alias(k) for k in ("id", "version", "endpoint")], issues.alias("issues"), name.alias("name"))

    made = F.transform(F.filter("list", lambda m: m["ok"]), capability)
    name = _text(_at(F.col("merchant"), "name"))
    whole = _issues(
        (v.isNull(), "invalid-json"),
        (v.isNotNull() & ~F.col("ok"), "profile-not-object"),
        (F.col("ok") & F.col("version").isNull(), "missing-version"),
        (F.col("version").isNotNull() & ~_is(F.col("version"), "STRING"), "version-not-string"),
        (F.col("ok") & F.col("merchant").isNull(), "missing-merchant"),
        (is_shop & (F.coalesce(name, F.lit("")) == ""), "merchant-name-empty"),
        (F.col("merchant").isNotNull() & ~is_shop, "merchant-not-object"),
        (F.col("ok") & F.col("capabilities").isNull(), "missing-capabilities"),
        (F.col("capabilities").isNotNull() & ~is_list, "capabilities-not-array"),
    )
    members = F.transform(F.filter("list", lambda m: ~m["ok"]), lambda m: F.concat(F.lit("capability-"), m["idx"].cast("string"), F.lit("-not-object")))
    shop = [F.when(is_shop, F.try_variant_get("merchant", F.lit(f"$.{k}"), "string")).alias(f"merchant_{k}") for k in ("name", "id")]
    out = held.select("row", v.isNotNull().alias("valid_json"), _text(F.col("version")).alias("version"), *shop, made.alias("made"), F.concat(whole, members).alias("issues"))
    names = F.filter(F.transform("made", lambda m: m["name"]), lambda n: n.isNotNull() & (n != "") & ~n.isin(*CAPABILITIES))
    plain = F.transform("made", lambda m: m.dropFields("name"))
    return out.select("row.*", "valid_json", "version", "merchant_name", "merchant_id", plain.alias("capabilities"), "issues", names.alias("unknown_capabilities"))


def summary(status: Column, capabilities: Column, issues: Column) -> Column:
    """What a fetch came to, by its status (null: it failed) and what was parsed."""
    found = F.concat(F.lit("profile-found: "), F.size(capabilities).cast("string"), F.lit(" capabilities, "), F.size(issues).cast("string"), F.lit(" structural issues"))
    return F.when(status.isNull(), "fetch-failed").when(status == 404, "no-ucp-profile (forward-looking opportunity)").when(status >= 400, F.concat(F.lit("http-"), status.cast("string"), F.lit(" on discovery"))).otherwise(found)


def capabilities(profiles: DataFrame) -> DataFrame:
    """parsed() -> one row for each capability instead of the list, with what it is for; unknown ids have UNKNOWN."""
    table = F.create_map(*[F.lit(x) for pair in CAPABILITIES.items() for x in pair])
    others = [c for c in profiles.columns if c not in ("valid_json", "version", "merchant_name", "merchant_id", "capabilities", "issues", "unknown_capabilities")]
    rows = profiles.select(*others, F.explode("capabilities").alias("c"))
    purpose = F.coalesce(F.when(F.col("c.id").isNotNull(), table[F.col("c.id")]), F.lit(UNKNOWN))
    return rows.select(*others, "c.idx", "c.id", "c.version", "c.endpoint", purpose.alias("purpose"), "c.issues")
