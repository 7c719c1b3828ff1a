"""Validators as tables of rules: structured data, offers, locale links, images and backlink reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sightline.functions import text as tx
from sightline.functions import urls as ux

# Required and recommended properties by type.
ARTICLE = (("headline",), ("author", "datePublished", "dateModified", "image", "publisher"))
REQUIREMENTS = {
    "Article": ARTICLE,
    "NewsArticle": ARTICLE,
    "BlogPosting": ARTICLE,
    "Product": (("name",), ("image", "description", "offers", "brand", "aggregateRating", "review")),
    "Organization": (("name",), ("url", "logo", "sameAs", "contactPoint")),
    "LocalBusiness": (("name", "address"), ("telephone", "openingHours", "geo", "priceRange", "url", "image")),
    "Person": (("name",), ("url", "sameAs", "jobTitle", "knowsAbout", "image")),
    "FAQPage": (("mainEntity",), ()),
    "BreadcrumbList": (("itemListElement",), ()),
    "Event": (("name", "startDate", "location"), ("endDate", "offers", "performer", "image")),
    "Recipe": (("name",), ("image", "recipeIngredient", "recipeInstructions", "author", "nutrition")),
    "VideoObject": (("name", "thumbnailUrl", "uploadDate"), ("description", "duration", "contentUrl", "embedUrl")),
    "SoftwareApplication": (("name",), ("applicationCategory", "operatingSystem", "offers", "aggregateRating")),
    "WebSite": (("name", "url"), ("potentialAction",)),
    "DiscussionForumPosting": (("headline", "author", "datePublished"), ("url", "text", "interactionStatistic")),
    "ProfilePage": (("mainEntity",), ("url", "dateCreated")),
}
AVAILABILITY = ("InStock", "OutOfStock", "PreOrder", "BackOrder", "Discontinued", "InStoreOnly", "LimitedAvailability", "OnlineOnly", "SoldOut", "PreSale")
IDENTIFIERS = ("gtin", "gtin8", "gtin12", "gtin13", "gtin14", "mpn", "sku", "isbn")


def jsonld_blocks(pages: DataFrame) -> DataFrame:
    """pages(url, html) -> (url, pos, json): each object of its JSON-LD scripts, arrays and @graph taken apart.

    Scripts that aren't valid JSON are left out.
    """
    script = r"""(?is)<script[^>]*type=["']application/ld\+json["'][^>]*>(.*?)</script\s*>"""
    raw = pages.select("url", F.posexplode(F.regexp_extract_all(tx.text_or_empty(F.col("html")), F.lit(script), F.lit(1))).alias("s", "t"))
    body = F.try_parse_json(F.trim("t"))
    graph = F.try_variant_get(body, '$["@graph"]', "array<variant>")
    parts = F.coalesce(graph, F.try_variant_get(body, "$", "array<variant>"), F.array(body))
    rows = raw.where(F.try_parse_json(F.trim("t")).isNotNull()).select("url", "s", F.posexplode(parts).alias("p", "v"))
    order = Window.partitionBy("url").orderBy("s", "p")
    return rows.select("url", (F.row_number().over(order) - 1).alias("pos"), F.to_json("v").alias("json"))


def block_types(json: Column) -> Column:
    """Short names of a block's @type, a text or an array of texts."""
    one = F.get_json_object(json, "$['@type']")
    many = F.when(one.startswith("["), F.from_json(one, "array<string>")).when(one.isNotNull(), F.array(one))
    return F.transform(F.coalesce(many, F.array().cast("array<string>")), lambda t: F.element_at(F.split(t, "/"), -1))


def jsonld_issues(blocks: DataFrame) -> DataFrame:
    """blocks(url, pos, json) -> (url, pos, type, severity, property).

    Missing @context and @type and required properties are errors, recommended ones warnings. Types without an entry
    have no requirements.
    """
    spark = blocks.sparkSession
    table = [(t, p, s) for t, (need, nice) in REQUIREMENTS.items() for s, ps in (("error", need), ("warning", nice)) for p in ps]
    wanted = spark.createDataFrame(table, "type string, property string, severity string")
    made = blocks.select("url", "pos", block_types(F.col("json")).alias("types"), F.coalesce(F.json_object_keys("json"), F.array().cast("array<string>")).alias("keys"))
    plain = F.array(F.when(~F.array_contains("keys", "@context") & (F.col("pos") == 0), F.lit("@context")), F.when(F.size("types") == 0, F.lit("@type")))
    bare = made.select("url", "pos", F.lit(None).cast("string").alias("type"), F.lit("error").alias("severity"), F.explode(F.array_compact(plain)).alias("property"))
    typed = made.select("url", "pos", "keys", F.explode(F.array_distinct("types")).alias("type")).join(F.broadcast(wanted), "type")
    return bare.unionByName(typed.where(~F.array_contains("keys", F.col("property"))).select("url", "pos", "type", "severity", "property"))


def merchant_issues(blocks: DataFrame) -> DataFrame:
    """blocks(url, pos, json) -> (url, path, severity, issue) of products and their offers."""
    products = blocks.where(F.exists(block_types(F.col("json")), lambda t: t.isin("Product", "ProductGroup"))).select("url", "pos", "json", F.json_object_keys("json").alias("keys"))
    has = lambda *names: F.arrays_overlap("keys", F.array(*[F.lit(n) for n in names]))
    issue = lambda test, severity, name: F.when(test, F.struct(F.lit(severity).alias("severity"), F.lit(name).alias("issue")))
    own = F.array(issue(~has("name"), "error", "name"), issue(~has("image"), "error", "image"), issue(~has(*IDENTIFIERS), "error", "identifier"), issue(~has("offers"), "error", "offers"), issue(~has("brand"), "warning", "brand"), issue(~has("description"), "warning", "description"), issue(~has("aggregateRating", "review"), "warning", "rating"))
    first = products.select("url", F.concat(F.lit("product "), F.col("pos")).alias("path"), F.inline(F.array_compact(own)))
    body = F.get_json_object("json", "$.offers")
    each = F.when(body.startswith("["), F.transform(F.from_json(body, "array<variant>"), lambda v: F.to_json(v))).when(body.isNotNull(), F.array(body))
    offers = products.select("url", "pos", F.posexplode(each).alias("n", "o")).select("url", "pos", "n", "o", F.coalesce(F.json_object_keys("o"), F.array().cast("array<string>")).alias("keys"))
    stock = F.element_at(F.split(F.get_json_object("o", "$.availability"), "/"), -1)
    tests = F.array(
        issue(~has("price", "lowPrice", "priceSpecification"), "error", "price"),
        issue(~has("priceCurrency") & F.get_json_object("o", "$.priceSpecification.priceCurrency").isNull(), "error", "priceCurrency"),
        issue(stock.isNull(), "error", "availability"),
        issue(~stock.isin(*AVAILABILITY), "error", "availability value"),
        *[issue(~has(p), "warning", p) for p in ("priceValidUntil", "shippingDetails", "hasMerchantReturnPolicy")],
    )
    second = offers.select("url", F.concat(F.lit("product "), F.col("pos"), F.lit(" offer "), F.col("n")).alias("path"), F.inline(F.array_compact(tests)))
    return first.unionByName(second)


def hreflang_issues(entries: DataFrame) -> DataFrame:
    """entries(page_url, lang, href) -> (page_url, lang, severity, issue).

    lang null for issues of the page: no link to itself (host compared without www.) and no x-default.
    """
    lang, low = F.trim(F.coalesce("lang", F.lit(""))), F.lower(F.trim(F.coalesce("lang", F.lit(""))))
    primary, last = F.element_at(F.split(lang, "-"), 1), F.element_at(F.split(lang, "-"), -1)
    more, plain = F.size(F.split(lang, "-")) > 1, low != "x-default"
    loose = lambda u: F.concat(ux.bare_host(u), F.regexp_replace(ux.part(u, 3), "/+$", ""))
    issue = lambda test, severity, name: F.when(test, F.struct(F.lit(severity).alias("severity"), F.lit(name).alias("issue")))
    tests = F.array(
        issue(plain & F.contains(lang, F.lit("_")), "error", "underscore"),
        issue(plain & ~F.length(primary).isin(2, 3), "error", "language subtag"),
        issue(plain & primary.rlike("[A-Z]"), "warning", "language case"),
        issue(plain & more & (F.length(last) == 2) & last.rlike("[a-z]"), "warning", "region case"),
        issue(plain & more & F.upper(last).isin("UK", "EU", "UN"), "error", "not a region"),
        issue(F.coalesce("href", F.lit("")) == "", "error", "no href"),
        issue((F.coalesce("href", F.lit("")) != "") & ~F.col("href").rlike(r"^(?i)https?://"), "error", "relative href"),
    )
    own = entries.select("page_url", lang.alias("lang"), F.inline(F.array_compact(tests)))
    twice = entries.groupBy("page_url", low.alias("lang")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("page_url", "lang", F.lit("error").alias("severity"), F.lit("duplicate").alias("issue"))
    page = entries.groupBy("page_url").agg(F.bool_or(F.coalesce(loose(F.col("href")) == loose(F.col("page_url")), F.lit(False))).alias("self"), F.bool_or(low == "x-default").alias("default"))
    whole = F.array(issue(~F.col("self"), "error", "no self-reference"), issue(~F.col("default"), "warning", "no x-default"))
    return own.unionByName(twice).unionByName(page.select("page_url", F.lit(None).cast("string").alias("lang"), F.inline(F.array_compact(whole))))


def image_scores(images: DataFrame) -> DataFrame:
    """images(page_url, pos, src, alt, width, height, lazy_method) -> a row for each page with counts and a score.

    A null alt is missing, an empty one decorative. 100 less: up to 35 for missing alts, up to 25 for missing sizes
    (whole percents), 15 each for a lazy first image and no modern format, 10 for more than five images without lazy ones.
    """
    lazy = F.coalesce("lazy_method", F.lit("none")) != "none"
    modern = F.lower(F.coalesce("src", F.lit(""))).rlike(r"\.(webp|avif)")
    per = images.groupBy("page_url").agg(
        F.count(F.lit(1)).alias("images"), F.count_if(F.col("alt").isNull()).alias("missing_alt"), F.count_if(F.trim("alt") == "").alias("empty_alt"),
        F.count_if(F.col("width").isNull() | F.col("height").isNull()).alias("missing_size"), F.count_if(lazy).alias("lazy"), F.count_if(modern).alias("modern"), F.min_by(lazy, "pos").alias("first_lazy"),
    )
    score = F.expr("greatest(0, 100 - least(35, missing_alt * 100 div images) - least(25, missing_size * 100 div images) - 15 * int(first_lazy) - 15 * int(modern = 0) - 10 * int(lazy = 0 and images > 5))")
    return per.withColumn("score", score)


def backlink_report(rows: DataFrame) -> DataFrame:
    """rows(row, source, target, link_found, verified, followed, rel) -> (row, severity, issue)."""
    issue = lambda test, severity, name: F.when(test, F.struct(F.lit(severity).alias("severity"), F.lit(name).alias("issue")))
    twice = F.count(F.lit(1)).over(Window.partitionBy("source")) > 1
    web = lambda c: F.coalesce(F.col(c).rlike(r"^(?i)https?://"), F.lit(False))
    tests = F.array(
        issue(~web("source"), "error", "source"),
        issue(~web("target"), "error", "target"),
        issue(F.col("verified").isNull(), "warning", "verified"),
        issue(F.col("verified") & ~F.coalesce("link_found", F.lit(False)), "error", "verified without a link"),
        issue(F.col("followed") & F.arrays_overlap(F.coalesce("rel", F.array().cast("array<string>")), F.array(F.lit("nofollow"), F.lit("ugc"), F.lit("sponsored"))), "error", "followed and nofollow"),
        issue(twice & F.col("source").isNotNull(), "warning", "duplicate source"),
    )
    return rows.select("row", F.array_compact(tests).alias("i")).select("row", F.inline("i"))


def link_status(links: DataFrame, target: str) -> DataFrame:
    """links(page_url, href, rel array) -> page_url, found, followed, sponsored, ugc of links to a host, www. or not.

    Not followed if any of the links has nofollow.
    """
    hit = ux.bare_host(F.col("href")) == target
    rel = lambda name: F.bool_or(hit & F.array_contains(F.coalesce("rel", F.array().cast("array<string>")), name))
    per = links.groupBy("page_url").agg(F.count_if(hit).alias("found"), rel("nofollow").alias("nofollow"), rel("sponsored").alias("sponsored"), rel("ugc").alias("ugc"))
    return per.select("page_url", "found", ((F.col("found") > 0) & ~F.coalesce("nofollow", F.lit(False))).alias("followed"), F.coalesce("sponsored", F.lit(False)).alias("sponsored"), F.coalesce("ugc", F.lit(False)).alias("ugc"))
