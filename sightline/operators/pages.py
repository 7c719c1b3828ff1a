"""Page extraction with native expressions: markup removal, titles, links, section risk and the link graph.

The markup walk (nested blocks, attributes) is in operators/markup.py.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sightline.functions import text as tx
from sightline.functions import urls as ux

#: Elements whose content isn't prose, in the order in which they are removed.
NOT_PROSE = ("script", "style", "nav", "footer", "header", "noscript", "template")
#: Entities that are decoded in visible text.
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&copy;", "©"), ("&middot;", "·"), ("&ndash;", "–"), ("&mdash;", "—"), ("&hellip;", "…"), ("&amp;", "&"))
#: Where the tag of a link begins; its href in double, single or no quotes, up to the tag's end; and what ends its anchor.
#: Each is a single pass over characters: nothing here repeats a group, which would cost stack for each tag that follows.
LINK_START, LINK_END = r"(?i)<a(?=\s)", r"(?i)</?a(?=[\s>])"
LINK_TAG = r"""(?i)^\s(?:[^>]*?\s)?href\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))[^>]*>"""


def stripped(html: Column) -> Column:
    """html without comments and without elements that hold no prose, each replaced by a space."""
    out = F.regexp_replace(tx.text_or_empty(html), r"(?s)<!--.*?-->", " ")
    for tag in NOT_PROSE:
        out = F.regexp_replace(out, rf"(?is)<{tag}\b[^>]*>.*?</{tag}\s*>", " ")
        out = F.regexp_replace(out, rf"(?i)<{tag}\b[^>]*>", " ")
    return out


def visible(html: Column) -> Column:
    """Text between the tags, entities decoded and white space collapsed; the title counts."""
    out = F.regexp_replace(stripped(html), r"<[^>]*>", " ")
    for a, b in ENTITIES:
        out = F.replace(out, F.lit(a), F.lit(b))
    return tx.collapsed(out)


def element_text(html: Column, tag: str) -> Column:
    """Text of the first element of a kind; null if there is none."""
    found = F.regexp_extract(html, rf"(?is)<{tag}(?:\s[^>]*)?>(.*?)</{tag}\s*>", 1)
    text = tx.collapsed(F.regexp_replace(found, r"<[^>]*>", " "))
    return F.when(html.rlike(rf"(?i)<{tag}[\s>]"), text)


def link_tags(html: Column) -> Column:
    """What follows each "<a " that has an href, up to the next one: the rest of the tag, the anchor and what comes after."""
    return F.filter(F.slice(F.split(tx.text_or_empty(html), LINK_START), 2, 1 << 30), lambda t: t.rlike(LINK_TAG))


def outline(pages: DataFrame) -> DataFrame:
    """pages(page_id, url, html) -> title, h1, words, links, paragraphs, scripts, is_spa: one row for each page.

    is_spa: under 100 words and three scripts or more. Null html: null title and h1, counts 0.
    """
    html = F.col("html")
    count = lambda pattern: tx.matches(html, pattern)
    words = tx.word_count(visible(html))
    made = pages.select("page_id", "url", element_text(html, "title").alias("title"), element_text(html, "h1").alias("h1"), words.alias("words"), F.size(link_tags(html)).alias("links"), count(r"(?i)<p[\s>]").alias("paragraphs"), count(r"(?i)<script").alias("scripts"))
    return made.withColumn("is_spa", (F.col("words") < 100) & (F.col("scripts") >= 3))


def without_dots(path: Column) -> Column:
    """path with its . and .. segments worked out; what would go over the root stays there."""
    step = lambda done, x: F.when(x == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(1)))).when(x == ".", done).otherwise(F.concat(done, F.array(x)))
    parts = F.split(path, "/")
    ended = F.when(path.rlike(r"/\.\.?$"), F.concat(parts, F.array(F.lit("")))).otherwise(parts)
    return F.when(path.rlike(r"(?:^|/)\.\.?(?:/|$)"), F.array_join(F.aggregate(ended, F.array().cast("array<string>"), step), "/")).otherwise(path)


def resolved(href: Column, url: Column) -> Column:
    """The address that href means on the page at url."""
    scheme, path = F.lower(ux.part(url, 1)), F.regexp_extract(href, r"^([^?#]*)", 1)
    base, base_path = F.concat(scheme, F.lit("://"), F.lower(ux.part(url, 2))), ux.part(url, 3)
    own = F.when(base_path == "", F.lit("/")).otherwise(base_path)
    near = F.concat(F.regexp_extract(own, r"^(.*/)", 1), path)
    rest = F.regexp_extract(href, r"^[^?#]*(.*)$", 1)
    # a fragment alone stays on the page's query
    nothing = F.concat(base, own, F.when(rest.startswith("?"), F.lit("")).otherwise(ux.part(url, 4)), rest)
    joined = F.concat(base, without_dots(F.when(path.startswith("/"), path).otherwise(near)), rest)
    return F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), href).when(href.startswith("//"), F.concat(scheme, F.lit(":"), href)).when(path == "", nothing).otherwise(joined)


def links(pages: DataFrame) -> DataFrame:
    """pages(page_id, url, html) -> (page_id, pos, href, anchor, target, is_internal), one row for each link.

    Empty, fragment-only and javascript: links are left out; relative ones are resolved against the page's address;
    anchors are the text within the link, markup left out, of 100 characters at most. Null html has no links.
    """
    rows = pages.select("page_id", "url", F.posexplode(link_tags(F.col("html"))).alias("pos", "l"))
    href = F.concat(*[F.regexp_extract("l", LINK_TAG, n) for n in (1, 2, 3)])
    body = F.regexp_replace(F.split(F.regexp_replace("l", LINK_TAG, ""), LINK_END, 2)[0], r"(?i)</?a?$", "")
    anchor = tx.collapsed(F.regexp_replace(body, r"<[^>]*>", " "))
    rows = rows.select("page_id", "url", "pos", F.trim(href).alias("href"), F.substring(anchor, 1, 100).alias("anchor"))
    rows = rows.where("href <> '' and not startswith(href, '#') and not startswith(lower(href), 'javascript:')")
    rows = rows.withColumn("target", resolved(F.col("href"), F.col("url")))
    return rows.select("page_id", "pos", "href", "anchor", "target", (ux.host(F.col("target")) == ux.host(F.col("url"))).alias("is_internal"))


# Wording that marks paid, commercial and affiliate content.
THIRD_PARTY = r"(?i)(?:Partner\s+Content|Sponsored\s+Content|Sponsored\s+by|Brand\s+Studio|In\s+Partnership\s+With|Advertisement|Advertorial|Paid\s+Post|Promoted|Paid\s+Content)"
COMMERCE = r"(?i)(?:Buy\s+Now|Shop\s+Now|Add\s+to\s+Cart|Compare\s+Prices|Best\s+\w+\s+Deals?|Promo\s+Code|Coupon|Discount\s+Code|Affiliate\s+Disclosure)"
AFFILIATE = r"(?i)(?:tag=|aff_id=|affid=|partnerid=|ref_=|utm_source=|utm_campaign=)"


def section_risk(pages: DataFrame, third: str = THIRD_PARTY, commerce: str = COMMERCE, affiliate: str = AFFILIATE, bounded: bool = True) -> DataFrame:
    """pages(url, html) -> one row for each section: pages, hits per page of the three kinds, flags, risk, sample_urls.

    Flags: third party 1 a page, commerce 2, affiliate 3, and commercial drift where the rounded commerce rate is over
    twice the mean of the sections. Third party alone, or commerce with affiliate, is high risk; any other flag medium.
    sample_urls: the three smallest. bounded: the wording must stand as whole words.
    """
    kind = (lambda p: p[:4] + r"\b" + p[4:] + r"\b") if bounded else (lambda p: p)
    after = (lambda p: p[:4] + r"\b" + p[4:]) if bounded else (lambda p: p)
    hits = pages.select(ux.section(F.col("url")).alias("section"), "url", tx.matches(F.col("html"), kind(third)).alias("tp"), tx.matches(F.col("html"), kind(commerce)).alias("cm"), tx.matches(F.col("html"), after(affiliate)).alias("af"))
    first = F.row_number().over(Window.partitionBy("section").orderBy("url"))
    samples = hits.select("section", "url").distinct().withColumn("r", first).where("r <= 3").groupBy("section").agg(F.array_sort(F.collect_list("url")).alias("sample_urls"))
    rates = hits.groupBy("section").agg(F.count(F.lit(1)).alias("page_count"), *[F.avg(c).alias(c) for c in ("tp", "cm", "af")])
    # one row for each section: the window over all of them is small
    mean = F.avg("cm").over(Window.partitionBy(F.lit(1)))
    rated = rates.withColumn("mean", mean).withColumn("r_", tx.half_up(F.col("cm"), 2))
    tests = (("third-party-authorship-density", F.col("tp") >= 1), ("commercial-intent-skew", F.col("cm") >= 2), ("affiliate-density", F.col("af") >= 3), ("commercial-intent-drift", (F.col("mean") > 0) & (F.col("r_") > 2 * F.col("mean"))))
    flags = F.array_compact(F.array(*[F.when(t, F.lit(n)) for n, t in tests]))
    risk = F.when((F.col("tp") >= 1) | ((F.col("cm") >= 2) & (F.col("af") >= 3)), "high").when(F.size("flags") > 0, "medium").otherwise("low")
    out = rated.withColumn("flags", flags).withColumn("risk", risk)
    rounded = [tx.half_up(F.col(c), 2).alias(n) for c, n in (("tp", "third_party_per_page"), ("cm", "commerce_per_page"), ("af", "affiliate_per_page"))]
    return out.select("section", "page_count", *rounded, "flags", "risk").join(samples, "section")


def risk_summary(sections: DataFrame) -> DataFrame:
    """How many sections have each risk, and the worst risk of all."""
    level = F.expr("case risk when 'high' then 2 when 'medium' then 1 else 0 end")
    worst = F.element_at(F.array(F.lit("low"), F.lit("medium"), F.lit("high")), F.max(level) + 1)
    return sections.agg(*[F.count_if(F.col("risk") == r).alias(r) for r in ("high", "medium", "low")], worst.alias("overall"))


def in_degrees(edges: DataFrame, nodes: DataFrame, least: int = 3) -> DataFrame:
    """edges(src, dst), nodes(node) -> node, incoming (different sources but itself), is_orphan, well_linked."""
    degree = edges.where("src <> dst").select("src", "dst").distinct().groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("incoming"))
    return nodes.join(degree, "node", "left").select("node", F.coalesce("incoming", F.lit(0)).alias("incoming")).withColumns({"is_orphan": F.col("incoming") == 0, "well_linked": F.col("incoming") >= least})


def reach(edges: DataFrame, starts: DataFrame, clicks: int = 2) -> DataFrame:
    """starts(node) -> (node, depth): what can be reached in so many clicks at most, with the fewest clicks."""
    seen = starts.select("node", F.lit(0).alias("depth")).distinct()
    front = seen
    for depth in range(1, clicks + 1):
        step = front.join(edges, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct()
        front = step.join(seen, "node", "left_anti").withColumn("depth", F.lit(depth))
        seen = seen.unionByName(front)
    return seen
