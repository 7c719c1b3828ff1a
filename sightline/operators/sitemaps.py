"""Sitemap discovery and the crawl of many sites at once, over tables of what was fetched.

A crawl reads files first come, first served: those that robots.txt declares, the common paths, then what indexes list. Each site
has a budget of files and of pages. Places in that order are numbers, so that each level of all sites is one job.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sightline.functions import text as tx
from sightline.functions import urls as ux
from sightline.sources.shared import stored

# Paths that are tried on every site, declared files that are looked at, and lines of a text sitemap.
COMMON_PATHS = ("/sitemap.xml", "/sitemap_index.xml", "/sitemap-index.xml", "/wp-sitemap.xml")
MAX_DECLARED, MAX_LINES, MAX_FILES = 16, 50_000, 65
#: Roots of XML that are sitemaps.
ROOTS = ("urlset", "sitemapindex", "rss", "feed")

_LINES = r"\r\n|\r|\n"
_BLANKS = r"^\s+|\s+$"
_COMMENT = r"(?s)<!--.*?-->"
_ROOT = r"<(?:[^\s<>/:!?]+:)?([^\s<>/:!?]+)"
_LOC = r"(?i)<(?:[^\s<>/:!?]+:)?loc(?:\s(?:[^>]*[^/>])?)?>([^<]*)"
#: One level's places are below this; a file's place times it leaves room for the positions within the file.
_WIDE = 1 << 32


def _trimmed(c: Column) -> Column:
    return F.regexp_replace(c, _BLANKS, "")


def declared(robots: Column) -> Column:
    """The values of a robots.txt's sitemap lines in their order, each once; none of a null."""
    lines = F.transform(F.split(F.coalesce(robots, F.lit("")), _LINES), _trimmed)
    values = F.transform(F.filter(lines, lambda x: x.rlike("(?i)^sitemap:")), lambda x: _trimmed(F.substring(x, F.lit(9), F.length(x))))
    return F.array_distinct(F.filter(values, lambda x: x != ""))


def _root(text: Column) -> Column:
    return F.lower(F.regexp_extract(F.regexp_replace(text, _COMMENT, ""), _ROOT, 1))


def kind(text: Column, content_type: Column, url: Column) -> Column:
    """(kind, error) of a file, one of them null: an XML root that is known, or lines of http URLs where the file says it is text."""
    is_text = F.coalesce(F.lower(content_type).contains("text/plain"), F.lit(False)) | F.lower(url).endswith(".txt")

    def of_text(body: Column) -> Column:
        lines = F.filter(F.transform(F.split(body, _LINES), _trimmed), lambda x: x != "")
        all_urls = lambda x: F.forall(x, lambda y: y.rlike(r"(?i)^https?://[^/?#@\s]+(?:[/?#].*)?$"))
        return (
            F.when(~is_text, "response is not a supported sitemap format")
            .otherwise(tx.let(lines, lambda x: F.when(F.size(x) > MAX_LINES, "text sitemap exceeds the 50,000 URL protocol limit").when(~all_urls(x), "invalid text sitemap")))
        )

    def judged(body: Column) -> Column:
        is_xml, names = body.startswith("<"), F.lit(None).cast("string")
        early = F.when(body == "", "empty response").when(F.upper(F.substring(body, 1, 4096)).contains("<!DOCTYPE"), "DOCTYPE is not allowed in sitemap XML")
        of_root = lambda r: F.struct(F.when(r.isin(*ROOTS), r).alias("kind"), F.when(r == "", "invalid XML").when(~r.isin(*ROOTS), "unsupported XML root").alias("error"))
        of_lines = lambda e: F.struct(F.when(e.isNull(), F.lit("text")).alias("kind"), e.alias("error"))
        late = F.when(is_xml, tx.let(_root(body), of_root)).otherwise(tx.let(of_text(body), of_lines))
        return tx.let(early, lambda e: F.when(e.isNotNull(), F.struct(names.alias("kind"), e.alias("error"))).otherwise(late))

    # what is used more than once is bound to a variable: as an expression it would be worked out again each time
    return tx.let(F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+", ""), judged)


def _shown(url: Column) -> Column:
    root = F.when(ux.part(url, 3) == "", F.lit("/")).otherwise("")
    return F.when(url.rlike(ux.PARTS), F.concat(ux.display(url), root)).otherwise(url)


def _redacted(url: Column) -> Column:
    """Whether a URL as shown lacks a user, query or fragment; true of what is no URL."""
    return ~url.rlike(ux.PARTS) | ux.part(url, 2).contains("@") | (ux.part(url, 4) != "") | (ux.part(url, 5) != "")


def candidates(robots: DataFrame, files: DataFrame) -> DataFrame:
    """robots(site, text), files(url, status, content_type, text) -> one row for each file that may be a site's sitemap.

    site is an origin (https://a.example) and one row. Columns: site, pos (from 0), url as it may be shown, query_redacted,
    source (robots.txt or common_path), cross_host (a declared file of another host), n_declared (before the first sixteen
    were taken), status, kind, valid, error. What files lacks was not fetched. The join is by whole addresses.
    """
    held = robots.select("site", declared(F.col("text")).alias("all")).withColumn("first", F.slice("all", 1, MAX_DECLARED))
    tried = F.concat("first", F.array(*[F.concat("site", F.lit(p)) for p in COMMON_PATHS]))
    once = F.filter(tried, lambda x, i: (i == 0) | (x != F.get(tried, i - 1)))
    rows = held.select("site", "first", F.size("all").alias("n_declared"), F.posexplode(once).alias("pos", "at"))
    own = F.array_contains("first", F.col("at"))
    rows = rows.select("site", "pos", "at", "n_declared", own.alias("own"), (own & (ux.host(F.col("at")) != ux.host(F.col("site")))).alias("cross_host"))
    good = F.col("status").between(200, 299)
    judged = F.when(good, kind(F.col("text"), F.col("content_type"), F.col("url")))
    read = files.where("url is not null").select(F.col("url").alias("at"), "status", judged.alias("k")).groupBy("at").agg(F.min(F.struct("status", "k")).alias("f"))
    out = rows.join(read, "at", "left")
    error = F.when(F.col("f").isNull(), "not fetched").when(F.col("f.k").isNull(), F.concat(F.lit("HTTP "), F.coalesce(F.col("f.status").cast("string"), F.lit("?")))).otherwise(F.col("f.k.error"))
    source = F.when(F.col("own"), "robots.txt").otherwise("common_path")
    return out.select("site", "pos", _shown(F.col("at")).alias("url"), _redacted(F.col("at")).alias("query_redacted"), source.alias("source"), "cross_host", "n_declared", F.col("f.status").alias("status"), F.col("f.k.kind").alias("kind"), F.col("f.k.kind").isNotNull().alias("valid"), error.alias("error"))


def _character(code: Column) -> Column:
    """The character of a reference's number (decimal, or hexadecimal after an x)."""
    digits = F.when(code.rlike("(?i)^x"), F.substring(code, F.lit(2), F.length(code))).otherwise(F.conv(code, 10, 16))
    return F.decode(F.unhex(F.lpad(digits, 8, "0")), "UTF-32")


def unescaped(text: Column) -> Column:
    """Text of XML with its five entities and numbers read; null if it holds any other reference."""
    known = r"&(?!(?:amp|lt|gt|quot|apos|#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6});)"
    pieces = F.split(text, "&#")
    # most texts have no reference, and most others no number
    rest = F.transform(F.slice(pieces, 2, 1 << 30), lambda x: F.concat(_character(F.substring_index(x, ";", 1)), F.substring(x, F.instr(x, ";") + 1, F.length(x))))
    out = F.when(~F.contains(text, F.lit("&#")), text).otherwise(F.concat(F.get(pieces, F.lit(0)), F.array_join(rest, "")))
    for entity, c in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(c))
    return F.when(~F.contains(text, F.lit("&")), text).when(~text.rlike(known), out)


def locations(text: Column) -> Column:
    """Addresses in the loc elements of a file in their order, of any prefix; empty ones and CDATA don't count."""
    found = F.regexp_extract_all(F.regexp_replace(F.coalesce(text, F.lit("")), _COMMENT, ""), F.lit(_LOC), F.lit(1))
    return F.filter(F.transform(F.transform(found, _trimmed), unescaped), lambda x: x.isNotNull() & (x != ""))


def _first(rows: DataFrame, most: int) -> DataFrame:
    """rows(site, url, o), any number of them alike -> (site, url, place from 1): the first `most` of each site by o.

    Repeats are merged before the shuffle, and no task sends more than `most` rows of a site to the one that ranks them.
    """
    once = rows.groupBy("site", "url").agg(F.min("o").alias("o"))
    place = F.row_number().over(Window.partitionBy("site").orderBy("o"))
    return once.withColumn("place", place).where(F.col("place") <= most).drop("o")


def visits(files: DataFrame, robots: DataFrame, most: int = MAX_FILES) -> DataFrame:
    """files(url, is_index, locs) of `_read`, robots(site, text) -> (site, url, place): the files that a crawl asks for, in order.

    A file that wasn't fetched counts, one that stands in the queue again doesn't. Each level of all sites is one job, written
    to the shared folder; there are as many levels as indexes are nested, `most` at most.
    """
    queue = F.concat(declared(F.col("text")), F.array(*[F.concat("site", F.lit(p)) for p in COMMON_PATHS]))
    front = stored(_first(robots.select("site", F.posexplode(queue).alias("o", "url")), most), "visits")
    levels = [front]
    indexes = files.where("is_index").select("url", "locs")
    for _ in range(1, most):
        seen = reduce(DataFrame.unionByName, levels)
        listed = front.join(indexes, "url").select("site", F.col("place").cast("long").alias("p"), F.posexplode("locs").alias("pos", "url"))
        new = listed.select("site", "url", (F.col("p") * _WIDE + F.col("pos")).alias("o")).join(seen.select("site", "url"), ["site", "url"], "left_anti")
        used = seen.groupBy("site").agg(F.max("place").alias("used"))
        placed = _first(new, most).join(used, "site").select("site", "url", (F.col("place") + F.col("used")).alias("place"))
        front = stored(placed.where(F.col("place") <= most), "visits")
        if front.isEmpty():
            break
        levels.append(front)
    return reduce(DataFrame.unionByName, levels)


def _read(files: DataFrame) -> DataFrame:
    ok = files.where("status = 200 and url is not null").groupBy("url").agg(F.min("text").alias("text"))
    return ok.select("url", (_root(F.coalesce("text", F.lit(""))) == "sitemapindex").alias("is_index"), locations(F.col("text")).alias("locs"))


def pages(files: DataFrame, robots: DataFrame, max_pages: int, most: int = MAX_FILES) -> DataFrame:
    """files(url, status, text), robots(site, text) -> (site, pos from 0, url): the first pages of each site's sitemaps.

    Pages come in the order in which their files are read, each once, `max_pages` of a site (one at least). Only files with status
    200 are read; of rows with the same url the smallest text. XML that breaks off gives what its loc elements hold.
    """
    held = stored(_read(files), "sitemaps")
    asked = visits(held, robots, most)
    leaves = held.where("not is_index").select("url", "locs")
    listed = asked.join(leaves, "url").select("site", F.col("place").cast("long").alias("p"), F.posexplode("locs").alias("pos", "url"))
    rows = _first(listed.select("site", "url", (F.col("p") * _WIDE + F.col("pos")).alias("o")), max(1, max_pages))
    return rows.select("site", (F.col("place") - 1).alias("pos"), "url")
