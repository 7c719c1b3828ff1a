"""Crawler access, sitemaps and llms.txt files as tables of lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Crawlers of answer engines and training sets.
CRAWLERS = ("GPTBot", "OAI-SearchBot", "ChatGPT-User", "ClaudeBot", "anthropic-ai", "Claude-SearchBot", "PerplexityBot", "Perplexity-User", "CCBot", "Bytespider", "cohere-ai", "Google-Extended", "GoogleOther", "Applebot-Extended", "FacebookBot", "Amazonbot", "meta-externalagent", "MistralAI-User")


def lines(files: DataFrame) -> DataFrame:
    """files(site, text) -> (site, seq, line): trimmed, without comments; empty ones stay away."""
    rows = files.select("site", F.posexplode(F.split(F.coalesce("text", F.lit("")), r"\r\n|\r|\n")).alias("seq", "line"))
    return rows.select("site", "seq", F.trim(F.regexp_replace("line", "#.*$", "")).alias("line")).where("line <> ''")


def robots_rules(files: DataFrame) -> DataFrame:
    """files(site, text) -> (site, agent, seq, directive, path), a row for each rule and agent of its group.

    Agent lines that follow each other share the rules below them. A group number is the running count of agent lines
    that follow a rule line or nothing. Agents are lower-cased; rules before any agent are left out.
    """
    key, value = F.lower(F.trim(F.regexp_extract("line", "^([^:]*):", 1))), F.trim(F.regexp_extract("line", "^[^:]*:(.*)$", 1))
    rows = lines(files).where(F.contains("line", F.lit(":"))).select("site", "seq", key.alias("key"), value.alias("value")).where("key in ('user-agent', 'allow', 'disallow', 'crawl-delay')")
    order = Window.partitionBy("site").orderBy("seq")
    begins = ((F.col("key") == "user-agent") & (F.coalesce(F.lag("key").over(order), F.lit("")) != "user-agent")).cast("int")
    rows = rows.withColumn("begins", begins).withColumn("grp", F.sum("begins").over(order))
    agents = rows.where("key = 'user-agent'").select("site", "grp", F.lower("value").alias("agent")).distinct()
    rules = rows.where("key <> 'user-agent' and grp > 0").select("site", "grp", "seq", F.col("key").alias("directive"), F.col("value").alias("path"))
    return agents.join(rules, ["site", "grp"], "left").select("site", "agent", "seq", "directive", "path")


def crawler_access(rules: DataFrame, sites: DataFrame, crawlers: tuple[str, ...] = CRAWLERS) -> DataFrame:
    """rules (of robots_rules), sites(site, found boolean) -> (site, crawler, verdict) for each crawler.

    An exact agent decides, else the agent *: blocked by `disallow: /`, partially blocked by another path (which for *
    counts as allowed). A site without the file is NO_ROBOTS_TXT.
    """
    spark = rules.sparkSession
    table = spark.createDataFrame([(c, c.lower()) for c in crawlers], "crawler string, agent string")
    state = rules.groupBy("site", "agent").agg(F.bool_or(F.expr("directive = 'disallow' and path = '/'")).alias("full"), F.bool_or(F.expr("directive = 'disallow' and path <> ''")).alias("part"))
    state = state.select("site", "agent", F.coalesce("full", F.lit(False)).alias("full"), F.coalesce("part", F.lit(False)).alias("part"))
    every = sites.join(F.broadcast(table))  # a fixed list of crawlers for each site
    star = state.where("agent = '*'").select("site", F.col("full").alias("star"))
    both = every.join(state, ["site", "agent"], "left").join(star, "site", "left")
    verdict = F.expr("""case when not found then 'NO_ROBOTS_TXT' when full then 'BLOCKED' when part then 'PARTIALLY_BLOCKED' when not full then 'ALLOWED'
      when star then 'BLOCKED_BY_WILDCARD' when not star then 'ALLOWED_BY_DEFAULT' else 'NOT_MENTIONED' end""")
    return both.select("site", "crawler", verdict.alias("verdict"))


def sitemap_kind(files: DataFrame) -> DataFrame:
    """files(site, text) -> (site, kind): by the first 4096 characters; a document type declaration is refused."""
    head = F.substring(F.coalesce("text", F.lit("")), 1, 4096)
    kind = F.when(head.rlike("(?i)<!DOCTYPE"), "refused").when(head.rlike("(?i)<sitemapindex"), "index").when(head.rlike("(?i)<urlset"), "urlset").when(head.rlike("(?i)<rss"), "rss").when(head.rlike("(?i)<feed"), "feed").when(head.rlike(r"(?m)^\s*https?://"), "text").otherwise("unknown")
    return files.select("site", kind.alias("kind"))


def sitemap_urls(files: DataFrame) -> DataFrame:
    """files(site, text) of sitemaps -> (site, pos, loc, lastmod): lastmod null where the entry has none."""
    entry = r"(?is)<(?:url|sitemap)\b[^>]*>(.*?)</(?:url|sitemap)\s*>"
    rows = files.select("site", F.posexplode(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(entry), F.lit(1))).alias("pos", "e"))
    one = lambda tag: F.nullif(F.trim(F.regexp_extract("e", rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}\s*>", 1)), F.lit(""))
    return rows.select("site", "pos", F.replace(one("loc"), F.lit("&amp;"), F.lit("&")).alias("loc"), one("lastmod").alias("lastmod")).where("loc is not null")


def sitemap_crawl(edges: DataFrame, starts: DataFrame, files: int = 65) -> DataFrame:
    """edges(parent, child), starts(node) -> (node, depth), breadth first, until nothing is new or depth `files`.

    Each round is one join of the last frontier, written to the checkpoint folder so that plans stay short.
    """
    from sightline.sources.shared import stored

    seen = stored(starts.select("node", F.lit(0).alias("depth")).distinct(), "crawl")
    front = seen
    for depth in range(1, files):
        step = front.join(edges, F.col("node") == F.col("parent")).select(F.col("child").alias("node")).distinct()
        front = stored(step.join(seen, "node", "left_anti").withColumn("depth", F.lit(depth)), "crawl")
        if not front.limit(1).count():
            break
        seen = seen.unionByName(front)
    return seen


def sitemap_coverage(listed: DataFrame, crawled: DataFrame) -> DataFrame:
    """listed(url), crawled(url) -> (url, state): in both, only listed or only crawled."""
    a, b = listed.select("url").distinct().withColumn("l", F.lit(1)), crawled.select("url").distinct().withColumn("c", F.lit(1))
    return a.join(b, "url", "full").select("url", F.expr("case when l is null then 'only crawled' when c is null then 'only listed' else 'both' end").alias("state"))


def llms_report(files: DataFrame) -> DataFrame:
    """files(site, text) of llms.txt -> (site, exists, has_title, has_description, sections, links, format_valid, issues,
    suggestions). The title must stand in the first line, links in list items. A null text is a missing file: nothing
    is suggested for it."""
    t = F.trim(F.coalesce(F.col("text"), F.lit("")))
    lines = F.split(t, r"\r?\n")
    starts = lambda mark: F.size(F.filter(lines, lambda x: x.startswith(mark)))
    made = files.select("site", F.col("text").isNotNull().alias("exists"), F.get(lines, F.lit(0)).startswith("# ").alias("has_title"), (starts("> ") > 0).alias("has_description"), starts("## ").alias("sections"),
                        F.size(F.regexp_extract_all(t, F.lit(r"(?m)^\s*-\s*\[.+\]\(.+\)"), F.lit(0))).alias("links"), F.lower(t).alias("low"))
    said = lambda tests: F.array_compact(F.array(*[F.when(test, F.lit(text)) for test, text in tests]))
    issues = said([(~F.col("has_title"), "no title in the first line"), (~F.col("has_description"), "no description"), (F.col("sections") == 0, "no section"), (F.col("links") == 0, "no link in a list")])
    facts = F.col("low").contains("key fact") | F.col("low").contains("about")
    advice = said([(F.col("links") < 5, "more key pages"), (F.col("sections") < 2, "more sections"), (~F.col("low").contains("contact"), "a contact section"), (~facts, "key facts")])
    none = F.array().cast("array<string>")
    made = made.withColumn("issues", F.when(F.col("exists"), issues).otherwise(F.array(F.lit("no file")))).withColumn("suggestions", F.when(F.col("exists"), advice).otherwise(none))
    valid = F.col("has_title") & F.col("has_description") & (F.col("sections") > 0) & (F.col("links") > 0)
    return made.select("site", "exists", "has_title", "has_description", "sections", "links", valid.alias("format_valid"), "issues", "suggestions")


def llms_text(entries: DataFrame) -> DataFrame:
    """entries(site, section, title, url) -> (site, text): a heading for each section in order, links by title below."""
    link = F.concat(F.lit("- ["), F.col("title"), F.lit("]("), F.col("url"), F.lit(")"))
    parts = entries.groupBy("site", "section").agg(F.array_join(F.array_sort(F.collect_set(link)), "\n").alias("body"))
    one = F.array_sort(F.collect_list(F.struct("section", F.concat(F.lit("## "), F.col("section"), F.lit("\n"), F.col("body")).alias("t"))))
    return parts.groupBy("site").agg(F.array_join(F.transform(one, lambda x: x["t"]), "\n\n").alias("text"))
