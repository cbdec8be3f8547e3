"""A breadth-first crawl, level by level.

Fetching is a function from a table of URLs to a table of pages: a join with pages at hand, or the network. So a level of the frontier is one plan. The order of a first-in, first-out queue is kept by the
key (depth, place in the level), where places follow the place of the parent and of the link in it; they are numbered by ranges, so that no task has to order a level.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions.text import content_digest
from quarry.functions.urls import host, normalize_url, slugify
from quarry.operators.index import with_ids
from quarry.plans.session import cut

MAX_BYTES = 2_000_000
#: Up to so many URLs of a level are broadcast to pages at hand, which then stay where they are; more are joined.
BROADCAST_URLS = 100_000


def usable(responses: DataFrame) -> DataFrame:
    """Responses that count as pages: status 200, an HTML content type, at most MAX_BYTES."""
    return responses.where((F.col("status") == 200) & F.lower("content_type").contains("html") & (F.octet_length("html") <= MAX_BYTES))


def allowed(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """Rows of ``urls`` whose (host, path) no disallow rule (host, prefix, allow) forbids; the longest matching rule decides, allow wins ties. In a rule * stands
    for anything, and $ at its end for the end of the path."""
    at = urls.withColumn("_host", host(F.col("url"))).withColumn("_path", F.regexp_extract("url", r"^[^/]*//[^/]*(/[^#]*)", 1))
    # quoted but for the two signs
    body = F.concat(F.lit("^\\Q"), F.replace(F.regexp_replace("prefix", "\\$$", ""), F.lit("*"), F.lit("\\E.*\\Q")), F.lit("\\E"), F.when(F.col("prefix").endswith("$"), "$").otherwise(""))
    hit = at.join(rules.select(F.col("host").alias("_host"), "prefix", "allow", body.alias("_rule")), "_host").where(F.when(F.col("prefix").rlike("[*$]"), F.expr("_path rlike _rule")).otherwise(F.expr("startswith(_path, prefix)")))
    best = hit.groupBy("url").agg(F.max(F.struct(F.length("prefix"), "allow")).alias("best"))
    return urls.join(best.where(~F.col("best.allow")).select("url"), "url", "left_anti")


def first_of_content(pages: DataFrame, order: str, stored: DataFrame | None = None) -> DataFrame:
    """Pages (with text and a unique column ``order``) whose digest no earlier page and no stored one has. Only digests are aggregated; the pages themselves meet the ids that stay."""
    pages = pages.withColumn("digest", content_digest(F.col("text")))
    keys = pages.select("digest", order)
    if stored is not None:
        keys = keys.join(stored.select("digest").distinct(), "digest", "left_anti")
    return pages.join(keys.groupBy("digest").agg(F.min(order).alias(order)).select(order), order, "left_semi")


def at_hand(pages: DataFrame, parsed: Callable[[DataFrame], DataFrame] | None = None) -> Callable[[DataFrame], DataFrame]:
    """For ``crawl``: pages at hand as a function from (url) to (url, text, links). What is stored of a page meets the URLs first, and ``parsed``, which makes text and links of it, sees only the
    pages that are asked for: a level costs one scan, and parsing as many pages as it has."""

    def get(urls: DataFrame) -> DataFrame:
        urls = urls.select("url")
        few = urls.limit(BROADCAST_URLS + 1).count() <= BROADCAST_URLS
        found = pages.join(F.broadcast(urls) if few else urls, "url")
        return parsed(found) if parsed else found

    return get


def crawl(spark: SparkSession, pages: DataFrame | Callable[[DataFrame], DataFrame], seeds: list[str], max_pages: int = 25, same_host_only: bool = True, rules: DataFrame | None = None, stored: DataFrame | None = None) -> DataFrame:
    """pages: (url, text, links), or a function from (url) to it, see ``sources.corpus.fetched``; to (url, filename, digest, seq), the pages stored in the order they are.
    Duplicates of content, of this crawl or of ``stored`` (digest), aren't stored and don't count towards ``max_pages``, but their links are followed."""
    return crawled(spark, pages, seeds, max_pages, same_host_only, rules, stored).select("url", "filename", "digest", "seq")


def crawled(spark: SparkSession, pages: DataFrame | Callable[[DataFrame], DataFrame], seeds: list[str], max_pages: int = 25, same_host_only: bool = True, rules: DataFrame | None = None, stored: DataFrame | None = None) -> DataFrame:
    """As ``crawl``, with the other columns of the pages."""
    get = pages if callable(pages) else at_hand(pages)
    start = spark.createDataFrame([(i, s) for i, s in enumerate(seeds)], "at long, url string").withColumn("url", normalize_url(F.col("url")))
    level = seen = start.groupBy("url").agg(F.min("at").alias("at"))
    hosts = level.select(host(F.col("url")).alias("_host")).distinct()
    known = stored.select("digest") if stored is not None else spark.createDataFrame([], "digest string")
    out, done = None, 0
    while done < max_pages:
        todo = allowed(level, rules) if rules is not None else level
        # fetched once: all that follows reads what is written here
        got = cut(get(todo).join(todo.select("url", "at"), "url").withColumn("digest", content_digest(F.col("text"))))
        fresh = got.select("digest", "at").join(known, "digest", "left_anti")
        kept = fresh.groupBy("digest").agg(F.min("at").alias("at")).orderBy("at").limit(max_pages - done)
        kept = cut(kept.withColumn("seq", (F.row_number().over(Window.orderBy("at")) + done - 1).cast("long")))  # at most max_pages rows
        rows = got.join(F.broadcast(kept.select("at", "seq")), "at").withColumn("filename", slugify(F.col("url"))).drop("at")
        out = rows if out is None else out.unionByName(rows)
        done += kept.count()
        known = known.unionByName(kept.select("digest"))
        if done >= max_pages:
            break
        links = got.select("at", F.posexplode("links").alias("place", "url")).where(F.col("url").rlike("^https?://"))
        if same_host_only:
            links = links.withColumn("_host", host(F.col("url"))).join(hosts, "_host", "left_semi").drop("_host")
        new = links.join(seen.select("url"), "url", "left_anti").groupBy("url").agg(F.min(F.struct("at", "place")).alias("key"))
        level = with_ids(new, "key").select("url", F.col("doc_id").alias("at"))
        if not level.take(1):
            break
        seen = seen.select("url").unionByName(level.select("url"))
    return out if out is not None else spark.createDataFrame([], "url string, text string, links array<string>, filename string, digest string, seq long")
