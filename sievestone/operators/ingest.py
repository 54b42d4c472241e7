"""From raw pages to articles: extraction, link filters, redirects, the crawl frontier, de-duplication."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievestone.config import CrawlRules
from sievestone.functions import web
from sievestone.functions.text import tokens
from sievestone.session import materialize


def extract_pages(pages: DataFrame, rules: CrawlRules = CrawlRules(), keep: Sequence[str] = ("page_id",)) -> DataFrame:
    """keep, url, title, file_name (attachments), paragraphs, links, host. A page without a title keeps its row, as visited."""
    hrefs = web.links(F.col("html"))
    attached = F.filter(hrefs, lambda u: web.is_attachment(u, rules.attachments))
    return pages.select(
        *keep,
        "url",
        web.title(F.col("html"), rules.title_tag).alias("title"),
        F.array_distinct(F.transform(attached, web.file_name)).alias("file_name"),
        web.paragraphs(F.col("html")).alias("paragraphs"),
        F.array_distinct(F.array_except(hrefs, attached)).alias("links"),
        web.host(F.col("url")).alias("host"),
    )


def follow_redirects(responses: DataFrame) -> DataFrame:
    """(url, status, html): one redirect is followed; what does not end in 2xx is dropped. responses: url, status, location, html."""
    target = responses.select(F.col("url").alias("_to"), F.col("status").alias("_status"), F.col("html").alias("_html"))
    moved = F.col("status").between(300, 399) & F.col("location").isNotNull()
    joined = responses.join(target, moved & (F.col("location") == F.col("_to")), "left")
    status, html = F.when(moved, F.col("_status")).otherwise(F.col("status")), F.when(moved, F.col("_html")).otherwise(F.col("html"))
    return joined.select("url", status.alias("status"), html.alias("html")).where(F.col("status").between(200, 299))


def frontier_step(pages: DataFrame, visited: DataFrame, rules: CrawlRules) -> DataFrame:
    """(url): distinct links of pages that may be followed and were not visited. pages: url, links."""
    found = pages.select(F.explode("links").alias("url")).where(web.is_followed(F.col("url"), rules.hosts, rules.follow_prefixes))
    return found.distinct().join(visited.select("url").distinct(), "url", "left_anti")


def crawl(pages: DataFrame, seeds: DataFrame, rules: CrawlRules, depth: int = 16) -> DataFrame:
    """(url, depth) of what is reached from seeds over a table of pages (url, links), breadth first.

    Each level is written to the shared folder; the loop ends with an empty frontier, or at `depth`.
    """
    visited = materialize(seeds.select("url").distinct().withColumn("depth", F.lit(0)), "frontier")
    front = visited
    for level in range(1, depth + 1):
        reached = pages.join(front.select("url"), "url", "left_semi")
        front = materialize(frontier_step(reached, visited, rules).withColumn("depth", F.lit(level)), "frontier")
        if front.isEmpty():
            break
        visited = visited.unionByName(front)
    return visited


def last_by_key(rows: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Of rows with equal keys the last by order: a grouped maximum, combined before the shuffle."""
    rest = [c for c in rows.columns if c not in keys]
    ordered = F.struct(F.col(order).alias("_order"), *rest)
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), ordered).alias("r")).select(*keys, "r.*")


def segment_articles(articles: DataFrame) -> DataFrame:
    """Adds segmented_title, segmented_paragraphs and segmented_file_name (name -> tokens); articles without a title go."""
    names = F.array_distinct(F.coalesce("file_name", F.array().cast("array<string>")))
    return articles.where(F.trim(F.coalesce("title", F.lit(""))) != "").withColumns(
        {
            "segmented_title": tokens(F.col("title")),
            "segmented_paragraphs": tokens(F.col("paragraphs")),
            "segmented_file_name": F.map_from_arrays(names, F.transform(names, lambda n: tokens(n))),
        }
    )


def replicate(rows: DataFrame, k: int) -> DataFrame:
    """Every row k times."""
    return rows.select("*", F.explode(F.sequence(F.lit(1), F.lit(k))).alias("_copy")).drop("_copy") if k > 0 else rows.limit(0)


def held_out(key: Column, percent: int = 10) -> Column:
    """Whole keys, by a hash: the same on every run."""
    return F.conv(F.substring(F.md5(key.cast("string").cast("binary")), 1, 8), 16, 10).cast("bigint") % 100 < percent


def crawl_stats(extracted: DataFrame) -> DataFrame:
    """One row of counts over extract_pages()."""
    return extracted.agg(
        F.count("*").alias("n_pages"),
        F.count_if(F.col("title").isNotNull()).alias("n_titled"),
        F.count_if(F.size("file_name") > 0).alias("n_with_files"),
        F.coalesce(F.sum(F.size("links")), F.lit(0)).cast("bigint").alias("n_links"),
    )


def numbered(rows: DataFrame, keys: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """Adds a 0-based number within keys."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1)
