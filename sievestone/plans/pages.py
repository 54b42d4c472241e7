"""Queries over pages and URLs: extraction, link filters, frontier, dates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievestone.config import CrawlRules
from sievestone.functions import web
from sievestone.operators import ingest
from sievestone.session import table

RULES = CrawlRules(title_tag="h1", follow_prefixes=("http://www.", "http://m.", "http://blog."))
HOSTS = ("blog.tionsh.example.net", "thther.example.org", "blog.tiontion.example.com")
EXTENSIONS = ("pdf", "doc", "html", "xls", "PDF", "txt", "docx", "png")


def _extracted(spark: SparkSession, d: str) -> DataFrame:
    return ingest.extract_pages(table(spark, d, "pages"), RULES)


def extract_pages(spark: SparkSession, d: str) -> DataFrame:
    return _extracted(spark, d).select("page_id", "title", "paragraphs", "host", F.size("links").alias("n_links"))


def page_links(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", F.explode(F.array_distinct(web.links(F.col("html")))).alias("link"))


def link_filter(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").where(web.is_followed(F.col("url"), RULES.hosts, RULES.follow_prefixes)).select("page_id", "url")


def link_filter_hosts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").where(web.is_followed(F.col("url"), HOSTS)).select("page_id", "url")


def frontier_step(spark: SparkSession, d: str) -> DataFrame:
    """Each page links to itself and to a next page, which no one has visited."""
    pages = table(spark, d, "pages")
    linked = pages.select("url", F.array("url", F.concat("url", F.lit("/next"))).alias("links"))
    return ingest.frontier_step(linked, pages.where("page_id % 3 = 0"), RULES)


def crawl_reach(spark: SparkSession, d: str) -> DataFrame:
    """Breadth first over a chain of pages: page i links to 2i + 1 and 2i + 2."""
    pages = table(spark, d, "pages")
    name = lambda c: F.concat(F.lit("http://www.example.com/"), c.cast("string"))
    linked = pages.select(name(F.col("page_id")).alias("url"), F.array(name(2 * F.col("page_id") + 1), name(2 * F.col("page_id") + 2)).alias("links"))
    return ingest.crawl(linked, linked.where(F.col("url") == "http://www.example.com/0"), RULES, depth=4)


def redirects(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "pages")
    name = lambda c: F.concat(F.lit("p"), c.cast("string"))
    status = F.when(F.col("page_id") % 5 == 1, 302).when(F.col("page_id") % 7 == 3, 404).otherwise(200)
    responses = p.select(name(F.col("page_id")).alias("url"), status.alias("status"), F.when(F.col("page_id") % 5 == 1, name(F.col("page_id") + 1)).alias("location"), F.col("url").alias("html"))
    return ingest.follow_redirects(responses)


def attachment_urls(spark: SparkSession, d: str) -> DataFrame:
    ext = F.element_at(F.array(*[F.lit(x) for x in EXTENSIONS]), (F.pmod("p_partkey", F.lit(8)) + 1).cast("int"))
    url = F.concat(F.lit("http://files.example.com/a/"), F.replace(F.col("p_name"), F.lit(" "), F.lit("%20")), F.lit("."), ext)
    p = table(spark, d, "part").select("p_partkey", url.alias("url"))
    return p.where(web.is_attachment(F.col("url"), RULES.attachments)).select("p_partkey", web.file_name(F.col("url")).alias("file_name"))


def url_dates(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    good = F.concat(F.lit("http://news.example.com/article/"), F.date_format("o_orderdate", "yyyy/MM/dd"), F.lit("/"), F.col("o_orderkey").cast("string"))
    bad = F.concat(F.lit("http://news.example.com/article/"), F.date_format("o_orderdate", "yy/MM/dd"), F.lit("/x"))
    odd = F.concat(F.lit("http://news.example.com/article/"), F.date_format("o_orderdate", "yyyy"), F.lit("/13/40/x"))
    url = F.when(F.col("o_orderkey") % 9 == 1, bad).when(F.col("o_orderkey") % 9 == 2, odd).when(F.col("o_orderkey") % 9 == 3, F.lit("x/y")).otherwise(good)
    return o.select("o_orderkey", web.url_date(url).alias("date"))


def crawl_stats(spark: SparkSession, d: str) -> DataFrame:
    return ingest.crawl_stats(_extracted(spark, d))


QUERIES = {
    "extract_pages": extract_pages,
    "page_links": page_links,
    "link_filter": link_filter,
    "link_filter_hosts": link_filter_hosts,
    "frontier_step": frontier_step,
    "crawl_reach": crawl_reach,
    "redirects": redirects,
    "attachment_urls": attachment_urls,
    "url_date": url_dates,
    "crawl_stats": crawl_stats,
}

SPACES = r"[\s\x{A0}\x{2000}-\x{200A}\x{2028}\x{2029}\x{3000}]+"
STRIP = rf"regexp_replace({{0}}, '^{SPACES.replace('{', '{{').replace('}', '}}')}|{SPACES.replace('{', '{{').replace('}', '}}')}$', '', 'g')"
TAGLESS = "regexp_replace({0}, '<[^>]*>', '', 'g')"
TITLE = f"nullif({STRIP.format(TAGLESS.format(chr(40) + 'regexp_extract(html, ' + chr(39) + '(?s)<h1[^>]*>(.*?)</h1>' + chr(39) + ', 1)' + chr(41)))}, '')"
LINKS = r"list_transform(regexp_extract_all(html, '<a\b[^>]*>'), lambda a: regexp_extract(a, 'href=\"([^\"]*)\"', 1))"
PARAGRAPHS = f"""array_to_string(list_transform(regexp_extract_all(html, '(?s)<p[^>]*>(.*?)</p>', 1),
lambda p: translate(translate({STRIP.format(TAGLESS.format('p'))}, '“”' || chr(10), '   '), chr(160) || chr(8194) || chr(8232), '')), ' ')"""
FOLLOWED = "(url LIKE 'http://www.%' OR url LIKE 'http://m.%' OR url LIKE 'http://blog.%')"
NO_FILES = r"list_filter(list_distinct({0}), lambda u: NOT regexp_matches(u, '\.(xls|doc|docx|txt|xlsx|pdf)$'))"

ORACLE_SQL = {
    "extract_pages": f"""SELECT page_id, {TITLE} AS title, {PARAGRAPHS} AS paragraphs, split_part(url, '/', 3) AS host,
CAST(len({NO_FILES.format(LINKS)}) AS INTEGER) AS n_links FROM pages""",
    "page_links": f"SELECT page_id, unnest(list_distinct({LINKS})) AS link FROM pages",
    "link_filter": f"SELECT page_id, url FROM pages WHERE {FOLLOWED}",
    "link_filter_hosts": f"SELECT page_id, url FROM pages WHERE split_part(url, '://', 1) = 'http' AND split_part(url, '/', 3) IN ({', '.join(f"'{h}'" for h in HOSTS)})",
    "frontier_step": f"SELECT DISTINCT url FROM (SELECT unnest([url, url || '/next']) AS url FROM pages) WHERE {FOLLOWED} AND url NOT IN (SELECT url FROM pages WHERE page_id % 3 = 0)",
    "crawl_reach": """WITH RECURSIVE r(i, depth) AS (SELECT CAST(0 AS BIGINT), 0 UNION ALL SELECT 2 * i + k, depth + 1 FROM r, (VALUES (1), (2)) v(k)
WHERE depth < 4 AND i IN (SELECT page_id FROM pages)) SELECT 'http://www.example.com/' || i AS url, CAST(depth AS INTEGER) AS depth FROM r""",
    "redirects": """WITH s AS (SELECT page_id, 'p' || page_id AS url, CASE WHEN page_id % 5 = 1 THEN 302 WHEN page_id % 7 = 3 THEN 404 ELSE 200 END AS status, url AS html FROM pages)
SELECT a.url, CASE WHEN a.status = 302 THEN b.status ELSE a.status END AS status, CASE WHEN a.status = 302 THEN b.html ELSE a.html END AS html
FROM s a LEFT JOIN s b ON a.status = 302 AND b.page_id = a.page_id + 1 WHERE CASE WHEN a.status = 302 THEN b.status ELSE a.status END BETWEEN 200 AND 299""",
    "attachment_urls": rf"""SELECT p_partkey, url_decode(regexp_extract(url, '[^/]*$')) AS file_name FROM (SELECT p_partkey, 'http://files.example.com/a/' || replace(p_name, ' ', '%20') || '.' ||
([{", ".join(f"'{x}'" for x in EXTENSIONS)}])[p_partkey % 8 + 1] AS url FROM part) WHERE regexp_matches(url, '\.(xls|doc|docx|txt|xlsx|pdf)$')""",
    "url_date": r"""WITH u AS (SELECT o_orderkey, string_split(CASE o_orderkey % 9 WHEN 1 THEN 'http://news.example.com/article/' || strftime(o_orderdate, '%y/%m/%d') || '/x'
WHEN 2 THEN 'http://news.example.com/article/' || strftime(o_orderdate, '%Y') || '/13/40/x' WHEN 3 THEN 'x/y'
ELSE 'http://news.example.com/article/' || strftime(o_orderdate, '%Y/%m/%d') || '/' || o_orderkey END, '/') AS p FROM orders)
SELECT o_orderkey, coalesce(CASE WHEN regexp_full_match(p[-4], '\d{4}') THEN TRY_CAST(p[-4] || '-' || p[-3] || '-' || p[-2] AS DATE) END, DATE '0001-01-01') AS date FROM u""",
    "crawl_stats": f"""SELECT count(*) AS n_pages, count({TITLE}) AS n_titled, count(*) FILTER (len({LINKS}) > len({LINKS})) AS n_with_files,
CAST(sum(len({NO_FILES.format(LINKS)})) AS BIGINT) AS n_links FROM pages""",
}
