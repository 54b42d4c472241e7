"""Continuous ingest: pages arrive as files, are extracted once by URL, and the BM25 index grows by micro-batch.

An extension: the batch operators are the same; only arrival and de-duplication are streaming.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from sievestone.config import BM25Params, CrawlRules
from sievestone.operators.index import BM25Index, index_of, postings_and_lengths
from sievestone.operators.ingest import extract_pages

PAGE = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("html", T.StringType()), T.StructField("seen", T.TimestampType())])


def read_pages(spark: SparkSession, path: str, schema: T.StructType = PAGE, per_trigger: int = 100) -> DataFrame:
    """Parquet files of pages as they arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def new_articles(pages: DataFrame, rules: CrawlRules = CrawlRules(), late: str = "1 day") -> DataFrame:
    """Each URL once within the watermark, extracted. pages: page_id, url, html, seen; the state is bounded by `late`."""
    once = pages.withWatermark("seen", late).dropDuplicatesWithinWatermark(["url"])
    return extract_pages(once, rules, keep=("page_id", "seen"))


def append_and_index(articles: DataFrame, store: str, index: str, checkpoint: str) -> StreamingQuery:
    """Each micro-batch adds its articles, postings and lengths in folders of its own, so a repeated batch replaces itself
    and work grows with the batch, not with the index."""

    def step(batch: DataFrame, number: int) -> None:
        rows = batch.select("page_id", "url", "title", "paragraphs")
        rows.write.mode("overwrite").parquet(f"{store}/batch={number}")
        saved = batch.sparkSession.read.schema(rows.schema).parquet(f"{store}/batch={number}")
        titled = saved.where(F.trim(F.coalesce("title", F.lit(""))) != "")
        tables = postings_and_lengths(titled.select(F.col("page_id").alias("doc_id"), F.concat_ws(" ", "title", "paragraphs").alias("text")))
        for name, table in zip(("postings", "doc_len"), tables, strict=True):
            table.write.mode("overwrite").parquet(f"{index}/{name}/batch={number}")

    return articles.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def load_grown(spark: SparkSession, index: str, params: BM25Params = BM25Params()) -> BM25Index:
    """The index over all micro-batches so far; statistics are those of all documents."""
    postings, doc_len = (spark.read.option("basePath", f"{index}/{name}").parquet(f"{index}/{name}").drop("batch") for name in ("postings", "doc_len"))
    return index_of(postings, doc_len, params)
