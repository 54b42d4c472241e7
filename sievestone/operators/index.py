"""Term statistics and ranking models over long tables (doc_id, word)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sievestone.config import BM25Params
from sievestone.functions.text import tokens


def token_table(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lowercase: bool = True) -> DataFrame:
    """(doc_id, pos, word) of every token."""
    # outer, as the optimizer would else filter by the number of tokens, and so match the pattern twice over every text
    return docs.select(doc_id, F.posexplode_outer(tokens(F.col(text), lowercase)).alias("pos", "word")).where("word is not null")


def by_document(docs: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """Each document's rows in one task: what is grouped by document and word, or query and document, then moves no more.

    A text is several times smaller than its rows of words. The number is stated, as tasks coalesced by the bytes of texts would be too
    large for those rows.
    """
    return docs.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), doc_id)


def only_words(table: DataFrame, words: DataFrame) -> DataFrame:
    """Rows of a table with words that are among those of stated queries; the optimizer filters before it counts."""
    return table.join(F.broadcast(words.select("word").distinct()), "word", "left_semi")


def term_frequency(words: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    return words.groupBy(doc_id, "word").agg(F.count("*").alias("tf"))


def document_frequency(tf: DataFrame) -> DataFrame:
    return tf.groupBy("word").agg(F.count("*").alias("df"))


def corpus_stats(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row (n_docs, n_tokens, avg_len); documents without a token count."""
    n = F.size(tokens(F.col(text)))
    return docs.agg(F.count("*").alias("n_docs"), F.coalesce(F.sum(n), F.lit(0)).cast("bigint").alias("n_tokens"), F.avg(n).alias("avg_len"))


def _with_stats(df: DataFrame, stats: DataFrame) -> DataFrame:
    return df.join(F.broadcast(stats))  # one row


# --- vector space model --------------------------------------------------------------------------------------------------


def vsm_idf(tf: DataFrame, stats: DataFrame) -> DataFrame:
    """(word, idf) with idf = log10(N / df)."""
    return _with_stats(document_frequency(tf), stats).select("word", F.log10(F.col("n_docs") / F.col("df")).alias("idf"))


def vsm_weights(tf: DataFrame, idf: DataFrame) -> DataFrame:
    """(doc_id, word, weight) with weight = (1 + log10 tf) * idf."""
    return tf.join(idf, "word").select("doc_id", "word", ((1 + F.log10("tf")) * F.col("idf")).alias("weight"))


def vsm_query_weights(query_tf: DataFrame, idf: DataFrame, query_id: str) -> DataFrame:
    """The same for queries; words that the corpus lacks weigh nothing."""
    return query_tf.join(idf, "word", "left").select(query_id, "word", ((1 + F.log10("tf")) * F.coalesce("idf", F.lit(0.0))).alias("weight"))


#: Score of a document from sums over the query's words alone: dot, squares of the document's weights, squares of the query's.
VSM_MEASURES: dict[str, Callable] = {
    "dot": lambda dot, d2, q2: dot,
    "cos": lambda dot, d2, q2: F.try_divide(dot, F.sqrt(d2) * F.sqrt(q2)),
    "jac": lambda dot, d2, q2: F.try_divide(dot, d2 + q2 - dot),
}


def vsm_scores(weights: DataFrame, query_weights: DataFrame, query_id: str, measure: str = "dot") -> DataFrame:
    """(query, doc_id, score) of documents that share a word; norms are restricted to the query's words. Queries are a stated set."""
    q2 = query_weights.groupBy(query_id).agg(F.sum(F.col("weight") * F.col("weight")).alias("q2"))
    q = query_weights.withColumnRenamed("weight", "wq").where("wq <> 0")
    sums = weights.join(F.broadcast(q), "word").groupBy(query_id, "doc_id").agg(
        F.sum(F.col("weight") * F.col("wq")).alias("dot"), F.sum(F.col("weight") * F.col("weight")).alias("d2")
    )
    score = VSM_MEASURES[measure](F.col("dot"), F.col("d2"), F.col("q2"))
    return sums.join(F.broadcast(q2), query_id).select(query_id, "doc_id", F.round(score, 6).alias("score"))


def argmax(scores: DataFrame, queries: DataFrame, query_id: str, missing: int = -1) -> DataFrame:
    """(query, doc_id, score): the first document with the greatest positive score; `missing` and 0 where there is none."""
    good = scores.where((F.col("score") > 0) & ~F.isnan("score"))
    best = good.groupBy(query_id).agg(F.max(F.struct("score", (-F.col("doc_id")).alias("d"))).alias("b"))
    return queries.select(query_id).join(best, query_id, "left").select(
        query_id, F.coalesce(-F.col("b.d"), F.lit(missing)).cast("bigint").alias("doc_id"), F.coalesce("b.score", F.lit(0.0)).alias("score")
    )


# --- smooth tf-idf ---------------------------------------------------------------------------------------------------------


def smooth_tfidf(tf: DataFrame, stats: DataFrame) -> DataFrame:
    """(doc_id, word, weight): tf * (ln((1 + N) / (1 + df)) + 1), rows scaled to length 1."""
    # by document again as counts, which take a fraction of a weight's bytes; a window, as rows and norms would else be moved one by one
    counts = by_document(tf.join(document_frequency(tf).hint("shuffle_hash"), "word").select("doc_id", "word", "tf", "df"))
    idf = F.ln((1 + F.col("n_docs")) / (1 + F.col("df"))) + 1
    raw = _with_stats(counts, stats).select("doc_id", "word", (F.col("tf") * idf).alias("w"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("doc_id")))
    return raw.select("doc_id", "word", (F.col("w") / norm).alias("weight"))


# --- BM25 ------------------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class BM25Index:
    """Four tables; statistics span every document."""

    postings: DataFrame  # doc_id, word, tf
    idf: DataFrame  # word, idf
    doc_len: DataFrame  # doc_id, doc_len
    stats: DataFrame  # n_docs, n_tokens, avg_len
    params: BM25Params = BM25Params()

    TABLES = ("postings", "idf", "doc_len", "stats")

    def save(self, path: str) -> None:
        for name in self.TABLES:
            table = getattr(self, name)
            # sorted where they are made: equal words lie together in a file, and no posting moves for it
            (table.sortWithinPartitions("word", "doc_id") if name == "postings" else table).write.mode("overwrite").parquet(f"{path}/{name}")

    @classmethod
    def load(cls, spark: SparkSession, path: str, params: BM25Params = BM25Params()) -> BM25Index:
        return cls(*[spark.read.parquet(f"{path}/{name}") for name in cls.TABLES], params)


def postings_and_lengths(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(doc_id, word, tf) and (doc_id, doc_len). words: a column of token arrays to use instead of the text."""
    got = docs.select(F.col(doc_id).alias("doc_id"), (F.col(words) if words else tokens(F.col(text))).alias("ws"))
    return term_frequency(got.select("doc_id", F.explode_outer("ws").alias("word")).where("word is not null")), got.select("doc_id", F.size("ws").cast("bigint").alias("doc_len"))


def index_of(postings: DataFrame, doc_len: DataFrame, params: BM25Params = BM25Params()) -> BM25Index:
    """Adds the statistics. idf = ln(N / df), never negative."""
    stats = doc_len.agg(F.count("*").alias("n_docs"), F.sum("doc_len").alias("n_tokens"), F.avg("doc_len").alias("avg_len"))
    idf = _with_stats(document_frequency(postings), stats).select("word", F.ln(F.col("n_docs") / F.col("df")).alias("idf"))
    return BM25Index(postings, idf, doc_len, stats, params)


def bm25_fit(docs: DataFrame, params: BM25Params = BM25Params(), doc_id: str = "doc_id", text: str = "text", words: str | None = None) -> BM25Index:
    return index_of(*postings_and_lengths(docs, doc_id, text, words), params)


def bm25_scores(index: BM25Index, queries: DataFrame, query_id: str = "query_id", text: str = "text") -> DataFrame:
    """(query, doc_id, score) of documents that share a word with the query. Queries are a stated set."""
    p = index.params
    q = token_table(queries, query_id, text).groupBy(query_id, "word").agg(F.count("*").alias("qtf"))
    asked = only_words(index.idf, q).join(F.broadcast(q), "word")
    tf, n = F.col("tf"), F.col("doc_len")
    part = (
        F.col("idf") * (p.k1 + 1) * tf / (p.k1 * (1 - p.b + p.b * n / F.col("avg_len")) + tf) * (p.k3 + 1) * F.col("qtf") / (p.k3 + F.col("qtf"))
    )
    hits = only_words(index.postings, q).join(index.doc_len.hint("shuffle_hash"), "doc_id").join(F.broadcast(asked), "word")
    return _with_stats(hits, index.stats).groupBy(query_id, "doc_id").agg(F.round(F.sum(part), 6).alias("score"))


def with_zero_scores(scores: DataFrame, queries: DataFrame, docs: DataFrame, query_id: str = "query_id") -> DataFrame:
    """Every document for every query, 0 where nothing matched: the stated queries against all rows."""
    found = scores.select("doc_id", F.struct(query_id, "score").alias("s")).groupBy("doc_id").agg(F.collect_list("s").alias("found"))
    asked = queries.select(query_id)
    every = docs.select("doc_id").join(found, "doc_id", "left").withColumn("found", F.coalesce("found", F.array().cast(found.schema["found"].dataType)))
    # one row of all queries: a document's rows are made in its place, as a join by query and document would move them all
    every = every.join(F.broadcast(asked.agg(F.collect_set(query_id).alias("all"))))
    zeros = F.transform(F.array_except("all", F.transform("found", lambda s: s[query_id])), lambda q: F.struct(q.alias(query_id), F.lit(0.0).alias("score")))
    rows = every.select("doc_id", F.explode(F.concat("found", zeros)).alias("s")).select(f"s.{query_id}", "doc_id", "s.score")
    return rows.join(F.broadcast(asked), query_id)


def top_k(scores: DataFrame, k: int, query_id: str = "query_id", doc_id: str = "doc_id") -> DataFrame:
    """(query, doc, score, rank): the k best of each query, ties by id. Each task keeps k rows of a query before the shuffle."""
    w = Window.partitionBy(query_id).orderBy(F.col("score").desc(), doc_id)
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def containing(docs: DataFrame, items: DataFrame, query_id: str = "query_id", doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(query, doc) where the document's text holds the item's text, letter for letter.

    An item's words but the first and the last are whole words of such a document; its rarest one finds the candidates by
    an equi-join, and they are verified in their place. Items without a word inside are held against all documents: a stated query set.
    """
    ws = tokens(F.col("_item"))
    stated = items.select(query_id, F.col(text).alias("_item")).where("_item is not null").withColumn("_inner", F.slice(ws, F.lit(2), F.greatest(F.size(ws) - 2, F.lit(0))))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_text"))
    inner = stated.select(query_id, F.explode(F.array_distinct("_inner")).alias("word"))
    words = F.explode_outer(F.array_distinct(tokens(F.col("_text")))).alias("word")
    df = only_words(rows.select(words), inner).groupBy("word").agg(F.count("*").alias("df"))
    rarest = inner.join(df, "word", "left").groupBy(query_id).agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "word")).alias("r")).select(query_id, "r.word")
    # the texts are cut once more rather than moved
    asked = rarest.join(F.broadcast(stated.select(query_id, "_item")), query_id)
    long = rows.select("doc_id", "_text", words).join(F.broadcast(asked), "word").where(F.contains("_text", "_item"))
    short = rows.crossJoin(F.broadcast(stated.where(F.size("_inner") == 0).select(query_id, "_item"))).where(F.contains("_text", "_item"))
    return long.select(query_id, "doc_id").unionByName(short.select(query_id, "doc_id"))


def load_or_fit(spark: SparkSession, path: str, docs: Callable[[], DataFrame], params: BM25Params = BM25Params(), force: bool = False) -> BM25Index:
    """The saved index, or a new one that is saved first."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    where = hadoop.Path(f"{path}/stats/_SUCCESS")
    if force or not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        bm25_fit(docs(), params).save(path)
    return BM25Index.load(spark, path, params)
