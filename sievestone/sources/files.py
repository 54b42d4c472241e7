"""Readers and writers with explicit schemas: JSON arrays, JSON lines, stop words, labelled questions, SVMlight."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievestone.operators.qa import parse_svmlight, svmlight

WORDS = T.ArrayType(T.StringType())
ARTICLE = T.StructType([T.StructField("url", T.StringType()), T.StructField("title", T.StringType()), T.StructField("file_name", WORDS), T.StructField("paragraghs", T.StringType())])
SEGMENTED = T.StructType(
    [*ARTICLE, T.StructField("segmented_title", WORDS), T.StructField("segmented_parapraghs", WORDS), T.StructField("segmented_file_name", T.MapType(T.StringType(), WORDS))]
)
PASSAGE = T.StructType([T.StructField("pid", T.LongType()), T.StructField("document", WORDS)])
QA = T.StructType(
    [T.StructField("qid", T.LongType()), T.StructField("pid", T.LongType()), T.StructField("question", T.StringType()), T.StructField("answer_sentence", WORDS), T.StructField("answer", T.StringType())]
)
SEGMENTS = T.ArrayType(T.StructType([T.StructField("t", T.StringType()), T.StructField("p", T.DoubleType())]))


def read_json_array(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Files that hold one JSON array each."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_json_lines(spark: SparkSession, path: str, schema: T.StructType, strict: bool = True) -> DataFrame:
    """One object a line. strict: a malformed line raises; otherwise such lines go."""
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)


def write_json(df: DataFrame, path: str) -> None:
    """JSON lines in UTF-8; an older result is replaced."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def read_stop_words(spark: SparkSession, path: str) -> DataFrame:
    """(word): one a line, without blank lines or repeats."""
    return spark.read.text(path).select(F.rtrim("value").alias("word")).where("word <> ''").distinct()


def read_labelled_questions(spark: SparkSession, path: str, replication: int = 1) -> DataFrame:
    """(label, question) from label, tab, question; lines of one letter or none go. Each row `replication` times."""
    lines = spark.read.text(path).where(F.length("value") > 1)
    parts = F.split(F.trim("value"), "\t")
    rows = lines.where(F.size(parts) == 2).select(parts[0].alias("label"), parts[1].alias("question"))
    return rows if replication == 1 else rows.select("*", F.explode(F.sequence(F.lit(1), F.lit(replication))).alias("_")).drop("_")


def write_svmlight(rows: DataFrame, path: str) -> None:
    """rows: qid, sent_no, rank, features; lines in the order of qid and sent_no."""
    ordered = rows.repartitionByRange("qid").sortWithinPartitions("qid", "sent_no")
    ordered.select(svmlight(F.col("rank"), F.col("qid"), F.col("features")).alias("value")).write.mode("overwrite").text(path)


def read_svmlight(spark: SparkSession, path: str) -> DataFrame:
    """(rank, qid, features)."""
    return spark.read.text(path).select(*[c.alias(name) for name, c in parse_svmlight(F.col("value")).items()])


def segments_to_words(reply: str) -> F.Column:
    """Tokens of a segmenter's JSON reply, [{t, p}, ...]."""
    return F.transform(F.from_json(F.col(reply), SEGMENTS), lambda s: s["t"])
