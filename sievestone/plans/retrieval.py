"""Queries over documents and benchmark texts: tokens, statistics, ranking, search."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievestone.config import STOP_WORDS
from sievestone.functions.text import bigrams, sentences, snippet, tokens, without_stop_words
from sievestone.functions.vectors import MEASURES
from sievestone.operators import index as ix
from sievestone.operators import ingest, qa, search
from sievestone.operators.metrics import accuracy
from sievestone.session import shared_dir, table
from sievestone.sources import files

STOP = sorted({w for words in STOP_WORDS.values() for w in words})
AS_OF = "2024-01-31"
ROLES = ("Administrator", "VerifiedUser", "SignedUser", "Guest")


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


def _texts(spark: SparkSession, d: str) -> DataFrame:
    return ix.by_document(_docs(spark, d).select("doc_id", "text"))


def _items(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def tokenize_docs(spark: SparkSession, d: str) -> DataFrame:
    return ix.token_table(_docs(spark, d))


def stopword_filter(spark: SparkSession, d: str) -> DataFrame:
    kept = without_stop_words(tokens(F.col("text")), STOP)
    return _docs(spark, d).select("doc_id", F.posexplode(kept).alias("pos", "word"))


def bigram_sets(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", F.explode(F.array_distinct(bigrams(tokens(F.col("text"))))).alias("bigram"))


def term_freq(spark: SparkSession, d: str) -> DataFrame:
    return ix.term_frequency(ix.token_table(_texts(spark, d)))


def doc_freq(spark: SparkSession, d: str) -> DataFrame:
    return ix.document_frequency(term_freq(spark, d))


def corpus_stats(spark: SparkSession, d: str) -> DataFrame:
    s = ix.corpus_stats(_docs(spark, d))
    return s.select("n_docs", "n_tokens", F.round("avg_len", 6).alias("avg_len"))


def vsm_weights(spark: SparkSession, d: str) -> DataFrame:
    tf = term_freq(spark, d)
    w = ix.vsm_weights(tf, ix.vsm_idf(tf, ix.corpus_stats(_docs(spark, d))).hint("shuffle_hash"))
    return w.select("doc_id", "word", F.round("weight", 6).alias("weight"))


def sk_tfidf(spark: SparkSession, d: str) -> DataFrame:
    w = ix.smooth_tfidf(term_freq(spark, d), ix.corpus_stats(_docs(spark, d)))
    return w.select("doc_id", "word", F.round("weight", 6).alias("weight"))


def _vsm(measure: str):
    def query(spark: SparkSession, d: str) -> DataFrame:
        items = _items(spark, d)
        qtf = ix.token_table(items, "query_id").groupBy("query_id", "word").agg(F.count("*").alias("tf"))
        tf = ix.only_words(term_freq(spark, d), qtf)
        idf = F.broadcast(ix.vsm_idf(tf, ix.corpus_stats(_docs(spark, d))))
        scores = ix.vsm_scores(ix.vsm_weights(tf, idf), ix.vsm_query_weights(qtf, idf, "query_id"), "query_id", measure)
        return ix.argmax(scores, items, "query_id")

    return query


def retrieval_accuracy(spark: SparkSession, d: str) -> DataFrame:
    """Share of items whose best document is one of those that hold the item's text; items that no document holds don't count."""
    docs, items = _docs(spark, d), _items(spark, d)
    gold = ix.containing(docs, items)
    best = _vsm("dot")(spark, d).select("query_id", F.col("doc_id").alias("best"))
    asked = gold.join(F.broadcast(best), "query_id").groupBy("query_id").agg(F.max(F.col("doc_id") == F.col("best")).alias("hit"))
    rows = asked.select("hit", F.lit(True).alias("gold"))
    return rows.agg(F.count("*").alias("n")).join(F.broadcast(accuracy(rows, "hit", "gold"))).select("n", F.round("accuracy", 6).alias("accuracy"))


def bm25_fit(spark: SparkSession, d: str) -> DataFrame:
    return ix.bm25_fit(_texts(spark, d)).idf.select("word", F.round("idf", 6).alias("idf"))


def bm25_doc_len(spark: SparkSession, d: str) -> DataFrame:
    i = ix.bm25_fit(_docs(spark, d))
    return i.doc_len.join(F.broadcast(i.stats)).select("doc_id", "doc_len", F.round(F.col("doc_len") / F.col("avg_len"), 6).alias("relative_len"))


def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    return ix.top_k(ix.bm25_scores(ix.bm25_fit(_texts(spark, d)), _items(spark, d)), 10)


def bm25_all_docs(spark: SparkSession, d: str) -> DataFrame:
    docs, items = _docs(spark, d), _items(spark, d)
    return ix.with_zero_scores(ix.bm25_scores(ix.bm25_fit(_texts(spark, d)), items), items, docs)


def _articles(spark: SparkSession, d: str) -> DataFrame:
    day = F.date_add(F.lit("2021-01-01").cast("date"), F.pmod(F.col("doc_id") * 37, F.lit(1200)).cast("int"))
    dated = F.concat(F.lit("http://news.example.com/article/"), F.date_format(day, "yyyy/MM/dd"), F.lit("/"), F.col("doc_id").cast("string"))
    url = F.when(F.col("doc_id") % 11 == 0, F.concat(F.lit("http://news.example.com/"), F.col("doc_id").cast("string"))).otherwise(dated)
    title = F.concat_ws(" ", "lang", "source")
    names = F.array(F.concat(F.lit("report "), F.col("source"), F.lit(".pdf")), F.concat(F.col("lang"), F.lit(" notes.doc")))
    docs = ix.by_document(_docs(spark, d).select("doc_id", "lang", "source", "text"))
    rows = docs.select("doc_id", url.alias("url"), title.alias("title"), names.alias("file_name"), F.col("text").alias("paragraphs"))
    return ingest.segment_articles(rows)


def role_search(spark: SparkSession, d: str) -> DataFrame:
    role = F.element_at(F.array(*[F.lit(r) for r in ROLES]), (F.pmod("query_id", F.lit(4)) + 1).cast("int"))
    found = search.search_pages(_articles(spark, d), _items(spark, d).withColumn("role", role), F.lit(AS_OF).cast("date"))
    return found.select("query_id", "rank", "doc_id", "score", "date")


def file_search(spark: SparkSession, d: str) -> DataFrame:
    queries = spark.createDataFrame([(1, "report en src3"), (2, "notes"), (3, "fr pdf"), (4, "nothing here"), (5, "src1 src2 report")], "query_id bigint, text string")
    return search.search_files(_articles(spark, d), queries)


def role_resolution(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    user = F.when(F.col("c_custkey") % 3 != 0, F.col("c_name"))
    role = F.when(F.col("c_custkey") % 5 == 0, F.lit("VerifiedUser")).when(F.col("c_custkey") % 7 == 0, F.lit("Administrator"))
    got = c.select("c_custkey", search.resolve_role(user, role).alias("role"))
    return got.select("c_custkey", "role", search.cutoff(F.col("role"), F.lit(AS_OF).cast("date")).alias("first_date"))


def snippets(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", snippet(F.col("text")).alias("snippet"))


def marked_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Letters' case and punctuation kept, as a segmenter would."""
    return _docs(spark, d).select("doc_id", F.posexplode(tokens(F.col("text"), lowercase=False, keep_punct=True)).alias("pos", "word"))


def containing(spark: SparkSession, d: str) -> DataFrame:
    return ix.containing(_docs(spark, d), _items(spark, d))


def segmented_articles(spark: SparkSession, d: str) -> DataFrame:
    a = _articles(spark, d)
    name = F.explode("segmented_file_name").alias("file_name", "words")
    return a.select("doc_id", F.array_join("segmented_title", " ").alias("title"), F.size("segmented_paragraphs").alias("n_words"), name).select(
        "doc_id", "title", "n_words", "file_name", F.array_join("words", " ").alias("file_words")
    )


def result_cards(spark: SparkSession, d: str) -> DataFrame:
    """What a result page shows, for administrators."""
    found = search.search_pages(_articles(spark, d), _items(spark, d).withColumn("role", F.lit("Administrator")), F.lit(AS_OF).cast("date"))
    return found.select("query_id", "rank", "url", "title", "snippet", F.date_format("date", "yyyy-MM-dd").alias("date"))


def index_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """The index is saved, loaded and asked."""
    path = f"{shared_dir(spark)}/index-{uuid.uuid4().hex}"
    return ix.top_k(ix.bm25_scores(ix.load_or_fit(spark, path, lambda: _texts(spark, d)), _items(spark, d)), 10)


def json_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    docs, path = _docs(spark, d), f"{shared_dir(spark)}/json-{uuid.uuid4().hex}"
    files.write_json(docs, path)
    return files.read_json_lines(spark, path, docs.schema)


def labelled_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Labels and questions as tab-separated lines, read twofold."""
    path = f"{shared_dir(spark)}/labelled-{uuid.uuid4().hex}"
    rows = _docs(spark, d).select(F.concat_ws("\t", F.upper("lang"), F.concat(F.lit("who wrote "), F.col("source"), F.lit(" "), F.col("doc_id").cast("string"))).alias("value"))
    rows.write.text(path)
    return files.read_labelled_questions(spark, path, 2)


def qa_pipeline(spark: SparkSession, d: str) -> DataFrame:
    """Retrieval, candidate sentences, ranking and the answer's span, for every benchmark text as a question."""
    items = _items(spark, d)
    best = _vsm("cos")(spark, d).where("doc_id >= 0").select("query_id", "doc_id")
    passages = F.broadcast(best).join(items.withColumnRenamed("text", "question"), "query_id").join(_docs(spark, d).select("doc_id", F.col("text").alias("passage")), "doc_id")
    rows = passages.select(F.col("query_id").alias("qid"), "doc_id", "question", F.posexplode(sentences(F.col("passage"))).alias("sent_no", "sentence"))
    share = qa.basic_features(tokens(F.col("question")), tokens(F.col("sentence")))["unigram"]
    top = qa.top_sentences(rows.withColumn("score", F.round(share, 6)), 1)
    none = F.array().cast("array<struct<word:string,tag:string>>")
    return top.select("qid", "doc_id", "sent_no", "score", qa.answer_span(F.lit("DES_OTHER"), F.col("sentence"), none).alias("answer"))


def corpus_dedup(spark: SparkSession, d: str) -> DataFrame:
    return ingest.last_by_key(_docs(spark, d).select("source", "lang", "doc_id", "n_chars"), ["source", "lang"], "doc_id")


def replicate_rows(spark: SparkSession, d: str) -> DataFrame:
    return ingest.replicate(_docs(spark, d).select("doc_id", "lang"), 3)


def dense_similarity(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    other = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    j = e.join(other, "vec_id")
    return j.select("vec_id", *[F.round(f(F.col("embedding"), F.col("other")), 5).alias(name) for name, f in MEASURES.items()])


QUERIES = {
    "tokenize_docs": tokenize_docs,
    "stopword_filter": stopword_filter,
    "bigrams": bigram_sets,
    "term_freq": term_freq,
    "doc_freq": doc_freq,
    "corpus_stats": corpus_stats,
    "vsm_weights": vsm_weights,
    "sk_tfidf": sk_tfidf,
    "vsm_dot": _vsm("dot"),
    "vsm_cos": _vsm("cos"),
    "vsm_jac": _vsm("jac"),
    "retrieval_accuracy": retrieval_accuracy,
    "bm25_fit": bm25_fit,
    "bm25_doc_len": bm25_doc_len,
    "bm25_topk": bm25_topk,
    "bm25_all_docs": bm25_all_docs,
    "role_search": role_search,
    "file_search": file_search,
    "role_resolution": role_resolution,
    "snippet": snippets,
    "corpus_dedup": corpus_dedup,
    "replicate_rows": replicate_rows,
    "dense_similarity": dense_similarity,
    "marked_tokens": marked_tokens,
    "containing": containing,
    "segmented_articles": segmented_articles,
    "result_cards": result_cards,
    "index_roundtrip": index_roundtrip,
    "json_roundtrip": json_roundtrip,
    "labelled_roundtrip": labelled_roundtrip,
    "qa_pipeline": qa_pipeline,
}

# --- DuckDB ----------------------------------------------------------------------------------------------------------------

WORDS = r"regexp_extract_all(lower(coalesce({0}, '')), '[\p{{L}}\p{{N}}_]+')"
TOKENS = f"tok AS (SELECT doc_id, unnest({WORDS.format('text')}) AS word FROM documents)"
TF = f"{TOKENS}, tf AS (SELECT doc_id, word, count(*) AS tf FROM tok GROUP BY ALL), df AS (SELECT word, count(*) AS df FROM tf GROUP BY ALL)"
N = f"n AS (SELECT count(*) AS n_docs, avg(len({WORDS.format('text')})) AS avg_len FROM documents)"
VSM = f"""{TF}, {N}, idf AS (SELECT word, log10(n_docs / df) AS idf FROM df, n),
w AS (SELECT doc_id, word, (1 + log10(tf)) * idf AS weight FROM tf JOIN idf USING (word)),
qtf AS (SELECT query_id, word, count(*) AS tf FROM (SELECT item_id AS query_id, unnest({WORDS.format('text')}) AS word FROM benchmark) GROUP BY ALL),
wq AS (SELECT query_id, word, (1 + log10(tf)) * coalesce(idf, 0) AS wq FROM qtf LEFT JOIN idf USING (word)),
q2 AS (SELECT query_id, sum(wq * wq) AS q2 FROM wq GROUP BY ALL),
s AS (SELECT query_id, doc_id, sum(weight * wq) AS dot, sum(weight * weight) AS d2 FROM w JOIN wq USING (word) WHERE wq <> 0 GROUP BY ALL)"""


def _vsm_sql(score: str) -> str:
    return f"""WITH {VSM}, r AS (SELECT query_id, doc_id, round({score}, 6) AS score FROM s JOIN q2 USING (query_id)),
best AS (SELECT query_id, doc_id, score FROM r WHERE score > 0 AND NOT isnan(score)
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) = 1)
SELECT item_id AS query_id, coalesce(doc_id, -1) AS doc_id, coalesce(score, 0) AS score FROM benchmark LEFT JOIN best ON item_id = query_id"""


COS, JAC = "CASE WHEN d2 * q2 > 0 THEN dot / (sqrt(d2) * sqrt(q2)) END", "CASE WHEN d2 + q2 - dot <> 0 THEN dot / (d2 + q2 - dot) END"


def _bm25(words: str, queries: str) -> str:
    """CTEs up to sc(query_id, doc_id, score). words: SELECT of doc_id, ws; queries: SELECT of query_id, text."""
    return f"""ws AS ({words}), qs AS ({queries}), p AS (SELECT doc_id, word, count(*) AS tf FROM (SELECT doc_id, unnest(ws) AS word FROM ws) GROUP BY ALL),
st AS (SELECT count(*) AS n_docs, avg(len(ws)) AS avg_len FROM ws), ln AS (SELECT doc_id, len(ws) AS doc_len FROM ws),
idf AS (SELECT word, ln(n_docs / df) AS idf FROM (SELECT word, count(*) AS df FROM p GROUP BY ALL), st),
q AS (SELECT query_id, word, count(*) AS qtf FROM (SELECT query_id, unnest({WORDS.format('text')}) AS word FROM qs) GROUP BY ALL),
sc AS (SELECT query_id, doc_id, round(sum(idf * 2.5 * tf / (1.5 * (0.25 + 0.75 * doc_len / avg_len) + tf) * 2.5 * qtf / (1.5 + qtf)), 6) AS score
FROM p JOIN q USING (word) JOIN idf USING (word) JOIN ln USING (doc_id), st GROUP BY ALL)"""


DOC_WORDS = f"SELECT doc_id, {WORDS.format('text')} AS ws FROM documents"
ITEM_QUERIES = "SELECT item_id AS query_id, text FROM benchmark"
ARTICLE = f"""art AS (SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN DATE '0001-01-01' ELSE DATE '2021-01-01' + CAST((doc_id * 37) % 1200 AS INTEGER) END AS date,
{WORDS.format("concat_ws(' ', lang, source)")} AS tw, {WORDS.format('text')} AS bw, source, lang FROM documents)"""
TOP_TEN = f"""WITH {_bm25(DOC_WORDS, ITEM_QUERIES)} SELECT query_id, doc_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank
FROM sc QUALIFY rank <= 10"""
STOP_LIST = ", ".join(f"'{w}'" for w in STOP)

ORACLE_SQL = {
    "tokenize_docs": f"SELECT doc_id, CAST(generate_subscripts(ws, 1) - 1 AS INTEGER) AS pos, unnest(ws) AS word FROM ({DOC_WORDS})",
    "stopword_filter": f"""SELECT doc_id, CAST(generate_subscripts(k, 1) - 1 AS INTEGER) AS pos, unnest(k) AS word
FROM (SELECT doc_id, list_filter(ws, lambda w: w NOT IN ({STOP_LIST})) AS k FROM ({DOC_WORDS}))""",
    "bigrams": f"""SELECT DISTINCT doc_id, bigram FROM (SELECT doc_id, word || lead(word) OVER (PARTITION BY doc_id ORDER BY pos) AS bigram
FROM (SELECT doc_id, generate_subscripts(ws, 1) AS pos, unnest(ws) AS word FROM ({DOC_WORDS}))) WHERE bigram IS NOT NULL""",
    "term_freq": f"WITH {TF} SELECT doc_id, word, tf FROM tf",
    "doc_freq": f"WITH {TF} SELECT word, df FROM df",
    "corpus_stats": f"SELECT count(*) AS n_docs, CAST(sum(len(ws)) AS BIGINT) AS n_tokens, round(avg(len(ws)), 6) AS avg_len FROM ({DOC_WORDS})",
    "vsm_weights": f"WITH {VSM} SELECT doc_id, word, round(weight, 6) AS weight FROM w",
    "sk_tfidf": f"""WITH {TF}, {N}, r AS (SELECT doc_id, word, tf * (ln((1 + n_docs) / (1 + df)) + 1) AS x FROM tf JOIN df USING (word), n),
m AS (SELECT doc_id, sqrt(sum(x * x)) AS norm FROM r GROUP BY ALL) SELECT doc_id, word, round(x / norm, 6) AS weight FROM r JOIN m USING (doc_id)""",
    "vsm_dot": _vsm_sql("dot"),
    "vsm_cos": _vsm_sql(COS),
    "vsm_jac": _vsm_sql(JAC),
    "retrieval_accuracy": f"""WITH best AS ({_vsm_sql("dot")}), gold AS (SELECT DISTINCT item_id AS query_id FROM documents d, benchmark b WHERE contains(d.text, b.text))
SELECT count(*) AS n, round(avg(CAST(coalesce(contains(d.text, b.text), false) AS INTEGER)), 6) AS accuracy
FROM best JOIN gold USING (query_id) LEFT JOIN documents d USING (doc_id) JOIN benchmark b ON b.item_id = query_id""",
    "bm25_fit": f"WITH {TF}, {N} SELECT word, round(ln(n_docs / df), 6) AS idf FROM df, n",
    "bm25_doc_len": f"WITH {N} SELECT doc_id, len(ws) AS doc_len, round(len(ws) / avg_len, 6) AS relative_len FROM ({DOC_WORDS}), n",
    "bm25_topk": TOP_TEN,
    "index_roundtrip": TOP_TEN,
    "bm25_all_docs": f"""WITH {_bm25(DOC_WORDS, ITEM_QUERIES)} SELECT item_id AS query_id, d.doc_id, coalesce(score, 0) AS score
FROM benchmark CROSS JOIN documents d LEFT JOIN sc ON sc.query_id = item_id AND sc.doc_id = d.doc_id""",
    "role_search": f"""WITH {ARTICLE}, {_bm25("SELECT doc_id, tw || bw AS ws FROM art", ITEM_QUERIES)},
r AS (SELECT item_id AS query_id, CASE item_id % 4 WHEN 0 THEN DATE '0001-01-01' WHEN 1 THEN DATE '2021-01-31' WHEN 2 THEN DATE '2023-01-31' ELSE DATE '2023-12-31' END AS first_date FROM benchmark)
SELECT r.query_id, doc_id, coalesce(score, 0) AS score, date, CAST(row_number() OVER (PARTITION BY r.query_id ORDER BY coalesce(score, 0) DESC, doc_id) AS INTEGER) AS rank
FROM r JOIN art ON date >= first_date LEFT JOIN sc USING (query_id, doc_id) QUALIFY rank <= 10""",
    "file_search": f"""WITH {ARTICLE}, f AS (SELECT doc_id, unnest(list_distinct(['report ' || source || '.pdf', lang || ' notes.doc'])) AS file_name, tw FROM art),
{_bm25(f"SELECT (doc_id, file_name) AS doc_id, tw || {WORDS.format('file_name')} AS ws FROM f",
       "SELECT * FROM (VALUES (1, 'report en src3'), (2, 'notes'), (3, 'fr pdf'), (4, 'nothing here'), (5, 'src1 src2 report')) v(query_id, text)")}
SELECT CAST(query_id AS BIGINT) AS query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id[1], doc_id[2]) AS INTEGER) AS rank,
doc_id[1] AS doc_id, doc_id[2] AS file_name, score FROM sc QUALIFY rank <= 10""",
    "role_resolution": """SELECT c_custkey, role, CASE role WHEN 'Administrator' THEN DATE '0001-01-01' WHEN 'VerifiedUser' THEN DATE '2021-01-31'
WHEN 'SignedUser' THEN DATE '2023-01-31' WHEN 'Guest' THEN DATE '2023-12-31' END AS first_date FROM (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'Guest'
WHEN c_custkey % 5 = 0 THEN 'VerifiedUser' WHEN c_custkey % 7 = 0 THEN 'Administrator' ELSE 'SignedUser' END AS role FROM customer)""",
    "snippet": "SELECT doc_id, CASE WHEN length(text) > 33 THEN substring(text, 1, 30) || '......' ELSE text END AS snippet FROM documents",
    "corpus_dedup": "SELECT source, lang, doc_id, n_chars FROM documents QUALIFY row_number() OVER (PARTITION BY source, lang ORDER BY doc_id DESC) = 1",
    "replicate_rows": "SELECT doc_id, lang FROM documents, range(3)",
    "dense_similarity": """WITH j AS (SELECT a.vec_id, CAST(a.embedding AS DOUBLE[]) AS x, CAST(b.embedding AS DOUBLE[]) AS y FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1),
s AS (SELECT vec_id, list_inner_product(x, y) AS d, list_inner_product(x, x) AS a, list_inner_product(y, y) AS b FROM j)
SELECT vec_id, round(d, 5) AS dot, round(CASE WHEN a * b > 0 THEN d / (sqrt(a) * sqrt(b)) ELSE 0 END, 5) AS cos, round(CASE WHEN a + b - d <> 0 THEN d / (a + b - d) ELSE 0 END, 5) AS jac FROM s""",
    "marked_tokens": r"""SELECT doc_id, CAST(generate_subscripts(ws, 1) - 1 AS INTEGER) AS pos, unnest(ws) AS word
FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]') AS ws FROM documents)""",
    "containing": "SELECT item_id AS query_id, doc_id FROM documents d, benchmark b WHERE contains(d.text, b.text)",
    "segmented_articles": f"""WITH {ARTICLE}, f AS (SELECT doc_id, tw, len(bw) AS n, unnest(list_distinct(['report ' || source || '.pdf', lang || ' notes.doc'])) AS file_name FROM art)
SELECT doc_id, array_to_string(tw, ' ') AS title, CAST(n AS INTEGER) AS n_words, file_name, array_to_string({WORDS.format('file_name')}, ' ') AS file_words FROM f""",
    "result_cards": f"""WITH {ARTICLE}, {_bm25("SELECT doc_id, tw || bw AS ws FROM art", ITEM_QUERIES)},
top AS (SELECT item_id AS query_id, art.*, CAST(row_number() OVER (PARTITION BY item_id ORDER BY coalesce(score, 0) DESC, art.doc_id) AS INTEGER) AS rank
FROM benchmark CROSS JOIN art LEFT JOIN sc ON sc.query_id = item_id AND sc.doc_id = art.doc_id QUALIFY rank <= 10)
SELECT query_id, rank, CASE WHEN doc_id % 11 = 0 THEN 'http://news.example.com/' || doc_id ELSE 'http://news.example.com/article/' || strftime(top.date, '%Y/%m/%d') || '/' || doc_id END AS url,
top.lang || ' ' || top.source AS title, CASE WHEN length(text) > 33 THEN substring(text, 1, 30) || '......' ELSE text END AS snippet,
CASE WHEN doc_id % 11 = 0 THEN '0001-01-01' ELSE strftime(top.date, '%Y-%m-%d') END AS date FROM top JOIN documents USING (doc_id)""",
    "json_roundtrip": "SELECT * FROM documents",
    "labelled_roundtrip": "SELECT upper(lang) AS label, 'who wrote ' || source || ' ' || doc_id AS question FROM documents, range(2)",
    "qa_pipeline": f"""WITH b AS ({_vsm_sql(COS)}), p AS (SELECT query_id AS qid, doc_id, {WORDS.format('i.text')} AS q,
list_filter(list_transform(regexp_split_to_array(coalesce(d.text, ''), '[\\n.]'), lambda s: trim(s)), lambda s: s <> '') AS ss
FROM b JOIN documents d USING (doc_id) JOIN benchmark i ON i.item_id = query_id),
c AS (SELECT qid, doc_id, q, CAST(generate_subscripts(ss, 1) - 1 AS INTEGER) AS sent_no, unnest(ss) AS s FROM p),
f AS (SELECT *, CAST(round(CASE WHEN len(a) > 0 THEN len(list_filter(q, lambda w: list_contains(a, w))) / len(a) ELSE 0 END, 6) AS DOUBLE) AS score FROM (SELECT *, {WORDS.format('s')} AS a FROM c)),
t AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score DESC, sent_no) = 1),
o AS (SELECT *, CASE WHEN contains(s, ':') THEN split_part(s, ':', 2) ELSE s END AS s1 FROM t)
SELECT qid, doc_id, sent_no, score, CASE WHEN contains(s1, '：') THEN split_part(s1, '：', 2) ELSE s1 END AS answer FROM o""",
}
