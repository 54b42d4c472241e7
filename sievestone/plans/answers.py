"""Queries over conversations and generated strings: question answering and its metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievestone.functions.strings import common_subsequence, common_substring
from sievestone.functions.text import tokens
from sievestone.operators import metrics, qa
from sievestone.operators.ingest import held_out
from sievestone.session import materialize, table

DICTIONARY = ("订单", "星期三", "送达", "没有", "日期", "大约", "前后", "之间")
CHINESE_NAMES = {"订单": "nz", "星期三": "t"}
NAMES = {"the": "nr", "of": "ns", "and": "nt", "that": "f"}
FUNCTION_WORDS = {"the": "u", "of": "p", "and": "c", "that": "c", "this": "u", "in": "p", "on": "p", "is": "n", "not": "d"}


def _qa(spark: SparkSession, d: str) -> DataFrame:
    return qa.turns_to_qa(table(spark, d, "conversations"))


def _labelled(spark: SparkSession, d: str) -> DataFrame:
    rows = qa.candidates(_qa(spark, d))
    return qa.label_candidates(rows, rows.where("sent_no = 0"))


def qa_pairs(spark: SparkSession, d: str) -> DataFrame:
    return _qa(spark, d)


def qa_candidates(spark: SparkSession, d: str) -> DataFrame:
    return qa.candidates(_qa(spark, d)).select("qid", "sent_no", "sentence")


def label_sentences(spark: SparkSession, d: str) -> DataFrame:
    return _labelled(spark, d).select("qid", "sent_no", "rank")


def _basic(spark: SparkSession, d: str) -> DataFrame:
    rows = _labelled(spark, d)
    f = qa.basic_features(tokens(F.col("question")), tokens(F.col("sentence")))
    return rows.select("qid", "sent_no", "rank", *[c.alias(n) for n, c in f.items()])


def features_basic(spark: SparkSession, d: str) -> DataFrame:
    return _basic(spark, d).select("qid", "sent_no", "n_answer", "len_diff", F.round("unigram", 6).alias("unigram"), F.round("bigram", 6).alias("bigram"))


def features_all(spark: SparkSession, d: str) -> DataFrame:
    return qa.all_features(_labelled(spark, d), "question", "sentence", names=FUNCTION_WORDS).select("qid", "sent_no", "rank", "features")


def features_content(spark: SparkSession, d: str) -> DataFrame:
    """Words and content words of the sentences that a selector chooses among: those of two words and more."""
    rows = qa.candidates(_qa(spark, d)).withColumn("a", tokens(F.col("sentence"))).where(F.size("a") > 1)
    return rows.select("qid", "sent_no", F.size("a").alias("n_answer"), qa.content_words(F.col("a"), FUNCTION_WORDS).alias("n_content"))


def retagged_words(spark: SparkSession, d: str) -> DataFrame:
    """Sentences cut into letters, then joined, cut by the dictionary and tagged."""
    tagged = qa.rejoin_and_tag(F.split("sentence", ""), DICTIONARY, CHINESE_NAMES, ("于", "从"))
    return _dated(spark, d).select("o_orderkey", F.posexplode(tagged).alias("pos", "t")).select("o_orderkey", "pos", "t.word", "t.tag")


def svmlight_export(spark: SparkSession, d: str) -> DataFrame:
    features = F.array(*[F.col(c).cast("double") for c in ("n_answer", "len_diff", "unigram", "bigram")])
    return _basic(spark, d).select("qid", "sent_no", qa.svmlight(F.col("rank"), F.col("qid"), features).alias("line"))


def svmlight_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    lines = svmlight_export(spark, d)
    got = lines.select("sent_no", *[c.alias(n) for n, c in qa.parse_svmlight(F.col("line")).items()])
    return got.select("qid", "sent_no", "rank", *[F.round(F.get("features", F.lit(i)), 6).alias(f"f{i + 1}") for i in range(4)])


def lcs_substring(spark: SparkSession, d: str) -> DataFrame:
    return _qa(spark, d).select("qid", common_substring("question", "passage").alias("size"))


def lcs_subsequence(spark: SparkSession, d: str) -> DataFrame:
    return _qa(spark, d).select("qid", common_subsequence("question", "passage").alias("size"))


def edit_distance(spark: SparkSession, d: str) -> DataFrame:
    ascii_only = lambda c: F.regexp_replace(c, r"[^\x00-\x7F]", "?")
    a, b = ascii_only("question"), ascii_only("sentence")
    return qa.candidates(_qa(spark, d)).select("qid", "sent_no", F.levenshtein(a, b).alias("distance"), F.levenshtein(a, b, 2).alias("within_two"))


def _overlap(spark: SparkSession, d: str, strip: bool = False) -> DataFrame:
    return metrics.letter_overlap(_qa(spark, d), ["qid"], "question", "passage", strip)


def char_prf1(spark: SparkSession, d: str) -> DataFrame:
    m = metrics.precision_recall_f1(_overlap(spark, d), ["qid"])
    return m.select("qid", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


def bleu1(spark: SparkSession, d: str) -> DataFrame:
    return metrics.bleu1(_overlap(spark, d, True), ["qid"]).select("qid", F.round("bleu1", 6).alias("bleu1"))


def mean_scores(spark: SparkSession, d: str) -> DataFrame:
    m = metrics.precision_recall_f1(_overlap(spark, d), ["qid"]).join(metrics.bleu1(_overlap(spark, d, True), ["qid"]), "qid")
    return m.agg(F.count("*").alias("n"), F.round(F.avg("f1"), 6).alias("f1"), F.round(F.avg("bleu1"), 6).alias("bleu1"))


def exact_match(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select(F.col("o_orderstatus").alias("p"), F.substring("o_orderpriority", 3, 1).alias("g"))
    return metrics.exact_match(rows, "p", "g").select(F.round("exact_match", 6).alias("exact_match"))


def selector_accuracy(spark: SparkSession, d: str) -> DataFrame:
    rows = _basic(spark, d).withColumn("score", F.round("unigram", 6))
    return qa.selector_accuracy(rows).select(F.round("accuracy", 6).alias("accuracy"))


def top_sentences(spark: SparkSession, d: str) -> DataFrame:
    rows = _basic(spark, d).withColumn("score", F.round("unigram", 6))
    return qa.top_sentences(rows, 3).select("qid", "place", "sent_no", "score")


def _dated(spark: SparkSession, d: str) -> DataFrame:
    day = F.col("o_orderdate")
    full = F.concat(F.lit("订单于"), F.date_format(day, "yyyy年M月d日"), F.lit("星期三送达"))
    dashed = F.concat(F.lit("从"), F.date_format(day, "yyyy"), F.lit("年到"), F.date_format(day, "yyyy"), F.lit("年之间"))
    month = F.concat(F.lit("大约"), F.date_format(day, "M月"), F.lit("前后"))
    plain = F.concat(F.lit("没有日期 "), F.col("o_orderpriority"))
    kinds = ("TIME_YEAR", "TIME_MONTH", "TIME_DAY", "TIME_WEEK", "TIME_RANGE", "TIME_OTHER")
    kind = F.element_at(F.array(*[F.lit(k) for k in kinds]), (F.pmod("o_orderkey", F.lit(6)) + 1).cast("int"))
    s = F.element_at(F.array(full, dashed, month, plain), (F.pmod(F.floor(F.col("o_orderkey") / 6), F.lit(4)) + 1).cast("int"))
    return table(spark, d, "orders").select("o_orderkey", kind.alias("kind"), s.alias("sentence"))


def tagged_words(spark: SparkSession, d: str) -> DataFrame:
    tagged = qa.cut_and_tag(F.col("sentence"), DICTIONARY, CHINESE_NAMES, ("于", "从"))
    return _dated(spark, d).select("o_orderkey", F.posexplode(tagged).alias("pos", "t")).select("o_orderkey", "pos", "t.word", "t.tag")


def span_time(spark: SparkSession, d: str) -> DataFrame:
    return _dated(spark, d).select("o_orderkey", qa.time_span(F.col("kind"), F.col("sentence")).alias("answer"))


def _coloned() -> Column:
    return F.concat_ws("", F.when(F.col("o_orderkey") % 3 != 0, F.concat(F.col("o_orderstatus"), F.lit(":"))), F.col("o_orderpriority"), F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("："), F.col("o_orderkey").cast("string"), F.lit(":x"))))


def span_colon(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", qa.colon_trim(_coloned()).alias("answer"))


def span_dispatch(spark: SparkSession, d: str) -> DataFrame:
    """Classes TIME and others alone: no tags are needed."""
    kind = F.when(F.col("o_orderkey") % 5 == 0, F.lit("DES_OTHER")).otherwise(F.col("kind"))
    rows = _dated(spark, d).join(table(spark, d, "orders").select("o_orderkey", _coloned().alias("coloned")), "o_orderkey")
    none = F.array().cast("array<struct<word:string,tag:string>>")
    sentence = F.when(F.col("o_orderkey") % 5 == 0, F.col("coloned")).otherwise(F.col("sentence"))
    return rows.select("o_orderkey", qa.answer_span(kind, sentence, none).alias("answer"))


def span_entities(spark: SparkSession, d: str) -> DataFrame:
    """Tagged words of candidate sentences: person, place and number answers."""
    rows = qa.candidates(_qa(spark, d)).withColumn("tagged", qa.tag_words(tokens(F.col("sentence")), NAMES))
    kinds = [qa.answer_span(F.lit(k), F.col("sentence"), F.col("tagged")).alias(k.lower()) for k in ("HUM", "LOC", "NUM")]
    return rows.select("qid", "sent_no", *kinds)


def grouped_split(spark: SparkSession, d: str) -> DataFrame:
    return _labelled(spark, d).select("qid", "sent_no", held_out(F.col("qid")).alias("validation"))


def question_classifier(spark: SparkSession, d: str) -> DataFrame:
    """Accuracy of language prediction on held-out documents."""
    rows = table(spark, d, "documents").select("doc_id", "text", F.col("lang").alias("label"))
    test = held_out(F.col("doc_id"), 20)
    found = qa.classify(rows.where(test), qa.fit_classifier(rows.where(~test)))
    return metrics.accuracy(found, "predicted", "label").select(F.round("accuracy", 6).alias("accuracy"))


def question_classifier_grid(spark: SparkSession, d: str) -> DataFrame:
    """The same for labelled quality, C chosen by cross-validation."""
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").select("doc_id", "text", F.col("quality").cast("string").alias("label"))
    test = held_out(F.col("doc_id"), 20)
    found = qa.classify(rows.where(test), qa.fit_classifier(rows.where(~test), c_grid=(1.0, 100.0), folds=2, features=1 << 10))
    return metrics.accuracy(found, "predicted", "label").select(F.round("accuracy", 6).alias("accuracy"))


def pairwise_ranker(spark: SparkSession, d: str) -> DataFrame:
    rows = _basic(spark, d).select("qid", "sent_no", "rank", F.array(*[F.col(c).cast("double") for c in ("n_answer", "len_diff", "unigram", "bigram")]).alias("features"))
    rows = materialize(rows, "ranker")  # training passes over it again and again
    scored = rows.withColumn("score", qa.rank_score(F.col("features"), qa.fit_ranker(rows)))
    return qa.top_sentences(scored, 1).select("qid", "sent_no", "rank", F.round("score", 6).alias("score"))


QUERIES = {
    "qa_pairs": qa_pairs,
    "qa_candidates": qa_candidates,
    "label_sentences": label_sentences,
    "features_basic": features_basic,
    "features_all": features_all,
    "features_content": features_content,
    "svmlight_export": svmlight_export,
    "svmlight_roundtrip": svmlight_roundtrip,
    "lcs_substring": lcs_substring,
    "lcs_subsequence": lcs_subsequence,
    "edit_distance": edit_distance,
    "char_prf1": char_prf1,
    "bleu1": bleu1,
    "mean_scores": mean_scores,
    "exact_match": exact_match,
    "selector_accuracy": selector_accuracy,
    "top_sentences": top_sentences,
    "tagged_words": tagged_words,
    "retagged_words": retagged_words,
    "span_time": span_time,
    "span_colon": span_colon,
    "span_dispatch": span_dispatch,
    "span_entities": span_entities,
    "grouped_split": grouped_split,
    "question_classifier": question_classifier,
    "question_classifier_grid": question_classifier_grid,
    "pairwise_ranker": pairwise_ranker,
}

# --- DuckDB ----------------------------------------------------------------------------------------------------------------

WORDS = r"regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}_]+')"
QA = """qa AS (SELECT q.conv_id * 1000 + q.turn AS qid, q.conv_id, q.turn, q.text AS question, a.text AS passage
FROM conversations q JOIN conversations a ON a.conv_id = q.conv_id AND a.turn = q.turn + 1 WHERE q.role = 'user' AND a.role = 'assistant')"""
CAND = f"""{QA}, parts AS (SELECT qid, question, list_filter(list_transform(regexp_split_to_array(coalesce(passage, ''), '[\\n.]'), lambda s: trim(s)), lambda s: s <> '') AS ss FROM qa),
cand AS (SELECT qid, question, CAST(generate_subscripts(ss, 1) - 1 AS INTEGER) AS sent_no, unnest(ss) AS sentence FROM parts),
lab AS (SELECT c.*, CASE WHEN (qid, sentence) IN (SELECT (qid, sentence) FROM cand WHERE sent_no = 0) THEN 3 ELSE 0 END AS rank FROM cand c)"""
FEAT = f"""{CAND}, ws AS (SELECT *, {WORDS.format('question')} AS q, {WORDS.format('sentence')} AS a FROM lab),
bg AS (SELECT *, list_transform(range(1, len(q)), lambda i: q[i] || q[i + 1]) AS qb, list_transform(range(1, len(a)), lambda i: a[i] || a[i + 1]) AS ab FROM ws),
feat AS (SELECT qid, sent_no, rank, CAST(len(a) AS INTEGER) AS n_answer, CAST(abs(len(q) - len(a)) AS INTEGER) AS len_diff,
CASE WHEN len(a) > 0 THEN len(list_filter(q, lambda w: list_contains(a, w))) / len(a) ELSE 0 END AS unigram,
len(list_filter(qb, lambda w: list_contains(ab, w))) / (1 + len(a)) AS bigram FROM bg)"""


def _overlap_sql(strip: bool) -> str:
    text = (lambda c: f"regexp_replace(coalesce({c}, ''), '\\s', '', 'g')") if strip else (lambda c: f"coalesce({c}, '')")
    return f"""{QA}, ch AS (SELECT qid, 0 AS side, unnest(string_split({text('question')}, '')) AS c FROM qa UNION ALL SELECT qid, 1, unnest(string_split({text('passage')}, '')) FROM qa),
cn AS (SELECT qid, c, count(*) FILTER (side = 0) AS p, count(*) FILTER (side = 1) AS g FROM ch WHERE c <> '' GROUP BY ALL),
ov AS (SELECT qa.qid, coalesce(sum(least(p, g)), 0) AS same, coalesce(sum(p), 0) AS n_pred, coalesce(sum(g), 0) AS n_gold FROM qa LEFT JOIN cn USING (qid) GROUP BY ALL)"""


PRF = """prf AS (SELECT qid, CASE WHEN n_pred > 0 THEN same / n_pred ELSE 0 END AS precision, CASE WHEN n_gold > 0 THEN same / n_gold ELSE 0 END AS recall,
CASE WHEN same > 0 THEN 2.0 * (same / n_pred) * (same / n_gold) / (same / n_pred + same / n_gold) ELSE 0 END AS f1 FROM ov)"""
BLEU = "CASE WHEN same > 0 THEN same / n_pred * CASE WHEN n_pred > n_gold THEN 1 ELSE exp(1 - n_gold / n_pred) END ELSE 0 END"
ANY = " ".join(f"WHEN regexp_matches(s, '{p}') THEN regexp_extract(s, '{p}')" for p in qa.TIME_ANY)
NAMED = " ".join(f"WHEN kind = '{k}' AND regexp_matches(s, '{p}') THEN regexp_extract(s, '{p}')" for k, p in qa.TIME.items())
DATED = """dated AS (SELECT o_orderkey, (['TIME_YEAR', 'TIME_MONTH', 'TIME_DAY', 'TIME_WEEK', 'TIME_RANGE', 'TIME_OTHER'])[o_orderkey % 6 + 1] AS kind,
CASE (o_orderkey // 6) % 4 WHEN 0 THEN '订单于' || strftime(o_orderdate, '%Y年%-m月%-d日') || '星期三送达' WHEN 1 THEN '从' || strftime(o_orderdate, '%Y') || '年到' || strftime(o_orderdate, '%Y') || '年之间'
WHEN 2 THEN '大约' || strftime(o_orderdate, '%-m月') || '前后' ELSE '没有日期 ' || o_orderpriority END AS s FROM orders)"""
COLONED = """col AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderstatus || ':' ELSE '' END || o_orderpriority || CASE WHEN o_orderkey % 2 = 0 THEN '：' || o_orderkey || ':x' ELSE '' END AS c FROM orders),
one AS (SELECT o_orderkey, CASE WHEN contains(c, ':') THEN split_part(c, ':', 2) ELSE c END AS c FROM col), trimmed AS (SELECT o_orderkey, CASE WHEN contains(c, '：') THEN split_part(c, '：', 2) ELSE c END AS c FROM one)"""
TIME_SQL = f"CASE {NAMED} {ANY} ELSE s END"
ASCII = r"regexp_replace({0}, '[^\x00-\x7F]', '?', 'g')"


def _names(words) -> str:
    return ", ".join(f"'{w}'" for w in sorted(words))


def _tag_sql(names: dict[str, str]) -> str:
    """The tag of a word x."""
    return f"""CASE {' '.join(f"WHEN x = '{w}' THEN '{t}'" for w, t in names.items())} WHEN regexp_matches(x, '^[\\p{{Nd}}\\p{{No}}]') THEN 'm'
WHEN x IN ({_names(qa.UNIT_WORDS)}) THEN 'q' WHEN regexp_matches(x, '^[\\p{{L}}\\p{{N}}]') THEN 'n' ELSE 'w' END"""


SCORED = f"{FEAT}, sc AS (SELECT *, round(unigram, 6) AS score, row_number() OVER (PARTITION BY qid ORDER BY round(unigram, 6) DESC, sent_no) AS place FROM feat)"

ORACLE_SQL = {
    "qa_pairs": f"WITH {QA} SELECT * FROM qa",
    "qa_candidates": f"WITH {CAND} SELECT qid, sent_no, sentence FROM cand",
    "label_sentences": f"WITH {CAND} SELECT qid, sent_no, rank FROM lab",
    "features_basic": f"WITH {FEAT} SELECT qid, sent_no, n_answer, len_diff, CAST(round(unigram, 6) AS DOUBLE) AS unigram, CAST(round(bigram, 6) AS DOUBLE) AS bigram FROM feat",
    "svmlight_export": f"""WITH {FEAT} SELECT qid, sent_no, rank || ' qid:' || qid || ' 1:' || printf('%.6f', CAST(n_answer AS DOUBLE)) || ' 2:' || printf('%.6f', CAST(len_diff AS DOUBLE)) ||
' 3:' || printf('%.6f', CAST(unigram AS DOUBLE)) || ' 4:' || printf('%.6f', CAST(bigram AS DOUBLE)) AS line FROM feat""",
    "svmlight_roundtrip": f"""WITH {FEAT} SELECT qid, sent_no, rank, CAST(n_answer AS DOUBLE) AS f1, CAST(len_diff AS DOUBLE) AS f2, CAST(round(unigram, 6) AS DOUBLE) AS f3,
CAST(round(bigram, 6) AS DOUBLE) AS f4 FROM feat""",
    "lcs_substring": f"""WITH {QA}, x AS (SELECT qid, generate_subscripts(c, 1) AS i, unnest(c) AS ch FROM (SELECT qid, string_split(question, '') AS c FROM qa)),
y AS (SELECT qid, generate_subscripts(c, 1) AS j, unnest(c) AS ch FROM (SELECT qid, string_split(passage, '') AS c FROM qa)),
m AS (SELECT qid, i - j AS diagonal, i - row_number() OVER (PARTITION BY qid, i - j ORDER BY i) AS island FROM x JOIN y USING (qid, ch)),
r AS (SELECT qid, max(n) AS n FROM (SELECT qid, count(*) AS n FROM m GROUP BY qid, diagonal, island) GROUP BY ALL)
SELECT qa.qid, CAST(coalesce(n, 0) AS INTEGER) AS size FROM qa LEFT JOIN r USING (qid)""",
    # a row of the table of common lengths for each letter of the question: the greatest of what an equal letter or none gives
    "lcs_subsequence": f"""WITH RECURSIVE {QA}, x AS (SELECT qid, generate_subscripts(c, 1) AS i, unnest(c) AS ch FROM (SELECT qid, string_split(question, '') AS c FROM qa)),
y AS (SELECT qid, generate_subscripts(c, 1) AS j, unnest(c) AS ch FROM (SELECT qid, string_split(passage, '') AS c FROM qa)),
t(qid, i, j, ch, v) AS (SELECT qid, CAST(0 AS BIGINT), CAST(j AS BIGINT), ch, 0 FROM y UNION ALL SELECT s.qid, s.i, s.j, s.ch, max(s.w) OVER (PARTITION BY s.qid ORDER BY s.j) FROM
(SELECT t.qid, x.i, t.j, t.ch, CASE WHEN x.ch = t.ch THEN 1 + coalesce(lag(t.v) OVER (PARTITION BY t.qid ORDER BY t.j), 0) ELSE t.v END AS w FROM t JOIN x ON x.qid = t.qid AND x.i = t.i + 1) s),
m AS (SELECT qid, max(v) AS v FROM t GROUP BY ALL) SELECT qa.qid, CAST(coalesce(v, 0) AS INTEGER) AS size FROM qa LEFT JOIN m USING (qid)""",
    "span_entities": f"""WITH {CAND}, w AS (SELECT qid, sent_no, sentence, {WORDS.format('sentence')} AS ws FROM cand),
g AS (SELECT *, list_transform(ws, lambda x: {_tag_sql(NAMES)}) AS tags FROM w),
e AS (SELECT *, list_reduce(list_transform(list_filter(list_zip(ws, tags), lambda p: p[2] IN ({_names(qa.PERSON_TAGS)})), lambda p: p[1]), lambda acc, v: CASE WHEN contains(acc, v) THEN acc ELSE acc || v END, '') AS hum,
list_reduce(list_transform(list_filter(list_zip(ws, tags), lambda p: p[2] IN ({_names(qa.PLACE_TAGS)})), lambda p: p[1]), lambda acc, v: CASE WHEN contains(acc, v) THEN acc ELSE acc || v END, '') AS loc,
list_filter(range(1, len(ws)), lambda i: tags[i] = 'm' AND tags[i + 1] = 'q') AS hits FROM g)
SELECT qid, sent_no, CASE WHEN hum <> '' THEN hum ELSE sentence END AS hum, CASE WHEN loc <> '' THEN loc ELSE sentence END AS loc,
CASE WHEN len(hits) > 0 THEN ws[hits[1]] || ws[hits[1] + 1] ELSE sentence END AS num FROM e""",
    "grouped_split": f"WITH {CAND} SELECT qid, sent_no, CAST('0x' || substr(md5(CAST(qid AS VARCHAR)), 1, 8) AS BIGINT) % 100 < 10 AS validation FROM lab",
    "edit_distance": f"""WITH {CAND}, e AS (SELECT qid, sent_no, CAST(levenshtein({ASCII.format('question')}, {ASCII.format('sentence')}) AS INTEGER) AS distance FROM cand)
SELECT *, CASE WHEN distance <= 2 THEN distance ELSE -1 END AS within_two FROM e""",
    "char_prf1": f"WITH {_overlap_sql(False)}, {PRF} SELECT qid, CAST(round(precision, 6) AS DOUBLE) AS precision, CAST(round(recall, 6) AS DOUBLE) AS recall, CAST(round(f1, 6) AS DOUBLE) AS f1 FROM prf",
    "bleu1": f"WITH {_overlap_sql(True)} SELECT qid, CAST(round({BLEU}, 6) AS DOUBLE) AS bleu1 FROM ov",
    "mean_scores": f"""SELECT count(*) AS n, CAST(round(avg(f1), 6) AS DOUBLE) AS f1, CAST(round(avg(b), 6) AS DOUBLE) AS bleu1 FROM
(WITH {_overlap_sql(False)}, {PRF} SELECT qid, f1 FROM prf) JOIN (WITH {_overlap_sql(True)} SELECT qid, {BLEU} AS b FROM ov) USING (qid)""",
    "exact_match": "SELECT round(avg(CAST(o_orderstatus = substring(o_orderpriority, 3, 1) AS INTEGER)), 6) AS exact_match FROM orders",
    "selector_accuracy": f"""WITH {SCORED}, g AS (SELECT qid, max(rank) AS gold FROM feat GROUP BY ALL HAVING max(rank) > 0)
SELECT round(avg(CAST(rank = gold AS INTEGER)), 6) AS accuracy FROM sc JOIN g USING (qid) WHERE place = 1""",
    "top_sentences": f"WITH {SCORED} SELECT qid, CAST(place AS INTEGER) AS place, sent_no, CAST(score AS DOUBLE) AS score FROM sc WHERE place <= 3",
    "tagged_words": f"""WITH {DATED}, w AS (SELECT o_orderkey, list_filter(regexp_extract_all(s, '{'|'.join(sorted(DICTIONARY, key=len, reverse=True))}|[0-9A-Za-z_]+|[^\\s]'), lambda x: x NOT IN ('于', '从')) AS ws FROM dated),
e AS (SELECT o_orderkey, CAST(generate_subscripts(ws, 1) - 1 AS INTEGER) AS pos, unnest(ws) AS x FROM w) SELECT o_orderkey, pos, x AS word, {_tag_sql(CHINESE_NAMES)} AS tag FROM e""",
    "features_content": f"""WITH {CAND}, w AS (SELECT qid, sent_no, {WORDS.format('sentence')} AS ws FROM cand)
SELECT qid, sent_no, CAST(len(ws) AS INTEGER) AS n_answer, CAST(len(list_filter(ws, lambda x: {_tag_sql(FUNCTION_WORDS)} NOT IN ({_names(qa.FUNCTION_TAGS)}))) AS INTEGER) AS n_content FROM w WHERE len(ws) > 1""",
    "span_time": f"WITH {DATED} SELECT o_orderkey, {TIME_SQL} AS answer FROM dated",
    "span_colon": f"WITH {COLONED} SELECT o_orderkey, c AS answer FROM trimmed",
    "span_dispatch": f"WITH {DATED}, {COLONED} SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN c ELSE {TIME_SQL} END AS answer FROM dated JOIN trimmed USING (o_orderkey)",
}
ORACLE_SQL["retagged_words"] = ORACLE_SQL["tagged_words"]
