"""Question answering: candidate sentences, features, ranking, classification, answer spans."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LinearSVC, LogisticRegression
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import IDF, CountVectorizerModel, IndexToString, Normalizer, StringIndexer, VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.ml.tuning import CrossValidator, CrossValidatorModel, ParamGridBuilder
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievestone.functions.segment import segment
from sievestone.functions.strings import common_subsequence, common_substring
from sievestone.functions.text import bigrams, sentences, tokens, without_stop_words
from sievestone.functions.vectors import cosine, inner_product, tanimoto
from sievestone.session import materialize

# --- candidates ------------------------------------------------------------------------------------------------------------


def turns_to_qa(conversations: DataFrame) -> DataFrame:
    """(qid, conv_id, turn, question, passage): a user's turn and the assistant's next one."""
    q = conversations.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"))
    a = conversations.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("passage"))
    return q.join(a, ["conv_id", "turn"]).select((F.col("conv_id") * 1000 + F.col("turn")).alias("qid"), "conv_id", "turn", "question", "passage")


def candidates(qa: DataFrame) -> DataFrame:
    """(qid, sent_no, question, sentence): the passage's sentences with their own numbers."""
    return qa.select("qid", "question", F.posexplode_outer(sentences(F.col("passage"))).alias("sent_no", "sentence")).where("sentence is not null")


def label_candidates(rows: DataFrame, answers: DataFrame, relevant: int = 3) -> DataFrame:
    """Adds rank: `relevant` where the sentence is an answer of the question, else 0. answers: qid, sentence."""
    gold = answers.select("qid", "sentence", F.lit(relevant).alias("rank")).distinct()
    return rows.join(gold, ["qid", "sentence"], "left").withColumn("rank", F.coalesce("rank", F.lit(0)))


# --- features --------------------------------------------------------------------------------------------------------------

#: Tags of words that are not content words.
FUNCTION_TAGS = ("d", "p", "c", "u", "xc", "w")
UNIT_WORDS = frozenset("km m cm mm kg g mg l ml percent years year months month days day hours hour minutes euros dollars people 年 月 日 人 个 米 公里 元".split())


def tag_words(words: Column, names: dict[str, str]) -> Column:
    """Words -> (word, tag): dictionary entries as given, numbers m, units q, marks w, else n. Null has none."""

    def tag(w: Column) -> Column:
        known = F.lit(None).cast("string")
        if names:
            known = F.try_element_at(F.create_map(*[F.lit(x) for pair in names.items() for x in pair]), w)
        kind = F.when(w.rlike(r"^[\p{Nd}\p{No}]"), "m").when(w.isin(*sorted(UNIT_WORDS)), "q").when(w.rlike(r"^[\p{L}\p{N}]"), "n").otherwise("w")
        return F.struct(w.alias("word"), F.coalesce(known, kind).alias("tag"))

    return F.transform(F.coalesce(words, F.array().cast("array<string>")), tag)


def content_words(words: Column, names: dict[str, str]) -> Column:
    """How many words have no tag of FUNCTION_TAGS."""
    return F.size(F.filter(tag_words(words, names), lambda t: ~t["tag"].isin(*FUNCTION_TAGS)))


def cut_and_tag(text: Column, words: Iterable[str], names: dict[str, str], stop: Iterable[str] = ()) -> Column:
    """Words of a text by a dictionary, without stop words, tagged."""
    return tag_words(without_stop_words(segment(text, words), stop), names)


def rejoin_and_tag(parts: Column, words: Iterable[str], names: dict[str, str], stop: Iterable[str] = ()) -> Column:
    """cut_and_tag() of words that were cut before: joined without a separator and cut anew."""
    return cut_and_tag(F.array_join(parts, ""), words, names, stop)


def basic_features(q: Column, a: Column) -> dict[str, Column]:
    """Overlap and length features of two token arrays. Ratios stay ratios."""
    # a lambda's variable holds the arrays: as plain expressions they would be made again for every word
    made = F.array(F.struct(q.alias("q"), F.array_distinct(a).alias("d"), F.size(a).alias("n"), bigrams(q).alias("qb"), bigrams(a).alias("ab")))

    def shares(s: Column) -> Column:
        one = F.size(F.filter(s["q"], lambda w: F.array_contains(s["d"], w)))
        two = F.size(F.filter(s["qb"], lambda w: F.array_contains(s["ab"], w)))
        return F.struct(F.coalesce(F.try_divide(one, s["n"]), F.lit(0.0)).alias("one"), (two / (1 + s["n"])).alias("two"))

    shared = F.transform(made, shares)[0]
    return {"n_answer": F.size(a), "len_diff": F.abs(F.size(q) - F.size(a)), "unigram": shared["one"], "bigram": shared["two"]}


def all_features(rows: DataFrame, question: str, sentence: str, qv: str | None = None, av: str | None = None, max_letters: int | None = None, names: dict[str, str] | None = None, least: int = 1) -> DataFrame:
    """Adds features: an array of 11 numbers. qv, av: dense vectors of both texts, if there are any. names: tags of known words.

    Sentences of fewer than `least` words have no row: 1 to train, 2 to select among candidates.
    max_letters bounds the letters that the quadratic comparisons of strings look at; None: all.
    """
    rows = rows.withColumns({"_q": tokens(F.col(question)), "_a": tokens(F.col(sentence))}).where(F.size("_a") >= least)
    x, y = (F.coalesce(F.col(c), F.lit("")) for c in (question, sentence))
    if max_letters is not None:
        x, y = F.substring(x, 1, max_letters), F.substring(y, 1, max_letters)
    basic = basic_features(F.col("_q"), F.col("_a"))
    content = content_words(F.col("_a"), names or {})
    zero = F.lit(0.0)
    vector = [f(F.col(qv), F.col(av)) for f in (inner_product, cosine, tanimoto)] if qv and av else [zero, zero, zero]
    values = [basic["n_answer"], content, basic["len_diff"], basic["bigram"], basic["unigram"], common_substring(x, y), common_subsequence(x, y), F.levenshtein(x, y), *vector]
    return rows.withColumn("features", F.array(*[v.cast("double") for v in values])).drop("_q", "_a")


def svmlight(rank: Column, qid: Column, features: Column) -> Column:
    """`rank qid:N 1:v ... n:v` with six decimals."""
    parts = F.transform(features, lambda v, i: F.concat((i + 1).cast("string"), F.lit(":"), F.format_string("%.6f", v)))
    return F.concat_ws(" ", rank.cast("string"), F.concat(F.lit("qid:"), qid.cast("string")), F.array_join(parts, " "))


def parse_svmlight(line: Column) -> dict[str, Column]:
    values = F.transform(F.regexp_extract_all(line, F.lit(r" \d+:(\S+)"), 1), lambda v: v.cast("double"))
    return {"rank": F.regexp_extract(line, r"^(\d+) ", 1).cast("int"), "qid": F.regexp_extract(line, r" qid:(-?\d+)", 1).cast("bigint"), "features": values}


# --- learning to rank ------------------------------------------------------------------------------------------------------


def ranking_pairs(rows: DataFrame) -> DataFrame:
    """(qid, diff, label): differences of features for every pair of unequal ranks, in both directions by turns."""
    a = rows.select("qid", F.col("rank").alias("ra"), F.col("features").alias("fa"))
    b = rows.select("qid", F.col("rank").alias("rb"), F.col("features").alias("fb"), "sent_no")
    pairs = a.join(b, "qid").where("ra > rb")
    sign = F.when(F.pmod("sent_no", F.lit(2)) == 0, 1.0).otherwise(-1.0)
    return pairs.select("qid", F.zip_with("fa", "fb", lambda x, y: (x - y) * sign).alias("diff"), F.when(sign > 0, 1.0).otherwise(0.0).alias("label"))


def fit_ranker(rows: DataFrame, c: float = 10.0, max_iter: int = 50) -> list[float]:
    """Weights of a linear ranker: a hinge loss over pairs, no intercept. rows: qid, sent_no, rank, features."""
    data = ranking_pairs(rows).select(array_to_vector("diff").alias("features"), "label")
    counts = data.agg(F.count("*").alias("n"), F.count_distinct("label").alias("k")).first()
    if counts.k < 2:
        raise ValueError("pairs of both directions are needed")
    model = LinearSVC(fitIntercept=False, standardization=True, maxIter=max_iter, regParam=1.0 / (c * counts.n)).fit(data)
    return [float(w) for w in model.coefficients]


def rank_score(features: Column, weights: Sequence[float]) -> Column:
    return F.aggregate(F.zip_with(features, F.array(*[F.lit(w) for w in weights]), lambda x, w: x * w), F.lit(0.0), lambda acc, v: acc + v)


def top_sentences(rows: DataFrame, n: int, score: str = "score") -> DataFrame:
    """The n best sentences of each question, ties by sentence number."""
    w = Window.partitionBy("qid").orderBy(F.col(score).desc(), "sent_no")
    return rows.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)


def selector_accuracy(rows: DataFrame, score: str = "score") -> DataFrame:
    """Share of questions whose best sentence is a best-ranked one; questions without a relevant sentence don't count."""
    best = top_sentences(rows, 1, score).select("qid", F.col("rank").alias("got"))
    gold = rows.groupBy("qid").agg(F.max("rank").alias("gold")).where("gold > 0")
    return best.join(gold, "qid").agg(F.avg((F.col("got") == F.col("gold")).cast("int")).alias("accuracy"))


# --- classification --------------------------------------------------------------------------------------------------------


def fit_classifier(rows: DataFrame, text: str = "text", label: str = "label", c_grid: Sequence[float] = (1.0,), folds: int = 3, features: int = 1 << 13, seed: int = 17) -> PipelineModel:
    """Multinomial logistic regression over length-1 tf-idf vectors; several values of C: chosen by cross-validation.

    regParam is 1 / (C * n), the same loss in Spark's scale.
    """
    data = rows.select(tokens(F.col(text)).alias("words"), F.col(label).cast("string").alias("label_text")).where("label_text is not null")
    n = data.count()
    # the most frequent words, ties by word; counted in SQL, as CountVectorizer moves and keeps every word as an object
    counts = data.select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    vocabulary = [r.word for r in counts.orderBy(F.desc("n"), "word").limit(features).collect()]
    prepare = [
        StringIndexer(inputCol="label_text", outputCol="label", stringOrderType="alphabetAsc", handleInvalid="keep"),
        CountVectorizerModel.from_vocabulary(vocabulary, inputCol="words", outputCol="tf"),
        IDF(inputCol="tf", outputCol="tfidf"),
        Normalizer(inputCol="tfidf", outputCol="features", p=2.0),
    ]
    ready = Pipeline(stages=prepare).fit(data)
    # written, not kept in memory: the training keeps blocks of its own there
    table = materialize(ready.transform(data).select("features", "label"), "classifier")
    lr = LogisticRegression(maxIter=100, tol=1e-4, standardization=False)
    if len(c_grid) > 1:
        grid = ParamGridBuilder().addGrid(lr.regParam, [1.0 / (c * max(n, 1)) for c in c_grid]).build()
        chosen: CrossValidatorModel = CrossValidator(
            estimator=lr, estimatorParamMaps=grid, evaluator=MulticlassClassificationEvaluator(metricName="accuracy"), numFolds=folds, parallelism=2, seed=seed
        ).fit(table)
        best = chosen.bestModel
    else:
        best = lr.copy({lr.regParam: 1.0 / (c_grid[0] * max(n, 1))}).fit(table)
    names = IndexToString(inputCol="prediction", outputCol="predicted", labels=ready.stages[0].labels)
    return PipelineModel(stages=[*ready.stages[1:], best, names])


def classify(rows: DataFrame, model: PipelineModel, text: str = "text") -> DataFrame:
    """rows with predicted."""
    out = model.transform(rows.withColumn("words", tokens(F.col(text))))
    return out.select(*[F.col(f"`{c}`") for c in rows.columns if c != "predicted"], "predicted")


# --- answer spans ----------------------------------------------------------------------------------------------------------

N = r"\p{Nd}"
TIME = {
    "TIME_YEAR": rf"{N}{{2,4}}年",
    "TIME_MONTH": rf"{N}{{1,2}}月",
    "TIME_DAY": rf"{N}{{1,2}}[日号]",
    "TIME_WEEK": r"(?:周|星期|礼拜)[1-7一二三四五六日]",
    "TIME_RANGE": rf"{N}{{2,4}}年?[-到至]{N}{{2,4}}年?",
}
#: In this order where the class names none of the above.
TIME_ANY = (rf"{N}{{1,4}}[年/-]{N}{{1,2}}[月/-]{N}{{1,2}}[日号]?", rf"{N}{{1,4}}[年/-]{N}{{1,2}}月?", rf"{N}{{1,2}}[月/-]{N}{{1,2}}[日号]?", TIME["TIME_YEAR"], TIME["TIME_MONTH"])
PERSON_TAGS, PLACE_TAGS = ("nr", "nt", "nz", "nw"), ("ns", "f", "s")


def _first(sentence: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(sentence, pattern, 0), F.lit(""))


def time_span(kind: Column, sentence: Column) -> Column:
    """The first match of the class's pattern, else of any date; without one, the whole sentence."""
    named = F.lit(None).cast("string")
    for name, pattern in TIME.items():
        named = F.when(kind == name, _first(sentence, pattern)).otherwise(named)
    return F.coalesce(named, *[_first(sentence, p) for p in TIME_ANY], sentence)


def entity_span(tagged: Column, sentence: Column, tags: Iterable[str]) -> Column:
    """Entities joined, those already contained in the result left out; without one, the whole sentence."""
    some = F.filter(tagged, lambda t: t["tag"].isin(*tags))
    joined = F.aggregate(some, F.lit(""), lambda acc, t: F.when(F.contains(acc, t["word"]), acc).otherwise(F.concat(acc, t["word"])))
    return F.when(joined != "", joined).otherwise(sentence)


def number_span(tagged: Column, sentence: Column) -> Column:
    """The first number that a measure word follows, both joined."""
    n = F.size(tagged)
    at = F.when(n > 1, F.sequence(F.lit(0), n - 2)).otherwise(F.array().cast("array<int>"))
    hit = F.filter(at, lambda i: (F.get(tagged, i)["tag"] == "m") & (F.get(tagged, i + 1)["tag"] == "q"))
    i = F.get(hit, F.lit(0))
    return F.when(F.size(hit) > 0, F.concat(F.get(tagged, i)["word"], F.get(tagged, i + 1)["word"])).otherwise(sentence)


def colon_trim(sentence: Column) -> Column:
    """After a colon, up to the next one; for the plain colon first, then for the wide one."""
    once = F.when(F.contains(sentence, F.lit(":")), F.split_part(sentence, F.lit(":"), F.lit(2))).otherwise(sentence)
    return F.when(F.contains(once, F.lit("：")), F.split_part(once, F.lit("："), F.lit(2))).otherwise(once)


def answer_span(kind: Column, sentence: Column, tagged: Column) -> Column:
    """By the class's prefix: HUM, LOC, NUM, TIME; else the sentence after its colons."""
    return (
        F.when(F.startswith(kind, F.lit("HUM")), entity_span(tagged, sentence, PERSON_TAGS))
        .when(F.startswith(kind, F.lit("LOC")), entity_span(tagged, sentence, PLACE_TAGS))
        .when(F.startswith(kind, F.lit("NUM")), number_span(tagged, sentence))
        .when(F.startswith(kind, F.lit("TIME")), time_span(kind, sentence))
        .otherwise(colon_trim(sentence))
    )


def vector_columns(df: DataFrame, columns: Sequence[str], out: str) -> DataFrame:
    """Numeric columns as one vector."""
    return VectorAssembler(inputCols=list(columns), outputCol=out).transform(df)
