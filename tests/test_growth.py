"""What moves between tasks: the plans of queries whose figures have to grow no faster than their input."""

import re

import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from sievestone.operators import index, qa
from sievestone.plans import registry


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def moved(df):
    """The columns that rows are dealt by, of every exchange."""
    return [re.findall(r"(\w+)#", keys) for keys in re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan(df))]


@pytest.mark.parametrize("name", ["vsm_dot", "vsm_cos", "vsm_jac", "bm25_topk", "bm25_all_docs", "qa_pipeline", "role_search", "result_cards", "vsm_weights", "sk_tfidf"])
def test_postings_are_counted_where_the_text_is(spark, name):
    assert ["doc_id", "word"] not in moved(registry.QUERIES[name](spark, SMALL))


@pytest.mark.parametrize("name", ["vsm_dot", "vsm_cos", "vsm_jac", "bm25_topk", "bm25_all_docs", "qa_pipeline"])
def test_scores_stay_with_their_document(spark, name):
    found = plan(registry.QUERIES[name](spark, SMALL))
    assert ["query_id", "doc_id"] not in moved(registry.QUERIES[name](spark, SMALL)) and "LeftSemi" in found


@pytest.mark.parametrize("name", ["role_search", "result_cards"])
def test_search_cuts_before_it_adds_zeros(spark, name):
    text = plan(registry.QUERIES[name](spark, SMALL))
    assert text.count("WindowGroupLimit") == 6


def test_containing_moves_no_text(spark):
    assert "SortMergeJoin" not in plan(registry.QUERIES["containing"](spark, SMALL))


def test_smooth_tfidf_makes_its_rows_once(spark):
    assert plan(registry.QUERIES["sk_tfidf"](spark, SMALL)).count("hashpartitioning(doc_id") == 3  # texts for tf and df, rows for their norms


def test_saving_moves_no_posting(spark, tmp_path, monkeypatch):
    from pyspark.sql import DataFrame

    monkeypatch.setattr(DataFrame, "repartitionByRange", lambda *a, **k: pytest.fail("postings are dealt out again"))
    docs = spark.createDataFrame([(0, "b a b"), (1, "b c")], "doc_id bigint, text string")
    index.bm25_fit(docs).save(str(tmp_path / "i"))
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "i/postings")).collect())) == [(0, "a", 1), (0, "b", 2), (1, "b", 1), (1, "c", 1)]


def test_zero_scores_of_odd_rows(spark):
    docs = spark.createDataFrame([(1,), (1,), (None,), (2,)], "doc_id bigint")
    queries = spark.createDataFrame([(7,), (8,)], "query_id bigint")
    scores = spark.createDataFrame([(7, 1, 2.0), (9, 2, 1.0)], "query_id bigint, doc_id bigint, score double")
    got = index.with_zero_scores(scores, queries, docs)
    assert got.columns == ["query_id", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(7, 1, 2.0)] * 2 + [(8, 1, 0.0)] * 2 + [(7, None, 0.0), (8, None, 0.0), (7, 2, 0.0), (8, 2, 0.0)], key=str)
    assert index.with_zero_scores(scores.limit(0), queries, docs).count() == 8


def test_ranker_trains_on_what_is_written(spark, monkeypatch):
    given = []
    monkeypatch.setattr(qa, "fit_ranker", lambda rows: given.append(plan(rows)) or [1.0] * 4)
    registry.QUERIES["pairwise_ranker"](spark, SMALL)
    assert "Join" not in given[0]


def test_vocabulary_is_the_most_frequent_words_ties_by_word(spark):
    texts = spark.createDataFrame([("b b d c", "x"), ("a c e", "y")], "text string, label string")
    model = qa.fit_classifier(texts, features=3)
    assert model.stages[0].vocabulary == ["b", "c", "a"]
    assert qa.classify(texts.where(F.lit(False)), model).count() == 0
