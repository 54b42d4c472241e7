import math
import random
from datetime import date

import pytest
from pyspark.sql import functions as F

from sievestone.config import CrawlRules, RolePolicy
from sievestone.functions import strings, text, vectors, web
from sievestone.operators import index, ingest, metrics, qa, search
from sievestone.sources import files


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_golden_metrics(spark):
    rows = spark.createDataFrame([(1, "北京天安门", "天安门")], "k int, p string, g string")
    overlap = metrics.letter_overlap(rows, ["k"], "p", "g")
    m = metrics.precision_recall_f1(overlap, ["k"]).first()
    assert (m.precision, m.recall) == (0.6, 1.0) and m.f1 == pytest.approx(0.75)
    assert metrics.bleu1(overlap, ["k"]).first().bleu1 == pytest.approx(0.6)
    answers = spark.createDataFrame([("A", "A"), ("B", "B"), ("C", "D")], "p string, g string")
    assert metrics.exact_match(answers, "p", "g").first()[0] == pytest.approx(2 / 3)


def test_metrics_of_nothing(spark):
    rows = spark.createDataFrame([(1, None, "a"), (2, "x", "y"), (3, "", "")], "k int, p string, g string")
    overlap = metrics.letter_overlap(rows, ["k"], "p", "g")
    assert all((r.precision, r.recall, r.f1) == (0, 0, 0) for r in metrics.precision_recall_f1(overlap, ["k"]).collect())
    assert all(r.bleu1 == 0 for r in metrics.bleu1(overlap, ["k"]).collect())
    assert metrics.exact_match(rows.limit(0), "p", "g").first()[0] is None


def test_bm25_by_hand(spark):
    docs = spark.createDataFrame([(0, "a b a"), (1, "b c"), (2, ""), (3, None)], "doc_id bigint, text string")
    queries = spark.createDataFrame([(7, "a a c"), (8, "zzz")], "query_id bigint, text string")
    got = {(r.query_id, r.doc_id): r.score for r in index.bm25_scores(index.bm25_fit(docs), queries).collect()}
    avg, idf = 5 / 4, math.log(4)
    k = lambda tf, n, q: idf * 2.5 * tf / (1.5 * (0.25 + 0.75 * n / avg) + tf) * 2.5 * q / (1.5 + q)
    assert got == {(7, 0): pytest.approx(k(2, 3, 2), abs=1e-6), (7, 1): pytest.approx(k(1, 2, 1), abs=1e-6)}


def test_top_k_breaks_ties_and_fills(spark):
    docs = spark.range(5).select(F.col("id").alias("doc_id"))
    queries = spark.createDataFrame([(1,)], "query_id bigint")
    scores = spark.createDataFrame([(1, 3, 2.0), (1, 1, 2.0)], "query_id bigint, doc_id bigint, score double")
    full = index.with_zero_scores(scores, queries, docs)
    assert full.count() == 5 and [(r.doc_id, r.rank) for r in index.top_k(full, 4).orderBy("rank").collect()] == [(1, 1), (3, 2), (0, 3), (2, 4)]


def test_search_fills_with_what_the_role_sees(spark):
    url = "http://h/article/{}/x"
    rows = [(i, url.format(day), f"t{i}", "a b" if i == 3 else "c") for i, day in enumerate(["2024/03/20", "2023/09/01", "none", "2024/03/21", "2022/01/01", "2024/03/25"])]
    articles = ingest.segment_articles(spark.createDataFrame([(*r, []) for r in rows], "doc_id bigint, url string, title string, paragraphs string, file_name array<string>"))
    queries = spark.createDataFrame([(1, "b", "Guest"), (2, "b", "SignedUser"), (3, "b", "Administrator"), (4, "", "VerifiedUser"), (5, "b", "nobody")], "query_id bigint, text string, role string")
    got = search.search_pages(articles, queries, F.lit("2024-03-31").cast("date"), k=3).orderBy("query_id", "rank").collect()
    want = {1: [3, 0, 5], 2: [3, 0, 1], 3: [3, 0, 1], 4: [0, 1, 3]}
    assert {q: [r.doc_id for r in got if r.query_id == q] for q in {r.query_id for r in got}} == want


def test_index_round_trip(spark, tmp_path):
    docs = spark.createDataFrame([(0, "a b"), (1, "b c")], "doc_id bigint, text string")
    queries = spark.createDataFrame([(1, "a c")], "query_id bigint, text string")
    calls = []
    again = lambda: calls.append(1) or docs
    a = index.load_or_fit(spark, str(tmp_path / "i"), again)
    b = index.load_or_fit(spark, str(tmp_path / "i"), again)
    assert len(calls) == 1
    rows = [sorted(index.bm25_scores(x, queries).collect()) for x in (a, b, index.bm25_fit(docs))]
    assert rows[0] == rows[1] == rows[2]


def test_argmax_sentinel_and_nan(spark):
    queries = spark.createDataFrame([(1,), (2,), (3,)], "q int")
    scores = spark.createDataFrame([(1, 5, 0.5), (1, 4, 0.5), (2, 4, 0.0), (3, 1, float("nan")), (3, 2, 0.1)], "q int, doc_id bigint, score double")
    assert {r.q: r.doc_id for r in index.argmax(scores, queries, "q").collect()} == {1: 4, 2: -1, 3: 2}


def brute_lcs(a, b, substring):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else 0 if substring else max(t[i][j + 1], t[i + 1][j])
    return max(map(max, t)) if substring else t[-1][-1]


def test_common_strings_equal_brute_force(spark):
    rnd = random.Random(1)
    pairs = [("".join(rnd.choice("abé中") for _ in range(rnd.randrange(15))), "".join(rnd.choice("abé中") for _ in range(rnd.randrange(15)))) for _ in range(150)]
    df = spark.createDataFrame([*pairs, (None, "a")], "a string, b string")
    for r in df.select("*", strings.common_substring("a", "b").alias("s"), strings.common_subsequence("a", "b").alias("q")).collect():
        assert (r.s, r.q) == (brute_lcs(r.a or "", r.b, True), brute_lcs(r.a or "", r.b, False))


def test_vectors_without_length(spark):
    a, z = F.array(F.lit(1.0), F.lit(2.0)), F.array(F.lit(0.0), F.lit(0.0))
    assert one(spark, vectors.cosine(a, z), vectors.tanimoto(z, z), vectors.inner_product(a, a), vectors.tanimoto(a, a)) == (0, 0, 5, 1)


def test_text_columns(spark):
    r = one(spark, text.tokens(F.lit("Né à l'été_2, 中文")), text.bigrams(F.array(F.lit("ab"), F.lit("c"), F.lit("d"))), text.bigrams(F.array(F.lit("a"))), text.snippet(F.lit("x" * 34)), text.snippet(F.lit("x" * 33)), text.tokens(F.lit(None).cast("string")))
    assert r[0] == ["né", "à", "l", "été_2", "中文"] and r[1] == ["abc", "cd"] and r[2] == [] and r[3] == "x" * 30 + "......" and r[4] == "x" * 33 and r[5] == []
    assert one(spark, text.without_stop_words(F.array(*map(F.lit, ["a", "b", "b", "A"])), ["a"]))[0] == ["b", "b", "A"]


def test_url_dates(spark):
    cases = {"http://h/article/2022/05/01/x": date(2022, 5, 1), "http://h/article/22/5/1/x": date(1, 1, 1), "x": date(1, 1, 1), "http://h/2022/13/01/x": date(1, 1, 1), "2022/5/x": date(1, 1, 1), "a/2024/2/29/x": date(2024, 2, 29)}
    rows = spark.createDataFrame([(u,) for u in cases], "u string").select("u", web.url_date(F.col("u")).alias("d")).collect()
    assert {r.u: r.d for r in rows} == cases


def test_extraction(spark):
    html = "<h3 class=a> <b>Title</b> </h3><p> one\n“two” </p><p>th ree</p><a href=\"/f/a%20b.pdf\">x</a><a>y</a><a href=\"/z\">"
    pages = spark.createDataFrame([(1, "http://h:8/x", html), (2, None, None)], "page_id bigint, url string, html string")
    a, b = ingest.extract_pages(pages).orderBy("page_id").collect()
    assert (a.title, a.paragraphs, a.file_name, a.links, a.host) == ("Title", "one  two  three", ["a b.pdf"], ["", "/z"], "h:8")
    assert b.title is None and b.paragraphs == "" and b.links == []


def test_frontier_and_redirects(spark):
    rules = CrawlRules(hosts=("h",), follow_prefixes=("http://h/a",))
    pages = spark.createDataFrame([("http://h/a0", ["http://h/a1", "http://h/a1", "https://h/a2", "http://o/a3", "http://h/b"]), ("http://h/a1", ["http://h/a0", "http://h/a4"])], "url string, links array<string>")
    got = ingest.crawl(pages, pages.limit(1).select("url"), rules).collect()
    assert sorted((r.url, r.depth) for r in got) == [("http://h/a0", 0), ("http://h/a1", 1), ("http://h/a4", 2)]
    responses = spark.createDataFrame([("a", 302, "b", None), ("b", 200, None, "B"), ("c", 302, "gone", None), ("d", 500, None, "D")], "url string, status int, location string, html string")
    assert sorted((r.url, r.html) for r in ingest.follow_redirects(responses).collect()) == [("a", "B"), ("b", "B")]


def test_roles_are_nested(spark):
    policy, as_of = RolePolicy(), F.lit("2024-03-31").cast("date")
    days = spark.createDataFrame([(date(1, 1, 1),), (date(2021, 3, 31),), (date(2023, 5, 1),), (date(2024, 2, 29),), (date(2024, 2, 28),)], "d date")
    seen = {r: {x.d for x in days.where(search.visible(F.col("d"), F.lit(r), as_of)).collect()} for r in policy.months}
    assert seen["Guest"] == {date(2024, 2, 29)} and seen["Guest"] < seen["SignedUser"] < seen["VerifiedUser"] < seen["Administrator"]
    assert days.where(search.visible(F.col("d"), F.lit("nobody"), as_of)).count() == 0


def test_spans(spark):
    tag = lambda *ws: F.array(*[F.struct(F.lit(w).alias("word"), F.lit(t).alias("tag")) for w, t in ws])
    s = F.lit("甲乙去了北京")
    r = one(
        spark, qa.entity_span(tag(("甲乙", "nr"), ("甲", "nr"), ("丙", "nt")), s, qa.PERSON_TAGS), qa.entity_span(tag(("x", "n")), s, qa.PERSON_TAGS),
        qa.number_span(tag(("3", "m"), ("x", "n"), ("4", "m"), ("km", "q")), s), qa.colon_trim(F.lit("a:b：c:d")), qa.time_span(F.lit("TIME_DAY"), F.lit("在5月3日")),
        qa.time_span(F.lit("TIME_X"), F.lit("于２０２２年5月3日到")), qa.time_span(F.lit("TIME_X"), F.lit("无")),
    )
    assert list(r) == ["甲乙丙", "甲乙去了北京", "4km", "c", "3日", "２０２２年5月3日", "无"]


def test_files_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([(1, 0, 3, [1.0, 0.25]), (1, 1, 0, [2.0, -0.5])], "qid bigint, sent_no int, rank int, features array<double>")
    files.write_svmlight(rows, str(tmp_path / "s"))
    assert sorted((r["rank"], r.qid, r.features) for r in files.read_svmlight(spark, str(tmp_path / "s")).collect()) == [(0, 1, [2.0, -0.5]), (3, 1, [1.0, 0.25])]
    (tmp_path / "a.json").write_text('[{"pid": 1, "document": ["x", "y"]}, {"pid": 2}]')
    assert [r.document for r in files.read_json_array(spark, str(tmp_path / "a.json"), files.PASSAGE).orderBy("pid").collect()] == [["x", "y"], None]
    (tmp_path / "q.tsv").write_text("HUM\tWho?\n\nx\nLOC\tWhere?\n")
    assert files.read_labelled_questions(spark, str(tmp_path / "q.tsv"), 3).count() == 6
    (tmp_path / "w.txt").write_text("的\nthe\nthe\n\n")
    assert sorted(r.word for r in files.read_stop_words(spark, str(tmp_path / "w.txt")).collect()) == ["the", "的"]
    (tmp_path / "bad.jsonl").write_text('{"pid": 1}\nnot json\n')
    assert files.read_json_lines(spark, str(tmp_path / "bad.jsonl"), files.PASSAGE, strict=False).count() <= 2
    with pytest.raises(Exception):
        files.read_json_lines(spark, str(tmp_path / "bad.jsonl"), files.PASSAGE).collect()


def test_segmenter_reply(spark):
    rows = spark.createDataFrame([('[{"t": "a", "p": 0.5}, {"t": "b", "p": 1}]',), ("[]",), (None,)], "reply string")
    assert [r.w for r in rows.select(files.segments_to_words("reply").alias("w")).collect()] == [["a", "b"], [], None]


def test_cut_and_tag(spark):
    rows = spark.createDataFrame([("在北京走3公里",), ("",), (None,)], "t string")
    got = rows.select(qa.cut_and_tag(F.col("t"), ["北京", "公里"], {"北京": "ns"}, ["在"]).alias("w")).collect()
    assert [[tuple(x) for x in r.w] for r in got] == [[("北京", "ns"), ("走", "n"), ("3", "m"), ("公里", "q")], [], []]


def test_last_duplicate_wins_and_replication(spark):
    rows = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, None)], "t string, n int, v string")
    assert sorted((r.t, r.v) for r in ingest.last_by_key(rows, ["t"], "n").collect()) == [("a", "y"), ("b", None)]
    assert ingest.replicate(rows, 3).count() == 9 and ingest.replicate(rows, 0).count() == 0


def test_ranker_and_classifier(spark):
    rows = spark.createDataFrame([(q, s, 3 if s == q % 3 else 0, [1.0 if s == q % 3 else 0.1 * s, 1.0]) for q in range(12) for s in range(3)], "qid bigint, sent_no int, rank int, features array<double>")
    weights = qa.fit_ranker(rows)
    scored = rows.withColumn("score", qa.rank_score(F.col("features"), weights))
    assert qa.selector_accuracy(scored).first()[0] == 1.0
    texts = spark.createDataFrame([(f"who is person {i}", "HUM") for i in range(8)] + [(f"where is place {i}", "LOC") for i in range(8)], "text string, label string")
    found = qa.classify(texts, qa.fit_classifier(texts, c_grid=(1.0, 10.0), folds=2))
    assert metrics.accuracy(found, "predicted", "label").first()[0] == 1.0


def test_streaming_ingest(spark, tmp_path):
    from sievestone.streaming import ingest as stream

    page = "<h3>{0}</h3><p>{0} words here</p>"
    rows = [(i, f"http://h/{i % 3}", page.format("abc"[i % 3]), "2024-01-01 00:00:00") for i in range(6)]
    spark.createDataFrame(rows, "page_id bigint, url string, html string, seen string").withColumn("seen", F.col("seen").cast("timestamp")).write.parquet(str(tmp_path / "in"))
    def arrived():
        articles = stream.new_articles(stream.read_pages(spark, str(tmp_path / "in")))
        stream.append_and_index(articles, str(tmp_path / "store"), str(tmp_path / "index"), str(tmp_path / "cp")).awaitTermination(120)
        return stream.load_grown(spark, str(tmp_path / "index"))

    query = spark.createDataFrame([(1, "b d")], "query_id bigint, text string")
    loaded = arrived()
    assert loaded.stats.first().n_docs == 3 and index.bm25_scores(loaded, query).count() == 1
    more = [(9, "http://h/9", page.format("d"), "2024-01-01 01:00:00"), (10, "http://h/1", page.format("b"), "2024-01-01 01:00:00")]
    spark.createDataFrame(more, "page_id bigint, url string, html string, seen string").withColumn("seen", F.col("seen").cast("timestamp")).write.mode("append").parquet(str(tmp_path / "in"))
    grown = arrived()
    assert grown.stats.first().n_docs == 4 and index.bm25_scores(grown, query).count() == 2


def test_containing(spark):
    docs = spark.createDataFrame([(1, "the cat sat on the mat today"), (2, "a cat sat on the mat"), (3, None), (4, "cat sat"), (5, "The cat sat on the mat")], "doc_id bigint, text string")
    items = spark.createDataFrame([(7, "cat sat on the mat"), (8, "at sa"), (9, None), (10, "he cat sat on the ma"), (11, "no such words in here")], "query_id bigint, text string")
    got = {(r.query_id, r.doc_id) for r in index.containing(docs, items).collect()}
    assert got == {(q.query_id, d.doc_id) for q in items.collect() for d in docs.collect() if q.text is not None and d.text is not None and q.text in d.text}


def test_segmentation(spark):
    from sievestone.functions.segment import segment, segmenter

    cut = segmenter(["北京", "天安门", "北京大学"])
    assert cut("我在北京大学和天安门, ok_1!") == ["我", "在", "北京大学", "和", "天安门", ",", "ok_1", "!"]
    assert cut(None) == [] and segmenter([])("中文") == ["中", "文"] and segmenter([], keep_marks=False)("a,b") == ["a", "b"]
    rows = spark.createDataFrame([("北京a",), (None,)], "t string").select(segment(F.col("t"), ["北京"]).alias("w")).collect()
    assert [r.w for r in rows] == [["北京", "a"], []]
