"""Language identification, quality and extraction: held-out accuracy, exact counts, odd inputs."""

import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from sievestone.llm import html_extraction as X
from sievestone.llm import language_id as G
from sievestone.llm import quality_rules as Q

SMALL = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs():
    return duckdb.sql(f"SELECT doc_id, text, lang FROM '{SMALL}/documents.parquet' ORDER BY doc_id").fetchall()


@pytest.fixture(scope="module")
def languages(docs):
    return G.fit_rows([(t, x) for i, t, x in docs if i % 2])


def test_language_held_out(docs, languages):
    held = [(t, x) for i, t, x in docs if i % 2 == 0]
    got, score, rejected = G.predict([t for t, _ in held], languages)
    assert np.mean([g == x for g, (_, x) in zip(got, held)]) > 0.98
    assert rejected.mean() < 0.02 and (score >= 0).all() and (score <= 1).all()


def test_language_odd_texts(languages):
    got, score, rejected = G.predict([None, "", "123 !?", "的中文字符在这里没有人认识它们", "x"], languages)
    assert got[:3] == ["und"] * 3 and score[:3].tolist() == [0, 0, 0] and rejected[:4].all()
    long = "the and of " * 200_000  # more than a chunk
    a, b = G._logits([long], languages)[0], G._logits(["the and of " * 200], languages)[0]
    assert np.allclose(a, b, atol=0.05)
    assert G.predict([], languages)[0] == [] and G.predict(["a"], G.fit_rows([]))[0] == ["und"]


def test_language_chunks_change_nothing(docs, languages, monkeypatch):
    import sievestone.llm.text as text

    texts = [t for _, t, _ in docs[:20]]
    whole = G._logits(texts, languages)
    monkeypatch.setattr(text, "CHUNK", 97)
    parts = G._logits(texts, languages)
    assert all(np.allclose(a, b) for a, b in zip(whole, parts))


def test_language_columns(spark, languages):
    df = spark.createDataFrame([(1, "the and of", "clash"), (1, "the and of", "clash"), (None, None, None)], "doc_id bigint, text string, lang_pred string")
    got = G.identify(df, languages)
    assert got.columns == ["doc_id", "text", "lang_pred", "lang_score", "lang_rejected"] and got.count() == 3
    assert G.identify(df.limit(0), languages).count() == 0
    kept = G.stage(spark, spark.createDataFrame([(i, "the and of it was " * 5, "en") for i in range(30)] + [(99, None, "en"), (98, "12 34", None)], "doc_id bigint, text string, lang string"), "")
    assert kept.columns == ["doc_id", "text", "lang"] and kept.count() == 30


def counts(text):
    words = re.findall("[^\x20\x09-\x0d]+", text)
    grams = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {j for i in range(len(words) - 4) if grams[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search("[^\x20\x09-\x0d]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


def test_quality_counts(docs):
    texts = [t for _, t, _ in docs[:150]] + ["", "a", "a b c d e a b c d e", "é\xa0é  x\n\n \nx\nx", "a b c d e\n" * 3, "\x85\x1c| <>"]
    got = Q.measure([*texts, None], None)
    for i, t in enumerate(texts):
        assert tuple(int(got[k][i]) for k in Q.COUNTS) == counts(t)
    assert got["base_failed"][-1] and not got["kept"][-1] and got["n_words"][-1] == 0


def test_quality_held_out(spark, docs):
    label = dict(duckdb.sql(f"SELECT doc_id, max(quality) FROM '{SMALL}/labels.parquet' WHERE doc_id IS NOT NULL GROUP BY 1").fetchall())
    rows = [(i, t, label[i]) for i, t, _ in docs if i in label]
    model = Q.fit_rows([(t, y) for i, t, y in rows if i % 2])
    held = [(t, y) for i, t, y in rows if i % 2 == 0 and len(t.split()) >= 10]
    prob = Q.measure([t for t, _ in held], model)["quality_prob"]
    y = np.array([y for _, y in held])
    assert ((prob >= 0.5) == (y == 1)).mean() > 0.95
    assert abs(prob.mean() - y.mean()) < 0.1  # calibrated
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (2, 0), (3, None)], "doc_id bigint, quality int")
    table = spark.createDataFrame([(1, "x"), (2, "y"), (2, "y"), (3, "z")], "doc_id bigint, text string")
    assert sorted((r.text, r.quality) for r in Q.training_rows(table, labels, Q.class_counts(labels)).collect()) == [("x", 1), ("y", 0)]
    assert Q.fit(table.limit(0), labels.limit(0)) is None
    assert Q.score(table.withColumn("kept", F.lit("clash")), None).where("kept = false").count() == 4


@pytest.fixture(scope="module")
def extractor():
    return X.fit()


def test_extraction_held_out(extractor):
    right = total = 0
    for page in X.training_pages(150, seed=1234):
        parent, kind, feats, text = X.parse(page)
        belief, _, _ = X.marginals(parent, kind, feats, extractor)
        for t, b in zip(text, belief):
            if t is not None and t != "-x":
                total += 1
                right += (b > 0) == t.startswith("+")
    assert right / total > 0.98


def test_marginals_equal_brute_force():
    import itertools
    import math
    import random

    rnd = random.Random(3)
    model = X.Model([rnd.uniform(-1, 1) for _ in range(X.N_FEATURES)], [[rnd.uniform(-1, 1) for _ in range(4)] for _ in range(X.KINDS)])
    parent, kind = [-1, 0, 0, 1, 1, 2, 4], [0, 1, 2, 3, 4, 5, 2]
    feats = [[]] + [[rnd.randrange(X.N_FEATURES)] for _ in range(6)]
    mass = [[0.0, 0.0] for _ in parent]
    for state in itertools.product((0, 1), repeat=len(parent)):
        e = sum(model.unary[f] for s, fs in zip(state, feats) if s for f in fs)
        e += sum(model.pair[kind[i]][2 * state[parent[i]] + state[i]] for i in range(1, len(parent)))
        for i, s in enumerate(state):
            mass[i][s] += math.exp(e)
    belief, _, _ = X.marginals(parent, kind, feats, model)
    for (a, b), x in zip(mass, belief):
        assert math.log(b / a) == pytest.approx(x)


def test_extraction_of_pages(spark, extractor):
    page = '<html><head><title>T</title><script>var a="<p>no</p>"</script></head><body><nav><ul><li><a href="/">Home</a></li><li><a href="/x">More</a></li></ul></nav><div class="cookie-notice"><p>We use cookies to make it all work better for you, always.</p></div><article><h1>Big &amp; bold</h1><p>First  part<br>goes on.<p><b>Second &eacute;t&eacute; here</p><ul><li>An item of the text</li></ul></article><div class="comments"><div class="comment"><p>Nice article, I read it twice and liked it a lot.</p></div></div><footer>&copy; us</footer></body></html>'
    assert X.extract(page, extractor) == "Big & bold\n\nFirst part goes on.\n\nSecond été here\n\nAn item of the text"
    assert X.extract(None, extractor) == X.extract("", extractor) == ""
    for odd in ("<", "<<<>>>", "<p", "</p></p>", "<!-- open", "<script>open", "<div " + "a" * 1000, "<a href='x>y", "&#0;&#x110000;&amp"):
        X.extract(odd, extractor)
    df = spark.createDataFrame([(1, "u", page, "clash"), (1, "u", page, "clash"), (2, None, None, None)], "page_id bigint, url string, html string, text string")
    got = X.extract_pages(df, extractor).orderBy("page_id").collect()
    assert [(r.page_id, r.n_chars == len(r.text)) for r in got] == [(1, True), (1, True), (2, True)] and got[2].text == ""
    assert X.extract_pages(df.limit(0), extractor).count() == 0
