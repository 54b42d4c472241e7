import itertools
import random

from pyspark.sql import functions as F

from sievestone.llm import line_dedup as L


def one_edit(a: str, b: str) -> bool:
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


def brute(docs):
    lines = [(d, n, x) for d, t in docs for n, x in enumerate((t or "").split("\n"))]
    long = sorted({x for _, _, x in lines if len(x) >= L.EDIT_CHARS})
    up = {x: x for _, _, x in lines if x.strip(" ")}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in itertools.combinations(long, 2):
        if one_edit(a, b):
            up[find(a)] = find(b)
    first = {}
    for d, n, x in sorted(lines):
        if x in up:
            first.setdefault(find(x), (d, n))
    return {(d, n): first[find(x)] if x in up else (d, n) for d, n, x in lines}


def fixture():
    rnd = random.Random(5)
    base = ["".join(rnd.choice("abcdé ") for _ in range(rnd.choice((32, 33, 40, 41, 64, 97)))) for _ in range(12)]
    docs = []
    for i in range(150):
        some = []
        for _ in range(rnd.randrange(4)):
            x = list(rnd.choice(base))
            for _ in range(rnd.randrange(3)):
                at = rnd.randrange(len(x))
                what = rnd.randrange(3)
                if what == 0:
                    x[at] = rnd.choice("xyz")
                elif what == 1:
                    del x[at]
                else:
                    x.insert(at, rnd.choice("xyz"))
            some.append("".join(x))
        docs.append((i, "\n".join(some) if i % 7 else rnd.choice(("", "short", None))))
    return docs


def test_classes_equal_brute_force(spark):
    docs = fixture()
    got = L.line_classes(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()
    assert {(r.doc_id, r.line_no): (r.class_doc_id, r.class_line_no) for r in got} == brute(docs)
    assert all(r.kept == ((r.doc_id, r.line_no) == (r.class_doc_id, r.class_line_no)) for r in got)


def test_many_variants_of_a_line(spark):
    base = "0123456789" * 5
    docs = [(i, base[: i % 50] + chr(200 + i // 50) + base[i % 50 + 1 :]) for i in range(400)]
    got = L.line_classes(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()
    assert {(r.doc_id, r.line_no): (r.class_doc_id, r.class_line_no) for r in got} == brute(docs)


def test_many_lines_one_letter_longer(spark):
    base = "".join(random.Random(9).choice("abcdef ") for _ in range(1500))
    docs = [(i, base[: 50 * i + 7] + chr(200 + i) + base[50 * i + 7 :]) for i in range(30)]
    docs += [(100 + i, base[:700] + chr(200 + i) + base[700:]) for i in range(30)] + [(200 + i, "x" + base[1 : 40 * i + 40] + "-" + base[40 * i + 41 :]) for i in range(30)]
    for some in (docs, [*docs, (300, base)]):
        got = L.line_classes(spark.createDataFrame(some, "doc_id bigint, text string")).collect()
        assert {(r.doc_id, r.line_no): (r.class_doc_id, r.class_line_no) for r in got} == brute(some)


def test_edit_distance(spark):
    rnd = random.Random(3)
    pairs = [("".join(rnd.choice("abé") for _ in range(rnd.randrange(9))), "".join(rnd.choice("abé") for _ in range(rnd.randrange(9)))) for _ in range(300)]
    rows = spark.createDataFrame(pairs, "a string, b string").select("*", F.levenshtein("a", "b").alias("d"), *[L.edits_within(F.col("a"), F.col("b"), t).alias(f"t{t}") for t in (1, 2, 3)]).collect()
    for r in rows:
        for t in (1, 2, 3):
            assert r[f"t{t}"] == (r.d if r.d <= t else None), r


def test_texts_and_odd_tables(spark):
    line = "a line that is long enough to be compared with others"
    docs = [(1, f"{line}\nshort\n{line}", 9), (2, f"{line}!", 9), (3, None, 9), (4, "short\nshort", 9), (5, f"{line}\nand one of its own that is quite long too", 9), (1, f"{line}\nshort\n{line}", 9)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, n_chars bigint").withColumn("row_key", F.lit("x"))
    got = L.dedup_lines(df).orderBy("doc_id").collect()
    assert got[0].row_key == "x"
    assert [(r.doc_id, r.text) for r in got] == [(1, f"{line}\nshort"), (1, f"{line}\nshort"), (3, None), (5, "and one of its own that is quite long too")]
    assert L.dedup_lines(df.limit(0)).count() == 0
    assert L.line_classes(df.where("doc_id = 3")).count() == 1


def test_repeats_of_any_length_and_clashing_columns(spark):
    docs = [(1, "Share this page\n\nfirst"), (2, "Share this page\n\nsecond"), (3, "Share this page\n \n\nfirst"), (None, "of no id\nShare this page"), (5, "x" * 100_000 + "\nsecond")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    clash = {c: F.lit(i) for i, c in enumerate(("_text", "_left", "_key", "_gone", "left", "key", "gone", "id", "line", "row"))}
    got = L.dedup_lines(df.withColumns(clash))
    rows = {r.doc_id: r.text for r in got.collect()}
    assert got.columns == ["doc_id", "text", *clash] and [got.first()[c] for c in clash] == list(range(len(clash)))
    assert rows == {None: "of no id\nShare this page", 1: "\nfirst", 2: "\nsecond", 5: "x" * 100_000}
