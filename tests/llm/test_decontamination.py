from pyspark.sql import functions as F

from sievestone.llm import decontamination as D

ITEM = "A train leaves the old station at 9:30 and covers 120 km before it reaches the coast, then it covers 120 km more on the way back home."
BENCH = [(1, ITEM), (2, "short text of five words"), (3, None), (4, ""), (5, "one two"), (6, "We asked that Maria and Peter whether Maria could lend him seven old books about the history of painting in the north.")]


def found(spark, docs, bench=BENCH):
    d = spark.createDataFrame(docs, "doc_id bigint, text string, item_id string")
    b = spark.createDataFrame(bench, "item_id bigint, text string")
    return {(r.doc_id, r.item_id): r for r in D.matches(d, b).collect()}


def test_exact_and_reparameterised(spark):
    docs = [
        (1, f"before this, {ITEM} and after", "x"),
        (2, ITEM.replace("120", "75").replace("9:30", "7.15"), "x"),  # one value for one value
        (3, ITEM.replace("120 km more", "90 km more"), "x"),  # 120 becomes 120 and 90
        (4, ITEM.replace("120 km", "75 miles"), "x"),
        (5, "The cats sleep all day and nobody minds it at all because they hunt the mice at night.", "x"),
        (6, "and yet short text of five words here", "x"),
        (7, BENCH[5][1].replace("Maria", "Olga").replace("Peter", "Ivan"), "x"),
        (8, BENCH[5][1].replace("whether Maria", "whether Ivan").replace("Peter", "Ivan"), "x"),
        (9, None, "x"),
        (10, "", "x"),
        (None, ITEM, "x"),
    ]
    got = found(spark, docs)
    assert {k for k in got} == {(1, 1), (2, 1), (4, 1), (6, 2), (7, 6), (None, 1)}
    assert got[(1, 1)].first_word == 2 and got[(2, 1)].n_slots > 0


def test_partial_passages(spark):
    words = ITEM.split()
    rows = [(n, "lead in, " + " ".join(words[2 : 2 + n]), "x") for n in (8, 12, 20)]
    got = found(spark, rows)
    assert (20, 1) in got and (8, 1) not in got


def test_first_word_after_a_comma(spark):
    got = found(spark, [(1, "they said, Nobody in the village owns a larger dog here", "x")], [(1, "Nobody in the village owns a larger dog")])
    assert set(got) == {(1, 1)}


def test_capitals_and_small_letters(spark):
    docs = [(i, f"SOME MORE OF IT!! {t.upper()}!! AND THE REST", "x") for i, t in ((1, ITEM), (2, BENCH[5][1]))] + [(3, f"and so on {BENCH[5][1].lower()} and so on", "x")]
    assert set(found(spark, docs)) == {(1, 1), (2, 6), (3, 6)}


def test_repeats_and_empty_tables(spark):
    docs = [(1, ITEM, "x"), (1, ITEM, "x"), (2, "\n".join([ITEM] * 3), "x")]
    got = found(spark, docs)
    assert set(got) == {(1, 1), (2, 1)} and got[(1, 1)].n_windows == got[(1, 1)].item_windows
    assert found(spark, []) == {}
    assert found(spark, docs, []) == {}


def brute(docs, bench, words):
    leaks = set()
    for d, dw in docs.items():
        for i, iw in bench.items():
            if len(iw) < D.SHORTEST:
                continue
            w = min(D.WIDTH, len(iw))
            n = len(iw) - w + 1
            need = min(D.RUN - D.WIDTH + 1, n)
            for diagonal in range(-len(iw), len(dw)):
                hits = sum(1 for a in range(n) if 0 <= a + diagonal <= len(dw) - w and iw[a : a + w] == dw[a + diagonal : a + diagonal + w])
                if hits >= need:
                    leaks.add((d, i))
    return leaks


def test_equals_brute_force_without_slots(spark):
    import random

    rnd = random.Random(2)
    word = lambda: rnd.choice("ka lo mi ru sen".split())
    bench = {i: [word() for _ in range(rnd.choice((3, 5, 8, 15, 30)))] for i in range(8)}
    docs = {}
    for d in range(30):
        w = [word() for _ in range(rnd.randrange(12))]
        src = bench[rnd.randrange(8)]
        a = rnd.randrange(len(src))
        docs[d] = w + src[a : a + rnd.randrange(1, 30)] + [word() for _ in range(rnd.randrange(5))]
    got = found(spark, [(d, " ".join(w), "x") for d, w in docs.items()], [(i, " ".join(w)) for i, w in bench.items()])
    assert set(got) == brute(docs, bench, None)


def test_native_plan(spark):
    d = spark.createDataFrame([(1, ITEM)], "doc_id bigint, text string")
    b = spark.createDataFrame(BENCH, "item_id bigint, text string")
    plan = D.matches(d, b)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_words_align(spark):
    t = "At 1:30 we met Anna, then 5kg of rice for Bob at 12.5 % came_late. 3 m"
    r = spark.range(1).select(D.words(F.lit(t)).alias("w"), D.slot_words(F.lit(t)).alias("s")).first()
    assert len(r.w) == len(r.s)
    assert [a[:2] == b[:2] if a.startswith(D.OPEN) else a == b for a, b in zip(r.w, r.s)] == [True] * len(r.w)


RICH = [
    (1, "Which of these is prime: 12, 15, 17, 21, 25, 27, 33, 35, 39, 49?"),
    (2, "Compute 12 + 7 * 3 - 4 / 2 + 9 * 5 - 6 + 8."),
    (3, "Who wrote the novel War and Peace, Leo Tolstoy, Fyodor Dostoevsky, Anton Chekhov or Ivan Turgenev?"),
    (4, "7 8 9 kg"),
]


def test_verbatim_copies_of_items_rich_in_placeholders(spark):
    docs = [(i, f"it was asked there. {t} And so on", "x") for i, t in RICH] + [(10 + i, t.upper(), "x") for i, t in RICH]
    docs += [(21, RICH[0][1].replace("17", "18").replace("27", "28"), "x"), (22, "Compute 1 + 2 * 3 - 4 / 5 + 6 * 7 - 8 + 9.", "x"), (23, RICH[2][1].replace("Leo", "Eva").replace("Anton", "Olga").replace("Dostoevsky", "Berg"), "x")]
    got = found(spark, docs, RICH)
    # 21 and 23 ask the same of other values; 22 has no words of its own besides its values
    assert set(got) == {(i, i) for i, _ in RICH} | {(10 + i, i) for i, _ in RICH} | {(21, 1), (23, 3)}
    assert all(r.n_windows == r.item_windows for k, r in got.items() if k[0] < 10)


def test_canonical_words_from_slots(spark):
    texts = [ITEM, BENCH[5][1], *[t for _, t in RICH], "At 1:30 we met Anna, then 5kg of rice for Bob at 12.5 % came_late. 3 m", "", None]
    for r in spark.createDataFrame([(t,) for t in texts], "t string").select(D.words(F.col("t")).alias("w"), D.canonical(D.slot_words(F.col("t"))).alias("c")).collect():
        assert r.w == r.c


SHORT = [
    (1, "Tom walks 3 km in 40 minutes and 7 km in 90 minutes"),
    (2, "What is 12 kg plus 15 kg plus 18 kg plus 20 kg"),
    (3, "Who was Ada Lovelace"),
    (4, "Define entropy briefly"),
    (5, "Photosynthesis?"),
    (6, "If Tom has 5 apples and gives 2 apples to Anna Berg, how many apples are left?"),
    (7, "The farmer sold twenty-five sheep at 9:30 on the market of the old town."),
]


def test_short_items_and_spelled_numbers(spark):
    docs = [(i, f"So they asked, {t} That was all.", "x") for i, t in SHORT if i != 5] + [(5, "a line\nphotosynthesis\nmore", "x"), (50, "the photosynthesis of plants", "x")]
    docs += [
        (16, "so if Sue has five apples and gives three apples to Karl Otto Meyer, how many apples are left?", "x"),
        (17, "The farmer sold 31 sheep at 7.15 on the market of the old town.", "x"),
        (11, "then Eva walks 5 km in 60 minutes and 9 km in 80 minutes", "x"),
        (21, "it weighs 12 kg plus 15 kg", "x"),
        (22, "nobody could define entropy", "x"),
    ]
    got = found(spark, docs, SHORT)
    assert set(got) == {(i, i) for i, _ in SHORT} | {(16, 6), (17, 7), (11, 1)}
    assert got[(5, 5)].first_word is None


def test_quoted_over_other_line_breaks(spark):
    item = "In the old harbour Maria Berg sold\nher boats to the brothers Ivan and Peter Holm from the north."
    docs = [(1, item.replace("\n", " "), "x"), (2, item.replace(" ", "\n"), "x"), (3, "“" + item.replace("\n", "  ") + "”", "x"), (4, item.replace("Maria Berg", "Eva").replace("Ivan", "Karl"), "x")]
    assert set(found(spark, docs, [(1, item)])) == {(i, 1) for i in range(1, 5)}


def test_stage_judges_rows_by_their_texts(spark, tmp_path):
    clean = "The cats sleep all day and nobody minds it at all because they hunt the mice at night."
    rows = [(1, ITEM, 7), (1, clean, 7), (None, ITEM, 7), (None, clean, 7), (2, None, 7), (3, "", 7), (4, ITEM + " x" * 200_000, 7)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, item_id int").withColumns({c: F.lit(1) for c in ("h", "text_hash", "width", "_leak")})
    spark.createDataFrame([(1, ITEM)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = D.stage(spark, docs, str(tmp_path))
    assert got.columns == docs.columns
    assert sorted((str(r.doc_id), r.text) for r in got.select(docs.doc_id, "text").collect() if r.text) == [("1", clean), ("None", clean)]
    assert got.count() == 4 and D.stage(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_recall_of_every_item_of_the_fixture(spark):
    """Every item verbatim, in capitals, and with other values; clean documents are left alone."""
    import re

    items = [(r.item_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet").collect()]
    rename = lambda t: re.sub(r"\d+", lambda m: str(int(m[0]) + 3), re.sub(r"(?<=[a-z,;] )([A-Z][a-z]+)", lambda m: "Q" + m[0].lower(), t))
    docs = [(i, f"before it. {t} After it", "x") for i, t in items] + [(1000 + i, t.upper(), "x") for i, t in items] + [(2000 + i, rename(t), "x") for i, t in items]
    got = {k for k in found(spark, docs, items)}
    hit = lambda base: sum((base + i, i) in got for i, _ in items) / len(items)
    assert hit(0) == 1 and hit(1000) == 1 and hit(2000) >= 0.9
    assert not [k for k in got if k[0] % 1000 != k[1] and dict(items)[k[0] % 1000] not in dict(items)[k[1]] and dict(items)[k[1]] not in dict(items)[k[0] % 1000]]
