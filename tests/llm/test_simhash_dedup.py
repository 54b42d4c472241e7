import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from sievestone.llm import simhash_dedup as S
from sievestone.llm.components import components


def slow_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hs = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_fingerprint():
    rnd = random.Random(1)
    for t in [None, "", " \t\n", "One", "a b", "É\xa0b C", *[" ".join(rnd.choice("AbcÉ") for _ in range(rnd.randrange(60))) for _ in range(50)]]:
        assert S.fingerprint(t) == slow_fingerprint(t)


def neighbours(points, radius):
    d = np.bitwise_count(points[:, None] ^ points[None, :])
    return {(i, j) for i in range(len(points)) for j in range(i) if d[i, j] <= radius}


def test_trees_find_all_neighbours():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**64, 6, dtype=np.uint64)
    points = np.unique(np.concatenate([base, *[base[rng.integers(6, size=40)] ^ (np.uint64(1) << rng.integers(0, 64, 40).astype(np.uint64)) for _ in range(3)]]))
    rng.shuffle(points)
    got = {(int(a), int(b)) for x, y in S.Forest(np.zeros(len(points), int), points).neighbours(3) for a, b in zip(x, y)}
    assert got == neighbours(points, 3)


def test_plans_are_exact():
    rng = np.random.default_rng(3)
    for n in (10, 10**7, 10**10, 10**13):
        tables = S.plan_blocks(n)
        for _ in range(200):
            x = int(rng.integers(0, 2**63))
            y = x
            for b in rng.choice(64, 3, replace=False):
                y ^= 1 << int(b)
            assert any(all((x >> s) % (1 << w) == (y >> s) % (1 << w) for s, w in t) for t in tables)


def brute_components(texts):
    fp = np.array([S.fingerprint(t) for _, t in texts], np.uint64)
    near = np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 3
    ids = np.array([i for i, _ in texts])
    while True:
        new = np.array([ids[near[i]].min() for i in range(len(ids))])
        if (new == ids).all():
            return ids.tolist()
        ids = new


def brute_near(texts):
    """The smallest id of each text's component: links at a Jaccard similarity of 4/5 of the sets of five-word shingles."""
    sets = []
    for _, t in texts:
        w = (t or "").encode().lower().split()
        sets.append({b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    ids = [i for i, _ in texts]
    near = [[j for j in range(len(sets)) if (sets[i] == sets[j]) or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) > 0] for i in range(len(sets))]
    while True:
        new = [min(ids[j] for j in near[i]) for i in range(len(ids))]
        if new == ids:
            return ids
        ids = new


def fixture():
    rnd = random.Random(7)
    word = lambda: rnd.choice("alpha beta gamma delta eps zeta".split()) + str(rnd.randrange(40))
    base = [[word() for _ in range(rnd.choice((30, 200, 400)))] for _ in range(12)]
    texts = []
    for i in range(150):
        w = list(rnd.choice(base))
        for _ in range(rnd.randrange(3)):
            w[rnd.randrange(len(w))] = word()
        texts.append((i, " ".join(w) if i % 11 else rnd.choice(("", "one", "ONE", "one two"))))
    return texts


def test_near_duplicates_equal_brute_force(spark):
    texts = fixture()
    got = {r.doc_id: r.component_id for r in S.near_duplicates(spark.createDataFrame(texts, "doc_id bigint, text string"), ["doc_id"]).collect()}
    assert [got[i] for i, _ in texts] == brute_components(texts)


def test_stage_and_odd_rows(spark):
    rows = [(3, "same words here again", "x"), (1, "same words here again", "y"), (1, "same words here again", "y"), (2, None, "z"), (4, "", "z"), (None, "a text of its own that nobody shares", "n")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, fp string")
    got = S.stage(spark, df, "")
    assert got.columns == df.columns
    assert sorted((r.doc_id or 0, r.fp) for r in got.collect()) == [(0, "n"), (1, "y"), (2, "z")]
    assert S.near_duplicates(df.limit(0), ["doc_id"]).count() == 0


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(30)] + [(7, 7), (100, 101)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert got == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(30)}
    assert components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0


def shingles(text):
    words = (text or "").encode().lower().split()
    return frozenset(b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def brute_links(texts):
    """Pairs of texts, by index, whose five-word shingles have a similarity of 0.8 or more."""
    sets = [shingles(t) for t in texts]
    alike = lambda a, b: a == b or 5 * len(a & b) >= 4 * len(a | b) and len(a & b) > 0
    return {(i, j) for j in range(len(sets)) for i in range(j) if alike(sets[i], sets[j])}


def near_texts():
    """Texts about the similarity of 0.8: long and short ones, with words replaced, put in, cut off and repeated."""
    rnd = random.Random(11)
    word = lambda: f"w{rnd.randrange(3000)}"
    base = [[word() for _ in range(n)] for n in (5, 8, 9, 12, 20, 40, 60, 120, 200, 300, 400, 900) for _ in range(3)]
    texts = []
    for w in base:
        texts.append(" ".join(w))
        for k in range(8):
            x = list(w)
            for _ in range(rnd.randrange(1, 2 + len(w) // 40)):
                at = rnd.randrange(len(x))
                x[at : at + rnd.randrange(2)] = [word()]
            if k % 4 == 1:
                x = x[: len(x) - rnd.randrange(1, 2 + len(x) // 5)]
            texts.append(" ".join(x).upper() if k % 4 == 2 else " ".join(x))
        texts.append(" ".join(w + w[-6:] * 30))
    return texts


def roots_of(n, links):
    up = list(range(n))
    for i, j in sorted(links, key=lambda x: x[1]):
        a, b = up[i], up[j]
        up = [min(a, b) if x in (a, b) else x for x in up]
    return up


def test_stage_keeps_one_of_each_component_of_near_copies(spark):
    texts = near_texts()
    links = brute_links(texts)
    far = sum(bin(S.fingerprint(texts[i]) ^ S.fingerprint(texts[j])).count("1") > 3 for i, j in links)
    assert far > len(links) / 2  # the query's radius misses most
    up = roots_of(len(texts), links)
    got = S.stage(spark, spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), "")
    assert sorted(r.doc_id for r in got.collect()) == sorted(set(up))


def test_stage_finds_the_pairs_that_brute_force_finds(spark, monkeypatch):
    texts = near_texts()
    rows = spark.createDataFrame([(i, i, t) for i, t in enumerate(texts)], "_row bigint, doc_id bigint, text string")
    want = brute_links(texts)
    assert len(want) > 200
    sets = S._prefixes(rows, "text")
    clusters = S.components(S._candidates(sets)).select(F.col("node").alias("_row"), F.col("root").alias("cluster")).join(sets.select("_row", "n"), "_row")
    for block in (S.BLOCK, 500):  # as it is, and with clusters cut into blocks
        monkeypatch.setattr(S, "BLOCK", block)
        found = [(min(r.u, r.v), max(r.u, r.v)) for r in S._similar(clusters, rows, "text", forest=False).collect()]
        assert len(found) == len(set(found)) and set(found) == want
        forest = {(min(r.u, r.v), max(r.u, r.v)) for r in S._similar(clusters, rows, "text").collect()}
        assert forest <= closure(len(texts), want) and roots_of(len(texts), forest) == roots_of(len(texts), want)


def closure(n, links):
    up = roots_of(n, links)
    return {(i, j) for j in range(n) for i in range(j) if up[i] == up[j]}


@pytest.mark.parametrize(("tile", "hashes", "columns"), [(512, 1 << 17, 1 << 12), (2, 1 << 17, 3), (7, 40, 5)])
def test_tiles_compare_every_pair_once(monkeypatch, tile, hashes, columns):
    for name, value in (("TILE", tile), ("TILE_HASHES", hashes), ("COLUMNS", columns)):
        monkeypatch.setattr(S, name, value)
    rng = np.random.default_rng(4)
    sets = [np.sort(rng.choice(30 * (i // 2 % 2) + np.arange(30), rng.integers(1, 31), replace=False)) for i in range(60)]
    sets += [sets[0], np.arange(1000, 1400), np.arange(1010, 1405)]
    alike = lambda i, j: 9 * len(np.intersect1d(sets[i], sets[j])) >= 4 * (len(sets[i]) + len(sets[j]))
    for block in (np.zeros(len(sets), int), np.arange(len(sets)) % 2):
        got = [tuple(sorted(p)) for a, b in S.similar_pairs(0, block.max(), block, sets) for p in zip(a.tolist(), b.tolist(), strict=True)]
        want = {(i, j) for j in range(len(sets)) for i in range(j) if alike(i, j) and (not block.any() or block[i] != block[j])}
        assert len(got) == len(set(got)) and set(got) == want and len(want) > 5


def test_stage_with_null_and_shared_ids(spark):
    a, b, c = ("a text of its own that nobody shares", "another one which is nobody else's either", "and a third that is like none of them at all")
    rows = [(None, a), (None, b), (None, b), (None, c), (1, c), (2, "the one text of the two under an id"), (2, "quite other words stand in the second of them"), (2, None)]
    got = S.stage(spark, spark.createDataFrame(rows, "doc_id bigint, text string"), "").collect()
    want = [(None, a), (None, b), (1, c), (2, None), (2, rows[5][1]), (2, rows[6][1])]
    key = lambda r: (r[0] or 0, r[1] or "")
    assert sorted([tuple(r) for r in got], key=key) == sorted(want, key=key)


def test_stage_keeps_the_smallest_text_of_an_id(spark):
    text = " ".join(f"word{i}" for i in range(60))
    rows = [(None, "A " + text, 1), (5, text + " z", 1), (5, text + " b", 3), (5, text + " b", 2), (7, "B " + text, 1)]
    got = S.stage(spark, spark.createDataFrame(rows, "doc_id bigint, text string, n bigint").repartition(3), "").collect()
    assert [tuple(r) for r in got] == [(5, text + " b", 2)]


def test_a_large_group_is_linked_without_its_pairs(spark):
    """Many near copies of one text, and texts that are like their neighbours alone."""
    import random

    rnd = random.Random(8)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(6))
    base = [word() for _ in range(120)]
    texts = [" ".join([*base[: i % 100], word(), *base[i % 100 + 1 :]]) for i in range(300)]
    chain = [word() for _ in range(400)]
    texts += [" ".join(chain[6 * i : 6 * i + 100]) for i in range(40)]
    rows = spark.createDataFrame([(i, i, t) for i, t in enumerate(texts)], "_row bigint, doc_id bigint, text string")
    assert S._candidates(S._prefixes(rows, "text")).where("u < 300").count() < 20 * 300 < 300 * 299 // 2
    got = {r.doc_id: r.component for r in S.near_copies(rows).collect()}
    assert got == {d: 0 if d < 300 else 300 for d in range(len(texts))}
    assert [got[d] for d in range(len(texts))] == brute_near(list(enumerate(texts)))


def test_long_texts_in_pieces():
    text = " ".join(f"w{i % 977} \t{i}" for i in range(200_000)) + "\n" + "x" * 3_000_000
    words = text.encode().split()
    for width in (1, 3, 5):
        got = np.concatenate(list(S.shingle_digests(text, width)))
        want = [xxhash.xxh64_digest(b" ".join(words[i : i + width]), S.SEED) for i in range(len(words) - width + 1)]
        assert got.tobytes() == b"".join(want)
    assert len(np.concatenate(list(S.shingle_digests("a b", 3)))) == 1 and not list(S.shingle_digests(" \n", 3))


def test_a_passage_of_many_unlike_texts_is_no_shard(spark):
    """Texts that share a passage alone don't meet; near copies are found as ever, even if they share little but the passage."""
    rnd = random.Random(9)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(7))
    passage = [word() for _ in range(30)]
    own = [[word() for _ in range(rnd.randrange(60, 90))] for _ in range(600)]
    texts = [" ".join(w[:20] + passage + w[20:]) for w in own]
    texts += [" ".join([*passage, *(word() for _ in range(k % 4))]) for k in range(60)]
    texts += [" ".join(w[:20] + passage + w[20:-2]) for w in own[:40]]
    rows = spark.createDataFrame([(i, i, t) for i, t in enumerate(texts)], "_row bigint, doc_id bigint, text string")
    largest = lambda sets: sets.select(F.explode("prefix").alias("key")).groupBy("key").count().agg(F.max("count")).first()[0]
    assert largest(S._prefixes(rows, "text")) >= 600
    assert largest(S._prefixes(rows, "text", S._common(rows, "text"))) <= 60
    got = {r.doc_id: r.component for r in S.near_copies(rows).collect()}
    assert [got.get(d, d) for d in range(len(texts))] == brute_near(list(enumerate(texts)))


def test_order_of_prefixes_puts_common_shingles_last():
    common = np.array([50, 7, 30], np.uint64)  # rarest first
    hashes = np.array([7, 10, 30, 40, 50, 60], np.uint64)
    assert S.Order(common).first(hashes, 5).tolist() == [10, 40, 60, 50, 7]
    assert S.Order(None).first(hashes, 2).tolist() == [7, 10]


@pytest.mark.parametrize("side", [1 << 10, 7])
def test_tiles_connect_what_trees_connect(monkeypatch, side):
    monkeypatch.setattr(S, "SIDE", side)
    rng = np.random.default_rng(6)
    few = lambda k: np.bitwise_and.reduce(rng.integers(0, 2**64, (3, k), dtype=np.uint64))
    base, size = rng.integers(0, 2**64, (2, 30), dtype=np.uint64), rng.integers(20, 400, 30)
    of = rng.integers(30, size=500)
    n = size[of] + rng.integers(0, 60, 500)
    shards = S.Shards(np.zeros(500, int), np.arange(500), n, rng.integers(0, 1 + n // 5), base[0][of] ^ few(500), base[1][of] ^ few(500))
    trees, tiles = S._roots(shards.by_trees()), S._roots(shards.by_tiles())
    assert (trees == tiles).all() and 30 < len(set(trees.tolist())) < 450
    got = np.concatenate([np.stack(x) for x in shards.links()], axis=1)
    assert (S._roots(S._unite(np.arange(500), *got)) == trees).all()


def test_a_large_group_of_alike_texts_is_not_compared_pair_by_pair(monkeypatch):
    compared = []
    meet = S.Shards._meet
    monkeypatch.setattr(S.Shards, "_meet", lambda self, parent, a, b: compared.append(len(a) * len(b)) or meet(self, parent, a, b))
    k = 20_000
    rng = np.random.default_rng(5)
    fp = np.uint64(12345) ^ (np.uint64(1) << rng.integers(0, 64, k).astype(np.uint64))
    links = list(S.Shards(np.zeros(k, int), np.arange(k), np.full(k, 100), np.zeros(k, int), fp, fp).links())
    assert sum(len(a) for a, _ in links) == k - 1 and sum(compared) < 100 * k
