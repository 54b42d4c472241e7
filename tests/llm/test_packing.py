import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from sievestone.llm import packing as P


@pytest.fixture(scope="module")
def hf():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t


def test_encoder_equals_the_tokenizer(hf):
    rnd = random.Random(1)
    letters = list(" \n\t\r\x0b\x85\xa0abzÉß'’12²½.,!?—€$_ªº\x1c中é🙂\x00") + ["'s", "'re", "don't", "  ", "\n\n", "<|endoftext|>"]
    texts = ["".join(rnd.choice(letters) for _ in range(rnd.randrange(20))) for _ in range(2000)]
    for t, e in zip(texts, hf.encode_batch(texts, add_special_tokens=False)):
        assert np.frombuffer(P.encoder()(t), "<u4").tolist() == e.ids, repr(t)


def test_cut():
    assert P.cut(1) == [1] and P.cut(256) == [256] and P.cut(600) == [256, 256, 64, 16, 8]
    assert all(sum(P.cut(n)) == n for n in range(1, 2000))


def test_pack_is_a_partition_of_all_ids(spark, hf):
    rnd = random.Random(4)
    docs = [(i, f"s{rnd.randrange(4)}" if i % 9 else None, " ".join(rnd.choice(("word", "été", "x9", "long-ish")) for _ in range(rnd.choice((0, 1, 30, 400, 3000))))) for i in range(120)]
    docs += [(500, "s1", None), (500, "s1", None), (None, "s2", "no id")]
    df = spark.createDataFrame(docs, "doc_id bigint, source string, text string")
    rows = P.pack(df, ["doc_id", "source"], lane_tokens=1 << 14).toPandas()
    sizes = rows.groupby("sequence_id").length.sum()
    assert sorted(sizes.index) == list(range(len(sizes)))
    assert all(n == 1024 or n & (n - 1) == 0 for n in sizes)
    x = rows.sort_values(["sequence_id", "offset"])
    assert ((x.offset + x.length).groupby(x.sequence_id).shift(fill_value=0) == x.offset).all()
    texts = {i: t for i, _, t in docs if i is not None}
    for i, g in rows[rows.doc_id.notna() & (rows.doc_id != 500)].groupby("doc_id"):
        ids = hf.encode(texts[int(i)] or "", add_special_tokens=False).ids + [0]
        g = g.sort_values("start")
        assert g.start.tolist() == (g.length.cumsum() - g.length).tolist() and g.length.sum() == len(ids) == g.doc_tokens.iloc[0]
        for r in g.itertuples():
            assert zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32
    assert len(rows[rows.doc_id == 500]) == 2


def test_windows_follow_the_mixture():
    # three sources of 60, 30 and 10 per cent: no prefix of windows strays by more than some blocks
    n = {0: 600, 1: 300, 2: 100}
    queue = np.concatenate([np.full(c, q) for q, c in n.items()])
    length = np.full(len(queue), 256)
    share = np.array([0.6, 0.3, 0.1])
    seq, off = P.fill(length, queue, share, np.zeros(3))
    order = np.lexsort((off, seq))
    got = np.stack([np.cumsum(queue[order] == q) for q in range(3)], 1)
    want = np.arange(1, len(queue) + 1)[:, None] * share
    assert np.abs(got - want).max() <= 4


def test_deficits_are_carried_into_a_lane():
    queue = np.array([0] * 20 + [1] * 20)
    seq, off = P.fill(np.full(40, 256), queue, np.array([0.5, 0.5]), np.array([-2048.0, 2048.0]))
    first = queue[np.lexsort((off, seq))][:8]
    assert (first == 1).all()


def test_weights_and_empty(spark):
    df = spark.createDataFrame([(i, f"s{i % 2}", "word " * 600) for i in range(40)], "doc_id bigint, source string, text string")
    rows = P.pack(df, ["doc_id", "source"], weights={"s0": 3.0, "s1": 1.0}).toPandas()
    early = rows[rows.sequence_id < 8]
    assert early[early.source == "s0"].length.sum() > 2 * early[early.source == "s1"].length.sum()
    assert P.pack(df.limit(0), ["doc_id", "source"]).count() == 0


def test_a_long_text_is_not_copied_for_each_piece(spark, monkeypatch):
    # what a worker runs, on 400 pieces of a text of 200,000 letters
    df = spark.createDataFrame([], "doc_id bigint, source string, text string")
    found = []
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, run, schema: found.append(run))
    P.pieces(df, ["doc_id", "source"])
    text = "a " * 102_400
    batch = pa.record_batch({"doc_id": [1, 2], "source": ["s", "s"], "row_key": [5, 6], "queue": ["=s", "=s"], "_text": [text, None]})
    before = pa.total_allocated_bytes()
    out = found[0](iter([batch]))
    got = [next(out)]  # its own rows are still held
    assert pa.total_allocated_bytes() - before < len(text)
    rows = pa.Table.from_batches([*got, *out]).to_pandas()
    ids = np.frombuffer(P.encoder()(text), "<u4").tolist() + [P.END]
    one, two = rows[rows.doc_id == 1], rows[rows.doc_id == 2]
    assert one.length.tolist() == P.cut(len(ids)) and len(one) >= 400 and two.length.tolist() == [1]
    assert all(zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32 for r in one.itertuples())
