import hashlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from sievestone.llm import arc_convert as A
from sievestone.llm import token_counts as C


@pytest.mark.parametrize("version", [1, 2])
def test_arc_round_trip(version):
    records = [("http://h/a b c", "1.2.3.4", "20010203040506", "text/html", b"HTTP/1.1 200 OK\r\n\r\nx\n\ny"), ("dns:h", "0.0.0.0", "20010203040506", "text/dns", b""), ("http://h/z", "-", "20010203040506", "text/html", b"\n\n")]
    data = A.write_arc("f.arc", version, records)
    got = list(A.read_arc(data))
    assert got[0].fields["url"] == "filedesc://f.arc" and got[0].body.startswith(str(version).encode())
    assert [(r.fields["url"], r.fields["ip"], r.fields["date"], r.fields["type"], r.body) for r in got[1:]] == records
    assert len(got[1].fields) == len(A.FIELDS[version])
    assert all(data[r.offset :].startswith(r.fields["url"].encode()) for r in got)


def test_bad_archives():
    good = A.write_arc("f", 1, [("http://h/", "-", "2001", "t", b"abc")])
    for bad in (good[:-3], good + b"no header here\n", good.replace(b"1 0 origin", b"7 0 origin"), good + b"tail"):
        with pytest.raises(ValueError):
            list(A.read_arc(bad))
    assert list(A.read_arc(b"")) == []
    assert A.timestamp("20010203") == "2001-02-03T00:00:00Z" and A.timestamp("20010203040506") == "2001-02-03T04:05:06Z"


def test_warc_is_read_by_declared_lengths():
    row = {"type": "response", "record_id": "urn:uuid:1", "date": "2001-01-01T00:00:00Z", "target_uri": "http://h/", "ip": "-", "head": b"HTTP/1.1 200 OK\r\n\r\n", "payload": b"\r\n\r\nWARC/1.1\r\nx\r\n\r\n", "content_type": "t"}
    row |= {"payload_digest": hashlib.sha1(row["payload"]).hexdigest(), "block_digest": hashlib.sha1(row["head"] + row["payload"]).hexdigest(), "refers": None}
    raw = (A._warc(row) + b"\r\n\r\n") * 3
    for parts in ([raw], [raw[:50], raw[50:]], [p + b"\r\n\r\n" for p in raw.split(b"\r\n\r\n")[:-1]], [raw[i : i + 1] for i in range(len(raw))]):
        got = list(A.parse_warc(iter(parts)))
        assert len(got) == 3 and all(b == row["head"] + row["payload"] for _, b in got)
    with pytest.raises(ValueError):
        list(A.parse_warc(iter([raw[:-30]])))
    with pytest.raises(ValueError):
        list(A.parse_warc(iter([raw + b"tail"])))


def test_pages_through_archives(spark, tmp_path):
    big, small = "é" * 600, "x" * 999
    rows = [(1, "http://h/1", big), (7, "http://h/2", big), (3, "odd url", big), (4, "http://h/4", small), (5, "http://h/4", small), (6, None, None), (8, "http://h/8", ""), (9, "http://h/9", big + "\r\n\r\nWARC/1.1\r\n"), (9, "http://h/9", big + "\r\n\r\nWARC/1.1\r\n"), (None, "http://h/n", big)]
    spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(3).write.parquet(str(tmp_path / "pages.parquet"))
    got = A.op3_arc_convert(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    texts = {i: (t or "").encode() for i, _, t in rows}
    for r in got:
        t = texts[r.page_id]
        assert (r.payload_bytes, r.payload_digest) == (len(t), hashlib.sha1(t).hexdigest())
    kinds = sorted((r.page_id or 0, r.record_type, r.refers_to) for r in got)
    assert kinds[:2] == [(0, "revisit", 7), (1, "revisit", 7)] and (7, "response", None) in kinds and (3, "revisit", 7) in kinds
    assert (4, "response", None) in kinds and (5, "response", None) in kinds
    assert sorted(k for k in kinds if k[0] == 9) == [(9, "response", None), (9, "revisit", 9)]
    (tmp_path / "none").mkdir()
    spark.createDataFrame([], "page_id bigint, url string, html string").write.parquet(str(tmp_path / "none" / "pages.parquet"))
    assert A.op3_arc_convert(spark, str(tmp_path / "none")).count() == 0


@pytest.fixture(scope="module")
def hf():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t


@pytest.mark.parametrize("rule", C.RULES)
def test_counts_equal_brute_force(spark, hf, rule):
    docs = [(1, "src", "a line\nand another\n\n\n\nmore  \n  text"), (2, None, None), (3, "", ""), (4, "s", "\n"), (5, "é中", "中文🙂\n\né\n"), (5, "é中", "中文🙂\n\né\n"), (None, "x", "y")]
    df = spark.createDataFrame(docs, "doc_id bigint, source string, text string")
    got = C.attribute(df, "doc_id", ["source", "text"], rule).collect()
    for i, source, text in docs:
        fields = [source or "", text or ""]
        whole = "\n\n".join(fields)
        parts = [fields[0] + "\n\n", *[x + "\n" for x in fields[1].split("\n")[:-1]], fields[1].split("\n")[-1]]
        owner = [k for k, p in enumerate(parts) for _ in p.encode()]
        ids = hf.encode(whole, add_special_tokens=False).ids
        want, at = [0] * len(parts), 0
        for n in C.id_lengths("byte_bpe_50k")[ids]:
            own = owner[at : at + n]
            want[own[0] if rule == "start" else max(sorted(set(own)), key=own.count)] += 1
            at += n
        mine = sorted((r.field != "source", r.section_no, r.start_char, r.n_chars, r.n_tokens, r.doc_tokens) for r in got if r.doc_id == i)
        mine = mine[:: docs.count((i, source, text))]
        assert [r[4] for r in mine] == want and [r[3] for r in mine] == [len(p) for p in parts]
        assert all(r[5] == len(ids) for r in mine) and [r[2] for r in mine] == np.cumsum([0, *[len(p) for p in parts[:-1]]]).tolist()
    assert C.attribute(df.limit(0), "doc_id", ["text"]).count() == 0


def test_a_table_held_twice_equals_its_sql(spark, tmp_path, monkeypatch):
    """Every page in two files: of equal pages one is the response."""
    import oracle
    from conftest import SMALL
    from oracle import compare

    from sievestone.llm import queries

    pages = spark.read.parquet(f"{SMALL}/pages.parquet").coalesce(1)
    for _ in range(2):
        pages.write.mode("append").parquet(str(tmp_path / "pages.parquet"))
    sql = queries.ORACLE_SQL["op3_arc_convert"].replace("FROM pages", f"FROM '{tmp_path}/pages.parquet/*.parquet'")
    monkeypatch.setattr(oracle, "TABLES", [])
    assert compare(spark, queries.QUERIES["op3_arc_convert"], sql, str(tmp_path)) == ""
    got = A.op3_arc_convert(spark, str(tmp_path)).where("payload_bytes >= 1000").groupBy("payload_digest").agg({"record_type": "collect_list"}).collect()
    assert got and all(sorted(r[1])[0] == "response" and sorted(r[1])[1:] == ["revisit"] * (len(r[1]) - 1) and len(r[1]) > 1 for r in got)
