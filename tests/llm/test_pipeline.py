import re
import zlib

import numpy as np
import pytest
import test_line_dedup
import test_simhash_dedup
from conftest import SMALL
from oracle import compare

import __spark_entry__ as entry
import corpus_pipeline
from sievestone.llm import language_id, packing, queries


def test_stages():
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "line_dedup", "simhash_dedup", "decontamination", "packing"]


def test_every_operator_is_registered():
    found = entry.queries()
    assert "pipeline" in found
    for n in range(1, 11):
        assert sum(q.startswith(f"op{n}_") for q in found) == 1


def test_run_keeps_the_columns_and_the_ids(spark):
    sf = SMALL
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept, columns = docs, docs.columns
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, sf)
        assert kept.columns == columns
    rows = corpus_pipeline.run(spark, sf)
    ids = {r.doc_id for r in rows.select("doc_id").distinct().collect()}
    assert ids == {r.doc_id for r in kept.select("doc_id").collect()} and 100 < len(ids) <= 200



def after_line_dedup(docs):
    first = test_line_dedup.brute(docs)
    out = []
    for d, t in docs:
        lines = (t or "").split("\n")
        left = [x for n, x in enumerate(lines) if first[(d, n)] == (d, n)]
        if len(left) == len(lines):
            out.append((d, t))
        elif "".join(left).strip(" "):
            out.append((d, "\n".join(left)))
    return out


def leaks(docs, items):
    """Documents that share thirteen words in a row, or a whole item, with the benchmark."""
    words = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    passages = set()
    for t in items:
        w = words(t)
        n = min(13, len(w))
        passages |= {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n >= 4 else set()
    sizes = {len(p) for p in passages}
    return {d for d, t in docs if any(tuple(w[i : i + n]) in passages for w in [words(t)] for n in sizes for i in range(len(w) - n + 1))}


def test_run_equals_brute_force(spark):
    sf = SMALL
    table = spark.read.parquet(f"{sf}/documents.parquet")
    docs = [(r.doc_id, r.text) for r in table.orderBy("doc_id").collect()]
    source = {r.doc_id: r.source for r in table.collect()}
    rejected = language_id.predict([t for _, t in docs], language_id.fit(table))[2]
    docs = after_line_dedup([d for d, gone in zip(docs, rejected) if not gone])
    docs = [d for d, root in zip(docs, test_simhash_dedup.brute_near(docs)) if d[0] == root]
    leaked = leaks(docs, [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()])
    docs = {d: t for d, t in docs if d not in leaked}
    got = corpus_pipeline.run(spark, sf).toPandas()
    assert leaked and set(got.doc_id) == set(docs)
    coder = packing.encoder()
    for d, g in got.sort_values("start").groupby("doc_id"):
        ids = np.append(np.frombuffer(coder(docs[d] or ""), "<u4"), packing.END).astype("<u4")
        assert g.start.tolist() == (g.length.cumsum() - g.length).tolist() and g.length.sum() == len(ids)
        assert [zlib.crc32(ids[a : a + n].tobytes()) for a, n in zip(g.start, g.length)] == g.ids_crc32.tolist()
        assert set(g.source) == {source[d]}
    x = got.sort_values(["sequence_id", "offset"])
    assert ((x.offset + x.length).groupby(x.sequence_id).shift(fill_value=0) == x.offset).all() and sorted(set(x.sequence_id)) == list(range(x.sequence_id.nunique()))


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    assert compare(spark, queries.QUERIES[name], queries.ORACLE_SQL[name], SMALL) == ""
