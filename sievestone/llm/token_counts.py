"""Token counts by field and section, from one encoding of each whole document.

A document is its fields joined by a separator; it is encoded once. The byte-level vocabulary gives each id's length in
bytes, so ids have spans without another pass. Fields end with their separator and the sections of the last field, its
lines, with their newline: the intervals tile the document, and the interval join is a binary search.

A token that crosses a boundary is allocated by rule: `start`, to the interval that holds its first byte (default), or
`most`, to the interval that holds most of its bytes, the earlier one of equals. Counts so add up to the document's.

Defined results: null and empty fields hold their separator only. Every document has a row for each field and at least
one line. Repeated rows are each counted. Texts are read whole.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievestone.llm.packing import encoder
from sievestone.session import arrow_batches

SEPARATOR = "\n\n"
RULES = ("start", "most")
_lengths: dict[str, np.ndarray] = {}


def id_lengths(name: str) -> np.ndarray:
    """Bytes of each id of a byte-level vocabulary."""
    if name not in _lengths:
        import public_tokenizers

        with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as f:
            pairs = [(int(b), len(base64.b64decode(a))) for a, b in map(bytes.split, f)]
        table = np.zeros(max(i for i, _ in pairs) + 1, np.int64)
        for i, n in pairs:
            table[i] = n
        _lengths[name] = table
    return _lengths[name]


def allocate(ends: np.ndarray, bounds: np.ndarray, rule: str) -> np.ndarray:
    """Tokens in each interval [bounds[i], bounds[i + 1]); ends: where each token ends, in bytes."""
    starts = np.concatenate([[0], ends[:-1]])
    at = np.searchsorted(bounds, starts, "right") - 1
    if rule == "most":
        last = np.searchsorted(bounds, ends, "left") - 1
        for i in np.flatnonzero(last > at):  # few: those that cross a boundary
            edges = np.clip(bounds[at[i] : last[i] + 2], starts[i], ends[i])
            at[i] += int(np.argmax(np.diff(edges)))
    return np.bincount(at, minlength=len(bounds) - 1)


def sections_of(fields: list[str], rule: str, tokenizer: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """(field, section, first code point, code points, tokens) of each interval, and all tokens. The last field is cut into lines."""
    whole = SEPARATOR.join(fields)
    data = np.frombuffer(whole.encode("utf-8", "surrogatepass"), np.uint8)
    heads = np.cumsum([len((f + SEPARATOR).encode("utf-8", "surrogatepass")) for f in fields[:-1]], dtype=np.int64)
    body = int(heads[-1]) if len(heads) else 0
    lines = body + np.flatnonzero(data[body:] == 10) + 1
    bounds = np.concatenate([[0], heads, lines, [len(data)]]).astype(np.int64)
    ends = np.cumsum(id_lengths(tokenizer)[np.frombuffer(encoder(tokenizer)(whole), "<u4")])
    # an empty interval has no tokens; only the last ones can be empty
    filled = bounds[: np.searchsorted(bounds, len(data), "left") + 1]
    tokens = np.zeros(len(bounds) - 1, np.int64)
    if len(ends):
        got = allocate(ends, filled, rule)
        tokens[: len(got)] = got
    chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[bounds]
    n_heads = len(heads)
    field = np.minimum(np.arange(len(bounds) - 1), n_heads)
    section = np.maximum(np.arange(len(bounds) - 1) - n_heads, 0)
    return field, section, chars[:-1], np.diff(chars), tokens, len(ends)


def attribute(docs: DataFrame, doc_id: str, fields: list[str], rule: str = "start", tokenizer: str = "byte_bpe_50k") -> DataFrame:
    """(doc_id, field, section_no, start_char, n_chars, n_tokens, doc_tokens); the last field by lines. One pass, no shuffle."""
    if rule not in RULES:
        raise ValueError(f"rule is one of {RULES}")
    schema = T.StructType(
        [T.StructField("doc_id", docs.schema[doc_id].dataType), T.StructField("field", T.StringType())]
        + [T.StructField(c, T.LongType()) for c in ("section_no", "start_char", "n_chars", "n_tokens", "doc_tokens")]
    )
    names = pa.array(fields, pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, whole.num_rows, 1024):
                batch = whole.slice(a, 1024)
                texts = [batch.column(i + 1).to_pylist() for i in range(len(fields))]
                got = [sections_of([f or "" for f in row], rule, tokenizer) for row in zip(*texts, strict=True)]
                n = [len(g[0]) for g in got]
                columns = [np.concatenate([g[k] for g in got]).astype(np.int64) for k in range(5)]
                row = pa.array(np.repeat(np.arange(len(got)), n))
                total = np.repeat(np.array([g[5] for g in got], np.int64), n)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(row), names.take(pa.array(columns[0])), *(pa.array(c) for c in columns[1:]), pa.array(total)], schema.names)

    arrow_batches(docs.sparkSession)
    return docs.select(F.col(f"`{doc_id}`").alias("_id"), *[F.col(f"`{f}`").cast("string").alias(f"_f{i}") for i, f in enumerate(fields)]).mapInArrow(run, schema)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return attribute(docs, "doc_id", ["source", "lang", "text"])
