"""Mixture-controlled packing by deficit round-robin over source queues.

1. Every document is encoded once. Its ids, with the end id, are cut into pieces whose lengths are powers of two
   (largest first, at most `block`), so pieces of a queue sorted by falling length fill blocks of exactly `block` ids.
2. Documents are dealt to lanes by a hash; a lane holds some lane_tokens ids. In a lane each source is a queue of
   full blocks; the ends of the queues are joined the same way into blocks of a queue of their own.
3. In a lane, each window credits each queue with its share of the window; the queue with the largest deficit gives
   the next block and pays for it. Deficits carry over from window to window. A lane starts with what the lanes before
   it left over: the difference between their targets and what they hold, a running sum over lanes of small counts.
4. What fills no whole window at a lane's end goes to sequences of power-of-two lengths, which need no padding.

Targets default to the sources' shares of all tokens; other weights steer the order in which sources are used up,
as every id is placed.

Defined results: a null text is the empty text: one piece, the end id. A null source is a source of its own, kept
apart from the empty name. Repeated rows are each packed. Empty tables give no pieces. Texts are read whole.
Added columns replace columns of the same name.
"""

from __future__ import annotations

import base64
import re
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sievestone.llm.text import give_back
from sievestone.session import arrow_batches, materialize

WINDOW, BLOCK, LANE_TOKENS, MOST_LANES, END = 1024, 256, 1 << 20, 100_000, 0
#: Pieces of text whose ids a worker keeps, some 150 bytes each.
CACHED = 100_000
#: The tokenizer's pattern for texts of Latin letters, its classes spelled out.
LETTERS, NUMBERS = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼½¾"
PIECES = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTERS}]+| ?[{NUMBERS}]+| ?[^\s{LETTERS}{NUMBERS}]+|\s+(?!\S)|\s+")
#: What else a text may hold for that; \x1c-\x1f are white space for Python, not for the tokenizer.
OTHER = re.compile(r"[^\x00-\x1b\x20-\xff–—‘’“”„…€]")
_encoders: dict[str, Callable[[str], bytes]] = {}


def encoder(name: str = "byte_bpe_50k") -> Callable[[str], bytes]:
    """text -> its ids as little-endian 32-bit numbers. Pieces that occur again are looked up, not encoded again."""
    if name not in _encoders:
        import public_tokenizers
        import tiktoken

        with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        coder = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        single = coder._core_bpe.encode_single_piece

        class Pieces(dict):
            def __missing__(self, piece: str) -> bytes:
                found = array("I", single(piece.encode())).tobytes()
                if len(self) < CACHED and len(piece) < 40:
                    self[piece] = found
                return found

        ids = Pieces().__getitem__

        def ids_of(text: str) -> bytes:
            if OTHER.search(text):
                return np.array(coder.encode_ordinary(text), "<u4").tobytes()
            return b"".join(map(ids, PIECES.findall(text)))

        _encoders[name] = ids_of
    return _encoders[name]


def cut(n: int, block: int = BLOCK) -> list[int]:
    """Lengths of the pieces of n ids: whole blocks, then the binary digits of the rest."""
    rest = n % block
    return [block] * (n // block) + [1 << k for k in reversed(range(rest.bit_length())) if rest >> k & 1]


def pieces(docs: DataFrame, keep: list[str], text: str = "text", source: str = "source", tokenizer: str = "byte_bpe_50k") -> DataFrame:
    """keep, row_key, source, start, length, ids_crc32 and doc_tokens of every piece; one pass, no shuffle."""
    own = ["row_key", "queue", "start", "length", "ids_crc32", "doc_tokens"]
    keep = [c for c in keep if c not in own]
    end = np.array([END], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        for batch in batches:
            rows, start, length, crc, total = [], [], [], [], []
            for i, t in enumerate(batch.column("_text").to_pylist()):
                ids = memoryview(encode(t or "") + end)
                n, at = len(ids) // 4, 0
                for size in cut(n):
                    rows.append(i)
                    start.append(at)
                    length.append(size)
                    crc.append(zlib.crc32(ids[4 * at : 4 * (at + size)]))
                    total.append(n)
                    at += size
            # without the text: a copy for each of its pieces would grow with the square of its length
            some = batch.select([*keep, "row_key", "queue"]).take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([*some.columns, *(pa.array(x, pa.int64()) for x in (start, length, crc, total))], [*keep, *own])
        give_back()

    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    # a null source gets a name that no quoted source has
    queue = F.coalesce(F.concat(F.lit("="), F.col(f"`{source}`").cast("string")), F.lit("null")).alias("queue")
    arrow_batches(docs.sparkSession)
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], F.xxhash64(*[F.col(f"`{c}`") for c in [*keep, text]]).alias("row_key"), queue, F.col(f"`{text}`").alias("_text"))
    return rows.mapInArrow(run, f"{fields}, row_key bigint, queue string, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint".lstrip(", "))


def fill(length: np.ndarray, queue: np.ndarray, share: np.ndarray, credit: np.ndarray, window: int = WINDOW, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of a lane's pieces, each a power of two of at most block. share, credit: of each queue number.

    Pieces of a queue must stand in falling order of length. Sequences count from 0 within the lane.
    """
    n_queues = len(share)
    order = np.lexsort((np.arange(len(length)), -length, queue))
    size, q = length[order], queue[order]
    before = np.cumsum(size) - size
    first = np.searchsorted(q, np.arange(n_queues))
    held = np.bincount(q, size, n_queues).astype(np.int64)
    begin = np.concatenate([before, [before[-1] + size[-1] if len(size) else 0]])[np.minimum(first, len(size))]
    within = before - begin[q]
    whole = within // block < (held // block)[q]
    # the ends of the queues make one more queue, its share what they hold
    rest = np.flatnonzero(~whole)
    rest = rest[np.argsort(-size[rest], kind="stable")]
    rest_at = np.cumsum(size[rest]) - size[rest]
    rest_blocks = int(size[rest].sum()) // block
    blocks = np.append(held // block, rest_blocks)
    weight = np.append(share * window, window * rest_blocks * block / max(int(held.sum()), 1))
    # deficit round-robin: a window credits every queue, then the queue that is owed most gives the next block
    per, total = window // block, int(blocks.sum())
    left = blocks.copy()
    given = np.zeros(n_queues + 1, np.int64)
    place = [np.empty(b, np.int64) for b in blocks]
    owed = np.where(left > 0, np.append(credit, 0.0), -np.inf)
    for at in range(total):
        if at % per == 0:
            owed += weight
        k = int(owed.argmax())
        place[k][given[k]] = at
        given[k] += 1
        left[k] -= 1
        owed[k] = owed[k] - block if left[k] else -np.inf
    slot = np.zeros(len(size), np.int64)  # the block of each piece, then the ids that fill none
    inside = np.zeros(len(size), np.int64)
    starts = np.concatenate([[0], np.cumsum(blocks)])
    flat = np.concatenate(place) if total else np.zeros(0, np.int64)
    w = np.flatnonzero(whole)
    slot[w], inside[w] = flat[starts[q[w]] + within[w] // block], within[w] % block
    full = rest_at // block < rest_blocks
    r = rest[full]
    slot[r], inside[r] = flat[starts[n_queues] + rest_at[full] // block], rest_at[full] % block
    last = rest[~full]
    slot[last], inside[last] = total, rest_at[~full] - rest_blocks * block
    # whole windows, then the rest of the lane as sequences of falling powers of two
    position = slot * block + inside
    windows = total // per
    tail = int(size.sum()) - windows * window
    cuts = [0]
    for k in reversed(range(max(tail, 1).bit_length())):
        if tail >> k & 1:
            cuts.append(cuts[-1] + (1 << k))
    over = position - windows * window
    number = np.searchsorted(np.array(cuts), np.maximum(over, 0), "right") - 1
    sequence = np.where(over >= 0, windows + number, position // window)
    offset = np.where(over >= 0, over - np.array(cuts)[np.minimum(number, len(cuts) - 1)], position % window)
    out_s, out_o = np.empty(len(size), np.int64), np.empty(len(size), np.int64)
    out_s[order], out_o[order] = sequence, offset
    return out_s, out_o


def pack(docs: DataFrame, keep: list[str], text: str = "text", source: str = "source", tokenizer: str = "byte_bpe_50k", weights: dict[str, float] | None = None, lane_tokens: int = LANE_TOKENS) -> DataFrame:
    """keep, start, length, ids_crc32, doc_tokens, sequence_id and offset of every piece.

    weights: target share by source name, of any sum; by default the sources' shares of all tokens.
    """
    keep = list(dict.fromkeys(keep))
    cut_up = materialize(pieces(docs, keep, text, source, tokenizer), "pieces")
    total = cut_up.agg(F.sum("length")).first()[0] or 0
    lanes = min(MOST_LANES, max(1, -(-int(total) // lane_tokens)))  # beyond that, lanes grow
    dealt = cut_up.withColumn("lane", F.pmod("row_key", F.lit(lanes)))
    held = materialize(dealt.groupBy("lane", "queue").agg(F.sum("length").alias("ids")), "queues")
    if weights:
        whole = float(sum(weights.values())) or 1.0
        named = F.create_map(*[F.lit(x) for k, v in sorted(weights.items()) for x in (f"={k}", v / whole)])
        share = F.coalesce(F.try_element_at(named, F.col("queue")), F.lit(0.0))
    else:
        share = F.sum("ids") / F.lit(float(max(total, 1)))
    shares = held.groupBy("queue").agg(share.alias("share"))
    # what a queue is owed when a lane begins: its target in all lanes before, less what they gave it. Lanes of a queue
    # are summed in one task each: counts, one for each lane_tokens ids.
    per_lane = held.groupBy("lane").agg(F.sum("ids").alias("lane_ids"))
    run_lane = Window.orderBy("lane").rowsBetween(Window.unboundedPreceding, -1)
    run_queue = Window.partitionBy("queue").orderBy("lane").rowsBetween(Window.unboundedPreceding, -1)
    ran = per_lane.select("lane", F.coalesce(F.sum("lane_ids").over(run_lane), F.lit(0)).alias("ran"))
    owed = (
        held.withColumn("gave", F.coalesce(F.sum("ids").over(run_queue), F.lit(0)))
        .join(ran, "lane")
        .join(shares, "queue")
        .select("lane", "queue", "share", (F.col("share") * F.col("ran") - F.col("gave")).alias("credit"))
    )
    queues = owed.groupBy("lane").agg(F.array_sort(F.collect_list(F.struct("queue", "share", "credit"))).alias("queues"))
    own = ["start", "length", "ids_crc32", "doc_tokens"]
    fields = ", ".join(f"`{c}` {cut_up.schema[c].dataType.simpleString()}" for c in keep)
    schema = f"{fields}, lane bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence bigint, offset bigint".lstrip(", ")

    def place(key: tuple, some: pd.DataFrame, names: pd.DataFrame) -> pd.DataFrame:
        info = list(names["queues"].iloc[0])
        code = {x["queue"]: i for i, x in enumerate(info)}
        some = some.sort_values(["row_key", "start"], kind="stable")
        number = some["queue"].map(code).to_numpy(np.int64)
        share, credit = (np.array([x[k] for x in info], float) for k in ("share", "credit"))
        some["sequence"], some["offset"] = fill(some["length"].to_numpy(np.int64), number, share, credit)
        return some[[*keep, "lane", *own, "sequence", "offset"]]

    placed = materialize(dealt.groupBy("lane").cogroup(queues.groupBy("lane")).applyInPandas(place, schema), "placed")
    # at most MOST_LANES rows
    counts = placed.groupBy("lane").agg((F.max("sequence") + 1).alias("n"))
    base = counts.select("lane", F.coalesce(F.sum("n").over(run_lane), F.lit(0)).alias("base"))
    return placed.join(F.broadcast(base), "lane").select(
        *keep, *own, (F.col("base") + F.col("sequence")).alias("sequence_id"), "offset"
    )


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack(docs.select("doc_id", "source", "text"), ["doc_id", "source"])


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents that are left, with their sequences."""
    return pack(docs.select("doc_id", "source", "text"), ["doc_id", "source"])
