"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

Every shard owns `vnodes` points of a ring; a key belongs to the next point clockwise. A shard takes its own keys in
ring order until it is full; the keys beyond that walk on clockwise to the next point whose shard has room. With no
slack, capacities add up to the number of rows, and shards' counts are at most one apart (law `rows`).

Rows are handled by DataFrame functions only. The plan of the walk is made from one count for each of the
shards * vnodes arcs, a number that doesn't grow with the data; a row then needs its arc and its rank in the arc.

Defined results: a null text has size 16 and CRC 0. A null key has a place on the ring like any other. Repeated rows
take places next to each other; equal ids are ordered by text. An empty table gives no rows. Columns that the
operator adds replace columns of the same name.
"""

from __future__ import annotations

import hashlib
import json
from bisect import bisect_left

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

VNODES, CELL_BITS, RING_BITS = 256, 12, 63
SIZE_OVERHEAD = 16


def ring(shards: int, vnodes: int = VNODES) -> list[tuple[int, int]]:
    """(position, shard) of every virtual node, clockwise."""
    at = lambda s, v: int.from_bytes(hashlib.md5(f"{s}/{v}".encode()).digest()[:8], "big") >> (64 - RING_BITS)
    return sorted((at(s, v), s) for s in range(shards) for v in range(vnodes))


def capacities(rows: int, shards: int, slack: float = 0.0) -> list[int]:
    """What each shard may hold: exact shares without slack, (1 + slack) times the mean with it."""
    if slack > 0:
        return [max(1, int(-(-rows * (1 + slack) // shards)))] * shards
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def walk(owners: list[int], loads: list[int], room: list[int]) -> list[list[tuple[int, int, int]]]:
    """For each arc the parts of its keys, in ring order: (first rank, end rank, shard).

    owners: the shard of each arc's point, clockwise; loads: keys in each arc; room: what each shard may hold.
    """
    room, parts, over = list(room), [], []
    for i, (s, n) in enumerate(zip(owners, loads, strict=True)):
        own = min(n, room[s])
        room[s] -= own
        parts.append([(0, own, s)] if own else [])
        if n > own:
            over.append(i)
    for i in over:
        at, j = parts[i][-1][1] if parts[i] else 0, i
        while at < loads[i]:
            j = (j + 1) % len(owners)
            some = min(loads[i] - at, room[owners[j]])
            if some:
                room[owners[j]] -= some
                parts[i].append((at, at + some, owners[j]))
                at += some
    return parts


def _literal(spark: SparkSession, rows: list, schema: str) -> DataFrame:
    """A small constant table, parsed in the JVM."""
    return spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")).alias("r")).select("r.*")


def _position(key: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(key), 64 - RING_BITS)


def with_arcs(docs: DataFrame, key: Column, points: list[tuple[int, int]]) -> DataFrame:
    """docs with _pos and _arc: the ring position and the number of the next point clockwise."""
    places = [p for p, _ in points]
    width = RING_BITS - CELL_BITS
    cells = []
    for c in range(1 << CELL_BITS):
        a, b = bisect_left(places, c << width), bisect_left(places, (c + 1) << width)
        arcs = [{"hi": places[i], "arc": i} for i in range(a, b)]
        arcs.append({"hi": (1 << RING_BITS) - 1, "arc": b % len(places)})
        cells.append({"_cell": c, "_arcs": arcs})
    # 2**CELL_BITS rows and one entry for each point: a fixed size
    table = F.broadcast(_literal(docs.sparkSession, cells, "_cell:bigint,_arcs:array<struct<hi:bigint,arc:int>>"))
    placed = docs.withColumn("_pos", _position(key)).withColumn("_cell", F.shiftright("_pos", width))
    arc = F.filter("_arcs", lambda x: F.col("_pos") <= x["hi"])[0]["arc"]
    return placed.join(table, "_cell").withColumn("_arc", arc).drop("_cell", "_arcs")


def place(docs: DataFrame, key: str, shards: int, vnodes: int = VNODES, slack: float = 0.0, ties: tuple[str, ...] = ()) -> DataFrame:
    """docs with shard and slot. Slots count from 0 in each shard without gaps. ties: columns that order equal keys.

    One shuffle of the rows, by arc; give it narrow rows and join the rest by key.
    """
    spark, points = docs.sparkSession, ring(shards, vnodes)
    docs = docs.drop("shard", "slot")
    counted = with_arcs(docs.select(F.col(f"`{key}`").alias("_key")), F.col("_key"), points).groupBy("_arc").agg(F.count("*").alias("n"))
    loads = [0] * len(points)
    for r in counted.collect():  # shards * vnodes rows at most
        loads[r["_arc"]] = r["n"]
    owners = [s for _, s in points]
    parts = walk(owners, loads, capacities(sum(loads), shards, slack))
    filled, plan = [0] * shards, []
    for i, some in enumerate(parts):
        if some:
            entries = []
            for a, b, s in some:
                entries.append({"upto": b, "shard": s, "base": filled[s] - a})
                filled[s] += b - a
            plan.append({"_arc": i, "_parts": entries})
    table = F.broadcast(_literal(spark, plan, "_arc:int,_parts:array<struct<upto:bigint,shard:int,base:bigint>>"))
    order = Window.partitionBy("_arc").orderBy("_pos", F.col(f"`{key}`"), *[F.col(f"`{c}`") for c in ties])
    ranked = with_arcs(docs, F.col(f"`{key}`"), points).withColumn("_rank", F.row_number().over(order).cast("long") - 1)
    part = F.filter("_parts", lambda x: F.col("_rank") < x["upto"])[0]
    return (
        ranked.join(table, "_arc")
        .withColumn("_part", part)
        .withColumns({"shard": F.col("_part.shard"), "slot": F.col("_part.base") + F.col("_rank")})
        .drop("_arc", "_pos", "_rank", "_parts", "_part")
    )


def op4_hash_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + SIZE_OVERHEAD).cast("long").alias("size"),
        F.coalesce(F.crc32("text"), F.lit(0).cast("long")).alias("text_crc32"),
    )
    return place(docs, "doc_id", shards=40, ties=("text_crc32", "size")).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
