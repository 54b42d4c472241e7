"""Connected components over an edge DataFrame by alternating stars; no links ever reach the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievestone.session import materialize


#: Rows of a few numbers each that are broadcast at most.
BROADCAST_ROWS = 500_000


def components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """(node, root): root is the smallest node that is reachable. edges: long columns u, v; loops and repeats are allowed.

    Each round writes its edges to the shared folder. A star's centre is found by a grouped minimum, which is
    combined before the shuffle, so a node with very many neighbours is no hot group.
    """
    hi, lo = F.greatest(u, v).alias("u"), F.least(u, v).alias("v")
    now = materialize(edges.select(hi, lo).where("u <> v").distinct(), "edges")
    mark = _mark(now)
    while mark[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u")
            .select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
            .select("e.*")
            .where("u <> v")
            .distinct()
        )
        new = materialize(small, "edges")
        fresh = _mark(new)
        if fresh == mark:
            break
        now, mark = new, fresh
    roots = now.groupBy("u").agg(F.min("v").alias("root"))
    return roots.select(F.col("u").alias("node"), "root").unionByName(
        roots.select(F.col("root").alias("node"), "root").distinct()
    )


def sized(ids: DataFrame, label: str) -> DataFrame:
    """ids, written down, and broadcast if they are BROADCAST_ROWS or fewer: the other side of a join, such as whole texts, then stays
    where it is. Beyond that the join shuffles."""
    found = materialize(ids, label)
    return F.broadcast(found) if found.count() <= BROADCAST_ROWS else found


def _mark(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")), F.lit(0)).alias("h")).first()
    return row.n, int(row.h)
