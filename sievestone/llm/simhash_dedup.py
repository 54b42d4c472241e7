"""SimHash near-duplicates over BK-trees.

A document's fingerprint is the bitwise majority of the XXH64 values of its word shingles. Equal fingerprints
collapse first. Distinct ones are dealt to shards by pigeonhole keys: of k bit blocks, fingerprints that differ in
r bits or fewer agree on at least k - r, so every pair of neighbours meets in a shard. Each shard is a
BK-tree, children keyed by integer Hamming distance to the parent, and a search follows only edges within the radius
of the distance at hand. The trees of a partition are built and searched together, as arrays.

The trees aren't broadcast whole: fingerprints grow with the corpus, so each task builds the trees of its own
shards. A shard yields a spanning forest, never its pairs; components.py joins the forests.

Defined results: a null text is the empty text; a text without words has fingerprint 0 and is linked like any other.
Repeated rows and equal texts share a component. Texts are read whole. A null doc_id is carried; a component's id is
the smallest non-null one. Columns that the operator adds replace columns of the same name.

RADIUS and WIDTH are the query's. The pipeline's stage links texts whose sets of STAGE_WIDTH-word shingles have a Jaccard
similarity of 4/5 or more. Of two such sets one shingle at least is among the first fifth of both, whatever the order, so texts meet in
the shards of these (prefix filter, exact). The order is that of the hashes, with shingles that a sample shows to be common last, the
most common at the end: a passage in very many unlike texts is then in none of their prefixes, unless a text is little else.
A shard's trees give candidates at STAGE_RADIUS bits, between fingerprints of the sets, and a second fingerprint leaves those at
BOTH_RADIUS bits of both; at that radius a tree is seen almost whole, so shards of more than SMALL texts are compared in tiles
instead, without pairs that are connected already. Candidates are kept as forests, never as pairs; what they connect
is a cluster, whose texts' sets are compared with each other, block by block, and the sets alone decide.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievestone.llm.components import components, sized
from sievestone.llm.text import give_back, mix
from sievestone.session import arrow_batches, materialize

RADIUS, WIDTH, SEED = 3, 3, 42
#: At a similarity of 4/5 fingerprints differ in some 10 of 64 bits, 12 for sets of four and five; 24 are 4 deviations more. Two
#: fingerprints together differ in some 19 of 128 bits, 24 for such sets; 40 are 5 deviations more than 19.
STAGE_RADIUS, BOTH_RADIUS, STAGE_WIDTH = 24, 40, 5
#: Bytes of a text that are read at once, hashes summed up at once, and links looked at together.
PIECE, HASHES, FRONTIER = 1 << 20, 1 << 15, 1 << 18
#: Texts that are sampled for common shingles, about; texts of the sample that a common one is in, at least; common ones, at most. The
#: result doesn't depend on these. Texts of a shard that has trees, at most; texts of a side of a larger one's tiles, and those tried first.
SAMPLE, COMMON, MOST = 1 << 14, 3, 1 << 16
SMALL, SIDE, PIVOTS = 128, 1 << 10, 32
#: Hashes of a block of a cluster; texts, hashes and columns that are compared at once.
BLOCK, TILE, TILE_HASHES, COLUMNS = 1 << 20, 512, 1 << 17, 1 << 12
SPACE = re.compile(rb"[\t-\r ]")


def shingle_digests(text: str | None, width: int) -> Iterator[np.ndarray]:
    """The big-endian bytes of the shingles' hashes, a row each; nothing for a text without words. A long text is read piece by piece."""
    data, at, held, none = (text or "").encode("utf-8", "surrogatepass").lower(), 0, [], True
    while at < len(data):
        gap = SPACE.search(data, at + PIECE)
        end = gap.start() if gap else len(data)
        words = held + data[at:end].split()
        at = end
        if len(words) >= width:
            yield _digests(words, width)
            none = False
        held = words[max(len(words) - width + 1, 0) :]
    if none and held:
        yield _digests(held, len(held))


def _digests(words: list[bytes], width: int) -> np.ndarray:
    flat = b" ".join(words)
    ends = list(accumulate([len(w) + 1 for w in words], initial=-1))
    digest = xxhash.xxh64_digest
    got = b"".join([digest(flat[i + 1 : j], SEED) for i, j in zip(ends, ends[width:])])
    return np.frombuffer(got, np.uint8).reshape(-1, 8)


def _majority(digests: Iterator[np.ndarray]) -> int:
    sums, n = np.zeros(64, np.int64), 0
    for some in digests:
        for a in range(0, len(some), HASHES):
            rows = some[a : a + HASHES]
            sums += np.unpackbits(rows, axis=1).sum(0, dtype=np.int64)
            n += len(rows)
    return int.from_bytes(np.packbits(2 * sums > n).tobytes(), "big")


def fingerprint(text: str | None, width: int = WIDTH) -> int:
    """The 64-bit majority of the shingles' hashes; bit set if in over half of them."""
    return _majority(shingle_digests(text, width))


def shingle_set(text: str | None, width: int = STAGE_WIDTH) -> np.ndarray:
    """The distinct hashes of the shingles, in order."""
    parts = [rows.copy().view(">u8").ravel().astype(np.uint64) for rows in shingle_digests(text, width)]
    return np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)


def set_fingerprint(hashes: np.ndarray) -> int:
    """The majority over a set: a shingle that is repeated counts once, as it does in the similarity."""
    rows = hashes.astype(">u8").view(np.uint8).reshape(-1, 8)
    return _majority(iter([rows]))


def second_fingerprint(hashes: np.ndarray) -> int:
    """set_fingerprint() of other hashes of the same shingles."""
    return set_fingerprint(mix(mix(hashes.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))))


def with_fingerprints(docs: DataFrame, keep: list[str], text: str = "text", width: int = WIDTH) -> DataFrame:
    """keep and fp (the fingerprint as a signed long); one pass, no shuffle."""
    keep = [c for c in keep if c != "fp"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t, width) for t in batch.column(text).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(fps.view(np.int64))], [*keep, "fp"])
        give_back()

    arrow_batches(docs.sparkSession)
    schema = ", ".join(f"`{docs.schema[c].name}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    columns = list(dict.fromkeys([*keep, text]))
    return docs.select(*[F.col(f"`{c}`") for c in columns]).mapInArrow(run, (schema + ", " if keep else "") + "fp bigint")


def plan_blocks(n: int, radius: int = RADIUS) -> list[list[tuple[int, int]]]:
    """Shard tables, each a list of (shift, width) bit blocks that must agree.

    With more fingerprints there are more, narrower blocks, so that a shard of random ones stays under 64; all plans are exact.
    """
    from itertools import combinations

    blocks = radius + 1
    while blocks < 8:
        cuts = np.linspace(0, 64, blocks + 1).astype(int)
        if n / 2.0 ** (64 * (blocks - radius) // blocks) <= 64:
            break
        blocks += 1
    cuts = np.linspace(0, 64, blocks + 1).astype(int)
    parts = [(int(a), int(b - a)) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    return [list(x) for x in combinations(parts, blocks - radius)]


class Forest:
    """The BK-trees of many shards. shard: the shard of each point, points of a shard next to each other."""

    def __init__(self, shard: np.ndarray, points: np.ndarray):
        self.points = points
        first = np.concatenate([[True], shard[1:] != shard[:-1]]) if len(shard) else np.zeros(0, bool)
        self.root = np.flatnonzero(first)[np.cumsum(first) - 1] if len(shard) else np.zeros(0, np.int64)
        keys, kids = [], []
        going = np.flatnonzero(~first)
        at = self.root[going]
        while len(going):  # all points go down a level at a time; the first to take an edge becomes the child
            edge = at * 65 + np.bitwise_count(points[going] ^ points[at]).astype(np.int64)
            key, lead, group = np.unique(edge, return_index=True, return_inverse=True)
            child = going[lead]
            keys.append(key)
            kids.append(child)
            at = child[group]
            down = at != going
            going, at = going[down], at[down]
        self.keys = np.concatenate(keys) if keys else np.zeros(0, np.int64)
        order = np.argsort(self.keys)
        self.keys, self.kids = self.keys[order], (np.concatenate(kids) if kids else np.zeros(0, np.int64))[order]

    def neighbours(self, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Arrays of (point, other) with other before point and at most radius bits apart, some at a time."""
        for first in range(0, len(self.points), 1 << 15):
            # what is still to be seen: queries, and where and how many the edges are that each follows; FRONTIER edges at most at a time
            q = np.arange(first, min(first + (1 << 15), len(self.points)))
            at, todo = self.root[q], []
            while True:
                d = np.bitwise_count(self.points[q] ^ self.points[at]).astype(np.int64)
                near = (d <= radius) & (at < q)
                if near.any():
                    yield q[near], at[near]
                lo = np.searchsorted(self.keys, at * 65 + np.maximum(d - radius, 0))
                n = np.searchsorted(self.keys, at * 65 + np.minimum(d + radius, 64), "right") - lo
                on = np.flatnonzero(n)
                if len(on):
                    q, lo, n = q[on], lo[on], n[on]
                    part = np.cumsum(n) // FRONTIER
                    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(n)]
                    todo += [(q[a:b], lo[a:b], n[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                if not todo:
                    break
                q, lo, n = todo.pop()
                kid = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
                q, at = np.repeat(q, n), self.kids[kid]


def _roots(parent: np.ndarray) -> np.ndarray:
    while True:
        up = parent[parent]
        if (up == parent).all():
            return parent
        parent = up


def _unite(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """parent with the links a, b taken in; a component's root is its first point."""
    while True:
        parent = _roots(parent)
        x, y = parent[a], parent[b]
        apart = x != y
        if not apart.any():
            return parent
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(parent, np.maximum(x, y), np.minimum(x, y))


def spanning_edges(shard: np.ndarray, points: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(point, representative) for every point whose component within its shard holds an earlier one."""
    parent = np.arange(len(points))
    for a, b in Forest(shard, points).neighbours(radius):
        parent = _unite(parent, a, b)
    moved = np.flatnonzero(parent != np.arange(len(points)))
    return points[moved], points[parent[moved]]


def _whole_shards(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[np.ndarray]:
    """Sorted batches of long columns as arrays of whole shards; the first `keys` columns name the shard."""
    held: list[np.ndarray] = []
    size = 0
    for batch in batches:
        block = np.stack([batch.column(i).to_numpy().astype(np.int64) for i in range(batch.num_columns)])
        held.append(block)
        size += block.shape[1]
        if size < 1 << 18:
            continue
        rows = np.concatenate(held, axis=1)
        last = int(np.argmax((rows[:keys] == rows[:keys, -1:]).all(0)))  # the last shard may go on
        if last:
            yield rows[:, :last]
        held, size = [rows[:, last:]], rows.shape[1] - last
    if held:
        yield np.concatenate(held, axis=1)


def link_fingerprints(distinct: DataFrame, n: int, radius: int = RADIUS) -> DataFrame:
    """Edges (u, v) that connect what lies within radius; distinct: one column fp, n: about how many."""
    tables = []
    for i, blocks in enumerate(plan_blocks(n, radius)):
        key = F.lit(0).cast("long")
        for shift, width in blocks:
            bits = F.shiftrightunsigned(F.col("fp"), shift).bitwiseAND((1 << width) - 1)
            key = F.shiftleft(key, width).bitwiseOR(bits)
        tables.append(F.struct(F.lit(i).alias("t"), key.alias("key")))
    shards = distinct.select("fp", F.explode(F.array(*tables)).alias("s")).select("s.t", "s.key", "fp")
    shards = shards.repartition("t", "key").sortWithinPartitions("t", "key", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _whole_shards(batches, 2):
            yield edges(rows)
        give_back()

    def edges(rows: np.ndarray) -> pa.RecordBatch:
        new = np.concatenate([[True], (rows[0, 1:] != rows[0, :-1]) | (rows[1, 1:] != rows[1, :-1])]) if rows.shape[1] else np.zeros(0, bool)
        a, b = spanning_edges(np.cumsum(new), rows[2].view(np.uint64), radius)
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["u", "v"])

    return shards.mapInArrow(run, "u bigint, v bigint")


def near_duplicates(docs: DataFrame, keep: list[str], doc_id: str = "doc_id", text: str = "text", radius: int = RADIUS, width: int = WIDTH) -> DataFrame:
    """keep with fp and component_id; component_id is the smallest doc_id that is reachable over links of radius or fewer bits."""
    keep = [c for c in dict.fromkeys([doc_id, *keep]) if c not in ("fp", "component_id")]
    prints = materialize(with_fingerprints(docs, keep, text, width), "fingerprints")
    distinct = materialize(prints.groupBy("fp").agg(F.min(doc_id).alias("least")), "distinct")
    # the roots of fingerprints that have neighbours; the others stand for themselves
    roots = components(link_fingerprints(distinct.select("fp"), distinct.count(), radius))
    placed = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    named = placed.join(least, "root").select("fp", "component_id")
    return prints.join(named, "fp").select(*keep, "fp", "component_id")


def op7_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = near_duplicates(docs, ["doc_id"])
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def _common(rows: DataFrame, text: str) -> np.ndarray:
    """The hashes of shingles that are in COMMON or more texts of a sample, rarest first."""
    n = rows.count()
    every = max(1, min(8, n >> 12), n // SAMPLE)  # every other text from 8,192 on, one of eight from 32,768 on

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64))], ["h"])
        give_back()

    arrow_batches(rows.sparkSession)
    sample = rows.where(F.pmod(F.xxhash64("_row"), F.lit(every)) == 0).select(text).mapInArrow(run, "h bigint")
    often = sample.groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") >= COMMON).orderBy(F.desc("n"), "h").limit(MOST).toArrow()
    return often.column("h").to_numpy()[::-1].astype(np.int64).view(np.uint64)


class Order:
    """Hashes in the order that prefixes are taken in: as they are, then the common ones in theirs."""

    def __init__(self, common: np.ndarray | None):
        common = np.zeros(0, np.uint64) if common is None else common
        self.place = np.argsort(common)
        self.common = common[self.place]

    def first(self, hashes: np.ndarray, n: int) -> np.ndarray:
        """The first n of sorted hashes. Mostly some of them are enough to see n that aren't common."""
        if not len(self.common):
            return hashes[:n]
        for some in (hashes[: 2 * n], hashes):
            at = np.minimum(np.searchsorted(self.common, some), len(self.common) - 1)
            often = self.common[at] == some
            rest = some[~often]
            if len(rest) >= n:
                return rest[:n]
        last = hashes[often]
        return np.concatenate([rest, last[np.argsort(self.place[at[often]])]])[:n]


def _prefixes(rows: DataFrame, text: str, common: np.ndarray | None = None) -> DataFrame:
    """(_row, doc_id, same, n, fp, fp2, prefix): equal sets have equal `same`; n: shingles; prefix: the first of them, as longs."""
    order = Order(common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            same, sizes, fps, others, prefix = [], [], [], [], []
            for t in batch.column(text).to_pylist():
                hashes = shingle_set(t)
                n = len(hashes)
                same.append(xxhash.xxh64_intdigest(hashes.tobytes(), SEED))
                sizes.append(n)
                fps.append(set_fingerprint(hashes))
                others.append(second_fingerprint(hashes))
                # a partner shares (4n + 4) // 5 of them or more, and so one of these
                prefix.append(order.first(hashes, n - (4 * n + 4) // 5 + 1).view(np.int64) if n else np.zeros(0, np.int64))
            longs = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (same, sizes, fps, others)]
            yield pa.RecordBatch.from_arrays([batch.column("_row"), batch.column("doc_id"), *longs, pa.array(prefix, pa.list_(pa.int64()))], ["_row", "doc_id", "same", "n", "fp", "fp2", "prefix"])
        give_back()

    arrow_batches(rows.sparkSession)
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.select("_row", "doc_id", text).mapInArrow(run, f"_row bigint, doc_id {kind}, same bigint, n bigint, fp bigint, fp2 bigint, prefix array<bigint>")


class Shards:
    """Texts of shards, next to each other: node (in order within a shard), sizes of sets, places of the shingle in them, both fingerprints."""

    def __init__(self, shard: np.ndarray, node: np.ndarray, n: np.ndarray, at: np.ndarray, fp: np.ndarray, fp2: np.ndarray):
        self.shard, self.node, self.n, self.at, self.fp, self.fp2 = shard, node, n, at, fp, fp2

    def take(self, which: np.ndarray | slice) -> Shards:
        return Shards(*(x[which] for x in (self.shard, self.node, self.n, self.at, self.fp, self.fp2)))

    def fit(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Sizes within 4/5; at the first shingle that both have, what is left of either reaches what they must share."""
        n, left = self.n, self.n - self.at
        return (5 * np.minimum(n[a], n[b]) >= 4 * np.maximum(n[a], n[b])) & (9 * np.minimum(left[a], left[b]) >= 4 * (n[a] + n[b]))

    def by_trees(self) -> np.ndarray:
        """The parent of each text in a forest of its shard that connects all candidates."""
        parent = np.arange(len(self.node))
        for a, b in Forest(self.shard, self.fp).neighbours(STAGE_RADIUS):
            near = np.bitwise_count(self.fp[a] ^ self.fp[b]).astype(int) + np.bitwise_count(self.fp2[a] ^ self.fp2[b]) <= BOTH_RADIUS
            near &= self.fit(a, b)
            parent = _unite(parent, a[near], b[near])
        return parent

    def _meet(self, parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """parent with the candidates of a and b taken in."""
        if not len(a) or not len(b):
            return parent
        d = np.bitwise_count(self.fp[a][:, None] ^ self.fp[b])
        near = d <= STAGE_RADIUS
        d += np.bitwise_count(self.fp2[a][:, None] ^ self.fp2[b])
        near &= d <= BOTH_RADIUS
        i, j = np.nonzero(near)
        a, b = a[i], b[j]
        fit = self.fit(a, b)
        return _unite(parent, a[fit], b[fit])

    def by_tiles(self) -> np.ndarray:
        """by_trees() of one shard. Texts of like sizes are compared tile by tile, without what is connected before a tile begins."""
        parent = np.arange(len(self.node))
        order = np.argsort(self.n, kind="stable")
        sides = [order[i : i + SIDE] for i in range(0, len(order), SIDE)]
        pivots = order[:: max(1, len(order) // PIVOTS)]
        for side in sides:
            parent = self._meet(parent, pivots, side)
        for i, a in enumerate(sides):
            for b in sides[i:]:
                if 5 * self.n[a[-1]] < 4 * self.n[b[0]]:
                    break
                parent = _roots(parent)
                roots, count = np.unique(np.concatenate([parent[a], parent[b]]), return_counts=True)
                most = roots[np.argmax(count)]
                inner = parent[a] == most
                outer = b[parent[b] != most]
                parent = self._meet(parent, a[~inner], b)
                if b is not a:
                    parent = self._meet(parent, a[inner], outer)
        return parent

    def links(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Links (node, node) of a forest of each shard."""
        starts = np.flatnonzero(np.concatenate([[True], self.shard[1:] != self.shard[:-1]])) if len(self.shard) else np.zeros(0, np.int64)
        sizes = np.diff(np.append(starts, len(self.shard)))
        small = self.take(np.repeat(sizes <= SMALL, sizes))
        parts = [(small, small.by_trees())]
        for k in np.flatnonzero(sizes > SMALL):
            large = self.take(slice(starts[k], starts[k] + sizes[k]))
            parts.append((large, large.by_tiles()))
        for part, parent in parts:
            moved = np.flatnonzero(parent != np.arange(len(parent)))
            yield part.node[parent[moved]], part.node[moved]


def _candidates(sets: DataFrame) -> DataFrame:
    """Links (u, v) that connect all that may be similar: a forest of each shard. sets: (_row, n, fp, fp2, prefix)."""
    entries = sets.select("_row", "n", "fp", "fp2", F.posexplode_outer("prefix").alias("at", "key")).where("key is not null")
    # two counts in one number: shards hold one row for each shingle of a prefix
    entries = entries.select("key", "_row", F.shiftleft(F.col("n"), 32).bitwiseOR(F.col("at").cast("long")).alias("size"), "fp", "fp2").repartition("key").sortWithinPartitions("key", "_row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _whole_shards(batches, 1):
            new = np.concatenate([[True], rows[0, 1:] != rows[0, :-1]]) if rows.shape[1] else np.zeros(0, bool)
            alone = new & np.concatenate([new[1:], [True]]) if len(new) else new
            shard, (_, node, size, fp, fp2) = np.cumsum(new)[~alone], rows[:, ~alone]
            found = Shards(shard, node, size >> 32, size & 0xFFFFFFFF, fp.view(np.uint64), fp2.view(np.uint64)).links()
            links = np.unique(np.concatenate([np.stack(x) for x in found], axis=1), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(links[0]), pa.array(links[1])], ["u", "v"])
        give_back()

    return entries.mapInArrow(run, "u bigint, v bigint").distinct()


class Tile:
    """Some sets, as the places of their hashes among the distinct ones."""

    def __init__(self, at: np.ndarray, sets: list[np.ndarray]):
        self.at, self.n = at, np.array([len(x) for x in sets])
        self.hashes, self.place, self.count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        self.row = np.repeat(np.arange(len(sets)), self.n)

    def columns(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(column, row) of the entries whose hash is the column-th of which, by column."""
        column = np.full(len(self.hashes), -1)
        column[which] = np.arange(len(which))
        column = column[self.place]
        some = np.flatnonzero(column >= 0)
        some = some[np.argsort(column[some], kind="stable")]
        return column[some], self.row[some]

    def similar(self, other: Tile) -> tuple[np.ndarray, np.ndarray]:
        """The places in at of pairs with a similarity of 4/5 or more, one of self and one of other."""
        none = np.zeros(0, np.int64)
        if 5 * min(self.n.max(), other.n.max()) < 4 * max(self.n.min(), other.n.min()):
            return none, none
        if self is other:
            mine = theirs = np.flatnonzero(self.count > 1)
        else:
            _, mine, theirs = np.intersect1d(self.hashes, other.hashes, assume_unique=True, return_indices=True)
        if not len(mine):
            return none, none
        shared = np.zeros((len(self.n), len(other.n)), np.float32)
        (x, i), (y, j) = self.columns(mine), other.columns(theirs)
        for first in range(0, len(mine), COLUMNS):
            width = min(COLUMNS, len(mine) - first)
            dense = []
            for column, row, rows in ((x, i, len(self.n)), (y, j, len(other.n))):
                a, b = np.searchsorted(column, [first, first + width])
                held = np.zeros((rows, width), np.float32)
                held[row[a:b], column[a:b] - first] = 1
                dense.append(held)
            shared += dense[0] @ dense[1].T
        near = 9 * shared.astype(np.int64) >= 4 * (self.n[:, None] + other.n)
        a, b = np.nonzero(np.triu(near, 1) if self is other else near)
        return self.at[a], other.at[b]


def similar_pairs(first: int, last: int, block: np.ndarray, sets: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Arrays of the places of pairs with a similarity of 4/5 or more: one of the block `first`, the other of `last`, which may be the same."""
    n = np.array([len(x) for x in sets])
    tiles: list[list[Tile]] = []
    for b in (first, last):
        at = np.flatnonzero(block == b)
        at = at[np.argsort(n[at], kind="stable")]
        if not len(at) or first == last and tiles:
            tiles.append([])
            continue
        part = np.arange(len(at)) // TILE + np.cumsum(n[at]) // TILE_HASHES
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(at)]
        tiles.append([Tile(at[i:j], [sets[k] for k in at[i:j]]) for i, j in zip(cuts[:-1], cuts[1:], strict=True)])
    for i, mine in enumerate(tiles[0]):
        for theirs in tiles[0][i:] if first == last else tiles[1]:
            yield mine.similar(theirs)


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int, int], np.ndarray, np.ndarray, list[np.ndarray]]]:
    """(cluster, i, j), and _row, block and set of the texts, of each unit of sorted batches (cluster, i, j, block, _row, hs)."""
    key, nodes, blocks, sets = None, [], [], []
    for batch in batches:
        keys, lists = zip(*(batch.column(c).to_pylist() for c in ("cluster", "i", "j")), strict=True), batch.column("hs")
        ends, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
        for k, b, node, x, y in zip(keys, batch.column("block").to_pylist(), batch.column("_row").to_pylist(), ends[:-1], ends[1:], strict=True):
            if k != key and nodes:
                yield key, np.array(nodes), np.array(blocks), sets
                nodes, blocks, sets = [], [], []
            key = k
            nodes.append(node)
            blocks.append(b)
            sets.append(flat[x:y])
    if nodes:
        yield key, np.array(nodes), np.array(blocks), sets


def _similar(clusters: DataFrame, rows: DataFrame, text: str, forest: bool = True) -> DataFrame:
    """Links (u, v) that connect the texts of a cluster whose sets have a similarity of 4/5 or more; all such pairs, if not forest.

    clusters: (_row, n, cluster). Reads the texts of these rows again, once. A cluster of more than BLOCK hashes is cut into blocks,
    and each two of them are a unit of their own, so no task holds more than two blocks; a text is copied once for each block."""

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t).view(np.int64) for t in batch.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("cluster", "blocks", "block", "_row")), pa.array(sets, pa.list_(pa.int64()))], ["cluster", "blocks", "block", "_row", "hs"])
        give_back()

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, i, j), node, block, sets in _units(batches):
            parent = np.arange(len(node))
            for a, b in similar_pairs(i, j, block, sets):
                if forest:
                    parent = _unite(parent, a, b)
                else:
                    yield pa.RecordBatch.from_arrays([pa.array(node[a]), pa.array(node[b])], ["u", "v"])
            moved = np.flatnonzero(parent != np.arange(len(node)))
            yield pa.RecordBatch.from_arrays([pa.array(node[parent[moved]]), pa.array(node[moved])], ["u", "v"])
        give_back()

    blocks = clusters.groupBy("cluster").agg(F.ceil(F.sum("n") / BLOCK).alias("blocks"))
    placed = clusters.join(blocks, "cluster").select("_row", "cluster", "blocks", F.pmod(F.xxhash64("_row"), "blocks").alias("block"))
    sets = rows.select("_row", text).join(sized(placed, "clusters"), "_row").mapInArrow(hashes, "cluster bigint, blocks bigint, block bigint, _row bigint, hs array<bigint>")
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other")
    units = sets.select("cluster", "block", "_row", "hs", other).select("cluster", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "_row", "hs")
    units = units.repartition("cluster", "i", "j").sortWithinPartitions("cluster", "i", "j")
    return units.mapInArrow(links, "u bigint, v bigint")


def near_copies(rows: DataFrame, text: str = "text") -> DataFrame:
    """(_row, doc_id, component) of every row that has copies or near copies. rows: (_row, doc_id, text), written down."""
    prints = materialize(_prefixes(rows, text, _common(rows, text)), "prefixes")
    equal = materialize(prints.groupBy("same").agg(F.min("_row").alias("first"), F.count("*").alias("copies")), "equal-sets")
    sets = prints.join(equal.select(F.col("first").alias("_row")), "_row", "left_semi").select("_row", "n", "fp", "fp2", "prefix")
    clusters = components(_candidates(sets)).select(F.col("node").alias("_row"), F.col("root").alias("cluster"))
    roots = materialize(components(_similar(clusters.join(sets.select("_row", "n"), "_row"), rows, text)), "roots")
    placed = equal.join(roots, equal["first"] == roots.node, "left").where("copies > 1 or root is not null")
    return prints.select("_row", "doc_id", "same").join(placed.select("same", F.coalesce("root", "first").alias("component")), "same").select("_row", "doc_id", "component")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies one row stays: that with the smallest doc_id, null ids last, then the smallest text, then
    the smallest in all columns. Rows are told apart by a number of their own, whatever their ids."""
    rows = materialize(docs.withColumn("_row", F.monotonically_increasing_id()), "rows")
    found = materialize(near_copies(rows), "copies")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id")
    least = found.groupBy("component").agg(F.min(place).alias("least"))
    tied = found.join(least, "component").where(place == F.col("least")).select("component", "_row")
    # texts are read only where an id does not tell a component's rows apart
    ties = tied.groupBy("component").agg(F.min("_row").alias("_row"), F.count("*").alias("n"))
    open_ = sized(tied.join(ties.where("n > 1").select("component"), "component"), "ties")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    read = rows.join(open_, "_row").groupBy("component").agg(F.min(F.struct("text", *[c.alias(f"c{i}") for i, c in enumerate(columns)], "_row")).alias("first"))
    kept = ties.where("n = 1").select("_row").unionByName(read.select("first._row"))
    gone = sized(found.join(kept, "_row", "left_anti").select("_row"), "gone")
    return rows.join(gone, "_row", "left_anti").select(*columns)
