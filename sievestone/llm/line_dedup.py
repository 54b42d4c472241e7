"""Line dedup by a segment-partition edit join, for lines that are equal or differ in at most one edit.

Lines that hold more than spaces take part; equal ones count as one by a 64-bit hash, whatever their length. From
EDIT_CHARS code points on a line has a threshold of one edit, below that of none. With threshold 1 a line is
split into two segments: of two lines within one edit, one segment of the shorter occurs in the longer, at its start
or at its end. The index holds each line's two segments under its length; a line probes the index of its own length
and, as the longer one, of the length below. What shares a segment is a candidate, and only the other segments, the
rests, still differ.

- First keys alone are counted; lines are read again for the segments that two of them share, each at its first place alone.
- Groups of few rests: pairs, cut down to what differs and verified by a banded bit-parallel edit distance.
- Groups of many rests are cut into blocks, at most BLOCKS of them, and indexed again by all but one block, until groups
  are small or blocks short. Of many short rests each is indexed by all but one letter, and those that agree are joined
  to the first of them. A hot segment so costs rows in proportion to its lines, not pairs.

Links make classes (connected components). Of a class the first occurrence by doc_id and line number stays.
Native: SQL functions only, no Python on the executors.

Defined results: a null text is one empty line. Lines of spaces alone, or of nothing, are classes of their own and stay, however often
they occur. Rows with equal id and text are one document: they keep the same lines. A null id comes first. Texts are read
whole. Lines are split at newlines alone. An empty table gives none. Columns of the input other than the id and the text are
carried unread, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievestone.llm.components import components
from sievestone.session import materialize

EDIT_CHARS, THRESHOLD, SMALL, SHORT, BLOCKS = 32, 1, 8, 16, 64
SHORTER, LONGER = 0, 1  # roles in a group: what is indexed, and what is one longer


def edits_within(a: Column, b: Column, most: int) -> Column:
    """Edit distance of two strings if it is at most `most`, else null: bit-parallel over a band of 2 * most + 1 diagonals.

    Bit k of mask e after j letters of b: a's first j + k - most letters become them with e edits or fewer.
    """
    # a lambda's variable holds the letters: as plain expressions they would be split again at every step
    letters = F.array(F.struct(F.split(a, "").alias("x"), F.split(b, "").alias("y"), F.length(a).alias("n"), F.length(b).alias("m")))
    return F.transform(letters, lambda s: _edits(s["x"], s["y"], s["n"], s["m"], most))[0]


def _edits(xs: Column, ys: Column, n: Column, m: Column, most: int) -> Column:
    band = range(2 * most + 1)

    def valid(j: Column) -> Column:
        bits = [F.when((j + (k - most)).between(0, n), F.lit(1 << k)).otherwise(0) for k in band]
        return _sum(bits)

    start = F.struct(*[F.lit(sum(1 << k for k in band if 0 <= k - most <= e)).alias(f"r{e}") for e in range(most + 1)])

    def step(s: Column, j: Column) -> Column:
        equal = _sum([F.when(F.get(xs, j + (k - most - 1)) == F.get(ys, j - 1), F.lit(1 << k)).otherwise(0) for k in band])
        ok, out, below = valid(j), [], None
        for e in range(most + 1):
            r = s[f"r{e}"].bitwiseAND(equal)
            if e:
                old = s[f"r{e - 1}"]
                # a letter for a letter, a letter of b alone, a letter of a alone
                r = r.bitwiseOR(old).bitwiseOR(F.shiftright(old, 1)).bitwiseOR(F.shiftleft(below, 1))
            below = r.bitwiseAND(ok)
            out.append(below.alias(f"r{e}"))
        return F.struct(*out)

    steps = F.when(m > 0, F.sequence(F.lit(1), m)).otherwise(F.array().cast("array<int>"))
    end = F.aggregate(steps, start, step)
    hit = F.call_function("shiftleft", F.lit(1), n - m + most)
    found = F.coalesce(*[F.when(end[f"r{e}"].bitwiseAND(hit) != 0, F.lit(e)) for e in range(most + 1)])
    return F.when(F.abs(n - m) <= most, found)


def _sum(bits: list[Column]) -> Column:
    total = bits[0]
    for b in bits[1:]:
        total = total + b
    return total


def lines_of(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, row_key, line_no, line) of every line."""
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    # the key is made below the generator: beside it, it would be made again for every line. Outer, as the optimizer would
    # else filter by the number of lines, and split every text twice
    rows = rows.withColumn("row_key", _row_key("doc_id", "text"))
    return rows.select("doc_id", "row_key", F.posexplode_outer(F.split("text", "\n")).alias("line_no", "line"))


def _row_key(doc_id: str, text: str) -> Column:
    return F.xxhash64(F.col(doc_id), F.col(text))


def _segment(x: Column, n: Column, r: Column, side: int) -> tuple[Column, Column, Column]:
    """(shared, rest, r of the rest): the first or the last half of a line of n letters, r of them in the index."""
    head = F.floor(r / 2).cast("int")
    tail = r - head
    if side == 0:
        return F.substring(x, F.lit(1), head), F.substring(x, head + 1, n), tail
    return F.substring(x, n - tail + 1, tail), F.substring(x, F.lit(1), n - tail), head


def _blocks(key: Column, x: Column, r: Column) -> Column:
    """The entries (key, rest, r) of a rest x in the index of all but one of its blocks."""
    n = F.length(x)
    size = F.greatest(F.lit(SHORT), F.ceil(r / BLOCKS).cast("int"))

    def entry(j: Column) -> Column:
        before = j * size
        within = F.least(size, r - before)
        after = r - before - within
        own = F.xxhash64(key, j, F.substring(x, F.lit(1), before), F.substring(x, n - after + 1, after))
        return F.struct(own.alias("key"), F.substring(x, before + 1, n - before - after).alias("rest"), within.alias("r"))

    return F.transform(F.sequence(F.lit(0), F.ceil(r / size).cast("int") - 1), entry)


def _letters(key: Column, x: Column, role: Column) -> Column:
    """The keys of a short rest x without one letter. What differs in that letter alone has the same place; what is one letter
    longer meets the whole of the shorter one, at place 0."""
    n = F.length(x)
    at = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    without = F.transform(at, lambda i: F.xxhash64(key, F.when(role == SHORTER, i).otherwise(0), F.concat(F.substring(x, F.lit(1), i - 1), F.substring(x, i + 1, n))))
    whole = F.when(role == SHORTER, F.array(F.xxhash64(key, F.lit(0), x)))
    return F.array_distinct(F.concat(without, F.coalesce(whole, F.array().cast("array<bigint>"))))


def _differing(x: Column, y: Column) -> Column:
    """(x, y) without the halves that they share, until x is short; x is as long as y or one letter shorter."""

    def step(s: Column, _: Column) -> Column:
        a, b = s["x"], s["y"]
        head = F.floor(F.length(a) / 2).cast("int")
        tail = F.length(a) - head
        return (
            F.when(F.length(a) <= SHORT, s)
            .when(F.substring(a, F.lit(1), head) == F.substring(b, F.lit(1), head), F.struct(F.substring(a, head + 1, tail).alias("x"), F.substring(b, head + 1, tail + 1).alias("y")))
            .when(F.right(a, tail) == F.right(b, tail), F.struct(F.substring(a, F.lit(1), head).alias("x"), F.substring(b, F.lit(1), F.length(b) - tail).alias("y")))
            .otherwise(F.struct(F.lit("").alias("x"), F.lit("-" * (THRESHOLD + 1)).alias("y")))  # two edits at least
        )

    halvings = F.sequence(F.lit(1), F.length(F.bin(F.length(x))))
    return F.aggregate(halvings, F.struct(x.alias("x"), y.alias("y")), step)


def _alive(rows: DataFrame) -> DataFrame:
    """Sizes of the keys under which a pair may stand. rows: distinct (id, role, key)."""
    sizes = rows.groupBy("key").agg(F.count("*").alias("n"), F.count_if(F.col("role") == SHORTER).alias("n_index"))
    return sizes.where("n >= 2 and n_index >= 1").select("key", "n")


def near_links(lines: DataFrame, firsts: DataFrame) -> DataFrame:
    """Edges (u, v) that connect lines within one edit. lines: (id, row_key, line_no, line), equal lines under one id, any number of times;
    firsts: (id, row_key, line_no) of one place of each."""
    sized = lines.withColumn("len", F.length("line"))
    n = F.col("len")
    entries = [
        F.struct(F.lit(role).alias("role"), F.lit(side).alias("side"), F.xxhash64(n - role, F.lit(side), _segment(F.col("line"), n, n - role, side)[0]).alias("key"))
        for role in (SHORTER, LONGER)
        for side in (0, 1)
    ]
    keys = sized.select("id", "len", F.explode(F.array(*entries)).alias("e")).where(f"e.role = {SHORTER} or len > {EDIT_CHARS}").select("id", "e.*")
    # a key is one row for each task, then one; few keys stand under two lines
    ends = keys.groupBy("key").agg(F.min("id").alias("a"), F.max("id").alias("b"), F.min("role").alias("role"))
    live = materialize(ends.where(f"a < b and role = {SHORTER}").select("key"), "live-keys")
    shared = materialize(keys.join(live, "key").distinct(), "shared")
    # texts only of lines that share a segment, from one place of each, so that copies of a line do not meet; by a merge, as
    # they grow with the input. Repeated rows have a place in common.
    places = firsts.join(shared.select("id").distinct().hint("merge"), "id", "left_semi")
    texts = sized.join(places.hint("merge"), ["id", "row_key", "line_no"], "left_semi").groupBy("id").agg(F.min("line").alias("line"))
    cut = shared.join(_alive(shared), "key").join(texts.withColumn("len", F.length("line")), "id")
    r = n - F.col("role")
    first, last = (_segment(F.col("line"), n, r, side) for side in (0, 1))
    rest, left = (F.when(F.col("side") == 0, first[k]).otherwise(last[k]) for k in (1, 2))
    rows = materialize(cut.select("key", "n", "id", "role", rest.alias("rest"), left.alias("r")), "segments")
    edges = None
    while True:
        more, many = (F.coalesce(F.max((F.col("n") > SMALL) & c), F.lit(False)) for c in (F.col("r") > SHORT, F.col("r") <= SHORT))
        state = rows.agg(more.alias("more"), many.alias("many")).first()
        new = _pairs(rows.where(f"n <= {SMALL}"))
        if state.many:
            new = new.unionByName(_stars(rows.where(f"n > {SMALL} and r <= {SHORT}")))
        edges = new if edges is None else edges.unionByName(new)
        if not state.more:
            return edges
        split = rows.where(f"n > {SMALL} and r > {SHORT}").select("id", "role", F.explode(_blocks(F.col("key"), F.col("rest"), F.col("r"))).alias("h")).select("id", "role", "h.*")
        rows = materialize(split.join(_alive(split), "key"), "segments")


def _pairs(small: DataFrame) -> DataFrame:
    """Verified pairs of small groups."""
    a = small.where(F.col("role") == SHORTER).select("key", F.col("id").alias("u"), F.col("rest").alias("x"))
    b = small.select("key", F.col("id").alias("v"), F.col("rest").alias("y"), "role")
    pairs = a.join(b, "key").where(((F.col("role") == LONGER) | (F.col("u") < F.col("v"))) & (F.col("u") != F.col("v")))
    # a lambda's variable holds what differs: as plain expressions it would be made again at every use
    near = F.exists(F.array(_differing(F.col("x"), F.col("y"))), lambda s: edits_within(s["x"], s["y"], THRESHOLD).isNotNull())
    return pairs.where(near).select("u", "v")


def _stars(many: DataFrame) -> DataFrame:
    """Each short rest of a large group with the first of those that agree but for one letter."""
    each = many.select("id", "role", F.explode(_letters(F.col("key"), F.col("rest"), F.col("role"))).alias("key"))
    least = each.groupBy("key").agg(F.min("id").alias("u"), F.max("id").alias("most"), F.min("role").alias("role")).where(f"u < most and role = {SHORTER}")
    return each.select("key", F.col("id").alias("v")).join(least.select("key", "u"), "key").where("u <> v").select("u", "v")


def line_classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, row_key, line_no, class_doc_id, class_line_no, kept) of every line."""
    lines = lines_of(docs, doc_id, text).withColumn("id", F.when(F.trim("line") != "", F.xxhash64("line")))
    place = F.struct("doc_id", "row_key", "line_no")
    slim = lines.select("doc_id", "row_key", "line_no", "id")
    named = slim.where("id is not null")
    firsts = materialize(named.groupBy("id").agg(F.min(place).alias("first"), F.count("*").alias("n")), "firsts")
    long = lines.where(F.col("id").isNotNull() & (F.length("line") >= EDIT_CHARS)).select("id", "row_key", "line_no", "line")
    roots = materialize(components(near_links(long, firsts.select("id", "first.row_key", "first.line_no"))), "classes")
    # lines that occur more than once or have neighbours; all others are classes of their own
    some = firsts.join(roots.withColumnRenamed("node", "id"), "id", "left").where("n > 1 or root is not null").select("id", "first", "root")
    # written down, so that Spark can split a class or a line with very many rows where it joins them
    some = materialize(some, "repeated")
    least = materialize(some.where("root is not null").groupBy("root").agg(F.min("first").alias("least")), "least")
    near = some.where("root is not null").join(least, "root").select("id", F.col("least").alias("first"))
    first = some.where("root is null").select("id", "first").unionByName(near)
    found = named.join(first, "id", "left").withColumn("first", F.coalesce("first", place))
    found = found.unionByName(slim.where("id is null").withColumn("first", place))
    return found.select(
        "doc_id", "row_key", "line_no", F.col("first.doc_id").alias("class_doc_id"), F.col("first.line_no").alias("class_line_no"), F.col("first").eqNullSafe(place).alias("kept")
    )


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without the lines that repeat an earlier one; a document goes that loses lines and has nothing but blanks left.

    n_chars, where there is one, follows the text.
    """
    # a line number for each line that goes; positions without them are found by hashing, whatever their number
    gone = line_classes(docs, doc_id, text).where(~F.col("kept")).groupBy(F.col("row_key").alias("key")).agg(F.collect_set("line_no").alias("gone"))
    # the input's columns in one, so that no name clashes
    rows = docs.select(F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)]).alias("row"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("whole"), F.col(f"`{doc_id}`").alias("own_id"))
    rows = rows.withColumn("key", _row_key("own_id", "whole")).join(gone, "key", "left")
    parts = F.split("whole", "\n")
    places = F.array_sort(F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col("gone")))
    chosen = F.transform(F.array(F.struct(parts.alias("p"), places.alias("l"))), lambda s: F.transform(s["l"], lambda i: F.get(s["p"], i)))[0]
    old = F.col(f"row.c{docs.columns.index(text)}")
    rows = rows.withColumn("left", F.when(F.col("gone").isNull(), old).otherwise(F.array_join(chosen, "\n")))
    rows = rows.where(F.col("gone").isNull() | F.col("left").rlike(r"[^ \n]"))
    new = {text: F.col("left"), "n_chars": F.length("left").cast("long")}
    return rows.select(*[new.get(c, F.col(f"row.c{i}")).alias(c) for i, c in enumerate(docs.columns)])


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return line_classes(docs).drop("row_key")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that occur earlier."""
    return dedup_lines(docs)
