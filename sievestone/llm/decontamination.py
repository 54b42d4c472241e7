"""Benchmark decontamination by template canonicalisation.

A text becomes a row of lower-case words. Names (runs of capitalised words inside a sentence, but not words in capitals
throughout), numbers (in digits or spelled out) and units after a number become typed placeholders that keep their value.
Windows of WIDTH words are hashed as templates, without values, and joined with the windows of the benchmark, so that a
re-parameterised question has the same hashes. Templates of few words outside placeholders identify nothing and are left out (weak
windows). Items that have such windows are searched for once more, literally: windows of their plain words, nothing marked, so
that a verbatim copy is found whatever it holds.

Windows of a document and an item on one diagonal (equal distance of positions) are a match when they cover RUN words, or
all of the item's windows of that kind. Values must map one to one from the item to the document: `2 kg ... 2` may become
`7 kg ... 7`, not `7 kg ... 9`.

Native: SQL functions only, no Python on the executors.

Defined results: null and empty texts have no windows and so no matches. An item shorter than WIDTH words is one window
of its own length, a literal one below LEAST words. An item of fewer than SHORTEST words matches lines that hold nothing else (first_word
is null then); an item without words matches nothing. first_word counts canonical words, or plain ones in a literal match. Repeated rows are matched once; equal ids with other texts are matched each and
then joined, in the stage told apart by their texts. A null doc_id is carried. Texts are read whole. Other columns
of the input are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievestone.llm.components import sized
from sievestone.session import materialize

WIDTH, RUN, LEAST, SHORTEST, LITERALS = 8, 13, 4, 3, 3
#: Benchmark windows that are broadcast at most; beyond that the join shuffles.
BROADCAST_WINDOWS = 500_000
UNITS = (
    "mm cm dm km m mg kg g ml cl l mile miles mi inch inches feet foot ft yard yards pound pounds lb lbs ounce ounces oz ton tons tonne tonnes "
    "second seconds sec secs minute minutes min mins hour hours hr hrs day days week weeks month months year years percent dollar dollars "
    "cent cents euro euros usd eur kph mph watt watts kw volt volts degree degrees meter meters metre metres kilometer kilometers "
    "kilometre kilometres liter liters litre litres gram grams kilogram kilograms"
).split()
ONES = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
TENS = "twenty thirty forty fifty sixty seventy eighty ninety".split()
#: Spelled numbers and their digits; tens and ones are one word by then.
SPELLED = {w: i for i, w in enumerate(ONES)} | {t + (ONES[k] if k else ""): 10 * i + k for i, t in enumerate(TENS, 2) for k in range(10)} | {"hundred": 100, "thousand": 1000, "million": 10**6}
JOINED = rf"(?i)(?<=\b(?:{'|'.join(TENS)}))-(?=(?:{'|'.join(ONES[1:10])})\b)"
CAPITALISED = r"\p{Lu}(?=[\p{L}\p{M}]*\p{Ll})[\p{L}\p{M}]*"
# a name is taken with the white space before it, by which it is known
TOKEN = rf"(?<=[\p{{L}}\p{{N}},;])\s++[\"'“‘«(\[]?{CAPITALISED}(?:(?:\s+|-){CAPITALISED})*+|\p{{Nd}}++(?:[.,:/]\p{{Nd}}+)*|[a-zA-Z\p{{L}}\p{{M}}\p{{N}}]++"
PLAIN = r"\p{Nd}++(?:[.,:/]\p{Nd}+)*|[a-zA-Z\p{L}\p{M}\p{N}]++"
# private-use code points mark placeholders: opening, closing, before the value. In texts they are parted from words as
# whatever is neither letter nor digit
OPEN, CLOSE, VALUE = "", "", ""


def _bound(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x) with x worked out once: a plain expression would be worked out again at each use."""
    return F.transform(F.array(x), f)[0]


def _slot(kind: str, value: Column) -> Column:
    return F.concat(F.lit(OPEN + kind + VALUE), value, F.lit(CLOSE))


def _digits(w: Column) -> Column:
    c = F.substring(w, 1, 1)
    return F.when(c <= F.lit("z"), c.between("0", "9")).otherwise(c.rlike(r"\p{Nd}"))


def slot_words(text: Column) -> Column:
    """The canonical words of a text, placeholders with their values. A sharp s is two letters, as it is in capitals."""
    whole = F.replace(F.coalesce(text, F.lit("")), F.lit("ß"), F.lit("ss"))
    # the pattern is tried at every hyphen; few texts need it
    whole = F.when(F.contains(F.lower(whole), F.lit("ty-")), F.regexp_replace(whole, JOINED, "")).otherwise(whole)
    found = F.transform(F.regexp_extract_all(whole, F.lit(TOKEN), F.lit(0)), lambda w: F.lower(w))
    digits = F.create_map(*[F.lit(x) for w, n in SPELLED.items() for x in (w, str(n))])

    def slot(every: Column, w: Column, i: Column) -> Column:
        before = F.get(every, i - 1)
        name = F.regexp_replace(F.regexp_replace(w, r"^\s+[^\p{L}]?", ""), r"\s+", " ")
        return (
            F.when(F.substring(w, 1, 1) <= F.lit(" "), _slot("n", name))
            .when(_digits(w), _slot("d", w))
            .when(w.isin(*SPELLED), _slot("d", F.try_element_at(digits, w)))
            .when(w.isin(*UNITS) & (i > 0) & (_digits(before) | before.isin(*SPELLED)), _slot("u", w))
            .otherwise(w)
        )

    return _bound(found, lambda every: F.transform(every, lambda w, i: slot(every, w, i)))


def canonical(slots: Column) -> Column:
    """slot_words() without values; a placeholder is its kind alone."""
    return F.transform(slots, _kind)


def words(text: Column) -> Column:
    return canonical(slot_words(text))


def _is_slot(w: Column) -> Column:
    return F.startswith(w, F.lit(OPEN))


def _kind(w: Column) -> Column:
    return F.when(_is_slot(w), F.concat(F.substring(w, 1, 2), F.lit(CLOSE))).otherwise(w)


def plain_words(text: Column) -> Column:
    """The words of a text with nothing marked."""
    return F.regexp_extract_all(F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("ß"), F.lit("ss"))), F.lit(PLAIN), F.lit(0))


def _runs(values: Column, width: int, join: Callable[[Column, Column], Column]) -> Column:
    """Of every run of width values its value by join: runs of powers of two are made of halves, others of such runs."""

    def pair(a: Column, b: Column, gap: int) -> Column:
        n = F.greatest(F.size(b) - gap, F.lit(0))
        return F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(gap + 1), n), join)

    def power(k: int) -> Column:
        return values if k == 1 else _bound(power(k // 2), lambda h: pair(h, h, k // 2))

    out, done = None, 0
    for k in (1 << b for b in reversed(range(width.bit_length())) if width >> b & 1):
        out, done = (power(k), k) if out is None else (pair(out, power(k), done), done + k)
    return out


def window_hashes(words: Column, width: int) -> Column:
    """The hash of every window of width words."""
    return _runs(F.transform(words, lambda w: F.xxhash64(w)), width, lambda a, b: F.xxhash64(a, b))


def benchmark_forms(benchmark: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(item_id, form, sw): an item's words in each form in which a document may quote it."""
    # the first word stands in a sentence when a document quotes it, and may be a name there; a document in capitals or
    # small letters has no names
    raw = F.col(f"`{text}`")
    quoted = F.array(F.struct(raw.alias("t"), F.lit(0).alias("skip")), F.struct(F.concat(F.lit("x, "), raw).alias("t"), F.lit(1).alias("skip")), F.struct(F.lower(raw).alias("t"), F.lit(0).alias("skip")))
    each = benchmark.select(F.col(f"`{item_id}`").alias("item_id"), F.xxhash64(raw).alias("item_hash"), F.explode(quoted).alias("q"))
    each = each.select("item_id", "item_hash", "q.skip", slot_words(F.col("q.t")).alias("sw"))
    own = F.slice("sw", F.col("skip") + 1, F.greatest(F.size("sw") - F.col("skip"), F.lit(0)))
    return each.select("item_id", "item_hash", own.alias("sw")).where(F.size("sw") > 0).distinct().select("item_id", F.xxhash64("item_hash", "sw").alias("form"), "sw")


def _windows(items: DataFrame, words: str) -> tuple[list[int], DataFrame]:
    """The widths, WIDTH numbers at most, and (width, h, item_id, form, at, n_slots) of every window of items (item_id, form, words)."""
    items = items.withColumn("width", F.least(F.size(words), F.lit(WIDTH)))
    widths = sorted(r["width"] for r in items.select("width").distinct().collect())
    own = F.coalesce(*[F.when(F.col("width") == k, window_hashes(canonical(F.col(words)), k)) for k in widths or [WIDTH]])
    each = items.select("item_id", "form", words, "width", F.posexplode(own).alias("at", "h"))
    slots = F.size(F.filter(F.expr(f"slice({words}, at + 1, width)"), _is_slot))
    return widths, each.select("width", "h", "item_id", "form", "at", slots.alias("n_slots")).distinct()


def _diagonals(rows: DataFrame, words: Column, widths: list[int], bench: DataFrame) -> DataFrame:
    """(doc_id, text_hash, item_id, form, diagonal, found, n_slots, width) of every diagonal with RUN words or all windows of a form in bench."""
    sizes = bench.groupBy("item_id", "form").agg(F.count("*").cast("int").alias("item_windows"))
    bench = materialize(bench.alias("w").join(sizes.alias("s"), F.expr("w.item_id <=> s.item_id and w.form = s.form")).select("w.*", "item_windows"), "benchmark")
    # one pass over the texts for all widths
    listed = rows.select("doc_id", F.xxhash64("text").alias("text_hash"), words.alias("words"))
    sets = listed.select("doc_id", "text_hash", *[window_hashes(F.col("words"), k).alias(f"w{k}") for k in widths])
    # outer, as the optimizer would else filter by the size of the array, and work it out twice
    probes = sets.select("doc_id", "text_hash", F.lit(widths[0]).alias("width"), F.posexplode_outer(f"w{widths[0]}").alias("pos", "h"))
    if len(widths) > 1:
        each = F.array(*[F.struct(F.lit(k).alias("width"), F.col(f"w{k}").alias("hs")) for k in widths])
        probes = sets.select("doc_id", "text_hash", F.explode(each).alias("s")).select("doc_id", "text_hash", "s.width", F.posexplode("s.hs").alias("pos", "h"))
    side = F.broadcast(bench) if bench.count() <= BROADCAST_WINDOWS else bench
    hits = probes.join(side, ["width", "h"]).withColumn("diagonal", F.col("pos") - F.col("at"))
    # a document's rows are in one task: what is shuffled is one row for each diagonal. at runs over an item's windows.
    lines = hits.groupBy("doc_id", "text_hash", "item_id", "form", "diagonal").agg(
        F.array_sort(F.collect_set("at")).alias("found"), F.max("n_slots").alias("n_slots"), F.max("width").alias("width"), F.max("item_windows").alias("item_windows")
    )
    return materialize(lines.where(F.size("found") >= F.least(F.lit(RUN - WIDTH + 1), F.col("item_windows"))), "leaks")


def _leaks(docs: DataFrame, benchmark: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, text_hash, item_id, n_windows, item_windows, n_slots, first_word) of every diagonal that is a match."""
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    forms = materialize(benchmark_forms(benchmark), "forms")
    widths, every = _windows(forms.where(F.size("sw") >= LEAST), "sw")
    strong = F.col("width") - F.col("n_slots") >= F.least(F.lit(LITERALS), (F.col("width") + 1) / 2)
    found = []
    if widths:
        lines = _diagonals(rows, words(F.col("text")), widths, every.where(strong))
        slotted, checked = lines.where("n_slots > 0"), lines.where("n_slots = 0")
        if not slotted.isEmpty():
            judged = materialize(_consistent(slotted, rows, forms), "judged")
            checked = _not_overruled(checked.unionByName(judged.where("one_to_one").drop("one_to_one")), judged.where("not one_to_one"))
        found.append(checked)
    weak = every.where(~strong).select("item_id").unionByName(forms.where(F.size("sw") < LEAST).select("item_id")).distinct()
    plain = benchmark.select("item_id", F.xxhash64("text").alias("form"), plain_words(F.col("text")).alias("pw")).distinct()
    plain = materialize(plain.alias("p").join(weak.alias("k"), F.expr("p.item_id <=> k.item_id"), "left_semi"), "plain-items")
    # only where there are items with weak windows are texts read once more
    widths, every = _windows(plain.where(F.size("pw") >= SHORTEST), "pw")
    if widths:
        found.append(_diagonals(rows, plain_words(F.col("text")), widths, every))
    found = [f.select("doc_id", "text_hash", "item_id", F.size("found").alias("n_windows"), "item_windows", "n_slots", (F.col("diagonal") + F.col("found")[0]).alias("first_word")) for f in found]
    few = plain.where(F.size("pw").between(1, SHORTEST - 1)).select("item_id", F.xxhash64("pw").alias("h"))
    if not found or not few.isEmpty():
        found.append(_whole_lines(rows, few))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def _whole_lines(rows: DataFrame, few: DataFrame) -> DataFrame:
    """Lines that are an item of one or two words."""
    lines = rows.select("doc_id", F.xxhash64("text").alias("text_hash"), F.explode(F.split("text", "\n")).alias("line"))
    hits = lines.select("doc_id", "text_hash", F.xxhash64(plain_words(F.col("line"))).alias("h")).join(few, "h").distinct()
    one, none = F.lit(1), F.lit(None).cast("int")
    return hits.select("doc_id", "text_hash", "item_id", one.alias("n_windows"), one.alias("item_windows"), F.lit(0).alias("n_slots"), none.alias("first_word"))


def matches(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, item_id, n_windows, item_windows, n_slots, first_word) of every leak: the longest diagonal of each pair."""
    best = _leaks(docs, benchmark, doc_id, text).groupBy("doc_id", "item_id").agg(
        F.max(F.struct("n_windows", (-F.col("first_word")).alias("neg"), "item_windows", "n_slots")).alias("b")
    )
    return best.select(
        "doc_id",
        "item_id",
        F.col("b.n_windows").cast("long").alias("n_windows"),
        F.col("b.item_windows").cast("long").alias("item_windows"),
        F.col("b.n_slots").cast("long").alias("n_slots"),
        (-F.col("b.neg")).cast("long").alias("first_word"),
    )


def _consistent(lines: DataFrame, rows: DataFrame, forms: DataFrame) -> DataFrame:
    """lines with one_to_one: whether their placeholders map so. Reads the texts of these documents again."""
    items = forms.select(F.col("item_id").alias("i"), F.col("form").alias("f"), F.col("sw").alias("iw"))
    texts = rows.withColumn("text_hash", F.xxhash64("text")).join(
        lines.select("doc_id", "text_hash").distinct(), [rows.doc_id.eqNullSafe(lines.doc_id), F.xxhash64(rows.text) == lines.text_hash], "left_semi"
    )
    texts = texts.groupBy("doc_id", "text_hash").agg(F.min("text").alias("text")).select(F.col("doc_id").alias("d"), F.col("text_hash").alias("t"), slot_words(F.col("text")).alias("dw"))
    both = lines.join(items, lines.item_id.eqNullSafe(items.i) & (lines.form == items.f)).join(texts, lines.doc_id.eqNullSafe(texts.d) & (lines.text_hash == texts.t))
    spots = F.array_distinct(F.flatten(F.transform("found", lambda x: F.sequence(x, x + F.col("width") - 1))))
    pairs = F.transform(spots, lambda i: F.struct(F.get("iw", i).alias("a"), F.get("dw", i + F.col("diagonal")).alias("b")))
    pairs = F.filter(pairs, lambda p: _is_slot(p["a"]))
    pairs = F.array_distinct(pairs)
    one = F.size(F.array_distinct(F.transform(pairs, lambda p: p["a"]))) == F.size(pairs)
    other = F.size(F.array_distinct(F.transform(pairs, lambda p: p["b"]))) == F.size(pairs)
    return both.select(*lines.columns, (one & other).alias("one_to_one"))


def _not_overruled(lines: DataFrame, bad: DataFrame) -> DataFrame:
    """lines but those that are part of a longer line that another form of the item has there, whose values do not map one to one."""
    begin, end = "{0}.diagonal + {0}.found[0]", "{0}.diagonal + {0}.found[size({0}.found) - 1] + {0}.width"
    over = "g.doc_id <=> b.doc_id and g.text_hash = b.text_hash and g.item_id <=> b.item_id and g.form <> b.form and size(b.found) > size(g.found)"
    over += f" and {begin.format('g')} < {end.format('b')} and {begin.format('b')} < {end.format('g')}"
    return lines.alias("g").join(bad.alias("b"), F.expr(over), "left_anti")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a leak. Rows that share an id, or have none, are judged by their own texts."""
    found = _leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), "doc_id", "text").select(F.col("doc_id").alias("_leak"), F.col("text_hash").alias("_hash")).distinct()
    leaks = sized(found, "leaking")
    return docs.join(leaks, docs.doc_id.eqNullSafe(leaks["_leak"]) & (F.xxhash64(docs.text) == leaks["_hash"]), "left_anti")
