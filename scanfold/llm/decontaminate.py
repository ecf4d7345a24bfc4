"""Benchmark decontamination by spaced seeds, in DataFrame functions only.

A mask picks some of the words in a window and ignores the others, so a window still hashes alike
when words at ignored places were replaced. The hashes of all windows of documents and benchmark
items are joined; each hit fixes how an item lies along a document. Around a hit the item and the
document are compared word by word along that diagonal: a document holds an item when some stretch
has four fifths of its words equal, wherever the different ones stand, and ``least_words`` equal
words or four fifths of the item's, whichever is less. Of a diagonal's stretches the one with the
best score counts, where an equal word is 1 and a different one -4.

The masks lose none of these: every way to place a fifth of different words in a stretch leaves one
mask at one place without any, which a test tries out in full up to 25 words; a longer stretch holds
a shorter one of 13 to 25 words with the same share.

Words are runs of letters and digits in lower case. Items shorter than the masks' span are looked
up by a mask of their own length without ignored places, and must be there whole. A null or empty
text has no words and no hits. Rows without an id can't be named and are left out; rows that share
one, repeated rows too, are taken together. Of stretches with equally many equal words the first in
the document counts, then the first in the item. Texts of any length are read whole. Empty tables on
either side give an empty result. Only the named columns are read, whatever others there are.

Before the join, a bit array of one size for any benchmark, handed over as a scalar subquery, sorts
out windows whose hash no item has, so only those that may hit are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanfold.llm.common import spare, text_of
from scanfold.sources.workspace import stored

#: Places of a window that count; the others are ignored.
MASKS = ((0, 1, 2, 3, 4), (0, 1, 2, 4, 5), (0, 1, 4, 6, 7))
LEAST_WORDS = 13
#: What a different word costs, against 1 for an equal one: four fifths equal sum up to nothing.
MISMATCH = 4
#: Bits of the array that sorts out windows: 2 to this power.
BIT_POWER = 22


def word_hashes(text: Column) -> Column:
    """The hashes of a text's words, in order."""
    words = F.split(F.lower(text_of(text)), r"[^\p{L}\p{N}]+")
    return F.transform(F.filter(words, lambda w: w != ""), lambda w: F.xxhash64(w))


def _windows(rows: DataFrame, masks: dict[str, tuple], items: bool) -> DataFrame:
    """id, p and each mask's hash of each window: rows has id and h. A window at the end that a mask
    doesn't fit has none, and of items only those of its own length have the hash of a short mask."""
    each = rows.select("id", "h", F.posexplode("h").alias("p", "x"))

    def fits(name: str, mask: tuple) -> Column:
        return (F.size("h") == len(mask)) & (F.col("p") == 0) if items and name.startswith("s") else F.col("p") + mask[-1] < F.size("h")

    hashes = [F.when(fits(name, mask), F.xxhash64(F.lit(name), *[F.get("h", F.col("p") + o) for o in mask])).alias(name) for name, mask in masks.items()]
    return each.select("id", "p", *hashes)


def _bits(keys: DataFrame) -> DataFrame:
    """One row with an array of 64-bit words in which the bit of each key is set."""
    words = 1 << BIT_POWER - 6
    place = F.col("k").bitwiseAND((1 << BIT_POWER) - 1)
    own = keys.select(F.shiftright(place, 6).alias("word"), F.expr("shiftleft(1L, cast(k & 63 as int))").alias("bit"))
    dense = own.groupBy("word").agg(F.bit_or("bit").alias("bits"))
    dense = keys.sparkSession.range(words).join(dense, F.col("id") == F.col("word"), "left").select("id", F.coalesce("bits", F.lit(0).cast("long")).alias("bits"))
    return dense.agg(F.transform(F.sort_array(F.collect_list(F.struct("id", "bits"))), lambda x: x["bits"]).alias("bits"))


def _may_hit(k: Column, bits: Column) -> Column:
    place = k.bitwiseAND((1 << BIT_POWER) - 1)
    word = F.get(bits, F.shiftright(place, 6).cast("int"))
    return word.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), k.bitwiseAND(63).cast("int"))) != 0


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 item_col: str = "item_id", item_text_col: str = "text", masks=MASKS, least_words: int = LEAST_WORDS) -> DataFrame:
    """One row per document and benchmark item that it holds: id, item, doc_word (where the best
    stretch begins in the document), item_word, n_words (its length), n_equal."""
    items = benchmark.select(F.col(item_col).alias("id"), word_hashes(F.col(item_text_col)).alias("h")).filter(F.size("h") > 0)
    items = stored(items, "benchmark-words")
    span = max(m[-1] for m in masks) + 1
    short = [r[0] for r in items.filter(F.size("h") < span).select(F.size("h").alias("n")).distinct().collect()]  # fewer than the span
    named = {f"m{i}": m for i, m in enumerate(masks)} | {f"s{n}": tuple(range(n)) for n in sorted(short)}

    def keys(rows: DataFrame, bits: Column | None) -> DataFrame:
        wide = _windows(rows, named, bits is None)
        if bits is not None:
            # First whether any of a window's hashes may hit, then each hash on its own.
            some = F.lit(False)
            for name in named:
                some = some | F.coalesce(_may_hit(F.col(name), bits), F.lit(False))
            wide = wide.filter(some)
        return wide.select("id", "p", F.explode(F.array(*named)).alias("k")).filter("k is not null")

    seeds = stored(keys(items, None).select(F.col("id").alias("item"), F.col("p").alias("q"), "k"), "benchmark-seeds")
    bits = stored(_bits(seeds), "benchmark-bits")
    # The array is a barrier that keeps the hashing of words out of the windows' expressions.
    rows = docs.select(F.col(id_col).alias("id"), F.explode(F.array(word_hashes(F.col(text_col)))).alias("h"))
    hits = keys(rows, bits.scalar()).join(seeds, "k").select("id", "item", (F.col("p") - F.col("q")).alias("diagonal")).distinct()
    # Hits are stored, so that the planner knows their size and texts move only if they are many.
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(stored(hits, "benchmark-hits"), "id")
    # With the words of both sides, each diagonal is compared whole.
    along = texts.select("id", "item", "diagonal", F.explode(F.array(word_hashes(F.col("text")))).alias("h")).join(
        items.select(F.col("id").alias("item"), F.col("h").alias("g")), "item")
    # A stretch begins and ends with equal words, so their places are all that is looked at. With the
    # a-th to the b-th of them its score is 5 (b - a + 1) - 4 (p[b] - p[a] + 1): a part of its end and
    # a part of its start, whose highest value so far goes along.
    wanted = F.when(F.col("size") < span, F.col("size")).otherwise(F.least(F.lit(least_words), F.ceil(F.col("size") * 0.8))).cast("int")
    alike = F.filter(F.transform("g", lambda w, i: F.when(F.get("h", i + F.col("diagonal")) == w, i)), lambda i: i.isNotNull())
    scan = along.select("id", "item", "diagonal", F.size("g").alias("size"), alike.alias("at")).select("*", wanted.alias("wanted")).filter(F.size("at") >= F.col("wanted"))
    whole = MISMATCH + 1

    def parts(p: Column, b: Column) -> Column:
        a = b - F.col("wanted") + 1
        first = F.get("at", a)
        return F.struct(p.alias("p"), (b * whole - p * MISMATCH + 1).alias("end"), (first * MISMATCH - a * whole).alias("start"), first.alias("first"))

    state = F.struct(F.lit(None).cast("int").alias("high"), F.lit(0).alias("from"), F.struct(F.lit(-1).alias("score"), F.lit(0).alias("start"), F.lit(0).alias("words")).alias("best"))

    def step(s: Column, e: Column) -> Column:
        higher = e["start"].isNotNull() & (s["high"].isNull() | (e["start"] > s["high"]))
        high, begin = F.when(higher, e["start"]).otherwise(s["high"]), F.when(higher, e["first"]).otherwise(s["from"])
        better = F.coalesce(high + e["end"] > s["best"]["score"], F.lit(False))
        best = F.when(better, F.struct((high + e["end"]).alias("score"), begin.alias("start"), (e["p"] - begin + 1).alias("words"))).otherwise(s["best"])
        return F.struct(high.alias("high"), begin.alias("from"), best.alias("best"))

    told = scan.select("id", "item", "diagonal", F.aggregate(F.transform("at", parts), state, step, lambda s: s["best"]).alias("s")).filter("s.score >= 0")
    found = told.select("id", "item", F.struct(
        ((F.col("s.words") * MISMATCH + F.col("s.score")) / whole).cast("int").alias("n_equal"), (-(F.col("s.start") + F.col("diagonal"))).alias("before"),
        (-F.col("s.start")).alias("item_before"), F.col("s.words").alias("n_words")).alias("b"))
    top = found.groupBy("id", "item").agg(F.max("b").alias("b"))
    return top.select(F.col("id").alias(id_col), F.col("item").alias(item_col), (-F.col("b.before")).cast("long").alias("doc_word"),
                      (-F.col("b.item_before")).cast("long").alias("item_word"), F.col("b.n_words").cast("long").alias("n_words"), F.col("b.n_equal").cast("long").alias("n_equal"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all their columns, that hold no benchmark item. Rows are matched by id
    and content hash, so rows that share an id or have none are judged by their own texts."""
    own = spare(docs, "content")
    rows = docs.withColumn(own, F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.lit("")), text_of(text_col)))
    found = contaminated(rows.select(F.col(own).alias("doc_id"), F.col(text_col).alias("text")), benchmark)
    found = stored(found.select(F.col("doc_id").alias("content")).distinct(), "contaminated")
    return rows.join(found, rows[own] == found["content"], "left_anti").drop(own)
