"""Phrase collocation mining by direct-address tiling.

Texts are cut into pieces at ``.,;:!?`` and line ends and pieces into words at spaces and tabs.
Words that occur often enough are numbered by falling frequency per language, so the pairs that
occur most lie close together: pairs of word numbers are cut into tiles of 1024 x 1024, and a task
counts the tiles that it fills well in a dense array (``bincount``) and the others as sorted
coordinates. Frequent pairs are then numbered by falling frequency in the same way, and a phrase of
three words is counted as a pair of a pair's number and a word's number. Spark adds up what the tasks counted.

A phrase of two or three words is a candidate with ``least`` occurrences or more. It is cut at the
place where 1,000,000 * a * a / (l * r) is lowest, in whole numbers of 38 digits; it is dropped when a longer
candidate around it occurs half as often or more. A phrase can't occur more often than its
parts, so leaving out rarer words and pairs loses none.

What is broadcast is bounded: numbers go to the ``most_words`` words and ``most_pairs`` pairs that
are most frequent over all languages. Where there are more, the rest is counted exactly another
way: phrases with a word without a number as texts, phrases around a pair without a number as
coordinates of three word numbers. With fewer, nothing is counted that way.

A null text is empty, a null language is ``und``. Rows that repeat count again. An empty table gives
an empty result. A text is held whole by the task that reads it. Only the named columns are read.
"""

from __future__ import annotations

from collections import Counter
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scanfold.llm.common import text_of
from scanfold.sources.workspace import stored

UNKNOWN_LANGUAGE = "und"
LEAST = 10
KEPT = 2000
#: Parts that a language's candidates are ranked in before they are ranked together.
RANKED_PARTS = 32
#: Bits of a word's number in a code of pairs and triples, so the most words that have one.
WORD_BITS = 20
MOST_WORDS = 1 << WORD_BITS
MOST_PAIRS = 1 << 22
TILE_BITS = 10
#: A tile is counted densely once so many of its pairs are met at a time; so many dense tiles a task keeps.
DENSE_FROM = 1 << 14
DENSE_TILES = 2
#: Pairs and phrases that a task holds before it counts them, and words before it sends them on.
HELD = 1 << 19
HELD_TEXTS = 1 << 17

#: Signs that end a piece; a full stop stands for all of them, as no word holds one.
BREAK = b"."
_TABLE = bytes.maketrans(b".,;:!?\x0a\x0b\x0c\x0d", BREAK * 10)
_BREAK, _OTHER = -1, -2


def words_of(text: bytes) -> list:
    """Words and breaks of a text; letters A to Z are lower-cased."""
    return text.lower().translate(_TABLE).replace(BREAK, b" . ").split()


def word_counts(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """lang, word, f of every word."""
    schema = pa.schema([("lang", pa.string()), ("word", pa.string()), ("f", pa.int64())])

    def run(batches):
        held: dict = {}

        def told():
            for lang, counts in held.items():
                counts.pop(BREAK, None)
                if counts:
                    yield pa.RecordBatch.from_arrays([
                        pa.array([lang] * len(counts), pa.string()), pa.array(list(counts), pa.binary()).cast(pa.string()),
                        pa.array(list(counts.values()), pa.int64())], schema=schema)
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                held.setdefault(lang, Counter()).update(words_of(text))
                if sum(map(len, held.values())) > HELD_TEXTS:
                    yield from told()
                    held = {}
        yield from told()

    return _texts(docs, lang_col, text_col).mapInArrow(run, "lang string, word string, f long").groupBy("lang", "word").agg(F.sum("f").alias("f"))


def _texts(docs: DataFrame, lang_col: str, text_col: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit(UNKNOWN_LANGUAGE)).alias("lang"), text_of(text_col).alias("text"))


def _most_frequent(rows: DataFrame, most: int, order: list) -> tuple:
    """The first rows in the order, ``most`` at most, at the driver; and whether these are all.

    Few enough rows are sorted here, since a limit on Spark would send them all through one task.
    """
    whole = rows.count() <= most
    if whole:
        return rows.toArrow().sort_by([(name, "descending" if down else "ascending") for name, down in order]), True
    return rows.orderBy(*[F.desc(name) if down else F.asc(name) for name, down in order]).limit(most).toArrow(), False


class Numbers:
    """Numbers of the most frequent words of each language, by falling frequency."""

    def __init__(self, words: DataFrame, most: int):
        most = min(most, MOST_WORDS)
        # ``most`` rows at most come to the driver.
        rows, self.whole = _most_frequent(words.select("lang", "word", "f"), most, [("f", True), ("lang", False), ("word", False)])
        self.by_lang: dict = {}
        for lang, word in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist()):
            own = self.by_lang.setdefault(lang, {})
            own[word.encode()] = len(own)

    def lookup(self, lang: str) -> dict:
        """Numbers by word, with the break."""
        return self.by_lang.get(lang, {}) | {BREAK: _BREAK}


class Pairs:
    """Numbers of the most frequent pairs of each language: sorted codes with the number of each."""

    def __init__(self, pairs: DataFrame, most: int):
        coded = pairs.filter(F.col("code").isNotNull())
        rows, self.whole = _most_frequent(coded.select("lang", "code", "a"), most, [("a", True), ("lang", False), ("code", False)])
        self.by_lang: dict = {}
        langs, codes = rows.column(0).to_numpy(zero_copy_only=False), rows.column(1).to_numpy()
        for lang in set(langs.tolist()):
            ranked = codes[langs == lang]
            order = np.argsort(ranked)
            self.by_lang[lang] = (ranked, ranked[order], order)

    def number(self, lang: str, codes: np.ndarray) -> np.ndarray:
        """The number of each pair, -1 where it has none."""
        if lang not in self.by_lang:
            return np.full(len(codes), -1)
        _, known, order = self.by_lang[lang]
        at = np.minimum(np.searchsorted(known, codes), len(known) - 1)
        return np.where(known[at] == codes, order[at], -1)


class TileCounts:
    """Counts of (left, right) number pairs of one language: dense tiles, and sorted coordinates for the rest."""

    def __init__(self):
        self.dense: dict = {}

    def add(self, left: np.ndarray, right: np.ndarray) -> tuple:
        """Count pairs; returns (left, right, count) of those that lie in no dense tile."""
        side = 1 << TILE_BITS
        tile = (left >> TILE_BITS << 32) | right >> TILE_BITS
        rest = np.ones(len(left), bool)
        found, sizes = np.unique(tile, return_counts=True)
        for t, n in sorted(zip(found.tolist(), sizes.tolist()), key=lambda x: -x[1])[:DENSE_TILES]:
            if t not in self.dense and (n < DENSE_FROM or len(self.dense) >= DENSE_TILES):
                continue
            own = tile == t
            cells = (left[own] & side - 1) << TILE_BITS | right[own] & side - 1
            counts = np.bincount(cells, minlength=side * side)
            self.dense[t] = self.dense[t] + counts if t in self.dense else counts
            rest &= ~own
        codes, counts = np.unique(left[rest] << 32 | right[rest], return_counts=True)
        return codes >> 32, codes & 0xFFFFFFFF, counts

    def totals(self):
        """(left, right, count) of each dense tile."""
        side = 1 << TILE_BITS
        for t, counts in self.dense.items():
            cells = np.flatnonzero(counts)
            yield (t >> 32 << TILE_BITS) + (cells >> TILE_BITS), ((t & 0xFFFFFFFF) << TILE_BITS) + (cells & side - 1), counts[cells]


_COUNTED = pa.schema([("lang", pa.string()), ("code", pa.int64()), ("phrase", pa.string()), ("a", pa.int64())])


def _coded(lang: str, codes: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([
        pa.array([lang]).take(pa.array(np.zeros(len(codes), np.int32))), pa.array(codes, pa.int64()),
        pa.nulls(len(codes), pa.string()), pa.array(counts, pa.int64())], schema=_COUNTED)


def phrase_counts(docs: DataFrame, size: int, numbers: Numbers, pairs: Pairs | None = None, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """lang, code or phrase, a: partial counts of the phrases of ``size`` words that can be frequent.

    A code holds the numbers of the words, ``WORD_BITS`` bits each; a phrase with a word without a
    number is a text.
    """
    known = docs.sparkSession.sparkContext.broadcast((numbers, pairs))

    def run(batches):
        numbers, pairs = known.value
        lookups: dict = {}
        tiles: dict = {}
        texts: dict = {}
        held: dict = {}
        default = _BREAK if numbers.whole else _OTHER

        def count(lang):
            """Count the held numbers of a language."""
            ids = np.concatenate(held.pop(lang)).astype(np.int64)
            columns = [ids[k:len(ids) - size + 1 + k] for k in range(size)]
            columns = [c[np.all([c >= 0 for c in columns], axis=0)] for c in columns] if size == 2 else columns
            own = tiles.setdefault(lang, TileCounts())
            if size == 2:
                left, right, counts = own.add(*columns)
                yield _coded(lang, left << WORD_BITS | right, counts)
                return
            whole = np.all([c >= 0 for c in columns], axis=0)
            first, second, third = (c[whole] for c in columns)
            number = pairs.number(lang, first << WORD_BITS | second)
            if pairs.whole:
                wanted = (number >= 0) & (pairs.number(lang, second << WORD_BITS | third) >= 0)
                left, right, counts = own.add(number[wanted], third[wanted])
            else:
                left, right, counts = own.add(number[number >= 0], third[number >= 0])
                alone = number < 0
                codes, seen = np.unique((first[alone] << WORD_BITS | second[alone]) << WORD_BITS | third[alone], return_counts=True)
                yield _coded(lang, codes, seen)
            if len(left):
                yield _coded(lang, pairs.by_lang[lang][0][left] << WORD_BITS | right, counts)

        def told_texts():
            for lang, counts in texts.items():
                yield pa.RecordBatch.from_arrays([
                    pa.array([lang] * len(counts), pa.string()), pa.nulls(len(counts), pa.int64()),
                    pa.array(list(counts), pa.binary()).cast(pa.string()), pa.array(list(counts.values()), pa.int64())], schema=_COUNTED)
            texts.clear()

        sizes: Counter = Counter()
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                if lang not in lookups:
                    lookups[lang] = numbers.lookup(lang)
                words = words_of(text)
                if len(words) < size:
                    continue
                ids = np.fromiter(map(lookups[lang].get, words, repeat(default)), np.int32, len(words))
                held.setdefault(lang, []).extend((ids, np.array([_BREAK], np.int32)))
                sizes[lang] += len(ids) + 1
                if not numbers.whole:
                    columns = np.stack([ids[k:len(ids) - size + 1 + k] for k in range(size)])
                    odd = np.flatnonzero(np.all(columns != _BREAK, axis=0) & np.any(columns == _OTHER, axis=0))
                    texts.setdefault(lang, Counter()).update(b" ".join(words[i:i + size]) for i in odd.tolist())
                    if sum(map(len, texts.values())) > HELD_TEXTS:
                        yield from told_texts()
                if sum(sizes.values()) > HELD:
                    for name in list(held):
                        yield from count(name)
                    sizes.clear()
        for name in list(held):
            yield from count(name)
        for lang, own in tiles.items():
            for left, right, counts in own.totals():
                yield _coded(lang, (left if size == 2 else pairs.by_lang[lang][0][left]) << WORD_BITS | right, counts)
        yield from told_texts()

    return _texts(docs, lang_col, text_col).mapInArrow(run, "lang string, code long, phrase string, a long")


def frequent(counts: DataFrame, size: int, numbers: Numbers, least: int) -> DataFrame:
    """lang, code, words (an array of ``size``), a of the phrases with ``least`` occurrences or more."""
    summed = counts.groupBy("lang", "code", "phrase").agg(F.sum("a").alias("a")).filter(F.col("a") >= least)
    known = counts.sparkSession.sparkContext.broadcast(numbers)
    schema = pa.schema([("lang", pa.string()), ("code", pa.int64()), ("words", pa.list_(pa.string())), ("a", pa.int64())])

    def run(batches):
        names: dict = {}
        for batch in batches:
            out = []
            for lang, code, phrase in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if code is None:
                    out.append(phrase.split(" "))
                    continue
                if lang not in names:
                    names[lang] = [w.decode() for w in known.value.by_lang[lang]]
                out.append([names[lang][code >> WORD_BITS * k & (1 << WORD_BITS) - 1] for k in reversed(range(size))])
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.string()), batch.column(1), pa.array(out, pa.list_(pa.string())), batch.column(3)], schema=schema)

    return summed.mapInArrow(run, "lang string, code long, words array<string>, a long")


def _score(a: str, left: str, right: str) -> str:
    """SQL text of floor(1000000 * a * a / (l * r)) in whole numbers of up to 38 digits."""
    def wide(name):
        return f"CAST({name} AS DECIMAL(15, 0))"
    return f"CAST(({wide(a)} * {wide(a)} * CAST(1000000 AS DECIMAL(7, 0))) DIV ({wide(left)} * {wide(right)}) AS BIGINT)"


def collocations(docs: DataFrame, least: int = LEAST, kept: int = KEPT, lang_col: str = "lang", text_col: str = "text",
                 most_words: int = MOST_WORDS, most_pairs: int = MOST_PAIRS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of the best phrases of each language."""
    words = stored(word_counts(docs, lang_col, text_col), "collocation-words")
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    often = words.filter(F.col("f") >= least)
    numbers = Numbers(often, most_words)
    twos = stored(frequent(phrase_counts(docs, 2, numbers, None, lang_col, text_col), 2, numbers, least), "collocation-pairs")
    pairs = Pairs(twos, most_pairs)
    threes = stored(frequent(phrase_counts(docs, 3, numbers, pairs, lang_col, text_col), 3, numbers, least), "collocation-triples")

    one = often.select("lang", F.col("word").alias("w"), "f")
    two = twos.select("lang", F.col("words")[0].alias("w1"), F.col("words")[1].alias("w2"), "a")
    three = threes.select("lang", *[F.col("words")[k].alias(f"w{k + 1}") for k in range(3)], "a")

    def with_word(rows, place, name):
        return rows.join(one.select("lang", F.col("w").alias(place), F.col("f").alias(name)), ["lang", place])

    def with_pair(rows, first, second, name):
        return rows.join(two.select("lang", F.col("w1").alias(first), F.col("w2").alias(second), F.col("a").alias(name)), ["lang", first, second])

    # The longest of a pair's candidates around it.
    around = three.select("lang", "w1", "w2", "a").unionByName(three.select("lang", F.col("w2").alias("w1"), F.col("w3").alias("w2"), "a"))
    around = around.groupBy("lang", "w1", "w2").agg(F.max("a").alias("longer"))
    short = with_word(with_word(two.join(around, ["lang", "w1", "w2"], "left"), "w1", "l"), "w2", "r")
    short = short.filter(F.coalesce(100 * F.col("longer") < 50 * F.col("a"), F.lit(True))).select(
        "lang", F.concat_ws(" ", "w1", "w2").alias("phrase"), "a", "l", "r", F.expr(_score("a", "l", "r")).alias("score"))

    long = with_word(with_pair(three, "w2", "w3", "r1"), "w1", "l1")
    long = with_word(with_pair(long, "w1", "w2", "l2"), "w3", "r2")
    long = long.withColumns({"s1": F.expr(_score("a", "l1", "r1")), "s2": F.expr(_score("a", "l2", "r2"))})
    early = F.col("s1") <= F.col("s2")
    long = long.select("lang", F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"), "a", *[
        F.when(early, F.col(f"{c}1")).otherwise(F.col(f"{c}2")).alias(name) for c, name in (("l", "l"), ("r", "r"), ("s", "score"))])

    # Ranked in parts of each language first, so that its last task sees ``kept`` rows of each part at most.
    order = [F.desc("score"), F.desc("a"), "phrase"]
    both = short.unionByName(long).withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(RANKED_PARTS)))
    first = both.withColumn("rank", F.row_number().over(W.partitionBy("lang", "part").orderBy(*order))).filter(F.col("rank") <= kept)
    last = first.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("long"))
    return last.filter(F.col("rank") <= kept).join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
