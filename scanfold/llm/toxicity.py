"""Toxic passages: maximum-scoring segments over token log-odds with Dirichlet priors.

A word is known by itself and by its beginnings of a few lengths, so that inflected forms of a stem
help each other. Each such token has the log-odds of being in toxic rather than clean labelled
documents. Both classes get a Dirichlet prior in proportion to how often all documents have the
token, and the log-odds are taken at the cautious end of their confidence interval, so rare tokens
say little. A word's weight is that of its most telling token, less the cost ``gap``. A linear scan finds every maximal-scoring segment of a document. Under
the clean distribution, segment scores follow an extreme-value law with the rate that solves
sum(p * exp(rate * weight)) = 1 and a constant counted from the clean labelled documents; it turns
a segment's score into an extreme-value score, corrected for the document's length, and a p-value.
A document's evidence is the sum of the extreme-value scores of its significant segments, so what
clean text holds by chance doesn't add up. A logistic curve fitted on labelled documents turns
evidence and its best segment into the document's score; its coefficients are zero or above, so more
toxic text never lowers a score, and clean text only by the correction, the logarithm of the length.

Tokens are hashed to ``BUCKETS`` cells, so the model has one size for any input. Counts for the
prior come from all documents; the fit takes at most ``most_labelled`` labelled rows, those with
the smallest hash of their id. Rows whose label or id is null, or whose id has several labels that
differ, teach nothing. A null or empty text has no segment and gets the score of no evidence.
Without labelled rows of both classes every score is 0. Texts are read whole.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanfold.llm.bpe import ENCODED_BYTES, in_small_batches
from scanfold.llm.common import text_of
from scanfold.sources.workspace import stored

BUCKETS = 1 << 19
#: Lengths of the beginnings that stand for a word beside the word itself.
BEGINNINGS = (3, 4, 5, 6, 7)
WORD = re.compile(r"[^\W\d_]+")
#: What the characters of an ASCII text become so that splitting at spaces gives its words.
ASCII_WORDS = {i: chr(i).lower() if chr(i).isalpha() else " " for i in range(128)}
#: Words that a task knows at most; they are forgotten beyond.
KNOWN_WORDS = 150_000
#: The table of the CRC-32 that ``zlib`` counts.
CRC = np.array([zlib.crc32(bytes([i ^ 0xFF])) ^ 0xFF000000 for i in range(256)], np.uint32)
#: Labelled rows that the fit takes at most.
MOST_LABELLED = 200_000
#: Extreme-value score of a p-value of 0.05.
SIGNIFICANT = float(-np.log(-np.log(0.95)))


@dataclass
class ToxicityModel:
    """Everything that scoring needs; its size doesn't depend on the input."""

    weights: np.ndarray  # of each bucket
    gap: float
    rate: float  # of the extreme-value law
    constant: float
    curve: np.ndarray  # logistic: bias, evidence, root of evidence, best significant segment's extreme-value score
    trained: bool = True


def tokens_of(word: str) -> list[int]:
    """The buckets of a word and of its beginnings."""
    return [zlib.crc32(("=" + word).encode()) % BUCKETS, *(zlib.crc32(word[:k].encode()) % BUCKETS for k in BEGINNINGS if k <= len(word))]


def words_of(text: str) -> list[str]:
    """The words of a text in lower case."""
    return text.translate(ASCII_WORDS).split() if text.isascii() else WORD.findall(text.lower())


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Whether ``WORD`` takes a character, by code point."""
    return np.fromiter((c.isalnum() and not c.isdecimal() for c in map(chr, range(0x110000))), bool, 0x110000)


def places_of(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the matches of ``WORD``, as code points."""
    own = _letters()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")]
    edges = np.flatnonzero(np.diff(own, prepend=False, append=False))
    return edges[::2], edges[1::2]


#: The place in ``tokens_of`` of a beginning of so many characters, 0 for none.
PLACES = np.array([BEGINNINGS.index(k) + 1 if k in BEGINNINGS else 0 for k in range(max(BEGINNINGS) + 2)])


def buckets_of(words: list[str]) -> np.ndarray:
    """``tokens_of`` of each word as a row, -1 where a word has no beginning of that length."""
    found = np.full((len(words), 1 + len(BEGINNINGS)), -1, np.int64)
    data = [w.encode() for w in words]
    found[:, 0] = np.fromiter((zlib.crc32(b"=" + x) % BUCKETS for x in data), np.int64, len(data))
    plain = np.fromiter(map(bytes.isascii, data), bool, len(data))
    for own, width in ((np.flatnonzero(plain), max(BEGINNINGS)), (np.flatnonzero(~plain), 4 * max(BEGINNINGS))):
        if not len(own):
            continue
        # Beginnings grow byte by byte; one ends where the next byte begins a character.
        chars = np.array([data[i] for i in own.tolist()], f"S{width}").view(np.uint8).reshape(-1, width)
        begins = np.concatenate([chars & 0xC0 != 0x80, np.ones((len(own), 1), bool)], axis=1)
        count, state = np.zeros(len(own), np.int64), np.full(len(own), 0xFFFFFFFF, np.uint32)
        for at in range(width):
            state = CRC[(state ^ chars[:, at]) & 0xFF] ^ (state >> 8)
            count += begins[:, at]
            place = PLACES[np.minimum(count, len(PLACES) - 1)]
            ended = np.flatnonzero((place > 0) & begins[:, at + 1] & (chars[:, at] > 0))
            found[own[ended], place[ended]] = (state[ended] ^ 0xFFFFFFFF) % BUCKETS
    return found


class WordWeights:
    """Weights by word for one task, emptied when many."""

    def __init__(self, model: ToxicityModel):
        self.weights, self.gap, self.known = model.weights, model.gap, {}

    def of(self, texts: list[list[str]]) -> list[np.ndarray]:
        """The weights of the words of each text; words not known yet are worked on together."""
        if len(self.known) > KNOWN_WORDS:
            self.known.clear()
        new = list(set().union(*texts).difference(self.known))
        if new:
            rows = buckets_of(new)
            own = np.where(rows < 0, np.float32(0), self.weights[rows])
            best = own[np.arange(len(new)), np.abs(own).argmax(axis=1)].astype(np.float64) - self.gap
            self.known.update(zip(new, best.tolist()))
        known = self.known.__getitem__
        return [np.fromiter(map(known, x), np.float64, len(x)) for x in texts]


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """(start, end, score) of all maximal-scoring segments in linear time.

    Each new positive item opens a segment, which swallows earlier ones as long as joining raises
    the score of both; sums before and after each segment decide that.
    """
    total = np.concatenate([[0.0], np.cumsum(scores)])
    open_: list[list] = []  # start, end, sum before, sum after, place of the nearest with a smaller sum before
    for i in np.flatnonzero(scores > 0).tolist():
        start, end, left, right = i, i + 1, total[i], total[i + 1]
        j = len(open_) - 1
        while True:
            while j >= 0 and open_[j][2] >= left:
                j = open_[j][4]
            if j < 0 or open_[j][3] >= right:
                break
            start, left = open_[j][0], open_[j][2]
            del open_[j:]
            j = len(open_) - 1
        open_.append([start, end, left, right, j])
    return [(s, e, float(right - left)) for s, e, left, right, _ in open_]


def labelled_rows(labels: DataFrame, most_labelled: int) -> DataFrame:
    """id, toxic of the labelled rows to learn from: at most so many, for any input."""
    own = (labels.select(F.col("doc_id").alias("id"), F.col("toxic").cast("int").alias("toxic"))
           .filter("id is not null and toxic in (0, 1)").groupBy("id")
           .agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("most")).filter("toxic = most"))
    own = own.filter(F.crc32(F.col("id").cast("string")) % 5 != 0)
    return own.orderBy(F.xxhash64("id"), "id").limit(most_labelled).select("id", "toxic")


def _with_labels(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str) -> DataFrame:
    texts = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    return texts.join(F.broadcast(labels), "id", "left").select("text", "toxic")


def count_words(texts: DataFrame) -> np.ndarray:
    """How many words of a bucket documents have, each different word of a document once: all
    documents, clean ones, toxic ones."""

    def run(batches):
        counts, held = np.zeros((3, BUCKETS), np.int64), [Counter() for _ in range(3)]

        def hand_over():
            for k, words in enumerate(held):
                rows, times = buckets_of(list(words)), np.fromiter(words.values(), np.int64, len(words))
                own = rows >= 0
                counts[k] += np.bincount(rows[own], np.repeat(times, own.sum(axis=1)), BUCKETS).astype(np.int64)
                words.clear()

        for batch in in_small_batches(batches, 0, ENCODED_BYTES):
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = set(words_of(text))
                held[0].update(words)
                if label is not None:
                    held[1 + label].update(words)
            if len(held[0]) > KNOWN_WORDS:
                hand_over()
        hand_over()
        some = np.flatnonzero(counts[0])
        for part in np.array_split(some, max(1, len(some) // 65536)):
            yield pa.RecordBatch.from_pydict({"bucket": part, "n": counts[0][part], "clean": counts[1][part], "toxic": counts[2][part]})

    told = texts.mapInArrow(run, "bucket long, n long, clean long, toxic long").groupBy("bucket").agg(
        F.sum("n").alias("n"), F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).toPandas()
    counts = np.zeros((3, BUCKETS))
    for k, name in enumerate(("n", "clean", "toxic")):
        counts[k, told["bucket"].to_numpy(np.int64)] = told[name]
    return counts


def weigh(counts: np.ndarray, prior: float, caution: float, gap: float) -> tuple[np.ndarray, float]:
    """The weight of each bucket, and the rate of the extreme-value law under the clean distribution."""
    everything = counts[0] + 0.5
    alpha = prior * everything / everything.sum()
    clean, toxic = counts[1] + alpha, counts[2] + alpha
    odds = np.log(toxic / (toxic.sum() - toxic)) - np.log(clean / (clean.sum() - clean))
    spread = np.sqrt(1 / toxic + 1 / clean)
    weights = np.sign(odds) * np.maximum(0, np.abs(odds) - caution * spread)
    share = clean / clean.sum()
    low, high = 1e-6, 1.0
    while share @ np.exp(high * (weights - gap)) < 1 and high < 64:
        high *= 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if share @ np.exp(mid * (weights - gap)) < 1 else (low, mid)
    return weights, low


def _features(text: str, scores: np.ndarray, model: ToxicityModel, spans: bool):
    """Evidence, the best extreme-value score, and the segments as (start, end, score, p), from the
    weights of the text's words."""
    if not len(scores) or scores.max() <= 0:
        return 0.0, 0.0, []
    found = maximal_segments(scores)
    scaled = [model.rate * s for _, _, s in found]
    corrected = [x - np.log(model.constant * len(scores)) for x in scaled]
    telling = [c for c in corrected if c >= SIGNIFICANT]
    passages = []
    if spans:
        starts, ends = places_of(text) if len(text) == len(text.lower()) else ((), ())
        for (start, end, s), c in zip(found, corrected):
            where = (int(starts[start]), int(ends[end - 1])) if len(starts) == len(scores) else (None, None)
            passages.append({"start_word": start, "end_word": end, "start": where[0], "end": where[1], "score": s, "p": float(-np.expm1(-np.exp(-c)))})
    return float(sum(telling)), float(max(telling, default=0.0)), passages


def _design(evidence: np.ndarray, best: np.ndarray) -> np.ndarray:
    return np.stack([np.ones(len(evidence)), evidence, np.sqrt(evidence), best], axis=1)


def _fit_curve(design: np.ndarray, toxic: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Logistic regression whose coefficients, but for the bias, are zero or above: the best of the
    fits to each subset of the columns that keep to it, which is the constrained optimum."""
    best, least = np.zeros(design.shape[1]), np.inf
    for n in range(design.shape[1]):
        for some in combinations(range(1, design.shape[1]), n):
            chosen = [0, *some]
            curve = _fit_freely(design[:, chosen], toxic, ridge)
            odds = design[:, chosen] @ curve
            loss = np.logaddexp(0, odds).sum() - odds @ toxic + ridge / 2 * (curve[1:] @ curve[1:])
            if (curve[1:] >= 0).all() and loss < least:
                best, least = np.zeros(design.shape[1]), loss
                best[chosen] = curve
    return best


def _fit_freely(design: np.ndarray, toxic: np.ndarray, ridge: float) -> np.ndarray:
    """Logistic regression by Newton steps."""
    curve = np.zeros(design.shape[1])
    penalty = np.diag([0.0] + [ridge] * (design.shape[1] - 1)) + 1e-9 * np.eye(design.shape[1])
    for _ in range(50):
        chance = 1 / (1 + np.exp(-np.clip(design @ curve, -30, 30)))
        step = np.linalg.solve(design.T @ (design * (chance * (1 - chance))[:, None]) + penalty,
                               design.T @ (toxic - chance) - penalty @ curve)
        curve += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return curve


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_labelled: int = MOST_LABELLED,
          prior: float = 2000.0, caution: float = 1.96, gap: float = 0.05, level: float = 3.0) -> ToxicityModel:
    """Learn from ``labels`` (doc_id, toxic). prior: weight of the Dirichlet prior in words;
    caution: standard errors taken off; level: score from which clean segments are counted."""
    chosen = labelled_rows(labels, most_labelled)
    texts = _with_labels(docs, chosen, id_col, text_col)
    counts = count_words(texts)
    if not counts[1].any() or not counts[2].any():
        return ToxicityModel(np.zeros(BUCKETS), gap, 1.0, 1.0, np.zeros(4), False)
    weights, rate = weigh(counts, prior, caution, gap)
    model = ToxicityModel(weights.astype(np.float32), gap, rate, 1.0, np.zeros(4))

    def run(batches):
        known = WordWeights(model)
        for batch in in_small_batches(batches, 0, ENCODED_BYTES):
            scores = known.of([words_of(x) for x in batch.column(0).to_pylist()])
            words, segments = [len(x) for x in scores], [[s for _, _, s in maximal_segments(x)] for x in scores]
            yield pa.RecordBatch.from_pydict({"toxic": batch.column(1).cast(pa.int32()), "words": pa.array(words, pa.int64()), "segments": pa.array(segments, pa.list_(pa.float64()))})

    rows = stored(texts.filter("toxic is not null").mapInArrow(run, "toxic int, words long, segments array<double>"), "toxicity-segments")
    clean = rows.filter("toxic = 0").agg(F.sum("words").alias("words"), F.sum(F.size(F.filter("segments", lambda x: x >= level))).alias("over")).first()
    expected = max(1.0, float(clean["words"] or 0)) * np.exp(-rate * level)
    model.constant = float(max(1.0, clean["over"] or 0) / expected)
    correction = F.log(F.lit(model.constant) * F.greatest("words", F.lit(1)))
    telling = F.filter(F.transform("segments", lambda x: x * rate - correction), lambda x: x >= SIGNIFICANT)
    told = rows.select("toxic", telling.alias("c")).select(
        "toxic", F.aggregate("c", F.lit(0.0), lambda a, x: a + x).alias("evidence"), F.coalesce(F.array_max("c"), F.lit(0.0)).alias("best")).toPandas()
    model.curve = _fit_curve(_design(told["evidence"].to_numpy(float), told["best"].to_numpy(float)), told["toxic"].to_numpy(float))
    return model


def score_documents(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, score, predicted and the passages with their p-values.

    ``start`` and ``end`` of a passage are code points, null in the rare texts whose length changes
    in lower case.
    """
    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    kind = rows.schema["id"].dataType

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_type

        known = WordWeights(model)
        passage = pa.struct([("start_word", pa.int64()), ("end_word", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("p", pa.float64())])
        for batch in in_small_batches(batches, 1, ENCODED_BYTES):
            texts = batch.column(1).to_pylist()
            found = [_features(x, own, model, True) for x, own in zip(texts, known.of([words_of(x) for x in texts]))]
            if model.trained and found:
                design = _design(np.array([x[0] for x in found]), np.array([x[1] for x in found]))
                scores = 1 / (1 + np.exp(-np.clip(design @ model.curve, -30, 30)))
            else:
                scores = np.zeros(len(found))
            yield pa.RecordBatch.from_arrays([
                batch.column(0).cast(to_arrow_type(kind)), pa.array(scores, pa.float64()), pa.array((scores >= 0.5).astype(np.int32)),
                pa.array([x[2] for x in found], pa.list_(passage))], ["id", "score", "predicted", "passages"])

    return rows.mapInArrow(run, f"id {kind.simpleString()}, score double, predicted int, passages array<struct<start_word: long, "
                           "end_word: long, start: long, end: long, score: double, p: double>>").withColumnRenamed("id", id_col)


def score_digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, n_passages (those with p of 0.05 at most)."""
    found = score_documents(docs, train(docs, labels))
    return found.select(
        "doc_id", (F.crc32(F.col("doc_id").cast("string")) % 5 == 0).alias("held_out"), "score", "predicted",
        F.size(F.filter("passages", lambda x: x["p"] <= 0.05)).cast("long").alias("n_passages"))


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all their columns, whose text isn't predicted toxic.

    The rows are scored where they are, so nothing is shuffled and repeated rows stay repeated.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    model = train(docs, labels, id_col, text_col)
    schema, at = docs.schema, docs.columns.index(text_col)
    arrow = to_arrow_schema(schema)

    def run(batches):
        known = WordWeights(model)
        for batch in in_small_batches(batches, at, ENCODED_BYTES):
            texts = [x or "" for x in batch.column(at).to_pylist()]
            found = [_features(x, own, model, False) for x, own in zip(texts, known.of([words_of(x) for x in texts]))]
            if model.trained and found:
                odds = _design(np.array([x[0] for x in found]), np.array([x[1] for x in found])) @ model.curve
                batch = batch.filter(pa.array(odds < 0))
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(batch.columns, arrow)], schema=arrow)

    return docs.mapInArrow(run, schema)
