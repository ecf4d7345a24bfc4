"""Secret scans: three fixed patterns, and a ratio of two character Markov models.

One model describes random strings, the other ordinary identifiers. Both are counted from labelled
samples in all documents: the values that the patterns find are random strings; runs of token
characters outside of them whose parts are words or numbers are ordinary identifiers; other runs
teach nothing. The random model is mixed with an even one. A run is a secret of the method when the log-likelihood ratio of
its characters, summed and per character, reaches the two thresholds. Only the table of character
pairs goes through the driver; it has as many cells for any input.

Positions count code points, the end exclusive. A null or empty text has no spans. Without any
labelled sample both models are even, so the method adds nothing. Texts of any length are read
whole, rows that repeat are scanned each for itself, and only the two named columns are read.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanfold.llm.bpe import in_small_batches
from scanfold.llm.common import text_of

#: The patterns and the least lengths of what they find.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_LEAST, ACCESS_LEAST = 6, 20
KINDS = ("assign", "access", "hex", "random")

#: Runs of token characters that the method looks at, and those that the models learn from.
RUN = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
SAMPLE = re.compile(r"[A-Za-z0-9+/_=-]{8,}")
#: Lower-case, capital or camel-case words and numbers between separators.
PART = re.compile(r"(?:[A-Z]?[a-z]{2,}+)++[0-9]{0,4}|[A-Z]+[0-9]{0,4}|[0-9]+|[a-z]|")
SEPARATORS = re.compile(r"[+/_=-]+")
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-."
CELLS = len(ALPHABET) + 1  # and the start of a string
CODE = np.full(128, CELLS - 1, np.int64)
CODE[[ord(c) for c in ALPHABET]] = np.arange(len(ALPHABET))


def base_spans(text: str) -> list[tuple[int, int, int, int]]:
    """(start, kind, end, start of the value) of what the patterns find, in order."""
    found = []
    # The word that begins an assignment is looked for only where one of its signs follows.
    if ":" in text or "=" in text:
        found += [(m.start(), 0, m.end(), m.start(2)) for m in ASSIGN.finditer(text) if m.end() - m.start(2) >= ASSIGN_LEAST]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end(), m.start()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    found += [(m.start(), 2, m.end(), m.start()) for m in HEX.finditer(text)]
    return sorted(found)


def is_ordinary(run: str) -> bool:
    """Whether all parts of a run of token characters are words or numbers."""
    return all(map(PART.fullmatch, SEPARATORS.split(run)))


def pairs(strings: list[str]) -> np.ndarray:
    """Counts of adjacent characters, the start of a string included."""
    counts = np.zeros(CELLS * CELLS, np.int64)
    if strings:
        codes = CODE[np.frombuffer(("\0" + "\0".join(strings)).encode("ascii"), np.uint8)]
        second = codes[1:]
        cells = (codes[:-1] * CELLS + second)[second != CELLS - 1]
        counts += np.bincount(cells, minlength=CELLS * CELLS)
    return counts


def outside(spans: list, found: list[re.Match]) -> list[re.Match]:
    """The matches that no span touches; both in order."""
    kept, at, ends = [], 0, 0
    for m in found:
        while at < len(spans) and spans[at][0] < m.end():
            ends, at = max(ends, spans[at][2]), at + 1
        if ends <= m.start():
            kept.append(m)
    return kept


def train(docs: DataFrame, text_col: str = "text", smoothing: float = 0.5, backing: float = 20.0) -> np.ndarray:
    """Log-likelihood ratio of each character after another, random over ordinary. Each pair's
    chance leans on that of its second character alone, by as much as ``backing`` samples."""

    def run(batches):
        counts = np.zeros((2, CELLS * CELLS), np.int64)
        for batch in in_small_batches(batches, 0):
            secret, ordinary = [], []
            for text in batch.column(0).to_pylist():
                spans = base_spans(text)
                secret += [text[value:end] for _, _, end, value in spans]
                found = SAMPLE.finditer(text) if spans else SAMPLE.findall(text)
                ordinary += filter(is_ordinary, [m[0] for m in outside(spans, found)] if spans else found)
            counts += pairs(secret), pairs(ordinary)
        kind, cell = np.nonzero(counts)
        yield pa.RecordBatch.from_pydict({"kind": kind, "cell": cell, "n": counts[kind, cell]})

    told = (docs.select(text_of(text_col).alias("text")).mapInArrow(run, "kind long, cell long, n long")
            .groupBy("kind", "cell").agg(F.sum("n").alias("n")).collect())
    counts = np.zeros((2, CELLS, CELLS))
    for kind, cell, n in told:
        counts[kind, cell // CELLS, cell % CELLS] += n
    alone = counts.sum(axis=1, keepdims=True) + smoothing
    chance = (counts + backing * alone / alone.sum(axis=2, keepdims=True)) / (counts.sum(axis=2, keepdims=True) + backing)
    # Half of the random model is even over the alphabet: samples of one form, as hex, don't rule out others.
    return np.log((chance[0] + 1 / CELLS) / 2) - np.log(chance[1])


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ratio: np.ndarray | None = None,
                 least_ratio: float = 12.0, least_per_char: float = 0.5) -> DataFrame:
    """One row per input row: the id and ``spans``, an array of (start, end, kind) by start and kind.

    ``ratio``: a trained table; by default it is trained from these documents. Spans of the method
    never touch those of the patterns.
    """
    table = train(docs, text_col) if ratio is None else ratio
    schema = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text")).schema
    kind_of_id = schema["id"].dataType

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_type

        for batch in in_small_batches(batches, 1):
            starts, ends, kinds, sizes = [], [], [], [0]
            for text in batch.column(1).to_pylist():
                spans = [x[:3] for x in base_spans(text)]
                runs = outside(spans, list(RUN.finditer(text)))
                if runs:
                    codes = CODE[np.frombuffer(("\0" + "\0".join(m[0] for m in runs)).encode("ascii"), np.uint8)]
                    worth = np.where(codes[1:] == CELLS - 1, 0.0, table[codes[:-1], codes[1:]])
                    first = np.cumsum([0] + [len(m[0]) + 1 for m in runs[:-1]])
                    sums = np.add.reduceat(worth, first)
                    for m, x in zip(runs, sums):
                        if x >= least_ratio and x >= least_per_char * len(m[0]):
                            spans.append((m.start(), 3, m.end()))
                    spans.sort()
                starts += [x[0] for x in spans]
                kinds += [KINDS[x[1]] for x in spans]
                ends += [x[2] for x in spans]
                sizes.append(len(starts))
            item = pa.StructArray.from_arrays([pa.array(starts, pa.int64()), pa.array(ends, pa.int64()), pa.array(kinds, pa.string())], ["start", "end", "kind"])
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(to_arrow_type(kind_of_id)), pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), item)], ["id", "spans"])

    found = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text")).mapInArrow(
        run, f"id {kind_of_id.simpleString()}, spans array<struct<start: long, end: long, kind: string>>")
    return found.withColumnRenamed("id", id_col)


def secret_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_assign, n_access, n_hex, base_sha256, spans, n_random."""
    found = find_secrets(docs, id_col, text_col)

    def count(kind: str):
        return F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long")

    def told(spans):
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")

    return found.select(
        id_col, count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        F.sha2(told(F.filter("spans", lambda x: x["kind"] != "random")), 256).alias("base_sha256"),
        told(F.col("spans")).alias("spans"), count("random").alias("n_random"))
