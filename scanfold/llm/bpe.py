"""Byte-level BPE encoding and decoding with a contiguous rank array.

A word is an array of parts, with the merge rank of each adjacent pair in a second array. The
smallest rank is looked up, its boundary deleted from both arrays, and the ranks on either side
refreshed, until no pair has a rank. Words of about the same length are worked on together as
rows of one matrix, which is the same procedure for each row. Words too long for a scan per merge
take a heap over the same ranks.

A null or empty text has no ids. Texts of any length are encoded whole. Strings of special tokens
in a text become their ids, as the vocabulary file says. The columns of the input stay; the result
column must not be one of them. Empty tables give empty results.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterable
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: the pattern that splits text before the merges of byte-level vocabularies.
WORD_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
NO_RANK = np.int32(2**31 - 1)
#: Words of more bytes take the heap.
SCAN_BYTES = 256
#: Entries that a cache holds at most; it is emptied beyond them.
CACHE_WORDS = 150_000
#: Bytes of text that are encoded at once; their words take many times that.
ENCODED_BYTES = 1 << 20
#: Words whose matrices are worked on at once.
ROWS = 8192


def default_vocabulary() -> str:
    """The file of the public byte-level vocabulary that is installed."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_letters() -> list[str]:
    """The letter that stands for each byte in vocabulary files: printable ones for themselves,
    the others as letters from 256 on, in order."""
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("\xa1"), ord("\xac") + 1), *range(ord("\xae"), ord("\xff") + 1)]
    hidden = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(256 + hidden.index(b)) for b in range(256)]


class RankArrayBpe:
    """A vocabulary file's merges, ready to encode words and decode ids."""

    def __init__(self, path: str | None = None):
        with open(path or default_vocabulary(), encoding="utf-8") as file:
            stated = json.load(file)
        model, letters = stated["model"], byte_letters()
        if model["type"] != "BPE" or stated["pre_tokenizer"]["type"] != "ByteLevel":
            raise ValueError("not a byte-level BPE vocabulary")
        vocabulary, own = model["vocab"], {c: b for b, c in enumerate(letters)}
        self.specials = {t["content"]: t["id"] for t in stated.get("added_tokens") or []}
        self.of_byte = np.array([vocabulary[c] for c in letters], np.int64)
        size = max([*vocabulary.values(), *self.specials.values()]) + 1
        self.size = size
        self.pieces = [b""] * size
        for token, i in vocabulary.items():
            self.pieces[i] = bytes(own[c] for c in token)
        for token, i in self.specials.items():
            self.pieces[i] = token.encode()
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left = np.array([vocabulary[a] for a, _ in merges], np.int64)
        right = np.array([vocabulary[b] for _, b in merges], np.int64)
        made = np.array([vocabulary[a + b] for a, b in merges], np.int64)
        order = np.argsort(left * size + right, kind="stable")
        self.pairs = (left * size + right)[order]
        self.rank_of_pair = order.astype(np.int32)
        self.made = made
        self.rank = {(int(a), int(b)): r for r, (a, b) in enumerate(zip(left, right))}

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The merge rank of each pair; pairs with a negative id on either side have none."""
        wanted = left * self.size + right
        at = np.searchsorted(self.pairs, wanted)
        at[at == len(self.pairs)] = 0
        return np.where((self.pairs[at] == wanted) & (left >= 0) & (right >= 0), self.rank_of_pair[at], NO_RANK)

    def encode_words(self, words: list[bytes]) -> list[np.ndarray]:
        """The ids of each word."""
        found: list = [None] * len(words)
        order = sorted(range(len(words)), key=lambda i: len(words[i]))
        start = 0
        while start < len(order):
            longest, stop = 2 * max(4, len(words[order[start]])), start + 1
            while stop < len(order) and stop - start < ROWS and len(words[order[stop]]) <= longest:
                stop += 1
            own = order[start:stop]
            if len(words[own[-1]]) > SCAN_BYTES:
                for i in own:
                    found[i] = self.encode_long(words[i])
            else:
                for i, ids in zip(own, self._scan([words[i] for i in own])):
                    found[i] = ids
            start = stop
        return found

    def _scan(self, words: list[bytes]) -> list[np.ndarray]:
        width = max(2, max(map(len, words)))
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        parts = np.full((len(words), width), -1, np.int64)
        parts[np.arange(width) < lengths[:, None]] = self.of_byte[np.frombuffer(b"".join(words), np.uint8)]
        ranks = self.ranks(parts[:, :-1], parts[:, 1:])
        done: list = [None] * len(words)
        rows = np.arange(len(words))
        while len(rows):
            place = ranks.argmin(axis=1)
            lowest = ranks[np.arange(len(rows)), place]
            for k in np.flatnonzero(lowest == NO_RANK):
                done[rows[k]] = parts[k, :lengths[rows[k]]].astype("<u4")
            alive = lowest != NO_RANK
            rows, parts, ranks, place, lowest = rows[alive], parts[alive], ranks[alive], place[alive], lowest[alive]
            if not len(rows):
                break
            # Delete the boundary after ``place``: what lies behind moves up by one.
            each, at = np.arange(len(rows)), np.arange(parts.shape[1])
            parts[each, place] = self.made[lowest]
            moved = np.minimum(at + (at > place[:, None]), parts.shape[1] - 1)
            parts = np.take_along_axis(parts, moved, axis=1)
            parts[:, -1] = -1
            ranks = np.take_along_axis(ranks, np.minimum(moved[:, :-1], ranks.shape[1] - 1), axis=1)
            ranks[:, -1] = NO_RANK
            lengths[rows] -= 1
            # Refresh the ranks on either side of the new part.
            inner = place < ranks.shape[1]
            ranks[each[inner], place[inner]] = self.ranks(parts[each[inner], place[inner]], parts[each[inner], place[inner] + 1])
            inner = place > 0
            ranks[each[inner], place[inner] - 1] = self.ranks(parts[each[inner], place[inner] - 1], parts[each[inner], place[inner]])
        return done

    def encode_long(self, word: bytes) -> np.ndarray:
        """The same merges in the same order, with a heap of (rank, place) and linked neighbours."""
        parts = self.of_byte[np.frombuffer(word, np.uint8)].tolist()
        after, before = [*range(1, len(parts)), -1], [-1, *range(len(parts) - 1)]
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(len(parts) - 1)
                if (r := self.rank.get((parts[i], parts[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i]
            if parts[i] != a or j < 0 or parts[j] != b:
                continue
            parts[i], parts[j] = int(self.made[rank]), -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for left, right in ((before[i], i), (i, after[i])):
                if left >= 0 and right >= 0 and (r := self.rank.get((parts[left], parts[right]))) is not None:
                    heapq.heappush(heap, (r, left, parts[left], parts[right]))
        return np.array([p for p in parts if p >= 0], "<u4")

    def decode(self, ids: bytes) -> str:
        """The text of little-endian 32-bit ids; bytes that aren't UTF-8 become replacement signs."""
        pieces = self.pieces
        return b"".join([pieces[i] for i in np.frombuffer(ids, "<u4").tolist()]).decode("utf-8", "replace")


class ChunkCache:
    """Ids of texts, put together from those of chunks that begin at a single space.

    A space between two other characters that aren't white space always begins a word of
    ``WORD_PATTERN``, so the ids of a text are those of its chunks one after the other.
    ``encode_chunks`` gives the ids, as bytes, of strings that no chunk boundary divides.
    """

    DOUBLED = re.compile(r"\s\s")
    BETWEEN = re.compile(r"(?<=\S) (?=\S)")

    def __init__(self, encode_chunks, most: int = CACHE_WORDS):
        self.encode_chunks, self.most, self.known = encode_chunks, most, {}

    def split(self, text: str) -> list[str]:
        """The text's chunks; all but the first without the space that they begin with."""
        return self.BETWEEN.split(text) if self.DOUBLED.search(text) else text.split(" ")

    def encode(self, texts: Iterable[str]) -> list[bytes]:
        split = [self.split(x) for x in texts]
        if len(self.known) > self.most:
            self.known.clear()
        later = {w for x in split for w in x[1:]} - self.known.keys()
        if later:
            later = list(later)
            self.known.update(zip(later, self.encode_chunks([" " + w for w in later])))
        first = self.encode_chunks([x[0] for x in split])
        known = self.known.__getitem__
        return [a + b"".join(map(known, x[1:])) for a, x in zip(first, split)]


class TextEncoder:
    """Ids of whole texts as bytes. ``encode_words`` gives the ids, as bytes, of words that
    ``WORD_PATTERN`` found; ``specials`` are the ids of special strings."""

    def __init__(self, encode_words, specials: dict[str, int]):
        self.encode_words, self.specials, self.words = encode_words, specials, {}
        self.special_split = re.compile("|".join(map(re.escape, sorted(specials, key=len, reverse=True)))) if specials else None
        self.find = regex.compile(WORD_PATTERN).findall
        self.cache = ChunkCache(self._chunks)

    def _chunks(self, chunks: list[str]) -> list[bytes]:
        split = [self.find(x) for x in chunks]
        if len(self.words) > CACHE_WORDS:
            self.words.clear()
        new = list(set(chain.from_iterable(split)) - self.words.keys())
        self.words.update(zip(new, self.encode_words(new)))
        known = self.words.__getitem__
        return [b"".join(map(known, x)) for x in split]

    def encode(self, texts: list[str]) -> list[bytes]:
        parts: list[tuple[int, str]] = []
        own: list[list] = []
        for text in texts:
            pieces, at = [], 0
            for m in self.special_split.finditer(text) if self.special_split else ():
                pieces += [text[at:m.start()], self.specials[m[0]]]
                at = m.end()
            own.append([*pieces, text[at:]])
            parts += [x for x in own[-1] if isinstance(x, str)]
        ids = iter(self.cache.encode(parts))
        return [b"".join(next(ids) if isinstance(x, str) else x.to_bytes(4, "little") for x in pieces) for pieces in own]


@lru_cache(maxsize=2)
def rank_array_bpe(vocabulary: str | None) -> RankArrayBpe:
    """Loaded once per worker process, which later tasks use again."""
    return RankArrayBpe(vocabulary)


def text_encoder(vocabulary: str | None) -> TextEncoder:
    """An encoder with caches of its own. A task makes one, so that a worker process that goes on to
    other work holds none of its words."""
    bpe = rank_array_bpe(vocabulary)
    return TextEncoder(lambda words: [x.tobytes() for x in bpe.encode_words([w.encode() for w in words])], bpe.specials)


def in_small_batches(batches: Iterable[pa.RecordBatch], column: int, most_bytes: int = 4 << 20) -> Iterable[pa.RecordBatch]:
    """Cut batches so that each holds about so many bytes of a text column, and one row at least."""
    for batch in batches:
        size = max(1, batch.column(column).nbytes)
        rows = max(1, batch.num_rows * most_bytes // size)
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def encode(docs: DataFrame, text_col: str = "text", out_col: str = "ids", vocabulary: str | None = None) -> DataFrame:
    """``docs`` with the token ids of each text, as little-endian unsigned 32-bit integers in a
    binary column. ``vocabulary``: a byte-level vocabulary file that every worker has."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import BinaryType, StructType

    if out_col in docs.columns:
        raise ValueError(f"{out_col} is a column already")
    schema = StructType([*docs.schema.fields]).add(out_col, BinaryType())
    arrow, at = to_arrow_schema(schema), docs.columns.index(text_col)

    def run(batches):
        encoder = text_encoder(vocabulary)
        for batch in in_small_batches(batches, at, ENCODED_BYTES):
            ids = encoder.encode([x or "" for x in batch.column(at).to_pylist()])
            yield pa.RecordBatch.from_arrays([*(c.cast(f.type) for c, f in zip(batch.columns, arrow)), pa.array(ids, arrow.field(len(arrow) - 1).type)], schema=arrow)

    return docs.mapInArrow(run, schema)


def decode(rows: DataFrame, ids_col: str = "ids", out_col: str = "decoded", vocabulary: str | None = None) -> DataFrame:
    """``rows`` with the text of each row's ids, special tokens included."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StringType, StructType

    if out_col in rows.columns:
        raise ValueError(f"{out_col} is a column already")
    schema = StructType([*rows.schema.fields]).add(out_col, StringType())
    arrow, at = to_arrow_schema(schema), rows.columns.index(ids_col)

    def run(batches):
        bpe = rank_array_bpe(vocabulary)
        for batch in in_small_batches(batches, at, ENCODED_BYTES):
            texts = [bpe.decode(x or b"") for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(c.cast(f.type) for c, f in zip(batch.columns, arrow)), pa.array(texts, arrow.field(len(arrow) - 1).type)], schema=arrow)

    return rows.mapInArrow(run, schema)


def round_trip_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, ids_sha256, decoded_sha256 of each row's text, encoded and decoded again."""
    coded = decode(encode(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))).drop("text"))
    return coded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
                        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
