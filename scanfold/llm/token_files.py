"""Token-id files: one id array per file, with Elias-Fano coded document boundaries.

A file holds many documents in ascending id order, each with an end id appended:

    magic, header | doc-id sequence | boundary sequence | ids, 2 or 4 bytes each

Both sequences never fall, so each is stored as an Elias-Fano code: the low bits of its values
packed, the high bits in unary, with a sample of the place of every 64th one-bit. ``select(i)``
gives the i-th value from the sample and a short scan of the bits behind it, so a reader finds any
document without a table of 64-bit offsets. Ids take 2 bytes when the vocabulary has at most 65,536
entries, which depends on the vocabulary only.

Documents with a null id come first, then ascending ids; equal ids are ordered by their texts. A
null or empty text has the end id alone. No document is split over two files; a file takes
documents until it holds ``ids_per_file`` ids, so one with more has a file of its own.
An empty table makes no file.
"""

from __future__ import annotations

import json
import os
import re
import struct
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scanfold.llm.bpe import TextEncoder, byte_letters, default_vocabulary, in_small_batches
from scanfold.llm.common import text_of
from scanfold.sources.workspace import new_path, stored

MAGIC = b"EFIDS001"
#: version of the layout, bytes per id, documents with a null id, documents, ids, bytes of the two sequences
HEADER = struct.Struct("<HHIQQQQ")
SAMPLE = 64
IDS_PER_FILE = 4_000_000
#: Documents that a reader takes at once.
READ_DOCUMENTS = 512
#: A space and a word without white space, as ``ChunkCache`` gives most of them.
WORD = re.compile(r" \S+\Z")


class EliasFano:
    """A sequence of whole numbers that never falls, in about 2 + log2(range / count) bits each."""

    HEAD = struct.Struct("<QQqB7x")

    def __init__(self, count: int, span: int, base: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.count, self.span, self.base, self.low_bits = count, span, base, low_bits
        self.low, self.high, self.samples = low, high, samples

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        base = int(values[0]) if len(values) else 0
        rest = values.astype(np.uint64) - np.uint64(base % 2**64)  # wraps, so that the whole range of ids fits
        span = int(rest[-1]) + 1 if len(values) else 1
        low_bits = max(0, (span // max(1, len(values))).bit_length() - 1)
        bits = (rest[:, None] >> np.arange(low_bits, dtype=np.uint64)) & np.uint64(1)
        ones = (rest >> np.uint64(low_bits)).astype(np.int64) + np.arange(len(values))
        high = np.zeros((int(ones[-1]) if len(values) else 0) + 1, np.uint8)
        high[ones] = 1
        return cls(len(values), span, base, low_bits, np.packbits(bits.astype(np.uint8).ravel(), bitorder="little"),
                   np.packbits(high, bitorder="little"), ones[::SAMPLE].astype("<u4"))

    def to_bytes(self) -> bytes:
        parts = [x.tobytes() for x in (self.low, self.high, self.samples)]
        return b"".join([self.HEAD.pack(self.count, min(self.span, 2**64 - 1), self.base, self.low_bits),
                         struct.pack("<3Q", *map(len, parts)), *parts])

    @classmethod
    def from_bytes(cls, data: bytes) -> EliasFano:
        count, span, base, low_bits = cls.HEAD.unpack_from(data)
        sizes, at = struct.unpack_from("<3Q", data, cls.HEAD.size), cls.HEAD.size + 24
        low = np.frombuffer(data, np.uint8, sizes[0], at)
        high = np.frombuffer(data, np.uint8, sizes[1], at + sizes[0])
        samples = np.frombuffer(data, "<u4", sizes[2] // 4, at + sizes[0] + sizes[1])
        return cls(count, span, base, low_bits, low, high, samples)

    def _low(self, i: int) -> int:
        first = i * self.low_bits
        cut = int.from_bytes(self.low[first // 8:(first + self.low_bits + 7) // 8].tobytes(), "little")
        return (cut >> first % 8) & ((1 << self.low_bits) - 1)

    def _place(self, i: int) -> int:
        """The place of the i-th one-bit: from the sample before it, then along the bits behind."""
        place, left = int(self.samples[i // SAMPLE]), i % SAMPLE
        while left:
            window = np.unpackbits(self.high[(place + 1) // 8:(place + 1) // 8 + 64], bitorder="little")[(place + 1) % 8:]
            ones = np.flatnonzero(window)
            if len(ones) >= left:
                place += 1 + int(ones[left - 1])
                left = 0
            else:
                left -= len(ones)
                place += len(window)
        return place

    def select(self, i: int) -> int:
        """The i-th value."""
        if not 0 <= i < self.count:
            raise IndexError(i)
        return self.base + ((self._place(i) - i << self.low_bits) | self._low(i))

    def values(self, start: int = 0, stop: int | None = None) -> np.ndarray:
        """The values from start to stop, as 64-bit numbers: both ends are selected, and only the bits between are read."""
        stop = self.count if stop is None else min(stop, self.count)
        if start >= stop:
            return np.zeros(0, np.int64)
        first, last, count = self._place(start), self._place(stop - 1), stop - start
        skip = first - first % 8
        ones = np.flatnonzero(np.unpackbits(self.high[skip // 8:last // 8 + 1], bitorder="little")[first - skip:last + 1 - skip]) + first
        high = (ones - np.arange(start, stop)).astype(np.uint64) << np.uint64(self.low_bits)
        at = start * self.low_bits
        bits = np.unpackbits(self.low[at // 8:(stop * self.low_bits + 7) // 8], bitorder="little")[at % 8:at % 8 + count * self.low_bits]
        low = (bits.reshape(count, self.low_bits).astype(np.uint64) << np.arange(self.low_bits, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
        return ((high | low) + np.uint64(self.base % 2**64)).astype(np.int64)


def pack_file(doc_ids: list, lengths: list[int], ids: np.ndarray, id_bytes: int) -> bytes:
    """One file's bytes. doc_ids: ascending, nulls first; lengths: ids of each document."""
    nulls = sum(x is None for x in doc_ids)
    names = EliasFano.of(np.array(doc_ids[nulls:], np.int64)).to_bytes()
    ends = EliasFano.of(np.cumsum(lengths, dtype=np.int64)).to_bytes()
    return b"".join([MAGIC, HEADER.pack(1, id_bytes, nulls, len(doc_ids), len(ids), len(names), len(ends)),
                     names, ends, ids.astype(f"<u{id_bytes}").tobytes()])


class TokenFile:
    """A file's documents, read from its bytes."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC:
            raise ValueError("not a token-id file")
        _, self.id_bytes, self.nulls, self.documents, self.total, names, ends = HEADER.unpack_from(data, 8)
        at = 8 + HEADER.size
        self.names = EliasFano.from_bytes(data[at:at + names])
        self.ends = EliasFano.from_bytes(data[at + names:at + names + ends])
        self.ids = np.frombuffer(data, f"<u{self.id_bytes}", self.total, at + names + ends)

    def name(self, i: int) -> int | None:
        return None if i < self.nulls else self.names.select(i - self.nulls)

    def document(self, i: int) -> np.ndarray:
        """The ids of the i-th document, found by two selects."""
        return self.ids[self.ends.select(i - 1) if i else 0:self.ends.select(i)]


class ChunkEncoder(TextEncoder):
    """Gives whole chunks to the library, which finds the words in them itself."""

    def _chunks(self, chunks: list[str]) -> list[bytes]:
        return self.encode_words(chunks)


@lru_cache(maxsize=2)
def library_encoder(vocabulary: str):
    """A function from texts to ids as bytes, by the tokenizers library, and the vocabulary's size.

    The library works on each different word once per cache of a worker process: its byte-level
    vocabularies split a text at special tokens, then by ``WORD_PATTERN``, and merge within words
    only. New words go to the library in one text, since each begins with the only space that it
    has: the ids whose pieces begin with a space are where the words begin. With a vocabulary of
    another build, whole texts go to the library.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(vocabulary)
    tokenizer.no_truncation()
    tokenizer.no_padding()

    def encode(texts: list[str]) -> list[bytes]:
        return [np.array(x.ids, "<u4").tobytes() for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    with open(vocabulary, encoding="utf-8") as file:
        stated = json.load(file)
    first, added = stated["pre_tokenizer"] or {}, stated["added_tokens"] or []
    by_word = stated["normalizer"] is None and stated["post_processor"] is None and first.get("type") == "ByteLevel" \
        and first.get("use_regex", True) and not first["add_prefix_space"] \
        and not any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in added)
    size = tokenizer.get_vocab_size()
    if not by_word:
        return encode, size
    space = byte_letters()[ord(" ")]
    begins = np.zeros(size, bool)
    begins[[i for piece, i in tokenizer.get_vocab(False).items() if i < size and piece.startswith(space)]] = True

    def encode_words(words: list[str]) -> list[bytes]:
        found: list = [None] * len(words)
        joined = [i for i, w in enumerate(words) if WORD.match(w)]
        for start in range(0, len(joined), 4096):
            own = joined[start:start + 4096]
            ids = np.array(tokenizer.encode_batch_fast(["".join([words[i] for i in own])], add_special_tokens=False)[0].ids, "<u4")
            cuts = np.flatnonzero(begins[ids]).tolist()
            if len(cuts) == len(own):
                raw = ids.tobytes()
                for i, a, b in zip(own, cuts, [*cuts[1:], len(ids)]):
                    found[i] = raw[4 * a:4 * b]
        left = [i for i, x in enumerate(found) if x is None]
        for i, x in zip(left, encode([words[i] for i in left])):
            found[i] = x
        return found

    return ChunkEncoder(encode_words, {t["content"]: t["id"] for t in added}).encode, size


def write_token_files(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text",
                      vocabulary: str | None = None, end_id: int = 0, ids_per_file: int = IDS_PER_FILE) -> DataFrame:
    """Encode and write all documents in ascending id order; returns the list of files.

    Rows: part, seq (the order of files), file, documents, ids. Texts are dealt by ranges of the id
    and sorted within them; a task holds one file's ids at most. A file is written under a name of
    its attempt and then renamed, so a task that is run again leaves whole files only.
    """
    vocabulary = vocabulary or default_vocabulary()
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    rows = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")

    def run(batches):
        from pyarrow import fs

        files, base = fs.FileSystem.from_uri(folder)
        task = TaskContext.get()
        part, attempt = task.partitionId(), task.taskAttemptId()
        encode, size = library_encoder(vocabulary)
        id_bytes = 2 if max(size, end_id + 1) <= 1 << 16 else 4
        end = end_id.to_bytes(4, "little")
        names: list = []
        own: list[bytes] = []
        held, seq = 0, 0

        def flush() -> pa.RecordBatch:
            nonlocal names, own, held, seq
            name = f"part-{part:06d}-{seq:06d}.efids"
            data = pack_file(names, [len(x) // 4 for x in own], np.frombuffer(b"".join(own), "<u4"), id_bytes)
            with files.open_output_stream(f"{base}/.{name}.{attempt}") as out:
                out.write(data)
            files.move(f"{base}/.{name}.{attempt}", f"{base}/{name}")
            told = pa.RecordBatch.from_pydict({"part": [part], "seq": [seq], "file": [name], "documents": [len(names)], "ids": [held]}, schema=listed)
            names, own, held, seq = [], [], 0, seq + 1
            return told

        listed = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("file", pa.string()), ("documents", pa.int64()), ("ids", pa.int64())])
        files.create_dir(base, recursive=True)
        for batch in in_small_batches(batches, 1):
            for name, ids in zip(batch.column(0).to_pylist(), encode(batch.column(1).to_pylist())):
                if own and held + len(ids) // 4 + 1 > ids_per_file:
                    yield flush()
                names.append(name)
                own.append(ids + end)
                held += len(ids) // 4 + 1
        if own:
            yield flush()

    return stored(rows.mapInArrow(run, "part int, seq int, file string, documents long, ids long"), "token-files")


def file_starts(files: DataFrame) -> DataFrame:
    """file, base: the ids in all files before each file of the list.

    Totals are summed per part first, and only one row per part meets in one task.
    """
    totals = files.groupBy("part").agg(F.sum("ids").alias("ids"))
    before = W.rowsBetween(W.unboundedPreceding, -1)
    totals = totals.select("part", F.coalesce(F.sum("ids").over(before.orderBy("part")), F.lit(0)).alias("earlier"))
    return files.join(totals, "part").select(
        "file", (F.col("earlier") + F.coalesce(F.sum("ids").over(before.partitionBy("part").orderBy("seq")), F.lit(0))).alias("base"))


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """file, doc_id, local, ids of each document in the files: its ids as little-endian unsigned
    32-bit integers, and how many ids the file has before it."""
    found = (spark.read.format("binaryFile").option("pathGlobFilter", "*.efids").load(folder)
             .select(F.element_at(F.split("path", "/"), -1).alias("file"), "content"))

    def run(batches):
        schema = pa.schema([("file", pa.string()), ("doc_id", pa.int64()), ("local", pa.int64()), ("ids", pa.binary())])
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1)):
                file = TokenFile(content.as_py())
                for at in range(0, file.documents, READ_DOCUMENTS):
                    to = min(at + READ_DOCUMENTS, file.documents)
                    ends = file.ends.values(at, to)
                    starts = np.concatenate([[file.ends.select(at - 1) if at else 0], ends[:-1]]).astype(np.int64)
                    doc_ids = [None] * (min(to, file.nulls) - min(at, file.nulls)) + file.names.values(max(at - file.nulls, 0), max(to - file.nulls, 0)).tolist()
                    yield pa.RecordBatch.from_arrays([
                        pa.array([name.as_py()] * (to - at)), pa.array(doc_ids, pa.int64()), pa.array(starts),
                        pa.array([file.ids[i:j].astype("<u4").tobytes() for i, j in zip(starts.tolist(), ends.tolist())], pa.binary())], schema=schema)

    return found.mapInArrow(run, "file string, doc_id long, local long, ids binary")


def token_file_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write token-id files below the shared folder, read them back: doc_id, start, n_tokens, ids_crc32."""
    spark = docs.sparkSession
    folder = new_path(spark, "token-ids")
    files = write_token_files(docs, folder, id_col, text_col)
    if files.isEmpty():
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    read = read_token_files(spark, folder).select(
        "file", "doc_id", "local", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
    return read.join(file_starts(files), "file").select(
        "doc_id", (F.col("base") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")
