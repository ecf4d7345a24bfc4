"""WARC archives: a writer with revisit records and a reader that salvages damaged files.

Each record is a gzip member of its own. Its headers state the length and SHA-256 of its block and
the SHA-256 of its payload; the payload of a page is its html in UTF-8. Of equal payloads of at least
``REVISIT_BYTES`` bytes the smallest id is a response with the payload, the others are revisits that
name it and carry only headers.

The reader goes through a file record by record, whether members or plain records. One that fails a
check (gzip checksum, version line, headers, length, digest) ends nothing: the reader searches for
the next place where a member or a version line starts a record that passes all checks, goes on from
there, and reports the bytes between as a quarantined gap with the reason.

A null html is an empty payload, a null url is written as ``urn:page`` and the id. Of pages with a
null id none is the smallest while there is another; among themselves they are responses. Rows that
share the smallest id and the payload are all responses. An empty table makes no file. A file takes
records until it holds ``FILE_BYTES``; a record is never split, so a very long one makes a long file.
A task holds one record at a time. Only the named columns are read.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scanfold.llm.common import text_of
from scanfold.operators.shuffle import salted_join
from scanfold.sources.workspace import new_path, stored

REVISIT_BYTES = 100
FILE_BYTES = 64 << 20
WRITTEN_AT = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

MEMBER = b"\x1f\x8b\x08"
VERSION = re.compile(rb"WARC/1\.[01]\r\n")
#: Where a record may begin: a gzip member or a version line.
START = re.compile(rb"\x1f\x8b\x08|WARC/1\.[01]\r\n")
CHUNK = 1 << 20
MOST_HEADER_BYTES = 1 << 20

FOUND_SCHEMA = ("path string, start long, end long, reason string, record_type string, page_id long, target_uri string, "
                "refers_to long, payload_bytes long, payload_digest string, payload binary")


class Damaged(Exception):
    """A record that fails a check; the message says which."""


# --- writing ------------------------------------------------------------------

def record_kinds(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """id, url, html, refers_to of each page; refers_to is null for a response.

    Payloads meet by digest and length as narrow rows: copies shrink to one row per task, and the
    join back is salted, so a payload that a third of the pages share is spread out. Revisits then
    meet their pages by id.
    """
    whole = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), text_of(html_col).alias("html"))
    whole = whole.withColumn("digest", F.unhex(F.sha2("html", 256)))
    narrow = whole.filter(F.octet_length("html") >= REVISIT_BYTES).select("id", "digest")
    repeated = stored(narrow.groupBy("digest").agg(F.min("id").alias("keep"), F.count("*").alias("n")).filter("n > 1").drop("n"), "warc-repeated")
    revisits = salted_join(narrow, repeated, ["digest"], ["id"], "inner").filter(~F.col("id").eqNullSafe(F.col("keep")) & F.col("keep").isNotNull())
    # Rows without an id can't be told apart by it: all with one payload take the same answer.
    revisits = stored(revisits.groupBy("id", "digest").agg(F.first("keep").alias("refers_to")), "warc-revisits")
    at = whole["id"].eqNullSafe(revisits["id"]) & (whole["digest"] == revisits["digest"])
    return whole.join(revisits, at, "left").select(whole["id"], "url", "html", "refers_to")


def _clean(text: str) -> str:
    """A header value on one line: control characters and blanks at the ends as in urls."""
    text = re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", text)
    return re.sub(r"^ +| +$", lambda m: "%20" * len(m[0]), text)


def _member(headers: list, block: bytes) -> bytes:
    headers = [*headers, ("WARC-Block-Digest", "sha256:" + hashlib.sha256(block).hexdigest()), ("Content-Length", str(len(block)))]
    head = "WARC/1.1\r\n" + "".join(f"{name}: {value}\r\n" for name, value in headers) + "\r\n"
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress(head.encode()) + pack.compress(block) + pack.compress(b"\r\n\r\n") + pack.flush()


def page_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, written_at: str = WRITTEN_AT) -> bytes:
    """The member of one page."""
    digest = hashlib.sha256(payload).hexdigest()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()

    def name(of):
        return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{of}/{digest}')}>"
    headers = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", name(page_id)), ("WARC-Date", written_at),
               ("WARC-Target-URI", _clean(url) if url else f"urn:page:{'' if page_id is None else page_id}"),
               ("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", f"sha256:{digest}")]
    if page_id is not None:
        headers.append(("WARC-Page-ID", str(page_id)))
    if refers_to is None:
        return _member(headers, http + payload)
    return _member([*headers, ("WARC-Profile", PROFILE), ("WARC-Refers-To", name(refers_to)), ("WARC-Refers-To-Page-ID", str(refers_to))], http)


def write_warc(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
               file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write the pages as ``.warc.gz`` files; returns the list of files: path, records, bytes.

    A file's name holds the task's attempt, and only the files of attempts that ended are listed,
    so a task that is run again leaves no file twice in the list.
    """
    listed = pa.schema([("path", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())])

    def run(batches):
        from pyarrow import fs

        files, base = fs.FileSystem.from_uri(folder)
        files.create_dir(base, recursive=True)
        task = TaskContext.get()
        out, name, records, size, seq = None, "", 0, 0, 0

        def told():
            return pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"], "records": [records], "bytes": [size]}, schema=listed)
        for batch in batches:
            for row in zip(*(batch.column(i) for i in range(4))):
                page_id, url, html, refers_to = (x.as_py() for x in row)
                if out is None:
                    name, records, seq = f"part-{task.partitionId():06d}-{seq:06d}-{task.taskAttemptId()}.warc.gz", 0, seq + 1
                    out = files.open_output_stream(f"{base}/{name}", compression=None)
                    size = out.write(_member([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>"), (
                        "WARC-Date", WRITTEN_AT), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n"))
                size += out.write(page_record(page_id, url, html.encode(), refers_to))
                records += 1
                if size >= file_bytes:
                    out.close()
                    out = None
                    yield told()
        if out is not None:
            out.close()
            yield told()

    return stored(record_kinds(pages, id_col, url_col, html_col).mapInArrow(run, "path string, records long, bytes long"), "warc-files")


# --- reading ------------------------------------------------------------------

class Window:
    """A file's bytes by position; holds only what is asked for and what follows up to a chunk."""

    def __init__(self, file):
        self.file, self.size, self.base, self.data = file, file.size(), 0, b""

    def get(self, start: int, length: int) -> bytes:
        """Up to ``length`` bytes from ``start``."""
        end = min(start + length, self.size)
        if start < self.base or end > self.base + len(self.data):
            if self.base <= start <= self.base + len(self.data):
                kept = self.data[start - self.base:]
            else:
                kept = b""
            self.file.seek(start + len(kept))
            self.data, self.base = kept + self.file.read(max(end - start - len(kept), CHUNK)), start
        return self.data[start - self.base:end - self.base]


def _unpacked(window: Window, start: int) -> tuple:
    """Bytes of the gzip member at ``start``, and where it ends."""
    unpack, parts, at = zlib.decompressobj(31), [], start
    while not unpack.eof:
        piece = window.get(at, CHUNK)
        if not piece:
            raise Damaged("truncated")
        try:
            parts.append(unpack.decompress(piece))
        except zlib.error as error:
            raise Damaged("gzip") from error
        if at == start and parts[0] and not VERSION.match(parts[0][:10]) and len(parts[0]) >= 10:
            raise Damaged("version")
        at += len(piece)
    return b"".join(parts), at - len(unpack.unused_data)


def _header_end(data: bytes, start: int) -> int:
    end = data.find(b"\r\n\r\n", start, start + MOST_HEADER_BYTES)
    if not VERSION.match(data, start):
        raise Damaged("version")
    if end < 0:
        raise Damaged("headers")
    return end + 4


def _headers(data: bytes) -> dict:
    """Header fields by lower-case name; lines that begin with a blank continue the one before."""
    found: dict = {}
    last = None
    for line in data.decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and last:
            found[last] += " " + line.strip()
        elif line:
            name, colon, value = line.partition(":")
            if not colon:
                raise Damaged("headers")
            last = name.strip().lower()
            found[last] = value.strip()
    if not {"warc-type", "warc-record-id", "content-length"} <= found.keys() or not re.fullmatch(r"[0-9]{1,18}", found["content-length"]):
        raise Damaged("headers")
    return found


def _digest_fits(stated: str | None, data: bytes) -> bool:
    kind, _, value = (stated or "").partition(":")
    if kind.lower() not in ("sha256", "sha1", "md5") or len(value) != hashlib.new(kind.lower()).digest_size * 2:
        return True  # none, or one in another coding, which is no damage
    return hashlib.new(kind.lower(), data).hexdigest() == value.lower()


def _record(headers: dict, block: bytes) -> dict:
    """The columns of a record that passes its checks."""
    kind = headers["warc-type"].lower()
    if not _digest_fits(headers.get("warc-block-digest"), block):
        raise Damaged("block digest")
    payload, length = block, len(block)
    if headers.get("content-type", "").startswith("application/http"):
        cut = block.find(b"\r\n\r\n")
        if cut < 0:
            raise Damaged("http headers")
        payload = block[cut + 4:]
        length = len(payload)
        if kind == "revisit":
            stated = re.search(rb"(?im)^content-length: *([0-9]{1,18})\r?$", block[:cut])
            length = int(stated[1]) if stated else None
    if kind != "revisit" and not _digest_fits(headers.get("warc-payload-digest"), payload):
        raise Damaged("payload digest")
    algorithm, _, digest = headers.get("warc-payload-digest", "").partition(":")

    def number(name):
        value = headers.get(name, "")
        return int(value) if re.fullmatch(r"-?[0-9]{1,19}", value) else None
    return {"record_type": kind, "page_id": number("warc-page-id"), "target_uri": headers.get("warc-target-uri"),
            "refers_to": number("warc-refers-to-page-id"), "payload_bytes": length,
            "payload_digest": digest.lower() if kind == "revisit" and algorithm.lower() == "sha256" else hashlib.sha256(payload).hexdigest(),
            "payload": payload}


def _records_in(data: bytes) -> list:
    """The records of a member's bytes; all must pass, and nothing may be left over."""
    found, at = [], 0
    while at < len(data):
        body = _header_end(data, at)
        headers = _headers(data[at:body - 4])
        end = body + int(headers["content-length"])
        if end + 4 > len(data):
            raise Damaged("length")
        if data[end:end + 4] != b"\r\n\r\n":
            raise Damaged("length")
        found.append(_record(headers, data[body:end]))
        at = end + 4
    if not found:
        raise Damaged("empty member")
    return found


def _at(window: Window, start: int) -> tuple:
    """The records that begin at ``start`` and the place behind them."""
    first = window.get(start, 10)
    if first.startswith(MEMBER):
        data, end = _unpacked(window, start)
        return _records_in(data), end
    if not VERSION.match(first):
        raise Damaged("version")
    head = window.get(start, CHUNK)
    body = _header_end(head, 0)
    headers = _headers(head[:body - 4])
    length = int(headers["content-length"])
    if start + body + length + 4 > window.size:
        raise Damaged("truncated")
    block = window.get(start + body, length + 4)
    if block[length:] != b"\r\n\r\n":
        raise Damaged("length")
    return [_record(headers, block[:length])], start + body + length + 4


def _next_start(window: Window, after: int) -> int:
    """The first place from ``after`` on where a member or a version line begins; the file's size if none."""
    at = after
    while at < window.size:
        found = START.search(window.get(at, CHUNK))
        if found:
            return at + found.start()
        at += CHUNK - 9  # a version line may begin in these bytes
    return window.size


def salvage(file) -> Iterator[dict]:
    """Records and gaps of an open file in order, each with start and end; a gap has a reason and no type."""
    window, at, gap, reason = Window(file), 0, None, None
    while at < window.size:
        try:
            records, end = _at(window, at)
        except Damaged as error:
            if gap is None:
                gap, reason = at, str(error)
            at = _next_start(window, at + 1)
            continue
        if gap is not None:
            yield {"start": gap, "end": at, "reason": reason}
            gap = None
        for record in records:
            yield {"start": at, "end": end, **record}
        at = end
    if gap is not None:
        yield {"start": gap, "end": window.size, "reason": reason}


def warc_files(spark: SparkSession, folder: str) -> DataFrame:
    """path of each archive in a folder, for ``read_warc``; contents aren't read here."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.warc*").load(folder).select("path")


def read_warc(files: DataFrame, with_payload: bool = True) -> DataFrame:
    """All records and quarantined gaps of the archives whose ``path`` is listed.

    Gaps are the rows with a reason. Files are dealt out one by one; a file is read by one task,
    since members can't be found from its middle without reading it.
    """
    schema = pa.schema([(name, {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[kind]) for name, kind in (
        field.split(" ") for field in FOUND_SCHEMA.split(", "))])

    def run(batches):
        from pyarrow import fs

        for batch in batches:
            for path in batch.column(0).to_pylist():
                files_, place = fs.FileSystem.from_uri(path if "://" in path or path.startswith("/") else re.sub("^file:", "file://", path))
                rows, held = [], 0
                with files_.open_input_file(place) as file:
                    for row in salvage(file):
                        held += len(row.get("payload") or b"") if with_payload else 64
                        rows.append(row | {"path": path} | ({} if with_payload else {"payload": None}))
                        if held > CHUNK * 8 or len(rows) >= 4096:
                            yield pa.RecordBatch.from_pylist(rows, schema=schema)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)

    paths = files.select("path")
    return paths.repartition(max(1, min(paths.count(), 100_000))).mapInArrow(run, FOUND_SCHEMA)


def quarantine(found: DataFrame) -> DataFrame:
    """path, start, end, reason of each gap."""
    return found.filter(F.col("reason").isNotNull()).select("path", "start", "end", "reason")


def warc_round_trip(pages: DataFrame) -> DataFrame:
    """Write archives below the shared folder and read them back: one row per page."""
    files = write_warc(pages, new_path(pages.sparkSession, "warc"))
    found = read_warc(files, with_payload=False)
    return found.filter(F.col("record_type").isin("response", "revisit")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
