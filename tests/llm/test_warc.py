"""WARC archives: round trip, revisits, and what the reader saves from damaged files."""

import gzip
import hashlib
import os
import random

import pyarrow as pa
import pytest

from scanfold.llm import warc
from scanfold.sources.workspace import new_path

BIG = "<html>" + "é same page " * 30 + "</html>"
SMALL = "<p>small</p>"


def salvaged(data):
    return list(warc.salvage(pa.BufferReader(data)))


def members(count, seed=0):
    draw = random.Random(seed)
    return [warc.page_record(i, f"http://example.com/{i}", bytes(draw.choice(b"abcdef <>\n") for _ in range(draw.randint(0, 3000))), None)
            for i in range(count)]


def plain(*records):
    return b"".join(gzip.decompress(r) for r in records)


def check_tiling(found, data):
    """Records and gaps together are the file, byte for byte."""
    at = 0
    for start, end in sorted({(r["start"], r["end"]) for r in found}):
        assert start == at
        at = end
    assert at == len(data)


def brute(rows):
    first = {}
    for i, html in rows:
        data = (html or "").encode()
        if len(data) >= 100 and i is not None:
            first[data] = min(i, first.get(data, i))
    found = []
    for i, html in rows:
        data = (html or "").encode()
        keep = first.get(data)
        revisit = keep is not None and i != keep
        found.append((i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if revisit else "response", keep if revisit else None))
    return sorted(found, key=str)


ROWS = [(5, BIG), (2, BIG), (9, BIG), (2, BIG), (None, BIG), (3, SMALL), (4, SMALL), (1, None), (7, ""), (8, "x" * 99), (10, "x" * 99),
        (11, "x" * 100), (12, "x" * 100), (None, "lone" * 40), (None, "lone" * 40), (13, "z" * 3_000_000), (-4, "WARC/1.1\r\nWARC-Type: response\r\n\r\n" * 9)]


def frame(spark, rows):
    urls = ["http://a.example/?q=1", None, "", "bad\r\nWARC-Type: x", " ü "]
    return spark.createDataFrame([(i, urls[n % 5], html, "d", 1) for n, (i, html) in enumerate(rows)],
                                 "page_id long, url string, html string, digest string, keep int")


def test_round_trip(spark):
    got = sorted((tuple(r) for r in warc.warc_round_trip(frame(spark, ROWS)).collect()), key=str)
    assert got == brute(ROWS)
    assert warc.warc_round_trip(frame(spark, [])).count() == 0


def test_files_and_payloads(spark):
    folder = new_path(spark, "warc-test")
    files = warc.write_warc(frame(spark, ROWS), folder, file_bytes=1)
    assert files.count() == len(ROWS) and {os.path.basename(r.path) for r in files.collect()} == {
        os.path.basename(r.path) for r in warc.warc_files(spark, folder).collect()}
    rows = warc.read_warc(warc.warc_files(spark, folder)).collect()
    assert not [r for r in rows if r.reason] and sum(r.record_type == "warcinfo" for r in rows) == len(ROWS)
    texts = sorted((r.payload.decode() for r in rows if r.record_type == "response"))
    assert texts == sorted(html or "" for (_, html), (_, _, _, kind, _) in zip(
        sorted(ROWS, key=lambda r: str((r[0], len((r[1] or "").encode()), hashlib.sha256((r[1] or "").encode()).hexdigest()))), brute(ROWS)) if kind == "response")
    uris = {r.target_uri for r in rows if r.record_type == "response"}
    assert "bad%0D%0AWARC-Type: x" in uris | {r.target_uri for r in rows} and "http://a.example/?q=1" in uris


def test_whole_file():
    records = members(20)
    data = b"".join(records)
    found = salvaged(data)
    assert [r["page_id"] for r in found] == list(range(20))
    check_tiling(found, data)
    check_tiling(salvaged(plain(*records)), plain(*records))
    assert [r["page_id"] for r in salvaged(plain(*records))] == list(range(20))


@pytest.mark.parametrize("packed", [True, False])
def test_each_damaged_record_is_lost_alone(packed):
    records = members(12, 1) if packed else [gzip.decompress(r) for r in members(12, 1)]
    for lost in range(12):
        for place in (0, 5, len(records[lost]) // 2, len(records[lost]) - 6):
            bad = bytearray(records[lost])
            bad[place] ^= 0x55
            data = b"".join([*records[:lost], bytes(bad), *records[lost + 1:]])
            found = salvaged(data)
            check_tiling(found, data)
            assert {r["page_id"] for r in found if "reason" not in r} >= set(range(12)) - {lost}
            gaps = [r for r in found if "reason" in r]
            low = sum(map(len, records[:lost]))
            # Some bits of a gzip header mean nothing, and plain header lines have no digest.
            unseen = place < 10 if packed else place < records[lost].find(b"\r\n\r\n")
            assert [(g["start"], g["end"]) for g in gaps] == [(low, low + len(bad))] or (unseen and not gaps)


def test_cut_and_junk():
    records = members(6, 2)
    data = b"junk\x1f\x8b\x08 more" + records[0] + records[1][:40] + records[2] + b"\0" * 5000 + plain(records[3]) + b"WARC/1.1\r\nno\r\n\r\n" + records[4] + records[5][:-9]
    found = salvaged(data)
    check_tiling(found, data)
    assert [r["page_id"] for r in found if "reason" not in r] == [0, 2, 3, 4]
    assert len([r for r in found if "reason" in r]) == 5


def test_reasons():
    whole = gzip.decompress(members(1, 3)[0])
    for old, new, reason in ((b"WARC/1.1", b"WARC/9.1", "version"), (b"WARC-Record-ID", b"WARC-Xecord-ID", "headers"),
                             (b"example", b"exbmple", None), (b"Content-Length: ", b"Content-Length: 1", "truncated")):
        found = salvaged(whole.replace(old, new))
        assert [r.get("reason") for r in found] == [reason]
    assert [r.get("reason") for r in salvaged(whole[:-30] + b"?" + whole[-29:])] == ["block digest"]
    assert salvaged(b"") == []


def test_starts_across_chunks(monkeypatch):
    monkeypatch.setattr(warc, "CHUNK", 64)
    monkeypatch.setattr(warc, "MOST_HEADER_BYTES", 4096)
    records = members(8, 5)
    for junk in range(50, 80):
        data = b"x" * junk + records[0] + b"y" * junk + b"".join(records[1:])
        found = salvaged(data)
        check_tiling(found, data)
        assert [r["page_id"] for r in found if "reason" not in r] == list(range(8))


def test_random_damage():
    draw = random.Random(6)
    records = members(30, 7)
    whole = b"".join(records)
    for _ in range(30):
        data = bytearray(whole)
        hit = set()
        for _ in range(4):
            at = draw.randrange(len(data))
            data[at] = draw.randrange(256)
            hit.add(next(i for i in range(30) if sum(map(len, records[:i + 1])) > at))
        found = salvaged(bytes(data))
        check_tiling(found, data)
        assert {r["page_id"] for r in found if "reason" not in r} >= set(range(30)) - hit


def test_damaged_file_on_spark(spark, tmp_path):
    records = members(9, 8)
    bad = bytearray(records[4])
    bad[30] ^= 0xFF
    (tmp_path / "a.warc.gz").write_bytes(b"".join([*records[:4], bytes(bad), *records[5:]]))
    (tmp_path / "b.warc").write_bytes(plain(*records) + b"tail")
    (tmp_path / "empty.warc").write_bytes(b"")
    found = warc.read_warc(warc.warc_files(spark, str(tmp_path)))
    gaps = {os.path.basename(r.path): (r.start, r.end, r.reason) for r in warc.quarantine(found).collect()}
    low = sum(map(len, records[:4]))
    assert set(gaps) == {"a.warc.gz", "b.warc"} and gaps["a.warc.gz"][:2] == (low, low + len(bad))
    assert found.filter("reason IS NULL").count() == 17
