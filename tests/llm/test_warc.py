import gzip
import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cloakline.llm import common, warc


def test_assembly_checks():
    assert warc.assemble([(2, 5, b"cde"), (1, None, b"ab")]) == b"abcde"
    for bad in ([(1, 5, b"ab")], [(1, None, b"ab"), (3, 5, b"cde")], [(1, None, b"ab"), (2, 6, b"cde")], [(1, None, b"ab"), (2, None, b"cde")]):
        with pytest.raises(warc.Damaged):
            warc.assemble(bad)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.binary(min_size=1, max_size=50), max_size=6))
def test_chunked_framing(pieces):
    body = b"".join(f"{len(p):x};x=1\r\n".encode() + p + b"\r\n" for p in pieces) + b"0\r\n\r\n"
    assert warc.payload_of(b"HTTP/1.1 200 OK\r\nTransfer-Encoding: Chunked\r\n\r\n" + body)[0] == b"".join(pieces)


def test_cut_short_chunk():
    with pytest.raises(warc.Damaged):
        warc.payload_of(b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n5\r\nabc\r\n0\r\n\r\n")


def brute(rows):
    first = {}
    for i, h in rows:
        data = (h or "").encode()
        first[data] = min(first.get(data, i), i)
    out = []
    for i, h in rows:
        data = (h or "").encode()
        revisit = len(data) >= 100 and first[data] != i
        out.append((i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if revisit else "response", first[data] if revisit else None))
    return sorted(out)


def test_archives_round_trip(spark):
    trap = "\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n0\r\n\r\n"
    rows = [(5, None), (2, ""), (3, "é" * 60), (1, "é" * 60), (9, "x" * 99), (8, "x" * 99), (4, trap * 30), (7, trap * 30), (6, "ü漢" * 40_000), (10, "y" * 8192), (11, "\x00\x01")]
    pages = spark.createDataFrame([(i, f"http://h/{i}\r\nX: 1", h, 0) for i, h in rows], "page_id long, url string, html string, digest int")
    for segment in (warc.SEGMENT, 1000):
        path = common.fresh_path(spark, "warc")
        warc.write(pages, path, segment)
        read = warc.read(spark, path).collect()
        assert sorted(tuple(r)[:5] for r in read) == brute(rows)
        texts = dict(rows)
        assert all(bytes(r.payload).decode() == (texts[r.page_id] or "") for r in read if r.record_type == "response")


def test_repeated_rows_and_empty_table(spark):
    pages = spark.createDataFrame([(1, "u", "z" * 200)] * 3 + [(None, None, "z" * 200)], "page_id long, url string, html string")
    path = common.fresh_path(spark, "warc")
    warc.write(pages, path)
    rows = warc.read(spark, path, with_payload=False).collect()
    assert sorted(r.record_type for r in rows) == ["response", "revisit", "revisit", "revisit"]
    assert {r.refers_to for r in rows if r.record_type == "revisit"} == {1}
    path = common.fresh_path(spark, "warc")
    warc.write(pages.limit(0), path)
    assert warc.read(spark, path).count() == 0


def test_response_does_not_follow_the_layout(spark):
    """Payloads of many rows, under repeated and null page_ids, however the rows lie: one response each."""
    rows = [(i, f"u{i % 3}", "a" * 150) for i in range(30)] + [(None, "n", "b" * 200)] * 40 + [(7, "u", "c" * 300)] * 5 + [(None, "u", "c" * 300)] * 5 + [(3, "v", "d" * 120), (3, "w", "d" * 120)]
    random.Random(1).shuffle(rows)
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    for layout in (pages, pages.repartition(8), pages.repartition(5, "url"), pages.coalesce(1)):
        path = common.fresh_path(spark, "warc")
        warc.write(layout, path, 100)
        read = warc.read(spark, path).collect()
        assert len(read) == len(rows)
        for payload, first in (("a" * 150, 0), ("b" * 200, None), ("c" * 300, 7), ("d" * 120, 3)):
            mine = [r for r in read if r.payload_digest == hashlib.sha256(payload.encode()).hexdigest()]
            responses = [r for r in mine if r.record_type == "response"]
            assert len(responses) == 1 and bytes(responses[0].payload).decode() == payload and responses[0].page_id == first
            assert all(r.refers_to == first and r.payload_bytes == len(payload) for r in mine if r.record_type == "revisit")
            assert sorted(str(r.page_id) for r in mine) == sorted(str(i) for i, _, h in rows if h == payload)


def test_record_identifiers_differ(spark):
    pages = spark.createDataFrame([(1, "u", "z" * 200)] * 4 + [(2, "u", "z" * 200), (3, "u", "short"), (3, "u", "short")], "page_id long, url string, html string")
    path = common.fresh_path(spark, "warc")
    warc.write(pages.repartition(3), path, 100)
    ids = [r.record_id for r in warc.segments(spark, path).collect()]
    assert len(ids) == len(set(ids))


def test_archives_of_other_writers(spark, tmp_path):
    record = lambda kind, headers, block: (f"WARC/1.0\r\nWARC-Type: {kind}\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers.items()) + f"Content-Length: {len(block)}\r\n\r\n").encode() + block + b"\r\n\r\n"
    body = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n3\r\nabc\r\n0\r\n\r\n"
    parts = [
        record("warcinfo", {"WARC-Record-ID": "<a>"}, b"software: x\r\n"), record("response", {"WARC-Record-ID": "<b>", "WARC-Payload-Digest": "sha1:ABC"}, body),
        record("revisit", {"WARC-Record-ID": "<c>"}, b""), record("continuation", {"WARC-Record-ID": "<e>", "WARC-Segment-Origin-ID": "<d>", "WARC-Segment-Number": 2, "WARC-Segment-Total-Length": len(body)}, body[9:]),
        record("response", {"WARC-Record-ID": "<d>", "WARC-Segment-Number": 1}, body[:9]),
    ]
    (tmp_path / "x.warc.gz").write_bytes(b"".join(map(gzip.compress, parts)))
    rows = warc.read(spark, f"file://{tmp_path}").collect()
    assert sorted((r.record_type, None if r.payload is None else bytes(r.payload)) for r in rows if r.payload) == [("response", b"abc"), ("response", b"abc")]
    assert [r.payload_bytes for r in rows if r.record_type == "revisit"] == [None]
    (tmp_path / "x.warc.gz").write_bytes(gzip.compress(b"".join(parts))[:-12])
    with pytest.raises(Exception, match="cut short|doesn't end"):
        warc.read(spark, f"file://{tmp_path}").collect()


def test_a_record_is_read_across_pieces():
    record = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nab\r\nc\r\n\r\n"
    for size in (1, 2, 3, 7, 1000):
        data = record * 3
        assert [x for _, x in warc.parse(data[i : i + size] for i in range(0, len(data), size))] == [b"ab\r\nc"] * 3
    packed = gzip.compress(b"x" * 5_000_000) + gzip.compress(b"y")
    assert b"".join(warc.inflate(packed)) == b"x" * 5_000_000 + b"y"
