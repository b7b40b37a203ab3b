from __future__ import annotations

import gzip
import hashlib
import random

from gridwarden.llm import queries, warc
from gridwarden.session import scratch_path

SCHEMA = "page_id long, url string, html string, record_id string, weight int"
TEXT = "x" * 100
ROWS = [
    (5, "http://a/5", TEXT), (3, "http://a/3", TEXT), (9, None, TEXT), (3, "http://a/3b", TEXT), (None, "u", TEXT),
    (1, "http://b/?q=1", "short"), (2, "http://b/", "short"), (4, "bad\r\nurl", ""), (6, "http://c", None),
    (7, "http://d", "\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n" * 3),
    (8, "http://d2", "\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n" * 3),
    (10, "http://e", "äöü\r\n" * 40_000), (11, "http://e", "äöü\r\n" * 40_000), (12, "http://f", "\r\n" * 70),
    (13, "http://g", TEXT + "!"), (13, "http://g", TEXT + "!"), (14, "", "ends with \r"),
]


def want(rows):
    bodies = [(i, (h or "").encode()) for i, _, h in rows]
    first = {}
    for i, body in bodies:
        if len(body) >= 100 and i is not None:
            first[body] = min(first.get(body, i), i)
    out = []
    for i, body in bodies:
        keep = first.get(body, i)
        kind = "response" if i == keep else "revisit"
        out.append((i, len(body), hashlib.sha256(body).hexdigest(), kind, None if i == keep else keep))
    return sorted(out, key=repr)


def got(spark, rows):
    pages = spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA)
    path = scratch_path(spark, "warc-test")
    warc.write_archives(pages, path)
    return sorted((tuple(r) for r in queries.capture_rows(spark, path).collect()), key=repr)


def test_round_trip(spark):
    assert got(spark, ROWS) == want(ROWS)


def test_random_payloads(spark):
    draw = random.Random(3)
    parts = ["\r", "\n", "\r\n", "\r\n\r\n", "a", "WARC/1.1\r\n", "é", "\x00"]
    rows = [(i, f"http://h/{i % 7}", "".join(draw.choices(parts, k=draw.choice([0, 3, 60, 61, 40_000])))) for i in range(150)]
    rows += [(i + 500, "u", rows[i % 20][2]) for i in range(60)]
    assert got(spark, rows) == want(rows)


def test_no_pages(spark):
    assert got(spark, []) == []


def test_hot_payload(spark):
    rows = [(i, "u", "hot" * 50 if i % 3 == 0 else f"{i // 2}" * 60) for i in range(2_500)]
    assert got(spark, rows) == want(rows)


def test_records_and_transactions(spark):
    pages = spark.createDataFrame([(*r, "clash", 1) for r in ROWS[:2]], SCHEMA)
    path = scratch_path(spark, "warc-test")
    warc.write_archives(pages, path)
    records = warc.read_records(spark, path)
    kinds = sorted(r.record_type for r in records.collect())
    assert kinds == ["metadata"] * 2 + ["request"] * 2 + ["response", "revisit"]
    rows = {r.record_type: r for r in warc.assemble(records).collect()}
    assert rows["response"].payload == TEXT.encode() and rows["revisit"].payload == b""
    assert rows["revisit"].refers_to == rows["response"].record_id
    assert rows["response"].metadata.fields == {"page-id": "3"} and rows["response"].request.n == 1


def record(kind, rid, block, **header):
    lines = [f"WARC-Type: {kind}", f"WARC-Record-ID: <{rid}>", f"Content-Length: {len(block)}"]
    lines += [f"{k.replace('_', '-')}: {v}" for k, v in header.items()]
    return "\r\n".join(["WARC/1.0", *lines, "", ""]).encode() + block + b"\r\n\r\n"


def test_archive_from_elsewhere(spark, tmp_path):
    """One gzip member a record, a response that names its request, several metadata records."""
    http = b"HTTP/1.1 200 OK\r\nA: b\r\n\r\nbody\r\n\r\n"
    made = [
        record("warcinfo", "i", b"software: x\r\n", Content_Type="application/warc-fields"),
        record("response", "r", http, Content_Type="application/http; msgtype=response", WARC_Concurrent_To="<q>"),
        record("request", "q", b"GET / HTTP/1.1\r\n\r\n", Content_Type="application/http;msgtype=request"),
        record("metadata", "m2", b"a: 2\r\n", Content_Type="application/warc-fields", WARC_Concurrent_To="<r>"),
        record("metadata", "m1", b"a: 1\r\n", Content_Type="application/warc-fields", WARC_Concurrent_To="<r>"),
        record("resource", "s", b"plain"),
        record("revisit", "v", b"", WARC_Refers_To="<r>"),
        record("revisit", "w", b"", WARC_Refers_To="<gone>"),
        record("metadata", "m3", b"", WARC_Concurrent_To="<gone>"),
    ]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(map(gzip.compress, made)))
    (tmp_path / "b.warc").write_bytes(b"".join(made[:1]))
    records = warc.read_records(spark, str(tmp_path))
    assert records.count() == 10
    rows = {r.record_id: r for r in warc.resolve(warc.assemble(records)).collect()}
    assert sorted(rows) == ["<r>", "<s>", "<v>", "<w>"]
    assert rows["<r>"].payload == b"body\r\n\r\n" and rows["<r>"].request.record_id == "<q>"
    assert (rows["<r>"].metadata.fields, rows["<r>"].metadata.n) == ({"a": "1"}, 2)
    assert rows["<v>"].original.payload_bytes == 8 and rows["<w>"].original is None
    assert rows["<s>"].payload == b"plain" and rows["<s>"].request is None


def test_damaged(spark, tmp_path):
    whole = record("resource", "s", b"plain")
    for nth, data in enumerate([whole[:-7], b"x" + whole, whole.replace(b"Content-Length: 5", b"Content-Length: x")]):
        (tmp_path / str(nth)).mkdir()
        (tmp_path / str(nth) / "a.gz").write_bytes(gzip.compress(data))
        try:
            warc.read_records(spark, str(tmp_path / str(nth))).collect()
        except Exception as e:
            assert "record" in str(e)
        else:
            raise AssertionError(nth)
