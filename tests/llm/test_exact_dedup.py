from __future__ import annotations

import hashlib
import random

from gridwarden.llm.exact_dedup import (
    CuckooIndex, build_index, deduplicate, digests, exact_duplicates, update_index,
)

SCHEMA = "doc_id long, text string, digest string, keep_id long"
ROWS = [
    (1, "Same", "x", 0), (5, "sAME", "x", 0), (3, "same", "x", 0), (4, "Äh", "x", 0), (2, "äh", "x", 0),
    (None, "", "x", 0), (9, None, "x", 0), (None, "alone", "x", 0), (7, "twice", "x", 0), (7, "twice", "x", 0),
    (6, "long " * 50_000, "x", 0), (8, "LONG " * 50_000, "x", 0),
]


def norm(text):
    return "".join(c.lower() if c.isascii() else c for c in text or "")


def test_cuckoo_index_against_a_dict():
    draw, index, live = random.Random(5), CuckooIndex(buckets=2), {}
    keys = [hashlib.sha256(bytes([i % 256, i // 256])).digest() for i in range(3000)]
    for _ in range(20_000):
        key = draw.choice(keys)
        if draw.random() < 0.3:
            assert index.delete(key) == (live.pop(key, None) is not None)
        else:
            index.add(key, draw.randrange(100), 1, 1)
            live[key] = live.get(key, 0) + 1
        assert len(index) == len(live)
    assert index.rebuilds and {e[0]: e[3] for e in index} == live
    assert all((index.get(k) is None) == (k not in live) for k in keys)


def test_equal_fingerprints_are_told_apart():
    index = CuckooIndex(buckets=4)
    keys = [b"\x07\x00" + bytes([i]) * 30 for i in range(9)]  # one fingerprint
    for nth, key in enumerate(keys):
        index.add(key, nth, 1, 1)
    assert [index.get(k)[1] for k in keys] == list(range(9))


def test_groups(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    got = exact_duplicates(docs.select("doc_id", "text")).collect()
    groups = {}
    for doc_id, text, *_ in ROWS:
        groups.setdefault(norm(text), []).append(doc_id)
    want = []
    for doc_id, text, *_ in ROWS:
        ids = groups[norm(text)]
        keep = max((i for i in ids if i is not None), default=None)
        want.append((doc_id, keep, len(ids), doc_id == keep, hashlib.sha256(norm(text).encode()).digest()))
    assert sorted(map(repr, want)) == sorted(repr((*tuple(r)[:4], bytes(r.digest))) for r in got)
    kept = deduplicate(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["2", "4", "5", "7", "8", "9", "None"]


def test_small_buckets_and_updates(spark):
    rows = [(i, f"text {i % 40}") for i in range(200)]
    keys = digests(spark.createDataFrame(rows, "doc_id long, text string")).cache()
    index = build_index(keys, bucket_rows=7)
    assert {(r.keep_id, r.group_size) for r in index.collect()} == {(i, 5) for i in range(160, 200)}
    gone = keys.where("doc_id < 10").select("digest")
    more = digests(spark.createDataFrame([(500, "TEXT 3"), (501, "text 39"), (502, "new")], "doc_id long, text string"))
    updated = update_index(index, more, gone, bucket_rows=7)
    assert {(r.keep_id, r.group_size) for r in updated.collect()} == {
        *((i, 5) for i in range(170, 199)), (500, 1), (501, 6), (502, 1),
    }


def test_no_rows(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert exact_duplicates(docs.select("doc_id", "text")).collect() == []
    assert deduplicate(docs).collect() == []
