from __future__ import annotations

import random
import re
from collections import Counter

from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from gridwarden.llm import phrases, queries

SCHEMA = "text string, lang string, rank long, phrase string"


def pieces(text):
    text = "".join(c.lower() if c.isascii() else c for c in text or "")
    return [re.findall("[^\x20\x09]+", p) for p in re.split("[.,;:!?\n\x0b\x0c\r]", text)]


def want(rows, least=30, top=2000):
    out = []
    for lang in {r[1] or "und" for r in rows if r[1] != ""} | {"" for r in rows if r[1] == ""}:
        f = Counter()
        for text, named, *_ in rows:
            if (named if named is not None else "und") == lang:
                for p in pieces(text):
                    f.update(tuple(p[i : i + k]) for k in range(1, 5) for i in range(len(p) - k + 1))
        n = sum(v for p, v in f.items() if len(p) == 1)
        kept = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        best = []
        for p, a in kept.items():
            inside = [
                b for q, b in kept.items()
                if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q))) and 100 * b >= 80 * a
            ]
            cuts = [(2_000_000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            if not inside:
                best.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, p, left, right) in enumerate(sorted(best)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n, -score))
    return sorted(out)


def got(spark, rows, **kw):
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)
    return sorted(tuple(r) for r in phrases.collocations(docs, **kw).collect())


def corpus(seed, size, words=40):
    draw = random.Random(seed)
    known = ["New", "york", "CITY", "hall", "é", "a\x00b", "x\xa0y", *(f"w{i}" for i in range(words))]
    out = []
    for _ in range(size):
        tokens = draw.choices(known, [1 / (i + 1) for i in range(len(known))], k=draw.randint(0, 60))
        tokens += ["new", "York", "city", "hall"] * draw.randint(0, 2)
        out.append(("".join(t + draw.choice([" ", " ", " ", "\t", ". ", ",", "\r\n", "  "]) for t in tokens), draw.choice(["en", "fr", None, ""])))
    return out


def test_against_brute_force(spark):
    rows = corpus(1, 300) + [(None, "en"), ("", None), ("only " * 200_000, "long"), (". ; ," * 50, "en")]
    assert got(spark, rows) == want(rows)
    assert got(spark, rows, top=3) == want(rows, top=3)


def test_small_blocks_and_shuffled_joins(spark, monkeypatch):
    rows = corpus(2, 200)
    whole = got(spark, rows, least=5)
    assert whole == want(rows, least=5) and len(whole) > 50
    monkeypatch.setattr(phrases, "BROADCAST_ROWS", -1)
    assert got(spark, rows, least=5) == whole


def blocks_of(rows):
    batch = pa.RecordBatch.from_pylist([{"lang": lang, "text": text} for text, lang in rows])
    return [r for b in phrases._blocks(iter([batch])) for r in b.to_pylist()]


def test_pairs_do_not_depend_on_blocks(monkeypatch):
    monkeypatch.setattr(phrases, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    rows = corpus(3, 60)

    def pairs(blocks):
        found = Counter()
        for b in blocks:
            names = list(zip(b["langs"], b["words"]))
            ids = np.frombuffer(b["ids"], np.int32)
            found.update((names[x], names[y]) for x, y in zip(ids, ids[1:]) if x >= 0 and y >= 0)
        return found

    whole = blocks_of(rows)
    monkeypatch.setattr(phrases, "BLOCK", 50)
    monkeypatch.setattr(phrases, "PART", 300)
    many = blocks_of(rows)
    assert len(whole) == 1 and len(many) > 10 and pairs(whole) == pairs(many)


def test_repeated_rows_and_no_rows(spark):
    rows = [("tick tock tick tock", "xx")] * 15
    assert got(spark, rows) == want(rows) != []
    assert got(spark, []) == [] and got(spark, [("a b c", "en")]) == []


def test_pair_counts():
    draw = np.random.default_rng(4)
    for top, bits in ((3, 1), (900, 2), (50, 9), (2_000_000_000, 2)):
        ids = draw.integers(-1, top, 5_000) // draw.integers(1, 4, 5_000)
        pairs = Counter((int(a) << 32) + int(b) for a, b in zip(ids, ids[1:]) if a >= 0 and b >= 0)
        keys, counts = phrases.pair_counts(ids, bits)
        assert dict(zip(keys.tolist(), counts.tolist())) == pairs and len(keys) == len(pairs)


def cuts(data):
    done = b""
    for part, between in phrases._parts(data):
        done += part
        yield done, between


def test_blocks_are_cut_between_words(monkeypatch):
    data = b"some words. and more words " * 50
    monkeypatch.setattr(phrases, "PART", 7)
    parts = [p for p, _ in phrases._parts(data)]
    assert b"".join(parts) == data and len(parts) > 20
    assert all(b == (data[len(a) :][:1] in (b".", b"")) for a, b in cuts(data))
    assert [w for p in parts for w in p.replace(b".", b" . ").split()] == data.replace(b".", b" . ").split()


def test_ids_without_partners():
    ids = np.array([-1, -1, 3, -1, 4, 5, -1, 6, -1, 7, 8])
    assert phrases.with_partners(ids).tolist() == [4, 5, -1, 7, 8]
    assert phrases.with_partners(np.array([1])).tolist() == []


def test_query_is_registered():
    assert queries.QUERIES["op11_phrases"] and queries.ORACLE["op11_phrases"]


def test_tables_of_blocks_are_small_files_of_binaries(spark, monkeypatch):
    """A task reads the row groups of a file whole, and arrays take many times their size."""
    made, keep = {}, phrases.written

    def watched(df, name, **options):
        made[name] = keep(df, name, **options)
        return made[name]

    monkeypatch.setattr(phrases, "written", watched)
    docs = spark.createDataFrame([("a b c. d " * 100_000, "en", 1, "x")] * 24, SCHEMA).coalesce(1)
    found = {r.phrase: r.a for r in phrases.collocations(docs).collect()}
    assert found == {"d a b c": 24 * 99_999}
    for name in ("phrase-blocks", "phrase-blocks-1", "phrase-blocks-2", "phrase-blocks-3"):
        files = [r["count"] for r in made[name].groupBy(F.input_file_name()).count().collect()]
        assert sum(files) > phrases.BLOCKS_A_FILE >= max(files)
        assert [c for c, kind in made[name].dtypes if kind.startswith("array") and c != "langs"] == []


def test_sums_of_pairs():
    draw = np.random.default_rng(8)
    parts = [(np.sort(draw.choice(90, 40, replace=False)) << 32, draw.integers(1, 9, 40)) for _ in range(3)]
    want = Counter()
    for keys, counts in parts:
        want.update(dict(zip(keys.tolist(), counts.tolist())))
    keys, counts = phrases._summed(*zip(*parts))
    assert dict(zip(keys.tolist(), counts.tolist())) == want and sorted(want) == keys.tolist()
    got = {}
    for row in phrases._dealt(keys, counts, 7).to_pylist():
        back = np.cumsum(phrases.from_planes(row["keys"], np.int64)).tolist()
        got.update(zip(back, phrases.from_planes(row["counts"], np.int64).tolist()))
        assert 0 <= row["nth"] < 7
    assert got == want
