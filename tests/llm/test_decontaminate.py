from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from gridwarden.llm import decontaminate
from gridwarden.llm.decontaminate import ITEMS, N_HIT, contamination, without_matches

DOCS = "doc_id long, text string, item_id long, matches string"
TEST_ITEMS = "item_id long, text string, doc_id long"


def words(text):
    lower = "".join(c.lower() if c.isascii() else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def brute_force(docs, items, window, slop=0):
    def places(found, wanted):
        """All chains of positions with gaps of at most 1 + slop."""
        chains = [(i,) for i, w in enumerate(found) if w == wanted[0]]
        for word in wanted[1:]:
            chains = [
                (*c, i) for c in chains for i in range(c[-1] + 1, min(len(found), c[-1] + 2 + slop))
                if found[i] == word
            ]
        return chains

    out = []
    for doc_id, text, *_ in docs:
        found, hit, by = words(text), set(), set()
        for item_id, item, *_ in items:
            seq = words(item)
            size = min(window, len(seq))
            for start in range(len(seq) - size + 1 if size and item_id is not None else 0):
                ends = {}
                for chain in places(found, seq[start : start + size]):
                    ends[chain[0]] = min(ends.get(chain[0], chain[-1]), chain[-1])
                for first, last in ends.items():
                    hit.update(range(first, last + 1))
                    by.add(str(item_id))
        out.append((doc_id, len(found), len(hit), sorted(by)))
    return sorted(out, key=repr)


def make(seed):
    draw = random.Random(seed)
    vocabulary = ["the", "of", "é", "x1", "Word", "rare", "it", "is"]
    items = [(i, ", ".join(draw.choices(vocabulary, k=draw.choice([1, 2, 5, 9, 14]))), 0) for i in range(8)]
    items += [(None, "the of", 0), (50, "", 0), (51, None, 0), (52, "?!", 0), (3, "it is rare", 0)]
    docs = []
    for i in range(40):
        text = " ".join(draw.choices(vocabulary, k=draw.randrange(60)))
        if draw.random() < 0.5:
            text += "\n" + (draw.choice(items)[1] or "").upper()
        docs.append((i, text, 1, "m"))
    return [*docs, (None, "it is rare", 1, "m"), (5, None, 1, "m"), (6, "", 1, "m")], items


def run(frame):
    rows = frame.selectExpr("doc_id", "n_words", f"{N_HIT} AS n_hit", f"{ITEMS} AS items").collect()
    return sorted(((r.doc_id, r.n_words, r.n_hit, r["items"]) for r in rows), key=repr)


@pytest.mark.parametrize(("seed", "slop", "slice_bytes", "block"), [(1, 0, 1 << 20, 1 << 20), (2, 0, 200, 60), (3, 1, 300, 1 << 20), (4, 2, 1 << 20, 90)])
def test_equals_brute_force(spark, monkeypatch, seed, slop, slice_bytes, block):
    real = decontaminate.slices
    monkeypatch.setattr(decontaminate, "slices", lambda b, n=slice_bytes: real(b, n))
    docs, items = make(seed)
    got = contamination(
        spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, TEST_ITEMS),
        window=3, slop=slop, block_bytes=block,
    )
    assert run(got) == brute_force(docs, items, 3, slop)


def test_phrases_stay_in_their_document(spark):
    docs = [(1, "a b c", 0, ""), (2, "d e f", 0, "")]
    items = [(1, "b c d e", 0)]
    assert [r[2] for r in run(contamination(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, TEST_ITEMS), window=4))] == [0, 0]


def test_empty_tables_and_filter(spark):
    none, some = spark.createDataFrame([], DOCS), spark.createDataFrame([(1, "a b", 0, ""), (2, "c", 0, "")], DOCS)
    items = spark.createDataFrame([(7, "A B", 0)], TEST_ITEMS)
    assert run(contamination(none, items)) == []
    assert [r[2] for r in run(contamination(some, items.limit(0)))] == [0, 0]
    left = without_matches(some, items)
    assert left.columns == some.columns and [r.doc_id for r in left.collect()] == [2]


def test_a_file_of_the_index_holds_one_shard(spark, monkeypatch):
    """A task reads the row groups of a file whole."""
    real = decontaminate.slices
    monkeypatch.setattr(decontaminate, "slices", lambda b: real(b, 200))
    docs, items = make(5)
    index = decontaminate.build_index(spark.createDataFrame(docs, DOCS).coalesce(1))
    shards = index.groupBy(F.input_file_name()).count().collect()
    assert len(shards) > 10 and {r["count"] for r in shards} == {1}
    found = decontaminate.search_index(index, spark.createDataFrame(items, TEST_ITEMS), window=3)
    assert run(found) == brute_force(docs, items, 3)
