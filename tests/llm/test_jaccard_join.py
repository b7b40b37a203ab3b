from __future__ import annotations

import random
import re
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gridwarden.llm import components as components_module
from gridwarden.llm import jaccard_join
from gridwarden.llm.jaccard_join import Bands, shingle_classes
from gridwarden.session import SHUFFLES_GO, scratch_root

SCHEMA = "doc_id long, text string, node string"


def brute_force(rows, size=3, num=90, den=100):
    sets = []
    for _, text, *_ in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
        span = min(size, len(words))
        sets.append({tuple(words[i : i + span]) for i in range(len(words) - span + 1)} if words else set())
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    least = {}
    for i, row in enumerate(rows):
        least[find(i)] = min(least.get(find(i), row[0]), row[0])
    return sorted((row[0], len(sets[i]), least[find(i)]) for i, row in enumerate(rows))


def corpus(seed):
    draw = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for _ in range(60):
        base = draw.choices(words, k=draw.choice([1, 2, 3, 8, 12, 13, 14, 40, 90, 200]))
        rows.append(" ".join(base))
        for _ in range(draw.choice([0, 0, 1, 3, 12])):
            copy = list(base)
            for _ in range(draw.choice([0, 1, 1, 2, 4])):
                copy[draw.randrange(len(copy))] = draw.choice(words)
            rows.append(" ".join(copy).upper() if draw.random() < 0.2 else "\t".join(copy))
    rows += ["", " \n", None, "A b", "a B"]
    draw.shuffle(rows)
    return [(i + 7, text, "other") for i, text in enumerate(rows)]


@pytest.mark.parametrize(("seed", "tile_rows"), [(1, 256), (2, 4), (3, 3)])
def test_equals_all_pairs(spark, monkeypatch, seed, tile_rows):
    monkeypatch.setattr(jaccard_join, "TILE_ROWS", tile_rows)
    rows = corpus(seed)
    got = shingle_classes(spark.createDataFrame(rows, SCHEMA), tile_rows=tile_rows)
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == brute_force(rows)


def test_documents(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = shingle_classes(spark.read.parquet(f"{sf_dir}/documents.parquet")).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_force(rows)


def test_no_rows_no_ids(spark):
    assert shingle_classes(spark.createDataFrame([], SCHEMA)).collect() == []
    rows = [(None, "a b c d", ""), (4, "a b c d", ""), (4, "x y z", ""), (3, "x y z", "")]
    got = sorted(
        (r.doc_id or 0, r.component_id) for r in shingle_classes(spark.createDataFrame(rows, SCHEMA)).collect()
    )
    assert got == [(0, None), (3, 3), (4, 3), (4, 4)]


@pytest.mark.parametrize(("size", "num"), [(5, 80), (2, 60)])
def test_other_parameters(spark, monkeypatch, size, num):
    """With every third shingle taken as frequent."""
    every_third = np.arange(jaccard_join.COUNTERS) % 3 == 0
    monkeypatch.setattr(jaccard_join, "frequent_shingles", lambda docs, size: every_third)
    rows = corpus(num)
    got = shingle_classes(spark.createDataFrame(rows, SCHEMA), size=size, num=num)
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == brute_force(rows, size, num)


def test_frequent_shingles(spark):
    rows = [(i, f"own{i} words{i} of{i} text{i} a common line of words", "") for i in range(200)]
    frequent = jaccard_join.frequent_shingles(spark.createDataFrame(rows, SCHEMA), 3)
    assert frequent.sum() == 4 - 1  # the shingles inside the common line


@settings(max_examples=200, deadline=None)
@given(
    st.integers(1, 400), st.integers(0, 2**32), st.floats(0, 1), st.sampled_from([50, 80, 90, 95]),
    st.sampled_from([0, 0.1, 0.7, 1]),
)
def test_linked_sets_share_a_key(size, seed, share, num, frequent):
    draw = np.random.default_rng(seed)
    pool = np.unique(draw.integers(0, 2**64, 2 * size + 2, dtype=np.uint64))
    draw.shuffle(pool)
    changed = int(share * size * (100 - num) / 100)
    a, b = pool[:size], np.concatenate([pool[changed:size], pool[size : size + draw.integers(0, changed + 1)]])
    shared, union = len(np.intersect1d(a, b)), len(np.union1d(a, b))
    if 100 * shared >= num * union and changed:
        bands, limit = Bands(num, 100), np.uint64(int(frequent * (2**20 - 1)))
        keys = [bands.keys(x, x[(x & np.uint64(2**20 - 1)) >= limit]) for x in map(np.sort, (a, b))]
        assert np.intersect1d(*keys).size


@pytest.mark.parametrize("sketch_rows", [2, 2_048])
def test_large_classes_are_cut_by_sketches(spark, monkeypatch, sketch_rows):
    """Documents that only share a passage are tied by keys, but their texts are not dealt out."""
    monkeypatch.setattr(jaccard_join, "TILE_ROWS", 4)
    monkeypatch.setattr(jaccard_join, "SKETCH_ROWS", sketch_rows)
    draw = random.Random(5)
    passage = " ".join(f"p{i}" for i in range(14))
    rows = [(i, passage + " " + " ".join(f"w{draw.randrange(10_000)}" for _ in range(60)), "") for i in range(40)]
    rows += [(100 + i, rows[7][1] + f" end{i}", "") for i in range(3)]
    dealt, keep = [], jaccard_join.written

    def watched(df, name, *rest):
        out = keep(df, name, *rest)
        if name == "tile-texts":
            dealt.append((name, out.count()))
        return out

    monkeypatch.setattr(jaccard_join, "written", watched)
    got = shingle_classes(spark.createDataFrame(rows, SCHEMA), size=3, num=80, tile_rows=4)
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == brute_force(rows, num=80)
    assert dealt == [("tile-texts", 4)]  # 43 without the cut


@settings(max_examples=60, deadline=None)
@given(seed=st.integers(0, 10**6), n=st.integers(2, 90), num=st.sampled_from([30, 60, 80, 90]))
def test_sketches_connect_all_links(seed, n, num):
    draw = np.random.default_rng(seed)
    pool = draw.integers(0, 2**63, 300).astype(np.uint64)
    sets = [np.unique(draw.choice(pool[: draw.integers(2, 300)], draw.integers(1, 200))) for _ in range(n)]
    nodes, sizes = list(range(n)), [len(s) for s in sets]
    sketches = [jaccard_join.sketch_of(s) for s in sets]
    found = jaccard_join.compare_sketches(nodes, sizes, sketches, nodes, num, 100)
    group = list(range(n))
    for a, b in found:
        group = [group[a] if g == group[b] else g for g in group]
    assert len(found) == n - len(set(group))  # a forest
    for i in range(n):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            if 100 * both >= num * (sizes[i] + sizes[j] - both):
                assert group[i] == group[j]


def test_scratch_tables_go(spark, monkeypatch):
    """What is left in the shared folder is what the result reads."""
    folder = Path(scratch_root(spark).removeprefix("file:")) / "gridwarden"
    monkeypatch.setattr(components_module, "ONE_TASK", 3)
    setting = spark.conf.get(SHUFFLES_GO, None)
    before = set(folder.glob("*"))
    edges = [(i, i + 1) for i in range(0, 40)] + [(i, i + 1) for i in range(100, 120)]
    found = components_module.components(spark.createDataFrame(edges, "a long, b long"))
    left = set(folder.glob("*")) - before
    assert [p.name.split("-")[0] for p in left] == ["components"]
    assert Counter(r.component for r in found.collect()) == {0: 41, 100: 21}
    monkeypatch.undo()
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(i, f"{text} end{i % 5} {i // 20}", "") for i in range(40)] + [(77, "other", "")]
    kept = jaccard_join.one_of_each_class(spark.createDataFrame(rows, SCHEMA), size=3, num=80, tile_rows=4)
    assert sorted(r.doc_id for r in kept.collect()) == [0, 77]
    assert [p.name.split("-")[0] for p in set(folder.glob("*")) - before - left] == ["gone"]
    assert spark.conf.get(SHUFFLES_GO, None) == setting
