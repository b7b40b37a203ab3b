"""The store of ids seen before: answers, files that are read, replays, compaction."""

from __future__ import annotations

import random

import numpy as np
import pytest

from gridwarden.session import scratch_path
from gridwarden.streaming.seen import SeenIds, _filter_rows, may_hold


def frame(spark, ids):
    return spark.createDataFrame([(i, "x") for i in ids], "id string, bucket string")


def known(store, spark, ids, batch):
    return sorted(map(repr, (r.id for r in store.earlier(frame(spark, ids), batch).collect())))


@pytest.mark.parametrize("compact_every", [16, 2])
def test_against_a_set(spark, compact_every):
    draw = random.Random(compact_every)
    store = SeenIds(spark, scratch_path(spark, "seen"), buckets=8, compact_every=compact_every)
    brought: list[set] = []
    for batch in range(5):
        ids = [draw.choice([None, "", str(draw.randrange(300))]) for _ in range(60)]
        before = set().union(*brought)
        assert known(store, spark, ids, batch) == sorted(map(repr, before & set(ids)))
        store.add(frame(spark, set(ids) - before), batch)
        brought.append(set(ids) - before)
    # a batch that is replayed sees what was before it, and replaces its own
    before = set().union(*brought[:3])
    assert known(store, spark, [None, *map(str, range(300))], 3) == sorted(map(repr, before & {None, *map(str, range(300))}))
    store.add(frame(spark, brought[3]), 3)
    assert known(store, spark, map(str, range(300)), 5) == sorted(repr(i) for i in set().union(*brought) if i)


def test_new_ids_open_no_files(spark, monkeypatch):
    store = SeenIds(spark, scratch_path(spark, "seen"), buckets=32)
    store.add(frame(spark, [f"old{i}" for i in range(2_000)]), 0)
    read = []
    original = SeenIds.opened

    def opened(self, batch_id, buckets):
        found = original(self, batch_id, buckets)
        read.append(len(found.inputFiles()) and len(buckets))
        return found

    monkeypatch.setattr(SeenIds, "opened", opened)
    assert known(store, spark, [f"new{i}" for i in range(20)], 1) == [] and sum(read) <= 1
    read.clear()
    assert known(store, spark, ["old5", *(f"new{i}" for i in range(20))], 1) == ["'old5'"]
    assert 1 <= sum(read) <= 2
    files = original(store, 1, [3]).where("id IS NOT NULL")
    files.collect()
    scans = files._jdf.queryExecution().executedPlan().collectLeaves()
    counts = [scans.apply(i).metrics().get("numFiles") for i in range(scans.size())]
    assert sum(c.get().value() for c in counts if c.isDefined()) == 1


def test_filters():
    import pyarrow as pa

    draw = np.random.default_rng(1)
    h1, h2 = draw.integers(-(2**63), 2**63, (2, 3_000))
    batch = pa.RecordBatch.from_arrays([pa.array(np.repeat([1, 4], 1500)), pa.array(h1), pa.array(h2)], names=["b", "h1", "h2"])
    parts = [batch.slice(i, 700) for i in range(0, 3_000, 700)]
    tables = {r["bucket"]: r["bits"] for out in _filter_rows(1 << 15)(iter(parts)) for r in out.to_pylist()}
    assert sorted(tables) == [1, 4]
    assert may_hold(tables[1], h1[:1500], h2[:1500]).all() and may_hold(tables[4], h1[1500:], h2[1500:]).all()
    others = draw.integers(-(2**63), 2**63, (2, 20_000))
    assert may_hold(tables[1], *others).mean() < 0.01
