"""What Python workers hold: batches bounded in bytes, and nothing of stages before."""

from __future__ import annotations

import gc
import tracemalloc

import numpy as np
import public_tokenizers
import pyarrow as pa

import corpus_pipeline
from gridwarden.llm import byte_bpe, common, lm_score

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


def numbers(values):
    return pa.RecordBatch.from_arrays([pa.array(values, pa.int64())], names=["n"])


def test_workers_drop_the_tables_of_other_stages(spark):
    docs = spark.range(64).selectExpr("id AS doc_id", "concat('word', id) AS text").repartition(8).cache()
    assert docs.count() == 64

    def run(batches):
        for _ in common.slices(batches):
            pass
        yield numbers([sum(isinstance(x, byte_bpe.MergeReplay) for x in gc.get_objects())])

    assert byte_bpe.encode(docs, PATH, public_tokenizers.PATTERN).where("size(ids) > 0").count() == 64
    assert [r.n for r in docs.mapInArrow(run, "n long").collect()] == [0] * 8


def test_tables_are_made_once_a_stage(monkeypatch):
    made = []
    for stage in (1, 1, 2, 2):
        monkeypatch.setattr(common, "_stage", lambda stage=stage: stage)
        assert list(common.slices(iter([]))) == []
        assert common.held(made.append, "x") is None
    assert made == ["x", "x"]


def test_batches_of_long_texts(spark):
    docs = spark.range(0, 40, 1, 1).selectExpr("id AS doc_id", "repeat('some words ', 100000) AS text")
    limit = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.unset(limit)
    try:
        corpus_pipeline.encode(spark, docs, "unused")

        def run(batches):
            yield numbers([batch.nbytes for batch in batches])

        sizes = [r.n for r in docs.mapInArrow(run, "n long").collect()]
    finally:
        spark.conf.unset(limit)
    assert sum(sizes) > 40_000_000 and max(sizes) < corpus_pipeline.BATCH_BYTES + 3_000_000


def test_entries_for_ids_alone_and_for_the_round_trip():
    ranks = byte_bpe.read_ranks(PATH)
    texts = ["don't  stop", "", "aé\n\nzzzzqx 12345"]
    alone, both = (byte_bpe.MergeReplay(ranks, public_tokenizers.PATTERN, b) for b in (False, True))
    assert list(alone.encode(texts)) == list(both.encode(texts))
    assert all(isinstance(e, bytes) for e in alone.chunks.values())


def test_batches_of_lm_score(spark):
    docs = spark.range(0, 40, 1, 1).selectExpr("id AS doc_id", "repeat('some words ', 100000) AS text")
    limit = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.unset(limit)
    try:
        blocks = lm_score.score_texts(docs, rounds=1).count()

        def run(batches):
            yield numbers([batch.nbytes for batch in batches])

        sizes = [r.n for r in docs.mapInArrow(run, "n long").collect()]
    finally:
        spark.conf.unset(limit)
    assert blocks == 40 and sum(sizes) > 40_000_000 and max(sizes) < common.BATCH_BYTES + 3_000_000


def test_a_block_is_made_in_little_memory():
    """Its tokens take up to 48 bytes each while it is made."""
    draw = np.random.default_rng(3)
    n, words = 1_000_000, 5_000
    codes = draw.integers(0, words, n).astype(np.int32)
    lengths = np.full(1_000, n // 1_000, np.int32)
    found = {
        "doc_ids": pa.array([list(range(1_000))], pa.list_(pa.int64())),
        "held": pa.array([[False] * 1_000], pa.list_(pa.bool_())),
        "lengths": pa.array([lengths], pa.list_(pa.int32())),
        "codes": pa.array([lm_score._squeeze(codes)], pa.binary()),
        "marks": pa.array([draw.integers(0, 1 << 31, words).astype(np.int32)], pa.list_(pa.int32())),
        "facts": pa.array([np.full(words, 64 * 200, np.int64)], pa.list_(pa.int64())),
    }
    batch = pa.RecordBatch.from_pydict(found)
    tracemalloc.start()
    try:
        block = lm_score.Block(batch, 0, n)
        _, most = tracemalloc.get_traced_memory()
    finally:
        tracemalloc.stop()
    assert len(block.code) == n + 1_000 and most < 48 * n


def test_tasks_over_blocks_give_memory_back(monkeypatch):
    calls = []
    monkeypatch.setattr(common, "release", lambda: calls.append("release"))
    for batch in common.alone(iter(["a", "b"])):
        calls.append(batch)
    assert calls == ["release", "a", "b", "release"]
