from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql.pandas.types import to_arrow_schema

from gridwarden.llm import lm_score
from gridwarden.llm.lm_score import is_held_out, score_texts

SCHEMA = "doc_id long, text string, block string"


def brute_force(rows):
    lists = [re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in t or "")) for _, t, *_ in rows]
    counts = Counter()
    for (doc_id, *_), words in zip(rows, lists):
        if not is_held_out(doc_id):
            counts.update([*words, None])
    total = sum(counts.values())
    out = []
    for (doc_id, *_), words in zip(rows, lists):
        tokens = [*words, None]
        base = sum(math.log10((counts[w] + 0.5) / (total + 0.5 * (len(counts) + 1))) for w in tokens)
        out.append((doc_id, is_held_out(doc_id), len(tokens), sum(counts[w] > 0 for w in tokens), total, base))
    return out


def check(got, rows):
    key = lambda r: (r[0] is not None, r[0] or 0, r[2], r[5])
    got = sorted((tuple(r) for r in got), key=key)
    want = sorted(brute_force(rows), key=key)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert [r[5] for r in got] == pytest.approx([r[5] for r in want])
    return got


def test_documents(spark, sf_dir, monkeypatch):
    monkeypatch.setattr("gridwarden.llm.common.SLICE_BYTES", 100_000)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = check(score_texts(spark.read.parquet(f"{sf_dir}/documents.parquet")).collect(), rows)
    assert all(r[6] < 0 and math.isfinite(r[6]) for r in got)


def test_better_than_base_on_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    base, score = score_texts(docs).where("held_out").selectExpr("sum(base_score)", "sum(score)").first()
    assert score > 0.97 * base


def first_scores(spark, trained, asked):
    """log10 P of the first token of each asked word, and of the end of an empty text."""
    held = [i for i in range(1000, 4000) if is_held_out(i)][: len(asked) + 1]
    rows = [*trained, *zip(held, asked), (held[len(asked)], "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    raw = lm_score._blocks(docs)
    used, ends = raw.selectExpr("sum(aggregate(counts, 0L, (a, x) -> a + x))", "sum(size(filter(held, x -> NOT x)))").first()
    tokens = used + ends
    blocks = lm_score._counted(raw)
    totals, types = lm_score._class_totals(blocks, tokens)
    sizes = lm_score._class_sizes(totals, types)
    weights = lm_score._train_round(blocks, lm_score._first_weights(sizes), tokens)
    batch = pa.Table.from_pylist([r.asDict() for r in blocks.collect()], to_arrow_schema(blocks.schema)).to_batches()[0]
    block = lm_score.Block(batch, 0, tokens)
    c = np.where(block.code < 0, ends, block.c[block.code])
    scores = lm_score._token_scores(block, c, weights, sizes)
    starts = dict(zip(block.doc_ids.to_pylist(), scores[block.ends - block.sizes].tolist()))
    return [starts[i] for i in held], weights


def test_probabilities_add_up(spark):
    """Over all known words, an unknown one of each ending, and the end; every context has them."""
    draw = random.Random(2)
    words = [f"w{i}" for i in range(60)] + ["often"]
    trained = [(i, " ".join(draw.choices(words, [1] * 60 + [40], k=30))) for i in range(80) if not is_held_out(i)]
    known = sorted({w for _, t in trained for w in t.split()})
    unseen, endings = [], set()
    letters = "abcdefghijklmnopqrstuvwxyz"
    for word in (f"unseen{a}{b}" for a in letters for b in letters):
        ending = zlib.crc32(word.encode()[-2:]) % (lm_score.END - lm_score.COMMON)
        if ending not in endings:
            endings.add(ending)
            unseen.append(word)
    assert len(endings) == lm_score.END - lm_score.COMMON
    scores, weights = first_scores(spark, trained, [*known, *unseen])
    assert np.abs(weights[1:]).max() > 0.01 and len(known) > 50
    assert sum(10**s for s in scores) == pytest.approx(1, abs=1e-5)


def test_softmax_and_gradient_by_hand():
    """A step over a few tokens against plain loops."""
    draw = np.random.default_rng(7)
    n, table, classes = 5, 9, 4
    features = draw.integers(1, table, (3, n)).astype(np.int32)
    labels = draw.integers(0, classes, n)
    weights = draw.normal(size=(table, classes)).astype(np.float32)
    log_shares = lm_score._log_shares(weights, features)
    want = weights.astype(float).copy()
    slopes = []
    for t in range(n):
        total = [weights[0, k] + sum(weights[f, k] for f in features[:, t]) for k in range(classes)]
        shares = [math.exp(x) / sum(map(math.exp, total)) for x in total]
        assert [math.exp(x) for x in log_shares[t]] == pytest.approx(shares, rel=1e-5)
        slopes.append([s - (k == labels[t]) for k, s in enumerate(shares)])
    squares = [1.0] * table
    for kind in [*features, [0] * n]:
        sums = {}
        for t in range(n):
            sums[kind[t]] = [a + b for a, b in zip(sums.get(kind[t], [0.0] * classes), slopes[t])]
        for row, total in sums.items():
            squares[row] += sum(x * x for x in total) / classes
            for k in range(classes):
                want[row, k] -= lm_score.RATE * total[k] / math.sqrt(squares[row])
    block = SimpleNamespace(held=np.array([False]), sizes=np.array([n]), features=features, classes=labels)
    assert lm_score._descend(weights, np.full(table, 1.0, np.float32), block) == n
    assert weights == pytest.approx(want, rel=1e-4, abs=1e-5)


def test_nulls_repeats_and_no_rows(spark):
    rows = [(None, None, ""), (1, "A a", ""), (1, "A a", ""), (2, "", ""), (3, " \n", ""), (4, "b", "")]
    check(score_texts(spark.createDataFrame(rows, SCHEMA)).collect(), rows)
    assert score_texts(spark.createDataFrame([], SCHEMA)).collect() == []

def test_words_are_counted_over_blocks_by_packed_hashes(spark, monkeypatch):
    """Each block gets, for each of its words, the count over all blocks; one block is the first."""
    monkeypatch.setattr(lm_score, "WORDS_A_PART", 7)
    draw = random.Random(4)
    texts = [" ".join(draw.choices([f"w{k}" for k in range(40)], k=25)) for _ in range(30)] + [""]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    blocks = lm_score._counted(lm_score._blocks(docs)).collect()
    counts = Counter(w for i, t in enumerate(texts) if not is_held_out(i) for w in t.split())
    want = sorted((lm_score.xxhash.xxh64_intdigest(w) & 0x7FFFFFFF, n) for w, n in counts.items())
    found = {(mark, fact >> 6) for row in blocks for mark, fact in zip(row.marks, row.facts)}
    assert len(blocks) == 3 and sorted(x for x in found if x[1]) == want
    firsts = [mark for row in blocks for mark, fact in zip(row.marks, row.facts) if fact & 1]
    assert len(firsts) == len(set(firsts)) == len({mark for mark, _ in found})
