"""The pipeline, stage by stage, each against a plain version of what it must keep."""

from __future__ import annotations

import random
import re

import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline
from gridwarden.llm import toxicity
from gridwarden.llm.byte_bpe import read_ranks

DOCS = "doc_id long, text string, lang string, source string, n_chars long, node string, `class` int"
LIBRARY = tiktoken.Encoding(
    "own", pat_str=public_tokenizers.PATTERN, special_tokens={},
    mergeable_ranks=read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")),
)


def lower(text):
    return "".join(c.lower() if c.isascii() else c for c in text or "")


def made_up():
    """Documents with copies, near copies, passages, toxic words, nulls, and ids that repeat."""
    draw = random.Random(12)
    words = ["".join(draw.choices("bcdfglmnprst", k=2)) + draw.choice(["ora", "ine", "ulo", "ety"]) + str(i % 9) for i in range(400)]
    items = [(i, " ".join(draw.choices(words, k=k))) for i, k in enumerate([4, 10, 14, 30])]
    items += [(8, ""), (9, None), (None, " ".join(draw.choices(words, k=12)))]
    rows, labels = [], []

    def add(text, doc_id=None):
        rows.append((len(rows) + 1 if doc_id is None else doc_id, text, "en", "s", 7, "x", 3))
        return rows[-1][0]

    for i in range(120):
        text = draw.choices(words, k=draw.choice([1, 4, 20, 60, 120]))
        kind = i % 6
        if kind == 1:
            text[3:3] = draw.choice([t for _, t in items if t]).split()
        if kind == 2:
            text[1:1] = ["scumbag"] * draw.randint(1, 2)
        first = add(" ".join(text))
        if i % 3:
            labels.append((first, int(kind == 2)))
        for _ in range(draw.choice([0, 0, 1, 3])):
            copy = list(text)
            if len(copy) > 50:
                copy[draw.randrange(len(copy))] = draw.choice(words)
            add(draw.choice([str.upper, str])(" ".join(copy)))
    for text in (None, "", " \n", None):
        add(text)
    near = " ".join(draw.choices(words, k=80))
    shared = add(near)
    add(near + " " + words[0])
    add(" ".join(draw.choices(words, k=70)), shared)  # another text under the same id
    add(near + " " + words[1] + " " + words[2], 100_000)
    add(" ".join(draw.choices(words, k=70)), 100_000)  # of two texts of this id one is a near copy
    rows.append((None, "no id", "en", "s", 7, "x", 3))
    return rows, labels, items


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rows, labels, items = made_up()
    path = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(rows, DOCS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path), rows, items


def kept(df):
    assert df.columns == ["doc_id", "text", "lang", "source", "n_chars", "node", "class"]
    return sorted(map(repr, (tuple(r) for r in df.collect())))


def listed(rows):
    return sorted(map(repr, rows))


def without_copies(rows):
    best = {}
    for row in rows:
        held = best.get(lower(row[1]))
        if held is None or (row[0] is not None and (held[0] is None or row[0] > held[0])):
            best[lower(row[1])] = row
    return list(best.values())


def without_near_copies(rows):
    sets = []
    for row in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", lower(row[1]))
        span = min(5, len(words))
        sets.append({tuple(words[i : i + span]) for i in range(len(words) - span + 1)} if words and row[0] is not None else set())
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    least = {}
    for i, row in enumerate(rows):
        if row[0] is not None:
            least[root(i)] = min(least.get(root(i), row[0]), row[0])
    stay = {row[0] for i, row in enumerate(rows) if row[0] is not None and row[0] == least[root(i)]}
    return [row for row in rows if row[0] is None or row[0] in stay]


def without_passages(rows, items):
    pattern = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    windows = set()
    for name, text in items:
        words = re.findall(pattern, lower(text))
        span = min(10, len(words))
        if name is not None and words:
            windows |= {tuple(words[i : i + span]) for i in range(len(words) - span + 1)}
    spans = {len(w) for w in windows}
    out = []
    for row in rows:
        words = re.findall(pattern, lower(row[1]))
        if not any(tuple(words[i : i + k]) in windows for k in spans for i in range(len(words) - k + 1)):
            out.append(row)
    return out


def test_stages(spark, folder):
    path, rows, items = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)

    left = stages["toxicity"](spark, docs, path)
    model = toxicity.fit(docs, spark.read.parquet(f"{path}/labels.parquet"))
    scorer = toxicity.Scorer(model)
    want = [r for r in rows if model.score(scorer.weigh(r[1] or "")[0]) < 0.5]
    assert kept(left) == listed(want)
    assert not any("scumbag" in lower(r[1]) for r in want) and len(want) >= len(rows) - sum("scumbag" in lower(r[1]) for r in rows)

    left = stages["exact dedup"](spark, spark.createDataFrame(want, DOCS), path)
    want = without_copies(want)
    got = kept(left)
    assert len(got) == len(want) and {lower(eval(r)[1]) for r in got} == {lower(r[1]) for r in want}
    assert {eval(r)[0] for r in got} == {r[0] for r in want}
    want = [eval(r) for r in got]

    left = stages["n-gram Jaccard join"](spark, spark.createDataFrame(want, DOCS), path)
    before, want = want, without_near_copies(want)
    assert kept(left) == listed(want) and len(want) < len(before)
    for text in (r[1] for r in rows[-6:] if r[1] and len(r[1].split()) == 70):
        assert any(r[1] == text for r in want)  # texts that share an id with a copy

    left = stages["benchmark decontamination"](spark, spark.createDataFrame(want, DOCS), path)
    before, want = want, without_passages(want, items)
    assert kept(left) == listed(want) and len(want) < len(before)

    tokens = stages["byte-level BPE"](spark, spark.createDataFrame(want, DOCS), path).collect()
    assert sorted((repr(r.doc_id), r.ids, r.n_tokens) for r in tokens) == sorted(
        (repr(r[0]), ids, len(ids)) for r in want for ids in [LIBRARY.encode_ordinary(r[1] or "")]
    )
    assert corpus_pipeline.run(spark, path).count() == len(want)


def test_empty_tables(spark, tmp_path):
    for name, schema in (("documents", DOCS), ("labels", "doc_id long, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns == ["doc_id", "n_tokens", "ids"] and out.collect() == []
