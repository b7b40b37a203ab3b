from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from gridwarden.llm import toxicity
from gridwarden.llm.queries import op7_toxicity

SCHEMA = "doc_id long, text string, toxic string, score double"
LABELS = "doc_id long, toxic int, text string"


def corpus(n=400):
    draw = random.Random(3)
    syllables = ["ta", "ri", "mo", "len", "sor", "vi", "ka", "de", "nu", "pel"]
    rows, labels = [], []
    for i in range(n):
        words = ["".join(draw.choices(syllables, k=draw.choice([1, 2, 3]))) for _ in range(30)]
        bad = i % 4 == 0
        if bad:
            words[draw.randrange(30)] = draw.choice(["grumbold", "grumboldly", "Grumbold!"])
        rows.append((i, " ".join(words), "t", 0.5))
        labels.append((i, int(bad), "t"))
    return rows, labels


@pytest.fixture(scope="module")
def model(spark):
    rows, labels = corpus()
    return toxicity.fit(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, LABELS))


def test_learns_the_word_and_its_beginning(model):
    assert any(f.strip() in "grumbold" for f in model.evidence)
    assert model.weight("grumboldest") > 0 and model.weight("talensor") == 0


@pytest.mark.parametrize(
    "text", ["you grumbold", "GRUMBOLD.", "grumb0ld", "gr.u.m.b.o.l.d", "g r u m b o l d", "gruuuuumbold", "gru-mb0ld!!"]
)
def test_restores_disguises(spark, model, text):
    found = toxicity.score(spark.createDataFrame([(1, text, "t", 0.0)], SCHEMA), model).first()
    assert found.score >= 0.5 and found.evidence


WORD = "grassbold"  # with a doubled letter of its own


@pytest.fixture(scope="module")
def other(spark):
    rows, labels = corpus()
    rows = [(i, text.lower().replace("grumbold", WORD), *rest) for i, text, *rest in rows]
    return toxicity.fit(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, LABELS))


def doubled():
    return [WORD[:i] + WORD[i] + WORD[i:] for i in range(len(WORD))]


def look_alikes():
    signs = {"g": "9", "a": "@", "s": "$", "b": "8", "o": "0"}
    return [WORD[:i] + signs[c] + WORD[i + 1 :] for i, c in enumerate(WORD) if c in signs]


@pytest.mark.parametrize(
    "text",
    [
        *doubled(), *look_alikes(), *map(" ".join, look_alikes()), *map(" ".join, doubled()),
        " ".join(WORD), "  ".join(WORD), "\n".join(WORD), ", ".join(WORD), "/".join(WORD), "_".join(WORD),
    ],
)
def test_restores_every_position(other, text):
    assert toxicity.Scorer(other).weigh(f"ta ri {text} mo")[1]


@pytest.mark.parametrize("text, word", [("(ou+", "cout"), ("$inu$", "sinus"), ("vi$$", "vis"), ("+a!", "tai"), ("5 t a t", "stat")])
def test_signs_at_the_ends(text, word):
    costs = toxicity.letter_costs({c: 50 for c in toxicity.trigram_codes(word)})
    assert word in toxicity.Restorer(costs).words(text)


def test_known_words_stay():
    restorer = toxicity.Restorer(toxicity.letter_costs({}), frozenset(["letter"]))
    assert restorer.words("letter, letter") == {"letter"}
    assert restorer.words("1, 2, 3, 4") == set()


def test_scores_and_filter(spark, model):
    rows = [(1, "ta ri grumbold", "t", 0.0), (2, "ta ri mo", "t", 0.0), (2, "ta ri mo", "t", 0.0), (None, None, "t", 0.0), (3, "", "t", 0.0),
            (4, "ta ri " * 40_000 + "grumbold", "t", 0.0)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = {(r.doc_id, r.score >= 0.5) for r in toxicity.score(docs, model).collect()}
    assert got == {(1, True), (2, False), (None, False), (3, False), (4, True)}
    left = toxicity.without_toxic(docs, model)
    assert left.columns == docs.columns
    assert sorted(str(r.doc_id) for r in left.collect()) == ["2", "2", "3", "None"]


def test_a_copied_text_does_not_vouch_for_its_words(spark):
    rows, labels = corpus()
    rows += [(1000 + i, "one unlucky copied sentence about turtles", "t", 0.0) for i in range(60)]
    labels += [(1000 + i, 1, "t") for i in range(60)]
    learnt = toxicity.fit(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, LABELS))
    assert learnt.weight("turtles") == 0 and learnt.weight("grumbold") > 0


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "a b", "t", 0.0)], SCHEMA)
    empty = toxicity.fit(docs, spark.createDataFrame([(None, 1, "t"), (7, 1, "t"), (1, None, "t")], LABELS))
    assert toxicity.score(docs, empty).first().score == 0
    assert toxicity.score(docs.limit(0), empty).collect() == []


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    rows = op7_toxicity(spark, folder).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in rows)
    held = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    assert sum(p == t for p, t in held) >= 0.95 * len(held)


def test_every_labelled_row_counts(spark):
    """Rows that a choice by hash of 200,000 labelled ones would leave out."""
    ids = spark.range(240_000).withColumn("h", F.pmod(F.xxhash64("id"), F.lit(2**32)))
    late = [r.id for r in ids.orderBy(F.desc("h")).limit(8).collect()]
    letters = F.translate(F.col("id").cast("string"), "0123456789", "acegikmoqs")
    bad = F.col("id").isin(late)
    text = F.when(bad, F.concat(letters, F.lit(" zorvblax "), F.reverse(letters))).otherwise(letters)
    docs = ids.select(F.col("id").alias("doc_id"), text.alias("text"))
    labels = ids.select(F.col("id").alias("doc_id"), bad.cast("int").alias("toxic"))
    learnt = toxicity.fit(docs, labels)
    assert learnt.weight("zorvblax") > 0


def test_joined_tables_give_the_same_model(spark, model, monkeypatch):
    for limit in ("WANTED", "BROADCAST_ROWS", "HELD"):
        monkeypatch.setattr(toxicity, limit, 0)
    rows, labels = corpus()
    other = toxicity.fit(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, LABELS))
    assert (other.evidence, other.known, other.costs) == (model.evidence, model.known, model.costs)
    assert other.slope == pytest.approx(model.slope) and other.offset == pytest.approx(model.offset)


def test_pairs_of_letters_decode_like_any_lattice(monkeypatch):
    """The short way through words with pairs of letters equals the whole lattice."""
    draw = random.Random(3)
    words = ["".join(draw.choices("abbl\u00e9\u00ef", k=draw.randrange(1, 12))) for _ in range(800)]
    counts = toxicity.trigram_counts({w: 1 + len(w) for w in words[:300]})
    costs = toxicity.letter_costs(counts)
    short = [toxicity.decode(w, costs) for w in words]
    monkeypatch.setattr(toxicity, "PAIRS_AT_MOST", re.compile(r"(?!)"))
    assert short == [toxicity.decode(w, costs) for w in words]


def test_trigrams_and_marks_of_many_words():
    words = {"abc": 2, "d": 5, "\u00e9t\u00e9": 1, "x\u4e00": 7, "a1": 3}
    by_word = Counter()
    for word, n in words.items():
        for code in toxicity.trigram_codes(word):
            by_word[code] += n
    assert toxicity.trigram_counts(words) == by_word
    lists = [[], ["a"], ["a", "b"], ["a", "b", "c"], list("abcdef"), [], ["z"]]
    assert toxicity._least_shingles(lists) == [toxicity._least_shingles([x])[0] for x in lists]
    assert toxicity._least_shingles([]) == []
