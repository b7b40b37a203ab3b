from __future__ import annotations

import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from gridwarden.llm import byte_bpe
from gridwarden.llm.byte_bpe import MergeReplay, decode, encode, read_ranks, round_trip_digests

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
RANKS = read_ranks(PATH)
CODER = MergeReplay(RANKS, public_tokenizers.PATTERN)
LIBRARY = tiktoken.Encoding(
    "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={}
)
TEXTS = [
    "", " ", "  \n\n x", "don't we'll THEY'RE", "a  b \n\tc　d e\x1cf\xa0g ",
    "äöü ñandú — 数字123,456", "x" * 3000, "ab" * 2000 + " " * 500, "<|endoftext|>", "\x00\x85 é́",
]


def test_equals_the_library():
    assert [tuple(i) for i in CODER.encode(TEXTS)] == [
        tuple(LIBRARY.encode_ordinary(t)) for t in TEXTS
    ]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=["Cs"]), max_size=60), max_size=5))
def test_any_text(texts):
    got = list(CODER.encode(texts))
    assert got == [LIBRARY.encode_ordinary(t) for t in texts]
    assert [CODER.decode(i) for i in got] == [t.encode() for t in texts]


def test_a_new_pair_of_lower_rank_goes_first():
    letters = {bytes([b]): 1000 + b for b in range(256)}
    ranks = {**letters, b"bc": 5, b"abc": 2, b"aa": 7}
    library = tiktoken.Encoding("odd", pat_str=r"\w+", mergeable_ranks=ranks, special_tokens={})
    text = "abcbcaabcaaabc"
    assert list(MergeReplay(ranks, r"\w+").encode([text]))[0] == library.encode_ordinary(text)


@pytest.mark.parametrize("rows", [[], [(1, None, 1), (None, "a b", 2), (3, "x y", 3), (3, "x y", 4)]])
def test_frames(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids long")
    tokens = encode(docs, PATH, public_tokenizers.PATTERN)
    assert {(r.doc_id, tuple(r.ids)) for r in tokens.collect()} == {
        (d, tuple(LIBRARY.encode_ordinary(t or ""))) for d, t, _ in rows
    }
    back = decode(tokens, PATH, public_tokenizers.PATTERN).collect()
    assert sorted((r.doc_id or 0, bytes(r.data)) for r in back) == sorted(
        (d or 0, (t or "").encode()) for d, t, _ in rows
    )
    assert round_trip_digests(docs, PATH, public_tokenizers.PATTERN).count() == len(rows)


def test_whole_table(spark, sf_dir):
    """Every document, against the library."""
    import hashlib

    from gridwarden.llm.queries import op1_byte_bpe

    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for row in op1_byte_bpe(spark, sf_dir).collect():
        ids = LIBRARY.encode_ordinary(texts[row.doc_id])
        assert row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(texts[row.doc_id].encode()).hexdigest()


def test_pairs_are_all_known_before_the_first_text():
    """A pair merges exactly if its bytes are a token; looking up needs no bytes and adds no entries."""
    coder = MergeReplay(RANKS, public_tokenizers.PATTERN)
    draw, known = random.Random(5), len(coder.pairs)
    left, right = (np.array([draw.choice(list(coder.token)[:900]) for _ in range(20_000)]) for _ in range(2))
    want = [RANKS.get(coder.token[a] + coder.token[b], -1) for a, b in zip(left.tolist(), right.tolist())]
    assert coder._merged_all(left, right).tolist() == want and max(want) > 0
    assert coder._merged_all(np.array([-1, -2, 5]), np.array([5, 5, -1])).tolist() == [-1] * 3
    words = ["".join(draw.choices("etaoin shrdlu", k=9)) for _ in range(500)]
    assert list(coder.encode(words)) == [LIBRARY.encode_ordinary(w) for w in words]
    assert len(coder.pairs) == known


def test_single_merges_need_few_array_calls(monkeypatch):
    """Ranks with a few hundred places are merged place by place: array calls would take longer."""
    coder = MergeReplay(RANKS, public_tokenizers.PATTERN)
    calls, merge = [], coder._merged_all
    monkeypatch.setattr(coder, "_merged_all", lambda *a: calls.append(1) or merge(*a))
    draw = random.Random(6)
    pieces = sorted({"".join(draw.choices("etaoinshrdlu", k=7)) for _ in range(600)})
    got = coder.replay([p.encode() for p in pieces])
    assert [list(ids) for ids in got] == [LIBRARY.encode_ordinary(p) for p in pieces]
    assert len(calls) < 20


@pytest.mark.parametrize("many", [2, 10**9])
def test_places_one_by_one_and_by_arrays(monkeypatch, many):
    monkeypatch.setattr(byte_bpe, "MANY", many)
    coder = MergeReplay(RANKS, public_tokenizers.PATTERN)
    draw = random.Random(7)
    texts = ["".join(draw.choices("aabno", k=draw.randrange(1, 40))) for _ in range(3_000)]
    assert list(coder.encode(texts)) == [LIBRARY.encode_ordinary(t) for t in texts]
