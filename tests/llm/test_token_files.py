from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from gridwarden.llm import range_coder, token_files
from gridwarden.llm.queries import op3_token_files

PATH = public_tokenizers.path("word_bpe_49k.json")
TOKENIZER = Tokenizer.from_file(PATH)
SCHEMA = "doc_id long, text string, part string"


def expected(rows):
    out, start = [], 0
    for doc_id, text, *_ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*TOKENIZER.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((doc_id, start, ids))
        start += len(ids)
    return out


@settings(max_examples=15, deadline=None)
@given(st.integers(1, 9), st.integers(1, 5000), st.integers(0, 2**32), st.sampled_from([2, 40, 65_536]))
def test_round_trip(blocks, steps, seed, ids):
    matrix = np.random.default_rng(seed).integers(0, ids, (blocks, steps)).astype(np.uint16)
    payloads = range_coder.encode(matrix)
    assert (range_coder.decode(payloads, steps) == matrix).all()
    assert (range_coder.decode(payloads[:1], steps) == matrix[:1]).all()  # blocks stand alone


def test_repetition_is_cheap():
    matrix = np.tile(np.arange(50, dtype=np.uint16) * 991, (4, 80))
    assert sum(map(len, range_coder.encode(matrix))) < matrix.nbytes / 15


def test_damage_is_noticed():
    row = token_files.pack(np.arange(5000, dtype=np.uint16), 1000)
    assert (token_files.unpack(row) == np.arange(5000)).all()
    row["payloads"][2] = b"x" + row["payloads"][2][1:]
    with pytest.raises(ValueError, match="block 2"):
        token_files.unpack(row)


@pytest.mark.parametrize("special", [False, True])
def test_tokenizer_by_chunks(special):
    texts = ["<|endoftext|> The<|ENDOFTEXT|>"] if special else ["it's John's. 'Tis, (a.b) x.. y!? é., À.", "1.5 a1."]
    texts += ["", " ", "a  b\n\tC d", "İSTANBUL ΣΑΣ ǅ é ́x", "x　y z"]
    ids, counts = token_files.tokenize(pa.array(texts), PATH)
    ends = np.cumsum(counts)
    assert [ids[e - n : e].tolist() for e, n in zip(ends, counts)] == [
        TOKENIZER.encode(t, add_special_tokens=False).ids for t in texts
    ]


@pytest.mark.parametrize("mark", token_files.MARKS)
def test_marks_after_every_letter(mark):
    """Normalising turns some letters into others with an accent, which marks are joined to."""
    letters = [chr(c) for c in range(0x30000) if chr(c).isalpha()]
    for pattern in ("{}" + mark, "a{}" + mark * 2):
        texts = [" ".join(pattern.format(c) for c in letters[i : i + 2_000]) for i in range(0, len(letters), 2_000)]
        ids, counts = token_files.tokenize(pa.array(texts), PATH)
        want = [e.ids for e in TOKENIZER.encode_batch(texts, add_special_tokens=False)]
        assert counts.tolist() == list(map(len, want)) and ids.tolist() == [i for w in want for i in w]


def test_special_tokens_beside_other_texts():
    texts = ["<|endoftext|> A B", "A <|ENDOFTEXT|>", "a", "x<|startoftext|>Y İ!! aय़!"]
    ids, counts = token_files.tokenize(pa.array(texts), PATH)
    want = [TOKENIZER.encode(t, add_special_tokens=False).ids for t in texts]
    assert counts.tolist() == list(map(len, want)) and ids.tolist() == [i for w in want for i in w]


@pytest.mark.parametrize("segment", [7, 100_000])
def test_files(spark, tmp_path, segment):
    rows = [(5, "b c", ""), (None, "no id", ""), (3, None, ""), (9, "word " * 40_000, ""), (4, "", ""), (9, "z", "")]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    path = f"{tmp_path}/tokens"
    token_files.write_tokens(docs, path, PATH, 2, block=200, segment=segment)
    got = token_files.read_tokens(spark, path).collect()
    got = sorted(((r.doc_id, r.start, r.ids) for r in got), key=lambda r: r[1])
    want = expected(rows)
    assert [r[0] for r in got] == [r[0] for r in want]
    assert sorted(map(str, (r[2] for r in got))) == sorted(map(str, (r[2] for r in want)))
    assert [r[1] for r in got] == np.cumsum([0, *(len(r[2]) for r in got)])[:-1].tolist()
    sums = token_files.read_checksums(spark, path).collect()
    assert sorted((r.start, r.ids_crc32) for r in sums) == [
        (start, zlib.crc32(np.array(ids, dtype="<u4").tobytes())) for _, start, ids in got
    ]


def test_no_rows(spark, tmp_path):
    token_files.write_tokens(spark.createDataFrame([], SCHEMA), f"{tmp_path}/t", PATH, 2)
    assert token_files.read_tokens(spark, f"{tmp_path}/t").collect() == []


def test_documents(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    want = [
        (d, start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())) for d, start, ids in expected(rows)
    ]
    assert sorted(map(tuple, op3_token_files(spark, sf_dir).collect())) == want
