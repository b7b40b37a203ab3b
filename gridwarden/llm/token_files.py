"""Token ids in binary files, compressed by an adaptive context-mixing range coder.

Documents are dealt by ranges of their id and sorted, so files and the rows in them are in
ascending order. A task tokenizes its documents and cuts them into segments, each closed as soon
as it holds `SEGMENT` ids; a segment is one row: the ids and lengths of its documents, and its
blocks, each coded on its own from a fresh state, with a CRC-32 of its payload and one of its
ids. At most `SIDE_BY_SIDE` blocks are coded at a time, also in the segment of a huge document. Reading checks both. The files are Parquet files of such rows, so
any store that Spark can write will do, and a segment is read without its neighbours.

The token stream begins at 0; a document starts where all documents before it end. That number
is computed from the sizes of segments when reading: sums by file part, then within a part.

Texts are cut at spaces, of which the tokenizer keeps none, and only chunks that are not known
yet are tokenized; their ids are kept for at most `CACHE` chunks beyond those of one slice.

Defined results: null text counts as empty and has the end id alone; documents without an id
come first; rows that repeat an id follow each other by a hash of their text, equal rows in any
order; an empty table gives an empty file. Ids must be below 65,536.
"""

from __future__ import annotations

import os
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridwarden.llm import range_coder
from gridwarden.llm.common import id_text, slices

CACHE = 400_000
MARKS = ".,;:!?"
BLOCK = 4_096  # ids
SIDE_BY_SIDE = 2_048  # blocks
SEGMENT = SIDE_BY_SIDE * BLOCK  # ids
SCHEMA = (
    "part int, segment int, doc_ids array<long>, lengths array<int>, "
    "n_ids int, steps int, payloads array<binary>, payload_crcs array<long>, id_crcs array<long>"
)


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path), {}


def tokenize(texts: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """All ids of the texts (an array without nulls) in one array, and their number by text."""
    tokenizer, known = _tokenizer(path)
    cut = pc.split_pattern(texts, " ")
    chunks = cut.flatten().dictionary_encode()
    words = chunks.dictionary  # in lower case, as the tokenizer does, but for its special tokens
    here = pc.if_else(pc.match_substring(words, "<|"), words, pc.ascii_lower(words)).to_pylist()
    new = list({c for c in here if c not in known})
    # A word and the marks after it are tokenized apart, so they are looked up apart. Not so if
    # normalising turns the end of the word into a mark or an accent, which marks may follow.
    stems = [c.rstrip(MARKS) for c in new]
    whole = [s if s.isascii() else tokenizer.normalizer.normalize_str(s) for s in stems]
    stems = [s if w.isalpha() else c for s, w, c in zip(stems, whole, new)]
    ends = [c[len(s) :] for s, c in zip(stems, new)]
    fresh = [c for c in {*stems, *ends} if c not in known]
    for start in range(0, len(fresh), 10_000):
        part = fresh[start : start + 10_000]
        for chunk, encoding in zip(part, tokenizer.encode_batch_fast(part, add_special_tokens=False)):
            ids = encoding.ids
            if ids and max(ids) > 65_535:
                raise ValueError("ids above 65,535 do not fit these files")
            known[chunk] = array("H", ids).tobytes()
    for chunk, stem, end in zip(new, stems, ends):
        if end:
            known[chunk] = known[stem] + known[end]
    pieces = list(map(known.__getitem__, here))
    sizes = np.fromiter(map(len, pieces), np.int64, len(pieces)) // 2
    starts = np.cumsum(sizes) - sizes
    flat = np.frombuffer(b"".join(pieces), np.uint16)
    codes = chunks.indices.to_numpy()
    lengths = sizes[codes]
    ends = np.cumsum(lengths)
    at = np.arange(ends[-1] if len(ends) else 0)
    at += np.repeat(starts[codes] - (ends - lengths), lengths)
    if len(known) > CACHE + 2 * len(here):
        known.clear()
        known.update(zip(here, pieces))
    upto = np.concatenate([[0], ends])[np.cumsum(pc.list_value_length(cut).to_numpy())]
    return flat[at], np.diff(upto, prepend=0)


def pack(ids: np.ndarray, block: int) -> dict:
    """The blocks of one segment, of nearly equal length; the last ids of the last are zeros."""
    blocks = max(1, -(-len(ids) // block))
    steps = -(-len(ids) // blocks)
    matrix = np.zeros(blocks * steps, dtype=np.uint16)
    matrix[: len(ids)] = ids
    matrix = matrix.reshape(blocks, steps)
    payloads = []
    for start in range(0, blocks, SIDE_BY_SIDE):
        payloads += range_coder.encode(matrix[start : start + SIDE_BY_SIDE])
    return {
        "n_ids": len(ids),
        "steps": steps,
        "payloads": payloads,
        "payload_crcs": [zlib.crc32(p) for p in payloads],
        "id_crcs": [zlib.crc32(row.astype("<u2").tobytes()) for row in matrix],
    }


def unpack(row: dict) -> np.ndarray:
    """The ids of a segment; an error if a block is damaged."""
    for nth, (payload, crc) in enumerate(zip(row["payloads"], row["payload_crcs"])):
        if zlib.crc32(payload) != crc:
            raise ValueError(f"block {nth} is damaged: its payload has another checksum")
    payloads = row["payloads"]
    matrix = np.concatenate(
        [
            range_coder.decode(payloads[start : start + SIDE_BY_SIDE], row["steps"])
            for start in range(0, len(payloads), SIDE_BY_SIDE)
        ]
    )
    for nth, crc in enumerate(row["id_crcs"]):
        if zlib.crc32(matrix[nth].astype("<u2").tobytes()) != crc:
            raise ValueError(f"block {nth} is damaged: its ids have another checksum")
    return matrix.reshape(-1)[: row["n_ids"]]


def write_tokens(
    docs: DataFrame,
    path: str,
    tokenizer: str,
    end_id: int,
    id_col: str = "doc_id",
    text_col: str = "text",
    block: int = BLOCK,
    segment: int = SEGMENT,
) -> None:
    """Tokenize all documents and write the files below `path`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, nth = TaskContext.get().partitionId(), 0
        ids, lengths, held = [], [], []

        def row() -> pa.RecordBatch:
            found = {"part": part, "segment": nth, "doc_ids": ids, "lengths": lengths}
            return pa.RecordBatch.from_pylist([found | pack(np.concatenate(held), block)], schema=kinds)

        size = 0
        for piece in slices(batches):
            flat, counts = tokenize(pc.fill_null(piece.column("text"), ""), tokenizer)
            start = 0
            for doc_id, count in zip(piece.column("doc_id").to_pylist(), counts.tolist()):
                ids.append(doc_id)
                lengths.append(count + 1)
                held.append(np.append(flat[start : start + count], np.uint16(end_id)))
                start += count
                size += count + 1
                if size >= segment:
                    yield row()
                    nth, ids, lengths, held, size = nth + 1, [], [], [], 0
        if size:
            yield row()

    kinds = _arrow_schema()
    rows = id_text(docs, id_col, text_col).withColumn("tie", F.xxhash64("text"))
    rows = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    rows.select("doc_id", "text").mapInArrow(run, SCHEMA).write.mode("overwrite").parquet(path)


def _arrow_schema() -> pa.Schema:
    return pa.schema(
        [
            ("part", pa.int32()), ("segment", pa.int32()), ("doc_ids", pa.list_(pa.int64())),
            ("lengths", pa.list_(pa.int32())), ("n_ids", pa.int32()),
            ("steps", pa.int32()), ("payloads", pa.list_(pa.binary())),
            ("payload_crcs", pa.list_(pa.int64())), ("id_crcs", pa.list_(pa.int64())),
        ]
    )


def _starts(files: DataFrame) -> DataFrame:
    """part, segment, start: ids before each segment."""
    sizes = files.select("part", "segment", "n_ids")
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("size"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("part_start"))
    inside = Window.partitionBy("part").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    return (
        sizes.withColumn("ahead", F.coalesce(F.sum("n_ids").over(inside), F.lit(0)))
        .join(parts, "part")
        .select("part", "segment", (F.col("part_start") + F.col("ahead")).alias("start"))
    )


def _read(spark: SparkSession, path: str, value, kind: str, arrow_kind: pa.DataType) -> DataFrame:
    """doc_id, start, n_tokens and a value computed from the ids of each document."""
    files = spark.read.schema(SCHEMA).parquet(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for nth in range(batch.num_rows):
                row = batch.slice(nth, 1).to_pylist()[0]
                ids = unpack(row)
                lengths = np.array(row["lengths"], dtype=np.int64)
                ends = np.cumsum(lengths)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([row["part"]] * len(ends), pa.int32()),
                        pa.array([row["segment"]] * len(ends), pa.int32()),
                        pa.array(row["doc_ids"], pa.int64()),
                        pa.array(ends - lengths),
                        pa.array(lengths),
                        pa.array([value(ids[e - n : e]) for e, n in zip(ends, lengths)], arrow_kind),
                    ],
                    names=["part", "segment", "doc_id", "ahead", "n_tokens", "value"],
                )

    out = f"part int, segment int, doc_id long, ahead long, n_tokens long, value {kind}"
    return files.mapInArrow(run, out).join(_starts(files), ["part", "segment"]).select(
        "doc_id", (F.col("start") + F.col("ahead")).alias("start"), "n_tokens", "value"
    )


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids of every document in the files."""
    rows = _read(spark, path, lambda ids: ids.astype(np.int32), "array<int>", pa.list_(pa.int32()))
    return rows.withColumnRenamed("value", "ids")


def read_checksums(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the files; the checksum is of the
    ids as little-endian 32-bit integers."""
    rows = _read(spark, path, lambda ids: zlib.crc32(ids.astype("<u4").tobytes()), "long", pa.int64())
    return rows.withColumnRenamed("value", "ids_crc32")
