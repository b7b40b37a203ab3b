"""Digests of files of any size: fixed byte ranges hashed in parallel, then a tree of digests.

The block digest of a file is the root of a tree: its blocks of `BLOCK` bytes are hashed with
SHA-256, the digests of each `FAN` neighbours are joined and hashed, and so on until one is left.
Empty files, which Spark does not list, have no row. The digest depends on the bytes alone, and is not the SHA-256 of
the file; `registry.file_fingerprint` gives that for files that fit into one task.

Bytes are read by Spark's text reader as lines, whose own bytes it leaves alone, so any store will
do and large files are split. A first pass sums the bytes of each split, which places its lines in
the file; then a task hashes the blocks that lie within its split, and hands on the parts of the
two at its ends. A line must fit into memory; files of random bytes have one every few hundred.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridwarden.session import broadcast_if_small, written

BLOCK = 1 << 20
FAN = 1024
SPLITS_BROADCAST = 1_000_000
PIECES = "path string, block bigint, at bigint, data binary, digest binary"


def _pieces(size: int):
    """Lines with their split's place in the file, in order, to digests of whole blocks and to
    parts of blocks that the split shares with its neighbours."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, at, held = None, 0, bytearray()
        out: list[tuple] = []

        def cut(last: bool) -> None:
            """Moves the blocks that are complete, or all that is left, from held to out."""
            nonlocal at
            while held and (last or at % size + len(held) >= size):
                stop = size - at % size
                data = bytes(held[:stop])
                del held[:stop]
                whole = len(data) == size
                out.append((current[0], at // size, at, None if whole else data, hashlib.sha256(data).digest() if whole else None))
                at += len(data)

        def batch_of() -> pa.RecordBatch:
            rows = [dict(zip(("path", "block", "at", "data", "digest"), r)) for r in out]
            out.clear()
            return pa.RecordBatch.from_pylist(rows, schema)

        schema = pa.schema(
            [("path", pa.string()), ("block", pa.int64()), ("at", pa.int64()), ("data", pa.binary()), ("digest", pa.binary())]
        )
        room = 0
        for batch in batches:
            columns = (batch.column(i).to_pylist() for i in range(5))
            for path, start, first, end, line in zip(*columns):
                if (path, start) != current:
                    if current:
                        cut(True)
                    current, at, room = (path, start), first, end - first
                held += line
                room -= len(line)
                if room > 0:  # the last line of a file may have no end
                    held += b"\n"
                    room -= 1
                if len(held) >= size:
                    cut(False)
            if out:
                yield batch_of()
        if current:
            cut(True)
        if out:
            yield batch_of()

    return run


def block_fingerprint(spark: SparkSession, path: str, block: int = BLOCK, fan: int = FAN) -> DataFrame:
    """path, n_bytes, digest (hex) of every file. A path that does not exist gives one row
    `unavailable`."""
    try:
        lines = spark.read.option("lineSep", "\n").text(path)
        files = spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("n_bytes"))
    except Exception as exc:
        if "PATH_NOT_FOUND" in str(exc):
            return spark.createDataFrame([(path, None, "unavailable")], "path string, n_bytes bigint, digest string")
        raise
    lines = lines.select(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("start"),
        F.col("_metadata.file_size").alias("size"),
        F.col("value").cast("binary").alias("line"),
    )
    splits = lines.groupBy("path", "start").agg(
        F.sum(F.octet_length("line").cast("bigint") + 1).alias("n"), F.first("size").alias("size")
    )
    ends = F.least(F.sum("n").over(Window.partitionBy("path").orderBy("start")), F.col("size"))
    # one row a split, so a millionth of the bytes or less
    placed = splits.withColumn("end", ends).withColumn(
        "first", F.coalesce(F.lag("end").over(Window.partitionBy("path").orderBy("start")), F.lit(0))
    )
    placed = broadcast_if_small(written(placed.select("path", "start", "first", "end"), "splits"), SPLITS_BROADCAST)
    rows = lines.join(placed, ["path", "start"]).select("path", "start", "first", "end", "line")
    pieces = written(rows.mapInArrow(_pieces(block), PIECES), "blocks")
    # at most a block's bytes meet
    shared = pieces.where("digest IS NULL").groupBy("path", "block").agg(
        F.sort_array(F.collect_list(F.struct("at", "data"))).alias("parts")
    )
    joined = F.aggregate("parts", F.lit(b""), lambda out, p: F.concat(out, p["data"]))
    shared = shared.select("path", "block", F.unhex(F.sha2(joined, 256)).alias("digest"))
    level = written(pieces.where("digest IS NOT NULL").select("path", "block", "digest").unionByName(shared), "digests")
    roots = []
    while True:
        tops = level.groupBy("path").agg(F.max("block").alias("top"))
        level = written(level.join(tops, "path"), "digests")
        roots.append(level.where("top = 0").select("path", "digest"))
        level = level.where("top > 0")
        if level.isEmpty():
            break
        some = F.sort_array(F.collect_list(F.struct("block", "digest")))
        level = level.groupBy("path", F.floor(F.col("block") / fan).alias("above")).agg(some.alias("parts"))
        joined = F.aggregate("parts", F.lit(b""), lambda out, p: F.concat(out, p["digest"]))
        level = level.select("path", F.col("above").alias("block"), F.unhex(F.sha2(joined, 256)).alias("digest"))
    level = reduce(DataFrame.unionByName, roots)
    named = level.select(F.col("path").alias("of"), F.lower(F.hex("digest")).alias("digest"))
    return files.join(named, files.path == F.col("of")).select("path", "n_bytes", "digest")
