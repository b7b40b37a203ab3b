"""Exact deduplication by a cuckoo filter over live digests.

Each task keeps a cuckoo filter whose slots hold a 16-bit fingerprint and point to the stored
key (the full digest) of the text. A fingerprint hit is verified against the stored key, an
insertion that finds no room moves others to their second bucket, and when that fails the
filter is rebuilt from the stored keys with twice the buckets.

The index of a corpus is built in two steps: a task-local index over the rows of one input
partition, which also shrinks a hot group of copies to one entry a task, and then one index a
digest bucket over these entries. Both are bounded: the first by the input partition, the
second by `bucket_rows`, as the number of buckets follows the number of entries.

Defined results: null text counts as empty; texts are equal when identical after lower-casing
A-Z only; of equal texts the row with the largest id stays, null ids only if all are null.
Rows that repeat both id and text are one document: all of them are reported as kept (or
dropped) and `deduplicate` returns one of them. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridwarden.llm.common import as_bytes, slices
from gridwarden.session import written

SLOTS = 4
MAX_MOVES = 200
BUCKET_ROWS = 50_000
INDEX_SCHEMA = "digest binary, keep_id long, keep_rows long, group_size long"


class CuckooIndex:
    """Live digests with insertion and deletion: (keep_id, keep_rows, group_size) of each."""

    def __init__(self, buckets: int = 64):
        self.rebuilds = 0
        self._clear(buckets)

    def _clear(self, buckets: int) -> None:
        self.buckets = buckets
        self.prints = array("H", bytes(2 * SLOTS * buckets))  # 0: free
        self.slots: list[list | None] = [None] * (SLOTS * buckets)
        self.live = 0

    @staticmethod
    def _print(digest: bytes) -> int:
        return int.from_bytes(digest[:2], "little") or 1

    def _first(self, digest: bytes) -> int:
        return int.from_bytes(digest[2:10], "little") & (self.buckets - 1)

    def _other(self, bucket: int, mark: int) -> int:
        return bucket ^ ((mark * 0x5BD1E995) & (self.buckets - 1))

    def _slot(self, digest: bytes) -> int:
        """The slot of a live digest, or -1. Fingerprint hits are verified on the stored key."""
        mark, bucket = self._print(digest), self._first(digest)
        for place in (bucket, self._other(bucket, mark)):
            for slot in range(place * SLOTS, place * SLOTS + SLOTS):
                if self.prints[slot] == mark and self.slots[slot][0] == digest:
                    return slot
        return -1

    def get(self, digest: bytes) -> list | None:
        slot = self._slot(digest)
        return self.slots[slot] if slot >= 0 else None

    def delete(self, digest: bytes) -> bool:
        slot = self._slot(digest)
        if slot < 0:
            return False
        self.prints[slot], self.slots[slot] = 0, None
        self.live -= 1
        return True

    def add(self, digest: bytes, keep_id: int | None, keep_rows: int, group_size: int) -> None:
        """Insert a digest, or merge into the live one: the larger id stays."""
        entry = self.get(digest)
        if entry is None:
            self._place([digest, keep_id, keep_rows, group_size])
            return
        entry[3] += group_size
        if entry[1] == keep_id:
            entry[2] += keep_rows
        elif entry[1] is None or (keep_id is not None and keep_id > entry[1]):
            entry[1], entry[2] = keep_id, keep_rows

    def _place(self, entry: list) -> None:
        mark, bucket = self._print(entry[0]), self._first(entry[0])
        for move in range(MAX_MOVES):
            for place in (bucket, self._other(bucket, mark)):
                for slot in range(place * SLOTS, place * SLOTS + SLOTS):
                    if not self.prints[slot]:
                        self.prints[slot], self.slots[slot] = mark, entry
                        self.live += 1
                        return
            slot = bucket * SLOTS + move % SLOTS
            entry, self.slots[slot] = self.slots[slot], entry
            mark, self.prints[slot] = self.prints[slot], mark
            bucket = self._other(bucket, mark)
        self._rebuild(entry)

    def _rebuild(self, homeless: list) -> None:
        """Overflow: twice the buckets, filled from the stored keys."""
        entries = [*self, homeless]
        self.rebuilds += 1
        self._clear(2 * self.buckets)
        for entry in entries:
            self._place(entry)

    def __iter__(self) -> Iterator[list]:
        return (entry for entry in self.slots if entry is not None)

    def __len__(self) -> int:
        return self.live


def _index_batch(entries: list[list]) -> pa.RecordBatch:
    columns = zip(*entries) if entries else ((), (), (), ())
    kinds = (pa.binary(), pa.int64(), pa.int64(), pa.int64())
    names = ("digest", "keep_id", "keep_rows", "group_size")
    return pa.RecordBatch.from_arrays(
        [pa.array(list(c), kind) for c, kind in zip(columns, kinds)], names=list(names)
    )


def _digest(data: bytes) -> bytes:
    return hashlib.sha256(data.lower()).digest()  # bytes.lower() changes A-Z only


def with_digest(docs: DataFrame, text_col: str = "text", name: str = "digest") -> DataFrame:
    """All columns and the SHA-256 of the normalised text."""
    at = docs.columns.index(text_col)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.RecordBatch.from_arrays([batch.column(at)], names=["text"])
            digests = pa.array([_digest(t) for t in as_bytes(texts)], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, digests], names=[*batch.schema.names, name]
            )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from add(slices(batches, text=text_col))

    schema = docs.schema
    return docs.mapInArrow(cut, schema.__class__(list(schema)).add(name, "binary"))


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and digest of every row."""
    pair = docs.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"),
        F.col(f"`{text_col}`").cast("string").alias("text"),
    )
    return with_digest(pair).select("doc_id", "digest")


def _local_index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    index = CuckooIndex()
    for batch in batches:
        for doc_id, digest in zip(
            batch.column(0).to_pylist(), batch.column(1).to_pylist()
        ):
            index.add(digest, doc_id, 1, 1)
    yield _index_batch(list(index))


def _merge_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by (bucket, step): stored entries, then deletions, then insertions."""
    index, current = CuckooIndex(), None
    for batch in batches:
        for bucket, step, digest, keep_id, keep_rows, size in zip(
            *(batch.column(i).to_pylist() for i in range(6))
        ):
            if bucket != current:
                if len(index):
                    yield _index_batch(list(index))
                index, current = CuckooIndex(), bucket
            if step == 1:
                index.delete(digest)
            else:
                index.add(digest, keep_id, keep_rows, size)
    yield _index_batch(list(index))


def _merge(changes: DataFrame, rows: int, bucket_rows: int) -> DataFrame:
    buckets = max(1, -(-rows // bucket_rows))
    spread = changes.select(
        F.pmod(F.xxhash64("digest"), F.lit(buckets)).alias("bucket"),
        "step", "digest", "keep_id", "keep_rows", "group_size",
    )
    tasks = max(buckets, int(changes.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return (
        spread.repartition(tasks, "bucket")
        .sortWithinPartitions("bucket", "step")
        .mapInArrow(_merge_buckets, INDEX_SCHEMA)
    )


def build_index(keys: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """The index over (doc_id, digest) rows: one row a live digest."""
    local = written(keys.select("doc_id", "digest").mapInArrow(_local_index, INDEX_SCHEMA), "cuckoo")
    return _merge(local.withColumn("step", F.lit(2)), local.count(), bucket_rows)


def update_index(
    index: DataFrame,
    inserts: DataFrame | None = None,
    deletes: DataFrame | None = None,
    bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """A new index: digests in `deletes` are removed, then (doc_id, digest) rows are inserted."""
    changes = index.withColumn("step", F.lit(0))
    if deletes is not None:
        gone = deletes.select("digest").selectExpr(
            "digest", "CAST(NULL AS LONG) AS keep_id", "0L AS keep_rows", "0L AS group_size", "1 AS step"
        )
        changes = changes.unionByName(gone)
    if inserts is not None:
        new = inserts.select("doc_id", "digest").mapInArrow(_local_index, INDEX_SCHEMA)
        changes = changes.unionByName(new.withColumn("step", F.lit(2)))
    changes = written(changes, "cuckoo-changes")
    return _merge(changes, changes.count(), bucket_rows)


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row with the row that stays: doc_id, keep_id, group_size, kept, digest."""
    keys = written(digests(docs, id_col, text_col), "digests")
    index = build_index(keys)
    return keys.join(index, "digest").select(
        "doc_id", "keep_id", "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "digest",
    )


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with their columns. Rows repeating id and text give one row."""
    marked = with_digest(docs, text_col, "__digest")
    index = build_index(written(digests(docs, id_col, text_col), "digests")).select(
        F.col("digest").alias("__digest"), F.col("keep_id").alias("__keep"),
        (F.col("keep_rows") > 1).alias("__repeated"),
    )
    stay = marked.join(index, "__digest").where(
        F.col(f"`{id_col}`").cast("long").eqNullSafe(F.col("__keep"))
    )
    once = stay.where("NOT __repeated")
    several = stay.where("__repeated").dropDuplicates(["__digest"])
    return once.unionByName(several).select(*[F.col(f"`{c}`") for c in docs.columns])
