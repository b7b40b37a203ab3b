"""Helpers shared by the operators: reading tables, and cutting Arrow batches into bounded slices."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SLICE_BYTES = 8 << 20
BATCH_BYTES = 8 << 20


def sized(spark: SparkSession) -> None:
    """Rows go to Python in batches of so many bytes: Spark's own limit is 64 MB, and each batch is
    held several times, by the executor and by its Python workers."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def id_text(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The two columns that an operator reads, under fixed names; other columns cannot clash."""
    return df.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"),
        F.col(f"`{text_col}`").cast("string").alias("text"),
    )


_held: dict[tuple, object] = {}  # what tasks of a stage leave to later ones in the same worker


def _stage() -> int | None:
    context = TaskContext.get()
    return context.stageId() if context else None


def held(make: Callable, *args):
    """`make(*args)`, made once by a Python worker for all tasks of a stage."""
    key = (_stage(), make, args)
    if key not in _held:
        _held[key] = make(*args)
    return _held[key]


@lru_cache(maxsize=1)
def _trim() -> Callable[[int], object]:
    """The C library's call that gives free memory back, where there is one."""
    try:
        return ctypes.CDLL(None).malloc_trim
    except (AttributeError, OSError):
        return lambda _: None


def release() -> None:
    """Drops what tasks of other stages held, and gives free memory back: a worker serves all
    stages of a session, so that what each of them leaves would add up."""
    stage = _stage()
    for key in [k for k in _held if k[0] != stage]:
        del _held[key]
    pa.default_memory_pool().release_unused()
    _trim()(0)


def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches; a task that begins or ends with this keeps no memory of earlier ones."""
    release()
    yield from batches
    release()


def slices(
    batches: Iterator[pa.RecordBatch], max_bytes: int = SLICE_BYTES, text: str = "text"
) -> Iterator[pa.RecordBatch]:
    """Cut batches so that a slice holds at most `max_bytes` of text, or one row beyond that, `alone`."""
    for batch in alone(batches):
        lengths = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(lengths, dtype=np.int64)
        start = 0
        while start < len(ends):
            before = ends[start - 1] if start else 0
            stop = int(np.searchsorted(ends, before + max_bytes, side="right"))
            stop = max(stop, start + 1)
            yield batch.slice(start, stop - start)
            start = stop


def as_bytes(batch: pa.RecordBatch, text: str = "text") -> list[bytes]:
    """UTF-8 of every text; null counts as empty."""
    return pc.fill_null(batch.column(text).cast(pa.binary()), b"").to_pylist()


def as_texts(batch: pa.RecordBatch, text: str = "text") -> list[str]:
    return pc.fill_null(batch.column(text), "").to_pylist()


def planes(values: np.ndarray) -> bytes:
    """Numbers as one plane a byte: planes of zeros take no room when compressed."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(-1, values.itemsize).T).tobytes()


def from_planes(data: bytes, kind: type) -> np.ndarray:
    rows = np.frombuffer(data, np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(rows.T).view(kind).ravel()


HOT_SHARE = 1_000  # a key with one of so many rows is hot, so there are at most as many hot keys


def join_split_hot(rows: DataFrame, facts: DataFrame, key: str, weight: str) -> DataFrame:
    """Left join of `rows` with `facts`, a table from `written` with one row a key.

    `weight` is the number of rows that a key has, and is not returned. Keys that hold a
    thousandth of the joined rows, at most a thousand, are broadcast and their rows never
    shuffled; the rest meets in a shuffle join. Rows of a null key have no facts.
    """
    names = [c for c in facts.columns if c not in (key, weight)]
    total = facts.agg(F.sum(weight)).first()[0] or 0
    is_hot = F.col(weight) * HOT_SHARE >= max(total, HOT_SHARE)
    hot, cold = facts.where(is_hot).select(key, *names), facts.where(~is_hot).select(key, *names)
    columns = [*rows.columns, *names]
    near = rows.join(F.broadcast(hot), key).select(*columns)
    far = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key, "left").select(*columns)
    return near.unionByName(far)


def union_find(size: int):
    """Parents over range(size), and the function that finds a root."""
    parent = list(range(size))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    return parent, find
