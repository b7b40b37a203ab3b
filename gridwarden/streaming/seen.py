"""Ids that earlier batches have brought, in buckets behind Bloom filters.

Ids are dealt to `buckets` folders by their hash. A unit (the new ids of one batch, or the ids of
all batches up to one, once they are compacted) has a filter for each bucket that it touches. The
ids of a new batch meet the filters of their bucket, in as many tasks as there are buckets; only
buckets with an id that may have been seen are opened, and only such ids are joined. A batch of
new ids thus reads filters, about two bytes an id, and no ids, but for the few buckets that a
filter takes by mistake.

Units are written under their batch with overwrite, so a batch that is replayed replaces its own,
and a batch never looks at units of later ones. Every `compact_every` batches all ids go into one
unit; folders below it are not read any more and may be deleted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridwarden.session import spread, written

UNIT = "batch_id"
BITS_AN_ID, HASHES = 16, 6
LEAST_BITS = 1024
FILTER_SCHEMA = "bucket int, bits binary"


def _places(h1: np.ndarray, h2: np.ndarray, bits: int) -> np.ndarray:
    """Positions of ids in a table whose size is a power of two."""
    steps = np.arange(HASHES, dtype=np.uint64)[:, None]
    with np.errstate(over="ignore"):
        at = h1.view(np.uint64) + steps * (h2.view(np.uint64) | np.uint64(1))
    return (at >> np.uint64(7)) & np.uint64(bits - 1)


def may_hold(table: bytes, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    data = np.frombuffer(table, np.uint8)
    at = _places(h1, h2, 8 * len(data))
    return (data[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).all(axis=0)


def _filter_rows(bits: int):
    """Filters of rows (bucket, h1, h2) that come sorted by bucket; one table is held at a time."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, table = None, None

        def row() -> pa.RecordBatch:
            packed = np.packbits(table, bitorder="little").tobytes()
            return pa.RecordBatch.from_arrays(
                [pa.array([current], pa.int32()), pa.array([packed], pa.binary())], names=["bucket", "bits"]
            )

        for batch in batches:
            buckets = batch.column(0).to_numpy()
            h1, h2 = (batch.column(i).to_numpy() for i in (1, 2))
            for bucket in np.unique(buckets).tolist():
                if bucket != current:
                    if table is not None:
                        yield row()
                    current, table = bucket, np.zeros(bits, np.uint8)
                mine = buckets == bucket
                table[_places(h1[mine], h2[mine], bits)] = 1
        if table is not None:
            yield row()

    return build


def _probe(ids: pd.DataFrame, filters: pd.DataFrame) -> pd.DataFrame:
    h1, h2 = ids["h1"].to_numpy(np.int64), ids["h2"].to_numpy(np.int64)
    found = np.zeros(len(ids), bool)
    for table in filters["bits"]:
        found |= may_hold(table, h1, h2)
    return ids.loc[found, ["id", "bucket"]]


class SeenIds:
    def __init__(self, spark: SparkSession, root: str, buckets: int = 64, compact_every: int = 16):
        self.spark, self.root = spark, root
        self.buckets, self.compact_every = buckets, compact_every

    def _hashed(self, ids: DataFrame) -> DataFrame:
        """Distinct ids (null is one) with their bucket and hashes."""
        bucket = F.pmod(F.col("h1"), F.lit(self.buckets)).cast("int")
        hashes = {"h1": F.xxhash64("id"), "h2": F.xxhash64("id", F.lit(1))}
        return ids.select("id").distinct().withColumns(hashes).withColumn("bucket", bucket)

    def _units(self, kind: str, schema: str, before: int, base: int) -> DataFrame:
        """Rows of the unit compacted up to batch `base`, and of the units since, before a batch."""
        tables = [(f"{kind}", f"{UNIT} < {before} AND {UNIT} > {base}"), (f"{kind}_upto", f"{UNIT} = {base}")]
        out = self.spark.createDataFrame([], f"{schema}, {UNIT} bigint")
        for name, units in tables:
            try:
                table = self.spark.read.schema(f"{schema}, {UNIT} bigint").parquet(f"{self.root}/{name}")
            except Exception as exc:
                if "PATH_NOT_FOUND" not in str(exc):
                    raise
                continue
            out = out.unionByName(table.where(units).select(*out.columns))
        return out

    def _base(self, before: int) -> int:
        """The last batch before this one up to which ids are compacted, or -1."""
        last = before // self.compact_every * self.compact_every - 1
        return last if last >= 0 else -1

    def opened(self, batch_id: int, buckets: list[int]) -> DataFrame:
        """Ids of earlier batches in some buckets; the other folders are pruned."""
        units = self._units("ids", "id string, bucket int", batch_id, self._base(batch_id))
        return units.where(F.col("bucket").isin(buckets))

    def earlier(self, ids: DataFrame, batch_id: int) -> DataFrame:
        """Those of the ids that a batch before this one has brought: id."""
        filters = self._units("filters", FILTER_SCHEMA, batch_id, self._base(batch_id)).select("bucket", "bits")
        mine = spread(self._hashed(ids), "bucket").groupBy("bucket")
        maybe = mine.cogroup(filters.groupBy("bucket")).applyInPandas(_probe, "id string, bucket int")
        maybe = written(maybe, "maybe-seen")
        buckets = [r.bucket for r in maybe.select("bucket").distinct().collect()]  # at most all buckets
        if not buckets:
            return maybe.select("id")
        known = self.opened(batch_id, buckets).select(F.col("id").alias("known")).distinct()
        return maybe.join(known, F.col("id").eqNullSafe(F.col("known")), "left_semi").select("id")

    def _write(self, hashed: DataFrame, ids_path: str, filters_path: str) -> None:
        rows = hashed.hint("rebalance", "bucket")
        rows.select("id", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(ids_path)
        most = hashed.groupBy("bucket").count().agg(F.max("count")).first()[0] or 0
        bits = LEAST_BITS
        while bits < BITS_AN_ID * most:
            bits *= 2
        sorted_rows = spread(hashed.select("bucket", "h1", "h2"), "bucket").sortWithinPartitions("bucket")
        filters = sorted_rows.mapInArrow(_filter_rows(bits), FILTER_SCHEMA)
        filters.write.mode("overwrite").parquet(filters_path)

    def add(self, ids: DataFrame, batch_id: int) -> None:
        """The ids that a batch is the first to bring."""
        hashed = written(self._hashed(ids), "new-ids")
        self._write(hashed, f"{self.root}/ids/{UNIT}={batch_id}", f"{self.root}/filters/{UNIT}={batch_id}")
        if (batch_id + 1) % self.compact_every == 0:
            every = self._hashed(self._units("ids", "id string, bucket int", batch_id + 1, self._base(batch_id)))
            self._write(
                written(every, "all-ids"),
                f"{self.root}/ids_upto/{UNIT}={batch_id}", f"{self.root}/filters_upto/{UNIT}={batch_id}",
            )
