"""Session defaults, the shared scratch folder, and size-checked broadcast."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(app: str = "gridwarden", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    options = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        **conf,
    }
    for key, value in options.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def use_utc(spark: SparkSession) -> SparkSession:
    """Every hour, weekday and date in this library is a UTC one."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


_local_scratch: str | None = None


def scratch_root(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; a local temporary one only in local mode."""
    global _local_scratch
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        configured = spark.sparkContext.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    if _local_scratch is None or not os.path.isdir(_local_scratch):
        _local_scratch = tempfile.mkdtemp(prefix="gridwarden-")
    return _local_scratch


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/gridwarden/{name}-{uuid.uuid4().hex}"


def written(
    df: DataFrame, name: str, partition_by: list[str] | None = None, rows_per_file: int | None = None
) -> DataFrame:
    """Cut the lineage with a table in the shared folder, so lost executors cost one stage.

    A file is written and read by row groups of up to 128 MB, which tasks hold whole. Tables with
    rows of megabytes are cut into files of few rows, so that a task holds no more than these."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if rows_per_file:
        writer = writer.option("maxRecordsPerFile", rows_per_file)
    writer.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.scratch_path = path
    return table


def dropped(*tables: DataFrame) -> None:
    """Deletes tables from `written`, once all that reads them is written itself."""
    for table in tables:
        spark = table.sparkSession
        if path := table.__dict__.get("scratch_path"):
            path = spark._jvm.org.apache.hadoop.fs.Path(path)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_go(spark: SparkSession) -> Iterator[None]:
    """Shuffle files go when the query that made them ends, not when the driver happens to collect
    its garbage. For steps that are each written."""
    before = spark.conf.get(SHUFFLES_GO, None)
    spark.conf.set(SHUFFLES_GO, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(SHUFFLES_GO)
        else:
            spark.conf.set(SHUFFLES_GO, before)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash partitioning for a grouped pandas function. Its groups cost far more time than
    bytes, so their partitions must not be merged by size, as adaptive execution would."""
    context = df.sparkSession.sparkContext
    wanted = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(wanted, context.defaultParallelism), *keys)


def broadcast_if_small(df: DataFrame, row_limit: int, byte_limit: int = 64 << 20) -> DataFrame:
    """Broadcast a table when its rows and bytes prove small, else leave it to a shuffle.

    One aggregation without a shuffle of rows; call it on tables from `written`, as it reads
    the table. Bytes are those of texts and binaries, and 16 for any other value.
    """
    sizes = [
        F.coalesce(F.octet_length(f"`{c}`"), F.lit(0)) if kind in ("string", "binary") else F.lit(16)
        for c, kind in df.dtypes
    ]
    rows, size = df.agg(F.count("*"), F.sum(sum(sizes, F.lit(0)).cast("long"))).first()
    if rows <= row_limit and (size or 0) <= byte_limit:
        return F.broadcast(df)
    return df
