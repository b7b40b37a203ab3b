"""Incremental ingestion: new feed files become clean rows, batch by batch.

A file stream with `availableNow` reads what has arrived since the last call. Each batch is
written under its own batch id with overwrite, so a batch that is replayed after a failure
replaces itself instead of counting twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridwarden.config import Settings
from gridwarden.functions.text import na_to_null
from gridwarden.operators import validate
from gridwarden.session import written
from gridwarden.sources.feed import EXTRA, csv_options, csv_schema
from gridwarden.sources.store import with_station_key
from gridwarden.streaming.seen import SeenIds

BATCH = "batch_id"


def _drop_seen(lines: DataFrame, seen: DataFrame) -> DataFrame:
    """Adds `seen_before`: the id occurred in an earlier batch. Seen ids are distinct, and a
    frequent id in the new batch is split by adaptive execution."""
    flags = seen.select(F.col("id").alias("_seen_id"), F.lit(True).alias("seen_before"))
    joined = lines.join(flags, lines["id"].eqNullSafe(F.col("_seen_id")), "left")
    return joined.drop("_seen_id").fillna({"seen_before": False})


def process_batch(lines: DataFrame, batch_id: int, root: str, settings: Settings) -> None:
    """One batch: raw lines to clean rows, the batch's report row and its new ids."""
    spark = lines.sparkSession
    staged = f"{root}/staged/{BATCH}={batch_id}"
    usable = lines.filter(F.col(EXTRA).isNull()).drop(EXTRA)
    in_order = F.struct("file", "block", F.monotonically_increasing_id().alias("row"))
    ordered = usable.withColumn(validate.ORDER, in_order).drop("file", "block")
    ordered.write.mode("overwrite").parquet(staged)
    raw = spark.read.parquet(staged)

    ids = SeenIds(spark, f"{root}/seen")
    seen = written(ids.earlier(raw, batch_id), "seen")
    marked = _drop_seen(validate.flag(raw, settings), seen)
    first = validate.keep_first(marked)
    valid = first.filter(F.col("keep_row") & ~F.col("seen_before")).drop("seen_before")
    clean = with_station_key(validate.normalise(valid, settings)).drop(validate.ORDER)
    clean.write.mode("overwrite").parquet(f"{root}/clean/{BATCH}={batch_id}")

    scan_reasons = [r for r in validate.REASONS if r != validate.DUPLICATE]
    counts = marked.agg(
        F.count("*").alias("total_rows_seen"),
        F.count_if("keep_row").alias("n_ok"),
        *[F.count_if(r).alias(r) for r in scan_reasons],
    )
    n_valid = spark.read.parquet(f"{root}/clean/{BATCH}={batch_id}").count()
    report = counts.withColumns(
        {
            "valid_rows": F.lit(n_valid).cast("bigint"),
            validate.DUPLICATE: F.col("n_ok") - F.lit(n_valid),
        }
    ).drop("n_ok")
    report.write.mode("overwrite").parquet(f"{root}/reports/{BATCH}={batch_id}")
    ids.add(marked.filter(~F.col("seen_before")), batch_id)


def ingest_available(
    spark: SparkSession,
    drop_dir: str,
    root: str,
    settings: Settings,
    files_per_batch: int | None = None,
) -> None:
    """Runs until every file now in `drop_dir` is taken in; call again for later files."""
    reader = spark.readStream.schema(csv_schema()).options(**csv_options())
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    cells = [na_to_null(F.col(c)).alias(c) for c in validate.REQUIRED]

    def take(batch: DataFrame, batch_id: int) -> None:
        process_batch(batch, batch_id, root, settings)

    query = (
        reader.csv(drop_dir)
        .select(
            *cells,
            EXTRA,
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("block"),
        )
        .writeStream.foreachBatch(take)
        .option("checkpointLocation", f"{root}/progress")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def clean_rows(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.parquet(f"{root}/clean").drop(BATCH)


def batch_reports(spark: SparkSession, root: str) -> DataFrame:
    """One report row per non-empty batch."""
    return spark.read.parquet(f"{root}/reports").filter("total_rows_seen > 0")
