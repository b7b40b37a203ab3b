"""Raw feeds: CSV, Parquet and a spatial database, all as string columns plus an order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridwarden.config import Settings
from gridwarden.functions.text import na_to_null
from gridwarden.operators.validate import ORDER, REQUIRED

EXTRA = "_extra"
RAW_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in REQUIRED])


def csv_schema(columns: list[str] | None = None) -> T.StructType:
    """All strings, and one trailing column that only over-long lines fill."""
    names = columns or REQUIRED
    return T.StructType([T.StructField(c, T.StringType()) for c in [*names, EXTRA]])


def csv_options() -> dict[str, str]:
    # a doubled quote inside a quoted cell is one quote; short lines are padded with nulls
    return {"header": "true", "quote": '"', "escape": '"', "mode": "PERMISSIVE",
            "enforceSchema": "true"}


def file_order():
    """Position of a line in the feed: file, split, row within the scan."""
    return F.struct(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
    )


def scan_csv(
    spark: SparkSession, path: str, columns: list[str] | None = None, header: bool = True
) -> DataFrame:
    """Every line of the feed, over-long ones marked in `_extra`."""
    names = columns or REQUIRED
    options = {**csv_options(), "header": str(header).lower()}
    lines = spark.read.schema(csv_schema(names)).options(**options).csv(path)
    cells = [na_to_null(F.col(c)).alias(c) for c in names]
    return lines.select(*cells, EXTRA, file_order().alias(ORDER))


def scan_csv_feed(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """The usable lines: those with more cells than the header are left out."""
    return scan_csv(spark, path, columns).filter(F.col(EXTRA).isNull()).drop(EXTRA)


def bad_lines(
    spark: SparkSession, path: str, columns: list[str] | None = None, header: bool = True
) -> DataFrame:
    """Count of all lines, of those left out (too long), and of those padded (too short)."""
    last = (columns or REQUIRED)[-1]
    return scan_csv(spark, path, columns, header).agg(
        F.count("*").alias("lines"),
        F.count(EXTRA).alias("bad_lines"),
        F.count_if(F.col(last).isNull()).alias("padded_lines"),
    )


def scan_parquet_feed(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.parquet(path)
    if ORDER in raw.columns:
        return raw
    return raw.select("*", file_order().alias(ORDER))


def geofence_query(table: str, settings: Settings, buckets: int | None = None) -> str:
    """SQL for a spatial database: the geofence is evaluated there, before rows travel.

    With `buckets` the query also returns a hash bucket that a parallel read splits on."""
    box = f"{settings.lon_min}, {settings.lat_min}, {settings.lon_max}, {settings.lat_max}"
    bucket = f", mod(abs(hashtext(id)), {buckets}) AS bucket" if buckets else ""
    return (
        "SELECT id, ST_Y(geom) AS latitude, ST_X(geom) AS longitude, vehicle_type, "
        f"violation_type, junction_name, police_station, created_datetime{bucket} "
        f"FROM {table} WHERE ST_Within(geom, ST_MakeEnvelope({box}, 4326))"
    )


def jdbc_options(
    url: str, table: str, settings: Settings, fetch_size: int = 10_000, buckets: int | None = None
) -> dict[str, str]:
    """Reader options: one cursor, or `buckets` parallel ones."""
    options = {"url": url, "fetchsize": str(fetch_size)}
    sql = geofence_query(table, settings, buckets)
    if not buckets:
        return {**options, "query": sql}
    return {
        **options,
        "dbtable": f"({sql}) feed",
        "partitionColumn": "bucket",
        "lowerBound": "0",
        "upperBound": str(buckets),
        "numPartitions": str(buckets),
    }


def scan_jdbc_geofenced(
    spark: SparkSession, url: str, table: str, settings: Settings, buckets: int | None = None
) -> DataFrame:
    """The database gives no row order, so `first` among equal ids follows the row's hash."""
    options = jdbc_options(url, table, settings, buckets=buckets)
    rows = spark.read.format("jdbc").options(**options).load().drop("bucket")
    text = [F.col(c).cast("string").alias(c) for c in REQUIRED]
    order = F.struct(
        F.xxhash64(*REQUIRED).alias("hash"), F.monotonically_increasing_id().alias("row")
    )
    return rows.select(*text).withColumn(ORDER, order)


def read_feed(spark: SparkSession, fmt: str, location: str, settings: Settings, **kw) -> DataFrame:
    """One entry for all backends; the rest of the library never asks where rows came from."""
    if fmt == "csv":
        return scan_csv_feed(spark, location)
    if fmt == "parquet":
        return scan_parquet_feed(spark, location)
    if fmt == "jdbc":
        return scan_jdbc_geofenced(spark, location, kw["table"], settings, kw.get("buckets"))
    raise ValueError(f"unknown feed format {fmt!r}")
