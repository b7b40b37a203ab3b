"""The clean table and the cluster assignments, Hive-partitioned by station key."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridwarden.config import NOISE
from gridwarden.functions.text import station_key

PARTITION = "station_key"


def with_station_key(clean: DataFrame) -> DataFrame:
    return clean.withColumn(PARTITION, station_key(F.col("police_station")))


def write_partitioned(df: DataFrame, root: str, mode: str = "append") -> None:
    """One directory per station. `rebalance` brings a station's rows together, and splits a
    station that holds a large share of the feed over several tasks and files."""
    keyed = df if PARTITION in df.columns else with_station_key(df)
    keyed.hint("rebalance", PARTITION).write.mode(mode).partitionBy(PARTITION).parquet(root)


def read_table(spark: SparkSession, root: str) -> DataFrame:
    """The stored table. Keys are read as the text in the folder names: left to Spark, `007`,
    `7` and `1e3` would be read as numbers, and `007` and `7` would become one station."""
    found = spark.read.parquet(root).schema
    fields = [f for f in found if f.name != PARTITION]
    schema = T.StructType([*fields, T.StructField(PARTITION, T.StringType())])
    return spark.read.schema(schema).parquet(root)


def read_station(spark: SparkSession, root: str, key: str) -> DataFrame:
    return read_table(spark, root).filter(F.col(PARTITION) == key)


def read_columns(spark: SparkSession, root: str, columns: list[str]) -> DataFrame:
    return read_table(spark, root).select(*columns)


def list_stations(table: DataFrame) -> DataFrame:
    return table.select(PARTITION).distinct().orderBy(PARTITION)


def write_table(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    writer = df.write.mode("overwrite")
    if fmt == "csv":
        writer = writer.option("header", "true").option("escape", '"')
    writer.format(fmt).save(path)


def write_indexed(df: DataFrame, path: str, column: str, group_bytes: int = 1 << 20) -> None:
    """A table for lookups by one value: sorted by that column, in small row groups, each with
    its least and largest value and a Bloom filter, so that a lookup reads one group."""
    (
        df.repartitionByRange(F.col(column)).sortWithinPartitions(column)
        .write.mode("overwrite")
        .option(f"parquet.bloom.filter.enabled#{column}", "true")
        .option("parquet.block.size", group_bytes)
        .parquet(path)
    )


ID_KEY = "id_key"


def write_bucketed(df: DataFrame, root: str, buckets: int) -> None:
    """A table dealt to buckets by station and id, one sorted file a bucket, so that tables
    written alike are joined on both without a shuffle. A station of any size is spread over all
    buckets. `id_key` is the id, told apart from a missing one, which matches a missing one."""
    key = F.when(F.col("id").isNull(), "").otherwise(F.concat(F.lit("="), F.col("id")))
    name = f"gridwarden_{uuid.uuid4().hex}"
    (
        df.withColumn(ID_KEY, key).repartition(buckets, PARTITION, ID_KEY).write
        .bucketBy(buckets, PARTITION, ID_KEY).sortBy(PARTITION, ID_KEY)
        .option("path", root).saveAsTable(name)
    )
    df.sparkSession.sql(f"DROP TABLE {name}")  # the files stay


def read_bucketed(spark: SparkSession, root: str, buckets: int) -> DataFrame:
    """The table again, with its buckets made known to this session's catalog."""
    schema = spark.read.parquet(root).schema
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    name = f"gridwarden_{uuid.uuid4().hex}"
    spark.sql(
        f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY ({PARTITION}, {ID_KEY}) "
        f"SORTED BY ({PARTITION}, {ID_KEY}) INTO {int(buckets)} BUCKETS LOCATION '{root}'"
    )
    return spark.table(name)


def join_bucketed(clean: DataFrame, assignments: DataFrame) -> DataFrame:
    """`join_assignments` for two tables of `read_bucketed` with as many buckets."""
    right = assignments.select(PARTITION, ID_KEY, "cluster_id").hint("merge")
    joined = clean.join(right, [PARTITION, ID_KEY], "left").select(*clean.columns, "cluster_id")
    return joined.drop(ID_KEY).withColumn("cluster_id", F.coalesce("cluster_id", F.lit(NOISE)))


def join_assignments(clean: DataFrame, assignments: DataFrame) -> DataFrame:
    """Left join on (station, id), null matching null; rows without a partner are noise.

    Ids are unique within the clean table, so the join neither multiplies rows nor skews."""
    right = assignments.select(
        F.col(PARTITION).alias("_station"), F.col("id").alias("_id"), "cluster_id"
    )
    same = (clean[PARTITION] == F.col("_station")) & clean["id"].eqNullSafe(F.col("_id"))
    joined = clean.join(right, same, "left").drop("_station", "_id")
    return joined.withColumn("cluster_id", F.coalesce("cluster_id", F.lit(NOISE)))
