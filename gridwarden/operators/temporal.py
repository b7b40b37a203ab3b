"""Clock features, time bounds, and the rush-hour factor."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridwarden.config import NOISE, Settings

KEY = ["station_key", "cluster_id"]


SPREAD = 1024  # names that stand in for noise in a lookup


def lookup(rows: DataFrame, facts: DataFrame, keys: list[str]) -> DataFrame:
    """Left join of incident rows with facts of their hotspot. Noise has no facts; it is sent
    under many names, so that the noise of a large station does not meet in one task."""
    own = ["id"] if "id" in rows.columns else rows.columns
    noise = F.concat(F.lit(NOISE + "#"), F.pmod(F.xxhash64(*own), F.lit(SPREAD)).cast("string"))
    sent = F.when(F.col("cluster_id") == NOISE, noise).otherwise(F.col("cluster_id"))
    facts = facts.withColumnRenamed("cluster_id", "_sent")
    keys = ["_sent" if k == "cluster_id" else k for k in keys]
    return rows.withColumn("_sent", sent).join(facts, keys, "left").select(
        *rows.columns, *[c for c in facts.columns if c not in keys]
    )


def join_hour_counts(clocked: DataFrame) -> DataFrame:
    """Adds violations_in_hour; null for noise."""
    return lookup(clocked, hour_counts(clocked), [*KEY, "hour"])


def join_cluster_median(clocked: DataFrame) -> DataFrame:
    """Adds cluster_median_hourly; null for noise."""
    return lookup(clocked, hour_medians(hour_counts(clocked)), KEY)


def total_hotspots(df: DataFrame) -> DataFrame:
    return hotspots(df).agg(F.count_distinct("cluster_id").alias("total_hotspots"))


def hotspots(df: DataFrame) -> DataFrame:
    return df.filter(F.col("cluster_id") != NOISE)


def add_clock(df: DataFrame) -> DataFrame:
    ts = F.col("created_datetime")
    return df.withColumns(
        {
            "hour": F.hour(ts),
            "day_of_week": F.date_format(ts, "EEEE"),
            "day_of_week_num": F.weekday(ts),
            "is_weekend": F.weekday(ts) >= 5,
            "month": F.month(ts),
            "date": F.to_date(ts),
        }
    )


def time_bounds(clean: DataFrame) -> DataFrame:
    """One row: min, max and midpoint over every clean row, noise included."""
    micros = F.unix_micros(F.col("created_datetime"))
    bounds = clean.agg(F.min(micros).alias("lo"), F.max(micros).alias("hi"))
    return bounds.select(
        F.timestamp_micros("lo").alias("min_time"),
        F.timestamp_micros("hi").alias("max_time"),
        F.timestamp_micros(F.expr("lo + (hi - lo) div 2")).alias("mid_time"),
    )


def read_time_bounds(clean: DataFrame):
    row = time_bounds(clean).first()
    if row is None or row["min_time"] is None:
        raise ValueError("no valid timestamp in the clean table")
    return row


def hour_counts(clocked: DataFrame) -> DataFrame:
    """Rows per cluster and hour of day over all dates; hours without a row do not exist."""
    return hotspots(clocked).groupBy(*KEY, "hour").agg(F.count("*").alias("violations_in_hour"))


def hour_medians(counts: DataFrame) -> DataFrame:
    """Exact median over the observed hours, at most 24 values a cluster."""
    return counts.groupBy(*KEY).agg(F.median("violations_in_hour").alias("cluster_median_hourly"))


def hour_facts(clocked: DataFrame) -> DataFrame:
    """Per (cluster, hour): its count, the cluster's size and the cluster's median hour.

    All three come from one pre-aggregated shuffle of the incident rows. The later steps work
    on at most 24 rows a cluster, which the windows see already partitioned by station.
    """
    by_hour = hour_counts(clocked)
    totals = by_hour.groupBy(*KEY).agg(
        F.sum("violations_in_hour").alias("cluster_rows"),
        F.median("violations_in_hour").alias("cluster_median_hourly"),
    )
    return by_hour.join(totals, KEY)


def add_rush_and_density(clocked: DataFrame, settings: Settings) -> DataFrame:
    """Both per-cluster lookups in one left join; noise finds no partner and keeps the
    baseline. For row-level output only: the rollups work on `rollups.incident_facts`, which
    needs no join back to the incident rows."""
    facts = hour_facts(clocked)
    rush = F.when(
        F.col("violations_in_hour") > F.col("cluster_median_hourly"), settings.rush_hour_factor
    ).otherwise(1.0)
    return (
        lookup(clocked, facts, [*KEY, "hour"])
        .withColumn("rush_hour_factor", rush)
        .withColumn("cluster_density", F.coalesce("cluster_rows", F.lit(1)).cast("double"))
        .drop("violations_in_hour", "cluster_median_hourly", "cluster_rows")
    )


def add_rush_hour(clocked: DataFrame, settings: Settings) -> DataFrame:
    """The rush-hour factor alone, with its two lookups in one join."""
    joined = lookup(clocked, hour_facts(clocked).drop("cluster_rows"), [*KEY, "hour"])
    rush = F.when(
        F.col("violations_in_hour") > F.col("cluster_median_hourly"), settings.rush_hour_factor
    ).otherwise(1.0)
    return joined.withColumn("rush_hour_factor", rush)
