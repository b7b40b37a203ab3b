"""Per-hotspot rollups.

`incident_facts` reduces the incident rows once, map-side first, to one row per hotspot, hour
and place. Every rollup is a small aggregation over it: nothing joins back to the rows, so a
hotspot or a noise bucket that holds a third of the feed never meets a join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridwarden.config import Settings
from gridwarden.functions.parsing import hours_between
from gridwarden.operators.impact import severity
from gridwarden.operators.temporal import KEY, add_clock, hotspots


def incident_facts(clustered: DataFrame, mid_time, settings: Settings) -> DataFrame:
    """Counts and additive sums per (hotspot, date, hour, junction, station)."""
    clocked = add_clock(hotspots(clustered)).withColumn(
        "_severity", severity(F.col("violation_type_clean"), settings)
    )
    return clocked.groupBy(
        *KEY, "date", "day_of_week_num", "hour", "junction_name", "police_station"
    ).agg(
        F.count("*").alias("n"),
        F.sum("latitude").alias("sum_lat"),
        F.sum("longitude").alias("sum_lon"),
        F.sum(F.col("_severity") * F.col("vehicle_weight")).alias("load"),
        F.count_if(F.col("_severity") >= settings.high_severity).alias("n_high"),
        F.max("created_datetime").alias("latest"),
        F.count_if(F.col("created_datetime") <= F.lit(mid_time)).alias("n_older"),
    )


def impact_from_facts(facts: DataFrame, settings: Settings) -> DataFrame:
    """hotspot_impact without row-level scores: density and rush factor are constant within
    a hotspot hour, so the score of an hour is density * factor * sum(severity * weight)."""
    hourly = facts.groupBy(*KEY, "hour").agg(
        *[F.sum(c).alias(c) for c in ("n", "sum_lat", "sum_lon", "load", "n_high")]
    )
    hours = F.collect_list(F.struct("n", "load"))  # at most 24 entries
    per_cluster = hourly.groupBy(*KEY).agg(
        F.sum("n").alias("total_violations"),
        (F.sum("sum_lat") / F.sum("n")).alias("center_latitude"),
        (F.sum("sum_lon") / F.sum("n")).alias("center_longitude"),
        F.sum("n_high").alias("high_severity_incidents"),
        F.median("n").alias("_median"),
        hours.alias("_hours"),
    )
    weighted = F.aggregate(
        "_hours",
        F.lit(0.0),
        lambda acc, h: acc
        + h["load"]
        * F.when(h["n"] > F.col("_median"), settings.rush_hour_factor).otherwise(1.0),
    )
    scored = per_cluster.withColumn("total_impact_score", F.col("total_violations") * weighted)
    return (
        scored.join(_commonest(facts, "junction_name"), KEY)
        .join(_commonest(facts, "police_station"), KEY)
        .select(
            *KEY,
            "junction_name",
            "police_station",
            "center_latitude",
            "center_longitude",
            "total_violations",
            "total_impact_score",
            (F.col("total_impact_score") / F.col("total_violations")).alias(
                "average_impact_per_vehicle"
            ),
            "high_severity_incidents",
        )
    )


def _commonest(facts: DataFrame, column: str) -> DataFrame:
    """Most frequent value, smallest on a tie, `Unknown` when every value is null."""
    counts = facts.groupBy(*KEY, column).agg(F.sum("n").alias("_n"))
    # max_by of (count, reversed order): among equal counts the smallest name wins
    ranked = F.min_by(column, F.struct(F.col(column).isNull(), -F.col("_n"), column))
    return counts.groupBy(*KEY).agg(F.coalesce(ranked, F.lit("Unknown")).alias(column))


def trend_from_facts(facts: DataFrame) -> DataFrame:
    return facts.groupBy("date", *KEY, "day_of_week_num", "hour").agg(
        F.sum("n").alias("hourly_violation_count")
    )


def hourly_trend(clustered: DataFrame) -> DataFrame:
    """Counts per (date, hotspot, weekday, hour), straight from the rows; sparse on purpose."""
    return (
        add_clock(hotspots(clustered))
        .groupBy("date", *KEY, "day_of_week_num", "hour")
        .agg(F.count("*").alias("hourly_violation_count"))
    )


def recency_factor(latest: Column, max_time) -> Column:
    return 1.0 / (1.0 + hours_between(F.lit(max_time), latest) / 24.0)


def growth_rate(older: Column, recent: Column, settings: Settings) -> Column:
    """Recent over older volume; 1.0 when nothing is older; clipped at both ends."""
    ratio = F.when(older > 0, recent / older).otherwise(F.lit(1.0))
    return F.least(
        F.lit(settings.growth_max), F.greatest(F.lit(settings.growth_min), ratio)
    )


def _recency_growth(per_cluster: DataFrame, max_time, settings: Settings) -> DataFrame:
    older, recent = F.col("n_older"), F.col("n") - F.col("n_older")
    return per_cluster.select(
        *KEY,
        "latest_incident",
        recency_factor(F.col("latest_incident"), max_time).alias("recency_factor"),
        growth_rate(older, recent, settings).alias("growth_rate"),
    )


def recency_growth(clustered: DataFrame, max_time, mid_time, settings: Settings) -> DataFrame:
    per_cluster = (
        hotspots(clustered)
        .groupBy(*KEY)
        .agg(
            F.max("created_datetime").alias("latest_incident"),
            F.count("*").alias("n"),
            F.count_if(F.col("created_datetime") <= F.lit(mid_time)).alias("n_older"),
        )
    )
    return _recency_growth(per_cluster, max_time, settings)


def recency_from_facts(facts: DataFrame, max_time, settings: Settings) -> DataFrame:
    per_cluster = facts.groupBy(*KEY).agg(
        F.max("latest").alias("latest_incident"),
        F.sum("n").alias("n"),
        F.sum("n_older").alias("n_older"),
    )
    return _recency_growth(per_cluster, max_time, settings)
