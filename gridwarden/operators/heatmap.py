"""Map layers: a bounded sample of points and one marker per hotspot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridwarden.config import Settings
from gridwarden.functions.draw import SPAN, ticket


def station_budget(clean: DataFrame, settings: Settings) -> int:
    stations = clean.agg(F.count_distinct("station_key")).first()[0]
    return max(1, settings.heatmap_max_points // max(1, stations))


def heatmap_sample(clean: DataFrame, budget: int, settings: Settings) -> DataFrame:
    """At most `budget` rows of each station, without replacement.

    Two rounds of the same draw: first among the rows of a (station, salt) share, then among
    the shares' survivors. The answer is that of one round, but the largest station is drawn
    by as many tasks as the shuffle has, and no task holds more than salts * budget of it.
    """
    salts = int(clean.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    points = clean.select("station_key", "id", "latitude", "longitude").withColumns(
        {"_ticket": ticket(F.lit(settings.heatmap_seed), F.col("id")), "_salt": F.pmod(F.xxhash64("id"), F.lit(salts))}
    )
    share = Window.partitionBy("station_key", "_salt").orderBy("_ticket", "id")
    station = Window.partitionBy("station_key").orderBy("_ticket", "id")
    return (
        points.withColumn("_n", F.row_number().over(share))
        .filter(F.col("_n") <= budget)
        .withColumn("_n", F.row_number().over(station))
        .filter(F.col("_n") <= budget)
        .drop("_n", "_salt", "_ticket")
    )


def cap_sample(points: DataFrame, settings: Settings) -> DataFrame:
    """The same draw over the whole layer: the max_points smallest tickets.

    Of a larger layer only tickets up to a bound that half as many again should meet are sorted,
    so what the tasks send on does not grow with their number; if the bound was too low for
    once, all are."""
    wanted, rows = settings.heatmap_max_points, points.count()
    if not rows:
        raise ValueError("a map needs at least one point")
    drawn = points.withColumn(
        "_ticket", ticket(F.lit(settings.heatmap_seed), F.col("station_key"), F.col("id"))
    )
    if rows > 2 * wanted:
        near = drawn.filter(F.col("_ticket") < int(SPAN * 1.5 * wanted / rows))
        drawn = near if near.count() >= wanted else drawn
    return drawn.orderBy("_ticket", "id").limit(wanted).drop("_ticket")


def map_center(points: DataFrame) -> DataFrame:
    return points.agg(
        F.avg("latitude").alias("center_latitude"), F.avg("longitude").alias("center_longitude")
    )


def marker_radius() -> Column:
    return F.greatest(F.lit(5.0), F.least(F.lit(40.0), F.col("total_violations") / 5))


def markers(board: DataFrame) -> DataFrame:
    """Everything a map client needs for one circle per hotspot."""
    return board.select(
        "cluster_id",
        "center_latitude",
        "center_longitude",
        marker_radius().alias("radius"),
        F.concat("cluster_id", F.lit(" — click for details")).alias("tooltip"),
        F.format_string(
            "Violations: %d | Junction: %s | Station: %s",
            F.col("total_violations").cast("bigint"),
            F.col("junction_name"),
            F.col("police_station"),
        ).alias("popup"),
        "priority_score",
    )
