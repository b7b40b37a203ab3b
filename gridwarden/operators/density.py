"""Density clustering of every station at once (HDBSCAN: mutual reachability, single linkage,
excess of mass), and the labels and figures made from it.

The stages are joins, windows and grouped aggregates over points, cells and cell pairs; see
`quadtree`, `core_distance`, `candidate_edges` and `condense`. No stage gathers a station.

Choices where implementations differ: the k-th neighbour does not count the point itself; the
root cluster is never selected; merges at equal weight happen at once; clusters of a station
are numbered by their smallest id.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridwarden.config import NOISE, Settings
from gridwarden.operators.candidate_edges import candidate_edges
from gridwarden.operators.components import components
from gridwarden.operators.condense import ROUND_LIMIT, flat_clusters
from gridwarden.operators.core_distance import core_distances
from gridwarden.operators.quadtree import coordinate_key, distinct_points
from gridwarden.session import broadcast_if_small, written

EARTH_METRES = 6_371_000.0


def cluster_hotspots(
    clean: DataFrame, settings: Settings, round_limit: int = ROUND_LIMIT
) -> DataFrame:
    """(station_key, id, cluster_id) for every clean row."""
    points = distinct_points(clean, settings)
    cored = core_distances(points)
    edges = candidate_edges(cored)
    flat = flat_clusters(cored, edges, settings.min_cluster_size, round_limit)
    named = written(number_clusters(cored, flat), "named")
    # the coordinate, not the id, finds the label; labels are one row per coordinate
    rows = clean.select("station_key", "id", "latitude", "longitude").withColumns(
        coordinate_key(settings)
    )
    labels = broadcast_if_small(named, settings.broadcast_row_limit)
    joined = rows.join(labels, ["station_key", "x", "y"], "left")
    label = F.coalesce("label", F.lit(-1))
    return joined.select("station_key", "id", namespace_cluster(label).alias("cluster_id"))


def linkage_cut(clean: DataFrame, settings: Settings, metres: list[float]) -> DataFrame:
    """(station_key, first_id, metres, label): the flat clusters of the single-linkage tree cut
    at each height. Places of a station hang together if a chain of mutual reachability steps of
    at most so many metres joins them; the label is the smallest id among them."""
    cored = core_distances(distinct_points(clean, settings))
    edges = candidate_edges(cored)
    places = cored.select("station_key", "pid", "first_id")
    out = []
    for height in metres:
        below = edges.where(F.col("weight") <= height / EARTH_METRES)
        joined = places.join(components(below).withColumnRenamed("node", "pid"), "pid", "left")
        joined = joined.withColumn("component", F.coalesce("component", "pid"))
        labels = joined.groupBy("component").agg(F.min("first_id").alias("label"))
        out.append(
            joined.join(labels, "component").select(
                "station_key", "first_id", F.lit(float(height)).alias("metres"), "label"
            )
        )
    return reduce(DataFrame.unionByName, out)


def small_station_rows(clean: DataFrame, settings: Settings) -> DataFrame:
    """Rows of stations with fewer rows than a cluster needs, all labelled noise."""
    sizes = clean.groupBy("station_key").agg(F.count("*").alias("_size"))
    small = sizes.filter(F.col("_size") < settings.min_cluster_size).select("station_key")
    return clean.join(small, "station_key", "left_semi").withColumn("cluster_id", F.lit(NOISE))


def number_clusters(points: DataFrame, flat: DataFrame) -> DataFrame:
    """(station_key, x, y, label): labels 0, 1, ... of a station in the order of the smallest
    id in the cluster. The window runs over one row per cluster, not over points."""
    members = points.select("station_key", "pid", "x", "y", "first_id").join(
        flat, ["station_key", "pid"]
    )
    first = members.groupBy("station_key", "cluster").agg(F.min("first_id").alias("first_id"))
    order = Window.partitionBy("station_key").orderBy("first_id", "cluster")
    numbered = first.select(
        "station_key", "cluster", (F.row_number().over(order) - 1).alias("label")
    )
    return members.join(numbered, ["station_key", "cluster"]).select("station_key", "x", "y", "label")


def namespace_cluster(label: Column, station: str = "station_key") -> Column:
    """-1 is noise; other labels are made unique across stations by the station key."""
    named = F.concat(F.col(station), F.lit("::"), label.cast("string"))
    return F.when(label == -1, NOISE).otherwise(named)


def station_stats(assignments: DataFrame) -> DataFrame:
    """Points, clusters and noise per station, counted per cluster first."""
    per_cluster = assignments.groupBy("station_key", "cluster_id").agg(F.count("*").alias("n"))
    noise = F.col("cluster_id") == NOISE
    return per_cluster.groupBy("station_key").agg(
        F.sum("n").alias("n_points"),
        F.count_if(~noise).alias("n_clusters"),
        F.coalesce(F.sum(F.when(noise, F.col("n"))), F.lit(0)).alias("n_noise"),
    )


def cluster_totals(stats: DataFrame) -> DataFrame:
    return stats.agg(
        F.count("*").alias("n_stations"),
        *[F.sum(c).alias(c) for c in ("n_points", "n_clusters", "n_noise")],
    )
