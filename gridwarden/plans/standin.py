"""A grid stand-in for the cluster id, for queries that another engine must reproduce.

It is not the density clustering of `operators.density`: a cell of 0.01 degrees with at
least min_cluster_size rows of one station is a cluster, all other rows are noise.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridwarden.config import NOISE, Settings


def grid_assignments(clean: DataFrame, settings: Settings) -> DataFrame:
    """Adds cluster_id. Cell sizes come from a pre-aggregated count joined back."""
    cell = F.concat_ws(
        "_",
        F.floor(F.col("latitude") * 100).cast("string"),
        F.floor(F.col("longitude") * 100).cast("string"),
    )
    celled = clean.withColumn("_cell", cell)
    big = (
        celled.groupBy("station_key", "_cell")
        .agg(F.count("*").alias("_rows"))
        .filter(F.col("_rows") >= settings.min_cluster_size)
        .drop("_rows")
        .withColumn("cluster_id", F.concat("station_key", F.lit("::"), "_cell"))
    )
    joined = celled.join(big, ["station_key", "_cell"], "left").drop("_cell")
    return joined.withColumn("cluster_id", F.coalesce("cluster_id", F.lit(NOISE)))
