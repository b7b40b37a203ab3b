"""Hourly volume forecast per hotspot: encoding, split, boosted trees, batch prediction."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridwarden.config import Settings
from gridwarden.functions.draw import ticket
from gridwarden.operators import boosting
from gridwarden.operators.numbering import number_rows
from gridwarden.session import broadcast_if_small, written

# Feature names, in model order.
FEATURES = ["cluster_id_encoded", "day_of_week_num", "hour"]
LABEL = "hourly_violation_count"
MAX_BINS = 256  # of the hotspot index; weekdays and hours have one bin each


def label_encode(trend: DataFrame) -> DataFrame:
    """(cluster_id, cluster_id_encoded): 0..k-1 over the sorted distinct ids.

    A table, not a driver-side label list, so the number of hotspots is not bounded by the
    driver's memory."""
    labels = trend.select("cluster_id").distinct()
    return number_rows(labels, [F.asc("cluster_id")], "cluster_id_encoded", start=0)


def encode(df: DataFrame, encoding: DataFrame, settings: Settings) -> DataFrame:
    """Inner join on the id; a plain number without category metadata, as the model wants."""
    return df.join(broadcast_if_small(encoding, settings.broadcast_row_limit), "cluster_id")


def split_flag(settings: Settings):
    """True for held-out rows. Drawn from the row's own key, so a rerun under any
    partitioning holds out the same rows; the share is met on average."""
    draw = ticket(F.lit(settings.model_seed), F.col("date"), F.col("cluster_id"), F.col("hour"))
    return draw % 1000 < round(settings.test_share * 1000)


@dataclass
class Forecast:
    model: boosting.Trees
    encoding: DataFrame
    mae: float
    n_train: int
    n_test: int


def axes(labels: int) -> list[boosting.Axis]:
    hotspot, weekday, hour = FEATURES
    return [
        boosting.Axis(hotspot, labels, min(labels, MAX_BINS)),
        boosting.Axis(weekday, 7, 7),
        boosting.Axis(hour, 24, 24),
    ]


def train_forecast(trend: DataFrame, settings: Settings) -> Forecast:
    """Boosted regression trees on (hotspot index, weekday, hour).

    The index is a plain number without category metadata, in at most 256 bins of as many
    hotspots each."""
    encoding = written(label_encode(trend), "encoding")
    labels = encoding.count()
    if labels < 2:
        raise ValueError("a forecast needs the history of at least two hotspots")
    rows = written(
        encode(trend, encoding, settings).withColumn("held_out", split_flag(settings)),
        "training",
    )
    how = boosting.Growth(
        settings.n_trees, settings.learning_rate, settings.max_depth,
        settings.l2, settings.least_child_rows, settings.split_penalty,
    )
    model = boosting.fit(rows.filter(~F.col("held_out")), axes(labels), LABEL, how)
    scored = model.transform(rows.filter("held_out"))
    held = forecast_mae(scored).first()
    n_train = rows.filter(~F.col("held_out")).count()
    return Forecast(model, encoding, held["forecast_mae"], n_train, held["n_test"])


def forecast_mae(scored: DataFrame) -> DataFrame:
    error = F.abs(F.col(LABEL) - F.col("prediction"))
    return scored.agg(F.avg(error).alias("forecast_mae"), F.count("*").alias("n_test"))


def feature_importance(nodes: DataFrame) -> DataFrame:
    """Number of splits per feature over all trees, zeros filled in, largest first."""
    spark = nodes.sparkSession
    splits = (
        nodes.filter("feature IS NOT NULL")
        .groupBy("feature")
        .agg(F.count("*").cast("double").alias("n"))
    )
    names = spark.createDataFrame([(f,) for f in FEATURES], "feature string")
    return (
        names.join(splits, "feature", "left")
        .select("feature", F.coalesce("n", F.lit(0.0)).alias("importance"))
        .orderBy(F.desc("importance"), "feature")
    )


def request_reject_reason():
    """Null for a well-formed request (cluster_id, hour, day_of_week)."""
    return (
        F.when(F.col("cluster_id").isNull() | (F.trim("cluster_id") == ""), "blank_cluster_id")
        .when(~F.coalesce(F.col("hour").between(0, 23), F.lit(False)), "hour_out_of_range")
        .when(
            ~F.coalesce(F.col("day_of_week").between(0, 6), F.lit(False)),
            "day_of_week_out_of_range",
        )
    )


def validate_requests(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    marked = requests.withColumn("reject_reason", request_reject_reason())
    good = marked.filter("reject_reason IS NULL").drop("reject_reason")
    return good, marked.filter("reject_reason IS NOT NULL")


def known_clusters(requests: DataFrame, encoding: DataFrame) -> DataFrame:
    return requests.join(encoding, "cluster_id", "left_semi")


def unknown_clusters(requests: DataFrame, encoding: DataFrame) -> DataFrame:
    return requests.join(encoding, "cluster_id", "left_anti")


def predict_batch(
    requests: DataFrame, forecast: Forecast, settings: Settings
) -> tuple[DataFrame, DataFrame]:
    """Scores a table of requests; the second table holds the refused ones with a reason. Both
    keep the columns of the requests, so that answers can be matched to them."""
    good, bad = validate_requests(requests)
    unknown = unknown_clusters(good, forecast.encoding).withColumn(
        "reject_reason", F.lit("unknown_cluster")
    )
    rows = encode(good, forecast.encoding, settings).withColumn(
        "day_of_week_num", F.col("day_of_week")
    )
    scored = forecast.model.transform(rows).select(
        *requests.columns,
        predicted_violations(F.col("prediction")).alias("predicted_violations"),
        F.lit(round(forecast.mae, 2)).alias("model_mae"),
        F.lit(settings.model_version).alias("model_version"),
    )
    return scored, bad.unionByName(unknown)


def predicted_violations(raw):
    """Counts cannot be negative; two decimals."""
    return F.round(F.greatest(F.lit(0.0), raw), 2)
