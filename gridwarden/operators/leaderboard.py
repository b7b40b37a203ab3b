"""Ranking, dispatch status, and the read queries over the ranked table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridwarden.config import Settings
from gridwarden.operators.numbering import number_rows
from gridwarden.operators.temporal import KEY

# The three dispatch states.
URGENT, HIGH, ROUTINE = "URGENT_DISPATCH", "HIGH_PRIORITY", "ROUTINE_PATROL"


def priority_score() -> Column:
    return F.col("total_impact_score") * F.col("recency_factor") * F.col("growth_rate")


def dispatch_status(settings: Settings) -> Column:
    return (
        F.when(F.col("growth_rate") > settings.urgent_growth, URGENT)
        .when(F.col("recency_factor") > settings.high_priority_recency, HIGH)
        .otherwise(ROUTINE)
    )


def recommendation(settings: Settings) -> Column:
    """One fixed sentence per state; the percentage rounds half to even."""
    percent = F.format_string("%.0f", F.rint((F.col("growth_rate") - 1) * 100))
    place = F.col("junction_name")
    status = dispatch_status(settings)
    # The three sentences.
    urgent = F.concat(
        F.lit("Target "), place, F.lit(". Violations accelerating (+"), percent,
        F.lit("% growth trend)."),
    )
    high = F.concat(
        F.lit("Monitor "), place,
        F.lit(" closely — highly active within the past few hours."),
    )
    routine = F.concat(
        F.lit("Schedule a routine check at "), place,
        F.lit(" during predicted peak windows."),
    )
    return F.when(status == URGENT, urgent).when(status == HIGH, high).otherwise(routine)


def score_board(impact: DataFrame, recency: DataFrame, settings: Settings) -> DataFrame:
    """Impact and recency joined on the hotspot key, with score, status and text."""
    key = [k for k in KEY if k in impact.columns and k in recency.columns]
    return impact.join(recency, key).withColumns(
        {
            "priority_score": priority_score(),
            "status": dispatch_status(settings),
            "recommendation": recommendation(settings),
        }
    )


def rank_board(board: DataFrame, scale: int = 6) -> DataFrame:
    """Consecutive ranks by descending score, cluster id on a tie. Scores are compared at
    `scale` decimals, because sums of doubles depend on their order beyond that."""
    order = [F.desc("_score"), F.asc("cluster_id")]
    scored = board.withColumn("_score", F.round("priority_score", scale))
    ranked = number_rows(scored, order, "rank")
    columns = [c for c in board.columns if c != "rank"]
    return ranked.select(F.col("rank").cast("int").alias("rank"), *columns)


def build_leaderboard(impact: DataFrame, recency: DataFrame, settings: Settings) -> DataFrame:
    return rank_board(score_board(impact, recency, settings))


def top_hotspots(board: DataFrame, limit: int | None = None) -> DataFrame:
    """First rows by rank; no limit returns the whole board."""
    if limit is not None and not 1 <= limit <= 5000:
        raise ValueError("limit must lie in 1..5000")
    ordered = hotspot_summary(board).orderBy("rank")
    return ordered if limit is None else ordered.limit(limit)


def hotspot_summary(board: DataFrame) -> DataFrame:
    return board.select(
        F.col("cluster_id").cast("string"),
        F.col("rank").cast("int"),
        F.col("junction_name").cast("string"),
        F.col("police_station").cast("string"),
        F.col("center_latitude").cast("double"),
        F.col("center_longitude").cast("double"),
        F.col("total_violations").cast("bigint"),
        F.col("priority_score").cast("double"),
        F.col("status").cast("string"),
        F.col("recommendation").cast("string"),
    )


class UnknownHotspotError(KeyError):
    """The asked cluster is not on the board."""


def lookup_hotspot(board: DataFrame, cluster_id: str) -> DataFrame:
    """One board row by id; the predicate reaches the Parquet scan. Unknown ids raise."""
    found = hotspot_summary(board.filter(F.col("cluster_id") == cluster_id))
    if found.isEmpty():
        raise UnknownHotspotError(cluster_id)
    return found


def dispatch_directives(board: DataFrame, n: int = 8) -> DataFrame:
    label = F.concat(
        F.lit("Rank "),
        F.col("rank").cast("string"),
        F.lit(": "),
        F.replace("status", F.lit("_"), F.lit(" ")),
        F.lit(" — "),
        F.col("recommendation"),
    )
    return board.orderBy("rank").limit(n).select("rank", label.alias("directive"))


def primary_offense(settings: Settings) -> str:
    """The rule with the largest weight, the first one on a tie."""
    rules = settings.severity_rules
    return max(rules, key=rules.get)


def kpis(board: DataFrame, run: DataFrame, settings: Settings) -> DataFrame:
    """One row: size of the board, its top score and junction, the offence to watch, and the
    run's own error, version and time. `run` holds the one served run."""
    best = F.struct(-F.col("rank"), "priority_score", "junction_name")
    head = board.agg(
        F.count("*").alias("total_active_hotspots"), F.max(best).alias("top")
    ).select(
        F.lit(1).alias("_k"),
        "total_active_hotspots",
        F.col("top.priority_score").alias("top_priority_score"),
        F.col("top.junction_name").alias("top_priority_junction"),
        F.lit(primary_offense(settings)).alias("primary_offense"),
    )
    served = run.select(
        F.lit(1).alias("_k"),
        F.round("forecast_mae", 2).alias("model_mae"),
        "model_version",
        "generated_at",
    )
    return head.filter("total_active_hotspots > 0").join(served, "_k").drop("_k")
