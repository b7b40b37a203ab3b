"""A whole run: raw feed to ranked board, forecast, map layers and a registry row.

Everything between the feed and the rollups is one chain of DataFrames. Tables are written
where they are read more than once, in the shared folder, so a lost executor repeats a stage
and not the run. The driver sees single rows only: the report, the time bounds, the MAE.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridwarden.config import Settings
from gridwarden.operators import (
    boosting,
    forecast,
    heatmap,
    leaderboard,
    registry,
    rollups,
    temporal,
    validate,
)
from gridwarden.operators.density import cluster_hotspots
from gridwarden.session import use_utc, written
from gridwarden.sources import store

ARTIFACTS = ["leaderboard", "feature_importance", "encoding", "model", "map_points"]
Assign = Callable[[DataFrame, Settings], DataFrame]


class IncompleteRunError(RuntimeError):
    """No promoted run, or one whose tables are not all there."""


@dataclass
class Run:
    metrics: dict
    leaderboard: DataFrame
    feature_importance: DataFrame
    map_points: DataFrame
    forecast: forecast.Forecast


def run_training(
    raw: DataFrame,
    root: str,
    settings: Settings,
    force_promote: bool = False,
    assign: Assign = cluster_hotspots,
    run_id: str | None = None,
) -> dict:
    """Runs all stages, writes the run below `root`, and returns its registry row."""
    spark = use_utc(raw.sparkSession)
    started = time.time()
    run_id = run_id or datetime.now(timezone.utc).strftime("run_%Y%m%dT%H%M%S%f")
    home, runs_path = f"{root}/{run_id}", f"{root}/runs"
    previous = registry.latest_run(registry.read_runs(spark, runs_path)).first()

    staged = written(raw, "staged")
    lineage = registry.row_fingerprint(staged).first().asDict()
    report = validate.report(staged, settings).first()
    validate.enforce_gate(report)

    clean_root, label_root = f"{home}/clean", f"{home}/assignments"
    store.write_partitioned(validate.clean(staged, settings), clean_root, "overwrite")
    clean = store.read_table(spark, clean_root)
    store.write_partitioned(assign(clean, settings), label_root, "overwrite")
    labels = temporal.hotspots(store.read_table(spark, label_root))
    clustered = store.join_assignments(clean, labels)

    bounds = temporal.read_time_bounds(clean)
    facts = written(rollups.incident_facts(clustered, bounds["mid_time"], settings), "facts")
    trend = written(rollups.trend_from_facts(facts), "trend")
    fitted = forecast.train_forecast(trend, settings)
    board = written(
        leaderboard.build_leaderboard(
            rollups.impact_from_facts(facts, settings),
            rollups.recency_from_facts(facts, bounds["max_time"], settings),
            settings,
        ),
        "board",
    )
    points = heatmap.heatmap_sample(clean, heatmap.station_budget(clean, settings), settings)
    points = heatmap.cap_sample(written(points, "sample"), settings)

    store.write_table(board, f"{home}/leaderboard")
    store.write_table(board, f"{home}/leaderboard_csv", "csv")
    store.write_table(fitted.encoding, f"{home}/encoding")
    store.write_table(points, f"{home}/map_points")
    fitted.model.save(f"{home}/model")
    importance = forecast.feature_importance(fitted.model.nodes)
    store.write_table(importance, f"{home}/feature_importance", "csv")

    verdict = _verdict(spark, fitted.mae, previous, settings, force_promote)
    reasons = {r: report[r] for r in validate.REASONS if report[r]}
    row = {
        "run_id": run_id,
        "model_version": settings.model_version,
        "generated_at": datetime.now(timezone.utc),
        "training_duration_seconds": round(time.time() - started, 1),
        "ingestion_report": {
            "total_rows_seen": report["total_rows_seen"],
            "valid_rows": report["valid_rows"],
            "rejected_rows": report["rejected_rows"],
            "rejection_rate": report["rejection_rate"],
            "rejection_reasons": reasons,
        },
        "total_hotspots": board.count(),
        "forecast_mae": fitted.mae,
        "forecast_n_train": fitted.n_train,
        "forecast_n_test": fitted.n_test,
        "feature_names": forecast.FEATURES,
        "dataset_time_span": {"min": bounds["min_time"], "max": bounds["max_time"]},
        "promotion_gate": {"promoted": verdict["promoted"], "reason": verdict["reason"]},
        "lineage": {k: str(v) for k, v in lineage.items()},
    }
    registry.append_run(spark, runs_path, row)
    return row


def _verdict(spark: SparkSession, mae: float, previous, settings: Settings, force: bool):
    prev_mae = previous["forecast_mae"] if previous else None
    one = spark.createDataFrame(
        [(mae, previous is not None, prev_mae, force)],
        "new_mae double, has_previous boolean, prev_mae double, force boolean",
    )
    return registry.promotion_gate(one, settings).first()


def load_run(spark: SparkSession, root: str) -> Run:
    """The promoted run with all its tables; what is missing is named in the error."""
    runs = registry.read_runs(use_utc(spark), f"{root}/runs")
    served = registry.latest_run(runs).first()
    if served is None:
        raise IncompleteRunError(f"no promoted run below {root}")
    home = f"{root}/{served['run_id']}"
    tables, missing = {}, []
    for name in ARTIFACTS:
        try:
            tables[name] = _load(spark, home, name)
        except Exception as exc:
            if not any(s in str(exc) for s in ("PATH_NOT_FOUND", "does not exist")):
                raise
            missing.append(name)
    if missing:
        raise IncompleteRunError(f"run {served['run_id']} lacks {missing}")
    fitted = forecast.Forecast(
        tables["model"],
        tables["encoding"],
        served["forecast_mae"],
        served["forecast_n_train"],
        served["forecast_n_test"],
    )
    return Run(
        served.asDict(True),
        tables["leaderboard"],
        tables["feature_importance"],
        tables["map_points"],
        fitted,
    )


def _load(spark: SparkSession, home: str, name: str):
    path = f"{home}/{name}"
    if name == "model":
        return boosting.Trees.load(spark, path)
    if name == "feature_importance":
        return (
            spark.read.schema("feature string, importance double")
            .option("header", "true")
            .csv(path)
            .orderBy(F.desc("importance"), "feature")
        )
    return spark.read.parquet(path)
