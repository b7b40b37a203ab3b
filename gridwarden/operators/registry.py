"""Run registry: one row per run, append-only; what is served is a query over it."""

from __future__ import annotations

from collections.abc import Iterator
from math import isnan

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridwarden.config import Settings
from gridwarden.functions.draw import ticket
from gridwarden.session import broadcast_if_small, spread, written

SERVED_BROADCAST = 100_000  # versions

RUN_SCHEMA = T.StructType(
    [
        T.StructField("run_id", T.StringType()),
        T.StructField("model_version", T.StringType()),
        T.StructField("generated_at", T.TimestampType()),
        T.StructField("training_duration_seconds", T.DoubleType()),
        T.StructField(
            "ingestion_report",
            T.StructType(
                [
                    T.StructField("total_rows_seen", T.LongType()),
                    T.StructField("valid_rows", T.LongType()),
                    T.StructField("rejected_rows", T.LongType()),
                    T.StructField("rejection_rate", T.DoubleType()),
                    T.StructField(
                        "rejection_reasons", T.MapType(T.StringType(), T.LongType())
                    ),
                ]
            ),
        ),
        T.StructField("total_hotspots", T.LongType()),
        T.StructField("forecast_mae", T.DoubleType()),
        T.StructField("forecast_n_train", T.LongType()),
        T.StructField("forecast_n_test", T.LongType()),
        T.StructField("feature_names", T.ArrayType(T.StringType())),
        T.StructField(
            "dataset_time_span",
            T.StructType(
                [
                    T.StructField("min", T.TimestampType()),
                    T.StructField("max", T.TimestampType()),
                ]
            ),
        ),
        T.StructField(
            "promotion_gate",
            T.StructType(
                [
                    T.StructField("promoted", T.BooleanType()),
                    T.StructField("reason", T.StringType()),
                ]
            ),
        ),
        T.StructField("lineage", T.MapType(T.StringType(), T.StringType())),
    ]
)


def _fixed(c: Column, digits: int) -> Column:
    """Fixed-point text rounded by the exact binary value of the double, as C and Python do.

    A scaled value that looks like a tie usually is none: the product's rounding error, taken
    from the upper and lower half of the mantissa, says on which side it lies."""
    scale = 10.0**digits
    scaled = c * scale
    upper = c * 134217729.0 - (c * 134217729.0 - c)
    error = (upper * scale - scaled) + (c - upper) * scale
    low = F.floor(scaled).cast("double")
    rounded = (
        F.when((scaled - low == 0.5) & (error > 0), low + 1.0)
        .when((scaled - low == 0.5) & (error < 0), low)
        .otherwise(F.rint(scaled))
    )
    return F.format_string(f"%.{digits}f", rounded / scale)


def promotion_gate(candidates: DataFrame, settings: Settings) -> DataFrame:
    """Adds promoted and reason to rows of (new_mae, has_previous, prev_mae, force).

    The first rule that applies decides: forced, gate off, no previous run, previous run
    without an error figure, then the tolerance; meeting the ceiling exactly passes.
    """
    new, prev = F.col("new_mae"), F.col("prev_mae")
    tolerance = settings.max_mae_regression_pct
    ceiling = prev * (1.0 + tolerance / 100.0)
    delta = F.coalesce(F.try_divide(prev - new, prev), F.lit(0.0)) * 100.0
    # The reason sentences.
    direction = F.when(
        delta > 0, F.concat(F.lit("+"), _fixed(delta, 1), F.lit("% better"))
    ).otherwise(F.concat(_fixed(F.abs(delta), 1), F.lit("% worse (within tolerance)")))
    rejected = F.concat(
        F.lit("REJECTED — MAE regressed: "), _fixed(new, 4), F.lit(" > "), _fixed(ceiling, 4),
        F.lit(" (prev="), _fixed(prev, 4), F.lit(f", tolerance={tolerance:.1f}%). "),
        F.lit("Re-run with --force-promote to override."),
    )
    passed = F.concat(
        F.lit("passed (prev="), _fixed(prev, 4), F.lit(" → new="), _fixed(new, 4),
        F.lit(", "), direction, F.lit(")"),
    )
    free = (
        F.when(F.col("force"), "force-promote flag set — gate bypassed")
        .when(F.lit(not settings.require_gate), "promotion gate disabled")
        .when(~F.col("has_previous"), "no baseline found — first run, promoting unconditionally")
        .when(prev.isNull(), "previous run has no forecast_mae — promoting unconditionally")
    )
    within = F.coalesce(new <= ceiling, F.lit(False))
    return candidates.withColumns(
        {
            "promoted": free.isNotNull() | within,
            "reason": F.coalesce(free, F.when(within, passed).otherwise(rejected)),
        }
    )


def with_previous(candidates: DataFrame, runs: DataFrame) -> DataFrame:
    """Pairs each candidate (model_version, new_mae, force) with the run that is promoted for
    its version now. One pre-aggregated row per version, so the join cannot fan out; that table
    is written and, where it proves small, broadcast, so that many candidates of one version do
    not meet in one task."""
    served = runs.filter("promoted").groupBy("model_version").agg(
        F.max_by(F.struct("run_id", "forecast_mae"), F.struct("generated_at", "run_id")).alias("p")
    )
    served = broadcast_if_small(written(served, "served"), SERVED_BROADCAST)
    return candidates.join(served, "model_version", "left").select(
        *candidates.columns,
        F.col("p").isNotNull().alias("has_previous"),
        F.col("p.forecast_mae").alias("prev_mae"),
    )


REPLAY_SCHEMA = "model_version string, run_id string, promoted boolean, baseline_run_id string, baseline_mae double"


def promotion_replay(runs: DataFrame, settings: Settings) -> DataFrame:
    """What the gate decides when the runs (model_version, generated_at, run_id, forecast_mae,
    force) of each version ask in the order of their time, and the baseline that each met.

    A run that is refused never becomes the baseline, so every decision depends on those before
    it: a fold along each version. The runs of a version come to one task as a sorted stream, of
    which the task holds a baseline and no more. An error figure that is missing or no number
    is refused where there is a baseline with one."""
    allowed = 1.0 + settings.max_mae_regression_pct / 100.0

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held = None, None  # the version, and (run, error) of its baseline
        for batch in batches:
            promoted, before = [], []
            for version, run, error, force in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if (version,) != current:
                    current, held = (version,), None
                error = None if error is None or isnan(error) else error
                free = force or not settings.require_gate or held is None or held[1] is None
                before.append(held or (None, None))
                promoted.append(bool(free or (error is not None and error <= held[1] * allowed)))
                if promoted[-1]:
                    held = (run, error)
            names, errors = zip(*before) if before else ((), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(promoted, pa.bool_()),
                 pa.array(names, pa.string()), pa.array(errors, pa.float64())],
                names=["model_version", "run_id", "promoted", "baseline_run_id", "baseline_mae"],
            )

    force = F.coalesce("force", F.lit(False)).alias("force")
    rows = runs.select("model_version", "generated_at", "run_id", F.col("forecast_mae").cast("double"), force)
    rows = spread(rows, "model_version").sortWithinPartitions("model_version", "generated_at", "run_id")
    return rows.drop("generated_at").mapInArrow(fold, REPLAY_SCHEMA)


def latest_run(runs: DataFrame) -> DataFrame:
    """The served run: newest promoted one; an empty table when there is none."""
    promoted = F.col("promotion_gate.promoted")
    return runs.filter(promoted).orderBy(F.desc("generated_at"), F.desc("run_id")).limit(1)


def run_health(runs: DataFrame, now: Column) -> DataFrame:
    """Always one row: `ok` with age, error and size of the served run, or `degraded`."""
    served = F.max_by(
        F.struct("model_version", "generated_at", "forecast_mae", "total_hotspots"),
        F.struct("generated_at", "run_id"),
    )
    one = runs.filter(F.col("promotion_gate.promoted")).agg(served.alias("r"))
    age = (F.unix_micros(now) - F.unix_micros("r.generated_at")) / 1e6
    return one.select(
        F.when(F.col("r").isNotNull(), "ok").otherwise("degraded").alias("status"),
        F.col("r.model_version").alias("model_version"),
        F.col("r").isNotNull().alias("artifacts_loaded"),
        F.col("r.generated_at").alias("artifact_generated_at"),
        F.when(F.col("r").isNotNull(), F.greatest(F.lit(0.0), age)).alias("artifact_age_seconds"),
        F.col("r.forecast_mae").alias("model_mae"),
        F.col("r.total_hotspots").alias("active_hotspots"),
    )


def append_run(spark: SparkSession, runs_path: str, row: dict) -> None:
    """Un-promoted runs are kept as well; the flag decides what is served."""
    spark.createDataFrame([row], RUN_SCHEMA).coalesce(1).write.mode("append").json(runs_path)


def read_runs(spark: SparkSession, runs_path: str) -> DataFrame:
    try:
        return spark.read.schema(RUN_SCHEMA).json(runs_path)
    except Exception as exc:
        if "PATH_NOT_FOUND" in str(exc):
            return spark.createDataFrame([], RUN_SCHEMA)
        raise


def file_fingerprint(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256) of every input file; each file is hashed whole by one task, so it suits
    files below 2 GB. A path that does not exist gives one row `unavailable`."""
    try:
        files = spark.read.format("binaryFile").load(path)
    except Exception as exc:
        if "PATH_NOT_FOUND" in str(exc):
            return spark.createDataFrame([(path, "unavailable")], "path string, sha256 string")
        raise
    return files.select("path", F.sha2("content", 256).alias("sha256"))


def row_fingerprint(df: DataFrame) -> DataFrame:
    """Order-free digest of a table of any size: row count, xor and sum of row hashes."""
    h = ticket(*[F.col(f"`{c}`") for c in df.columns])
    return df.agg(
        F.count("*").alias("n_rows"),
        F.bit_xor(h).alias("xor_hash"),
        F.sum(h % 1_000_003).alias("sum_hash"),
    )
