"""Validation, cleaning, first-wins dedupe, and the account of every rejected row.

The raw feed is all strings plus `ingest_order`, a unique sortable column that says which
of two rows came first. All flags are plain columns, so one scan yields them together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridwarden.config import Settings
from gridwarden.functions import parsing, text

REQUIRED = [
    "id",
    "latitude",
    "longitude",
    "vehicle_type",
    "violation_type",
    "junction_name",
    "police_station",
    "created_datetime",
]
ORDER = "ingest_order"

# Reason names, in the order of the checks.
MISSING = "missing_or_non_numeric_coordinates"
NON_FINITE = "non_finite_coordinates"
NULL_ISLAND = "null_island_coordinates"
OUTSIDE = "outside_service_geofence"
BAD_TIME = "unparseable_timestamp"
DUPLICATE = "duplicate_id"
REASONS = [MISSING, NON_FINITE, NULL_ISLAND, OUTSIDE, BAD_TIME, DUPLICATE]


def require_columns(raw: DataFrame) -> DataFrame:
    absent = [c for c in REQUIRED if c not in raw.columns]
    if absent:
        raise ValueError(f"feed lacks required columns: {absent}")
    return raw


def coerce(raw: DataFrame, settings: Settings) -> DataFrame:
    """Adds lat, lon, ts next to the untouched raw text."""
    return require_columns(raw).withColumns(
        {
            "lat": parsing.to_double(F.col("latitude")),
            "lon": parsing.to_double(F.col("longitude")),
            "ts": parsing.to_utc_timestamp(F.col("created_datetime"), settings.timestamp_formats),
        }
    )


def _inf(c: Column) -> Column:
    return F.abs(c) == F.lit(float("inf"))


def flag(raw: DataFrame, settings: Settings) -> DataFrame:
    """One boolean per reason but the duplicate one. Reasons may overlap: an infinite
    latitude is both non-finite and outside the geofence."""
    lat, lon = F.col("lat"), F.col("lon")
    typed = coerce(raw, settings)
    missing = lat.isNull() | lon.isNull()
    island = F.coalesce((lat == 0.0) | (lon == 0.0), F.lit(False))
    inside = F.coalesce(
        lat.between(settings.lat_min, settings.lat_max)
        & lon.between(settings.lon_min, settings.lon_max),
        F.lit(False),
    )
    infinite = F.coalesce(_inf(lat), F.lit(False)) | F.coalesce(_inf(lon), F.lit(False))
    geo_ok = inside & ~island  # inside means present and finite as well
    return typed.withColumns(
        {
            MISSING: missing,
            NON_FINITE: infinite & ~missing,
            NULL_ISLAND: island & ~missing,
            OUTSIDE: ~inside & ~missing & ~island,
            "keep_geo": geo_ok,
            BAD_TIME: geo_ok & F.col("ts").isNull(),
            "keep_row": geo_ok & F.col("ts").isNotNull(),
        }
    )


def keep_first(flagged: DataFrame) -> DataFrame:
    """The first raw row of every id, valid or not; null ids count as one id.

    `row_number() <= 1` lets each map task drop all but its own first row per id before the
    shuffle, so an id that holds a third of the feed costs one row per task.
    """
    order = Window.partitionBy("id").orderBy(ORDER)
    return flagged.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


def mark_duplicates(flagged: DataFrame) -> DataFrame:
    """Adds `duplicate_id` to every row, counted only among rows that are valid otherwise.

    The first order of each id is found by a pre-aggregated minimum and joined back on the
    order itself, which is unique: no id, however frequent, gathers its rows in one task.
    """
    first = flagged.groupBy("id").agg(F.min(ORDER).alias("first_order")).select("first_order")
    joined = flagged.join(first, flagged[ORDER] == first["first_order"], "left")
    return joined.withColumn(
        DUPLICATE, F.col("keep_row") & F.col("first_order").isNull()
    ).drop("first_order")


def normalise(valid: DataFrame, settings: Settings) -> DataFrame:
    """Typed coordinates and time in place of the text, normalised categories, weight."""
    vehicle = text.vehicle_type(F.col("vehicle_type"))
    typed = valid.withColumns(
        {
            "latitude": F.col("lat"),
            "longitude": F.col("lon"),
            "created_datetime": F.col("ts"),
            "vehicle_type": vehicle,
            "junction_name": text.junction(F.col("junction_name")),
            "police_station": text.station(F.col("police_station")),
            "violation_type_clean": text.violation_text(F.col("violation_type")),
        }
    )
    weighted = typed.withColumn("vehicle_weight", vehicle_weight(F.col("vehicle_type"), settings))
    return weighted.drop(
        "lat", "lon", "ts", "keep_geo", "keep_row", *[r for r in REASONS if r != DUPLICATE]
    )


def vehicle_weight(c: Column, settings: Settings) -> Column:
    """The rule table is a few dozen entries from settings, so a literal map, not a join."""
    default = F.lit(settings.default_vehicle_weight)
    if not settings.vehicle_weights:
        return default.cast("int")
    pairs = [F.lit(x) for kv in settings.vehicle_weights.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), c), default).cast("int")


def vehicle_weight_join(df: DataFrame, weights: DataFrame, settings: Settings) -> DataFrame:
    """The same lookup against a rule table of any size."""
    joined = df.join(weights, "vehicle_type", "left")
    weight = F.coalesce(F.col("weight"), F.lit(settings.default_vehicle_weight)).cast("int")
    return joined.withColumn("vehicle_weight", weight).drop("weight")


def clean(raw: DataFrame, settings: Settings) -> DataFrame:
    """Valid rows only. Dedupe runs over all raw rows: an invalid first row of an id shadows
    the valid ones after it."""
    return normalise(keep_first(flag(raw, settings)).filter("keep_row"), settings)


def report(raw: DataFrame, settings: Settings) -> DataFrame:
    """One row: totals, rejection rate, one count per reason, and the gate's verdict.

    Counted per id first, so the whole account is one scan and one narrow shuffle.
    """
    flagged = flag(raw, settings)
    scan_reasons = [r for r in REASONS if r != DUPLICATE]
    per_id = flagged.groupBy("id").agg(
        F.count("*").alias("n"),
        F.count_if("keep_row").alias("n_ok"),
        F.min_by("keep_row", ORDER).alias("first_ok"),
        *[F.count_if(r).alias(r) for r in scan_reasons],
    )
    total = F.coalesce(F.sum("n"), F.lit(0))
    valid = F.count_if("first_ok")
    counts = per_id.agg(
        total.alias("total_rows_seen"),
        valid.alias("valid_rows"),
        *[F.coalesce(F.sum(r), F.lit(0)).alias(r) for r in scan_reasons],
        (F.coalesce(F.sum("n_ok"), F.lit(0)) - valid).alias(DUPLICATE),
    )
    return with_verdict(counts, settings)


def with_verdict(counts: DataFrame, settings: Settings) -> DataFrame:
    """Adds rates and the verdict to (total_rows_seen, valid_rows); nothing read does not pass."""
    total, valid = F.col("total_rows_seen"), F.col("valid_rows")
    rate = F.when(total > 0, (total - valid) / total).otherwise(0.0)
    return counts.withColumns({"rejected_rows": total - valid, "rejection_rate": rate}).withColumn(
        "passed", (total > 0) & (F.col("rejection_rate") <= settings.max_rejection_rate)
    )


def reasons_long(one_row: DataFrame) -> DataFrame:
    """(reason, n) with the reasons that occurred."""
    long = one_row.unpivot([], REASONS, "reason", "n")
    return long.filter("n > 0")


def merge_reports(reports: DataFrame, settings: Settings) -> DataFrame:
    """Many report rows into one; the rate is recomputed, not averaged."""
    columns = ["total_rows_seen", "valid_rows", *REASONS]
    summed = reports.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in columns])
    return with_verdict(summed, settings)


def quarantine(raw: DataFrame, settings: Settings) -> DataFrame:
    """One row per rejected row and reason, with the raw row as JSON."""
    payload = F.to_json(F.struct(*REQUIRED), {"ignoreNullFields": "false"})
    marked = mark_duplicates(flag(raw, settings))
    hit = F.filter(
        F.array(*[F.when(F.col(r), F.lit(r)) for r in REASONS]), lambda r: r.isNotNull()
    )
    return marked.select(
        F.col(ORDER).alias("row_index"), F.explode(hit).alias("reason"), payload.alias("raw_payload")
    )


def strict_records(raw: DataFrame, settings: Settings) -> DataFrame:
    """The per-record contract: same geofence, stricter text rules, offences kept as a list,
    no dedupe."""
    ok = flag(raw, settings).filter(F.col("keep_row") & F.col("id").isNotNull())
    return ok.select(
        "id",
        F.col("lat").alias("latitude"),
        F.col("lon").alias("longitude"),
        text.strict_vehicle_type(F.col("vehicle_type")).alias("vehicle_type"),
        text.violation_array(F.col("violation_type")).alias("violation_type"),
        text.strict_junction(F.col("junction_name")).alias("junction_name"),
        text.strict_station(F.col("police_station")).alias("police_station"),
        F.col("ts").alias("created_datetime"),
    )


class QualityGateError(RuntimeError):
    """Too many rejected rows, or none read: the run stops before anything is published."""


def enforce_gate(report_row) -> None:
    if not report_row["total_rows_seen"]:
        raise QualityGateError("no rows were read")
    if not report_row["passed"]:
        raise QualityGateError(
            f"rejection rate {report_row['rejection_rate']:.4f} is above the allowed share"
        )
