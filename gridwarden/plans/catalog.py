"""Named queries over the given tables: one or more per operator of the library."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridwarden.config import NOISE, Settings
from gridwarden.functions import geo, text
from gridwarden.operators import (
    forecast,
    heatmap,
    impact,
    leaderboard,
    registry,
    rollups,
    temporal,
    validate,
)
from gridwarden.plans.literals import CUTS, LITERALS
from gridwarden.plans.standin import grid_assignments
from gridwarden.session import scratch_path, use_utc, written
from gridwarden.sources import store
from gridwarden.sources.adapter import events_feed, feed_from_events
from gridwarden.sources.feed import bad_lines, csv_options, read_feed, scan_csv_feed

S = Settings()
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(name: str):
    def register(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(use_utc(spark), sf_dir)

        QUERIES[name] = run
        return fn

    return register


# --- shared inputs -----------------------------------------------------------------------


def raw(spark: SparkSession, d: str) -> DataFrame:
    return events_feed(spark, d)


def clean(spark: SparkSession, d: str) -> DataFrame:
    return store.with_station_key(validate.clean(raw(spark, d), S))


def clustered(spark: SparkSession, d: str) -> DataFrame:
    return grid_assignments(clean(spark, d), S)


def clocked(spark: SparkSession, d: str) -> DataFrame:
    """Written, as the lookups below read these rows more than once."""
    return temporal.add_clock(written(clustered(spark, d), "clustered"))


def scored(spark: SparkSession, d: str) -> DataFrame:
    rows = temporal.add_rush_and_density(clocked(spark, d), S)
    return impact.add_severity(rows, S).withColumn("impact_score", impact.impact_score())


def facts(spark: SparkSession, d: str) -> tuple[DataFrame, object]:
    rows = written(clustered(spark, d), "clustered")
    bounds = temporal.read_time_bounds(rows)
    return rollups.incident_facts(rows, bounds["mid_time"], S), bounds


def board(spark: SparkSession, d: str) -> DataFrame:
    table, bounds = facts(spark, d)
    table = written(table, "facts")
    per_hotspot = rollups.impact_from_facts(table, S)
    recency = rollups.recency_from_facts(table, bounds["max_time"], S)
    return leaderboard.build_leaderboard(per_hotspot, recency, S)


def runs(spark: SparkSession, d: str) -> DataFrame:
    """Orders read as a run registry: a date, an error figure, a promoted flag."""
    orders = spark.read.parquet(f"{d}/orders.parquet")
    key = F.col("o_orderkey")
    return orders.select(
        key.cast("string").alias("run_id"),
        F.concat(F.lit("v"), (F.col("o_custkey") % 50).cast("string")).alias("model_version"),
        F.col("o_orderdate").cast("timestamp").alias("generated_at"),
        F.when(key % 17 != 0, F.col("o_totalprice") / 100000).alias("forecast_mae"),
        (key % 1000).alias("total_hotspots"),
        F.struct((F.col("o_orderstatus") != "F").alias("promoted")).alias("promotion_gate"),
    )


def candidates(spark: SparkSession, d: str) -> DataFrame:
    """Line items read as finished runs that ask for promotion."""
    items = spark.read.parquet(f"{d}/lineitem.parquet")
    return items.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("candidate"),
        F.concat(F.lit("v"), (F.col("l_partkey") % 60).cast("string")).alias("model_version"),
        (F.col("l_extendedprice") / 25000).alias("new_mae"),
        ((F.col("l_returnflag") == "A") & (F.col("l_linenumber") == 1)).alias("force"),
    )


def requests(spark: SparkSession, d: str) -> DataFrame:
    """Every incident asks for a forecast of its cluster; some ask badly."""
    rows = clustered(spark, d)
    number = F.col("id").cast("bigint")
    return rows.select(
        "id",
        F.when(number % 41 == 0, F.lit("  ")).otherwise(F.col("cluster_id")).alias("cluster_id"),
        (number % 26).cast("int").alias("hour"),
        (number % 8).cast("int").alias("day_of_week"),
    )


def micros(column: str):
    return F.unix_micros(F.col(column))


def r(column, digits: int = 6):
    return F.round(column, digits)


def mean_degrees(column: str):
    """A mean coordinate at six decimals. Inputs have six decimals too, so plain rounding
    would often meet exact ties, which the order of a sum decides; the shift avoids them."""
    return F.round(F.col(column) + 1.3717e-7, 6).alias(column)


ROWS_A_FILE = 200_000  # of a drop of the feed
JOIN_BUCKETS = 16  # of the small tables here; a tenth of a gigabyte a bucket is a good measure


# --- scans, sources, sinks ---------------------------------------------------------------


def write_csv_feed(spark: SparkSession, d: str, extra_cell: bool = False) -> str:
    path = scratch_path(spark, "feed-csv")
    feed = raw(spark, d)
    writer_options = {
        **csv_options(),
        "ignoreLeadingWhiteSpace": "false",
        "ignoreTrailingWhiteSpace": "false",
        "emptyValue": "",
    }
    writer_options.pop("mode")
    writer_options.pop("enforceSchema")
    feed.drop(validate.ORDER).write.options(**writer_options).csv(path)
    return path


@query("scan_csv_feed")
def q_scan_csv(spark, d):
    return scan_csv_feed(spark, write_csv_feed(spark, d)).drop(validate.ORDER)


@query("bad_lines")
def q_bad_lines(spark, d):
    """Feed lines with a cell too many (dropped) and with cells missing (padded)."""
    e = F.col(validate.ORDER)
    cells = [F.coalesce(F.col(c), F.lit("")) for c in ("id", "latitude", "longitude")]
    tail = [F.lit(x) for x in ("CAR", "NO PARKING", "", "Station 1", "2024-01-01")]
    line = F.concat_ws(",", *cells, *tail)
    lines = raw(spark, d).select(
        F.when(e % 50 == 3, F.concat(line, F.lit(",surplus")))
        .when(e % 50 == 4, F.concat_ws(",", *cells))
        .otherwise(line)
        .alias("value")
    )
    path = scratch_path(spark, "bad-lines")
    lines.write.text(path)
    return bad_lines(spark, path, header=False)


@query("null_tokens")
def q_null_tokens(spark, d):
    """One cell per event, holding in turn each missing-value token or a real text."""
    e = F.col("event_id")
    words = [*text.NA_TOKENS, "null and void", "none"]
    cell = F.element_at(
        F.array(*[F.lit(w) for w in words]), ((e % len(words)) + 1).cast("int")
    )
    events = spark.read.parquet(f"{d}/events.parquet")
    return events.select("event_id", text.na_to_null(cell).alias("cell"))


@query("ingest_incremental")
def q_ingest_incremental(spark, d):
    """The feed arrives as four drops, taken in one by one; the merged report of all."""
    from gridwarden.streaming import ingest

    drops, root = scratch_path(spark, "drops"), scratch_path(spark, "stream")
    feed = raw(spark, d).withColumn("drop", F.expr("coalesce(pmod(ingest_order div 131, 4), 0)"))
    sizes = {r["drop"]: r["count"] for r in feed.groupBy("drop").count().collect()}
    for drop in range(4):
        files = sizes.get(drop, 0) // ROWS_A_FILE + 1
        (
            feed.where(F.col("drop") == drop)
            .repartitionByRange(files, validate.ORDER)
            .sortWithinPartitions(validate.ORDER)
            .select(*validate.REQUIRED)
            .write.mode("append")
            .options(
                header="true",
                escape='"',
                ignoreLeadingWhiteSpace="false",
                ignoreTrailingWhiteSpace="false",
                emptyValue="",
            )
            .csv(drops)
        )
        ingest.ingest_available(spark, drops, root, S)
    return validate.merge_reports(ingest.batch_reports(spark, root), S)


@query("read_feed")
def q_read_feed(spark, d):
    path = scratch_path(spark, "feed-parquet")
    raw(spark, d).write.parquet(path)
    feed = read_feed(spark, "parquet", path, S)
    return feed.groupBy("police_station").agg(F.count("*").alias("n"))


def stored_clean(spark, d) -> str:
    root = scratch_path(spark, "clean")
    store.write_partitioned(clean(spark, d), root)
    return root


@query("write_partitioned")
def q_write_partitioned(spark, d):
    table = store.read_table(spark, stored_clean(spark, d))
    return table.select(
        "id", "latitude", "longitude", "police_station", "station_key", "vehicle_weight",
        "violation_type_clean", micros("created_datetime").alias("created_us"),
    )


@query("station_key")
def q_station_key(spark, d):
    feed = raw(spark, d).select("police_station").distinct()
    pages = spark.read.parquet(f"{d}/pages.parquet").select(F.col("url").alias("police_station"))
    return (
        feed.union(pages)
        .distinct()
        .select("police_station", text.station_key(F.col("police_station")).alias("station_key"))
    )


@query("list_stations")
def q_list_stations(spark, d):
    return store.list_stations(store.read_table(spark, stored_clean(spark, d)))


@query("read_station")
def q_read_station(spark, d):
    rows = store.read_station(spark, stored_clean(spark, d), "Station_3")
    return rows.select("id", "latitude", "longitude", "junction_name")


@query("read_columns")
def q_read_columns(spark, d):
    rows = store.read_columns(spark, stored_clean(spark, d), ["id", "created_datetime"])
    return rows.select("id", micros("created_datetime").alias("created_us"))


@query("write_table")
def q_write_table(spark, d):
    path = scratch_path(spark, "board")
    store.write_table(board(spark, d), path)
    return spark.read.parquet(path).select("rank", "cluster_id", r("priority_score", 4).alias("priority_score"))


def stored_assignments(spark, d) -> tuple[DataFrame, DataFrame]:
    rows = store.read_table(spark, stored_clean(spark, d))
    root = scratch_path(spark, "assignments")
    assigned = grid_assignments(rows, S).select("station_key", "id", "cluster_id")
    store.write_partitioned(assigned, root)
    return rows, store.read_table(spark, root)


@query("write_assignments")
def q_write_assignments(spark, d):
    return stored_assignments(spark, d)[1].select("station_key", "id", "cluster_id")


@query("join_assignments")
def q_join_assignments(spark, d):
    rows, assigned = stored_assignments(spark, d)
    hot = temporal.hotspots(assigned)  # noise rows find no partner
    return store.join_assignments(rows, hot).select("id", "station_key", "cluster_id")


@query("join_colocated")
def q_join_colocated(spark, d):
    """The same join over tables in buckets of station and id."""
    rows, assigned = stored_assignments(spark, d)
    paths = [scratch_path(spark, name) for name in ("clean-buckets", "label-buckets")]
    for table, path in zip((rows, temporal.hotspots(assigned)), paths):
        store.write_bucketed(table, path, JOIN_BUCKETS)
    stored = [store.read_bucketed(spark, path, JOIN_BUCKETS) for path in paths]
    return store.join_bucketed(*stored).select("id", "station_key", "cluster_id")


@query("load_rules")
def q_load_rules(spark, d):
    """A rule file over the defaults, applied to the feed."""
    import tempfile
    from pathlib import Path

    from gridwarden.config import load_rules

    with tempfile.TemporaryDirectory() as folder:
        path = Path(folder) / "rules.yaml"
        path.write_text("severity_mapping:\n  FOOTPATH: 4.0\n  CROSSING: 9.5\n")
        settings = load_rules(S, path)
    rows = impact.add_severity(clean(spark, d), settings)
    return rows.groupBy("severity").agg(F.count("*").alias("n"))


# --- validation --------------------------------------------------------------------------


@query("require_columns")
def q_require_columns(spark, d):
    feed = validate.require_columns(raw(spark, d))
    counts = feed.agg(*[F.count(c).alias(c) for c in validate.REQUIRED])
    return counts.unpivot([], validate.REQUIRED, "column_name", "n_present")


@query("coerce_coordinates")
def q_coerce(spark, d):
    return validate.coerce(raw(spark, d), S).select(
        F.col(validate.ORDER).alias("row_index"),
        F.when(F.abs("lat") != F.lit(float("inf")), F.col("lat")).alias("lat"),
        (F.abs("lat") == F.lit(float("inf"))).alias("lat_infinite"),
        "lon",
    )


@query("coerce_timestamp")
def q_coerce_timestamp(spark, d):
    return validate.coerce(raw(spark, d), S).select(
        F.col(validate.ORDER).alias("row_index"), micros("ts").alias("created_us")
    )


def _reason_query(reason: str):
    def run(spark, d):
        return validate.flag(raw(spark, d), S).filter(reason).select(
            F.col(validate.ORDER).alias("row_index"), "id", "latitude", "longitude"
        )

    query(reason)(run)


for _reason in validate.REASONS[:-1]:
    _reason_query(_reason)


@query("keep_geo")
def q_keep_geo(spark, d):
    return validate.flag(raw(spark, d), S).select(
        F.col(validate.ORDER).alias("row_index"), "keep_geo"
    )


@query("duplicate_id")
def q_duplicates(spark, d):
    marked = validate.mark_duplicates(validate.flag(raw(spark, d), S))
    return marked.filter(validate.DUPLICATE).select(
        F.col(validate.ORDER).alias("row_index"), "id"
    )


@query("dedupe_keep_first")
def q_keep_first(spark, d):
    return validate.keep_first(validate.flag(raw(spark, d), S)).select(
        F.col(validate.ORDER).alias("row_index"), "id"
    )


@query("validate_filter")
def q_validate_filter(spark, d):
    return validate.clean(raw(spark, d), S).select(
        "id", "latitude", "longitude", "vehicle_type", "junction_name", "police_station",
        "violation_type_clean", "vehicle_weight", micros("created_datetime").alias("created_us"),
    )


def _normal_query(name: str, column: str, fn):
    def run(spark, d):
        pair = raw(spark, d).select(
            F.col(column).alias("raw_text"), fn(F.col(column)).alias("clean_text")
        )
        return pair.groupBy("raw_text", "clean_text").agg(F.count("*").alias("n"))

    query(name)(run)


_normal_query("normalize_vehicle_type", "vehicle_type", text.vehicle_type)
_normal_query("normalize_junction", "junction_name", text.junction)
_normal_query("normalize_station", "police_station", text.station)
_normal_query("parse_violation_list", "violation_type", text.violation_text)


@query("parse_violation_array")
def q_violation_array(spark, d):
    """Both forms: the stringified list, and a source that delivers arrays."""
    as_text = text.violation_array(F.col("violation_type"))
    events = spark.read.parquet(f"{d}/events.parquet")
    feed = feed_from_events(events, carry=["event_id", "props"])
    return feed.select(
        "event_id",
        F.array_join(as_text, "|").alias("items"),
        F.size(as_text).alias("n_items"),
        F.array_join(text.violation_array_from_list(F.split("props", ":")), "|").alias("list_items"),
    )


def _filled(pattern: str):
    parts = re.split(r"\{([abAB])\}", pattern)
    names = {"a": F.element_at(F.split("p_name", " "), 1), "b": F.col("p_brand")}
    names |= {k.upper(): F.upper(v) for k, v in names.items()}
    return F.concat(*[names[x] if i % 2 else F.lit(x) for i, x in enumerate(parts)])


@query("parse_literals")
def q_literals(spark, d):
    """Names of parts, written as literals of every form."""
    part = spark.read.parquet(f"{d}/part.parquet")
    forms = F.array(*[_filled(given) for given, _ in LITERALS])
    rows = part.select("p_partkey", F.get(forms, (F.col("p_partkey") % len(LITERALS)).cast("int")).alias("given"))
    items = text.violation_array(F.col("given"))
    return rows.select("p_partkey", "given", F.array_join(items, "|").alias("items"), F.size(items).alias("n_items"))


@query("vehicle_weight")
def q_vehicle_weight(spark, d):
    rows = clean(spark, d)
    return rows.groupBy("vehicle_type", "vehicle_weight").agg(F.count("*").alias("n"))


@query("vehicle_weight_join")
def q_vehicle_weight_join(spark, d):
    """The lookup against a rule table that Spark derives from the parts."""
    part = spark.read.parquet(f"{d}/part.parquet")
    rules = (
        part.groupBy(F.col("p_brand").alias("vehicle_type"))
        .agg((F.max("p_size") % 5).cast("int").alias("weight"))
        .filter("weight > 0")
    )
    parts = part.select("p_partkey", F.col("p_brand").alias("vehicle_type"))
    return validate.vehicle_weight_join(parts, rules, S).select("p_partkey", "vehicle_weight")


@query("strict_record")
def q_strict(spark, d):
    return validate.strict_records(raw(spark, d), S).select(
        "id", "latitude", "longitude", "vehicle_type",
        F.array_join("violation_type", "|").alias("violations"),
        "junction_name", "police_station", micros("created_datetime").alias("created_us"),
    )


@query("quarantine")
def q_quarantine(spark, d):
    return validate.quarantine(raw(spark, d), S)


@query("ingestion_report")
def q_report(spark, d):
    return validate.report(raw(spark, d), S)


@query("rejection_reasons")
def q_reasons(spark, d):
    return validate.reasons_long(validate.report(raw(spark, d), S))


def batch_reports(spark, d) -> DataFrame:
    """One report per batch of the feed; a batch is the rows of one user bucket."""
    flagged = validate.mark_duplicates(validate.flag(raw(spark, d), S))
    batch = F.expr("ingest_order div 1310").alias("batch")
    return flagged.groupBy(batch).agg(
        F.count("*").alias("total_rows_seen"),
        F.count_if(F.col("keep_row") & ~F.col(validate.DUPLICATE)).alias("valid_rows"),
        *[F.count_if(reason).alias(reason) for reason in validate.REASONS],
    )


@query("merge_reports")
def q_merge_reports(spark, d):
    return validate.merge_reports(batch_reports(spark, d), S)


@query("quality_gate")
def q_quality_gate(spark, d):
    return validate.with_verdict(batch_reports(spark, d), S).select("batch", "passed")


# --- projections, joins and rollups over the stand-in clusters ---------------------------


@query("noise_filter")
def q_noise_filter(spark, d):
    return temporal.hotspots(clustered(spark, d)).select("id", "cluster_id")


@query("fill_noise")
def q_fill_noise(spark, d):
    """Only hotspot rows have an assignment; the join fills in noise."""
    assigned = temporal.hotspots(clustered(spark, d)).select("station_key", "id", "cluster_id")
    rows = store.join_assignments(clean(spark, d), assigned)
    return rows.groupBy((F.col("cluster_id") == NOISE).alias("is_noise")).agg(
        F.count("*").alias("n")
    )


@query("namespace_cluster")
def q_namespace(spark, d):
    from gridwarden.operators.density import namespace_cluster

    number = F.col("id").cast("bigint")
    return clean(spark, d).select("id", namespace_cluster(number % 3 - 1).alias("cluster_id"))


@query("temporal_features")
def q_temporal(spark, d):
    return clocked(spark, d).select(
        "id", "hour", "day_of_week", "day_of_week_num", "is_weekend", "month",
        F.col("date").cast("string").alias("date"),
    )


@query("severity")
def q_severity(spark, d):
    rows = impact.add_severity(clean(spark, d), S)
    return rows.groupBy("violation_type_clean", "severity").agg(F.count("*").alias("n"))


@query("rules_join")
def q_rules_join(spark, d):
    """Keyword containment against a rule table made of part-name words, over part names."""
    part = spark.read.parquet(f"{d}/part.parquet")
    rules = part.groupBy(F.col("p_type").alias("keyword")).agg(
        F.max("p_size").cast("double").alias("weight")
    )
    texts = part.select(
        "p_partkey", F.concat_ws(" ", "p_name", "p_type", "p_brand").alias("violation_type_clean")
    )
    return impact.severity_by_rule_table(texts, rules, S).select("p_partkey", "severity")


@query("join_density")
def q_join_density(spark, d):
    return impact.add_density(clustered(spark, d)).select("id", "cluster_density")


@query("cluster_density")
def q_density(spark, d):
    return impact.density(clustered(spark, d))


@query("time_bounds")
def q_time_bounds(spark, d):
    return temporal.time_bounds(clean(spark, d)).select(
        micros("min_time").alias("min_us"),
        micros("max_time").alias("max_us"),
        micros("mid_time").alias("mid_us"),
    )


@query("hour_counts")
def q_hour_counts(spark, d):
    return temporal.hour_counts(clocked(spark, d))


@query("cluster_median_hourly")
def q_medians(spark, d):
    return temporal.hour_medians(temporal.hour_counts(clocked(spark, d)))


@query("join_hour_counts")
def q_join_hour_counts(spark, d):
    return temporal.join_hour_counts(clocked(spark, d)).select("id", "violations_in_hour")


@query("join_cluster_median")
def q_join_median(spark, d):
    return temporal.join_cluster_median(clocked(spark, d)).select("id", "cluster_median_hourly")


@query("rush_hour_factor")
def q_rush(spark, d):
    return temporal.add_rush_hour(clocked(spark, d), S).select("id", "rush_hour_factor")


@query("impact_score")
def q_impact_score(spark, d):
    return scored(spark, d).select("id", "cluster_id", "impact_score")


def _impact_columns(df: DataFrame) -> DataFrame:
    return df.select(
        "cluster_id", "junction_name", "police_station",
        mean_degrees("center_latitude"),
        mean_degrees("center_longitude"),
        "total_violations",
        r("total_impact_score", 4).alias("total_impact_score"),
        r("average_impact_per_vehicle", 4).alias("average_impact_per_vehicle"),
        "high_severity_incidents",
    )


@query("hotspot_impact")
def q_hotspot_impact(spark, d):
    table = written(facts(spark, d)[0], "facts")  # read several times
    return _impact_columns(rollups.impact_from_facts(table, S))


@query("hotspot_impact_from_rows")
def q_hotspot_impact_rows(spark, d):
    return _impact_columns(impact.hotspot_impact(scored(spark, d), S))


@query("hourly_trend")
def q_trend(spark, d):
    return rollups.hourly_trend(clustered(spark, d)).select(
        F.col("date").cast("string").alias("date"),
        "cluster_id", "day_of_week_num", "hour", "hourly_violation_count",
    )


def _recency_columns(df: DataFrame) -> DataFrame:
    return df.select(
        "cluster_id",
        micros("latest_incident").alias("latest_us"),
        r("recency_factor").alias("recency_factor"),
        r("growth_rate").alias("growth_rate"),
    )


@query("recency_growth")
def q_recency(spark, d):
    rows = written(clustered(spark, d), "clustered")
    bounds = temporal.read_time_bounds(rows)
    return _recency_columns(
        rollups.recency_growth(rows, bounds["max_time"], bounds["mid_time"], S)
    )


@query("recency_factor")
def q_recency_factor(spark, d):
    table, bounds = facts(spark, d)
    return _recency_columns(rollups.recency_from_facts(table, bounds["max_time"], S)).select(
        "cluster_id", "recency_factor"
    )


@query("growth_rate")
def q_growth(spark, d):
    table, bounds = facts(spark, d)
    return _recency_columns(rollups.recency_from_facts(table, bounds["max_time"], S)).select(
        "cluster_id", "growth_rate"
    )


@query("station_cluster_stats")
def q_station_stats(spark, d):
    from gridwarden.operators.density import station_stats

    return station_stats(clustered(spark, d))


@query("cluster_totals")
def q_cluster_totals(spark, d):
    from gridwarden.operators.density import cluster_totals, station_stats

    return cluster_totals(station_stats(clustered(spark, d)))


@query("total_hotspots")
def q_total_hotspots(spark, d):
    return temporal.total_hotspots(clustered(spark, d))


@query("non_noise_labels")
def q_labels(spark, d):
    return temporal.hotspots(clustered(spark, d)).select("cluster_id").distinct()


@query("union_rollups")
def q_union(spark, d):
    """Two feeds rolled up apart and laid end to end."""
    rows = written(clustered(spark, d), "clustered")
    early = rollups.hourly_trend(rows.filter("hour(created_datetime) < 12"))
    late = rollups.hourly_trend(rows.filter("hour(created_datetime) >= 12"))
    return early.unionByName(late).select("cluster_id", "hour", "hourly_violation_count")


@query("typed_empty")
def q_typed_empty(spark, d):
    """All rows noise: the rollup is empty and still has its columns."""
    rows = clustered(spark, d).withColumn("cluster_id", F.lit(NOISE))
    return _impact_columns(impact.hotspot_impact(_with_scores(rows), S))


def _with_scores(rows: DataFrame) -> DataFrame:
    timed = temporal.add_rush_and_density(temporal.add_clock(rows), S)
    return impact.add_severity(timed, S).withColumn("impact_score", impact.impact_score())


@query("haversine_radians")
def q_haversine(spark, d):
    """Distance of every clean row to the middle of the geofence."""
    mid_lat, mid_lon = F.lit((S.lat_min + S.lat_max) / 2), F.lit((S.lon_min + S.lon_max) / 2)
    angle = geo.haversine_degrees(F.col("latitude"), F.col("longitude"), mid_lat, mid_lon)
    return clean(spark, d).select("id", r(angle, 9).alias("angle"))


# --- leaderboard and the read queries ----------------------------------------------------


@query("leaderboard")
def q_leaderboard(spark, d):
    return board(spark, d).select(
        "rank", "cluster_id", "junction_name", "police_station",
        mean_degrees("center_latitude"),
        mean_degrees("center_longitude"),
        "total_violations",
        r("total_impact_score", 4).alias("total_impact_score"),
        "high_severity_incidents",
        r("recency_factor").alias("recency_factor"),
        r("growth_rate").alias("growth_rate"),
        r("priority_score", 4).alias("priority_score"),
        "status", "recommendation",
    )


def _score_rows(spark, d) -> DataFrame:
    table, bounds = facts(spark, d)
    table = written(table, "facts")
    per_hotspot = rollups.impact_from_facts(table, S)
    recency = rollups.recency_from_facts(table, bounds["max_time"], S)
    return leaderboard.score_board(per_hotspot, recency, S)


@query("join_leaderboard")
def q_join_leaderboard(spark, d):
    return _score_rows(spark, d).select(
        "cluster_id", "total_violations", r("growth_rate").alias("growth_rate")
    )


@query("priority_score")
def q_priority(spark, d):
    return _score_rows(spark, d).select("cluster_id", r("priority_score", 4).alias("priority_score"))


@query("dispatch_status")
def q_status(spark, d):
    return _score_rows(spark, d).select("cluster_id", "status")


@query("recommendation")
def q_recommendation(spark, d):
    return _score_rows(spark, d).select("cluster_id", "recommendation")


@query("rank_leaderboard")
def q_rank(spark, d):
    return board(spark, d).select("rank", "cluster_id")


@query("hotspot_summary")
def q_summary(spark, d):
    return _summary(leaderboard.hotspot_summary(board(spark, d)))


def _summary(df: DataFrame) -> DataFrame:
    return df.select(
        "cluster_id", "rank", "junction_name", "police_station",
        mean_degrees("center_latitude"),
        mean_degrees("center_longitude"),
        "total_violations", r("priority_score", 4).alias("priority_score"),
        "status", "recommendation",
    )


@query("top_hotspots")
def q_top(spark, d):
    return _summary(leaderboard.top_hotspots(board(spark, d), 25))


@query("dispatch_directives")
def q_directives(spark, d):
    return leaderboard.dispatch_directives(board(spark, d))


@query("lookup_hotspot")
def q_lookup(spark, d):
    path = scratch_path(spark, "board")
    store.write_indexed(board(spark, d), path, "cluster_id")
    table = spark.read.parquet(path)
    best = table.filter("rank = 1").first()["cluster_id"]
    return _summary(leaderboard.lookup_hotspot(table, best))


@query("primary_offense")
def q_primary_offense(spark, d):
    """The heaviest rule, and how many incidents of each station name it."""
    word = leaderboard.primary_offense(S)
    rows = clean(spark, d).filter(F.col("violation_type_clean").contains(F.lit(word)))
    return rows.groupBy("station_key").agg(
        F.count("*").alias("n"), F.max(F.initcap(F.lit(word))).alias("primary_offense")
    )


@query("kpis")
def q_kpis(spark, d):
    served = registry.latest_run(runs(spark, d))
    return leaderboard.kpis(board(spark, d), served, S).select(
        "total_active_hotspots",
        r("top_priority_score", 4).alias("top_priority_score"),
        "top_priority_junction", "primary_offense", "model_mae", "model_version",
        micros("generated_at").alias("generated_us"),
    )


# --- map layers --------------------------------------------------------------------------


@query("marker_radius")
def q_marker_radius(spark, d):
    return _score_rows(spark, d).select("cluster_id", heatmap.marker_radius().alias("radius"))


@query("marker_labels")
def q_marker_labels(spark, d):
    return heatmap.markers(_score_rows(spark, d)).select("cluster_id", "tooltip", "popup")


def _heatmap_sample(spark, d, settings):
    rows = written(clean(spark, d).select("station_key", "id", "latitude", "longitude"), "points")
    budget = heatmap.station_budget(rows, settings)
    return heatmap.heatmap_sample(rows, budget, settings).select("station_key", "id")


@query("heatmap_sample")
def q_heatmap_sample(spark, d):
    return _heatmap_sample(spark, d, S)


@query("heatmap_sample_cut")
def q_heatmap_sample_cut(spark, d):
    """The same with a tenth of the points, so that small tables show the cut, too."""
    return _heatmap_sample(spark, d, Settings(heatmap_max_points=2_000))


@query("cap_sample")
def q_cap_sample(spark, d):
    return heatmap.cap_sample(clean(spark, d), S).select("station_key", "id")


@query("cap_sample_cut")
def q_cap_sample_cut(spark, d):
    settings = Settings(heatmap_max_points=2_000)
    return heatmap.cap_sample(clean(spark, d), settings).select("station_key", "id")


@query("map_center")
def q_map_center(spark, d):
    return heatmap.map_center(clean(spark, d)).select(
        mean_degrees("center_latitude"),
        mean_degrees("center_longitude"),
    )


# --- forecast ----------------------------------------------------------------------------

@query("label_encode")
def q_label_encode(spark, d):
    return forecast.label_encode(rollups.hourly_trend(clustered(spark, d)))


@query("join_encoding")
def q_join_encoding(spark, d):
    trend = written(rollups.hourly_trend(clustered(spark, d)), "trend")
    encoding = written(forecast.label_encode(trend), "encoding")
    return forecast.encode(trend, encoding, S).select(
        F.col("date").cast("string").alias("date"), "cluster_id", "hour", "cluster_id_encoded",
        "hourly_violation_count",
    )


@query("validate_requests")
def q_validate_requests(spark, d):
    good, bad = forecast.validate_requests(requests(spark, d))
    both = good.withColumn("reject_reason", F.lit("ok")).unionByName(bad)
    return both.select("id", "reject_reason")


def _request_split(spark, d):
    trend = rollups.hourly_trend(clustered(spark, d))
    labels = trend.select("cluster_id").distinct()
    return forecast.validate_requests(requests(spark, d))[0], labels


@query("known_clusters")
def q_known(spark, d):
    return forecast.known_clusters(*_request_split(spark, d)).select("id", "cluster_id")


@query("unknown_clusters")
def q_unknown(spark, d):
    return forecast.unknown_clusters(*_request_split(spark, d)).select("id", "cluster_id")


@query("train_test_split")
def q_split(spark, d):
    trend = rollups.hourly_trend(clustered(spark, d))
    return trend.groupBy(forecast.split_flag(S).alias("held_out")).agg(F.count("*").alias("n"))


def _trained(spark, d):
    trend = written(rollups.hourly_trend(clustered(spark, d)), "trend")
    return trend, forecast.train_forecast(trend, S)


@query("train_forecast")
def q_train(spark, d):
    """Row counts of both shares, and whether the trees beat the mean on the held-out one."""
    trend, model = _trained(spark, d)
    flagged = trend.withColumn("held_out", forecast.split_flag(S))
    mean = flagged.filter("NOT held_out").agg(F.avg(forecast.LABEL)).first()[0]
    held = flagged.filter("held_out").withColumn("prediction", F.lit(mean))
    return forecast.forecast_mae(held).select(
        F.lit(model.n_train).cast("bigint").alias("n_train"), "n_test",
        (F.lit(model.mae) < F.col("forecast_mae")).alias("beats_mean"),
    )


@query("feature_importance")
def q_importance(spark, d):
    _, model = _trained(spark, d)
    return forecast.feature_importance(model.model.nodes)


def _first_tree(spark, d):
    trend = written(rollups.hourly_trend(clustered(spark, d)), "trend")
    return forecast.train_forecast(trend, replace(S, n_trees=1))


@query("forecast_first_tree")
def q_first_tree(spark, d):
    """Every node of the first tree: its split and gain, or the value of the leaf."""
    nodes = _first_tree(spark, d).model.nodes.where("tree = 0")
    return nodes.select("node", "feature", "upper", "n_rows", r("gain").alias("gain"), r("value", 9).alias("value"))


@query("first_tree_importance")
def q_first_tree_importance(spark, d):
    return forecast.feature_importance(_first_tree(spark, d).model.nodes)


@query("first_tree_predictions")
def q_first_tree_predictions(spark, d):
    """The rounded answer to every request that the model of one tree can answer."""
    good, _ = forecast.predict_batch(requests(spark, d), _first_tree(spark, d), S)
    return good.select("id", "cluster_id", "hour", "day_of_week", "predicted_violations")


@query("predict_batch")
def q_predict(spark, d):
    """Every request with its fate; the prediction itself depends on the trees."""
    _, model = _trained(spark, d)
    good, bad = forecast.predict_batch(requests(spark, d), model, S)
    answered = good.select(
        "id", "cluster_id", "hour", "day_of_week", F.lit("ok").alias("status"),
        (F.col("predicted_violations") >= 0).alias("has_prediction"), "model_version",
    )
    refused = bad.select(
        "id", "cluster_id", "hour", "day_of_week", F.col("reject_reason").alias("status"),
        F.lit(False).alias("has_prediction"), F.lit(None).cast("string").alias("model_version"),
    )
    return answered.unionByName(refused)


# --- registry ----------------------------------------------------------------------------


def _served(spark, d) -> DataFrame:
    return runs(spark, d).withColumn("promoted", F.col("promotion_gate.promoted"))


@query("promotion_gate")
def q_gate(spark, d):
    paired = registry.with_previous(candidates(spark, d), _served(spark, d))
    return registry.promotion_gate(paired, S).select("candidate", "promoted", "reason")


@query("block_fingerprint")
def q_block_fingerprint(spark, d):
    """Of every file of the events table, in blocks small enough that there are several."""
    from gridwarden.sources.blocks import block_fingerprint

    found = block_fingerprint(spark, f"{d}/events.parquet", block=4096, fan=8)
    return found.select(F.element_at(F.split("path", "/"), -1).alias("file"), "n_bytes", "digest")


@query("promotion_replay")
def q_replay(spark, d):
    """Every run of the registry asks again, in the order of time."""
    rows = runs(spark, d).withColumn("force", F.col("run_id").cast("bigint") % 97 == 5)
    return registry.promotion_replay(rows, S)


@query("latest_run")
def q_latest(spark, d):
    return registry.latest_run(runs(spark, d)).select(
        "run_id", "model_version", micros("generated_at").alias("generated_us")
    )


@query("run_health")
def q_health(spark, d):
    now = F.lit("2024-06-01 00:00:00").cast("timestamp")
    return registry.run_health(runs(spark, d), now).select(
        "status", "model_version", "artifacts_loaded",
        micros("artifact_generated_at").alias("generated_us"),
        "artifact_age_seconds", r("model_mae").alias("model_mae"), "active_hotspots",
    )


@query("input_fingerprint")
def q_fingerprint(spark, d):
    return registry.row_fingerprint(raw(spark, d))


@query("file_fingerprint")
def q_file_fingerprint(spark, d):
    return registry.file_fingerprint(spark, f"{d}/events.parquet").select("sha256")


# --- density clusters and the whole run --------------------------------------------------

def density_assignments(spark: SparkSession, d: str) -> DataFrame:
    from gridwarden.operators.density import cluster_hotspots

    return cluster_hotspots(written(clean(spark, d), "clean"), S)


@query("core_distances")
def q_core_distances(spark, d):
    """Metres to the k-th nearest other row, for every distinct place of a station."""
    from gridwarden.operators.core_distance import core_distances
    from gridwarden.operators.quadtree import distinct_points

    cored = core_distances(distinct_points(clean(spark, d), S))
    return cored.select(
        "station_key", "first_id", F.round(F.col("core") * 6_371_000 + 1.37e-3, 1).alias("core_metres")
    )


@query("linkage_cut")
def q_linkage_cut(spark, d):
    """The tree that the clusters are read from, cut at fixed heights."""
    from gridwarden.operators.density import linkage_cut

    return linkage_cut(written(clean(spark, d), "clean"), S, CUTS)


@query("cluster_hotspots")
def q_cluster(spark, d):
    return density_assignments(spark, d)


@query("cluster_recovery")
def q_cluster_recovery(spark, d):
    """The feed plants five dense places in every named station, far apart for their size. Each
    must come back as one cluster of its own that holds all of its rows, once it has clearly
    more rows than a cluster needs."""
    rows = clean(spark, d).select("station_key", "id", F.col("id").cast("bigint").alias("e"))
    planted = rows.withColumn("h", (F.col("e") * 7919 + 13) % 1000).where(
        "h < 900 AND station_key <> 'Unknown'"
    )
    found = density_assignments(spark, d).select("station_key", "id", "cluster_id")
    named = F.when(F.col("cluster_id") != NOISE, F.col("cluster_id"))
    places = (
        planted.join(found, ["station_key", "id"])
        .groupBy("station_key", (F.col("h") % 5).alias("place"))
        .agg(
            F.count("*").alias("n_rows"),
            F.count(named).alias("n_in_clusters"),
            F.count_distinct(named).alias("n_clusters"),
            F.min(named).alias("cluster_id"),
        )
    )
    shared = places.groupBy("cluster_id").agg(F.count("*").alias("n_places"))
    return places.join(shared, "cluster_id", "left").select(
        "station_key", "place", "n_rows", "n_in_clusters", "n_clusters", "n_places"
    )


@query("small_station_noise")
def q_small_stations(spark, d):
    """Stations cut down to half a day each, so that many are below the least size."""
    from gridwarden.operators.density import small_station_rows

    part = F.date_format("created_datetime", "yyyyMMdda")
    rows = clean(spark, d).withColumn("station_key", F.concat_ws("_", "station_key", part))
    return small_station_rows(rows, S).select("id", "station_key", "cluster_id")


@query("density_leaderboard")
def q_density_board(spark, d):
    """The board over true density clusters."""
    rows = store.join_assignments(clean(spark, d), temporal.hotspots(density_assignments(spark, d)))
    rows = written(rows, "clustered")
    bounds = temporal.read_time_bounds(rows)
    table = written(rollups.incident_facts(rows, bounds["mid_time"], S), "facts")
    return leaderboard.build_leaderboard(
        rollups.impact_from_facts(table, S),
        rollups.recency_from_facts(table, bounds["max_time"], S),
        S,
    ).drop("latest_incident")


def _finished_run(spark, d):
    from gridwarden.plans.training import load_run, run_training

    root = scratch_path(spark, "artifacts")
    row = run_training(
        raw(spark, d), root, S, assign=lambda c, s: grid_assignments(c, s).select(
            "station_key", "id", "cluster_id")
    )
    return row, load_run(spark, root), root


@query("write_run")
def q_write_run(spark, d):
    """A whole run with the grid stand-in; its board as read back from the promoted run."""
    return _summary(leaderboard.hotspot_summary(_finished_run(spark, d)[1].leaderboard))


@query("run_metrics")
def q_run_metrics(spark, d):
    _, _, root = _finished_run(spark, d)
    return registry.read_runs(spark, f"{root}/runs").select(
        F.col("ingestion_report.total_rows_seen").alias("total_rows_seen"),
        F.col("ingestion_report.valid_rows").alias("valid_rows"),
        r("ingestion_report.rejection_rate").alias("rejection_rate"),
        "total_hotspots",
        (F.col("forecast_n_train") + F.col("forecast_n_test")).alias("n_trend"),
        F.unix_micros("dataset_time_span.min").alias("min_us"),
        F.unix_micros("dataset_time_span.max").alias("max_us"),
        F.col("promotion_gate.promoted").alias("promoted"),
    )
