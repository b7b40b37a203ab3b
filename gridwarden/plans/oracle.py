"""The same queries in DuckDB SQL, over the same tables, for comparison."""

from __future__ import annotations

from gridwarden.config import SEVERITY_RULES, VEHICLE_WEIGHTS, Settings
from gridwarden.functions.text import NA_TOKENS
from gridwarden.operators.forecast import FEATURES, MAX_BINS
from gridwarden.operators.validate import REASONS, REQUIRED
from gridwarden.plans.literals import CUTS, LITERALS
from gridwarden.plans.tree_sql import first_tree, reached

S = Settings()


def quoted(word: str) -> str:
    return "'" + word.replace("'", "''") + "'"


FEED = """
u AS (
  SELECT *, user_id % 12 AS st, (event_id*7919 + 13) % 1000 AS h FROM events),
v AS (
  SELECT *, h % 5 AS c,
    12800000 + st*45000 + (h%5)*6000 + ((event_id*31)%97)*10
      + CASE WHEN h >= 900 THEN ((event_id*37)%1000)*30 ELSE 0 END AS lat_u,
    77400000 + st*30000 + (h%5)*5000 + ((event_id*43)%89)*10
      + CASE WHEN h >= 900 THEN ((event_id*41)%1000)*30 ELSE 0 END AS lon_u
  FROM u),
feed AS (
  SELECT
    CAST(CASE WHEN event_id%131=7 THEN event_id-1 ELSE event_id END AS VARCHAR) AS id,
    CASE WHEN event_id%101=7 THEN 'abc' WHEN event_id%103=7 THEN NULL
         WHEN event_id%107=7 THEN '0.0' WHEN event_id%109=7 THEN '13.9999'
         WHEN event_id%113=7 THEN 'inf'
         ELSE (lat_u // 1000000)::VARCHAR || '.' || lpad((lat_u % 1000000)::VARCHAR, 6, '0')
    END AS latitude,
    (lon_u // 1000000)::VARCHAR || '.' || lpad((lon_u % 1000000)::VARCHAR, 6, '0') AS longitude,
    CASE event_id%6 WHEN 0 THEN 'CAR' WHEN 1 THEN 'scooter ' WHEN 3 THEN 'BUS'
         WHEN 4 THEN 'LORRY/GOODS VEHICLE' WHEN 5 THEN 'TOTALLY_UNKNOWN_TYPE' END AS vehicle_type,
    CASE event_type WHEN 'click' THEN '["NO PARKING"]'
         WHEN 'view' THEN '["WRONG PARKING", "PARKING ON FOOTPATH"]'
         WHEN 'error' THEN '[''PARKING NEAR ROAD CROSSING'']'
         WHEN 'purchase' THEN 'NULL' WHEN 'signup' THEN 'WRONG PARKING' END AS violation_type,
    CASE event_id%17 WHEN 0 THEN NULL WHEN 1 THEN 'NULL' WHEN 2 THEN '  '
         ELSE 'Junction ' || c::VARCHAR END AS junction_name,
    CASE WHEN event_id%19=0 THEN 'NULL' ELSE 'Station ' || st::VARCHAR END AS police_station,
    CASE WHEN event_id%127=7 THEN 'not-a-date'
         ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS created_datetime,
    event_id AS ingest_order, props
  FROM v)
"""


def strip(c: str) -> str:
    return rf"regexp_replace({c}, '^\s+|\s+$', '', 'g')"


def key(c: str) -> str:
    k = rf"regexp_replace({c}, '[^\p{{L}}\p{{N}}]', '_', 'g')"
    return f"CASE WHEN {k} IS NULL OR {k} = '' THEN 'unknown' ELSE {k} END"


VEHICLE = f"coalesce(nullif(upper({strip('vehicle_type')}), 'NULL'), 'UNKNOWN')"
JUNCTION = f"coalesce(nullif(nullif({strip('junction_name')}, 'NULL'), ''), 'No Junction')"
STATION = f"coalesce(nullif({strip('police_station')}, 'NULL'), 'Unknown')"
ITEMS = f"""
CASE WHEN {strip("violation_type")} IS NULL OR upper({strip("violation_type")}) IN ('', 'NULL')
     THEN ['UNKNOWN']
     WHEN try_cast({strip("violation_type")} AS VARCHAR[]) IS NOT NULL
     THEN list_transform(try_cast({strip("violation_type")} AS VARCHAR[]), lambda x: upper(trim(x)))
     ELSE [upper({strip("violation_type")})] END
"""
WEIGHT = (
    "CASE vehicle_type "
    + " ".join(f"WHEN {quoted(k)} THEN {v}" for k, v in VEHICLE_WEIGHTS.items())
    + " ELSE 1 END"
)


def severity(rules: dict[str, float], column: str = "violation_type_clean") -> str:
    tests = ", ".join(
        f"CASE WHEN contains({column}, {quoted(k)}) THEN CAST({w} AS DOUBLE) END"
        for k, w in rules.items()
    )
    return f"greatest(CAST(1.0 AS DOUBLE), {tests})"


FLAGS = f"""
typed AS (
  SELECT *, try_cast(latitude AS DOUBLE) AS lat, try_cast(longitude AS DOUBLE) AS lon,
         try_cast(created_datetime AS TIMESTAMP) AS ts
  FROM feed),
parts AS (
  SELECT *, lat IS NULL OR lon IS NULL AS missing,
    coalesce(isinf(lat), false) OR coalesce(isinf(lon), false) AS infinite,
    coalesce(lat = 0 OR lon = 0, false) AS island,
    coalesce(lat BETWEEN {S.lat_min} AND {S.lat_max}
             AND lon BETWEEN {S.lon_min} AND {S.lon_max}, false) AS inside
  FROM typed),
flagged AS (
  SELECT *, missing AS missing_or_non_numeric_coordinates,
    infinite AND NOT missing AS non_finite_coordinates,
    island AND NOT missing AS null_island_coordinates,
    NOT inside AND NOT missing AND NOT island AS outside_service_geofence,
    NOT missing AND NOT infinite AND NOT island AND inside AS keep_geo
  FROM parts),
timed AS (
  SELECT *, keep_geo AND ts IS NULL AS unparseable_timestamp,
    keep_geo AND ts IS NOT NULL AS keep_row,
    row_number() OVER (PARTITION BY id ORDER BY ingest_order) AS nth
  FROM flagged),
marked AS (SELECT *, keep_row AND nth > 1 AS duplicate_id FROM timed)
"""
CLEAN = f"""
texts AS (
  SELECT id, lat AS latitude, lon AS longitude, {VEHICLE} AS vehicle_type,
    {JUNCTION} AS junction_name, {STATION} AS police_station,
    array_to_string({ITEMS}, ', ') AS violation_type_clean, ts AS created_datetime
  FROM marked WHERE keep_row AND nth = 1),
clean AS (
  SELECT *, CAST({WEIGHT} AS INTEGER) AS vehicle_weight, {key("police_station")} AS station_key
  FROM texts)
"""
CLUSTERED = f"""
celled AS (
  SELECT *, CAST(floor(latitude*100) AS BIGINT)::VARCHAR || '_'
            || CAST(floor(longitude*100) AS BIGINT)::VARCHAR AS cell FROM clean),
sized AS (SELECT *, count(*) OVER (PARTITION BY station_key, cell) AS cell_rows FROM celled),
clustered AS (
  SELECT * EXCLUDE (cell, cell_rows),
    CASE WHEN cell_rows >= {S.min_cluster_size} THEN station_key || '::' || cell
         ELSE 'NOISE' END AS cluster_id FROM sized),
hot AS (SELECT * FROM clustered WHERE cluster_id <> 'NOISE'),
clocked AS (
  SELECT *, hour(created_datetime)::INTEGER AS hour, dayname(created_datetime) AS day_of_week,
    (isodow(created_datetime) - 1)::INTEGER AS day_of_week_num,
    isodow(created_datetime) >= 6 AS is_weekend,
    month(created_datetime)::INTEGER AS month, created_datetime::DATE AS date FROM clustered)
"""
SCORED = f"""
hour_counts AS (
  SELECT station_key, cluster_id, hour, count(*) AS violations_in_hour FROM clocked
  WHERE cluster_id <> 'NOISE' GROUP BY ALL),
medians AS (
  SELECT station_key, cluster_id, median(violations_in_hour) AS cluster_median_hourly
  FROM hour_counts GROUP BY ALL),
density AS (
  SELECT station_key, cluster_id, count(*) AS cluster_density FROM hot GROUP BY ALL),
looked AS (
  SELECT k.*, violations_in_hour, cluster_median_hourly,
    CAST(coalesce(cluster_density, 1) AS DOUBLE) AS cluster_density,
    CASE WHEN violations_in_hour > cluster_median_hourly
         THEN CAST(1.5 AS DOUBLE) ELSE CAST(1.0 AS DOUBLE) END AS rush_hour_factor,
    {severity(SEVERITY_RULES)} AS severity
  FROM clocked k LEFT JOIN hour_counts USING (station_key, cluster_id, hour)
  LEFT JOIN medians USING (station_key, cluster_id)
  LEFT JOIN density USING (station_key, cluster_id)),
scored AS (
  SELECT *, cluster_density * severity * vehicle_weight * rush_hour_factor AS impact_score
  FROM looked)
"""


def _mode(column: str) -> str:
    return f"""
mode_{column} AS (
  SELECT cluster_id, {column} FROM (
    SELECT cluster_id, {column}, row_number() OVER (
      PARTITION BY cluster_id ORDER BY n DESC, {column}) AS pos
    FROM (SELECT cluster_id, {column}, count(*) AS n FROM hot GROUP BY ALL)) WHERE pos = 1)"""


BOARD = f"""
{_mode("junction_name")}, {_mode("police_station")},
impact AS (
  SELECT cluster_id, any_value(station_key) AS station_key,
    avg(latitude) AS center_latitude, avg(longitude) AS center_longitude,
    count(*) AS total_violations, sum(impact_score) AS total_impact_score,
    avg(impact_score) AS average_impact_per_vehicle,
    count_if(severity >= 2.0)::BIGINT AS high_severity_incidents
  FROM scored WHERE cluster_id <> 'NOISE' GROUP BY cluster_id),
summary AS (
  SELECT impact.*, junction_name, police_station FROM impact
  JOIN mode_junction_name USING (cluster_id) JOIN mode_police_station USING (cluster_id)),
bounds AS (
  SELECT epoch_us(min(created_datetime)) AS lo, epoch_us(max(created_datetime)) AS hi,
    epoch_us(min(created_datetime))
      + (epoch_us(max(created_datetime)) - epoch_us(min(created_datetime))) // 2 AS mid
  FROM clean),
per_cluster AS (
  SELECT cluster_id, epoch_us(max(created_datetime)) AS latest_us, any_value(hi) AS hi,
    count_if(epoch_us(created_datetime) <= mid)::BIGINT AS older,
    count_if(epoch_us(created_datetime) > mid)::BIGINT AS recent
  FROM hot, bounds GROUP BY cluster_id),
recency AS (
  SELECT cluster_id, latest_us,
    1.0::DOUBLE / (1.0::DOUBLE + ((hi - latest_us) / 3.6e9::DOUBLE) / 24.0::DOUBLE)
      AS recency_factor,
    least(3.0::DOUBLE, greatest(0.5::DOUBLE,
      CASE WHEN older > 0 THEN recent::DOUBLE / older::DOUBLE ELSE 1.0::DOUBLE END))
      AS growth_rate
  FROM per_cluster),
scores AS (
  SELECT *, total_impact_score * recency_factor * growth_rate AS priority_score,
    CASE WHEN growth_rate > 1.2 THEN 'URGENT_DISPATCH' WHEN recency_factor > 0.9
         THEN 'HIGH_PRIORITY' ELSE 'ROUTINE_PATROL' END AS status
  FROM summary JOIN recency USING (cluster_id)),
board AS (
  SELECT *, row_number() OVER (ORDER BY round(priority_score, 6) DESC, cluster_id)::INTEGER
    AS rank,
    CASE status WHEN 'URGENT_DISPATCH' THEN 'Target ' || junction_name
           || '. Violations accelerating (+' || printf('%.0f', (growth_rate - 1) * 100)
           || '% growth trend).'
         WHEN 'HIGH_PRIORITY' THEN 'Monitor ' || junction_name
           || ' closely — highly active within the past few hours.'
         ELSE 'Schedule a routine check at ' || junction_name
           || ' during predicted peak windows.' END AS recommendation
  FROM scores)
"""
RUNS = """
runs AS (
  SELECT o_orderkey::VARCHAR AS run_id, 'v' || (o_custkey % 50)::VARCHAR AS model_version,
    o_orderdate AS generated_at,
    CASE WHEN o_orderkey % 17 <> 0 THEN o_totalprice / 100000 END AS forecast_mae,
    o_orderkey % 1000 AS total_hotspots, o_orderstatus <> 'F' AS promoted
  FROM orders)
"""
REQUESTS = """
asked AS (
  SELECT id, CASE WHEN id::BIGINT % 41 = 0 THEN '  ' ELSE cluster_id END AS cluster_id,
    (id::BIGINT % 26)::INTEGER AS hour, (id::BIGINT % 8)::INTEGER AS day_of_week
  FROM clustered),
judged AS (
  SELECT *, CASE WHEN trim(cluster_id) = '' THEN 'blank_cluster_id'
    WHEN hour > 23 THEN 'hour_out_of_range'
    WHEN day_of_week > 6 THEN 'day_of_week_out_of_range' ELSE 'ok' END AS reject_reason
  FROM asked)
"""

STEPS = {
    "feed": FEED,
    "flags": FLAGS,
    "clean": CLEAN,
    "clusters": CLUSTERED,
    "scores": SCORED,
    "board": BOARD,
}


def upto(step: str, body: str, *more: str) -> str:
    """`body` behind all building blocks up to `step`."""
    blocks = []
    for name, sql in STEPS.items():
        blocks.append(sql.strip())
        if name == step:
            break
    return "WITH " + ",\n".join([*blocks, *[m.strip() for m in more]]) + "\n" + body


US = "epoch_us(created_datetime) AS created_us"
SUMMARY = """cluster_id, rank, junction_name, police_station,
  round(center_latitude + 1.3717e-7, 6) AS center_latitude, round(center_longitude + 1.3717e-7, 6) AS center_longitude,
  total_violations, round(priority_score, 4) AS priority_score, status, recommendation"""
IMPACT = """cluster_id, junction_name, police_station,
  round(center_latitude + 1.3717e-7, 6) AS center_latitude, round(center_longitude + 1.3717e-7, 6) AS center_longitude,
  total_violations, round(total_impact_score, 4) AS total_impact_score,
  round(average_impact_per_vehicle, 4) AS average_impact_per_vehicle, high_severity_incidents"""
REPORT_SUMS = ", ".join(f"count_if({x})::BIGINT AS {x}" for x in REASONS)
REPORT = f"""
counted AS (
  SELECT count(*) AS total_rows_seen,
    count_if(keep_row AND NOT duplicate_id)::BIGINT AS valid_rows, {REPORT_SUMS} FROM marked),
report AS (
  SELECT *, total_rows_seen - valid_rows AS rejected_rows,
    (total_rows_seen - valid_rows)::DOUBLE / total_rows_seen AS rejection_rate,
    (total_rows_seen - valid_rows)::DOUBLE / total_rows_seen <= 0.25 AS passed FROM counted)
"""


def ticket(*values: str) -> str:
    texts = ", ".join(f"coalesce(({v})::VARCHAR, chr(0))" for v in values)
    return f"('0x' || left(md5(concat_ws(chr(31), {texts})), 12))::BIGINT"


def sampled(points: int) -> str:
    return f"""SELECT station_key, id FROM (
      SELECT station_key, id, row_number() OVER (
        PARTITION BY station_key ORDER BY {ticket("42", "id")}, id) AS n FROM clean)
      WHERE n <= {points} // (SELECT count(DISTINCT station_key) FROM clean)"""


def capped(points: int) -> str:
    draw = ticket("42", "station_key", "id")
    return f"SELECT station_key, id FROM clean ORDER BY {draw}, id LIMIT {points}"


HELD_OUT = f"{ticket('42', 'date', 'cluster_id', 'hour')} % 1000 < 200"
TREND = """
trend AS (
  SELECT date, cluster_id, day_of_week_num, hour, count(*) AS hourly_violation_count
  FROM clocked WHERE cluster_id <> 'NOISE' GROUP BY ALL)
"""
LABELS = """
labels_of AS (
  SELECT cluster_id, row_number() OVER (ORDER BY cluster_id) - 1 AS cluster_id_encoded
  FROM (SELECT DISTINCT cluster_id FROM hot))
"""
CSV_CELLS = ", ".join(
    f"CASE WHEN {c} NOT IN ({', '.join(quoted(t) for t in NA_TOKENS)}) THEN {c} END AS {c}"
    for c in REQUIRED
)
TOKENS = [*NA_TOKENS, "null and void", "none"]
TOKEN_LIST = "[" + ", ".join(quoted(t) for t in TOKENS) + "]"
STATS = """
stats AS (
  SELECT station_key, count(*) AS n_points,
    count(DISTINCT CASE WHEN cluster_id <> 'NOISE' THEN cluster_id END) AS n_clusters,
    count_if(cluster_id = 'NOISE')::BIGINT AS n_noise FROM clustered GROUP BY station_key)
"""
MID_LAT, MID_LON = (S.lat_min + S.lat_max) / 2, (S.lon_min + S.lon_max) / 2

ORACLE: dict[str, str] = {
    "scan_csv_feed": upto("feed", f"SELECT {CSV_CELLS} FROM feed"),
    "bad_lines": "SELECT count(*) AS lines, count_if(event_id % 50 = 3)::BIGINT AS bad_lines, "
    "count_if(event_id % 50 = 4)::BIGINT AS padded_lines FROM events",
    "null_tokens": f"""SELECT event_id, CASE WHEN list_position(
      {TOKEN_LIST}, {TOKEN_LIST}[(event_id % {len(TOKENS)} + 1)::INTEGER]) > {len(NA_TOKENS)}
      THEN {TOKEN_LIST}[(event_id % {len(TOKENS)} + 1)::INTEGER] END AS cell FROM events""",
    "ingest_incremental": upto("flags", "SELECT * FROM report", REPORT),
    "read_feed": upto(
        "feed", "SELECT police_station, count(*) AS n FROM feed GROUP BY police_station"
    ),
    "write_partitioned": upto(
        "clean",
        "SELECT id, latitude, longitude, police_station, station_key, vehicle_weight, "
        f"violation_type_clean, {US} FROM clean",
    ),
    "station_key": upto(
        "feed",
        f"SELECT police_station, {key('police_station')} AS station_key FROM ("
        "SELECT police_station FROM feed UNION SELECT url FROM pages)",
    ),
    "list_stations": upto("clean", "SELECT DISTINCT station_key FROM clean ORDER BY 1"),
    "read_station": upto(
        "clean",
        "SELECT id, latitude, longitude, junction_name FROM clean "
        "WHERE station_key = 'Station_3'",
    ),
    "read_columns": upto("clean", f"SELECT id, {US} FROM clean"),
    "write_table": upto(
        "board", "SELECT rank, cluster_id, round(priority_score, 4) AS priority_score FROM board"
    ),
    "write_assignments": upto("clusters", "SELECT station_key, id, cluster_id FROM clustered"),
    "join_assignments": upto("clusters", "SELECT id, station_key, cluster_id FROM clustered"),
    "join_colocated": upto("clusters", "SELECT id, station_key, cluster_id FROM clustered"),
    "load_rules": upto(
        "clean",
        f"SELECT {severity({'FOOTPATH': 4.0, 'CROSSING': 9.5})} AS severity, count(*) AS n "
        "FROM clean GROUP BY 1",
    ),
    "require_columns": upto(
        "feed",
        " UNION ALL ".join(
            f"SELECT '{c}' AS column_name, count({c}) AS n_present FROM feed" for c in REQUIRED
        ),
    ),
    "coerce_coordinates": upto(
        "flags",
        "SELECT ingest_order AS row_index, CASE WHEN NOT isinf(lat) THEN lat END AS lat, "
        "isinf(lat) AS lat_infinite, lon FROM typed",
    ),
    "coerce_timestamp": upto(
        "flags", "SELECT ingest_order AS row_index, epoch_us(ts) AS created_us FROM typed"
    ),
    **{
        reason: upto(
            "flags",
            "SELECT ingest_order AS row_index, id, latitude, longitude FROM marked "
            f"WHERE {reason}",
        )
        for reason in REASONS[:-1]
    },
    "keep_geo": upto("flags", "SELECT ingest_order AS row_index, keep_geo FROM flagged"),
    "duplicate_id": upto(
        "flags", "SELECT ingest_order AS row_index, id FROM marked WHERE duplicate_id"
    ),
    "dedupe_keep_first": upto(
        "flags", "SELECT ingest_order AS row_index, id FROM marked WHERE nth = 1"
    ),
    "validate_filter": upto(
        "clean",
        "SELECT id, latitude, longitude, vehicle_type, junction_name, police_station, "
        f"violation_type_clean, vehicle_weight, {US} FROM clean",
    ),
    **{
        name: upto(
            "feed",
            f"SELECT {column} AS raw_text, {sql} AS clean_text, count(*) AS n FROM feed "
            "GROUP BY 1, 2",
        )
        for name, column, sql in [
            ("normalize_vehicle_type", "vehicle_type", VEHICLE),
            ("normalize_junction", "junction_name", JUNCTION),
            ("normalize_station", "police_station", STATION),
            ("parse_violation_list", "violation_type", f"array_to_string({ITEMS}, ', ')"),
        ]
    },
    "parse_violation_array": upto(
        "feed",
        f"SELECT ingest_order AS event_id, array_to_string({ITEMS}, '|') AS items, "
        f"len({ITEMS})::INTEGER AS n_items, array_to_string(list_transform("
        "string_split(props, ':'), lambda x: upper(trim(x))), '|') AS list_items FROM feed",
    ),
    "parse_literals": f"""
      WITH p AS (
        SELECT p_partkey, string_split(p_name, ' ')[1] AS a, p_brand AS b, upper(string_split(p_name, ' ')[1]) AS big_a,
          upper(p_brand) AS big_b, (p_partkey % {len(LITERALS)})::INTEGER AS form FROM part)
      SELECT p_partkey, replace(replace(given[form + 1], '{{a}}', a), '{{b}}', b) AS given,
        replace(replace(shown[form + 1], '{{A}}', big_a), '{{B}}', big_b) AS items,
        len(string_split(shown[form + 1], '|'))::INTEGER AS n_items
      FROM p, (SELECT [{", ".join(quoted(x) for x, _ in LITERALS)}] AS given, [{", ".join(quoted(y) for _, y in LITERALS)}] AS shown)""",
    "vehicle_weight": upto(
        "clean", "SELECT vehicle_type, vehicle_weight, count(*) AS n FROM clean GROUP BY ALL"
    ),
    "vehicle_weight_join": """
      WITH w AS (SELECT p_brand, (max(p_size) % 5)::INTEGER AS weight FROM part GROUP BY 1)
      SELECT p_partkey, CASE WHEN weight > 0 THEN weight ELSE 1 END AS vehicle_weight
      FROM part JOIN w USING (p_brand)""",
    "strict_record": upto(
        "flags",
        f"""SELECT id, lat AS latitude, lon AS longitude,
        CASE WHEN coalesce(upper({strip("vehicle_type")}), '') IN ('', 'NULL') THEN 'UNKNOWN'
             ELSE upper({strip("vehicle_type")}) END AS vehicle_type,
        array_to_string({ITEMS}, '|') AS violations,
        CASE WHEN coalesce(upper({strip("junction_name")}), '') IN ('', 'NULL')
             THEN 'No Junction' ELSE {strip("junction_name")} END AS junction_name,
        CASE WHEN coalesce({strip("police_station")}, '') = '' THEN 'Unknown'
             ELSE {strip("police_station")} END AS police_station,
        epoch_us(ts) AS created_us FROM marked WHERE keep_row""",
    ),
    "quarantine": upto(
        "flags",
        " UNION ALL ".join(
            f"SELECT ingest_order AS row_index, '{reason}' AS reason, "
            "CAST(to_json({" + ", ".join(f"'{c}': {c}" for c in REQUIRED) + "}) AS VARCHAR) "
            f"AS raw_payload FROM marked WHERE {reason}"
            for reason in REASONS
        ),
    ),
    "ingestion_report": upto("flags", "SELECT * FROM report", REPORT),
    "rejection_reasons": upto(
        "flags",
        "SELECT * FROM ("
        + " UNION ALL ".join(f"SELECT '{x}' AS reason, {x} AS n FROM report" for x in REASONS)
        + ") WHERE n > 0",
        REPORT,
    ),
    "merge_reports": upto("flags", "SELECT * FROM report", REPORT),
    "quality_gate": upto(
        "flags",
        "SELECT ingest_order // 1310 AS batch, 1 - count_if(keep_row AND NOT duplicate_id)"
        "::DOUBLE / count(*) <= 0.25 AS passed FROM marked GROUP BY 1",
    ),
    "noise_filter": upto("clusters", "SELECT id, cluster_id FROM hot"),
    "fill_noise": upto(
        "clusters",
        "SELECT cluster_id = 'NOISE' AS is_noise, count(*) AS n FROM clustered GROUP BY 1",
    ),
    "namespace_cluster": upto(
        "clean",
        "SELECT id, CASE WHEN id::BIGINT % 3 = 0 THEN 'NOISE' "
        "ELSE station_key || '::' || (id::BIGINT % 3 - 1)::VARCHAR END AS cluster_id FROM clean",
    ),
    "temporal_features": upto(
        "clusters",
        "SELECT id, hour, day_of_week, day_of_week_num, is_weekend, month, "
        "date::VARCHAR AS date FROM clocked",
    ),
    "severity": upto(
        "clean",
        f"SELECT violation_type_clean, {severity(SEVERITY_RULES)} AS severity, count(*) AS n "
        "FROM clean GROUP BY 1, 2",
    ),
    "rules_join": """
      WITH rules AS (
        SELECT p_type AS keyword, max(p_size)::DOUBLE AS weight FROM part GROUP BY 1),
      texts AS (
        SELECT p_partkey, concat_ws(' ', p_name, p_type, p_brand) AS body FROM part),
      hits AS (
        SELECT body, max(weight) AS best
        FROM (SELECT DISTINCT body FROM texts) JOIN rules ON contains(body, keyword) GROUP BY 1)
      SELECT p_partkey, greatest(1.0::DOUBLE, coalesce(best, 1.0)) AS severity
      FROM texts LEFT JOIN hits USING (body)""",
    "join_density": upto("scores", "SELECT id, cluster_density FROM looked"),
    "cluster_density": upto("scores", "SELECT * FROM density"),
    "time_bounds": upto(
        "clean",
        "SELECT min(epoch_us(created_datetime)) AS min_us, "
        "max(epoch_us(created_datetime)) AS max_us, min(epoch_us(created_datetime)) + "
        "(max(epoch_us(created_datetime)) - min(epoch_us(created_datetime))) // 2 AS mid_us "
        "FROM clean",
    ),
    "hour_counts": upto("scores", "SELECT * FROM hour_counts"),
    "cluster_median_hourly": upto("scores", "SELECT * FROM medians"),
    "join_hour_counts": upto("scores", "SELECT id, violations_in_hour FROM looked"),
    "join_cluster_median": upto("scores", "SELECT id, cluster_median_hourly FROM looked"),
    "rush_hour_factor": upto("scores", "SELECT id, rush_hour_factor FROM looked"),
    "impact_score": upto("scores", "SELECT id, cluster_id, impact_score FROM scored"),
    "hotspot_impact": upto("board", f"SELECT {IMPACT} FROM summary"),
    "hotspot_impact_from_rows": upto("board", f"SELECT {IMPACT} FROM summary"),
    "hourly_trend": upto(
        "clusters",
        "SELECT date::VARCHAR AS date, cluster_id, day_of_week_num, hour, "
        "hourly_violation_count FROM trend",
        TREND,
    ),
    "recency_growth": upto(
        "board",
        "SELECT cluster_id, latest_us, round(recency_factor, 6) AS recency_factor, "
        "round(growth_rate, 6) AS growth_rate FROM recency",
    ),
    "recency_factor": upto(
        "board", "SELECT cluster_id, round(recency_factor, 6) AS recency_factor FROM recency"
    ),
    "growth_rate": upto(
        "board", "SELECT cluster_id, round(growth_rate, 6) AS growth_rate FROM recency"
    ),
    "station_cluster_stats": upto("clusters", "SELECT * FROM stats", STATS),
    "cluster_totals": upto(
        "clusters",
        "SELECT count(*) AS n_stations, sum(n_points)::BIGINT AS n_points, "
        "sum(n_clusters)::BIGINT AS n_clusters, sum(n_noise)::BIGINT AS n_noise FROM stats",
        STATS,
    ),
    "total_hotspots": upto(
        "clusters", "SELECT count(DISTINCT cluster_id) AS total_hotspots FROM hot"
    ),
    "non_noise_labels": upto(
        "clusters",
        "SELECT cluster_id FROM clustered EXCEPT SELECT 'NOISE'",
    ),
    "union_rollups": upto(
        "clusters", "SELECT cluster_id, hour, hourly_violation_count FROM trend", TREND
    ),
    "typed_empty": upto("board", f"SELECT {IMPACT} FROM summary WHERE false"),
    "haversine_radians": upto(
        "clean",
        f"""SELECT id, round(2 * asin(sqrt(
          pow(sin((radians(latitude) - radians({MID_LAT})) / 2), 2)
          + cos(radians(latitude)) * cos(radians({MID_LAT}))
            * pow(sin((radians(longitude) - radians({MID_LON})) / 2), 2))), 9) AS angle
        FROM clean""",
    ),
    "leaderboard": upto(
        "board",
        f"SELECT {SUMMARY}, round(total_impact_score, 4) AS total_impact_score, "
        "high_severity_incidents, round(recency_factor, 6) AS recency_factor, "
        "round(growth_rate, 6) AS growth_rate FROM board",
    ),
    "join_leaderboard": upto(
        "board",
        "SELECT cluster_id, total_violations, round(growth_rate, 6) AS growth_rate FROM scores",
    ),
    "priority_score": upto(
        "board", "SELECT cluster_id, round(priority_score, 4) AS priority_score FROM scores"
    ),
    "dispatch_status": upto("board", "SELECT cluster_id, status FROM scores"),
    "recommendation": upto("board", "SELECT cluster_id, recommendation FROM board"),
    "rank_leaderboard": upto("board", "SELECT rank, cluster_id FROM board"),
    "hotspot_summary": upto("board", f"SELECT {SUMMARY} FROM board"),
    "top_hotspots": upto("board", f"SELECT {SUMMARY} FROM board ORDER BY rank LIMIT 25"),
    "dispatch_directives": upto(
        "board",
        "SELECT rank, 'Rank ' || rank::VARCHAR || ': ' || replace(status, '_', ' ') || ' — ' "
        "|| recommendation AS directive FROM board ORDER BY rank LIMIT 8",
    ),
    "lookup_hotspot": upto("board", f"SELECT {SUMMARY} FROM board WHERE rank = 1"),
    "primary_offense": upto(
        "clean",
        "SELECT station_key, count(*) AS n, 'Parking Near Road Crossing' AS primary_offense "
        "FROM clean WHERE contains(violation_type_clean, 'PARKING NEAR ROAD CROSSING') "
        "GROUP BY 1",
    ),
    "kpis": upto(
        "board",
        """SELECT (SELECT count(*) FROM board) AS total_active_hotspots,
          round(priority_score, 4) AS top_priority_score,
          junction_name AS top_priority_junction,
          'PARKING NEAR ROAD CROSSING' AS primary_offense,
          round(r.forecast_mae, 2) AS model_mae, r.model_version,
          epoch_us(r.generated_at) AS generated_us
        FROM board, (SELECT * FROM runs WHERE promoted
                     ORDER BY generated_at DESC, run_id DESC LIMIT 1) r WHERE rank = 1""",
        RUNS,
    ),
    "marker_radius": upto(
        "board",
        "SELECT cluster_id, greatest(5.0::DOUBLE, least(40.0::DOUBLE, "
        "total_violations::DOUBLE / 5)) AS radius FROM scores",
    ),
    "marker_labels": upto(
        "board",
        "SELECT cluster_id, cluster_id || ' — click for details' AS tooltip, 'Violations: ' || "
        "total_violations::VARCHAR || ' | Junction: ' || junction_name || ' | Station: ' || "
        "police_station AS popup FROM scores",
    ),
    "heatmap_sample": upto("clean", sampled(20_000)),
    "heatmap_sample_cut": upto("clean", sampled(2_000)),
    "cap_sample": upto("clean", capped(20_000)),
    "cap_sample_cut": upto("clean", capped(2_000)),
    "map_center": upto(
        "clean",
        "SELECT round(avg(latitude) + 1.3717e-7, 6) AS center_latitude, "
        "round(avg(longitude) + 1.3717e-7, 6) AS center_longitude FROM clean",
    ),
    "label_encode": upto("clusters", "SELECT * FROM labels_of", LABELS),
    "join_encoding": upto(
        "clusters",
        "SELECT date::VARCHAR AS date, cluster_id, hour, cluster_id_encoded, "
        "hourly_violation_count FROM trend JOIN labels_of USING (cluster_id)",
        TREND,
        LABELS,
    ),
    "validate_requests": upto("clusters", "SELECT id, reject_reason FROM judged", REQUESTS),
    "known_clusters": upto(
        "clusters",
        "SELECT id, cluster_id FROM judged WHERE reject_reason = 'ok' "
        "AND cluster_id IN (SELECT cluster_id FROM hot)",
        REQUESTS,
    ),
    "unknown_clusters": upto(
        "clusters",
        "SELECT id, cluster_id FROM judged WHERE reject_reason = 'ok' "
        "AND cluster_id NOT IN (SELECT cluster_id FROM hot)",
        REQUESTS,
    ),
    "train_test_split": upto(
        "clusters", f"SELECT {HELD_OUT} AS held_out, count(*) AS n FROM trend GROUP BY 1", TREND
    ),
    "train_forecast": upto(
        "clusters",
        f"SELECT count_if(NOT {HELD_OUT})::BIGINT AS n_train, count_if({HELD_OUT})::BIGINT AS n_test, "
        "true AS beats_mean FROM trend",
        TREND,
    ),
    "forecast_first_tree": upto(
        "clusters",
        "SELECT node, feature, upper::INTEGER AS upper, n_rows, round(gain, 6) AS gain, round(value, 9) AS value FROM nodes",
        TREND, LABELS, first_tree(HELD_OUT, S),
    ),
    "first_tree_importance": upto(
        "clusters",
        f"""SELECT feature, count(node)::DOUBLE AS importance
        FROM (SELECT unnest([{", ".join(map(quoted, FEATURES))}]) AS feature) LEFT JOIN nodes USING (feature) GROUP BY 1""",
        TREND, LABELS, first_tree(HELD_OUT, S),
    ),
    "first_tree_predictions": upto(
        "clusters",
        """SELECT id, cluster_id, hour, day_of_week,
          round(greatest(0, mean + value), 2) AS predicted_violations
        FROM reached JOIN nodes USING (node), base""",
        TREND, LABELS, REQUESTS, first_tree(HELD_OUT, S),
        f"""placed AS (
          SELECT id, cluster_id, hour, day_of_week, cluster_id_encoded * least(k, {MAX_BINS}) // k AS b,
            day_of_week AS d, hour AS h
          FROM judged JOIN labels_of USING (cluster_id), size WHERE reject_reason = 'ok')""",
        reached(S),
    ),
    "predict_batch": upto(
        "clusters",
        """SELECT id, cluster_id, hour, day_of_week, status, status = 'ok' AS has_prediction,
          CASE WHEN status = 'ok' THEN 'v1' END AS model_version
        FROM (SELECT *, CASE WHEN reject_reason = 'ok' AND cluster_id NOT IN
            (SELECT cluster_id FROM hot) THEN 'unknown_cluster' ELSE reject_reason END AS status
          FROM judged)""",
        REQUESTS,
    ),
    "input_fingerprint": upto(
        "feed",
        f"""SELECT count(*) AS n_rows, bit_xor(h) AS xor_hash, sum(h % 1000003)::BIGINT AS sum_hash
        FROM (SELECT {ticket(*REQUIRED, "ingest_order")} AS h FROM feed)""",
    ),
    "promotion_gate": f"""
      WITH {RUNS},
      served AS (
        SELECT model_version, forecast_mae AS prev FROM (
          SELECT *, row_number() OVER (PARTITION BY model_version
            ORDER BY generated_at DESC, run_id DESC) AS pos FROM runs WHERE promoted)
        WHERE pos = 1),
      asked AS (
        SELECT l_orderkey::VARCHAR || '-' || l_linenumber::VARCHAR AS candidate,
          'v' || (l_partkey % 60)::VARCHAR AS model_version, l_extendedprice / 25000 AS new,
          l_returnflag = 'A' AND l_linenumber = 1 AS force FROM lineitem),
      paired AS (
        SELECT asked.*, prev, served.model_version IS NOT NULL AS has_previous,
          prev * (1.0 + 10.0/100.0) AS ceiling, (prev - new) / prev * 100.0 AS delta
        FROM asked LEFT JOIN served USING (model_version))
      SELECT candidate, force OR NOT has_previous OR prev IS NULL OR new <= ceiling AS promoted,
        CASE WHEN force THEN 'force-promote flag set — gate bypassed'
          WHEN NOT has_previous THEN 'no baseline found — first run, promoting unconditionally'
          WHEN prev IS NULL THEN 'previous run has no forecast_mae — promoting unconditionally'
          WHEN new <= ceiling THEN printf('passed (prev=%.4f → new=%.4f, ', prev, new)
            || CASE WHEN delta > 0 THEN printf('+%.1f%% better)', delta)
                    ELSE printf('%.1f%% worse (within tolerance))', abs(delta)) END
          ELSE printf('REJECTED — MAE regressed: %.4f > %.4f (prev=%.4f, tolerance=10.0%%). ',
                      new, ceiling, prev) || 'Re-run with --force-promote to override.'
        END AS reason FROM paired""",
    "promotion_replay": f"""
      WITH RECURSIVE {RUNS.strip()},
      o AS (
        SELECT *, run_id::BIGINT % 97 = 5 AS force,
          row_number() OVER (PARTITION BY model_version ORDER BY generated_at, run_id) AS pos FROM runs),
      fold AS (
        SELECT model_version, pos, run_id, true AS promoted, NULL::VARCHAR AS baseline_run_id,
          NULL::DOUBLE AS baseline_mae, run_id AS held_id, forecast_mae::DOUBLE AS held FROM o WHERE pos = 1
        UNION ALL
        SELECT model_version, pos, run_id, ok, held_id, held,
          CASE WHEN ok THEN run_id ELSE held_id END, CASE WHEN ok THEN forecast_mae ELSE held END
        FROM (
          SELECT o.*, held_id, held, coalesce(force OR held IS NULL OR forecast_mae <= held * (1.0 + 10.0/100.0), false) AS ok
          FROM fold JOIN o ON o.model_version = fold.model_version AND o.pos = fold.pos + 1))
      SELECT model_version, run_id, promoted, baseline_run_id, baseline_mae FROM fold""",
    "latest_run": f"""WITH {RUNS} SELECT run_id, model_version,
      epoch_us(generated_at) AS generated_us FROM runs WHERE promoted
      ORDER BY generated_at DESC, run_id DESC LIMIT 1""",
    "run_health": f"""WITH {RUNS} SELECT 'ok' AS status, model_version,
      true AS artifacts_loaded, epoch_us(generated_at) AS generated_us,
      greatest(0.0::DOUBLE, (epoch_us(TIMESTAMP '2024-06-01 00:00:00')
        - epoch_us(generated_at)) / 1e6::DOUBLE) AS artifact_age_seconds,
      round(forecast_mae, 6) AS model_mae, total_hotspots AS active_hotspots
      FROM runs WHERE promoted ORDER BY generated_at DESC, run_id DESC LIMIT 1""",
    "core_distances": upto(
        "clean",
        """SELECT station_key, min(id) AS first_id,
          round(min(core) * 6371000 + 1.37e-3, 1) AS core_metres
        FROM (
          SELECT a.station_key, a.id, a.la, a.lo, a.k,
            2 * asin(sqrt(sin((a.la - b.la) / 2) ** 2
              + cos(a.la) * cos(b.la) * sin((a.lo - b.lo) / 2) ** 2)) AS core,
            row_number() OVER (PARTITION BY a.station_key, a.id ORDER BY core) AS nth
          FROM places a JOIN places b USING (station_key))
        WHERE nth = k + 1 GROUP BY station_key, la, lo""",
        """places AS (
          SELECT station_key, id, radians(round(latitude, 9)) AS la,
            radians(round(longitude, 9)) AS lo, greatest(1, least(10, size - 1)) AS k
          FROM (SELECT *, count(*) OVER (PARTITION BY station_key) AS size FROM clean)
          WHERE size >= 10)""",
    ),
    "linkage_cut": upto(
        "clean",
        """SELECT station_key, first_id, metres, label FROM labels""",
        """places AS (
          SELECT station_key, id, radians(round(latitude, 9)) AS la,
            radians(round(longitude, 9)) AS lo, greatest(1, least(10, size - 1)) AS k
          FROM (SELECT *, count(*) OVER (PARTITION BY station_key) AS size FROM clean)
          WHERE size >= 10)""",
        """ranked AS (
          SELECT station_key, id, la, lo, k, angle, row_number() OVER (PARTITION BY station_key, id ORDER BY angle) AS nth
          FROM (
            SELECT a.station_key, a.id, a.la, a.lo, a.k,
              2 * asin(sqrt(sin((a.la - b.la) / 2) ** 2
                + cos(a.la) * cos(b.la) * sin((a.lo - b.lo) / 2) ** 2)) AS angle
            FROM places a JOIN places b USING (station_key)))""",
        """spots AS MATERIALIZED (
          SELECT station_key, la, lo, min(id) AS first_id, min(angle) AS core FROM ranked
          WHERE nth = k + 1 GROUP BY ALL)""",
        f"""steps AS MATERIALIZED (
          SELECT metres, a.station_key, a.first_id AS u, b.first_id AS v
          FROM spots a JOIN spots b USING (station_key), (SELECT unnest({CUTS}::DOUBLE[]) AS metres)
          WHERE a.first_id <> b.first_id AND greatest(a.core, b.core, 2 * asin(sqrt(sin((a.la - b.la) / 2) ** 2
            + cos(a.la) * cos(b.la) * sin((a.lo - b.lo) / 2) ** 2))) <= metres / 6371000.0)""",
        f"""labels(metres, station_key, first_id, label) USING KEY (metres, station_key, first_id) AS (
          SELECT metres, station_key, first_id, first_id
          FROM spots, (SELECT unnest({CUTS}::DOUBLE[]) AS metres)
          UNION
          SELECT s.metres, s.station_key, s.v, min(l.label)
          FROM labels l JOIN steps s ON s.metres = l.metres AND s.station_key = l.station_key AND s.u = l.first_id
            JOIN recurring.labels AS prev ON prev.metres = s.metres AND prev.station_key = s.station_key AND prev.first_id = s.v
          WHERE l.label < prev.label GROUP BY ALL)""",
    ).replace("WITH ", "WITH RECURSIVE ", 1),
    "cluster_recovery": upto(
        "clean",
        """SELECT station_key, place, count(*) AS n_rows, count(*) AS n_in_clusters,
          1::BIGINT AS n_clusters, 1::BIGINT AS n_places
        FROM (SELECT *, (id::BIGINT * 7919 + 13) % 1000 AS h, h % 5 AS place FROM clean)
        WHERE h < 900 AND station_key <> 'Unknown' GROUP BY ALL""",
    ),
    "small_station_noise": upto(
        "clean",
        """SELECT id, part AS station_key, 'NOISE' AS cluster_id FROM (
          SELECT *, count(*) OVER (PARTITION BY part) AS size FROM (
            SELECT id, station_key || '_' || strftime(created_datetime, '%Y%m%d%p') AS part
            FROM clean)) WHERE size < 10""",
    ),
    "write_run": upto("board", f"SELECT {SUMMARY} FROM board"),
    "run_metrics": upto(
        "board",
        """SELECT (SELECT count(*) FROM feed) AS total_rows_seen, count(*) AS valid_rows,
          round(1 - count(*)::DOUBLE / (SELECT count(*) FROM feed), 6) AS rejection_rate,
          (SELECT count(*) FROM board) AS total_hotspots,
          (SELECT count(*) FROM trend) AS n_trend,
          min(epoch_us(created_datetime)) AS min_us, max(epoch_us(created_datetime)) AS max_us,
          true AS promoted FROM clean""",
        TREND,
    ),
}
