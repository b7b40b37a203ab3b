from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from gridwarden.config import Settings
from gridwarden.operators import heatmap, impact, leaderboard, rollups, temporal
from gridwarden.plans.catalog import clustered
from gridwarden.session import written

S = Settings()
MAX, MID = datetime(2024, 4, 8, 12), datetime(2024, 2, 1)


@pytest.mark.parametrize(
    ("body", "want"),
    [("NO PARKING", 1.5), ("WRONG PARKING, PARKING ON FOOTPATH", 2.5), ("OTHER", 1.0), (None, 1.0),
     ("no parking", 1.0), ("PARKING NEAR ROAD CROSSING, NO PARKING", 3.0)],
)
def test_severity(spark, body, want):
    df = spark.createDataFrame([(body,)], "violation_type_clean string")
    assert impact.add_severity(df, S).first()["severity"] == want
    rules = spark.createDataFrame(list(S.severity_rules.items()), "keyword string, weight double")
    assert impact.severity_by_rule_table(df, rules, S).first()["severity"] == want


def scored(spark, clusters):
    rows = [(str(i), "S", c, 12.9, 77.6, "MG Road", "Upparpet", sev, w, rush)
            for i, (c, sev, w, rush) in enumerate(clusters)]
    df = spark.createDataFrame(
        rows,
        "id string, station_key string, cluster_id string, latitude double, longitude double, "
        "junction_name string, police_station string, severity double, vehicle_weight int, "
        "rush_hour_factor double",
    )
    return impact.add_density(df).withColumn("impact_score", impact.impact_score())


def test_density_impact_and_summary(spark):
    a = [("A::1", 1.5, 2, 1.5), ("A::1", 2.5, 1, 1.0), ("A::1", 1.0, 1, 1.0), ("A::1", 1.5, 1, 1.0)]
    df = scored(spark, [*a, ("B::2", 1.0, 1, 1.0), ("B::2", 3.0, 4, 1.0), ("NOISE", 1.0, 1, 1.0)])
    got = {r.id: r for r in df.collect()}
    assert (got["0"].cluster_density, got["0"].impact_score) == (4, 18)
    assert (got["6"].cluster_density, got["6"].impact_score) == (1, 1)
    summary = {r.cluster_id: r for r in impact.hotspot_impact(df, S).collect()}
    assert set(summary) == {"A::1", "B::2"}
    assert (summary["A::1"].total_violations, summary["A::1"].high_severity_incidents) == (4, 1)
    assert summary["A::1"].junction_name == "MG Road"


def test_only_noise_gives_typed_empty(spark):
    empty = impact.hotspot_impact(scored(spark, [("NOISE", 1.0, 1, 1.0)]), S)
    assert empty.count() == 0 and "total_impact_score" in empty.columns


def recency(spark, times):
    rows = [("S", "A::1", t) for t in times]
    df = spark.createDataFrame(
        rows, "station_key string, cluster_id string, created_datetime timestamp"
    )
    return rollups.recency_growth(df, MAX, MID, S).first()


def test_recency_and_growth(spark):
    assert recency(spark, [MAX]).recency_factor == 1.0
    assert recency(spark, [datetime(2024, 4, 6, 12)]).recency_factor == pytest.approx(1 / 3)
    assert recency(spark, [MAX]).growth_rate == 1.0  # nothing older
    assert recency(spark, [datetime(2024, 1, 1), *[MAX] * 20]).growth_rate == 3.0
    assert recency(spark, [MID, MID]).growth_rate == 0.5  # the midpoint counts as older


@pytest.mark.parametrize(
    ("growth", "recent", "status"),
    [(1.5, 0.5, "URGENT_DISPATCH"), (1.0, 0.95, "HIGH_PRIORITY"), (1.0, 0.5, "ROUTINE_PATROL"),
     (1.2, 0.9, "ROUTINE_PATROL")],
)
def test_status_and_text(spark, growth, recent, status):
    df = spark.createDataFrame(
        [("J", growth, recent)], "junction_name string, growth_rate double, recency_factor double"
    )
    row = df.select(
        leaderboard.dispatch_status(S).alias("s"), leaderboard.recommendation(S).alias("t")
    ).first()
    assert row.s == status and "J" in row.t
    if growth == 1.5:
        assert row.t == "Target J. Violations accelerating (+50% growth trend)."


def test_percent_rounds_half_to_even(spark):
    df = spark.createDataFrame(
        [("J", 1.225, 0.0)], "junction_name string, growth_rate double, recency_factor double"
    )
    text = df.select(leaderboard.recommendation(S)).first()[0]
    assert f"+{(1.225 - 1) * 100:.0f}%" in text


def test_rank_ties_and_limits(spark):
    rows = [(f"C::{i:03d}", float(i // 2), "J", "P") for i in range(40)]
    df = spark.createDataFrame(
        rows, "cluster_id string, priority_score double, junction_name string, police_station string"
    )
    ranked = leaderboard.rank_board(df).orderBy("rank").collect()
    assert [r["rank"] for r in ranked] == list(range(1, 41))
    want = sorted(rows, key=lambda r: (-r[1], r[0]))
    assert [r.cluster_id for r in ranked] == [r[0] for r in want]
    with pytest.raises(ValueError):
        leaderboard.top_hotspots(df, 0)


def test_rollups_from_facts_equal_those_from_rows(spark, sf_dir):
    rows = written(clustered(spark, sf_dir), "rows")
    bounds = temporal.read_time_bounds(rows)
    facts = written(rollups.incident_facts(rows, bounds["mid_time"], S), "facts")
    timed = temporal.add_rush_and_density(temporal.add_clock(rows), S)
    full = impact.add_severity(timed, S).withColumn("impact_score", impact.impact_score())

    def same(left, right):
        """Equal but for the order of floating-point sums."""
        a, b = ({r.cluster_id: r for r in df.collect()} for df in (left, right.select(left.columns)))
        assert set(a) == set(b)
        for key, row in a.items():
            for x, y in zip(row, b[key], strict=True):
                assert x == (pytest.approx(y, rel=1e-12) if isinstance(y, float) else y)

    same(impact.hotspot_impact(full, S), rollups.impact_from_facts(facts, S))
    slow = rollups.recency_growth(rows, bounds["max_time"], bounds["mid_time"], S)
    same(slow, rollups.recency_from_facts(facts, bounds["max_time"], S))
    assert full.count() == rows.count()


def test_no_row_is_rush_hour_in_a_one_hour_cluster(spark):
    rows = [("S", "A::1", datetime(2024, 1, d, 9)) for d in range(1, 6)]
    df = spark.createDataFrame(
        rows, "station_key string, cluster_id string, created_datetime timestamp"
    )
    got = temporal.add_rush_hour(temporal.add_clock(df), S).select("rush_hour_factor").distinct()
    assert [r[0] for r in got.collect()] == [1.0]


def test_sample_is_exact_and_reproducible(spark):
    rows = [("A" if i % 3 else "B", str(i), 12.9, 77.6) for i in range(3000)]
    df = spark.createDataFrame(
        rows, "station_key string, id string, latitude double, longitude double"
    )
    first = heatmap.heatmap_sample(df, 50, S)
    again = heatmap.heatmap_sample(df.repartition(7, F.rand(1)), 50, S)
    ids = {r.id for r in first.collect()}
    assert len(ids) == 100 and ids == {r.id for r in again.collect()}
    with pytest.raises(ValueError):
        heatmap.cap_sample(df.limit(0), S)
