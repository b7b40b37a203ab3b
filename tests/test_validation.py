from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from gridwarden.config import Settings
from gridwarden.functions import text
from gridwarden.functions.parsing import to_double, to_utc_timestamp
from gridwarden.operators import validate as v

S = Settings()
SCHEMA = ", ".join(f"{c} string" for c in v.REQUIRED) + ", ingest_order bigint"
ROWS = [
    ("a-70", "13.1024", "77.4418", "VAN", "['NO PARKING', 'WRONG PARKING']", "East Gate", "Harbour", "2023-11-02 22:05:09"),
    ("a-71", "12.7315", "77.8802", " tempo", '["PARKING ON FOOTPATH"]', "null", "Harbour", "2023-11-03 06:41:00"),
    ("a-72", "0", "0", "BUS", "UNKNOWN", "East Gate", "Harbour", "2023-11-03 07:00:00"),
    ("a-73", "12.9x", "77.5000", "CAR", "NULL", "Mill Lane", "Old Town", "yesterday"),
    ("a-74", "12.8800", "", "JEEP", "['NO PARKING']", None, "Old Town", "2023-11-04 12:30:00"),
    ("a-75", "13.4500", "77.3000", "HOVERCRAFT", "wrong parking", "   ", "NULL", "2023-11-05 00:00:01"),
    ("a-76", "12.6999", "77.5000", "CAR", "['NO PARKING']", "Mill Lane", "Old Town", "2023-11-05 09:15:00"),
    ("a-70", "13.1024", "77.4418", "VAN", "['NO PARKING']", "East Gate", "Harbour", "2023-11-02 22:05:10"),
]


@pytest.fixture(scope="module")
def feed(spark):
    return spark.createDataFrame([(*r, i) for i, r in enumerate(ROWS)], SCHEMA)


def test_report_counts_every_row(feed):
    row = v.report(feed, S).first()
    assert (row.total_rows_seen, row.valid_rows, row.rejected_rows) == (8, 3, 5)
    assert row.rejection_rate == 0.625 and row.passed is False
    long = {r.reason: r.n for r in v.reasons_long(v.report(feed, S)).collect()}
    assert long == {v.MISSING: 2, v.NULL_ISLAND: 1, v.OUTSIDE: 1, v.DUPLICATE: 1}
    with pytest.raises(v.QualityGateError):
        v.enforce_gate(row)


def test_clean_rows(feed):
    got = {r.id: r for r in v.clean(feed, S).collect()}
    assert set(got) == {"a-70", "a-71", "a-75"}
    assert (got["a-71"].vehicle_type, got["a-71"].vehicle_weight) == ("TEMPO", 2)
    assert got["a-71"].junction_name == "null"
    assert got["a-70"].violation_type_clean == "NO PARKING, WRONG PARKING"
    assert (got["a-75"].police_station, got["a-75"].vehicle_weight) == ("Unknown", 1)
    assert got["a-70"].vehicle_weight == 2 and got["a-75"].junction_name == "No Junction"


def test_missing_column_is_an_error(spark):
    with pytest.raises(ValueError, match="longitude"):
        v.report(spark.createDataFrame([("1", "12.9")], "id string, latitude string"), S)


def test_empty_feed(spark):
    row = v.report(spark.createDataFrame([], SCHEMA), S).first()
    assert (row.total_rows_seen, row.valid_rows, row.rejection_rate) == (0, 0, 0.0)
    assert row.passed is False
    with pytest.raises(v.QualityGateError, match="no rows"):
        v.enforce_gate(row)


def test_bad_time_and_shadowing_first_row(spark):
    base = list(ROWS[0])
    late = [*base[:7], "not-a-real-date"]
    df = spark.createDataFrame([(*late, 0), (*base, 1)], SCHEMA)
    row = v.report(df, S).first()
    assert row.unparseable_timestamp == 1
    assert (row.valid_rows, row.duplicate_id) == (0, 1)  # the invalid first row shadows


def test_null_ids_are_one_id_and_reasons_overlap(spark):
    none = (None, *ROWS[0][1:])
    inf = ("9", "inf", *ROWS[0][2:])
    df = spark.createDataFrame([(*none, 0), (*none, 1), (*inf, 2)], SCHEMA)
    row = v.report(df, S).first()
    assert (row.valid_rows, row.duplicate_id) == (1, 1)
    assert (row.non_finite_coordinates, row.outside_service_geofence) == (1, 1)


def test_merge_reports(feed):
    one = v.report(feed, S)
    row = v.merge_reports(one.union(one), S).first()
    assert (row.total_rows_seen, row.valid_rows, row.rejection_rate) == (16, 6, 0.625)


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        (None, "UNKNOWN"), ("", "UNKNOWN"), (" null ", "UNKNOWN"), ("[]", "[]"),
        ('["a", " b c "]', "A, B C"), ("['x']", "X"), ("'q'", "Q"), ("5", "5"),
        ("[broken", "[BROKEN"), ("plain text", "PLAIN TEXT"),
    ],
)
def test_violation_text(spark, raw, want):
    df = spark.createDataFrame([(raw,)], "c string")
    assert df.select(text.violation_text(F.col("c"))).first()[0] == want


def test_numbers_and_times(spark):
    words = ["12.9", " 12.9 ", "12.9d", "12.9f", "inf", "nan", "1e1", "x", None]
    df = spark.createDataFrame([(w,) for w in words], "c string")
    got = [r[0] for r in df.select(to_double(F.col("c"))).collect()]
    assert got == [12.9, 12.9, None, None, float("inf"), None, 10.0, None, None]
    times = ["2024-01-15T08:30:00Z", "2024-01-15 08:30:00+05:30", "08:30", "15/01/2024 08:30"]
    df = spark.createDataFrame([(t,) for t in times], "c string")
    iso = df.select(to_utc_timestamp(F.col("c")).cast("string")).collect()
    assert [r[0] for r in iso] == ["2024-01-15 08:30:00", "2024-01-15 03:00:00", None, None]
    extra = df.select(to_utc_timestamp(F.col("c"), ("dd/MM/yyyy HH:mm",)).cast("string")).collect()
    assert extra[3][0] == "2024-01-15 08:30:00"


def test_strict_contract_differs(spark):
    base = list(ROWS[0])
    base[3], base[5], base[6] = "", "null", ""
    df = spark.createDataFrame([(*base, 0)], SCHEMA)
    loose, strict = v.clean(df, S).first(), v.strict_records(df, S).first()
    assert (loose.vehicle_type, loose.junction_name, loose.police_station) == ("", "null", "")
    assert (strict.vehicle_type, strict.junction_name) == ("UNKNOWN", "No Junction")
    assert strict.police_station == "Unknown" and strict.violation_type == ["NO PARKING", "WRONG PARKING"]


def test_station_key(spark):
    df = spark.createDataFrame([("A B",), ("A_B",), ("",), ("é1.",)], "c string")
    got = [r[0] for r in df.select(text.station_key(F.col("c"))).collect()]
    assert got == ["A_B", "A_B", "unknown", "é1_"]
