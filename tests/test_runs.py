from __future__ import annotations

import hashlib
import random

import pytest

from gridwarden.config import RuleFileError, Settings, load_rules
from gridwarden.operators import forecast, leaderboard, registry
from gridwarden.plans.catalog import events_feed, grid_assignments
from gridwarden.plans.training import IncompleteRunError, load_run, run_training
from gridwarden.session import broadcast_if_small
from gridwarden.sources import feed, store
from gridwarden.sources.blocks import block_fingerprint
from gridwarden.streaming import ingest

FAST = Settings(n_trees=10, max_depth=4)
CASES = [
    (5.0, None, 10, False, True), (1.0, 1.5, 10, False, True), (1.09, 1.0, 10, False, True),
    (1.10, 1.0, 10, False, True), (1.101, 1.0, 10, False, False), (1.15, 1.0, 10, False, False),
    (99.0, 1.0, 10, True, True), (1.02, 1.0, 1, False, False), (1.49, 1.0, 50, False, True),
    (0.0, 0.0, 10, False, True),
]


def verdict(spark, new, prev, settings, force=False, has=None):
    one = spark.createDataFrame(
        [(new, prev is not None if has is None else has, prev, force)],
        "new_mae double, has_previous boolean, prev_mae double, force boolean",
    )
    return registry.promotion_gate(one, settings).first()


@pytest.mark.parametrize(("new", "prev", "tolerance", "force", "want"), CASES)
def test_gate(spark, new, prev, tolerance, force, want):
    settings = Settings(max_mae_regression_pct=float(tolerance))
    assert verdict(spark, new, prev, settings, force)["promoted"] is want


def test_gate_texts(spark):
    s = Settings()
    assert "bypassed" in verdict(spark, 99.0, 1.0, s, True)["reason"]
    assert verdict(spark, 99.0, 1.0, Settings(require_gate=False))["promoted"]
    assert verdict(spark, 1.0, None, s, has=True)["promoted"]
    text = verdict(spark, 1.2, 1.0, s)["reason"]
    assert text.startswith("REJECTED — MAE regressed: 1.2000 > 1.1000 (prev=1.0000")
    text = verdict(spark, 0.5, 1.0, s)["reason"]
    assert text == "passed (prev=1.0000 → new=0.5000, +50.0% better)"


def test_rules_file(tmp_path):
    path = tmp_path / "rules.yaml"
    path.write_text("severity_mapping:\n  TEST: 9.9\n")
    changed = load_rules(Settings(), path)
    assert changed.severity_rules == {"TEST": 9.9} and "CAR" in changed.vehicle_weights
    assert load_rules(Settings(), tmp_path / "none.yaml") == Settings()
    path.write_text(": : bad : :")
    with pytest.warns(UserWarning):
        assert load_rules(Settings(), path) == Settings()
    path.write_text("vehicle_weight_mapping:\n  DRAY: 3\nseverity_mapping:\n  LOUD: often\n")
    with pytest.raises(RuleFileError, match="severity_mapping: LOUD"):
        load_rules(Settings(), path)
    path.write_text("severity_mapping: [1, 2]\n")
    with pytest.raises(RuleFileError, match="no table"):
        load_rules(Settings(), path)
    path.write_text("# nothing\n")
    assert load_rules(Settings(), path) == Settings()


def test_station_keys_stay_text(spark, tmp_path):
    rows = [("a", "007"), ("b", "7"), ("c", "1e3"), ("d", "1000"), ("e", "12")]
    df = spark.createDataFrame(rows, "id string, police_station string")
    root = f"{tmp_path}/store"
    store.write_partitioned(df, root)
    assert {r.id: r.station_key for r in store.read_table(spark, root).collect()} == dict(rows)
    assert [r.id for r in store.read_station(spark, root, "007").collect()] == ["a"]
    assert [r.station_key for r in store.list_stations(store.read_table(spark, root)).collect()] == sorted(
        k for _, k in rows
    )


def test_broadcast_by_rows_and_bytes(spark):
    df = spark.range(100).selectExpr("id", "repeat('x', 1000) AS text")
    plan = lambda x: spark.range(5).join(x, "id")._jdf.queryExecution().toString()
    assert "strategy=broadcast" in plan(broadcast_if_small(df, 100))
    assert "strategy=broadcast" not in plan(broadcast_if_small(df, 99))
    assert "strategy=broadcast" not in plan(broadcast_if_small(df, 100, byte_limit=99_000))


def test_fingerprints(spark, tmp_path):
    a = tmp_path / "a.csv"
    a.write_bytes(b"id,lat\n1,2\n")
    row = registry.file_fingerprint(spark, str(a)).first()
    assert row.sha256 == hashlib.sha256(b"id,lat\n1,2\n").hexdigest()
    assert registry.file_fingerprint(spark, str(tmp_path / "none")).first().sha256 == "unavailable"
    df = spark.range(100).selectExpr("id", "id % 7 AS x")
    one, two = (registry.row_fingerprint(x).first() for x in (df, df.repartition(9)))
    assert one == two != registry.row_fingerprint(df.filter("id > 0")).first()


def test_csv_feed(spark, tmp_path):
    path = tmp_path / "feed.csv"
    header = ",".join(feed.REQUIRED)
    path.write_text(
        f"{header}\n"
        '1,12.9,77.6,CAR,"[""A"",""B""]",NULL,St 1,2024-01-01\n'
        "2,12.9,77.6\n"
        "3,12.9,77.6,CAR,X,J,S,2024-01-01,surplus\n"
    )
    rows = {r.id: r for r in feed.scan_csv_feed(spark, str(path)).collect()}
    assert set(rows) == {"1", "2"}
    assert rows["1"].violation_type == '["A","B"]' and rows["1"].junction_name is None
    assert rows["2"].vehicle_type is None
    assert tuple(feed.bad_lines(spark, str(path)).first()) == (3, 1, 1)
    with pytest.raises(ValueError):
        feed.read_feed(spark, "xml", "x", Settings())


def test_jdbc_plan():
    options = feed.jdbc_options("jdbc:postgresql://db/x", "violations", Settings(), buckets=16)
    assert "ST_MakeEnvelope(77.3, 12.7, 77.9, 13.45, 4326)" in options["dbtable"]
    assert options["partitionColumn"] == "bucket" and options["numPartitions"] == "16"
    assert "query" in feed.jdbc_options("jdbc:postgresql://db/x", "violations", Settings())


def test_stream_takes_in_new_files_once(spark, tmp_path):
    drops, root = tmp_path / "drops", str(tmp_path / "root")
    drops.mkdir()
    header = ",".join(feed.REQUIRED)
    line = "{},12.9,77.6,CAR,X,J,S 1,2024-01-01 00:00:00"
    (drops / "a.csv").write_text("\n".join([header, line.format(1), line.format(2)]))
    ingest.ingest_available(spark, str(drops), root, Settings())
    (drops / "b.csv").write_text("\n".join([header, line.format(2), line.format(3)]))
    ingest.ingest_available(spark, str(drops), root, Settings())
    ingest.ingest_available(spark, str(drops), root, Settings())
    assert sorted(r.id for r in ingest.clean_rows(spark, root).collect()) == ["1", "2", "3"]
    reports = ingest.batch_reports(spark, root).orderBy("batch_id").collect()
    assert [r.valid_rows for r in reports] == [2, 1] and reports[1].duplicate_id == 1


def stand_in(clean, settings):
    return grid_assignments(clean, settings).select("station_key", "id", "cluster_id")


def test_runs_are_kept_and_served(spark, sf_dir, tmp_path):
    root = str(tmp_path / "artifacts")
    with pytest.raises(IncompleteRunError):
        load_run(spark, root)
    assert registry.run_health(
        registry.read_runs(spark, f"{root}/runs"), registry.F.current_timestamp()
    ).first().status == "degraded"
    raw = events_feed(spark, sf_dir)
    first = run_training(raw, root, FAST, assign=stand_in, run_id="run_1")
    assert first["promotion_gate"]["promoted"]
    strict = Settings(n_trees=1, max_depth=1, learning_rate=0.01, max_mae_regression_pct=-99.0)
    second = run_training(raw, root, strict, assign=stand_in, run_id="run_2")
    assert not second["promotion_gate"]["promoted"]
    run = load_run(spark, root)
    assert run.metrics["run_id"] == "run_1"
    assert registry.read_runs(spark, f"{root}/runs").count() == 2
    board = run.leaderboard
    assert board.count() == first["total_hotspots"] == run.metrics["total_hotspots"]
    best = board.filter("rank = 1").first().cluster_id
    assert leaderboard.lookup_hotspot(board, best).count() == 1
    with pytest.raises(leaderboard.UnknownHotspotError):
        leaderboard.lookup_hotspot(board, "NOT_REAL")
    asked = spark.createDataFrame(
        [(best, 18, 2), ("GHOST::99", 1, 1), (best, 99, 1), (" ", 1, 1)],
        "cluster_id string, hour int, day_of_week int",
    )
    good, bad = forecast.predict_batch(asked, run.forecast, FAST)
    assert [r.predicted_violations >= 0 for r in good.collect()] == [True]
    assert {r.reject_reason for r in bad.collect()} == {
        "unknown_cluster", "hour_out_of_range", "blank_cluster_id",
    }
    names = [r.feature for r in run.feature_importance.collect()]
    assert sorted(names) == sorted(forecast.FEATURES)


def replayed(spark, rows, settings):
    runs = spark.createDataFrame(rows, "model_version string, generated_at long, run_id string, forecast_mae double, force boolean")
    out = registry.promotion_replay(runs, settings).collect()
    return {(r.model_version, r.run_id): (r.promoted, r.baseline_run_id, r.baseline_mae) for r in out}


@pytest.mark.parametrize("gate", [True, False])
def test_promotion_replay(spark, gate):
    """Against the gate itself, asked run by run."""
    draw = random.Random(8)
    rows = [
        (draw.choice(["a", "a", "b", None]), i // 2, f"r{i:03d}", draw.choice([None, float("nan"), 1.0, 1.05, 1.1, 1.3, 2.0]), draw.choice([True, None, False, False, False]))
        for i in range(300)
    ]
    settings = Settings(require_gate=gate)
    want = {}
    for version in {r[0] for r in rows}:
        held = None
        for _, _, run, error, force in sorted((r for r in rows if r[0] == version), key=lambda r: r[1:3]):
            error = None if error is None or error != error else error
            ok = bool(force) or not gate or held is None or held[1] is None or (error is not None and error <= held[1] * 1.1)
            want[version, run] = (ok, *(held or (None, None)))
            held = (run, error) if ok else held
    assert replayed(spark, rows, settings) == want
    assert replayed(spark, [], settings) == {}


def test_a_lookup_reads_one_row_group(spark, tmp_path):
    import pyarrow.parquet as pq

    rows = [(f"S::{i:06d}", "x" * 40 + str(i)) for i in range(30_000)]
    board = spark.createDataFrame(rows, "cluster_id string, text string")
    path = f"{tmp_path}/board"
    store.write_indexed(board, path, "cluster_id", group_bytes=64 << 10)
    groups = [
        pq.ParquetFile(f).metadata.row_group(g)
        for f in tmp_path.glob("board/*.parquet") for g in range(pq.ParquetFile(f).num_row_groups)
    ]
    assert len(groups) > 8 and sum(g.num_rows for g in groups) == 30_000
    wanted = "S::012345"
    fits = [g.num_rows for g in groups if g.column(0).statistics.min <= wanted <= g.column(0).statistics.max]
    assert len(fits) == 1
    found = spark.read.parquet(path).where(f"cluster_id = '{wanted}'")
    assert found.collect()[0].text.endswith("12345")
    plan = found._jdf.queryExecution().executedPlan()
    scan = plan.collectLeaves().head()
    assert scan.metrics().apply("numOutputRows").value() <= max(fits)


def tree_digest(data, block, fan):
    level = [hashlib.sha256(data[i : i + block]).digest() for i in range(0, len(data), block)] or [hashlib.sha256(b"").digest()]
    while len(level) > 1:
        level = [hashlib.sha256(b"".join(level[i : i + fan])).digest() for i in range(0, len(level), fan)]
    return level[0].hex()


def test_command_line(spark, sf_dir, tmp_path, capsys):
    from gridwarden import train

    path, root = f"{tmp_path}/feed", f"{tmp_path}/artifacts"
    events_feed(spark, sf_dir).select(*feed.REQUIRED).coalesce(1).write.option("header", "true").option("escape", '"').csv(path)
    asked = ["--feed", f"{path}/*.csv", "--artifacts", root]
    assert train.main(asked)["promotion_gate"]["promoted"]
    (tmp_path / "rules.yaml").write_text("severity_mapping:\n  FOOTPATH: 4.0\n")
    row = train.main([*asked, "--rules", f"{tmp_path}/rules.yaml", "--force-promote"])
    assert "bypassed" in row["promotion_gate"]["reason"]
    assert "no baseline" in capsys.readouterr().out
    assert load_run(spark, root).metrics["run_id"] == row["run_id"]
    with pytest.raises(SystemExit):
        train.arguments(["--feed", "x"])


def test_block_fingerprints(spark, tmp_path):
    """Files of every kind of end, read whole and in many splits."""
    draw = random.Random(9)
    contents = {
        "empty": b"", "one": b"x", "line": b"x\n", "lines": b"\n" * 70_000, "returns": b"a\r\nb\r" * 9_000, "exact": b"y" * 999 + b"\n",
        "random": draw.randbytes(300_000), "random-end": draw.randbytes(200_000) + b"\n", "late": draw.randbytes(5_000) + b"z" * 90_000,
    }
    for name, data in contents.items():
        (tmp_path / name).write_bytes(data)
    want = {n: (len(d), tree_digest(d, 1000, 8)) for n, d in contents.items()}
    want.pop("empty")
    for split in ("128m", "20k"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        try:
            rows = block_fingerprint(spark, str(tmp_path), block=1000, fan=8).collect()
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
        assert {r.path.rsplit("/")[-1]: (r.n_bytes, r.digest) for r in rows} == want
    assert block_fingerprint(spark, f"{tmp_path}/none").first().digest == "unavailable"


def test_bucketed_join_needs_no_exchange(spark, tmp_path):
    draw = random.Random(2)
    rows = [(f"S{draw.randrange(3)}", draw.choice([None, "", str(i)]) if i % 50 == 0 else str(i), i) for i in range(2_000)]
    rows = list({(s, i): (s, i, n) for s, i, n in rows}.values())
    labels = [(s, i, f"{s}::{n % 5}") for s, i, n in rows if n % 3]
    clean = spark.createDataFrame(rows, "station_key string, id string, n int")
    assigned = spark.createDataFrame(labels, "station_key string, id string, cluster_id string")
    want = store.join_assignments(clean, assigned)
    for name, table in (("clean", clean), ("labels", assigned)):
        store.write_bucketed(table, f"{tmp_path}/{name}", 6)
    got = store.join_bucketed(*(store.read_bucketed(spark, f"{tmp_path}/{n}", 6) for n in ("clean", "labels")))
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.select(got.columns).collect()))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan
