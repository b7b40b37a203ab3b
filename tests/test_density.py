"""Density clustering: equality with brute force, invariants, independence of partitioning."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from gridwarden.config import NOISE, Settings
from gridwarden.operators import candidate_edges as edge_search
from gridwarden.operators import condense, density
from gridwarden.operators.candidate_edges import candidate_edges
from gridwarden.operators.components import components
from gridwarden.operators.core_distance import core_distances
from gridwarden.operators.quadtree import distinct_points
from gridwarden.plans.catalog import clean
from gridwarden.session import written
from tests.brute_force import cluster

S = Settings()


def made_up_rows() -> list[tuple]:
    """Blobs of different density, a lattice with many equal distances, piled-up coordinates,
    scattered points, and a station below the least size."""
    rng = random.Random(7)
    rows = []

    def add(station, lat, lon):
        rows.append((station, f"{len(rows):05d}", round(lat, 6), round(lon, 6)))

    for x, y, spread, n in [(12.90, 77.50, 4e-4, 60), (12.9035, 77.503, 3e-4, 40),
                            (12.95, 77.60, 2e-3, 70), (12.9501, 77.6301, 1e-4, 25)]:
        for _ in range(n):
            add("Blobs", rng.gauss(x, spread), rng.gauss(y, spread))
    for _ in range(40):
        add("Blobs", rng.uniform(12.8, 13.1), rng.uniform(77.4, 77.7))
    for i in range(9):
        for j in range(8):
            add("Lattice", 13.0 + i * 1e-4, 77.5 + j * 1e-4)
            if (i * j) % 5 == 0:
                add("Lattice", 13.02 + i * 3e-4, 77.52 + j * 2e-4)
    for _ in range(40):
        add("Piled", 13.1, 77.6)
    for _ in range(7):
        add("Piled", 13.1002, 77.6)
    for _ in range(14):
        add("Piled", 13.1004, 77.6002)
    for _ in range(60):
        add("Piled", rng.gauss(13.12, 5e-4), rng.gauss(77.62, 5e-4))
    for i in range(9):
        add("Small", 13.2 + i * 1e-5, 77.7)
    for i in range(10):
        add("Ten", 13.2 + i * i * 1e-5, 77.7)
    return rows


def as_groups(labels: dict[str, object]) -> set[frozenset]:
    groups: dict[object, set] = {}
    for key, label in labels.items():
        groups.setdefault(label, set()).add(key)
    return {frozenset(g) for g in groups.values()}


def expected(rows) -> dict[str, str]:
    out = {}
    for station in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == station]
        labels = cluster([r[2] for r in mine], [r[3] for r in mine], S.min_cluster_size)
        out |= {
            r[1]: NOISE if x == -1 else f"{station}-{x}" for r, x in zip(mine, labels, strict=True)
        }
    return out


def check_same(got: dict[str, str], want: dict[str, str]) -> None:
    assert {k for k, v in got.items() if v == NOISE} == {k for k, v in want.items() if v == NOISE}
    hot = {k: v for k, v in got.items() if v != NOISE}
    assert as_groups(hot) == as_groups({k: v for k, v in want.items() if v != NOISE})


@pytest.fixture(scope="module")
def table(spark):
    rows = made_up_rows()
    df = spark.createDataFrame(
        rows, "station_key string, id string, latitude double, longitude double"
    )
    return rows, written(df, "fixture")


@pytest.mark.parametrize("round_limit", [2_000_000, 300, 20])
def test_equals_brute_force(table, round_limit):
    """The small limit forces tile thinning and many rounds of merging."""
    rows, df = table
    got = {
        r["id"]: r["cluster_id"]
        for r in density.cluster_hotspots(df, S, round_limit).collect()
    }
    assert len(got) == len(rows)
    check_same(got, expected(rows))
    assert len({v for v in got.values() if v != NOISE}) >= 6


def test_no_part_of_a_round_is_large(table):
    """Parts of a round hold at most the limit, but for edges of one weight, and come to an end."""
    _, df = table
    edges = written(candidate_edges(core_distances(distinct_points(df, S))), "edges")
    now, later = condense._round(edges, 20)
    sizes = now.groupBy("station_key", "part").agg(
        F.count("*").alias("n"), F.min("weight").alias("low"), F.max("weight").alias("high")
    )
    assert sizes.filter("n > 20 AND low < high").isEmpty() and later is not None
    assert sizes.filter("station_key = 'Blobs'").count() > 3
    assert now.count() + later.count() == edges.count()
    ends = now.select("station_key", "part", F.explode(F.array("u", "v")).alias("p")).distinct()
    assert ends.groupBy("station_key", "p").count().filter("count > 1").isEmpty()


@pytest.mark.parametrize("one_task", [0, 1_000])
def test_components(spark, one_task):
    draw = random.Random(4)
    pairs = [(draw.randrange(300), draw.randrange(300)) for _ in range(150)] + [(i, i + 1) for i in range(400, 460)]
    pairs += [(7, 7), (1000 - 1, 999), (2000, 1500), (1500, 2000)]
    parent = {n: n for p in pairs for n in p if p[0] != p[1]}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in pairs:
        if a != b:
            a, b = sorted((root(a), root(b)))
            parent[b] = a
    edges = spark.createDataFrame(pairs, "u long, v long")
    got = {r.node: r.component for r in components(edges, one_task=one_task).collect()}
    assert got == {n: root(n) for n in parent}
    assert components(edges.limit(0), one_task=one_task).collect() == []


def test_any_partitioning_gives_the_same_labels(spark, table):
    _, df = table
    before = {r["id"]: r["cluster_id"] for r in density.cluster_hotspots(df, S).collect()}
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        shuffled = written(df.repartition(5, F.rand(3)), "shuffled")
        after = {r["id"]: r["cluster_id"] for r in density.cluster_hotspots(shuffled, S).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert before == after


def test_feed_clusters_equal_brute_force(spark, sf_dir):
    rows = written(clean(spark, sf_dir).select("station_key", "id", "latitude", "longitude"), "rows")
    assigned = written(density.cluster_hotspots(rows, S), "assigned")
    pairs = rows.collect()
    got = {r["id"]: r["cluster_id"] for r in assigned.collect()}
    check_same(got, expected([tuple(r) for r in pairs]))
    sizes = density.station_stats(assigned).agg(F.sum("n_points")).first()[0]
    assert sizes == len(pairs)
    least = assigned.filter(F.col("cluster_id") != NOISE).groupBy("cluster_id").count()
    assert least.agg(F.min("count")).first()[0] >= S.min_cluster_size


def test_joined_tiles_need_no_far_pairs(spark, table, monkeypatch):
    """Few pairs that are apart are compared, the edges still hold a minimum spanning tree, and
    tiles are joined alike in one task and in rounds."""
    draw = random.Random(5)
    places = [("Dense", f"{i:05d}", 13.0 + (i % 60) * 1e-5, 77.5 + (i // 60) * 1e-5) for i in range(3_600)]
    places += [("Dense", f"n{i:04d}", draw.uniform(12.9, 13.1), draw.uniform(77.4, 77.6)) for i in range(200)]
    df = spark.createDataFrame(places, "station_key string, id string, latitude double, longitude double")
    cored = core_distances(distinct_points(written(df, "places"), S))

    def weights() -> tuple[int, list[float]]:
        rows = candidate_edges(cored).collect()
        parent: dict[int, int] = {}

        def root(n):
            while parent.setdefault(n, n) != n:
                n = parent[n]
            return n

        tree = []
        for e in sorted(rows, key=lambda e: e.weight):
            a, b = root(e.u), root(e.v)
            if a != b:
                parent[a] = b
                tree.append(e.weight)
        return len(rows), tree

    n, tree = weights()
    monkeypatch.setattr(edge_search, "_unjoined", lambda apart, tile_edges: apart)
    n_all, tree_all = weights()
    assert tree == tree_all and len(tree) == 3_799
    assert n < 2 * 3_800 < n_all
    pairs = [(draw.randrange(90), draw.randrange(90), draw.random()) for _ in range(70)]
    edges = written(spark.createDataFrame(pairs, "u long, v long, weight double").where("u <> v"), "some")
    got = [
        {r.node: list(r.labels) for r in edge_search.joined_at(edges, [0.2, 0.5, 0.9], limit).collect()}
        for limit in (0, 1_000)
    ]
    assert got[0] == got[1] and len({tuple(x) for x in got[0].values()}) > 3
