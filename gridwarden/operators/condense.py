"""From weighted edges to flat clusters: single linkage, condensed by a least cluster size,
with the clusters of largest excess of mass selected.

Edges are taken in rounds. A station with at most `limit` edges is one part and ends in that
round. Otherwise its lighter half of edges falls into connected components, each a part of its
own: what merges inside depends on no other edge. A component with more than `limit` edges is
halved again in the same way, so no task sees more edges than that, however large the station,
and one station is worked on by many tasks. What a round merged becomes one node with a few
running sums, the remaining edges are relabelled, and their number at least halves, so rounds grow
with the logarithm of the largest station. The exception are edges of one and the same weight,
which merge at once and stay together.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridwarden.operators import quadtree as qt
from gridwarden.operators.components import components
from gridwarden.session import spread, written

ROUND_LIMIT = 500_000  # edges of a part

# node: a component; rows: incident rows in it; mass: sum of rows/weight over everything that
# joined the open cluster; kids: selected mass of the closed clusters below it
STATE = "station_key string, node bigint, rows bigint, mass double, kids double"
MERGED = (
    "station_key string, node bigint, comp bigint, cluster string, "
    "rows bigint, mass double, kids double"
)


def flat_clusters(
    points: DataFrame, edges: DataFrame, min_size: int, limit: int = ROUND_LIMIT
) -> DataFrame:
    """(station_key, pid, cluster) for the points of selected clusters."""
    born = F.when(F.col("w") >= min_size, F.col("w") / F.nullif(F.col("core"), F.lit(0.0)))
    mass = F.when(
        (F.col("w") >= min_size) & (F.col("core") == 0), F.lit(float("inf"))
    ).otherwise(F.coalesce(born, F.lit(0.0)))
    state = points.select(
        "station_key",
        F.col("pid").alias("node"),
        F.col("w").alias("rows"),
        mass.alias("mass"),
        F.lit(0.0).alias("kids"),
    )
    edges = thin_by_tile(points, edges, limit)
    steps: list[DataFrame] = []
    while True:
        now, later = _round(edges, limit)
        if now is None:
            break
        merged = written(_merge_round(now, state, min_size, len(steps)), "merged")
        steps.append(merged.select("station_key", "node", "comp", "cluster"))
        if later is None:
            break
        edges = written(_relabel(later, merged), "edges")
        untouched = state.join(merged.select("station_key", "node"), ["station_key", "node"], "left_anti")
        survivors = merged.filter("node = comp").select(*state.columns)
        state = written(untouched.unionByName(survivors), "state")
    return _labels(points, steps)


def _round(edges: DataFrame, limit: int) -> tuple[DataFrame | None, DataFrame | None]:
    """Edges that merge now, with their part, and those that wait; None for none."""
    part = ["station_key", "part"]
    open_ = edges.withColumn("part", F.lit(0).cast("bigint"))
    now: list[DataFrame] = []
    later: list[DataFrame] = []
    while True:
        middle = F.percentile_approx("weight", F.lit(0.5), F.lit(10_000))
        sizes = written(
            open_.groupBy(*part).agg(
                F.count("*").alias("n"), F.min("weight").alias("low"), F.max("weight").alias("high"), middle.alias("middle")
            ),
            "parts",
        )
        fits = (F.col("n") <= limit) | (F.col("low") == F.col("high"))
        n_small, n_large = sizes.agg(F.count_if(fits), F.count_if(~fits)).first()
        if n_small:
            now.append(open_.join(sizes.filter(fits).select(*part), part, "left_semi") if n_large else open_)
        if not n_large:
            break
        large = sizes.filter(~fits).select(*part, "middle", "high")
        # many edges of the largest weight: take all that are lighter
        light = F.when(F.col("middle") < F.col("high"), F.col("weight") <= F.col("middle")).otherwise(
            F.col("weight") < F.col("high")
        )
        cut = written(open_.join(large, part).withColumn("light", light).drop("part", "middle", "high"), "halves")
        later.append(cut.filter("NOT light").drop("light"))
        half = cut.filter("light").drop("light")
        named = components(half).select(F.col("node").alias("u"), F.col("component").alias("part"))
        open_ = written(half.join(named, "u").select(*edges.columns, "part"), "halves")
    return (_joined(now), _joined(later))


def _joined(tables: list[DataFrame]) -> DataFrame | None:
    return reduce(DataFrame.unionByName, tables) if tables else None


def _relabel(edges: DataFrame, merged: DataFrame) -> DataFrame:
    """Ends of the remaining edges as components; of parallel edges the lightest one stays."""
    names = merged.select("station_key", "node", "comp")
    for end in ("u", "v"):
        renamed = names.select("station_key", F.col("node").alias(end), "comp")
        edges = (
            edges.join(renamed, ["station_key", end], "left")
            .withColumn(end, F.coalesce("comp", end))
            .drop("comp")
        )
    ends = {"lo": F.least("u", "v"), "hi": F.greatest("u", "v")}
    return (
        edges.filter("u <> v")
        .withColumns(ends)
        .groupBy("station_key", "lo", "hi")
        .agg(F.min("weight").alias("weight"))
        .select("station_key", F.col("lo").alias("u"), F.col("hi").alias("v"), "weight")
    )


def thin_by_tile(points: DataFrame, edges: DataFrame, limit: int) -> DataFrame:
    """Where a station has more edges than one round takes, drops edges that some tile of the
    map proves useless: those that close a cycle of lighter edges inside the tile."""
    n = edges.groupBy("station_key").agg(F.count("*").alias("n"))
    large = written(n.filter(F.col("n") > limit).select("station_key"), "large")
    if large.isEmpty():
        return edges
    tile_points = max(2, limit // 20)
    some = points.join(large, "station_key", "left_semi")
    base = some.drop("core")
    table = qt.cells(base, [])
    tiles = qt.place(base, table, F.col("n") <= tile_points).select(*qt.CELL, "pid")
    tiles = written(tiles, "tiles")
    big = edges.join(large, "station_key", "left_semi")
    for end in ("u", "v"):
        here = tiles.select(
            "station_key",
            F.col("pid").alias(end),
            F.col("kx").alias(f"kx_{end}"),
            F.col("ky").alias(f"ky_{end}"),
        )
        big = big.join(here, ["station_key", end])
    big = written(big, "tiled")
    same = "kx_u = kx_v AND ky_u = ky_v"
    tile = ["station_key", "kx_u", "ky_u"]
    inside = (
        spread(big.filter(same), *tile)
        .groupBy(*tile)
        .applyInPandas(_spanning_forest, "station_key string, u bigint, v bigint, weight double")
    )
    across = big.filter(f"NOT ({same})").select(*edges.columns)
    rest = edges.join(large, "station_key", "left_anti")
    return written(rest.unionByName(inside.unionByName(across)), "thinned")


def _codes(*ends: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    names, codes = np.unique(np.concatenate(ends), return_inverse=True)
    return names, np.split(codes, np.cumsum([len(e) for e in ends])[:-1])


def _find(parent: list[int], i: int) -> int:
    while parent[i] != i:
        parent[i] = parent[parent[i]]
        i = parent[i]
    return i


def _spanning_forest(tile: pd.DataFrame) -> pd.DataFrame:
    tile = tile.sort_values(["weight", "u", "v"])
    names, (u, v) = _codes(tile["u"].to_numpy(), tile["v"].to_numpy())
    parent = list(range(len(names)))
    keep = np.zeros(len(tile), dtype=bool)
    for i, (a, b) in enumerate(zip(u.tolist(), v.tolist(), strict=True)):
        a, b = _find(parent, a), _find(parent, b)
        if a != b:
            parent[a] = b
            keep[i] = True
    return tile.loc[keep, ["station_key", "u", "v", "weight"]]


def _merge_round(now: DataFrame, state: DataFrame, min_size: int, number: int) -> DataFrame:
    ends = now.select("station_key", "part", F.explode(F.array("u", "v")).alias("node")).distinct()
    touched = state.join(ends, ["station_key", "node"])
    nulls = {c: F.lit(None).cast("double") for c in ("mass", "kids", "weight")}
    edge_rows = now.select(
        "station_key", "part", "u", "v", "weight", F.lit(None).cast("bigint").alias("rows"),
        nulls["mass"].alias("mass"), nulls["kids"].alias("kids"),
    )
    node_rows = touched.select(
        "station_key", "part", F.col("node").alias("u"), F.lit(None).cast("bigint").alias("v"),
        nulls["weight"].alias("weight"), "rows", "mass", "kids",
    )

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        return _merge(group, min_size, number)

    rows = spread(node_rows.unionByName(edge_rows), "station_key", "part")
    return rows.groupBy("station_key", "part").applyInPandas(merge, MERGED)


@dataclass
class _Tree:
    """Clusters met in one round: their parent, and the cluster that stands for them."""

    parent: list[int] = field(default_factory=list)
    chosen: list[bool] = field(default_factory=list)
    closed: list[bool] = field(default_factory=list)

    def add(self) -> int:
        self.parent.append(-1)
        self.chosen.append(False)
        self.closed.append(False)
        return len(self.parent) - 1

    def close(self, i: int, parent: int, chosen: bool) -> None:
        self.parent[i], self.chosen[i], self.closed[i] = parent, chosen, True

    def standing(self) -> list[int]:
        """For each cluster the topmost chosen closed one at or above it, or -1. Parents are
        always younger, so one pass from the youngest down settles all."""
        top = [-1] * len(self.parent)
        for i in range(len(self.parent) - 1, -1, -1):
            above = top[self.parent[i]] if self.parent[i] >= 0 else -1
            top[i] = above if above >= 0 else (i if self.chosen[i] else -1)
        return top


def _merge(group: pd.DataFrame, min_size: int, number: int) -> pd.DataFrame:
    """Merges one part of one round. Edges of equal weight merge at once."""
    is_node = group["v"].isna().to_numpy()
    nodes = group[is_node]
    links = group[~is_node].sort_values("weight")
    names, (ids, u, v) = _codes(
        nodes["u"].to_numpy(np.int64),
        links["u"].to_numpy(np.int64),
        links["v"].to_numpy(np.int64),
    )
    size = len(names)
    rows, mass, kids = [0] * size, [0.0] * size, [0.0] * size
    for i, r, m, k in zip(ids.tolist(), nodes["rows"], nodes["mass"], nodes["kids"], strict=True):
        rows[i], mass[i], kids[i] = int(r), float(m), float(k)
    tree = _Tree()
    open_cluster = [tree.add() if rows[i] >= min_size else -1 for i in range(size)]
    home = list(open_cluster)  # cluster in which a node joined the hierarchy
    loose = [[i] if rows[i] < min_size else [] for i in range(size)]  # nodes not yet in one
    parent = list(range(size))

    weights = links["weight"].to_numpy()
    starts = np.flatnonzero(np.r_[True, weights[1:] != weights[:-1]]) if len(weights) else []
    stops = np.r_[starts[1:], len(weights)] if len(weights) else []
    u, v = u.tolist(), v.tolist()
    for start, stop in zip(starts, stops, strict=True):
        weight = float(weights[start])
        groups: dict[int, list[int]] = {}
        for j in range(start, stop):
            a, b = _find(parent, u[j]), _find(parent, v[j])
            if a == b:
                continue
            left, right = groups.pop(a, [a]), groups.pop(b, [b])
            if len(left) < len(right):
                a, b, left, right = b, a, right, left
            parent[b] = a
            left.extend(right)
            groups[a] = left
        for root, members in groups.items():
            total = sum(rows[m] for m in members)
            large = [m for m in members if rows[m] >= min_size]
            joining: list[int] = []
            if total < min_size:
                for m in members:
                    joining += loose[m]
                    loose[m] = []
                rows[root], loose[root] = total, joining
                continue
            small_rows = total - sum(rows[m] for m in large)
            if len(large) == 1:
                cluster, new_mass = open_cluster[large[0]], mass[large[0]] + small_rows / weight
                new_kids = kids[large[0]]
            else:
                cluster, new_mass, new_kids = tree.add(), total / weight, 0.0
                for m in large:
                    excess = mass[m] - rows[m] / weight
                    wins = excess >= kids[m]
                    tree.close(open_cluster[m], cluster, wins)
                    new_kids += excess if wins else kids[m]
            for m in members:
                for node in loose[m]:
                    home[node] = cluster
                loose[m] = []
            rows[root], mass[root], kids[root] = total, new_mass, new_kids
            open_cluster[root] = cluster
    top = tree.standing()
    name = f"{number}:{group['part'].iloc[0]}:"
    comp = [_find(parent, i) for i in range(size)]
    label = [top[h] if h >= 0 else -1 for h in home]
    return pd.DataFrame(
        {
            "station_key": group["station_key"].iloc[0],
            "node": names,
            "comp": names[comp],
            "cluster": [f"{name}{c}" if c >= 0 else None for c in label],
            "rows": [rows[c] for c in comp],
            "mass": [mass[c] for c in comp],
            "kids": [kids[c] for c in comp],
        }
    )


def _labels(points: DataFrame, steps: list[DataFrame]) -> DataFrame:
    """Follows each point through the rounds, from the last, small one back to the first: a
    later round's cluster stands above an earlier one's."""
    key = ["station_key", "node"]

    def back(later: DataFrame, step: DataFrame) -> DataFrame:
        over = later.select("station_key", F.col("node").alias("comp"), F.col("cluster").alias("over"))
        via = step.join(over, ["station_key", "comp"], "left").select(
            *key, F.coalesce("over", "cluster").alias("cluster")
        )
        alone = later.join(step.select(*key), key, "left_anti").select(*via.columns)
        return written(via.unionByName(alone), "labels")

    if not steps:
        return points.select("station_key", "pid", F.lit(None).cast("string").alias("cluster")).limit(0)
    labels = reduce(back, reversed(steps[:-1]), steps[-1].select(*key, "cluster"))
    named = labels.withColumnRenamed("node", "pid").filter("cluster IS NOT NULL")
    return points.select("station_key", "pid").join(named, ["station_key", "pid"])
