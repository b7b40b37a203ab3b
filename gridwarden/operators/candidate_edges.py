"""Sparse edges that contain a minimum spanning tree of the mutual reachability graph.

The weight of two points is the largest of their core distances and their own distance. Tiles,
cells of at most a hundred or so points, get their own spanning tree first; the heaviest edge
of that tree is the tile's `width`. A coarser cell's width is its diameter. In both cases the
points of a cell hang together by links no heavier than its width.

Pairs of cells are then opened top-down until a pair is apart: neither width exceeds the least
possible weight between the two. One lightest edge is enough for such a pair. For two points
p, q of it and its lightest edge p*, q*: p and p* hang together by links no heavier than (p, q),
so do q and q*; by induction over smaller cells the chosen edges join p and q at the weight of
(p, q). Two tiles that are not apart give the cross edges of their joint spanning tree.

Most pairs that are apart hold no edge of a spanning tree: the edges of touching tiles, found
first, already join their cells at less than the pair's least possible weight. `_unjoined` drops
these. For p, q of such a pair and the points r, s of least core distance of its cells: p and r
hang together by links no heavier than (p, q) inside a smaller cell, so do q and s, and r and s by
lighter ones; by induction over weights, and over cells at equal weight, nothing is lost.

Every pair of points falls into exactly one pair of cells, and the number of pairs grows with
the number of tiles, not with its square. No task sees more than a tile and a bounded share of
the tiles it is paired with.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridwarden.operators import quadtree as qt
from gridwarden.operators.components import ONE_TASK, components, least_labels
from gridwarden.operators.core_distance import CANDIDATES, SMALL, angles
from gridwarden.session import broadcast_if_small, spread, written

PAIR = ["rax", "ray", "rbx", "rby"]
EDGE = "station_key string, u bigint, v bigint, weight double"
POINT = ["pid", "lat", "lon", "c", "core"]
HEIGHTS = 32  # weights at which joined tiles are looked up
ROUNDING = 1e-14  # of weights
SMALL_TABLE = 200_000  # tiles whose labels may be broadcast


def candidate_edges(points: DataFrame) -> DataFrame:
    """(station_key, u, v, weight) over point ids. `points` carry core and tile key."""
    inner = written(
        spread(points, *qt.CELL)
        .groupBy(*qt.CELL)
        .applyInArrow(_tile_tree, f"{EDGE}, kx bigint, ky bigint"),
        "tile-trees",
    )
    tile = F.min("pid").over(qt.window_of("kx", "ky"))
    kids = written(_cells_with_width(points.withColumn("tile", tile), inner), "children")
    pairs = _siblings(kids)
    apart: list[DataFrame] = []
    near: list[DataFrame] = []
    while True:
        pairs = written(_judged(pairs), "pairs")
        apart.append(pairs.filter("apart").drop("apart"))
        touching = pairs.filter("NOT apart").drop("apart")
        near.append(touching.filter("a.done AND b.done"))
        rest = touching.filter("NOT (a.done AND b.done)")
        if rest.isEmpty():
            break
        pairs = qt.open_side(qt.open_side(rest, "a", kids, "done"), "b", kids, "done")
    cross = _compare(written(_keys(_rooted(_union(near)), True), "tile-pairs"), points)
    tiles = _tiles(points, inner)
    joints = _tile_edges(cross, tiles)
    far = written(_unjoined(_union(apart), joints), "far")
    # the pairs that are left join cells as well, at no more than their largest possible weight
    far = _unjoined(far, written(joints.unionByName(_routes(far, tiles)), "routes"))
    closest = _compare(written(_keys(_closest_tiles(far, kids), False), "tile-pairs"), points)
    edge = ["station_key", "u", "v", "weight"]
    return written(_union([x.select(*edge) for x in (inner, cross, closest)]), "edges")


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for more in tables[1:]:
        out = out.unionByName(more)
    return out


def _cells_with_width(points: DataFrame, inner: DataFrame) -> DataFrame:
    """Cells as children of their parents, with least core and its tile, width, and the tile flag."""
    least = [F.min("core").alias("core"), F.min_by("tile", "core").alias("tile")]
    table = qt.cells(points.drop("kx", "ky"), least)
    links = inner.groupBy(*qt.CELL).agg(F.max("weight").alias("link"))
    boxed = table.join(links, qt.CELL, "left").withColumn(
        "box", F.struct("la0", "la1", "lo0", "lo1", "c0", "c1")
    )
    diameter = qt.farthest("box", "box") * (1 + qt.SLACK)
    done = F.expr(SMALL)
    tile_width = F.least(diameter, F.coalesce("link", F.lit(0.0)))
    wide = boxed.withColumn("width", F.when(done, tile_width).otherwise(diameter))
    return qt.as_children(wide.drop("box", "link"), done)


def _siblings(kids: DataFrame) -> DataFrame:
    """Pairs of children of the same opened cell, at most 120 for each parent."""
    opened = kids.filter("NOT cell.done").select(
        "station_key", F.col("cell.kx").alias("tx"), F.col("cell.ky").alias("ty")
    )
    # cells inside a tile have no opened parent and stay out
    inside = kids.filter("cell.kx % 64 > 0").join(
        opened.select("station_key", F.col("tx").alias("px"), F.col("ty").alias("py")),
        ["station_key", "px", "py"],
        "left_semi",
    )
    left = inside.withColumnRenamed("cell", "a")
    right = inside.withColumnRenamed("cell", "b")
    pairs = left.join(right, ["station_key", "px", "py"]).filter(
        "a.kx < b.kx OR (a.kx = b.kx AND a.ky < b.ky)"
    )
    return pairs.select("station_key", "a", "b")


def _least() -> Column:
    """No pair of points of cells a and b weighs less."""
    return F.greatest(qt.nearest("a", "b") * (1 - qt.SLACK), F.col("a.core"), F.col("b.core"))


def _judged(pairs: DataFrame) -> DataFrame:
    """Marks the pairs that are apart."""
    return pairs.withColumn("apart", F.greatest("a.width", "b.width") <= _least())


def _tiles(points: DataFrame, inner: DataFrame) -> DataFrame:
    """Tiles with their name, the least point, and the weight at which all their points hang
    together."""
    links = inner.groupBy(*qt.CELL).agg(F.max("weight").alias("link"))
    tiles = points.groupBy(*qt.CELL).agg(F.min("pid").alias("tile"))
    return written(tiles.join(links, qt.CELL, "left").fillna(0.0, ["link"]), "tiles")


def _tile_edges(cross: DataFrame, tiles: DataFrame) -> DataFrame:
    """(u, v, weight): touching tiles, and a weight at which all points of both hang together."""
    pairs = cross.groupBy("station_key", *PAIR).agg(F.min("weight").alias("weight"))
    for side, end in (("a", "u"), ("b", "v")):
        names = {"kx": f"r{side}x", "ky": f"r{side}y", "tile": end, "link": f"link_{end}"}
        pairs = pairs.join(tiles.withColumnsRenamed(names), ["station_key", f"r{side}x", f"r{side}y"])
    return written(pairs.select("u", "v", F.greatest("weight", "link_u", "link_v").alias("weight")), "tile-edges")


def _routes(far: DataFrame, tiles: DataFrame) -> DataFrame:
    """The same for the tiles of least core distance of pairs of cells: the two points of least
    core distance weigh no more than this."""
    most = F.greatest(qt.farthest("a", "b") * (1 + qt.SLACK), F.col("a.core"), F.col("b.core")) + ROUNDING
    pairs = far.select(F.col("a.tile").alias("u"), F.col("b.tile").alias("v"), most.alias("weight"))
    for end in ("u", "v"):
        pairs = pairs.join(tiles.select(F.col("tile").alias(end), F.col("link").alias(f"link_{end}")), end)
    return pairs.select("u", "v", F.greatest("weight", "link_u", "link_v").alias("weight"))


def joined_at(edges: DataFrame, heights: list[float], one_task: int = ONE_TASK) -> DataFrame:
    """(node, labels): for each of the rising heights, the component of edges up to it; a node
    without such an edge is its own. Few edges are solved in one task, more are contracted height
    by height."""

    def solve(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = list(parts)
        if not held:
            return
        u, v, weight = (pd.concat(held)[c].to_numpy() for c in ("u", "v", "weight"))
        nodes = np.unique(np.concatenate([u, v]))
        labels = np.tile(nodes, (len(heights), 1))
        for row, height in zip(labels, heights, strict=True):
            found, label = least_labels(u[weight <= height], v[weight <= height])
            row[np.searchsorted(nodes, found)] = label
        yield pd.DataFrame({"node": nodes, "labels": list(labels.T)})

    if edges.count() <= one_task:
        return written(edges.coalesce(1).mapInPandas(solve, "node bigint, labels array<bigint>"), "joined")
    nodes = edges.selectExpr("explode(array(u, v)) AS node").distinct()
    at = nodes.select("node", F.array().cast("array<bigint>").alias("labels"), F.col("node").alias("last"))
    left = edges
    for height in heights:
        found = components(left.where(F.col("weight") <= height))
        here = found.select(F.col("node").alias("last"), F.col("component").alias("now"))
        now = at.join(here, "last", "left").select("node", "labels", F.coalesce("now", "last").alias("last"))
        at = written(now.withColumn("labels", F.concat("labels", F.array("last"))), "joined")
        for end in ("u", "v"):
            names = found.select(F.col("node").alias(end), "component")
            left = left.join(names, end, "left").withColumn(end, F.coalesce("component", end)).drop("component")
        left = left.where("u <> v").groupBy(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
        left = written(left.agg(F.min("weight").alias("weight")), "left")
    return at.select("node", "labels")


def _unjoined(apart: DataFrame, tile_edges: DataFrame) -> DataFrame:
    """Without the pairs whose cells hang together by edges lighter than any of theirs."""
    low, high = tile_edges.agg(F.min(F.nullif("weight", F.lit(0.0))), F.max("weight")).first()
    if not high:
        return apart
    heights = sorted({*np.geomspace(low, high, HEIGHTS).tolist(), high})
    labels = broadcast_if_small(joined_at(tile_edges, heights), SMALL_TABLE)
    # of the heights below the pair, counted from 1, the last one
    below = F.array_size(F.filter(F.array(*map(F.lit, heights)), lambda h: h < F.col("least")))
    pairs = apart.withColumn("least", _least() - ROUNDING)
    pairs = pairs.withColumns({"below": below, "tile_a": F.col("a.tile"), "tile_b": F.col("b.tile")})
    for side in ("a", "b"):
        names = labels.select(F.col("node").alias(f"tile_{side}"), F.col("labels").alias(f"at_{side}"))
        pairs = pairs.join(names, f"tile_{side}", "left")
        own = F.when(F.col("below") > 0, F.try_element_at(f"at_{side}", "below"))
        pairs = pairs.withColumn(f"at_{side}", F.coalesce(own, F.col(f"tile_{side}")))
    return pairs.where("at_a <> at_b").select(*apart.columns)


def _rooted(pairs: DataFrame) -> DataFrame:
    """The pair's own key, kept while its sides are opened further."""
    keys = {f"r{s}{x}": F.col(f"{s}.k{x}") for s in ("a", "b") for x in ("x", "y")}
    return pairs.withColumns(keys)


def _closest_tiles(apart: DataFrame, kids: DataFrame) -> DataFrame:
    """Opens both sides of each pair down to tiles, and keeps the pairs of tiles that may hold
    its lightest edge."""
    state = _rooted(apart)
    ready: list[DataFrame] = []
    while True:
        state = written(_bounded(state), "closest")
        ready.append(state.filter("settled").drop("settled"))
        rest = state.filter("NOT settled").drop("settled")
        if rest.isEmpty():
            return _union(ready)
        state = qt.open_side(qt.open_side(rest, "a", kids, "done"), "b", kids, "done")


def _bounded(state: DataFrame) -> DataFrame:
    """Drops partial pairs that cannot beat the best upper bound of their pair; a pair is
    settled when all its partial pairs are tiles."""
    pair = qt.window_of(*PAIR)
    cores = F.greatest("a.core", "b.core")
    low = F.greatest(qt.nearest("a", "b") * (1 - qt.SLACK), cores)
    high = F.greatest(qt.farthest("a", "b") * (1 + qt.SLACK), cores)
    tiles = (F.col("a.done") & F.col("b.done")).cast("int")
    return (
        state.withColumns({"low": low, "best": F.min(high).over(pair)})
        .filter("low <= best")
        .drop("low", "best")
        .withColumn("settled", F.min(tiles).over(pair) == 1)
    )


def _keys(pairs: DataFrame, near: bool) -> DataFrame:
    return pairs.select(
        "station_key", *PAIR, F.lit(near).alias("near"),
        F.col("a.kx").alias("kx"), F.col("a.ky").alias("ky"),
        F.col("b.kx").alias("bx"), F.col("b.ky").alias("by"), F.col("b.n").alias("n"),
    )


def _compare(tile_pairs: DataFrame, points: DataFrame) -> DataFrame:
    """Edges between tiles: one task group per tile and share of its partners."""
    load = F.sum("n").over(qt.window_of("kx", "ky"))
    shares = F.ceil(load / CANDIDATES)
    split = written(
        tile_pairs.withColumn("share", F.pmod(F.hash("bx", "by"), shares).cast("bigint")), "tasks"
    )
    unit = ["station_key", "kx", "ky", "share"]
    partner = points.select(
        "station_key", F.col("kx").alias("bx"), F.col("ky").alias("by"), *POINT
    )
    theirs = split.drop("n").join(partner, ["station_key", "bx", "by"])
    own = split.select(*unit).distinct().join(points.select(*qt.CELL, *POINT), qt.CELL)
    blank = {c: F.lit(None).cast("bigint") for c in (*PAIR, "bx", "by")}
    mine = own.withColumns({**blank, "near": F.lit(None).cast("boolean")})
    found = (
        spread(mine.unionByName(theirs), *unit)
        .groupBy(*unit)
        .applyInArrow(_cross_edges, f"{EDGE}, near boolean, " + ", ".join(f"{c} bigint" for c in PAIR))
    )
    found = written(found, "found")  # both kinds below read it
    edge = F.struct("weight", "u", "v")
    single = found.filter("NOT near").groupBy("station_key", *PAIR).agg(F.min(edge).alias("e"))
    kept = ["station_key", *PAIR, "u", "v", "weight"]
    return (
        found.filter("near")
        .select(*kept)
        .unionByName(single.select("station_key", *PAIR, "e.*").select(*kept))
    )


def _columns(points: pa.Table) -> list[np.ndarray]:
    return [points[c].to_numpy() for c in POINT]


def _weights(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Mutual reachability of all points of a with all points of b."""
    angle = angles(*a[1:4], *b[1:4])
    both = np.maximum(a[4][:, None], b[4][None, :])
    return np.rint(np.maximum(angle, both) * 1e14) / 1e14


def _spanning_tree(weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Minimum spanning tree of a small full matrix: every part takes its first edge in the
    order of weights, until there is one part."""
    n = len(weights)
    u, v = np.triu_indices(n, 1)
    order = np.argsort(weights[u, v], kind="stable")
    u, v = u[order], v[order]
    part = np.arange(n)
    ends: list[np.ndarray] = [np.empty((2, 0), dtype=np.int64)]
    while len(u):
        a, b = part[u], part[v]
        first = np.full((2, n), len(u))
        back = np.arange(len(u))[::-1]  # of several values the last one stays
        first[0, a[::-1]], first[1, b[::-1]] = back, back
        first = first.min(axis=0)
        first = np.unique(first[first < len(u)])
        ends.append(np.stack([u[first], v[first]]))
        nodes, least = least_labels(a[first], b[first])
        joined = np.arange(n)
        joined[nodes] = least
        part = joined[part]
        open_ = part[u] != part[v]
        u, v = u[open_], v[open_]
    tree = np.concatenate(ends, axis=1)
    return tree[0], tree[1]


def _tile_tree(tile: pa.Table) -> pa.Table:
    points = _columns(tile)
    weights = _weights(points, points)
    u, v = _spanning_tree(weights)
    edges = {"u": points[0][u], "v": points[0][v], "weight": weights[u, v]}
    key = {c: pa.repeat(tile[c][0], len(u)) for c in qt.CELL}
    return pa.table({"station_key": key["station_key"], **edges, "kx": key["kx"], "ky": key["ky"]})


def _cross_edges(group: pa.Table) -> pa.Table:
    """Edges of one tile to its partners: all partners that are apart in one matrix, touching
    ones through a joint spanning tree each."""
    own = pc.is_null(group["near"])
    mine = _columns(group.filter(own))
    others = group.filter(pc.invert(own))
    others = others.take(pc.sort_indices(others, [(c, "ascending") for c in ("near", "bx", "by")]))
    near = others["near"].to_numpy().astype(bool)
    tile = np.stack([near.astype(np.int64), others["bx"].to_numpy(), others["by"].to_numpy()], axis=1)
    starts = np.flatnonzero(np.r_[True, (tile[1:] != tile[:-1]).any(axis=1)])
    theirs = _columns(others)
    n_apart = int((~near).sum())
    found = [_lightest([c[:n_apart] for c in theirs], starts[starts < n_apart], mine)]
    n, within = len(mine[0]), None
    for start, stop in zip(starts, np.r_[starts[1:], len(tile)], strict=True):
        if start < n_apart:
            continue
        other = [c[start:stop] for c in theirs]
        between = _weights(mine, other)
        within = _weights(mine, mine) if within is None else within
        joint = np.block([[within, between], [between.T, _weights(other, other)]])
        u, v = _spanning_tree(joint)
        cross = (u < n) != (v < n)
        u, v = np.minimum(u, v)[cross], np.maximum(u, v)[cross] - n
        found.append((u, v + start, between[u, v]))
    u, v, weight = (np.concatenate(x) for x in zip(*found, strict=True))
    pair = others.select(PAIR).take(pa.array(v))
    return pa.table(
        {"station_key": pa.repeat(group["station_key"][0], len(u)), "u": mine[0][u], "v": theirs[0][v],
         "weight": weight, "near": near[v], **{c: pair[c] for c in PAIR}}
    )


def _lightest(
    theirs: list[np.ndarray], starts: np.ndarray, mine: list[np.ndarray]
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One lightest edge to each partner; partners lie end to end from `starts`."""
    if not len(starts):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    between = _weights(mine, theirs)
    u = between.argmin(axis=0)
    weight = between[u, np.arange(between.shape[1])]
    least = np.minimum.reduceat(weight, starts)
    partner = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(weight)]))
    hits = np.flatnonzero(weight == least[partner])
    v = hits[np.unique(partner[hits], return_index=True)[1]]
    return u[v], v, weight[v]
