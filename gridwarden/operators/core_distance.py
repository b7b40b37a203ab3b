"""Core distance of every point: the angle to its k-th nearest other row of the station.

Search cells are paired top-down. A search cell keeps only the partner cells that can hold one
of its k nearest rows: those nearer than the smallest radius known to hold k + 1 rows (the
point itself among them). Pairs of small cells end up in one task each search cell, a few
hundred points against a few thousand.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridwarden.operators import quadtree as qt
from gridwarden.session import spread, written

LEAF = 128  # points of a final cell, called a tile
CANDIDATES = 20_000  # points one search cell may meet; beyond, it is searched point by point

SMALL = f"n <= greatest({LEAF}, k + 1)"  # a tile, or a cell inside one

UNIT = ["station_key", "ux", "uy", "up"]


def core_distances(points: DataFrame) -> DataFrame:
    """Adds `core` and the tile's key (kx, ky) to the points."""
    table = qt.cells(points, [])
    done = F.expr(SMALL)
    kids = qt.as_children(table, done)
    leafed = written(qt.place(points, table, done), "leafed")

    root = kids.filter("cell.kx = 0").select(
        "station_key",
        F.col("cell").alias("a"),
        F.col("cell").alias("b"),
        F.lit(float("inf")).alias("reach"),
    )
    finals: list[DataFrame] = []
    pairs = written(root, "search")
    while True:
        ends, pairs = _split_final(pairs)
        finals.append(ends)
        if pairs.isEmpty():
            break
        opened = qt.open_side(qt.open_side(pairs, "a", kids, "done"), "b", kids, "done")
        pairs = written(_prune(opened, "a.kx", "a.ky"), "search")
    found = finals[0]
    for more in finals[1:]:
        found = found.unionByName(more)
    return written(_measure(written(found, "partners"), leafed), "cores")


def _split_final(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A search cell is final once it and all its partners are small."""
    busy = F.max((~F.col("a.done") | ~F.col("b.done")).cast("int"))
    marked = pairs.withColumn("busy", busy.over(qt.window_of("a.kx", "a.ky")))
    return marked.filter("busy = 0").drop("busy"), marked.filter("busy = 1").drop("busy")


def _prune(pairs: DataFrame, *search: str) -> DataFrame:
    enough = F.when(F.col("b.w") > F.col("b.k"), qt.farthest("a", "b") * (1 + qt.SLACK))
    best = F.min(enough).over(qt.window_of(*search))
    reach = F.least(F.col("reach"), F.coalesce(best, F.lit(float("inf"))))
    near = qt.nearest("a", "b") * (1 - qt.SLACK)
    return pairs.withColumn("reach", reach).filter(near <= F.col("reach"))


def _measure(partners: DataFrame, leafed: DataFrame) -> DataFrame:
    load = F.sum("b.n").over(qt.window_of("a.kx", "a.ky"))
    sized = partners.withColumn("load", load)
    light = sized.filter(F.col("load") <= CANDIDATES).select(
        "station_key",
        F.col("a.kx").alias("ux"),
        F.col("a.ky").alias("uy"),
        F.lit(-1).cast("bigint").alias("up"),
        F.col("b.kx").alias("kx"),
        F.col("b.ky").alias("ky"),
    )
    # a wide sparse cell beside a dense area: search for each of its points alone
    one = F.struct(
        F.col("pid"),
        *[F.col(s).alias(d) for s, d in
          [("lat", "la0"), ("lat", "la1"), ("lon", "lo0"), ("lon", "lo1"), ("c", "c0"), ("c", "c1")]],
    )
    heavy = sized.filter(F.col("load") > CANDIDATES).withColumns(
        {"kx": F.col("a.kx"), "ky": F.col("a.ky")}
    )
    single = heavy.drop("a", "load").join(
        leafed.select(*qt.CELL, one.alias("a")), qt.CELL
    )
    alone = _prune(single, "a.pid").select(
        "station_key",
        F.col("kx").alias("ux"),
        F.col("ky").alias("uy"),
        F.col("a.pid").alias("up"),
        F.col("b.kx").alias("kx"),
        F.col("b.ky").alias("ky"),
    )
    tasks = written(light.unionByName(alone), "tasks")

    members = leafed.select(*qt.CELL, "pid", "lat", "lon", "c", "w", "k")
    candidates = tasks.join(members, qt.CELL).select(
        *UNIT, F.lit(False).alias("ask"), "pid", "lat", "lon", "c", "w", "k"
    )
    units = tasks.select(*UNIT).distinct().withColumns({"kx": F.col("ux"), "ky": F.col("uy")})
    asking = (
        units.join(members, qt.CELL)
        .filter((F.col("up") == -1) | (F.col("up") == F.col("pid")))
        .select(*UNIT, F.lit(True).alias("ask"), "pid", "lat", "lon", "c", "w", "k")
    )
    cores = (
        spread(asking.unionByName(candidates), *UNIT)
        .groupBy(*UNIT)
        .applyInArrow(_kth_neighbour, "pid bigint, core double")
    )
    return leafed.join(cores, "pid")


def angles(lat1, lon1, c1, lat2, lon2, c2) -> np.ndarray:
    """Great-circle angles between all of the first and all of the second points."""
    s_lat = np.sin((lat1[:, None] - lat2[None, :]) / 2)
    s_lon = np.sin((lon1[:, None] - lon2[None, :]) / 2)
    h = s_lat * s_lat + c1[:, None] * c2[None, :] * (s_lon * s_lon)
    return 2.0 * np.arcsin(np.sqrt(np.minimum(1.0, h)))


def _kth_neighbour(group: pa.Table) -> pa.Table:
    q, c = group.filter(group["ask"]), group.filter(pc.invert(group["ask"]))
    angle = angles(*(q[x].to_numpy() for x in ("lat", "lon", "c")),
                   *(c[x].to_numpy() for x in ("lat", "lon", "c")))
    # every point holds at least one row, so the k + 1 nearest points are enough
    k = q["k"].to_numpy()
    some = min(int(k[0]) + 1, angle.shape[1])
    near = np.argpartition(angle, some - 1, axis=1)[:, :some]
    order = np.argsort(np.take_along_axis(angle, near, axis=1), axis=1, kind="stable")
    near = np.take_along_axis(near, order, axis=1)
    rows = np.cumsum(c["w"].to_numpy()[near], axis=1)
    place = np.argmax(rows > k[:, None], axis=1)
    kth = np.take_along_axis(near, place[:, None], axis=1)
    core = np.take_along_axis(angle, kth, axis=1)[:, 0]
    return pa.table({"pid": q["pid"].to_numpy(), "core": np.rint(core * 1e14) / 1e14})
