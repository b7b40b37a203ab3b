"""Distinct coordinates of each station and the cells that hold them.

Cells form a quadtree over the geofence, two levels a step, so a cell has at most 16 children.
Every cell carries a tight box; `nearest` and `farthest` bound the great-circle angle between
any point of one cell and any point of another, and are exact for single points.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridwarden.config import Settings
from gridwarden.functions.geo import haversine
from gridwarden.session import written

BITS = 40  # finest cells are far below 1e-9 degrees on any geofence
STEP = 2
COARSE = 20  # levels up to here are built for all points, finer ones for crowded cells only
CELL = ["station_key", "kx", "ky"]
SLACK = 1e-12  # keeps rounded bounds on the safe side


def grid(c: Column, low: float, high: float) -> Column:
    """Position on the finest grid. A coordinate outside is an error: clean rows have none, and
    moving it to the edge would merge different places."""
    top = F.lit(2.0**BITS)
    position = F.floor((c - low) / (high - low) * top).cast("bigint")
    inside = F.least(F.lit(2**BITS - 1), position)  # the upper edge itself belongs to the grid
    outside = F.raise_error(F.concat(F.lit("coordinate outside the geofence: "), c.cast("string")))
    return F.when(c.between(low, high), inside).otherwise(outside.cast("bigint"))


def coordinate_key(settings: Settings) -> dict[str, Column]:
    """Coordinates are told apart at 1e-9 degrees, a tenth of a millimetre."""
    lat, lon = F.round("latitude", 9), F.round("longitude", 9)
    return {
        "x": grid(lat, settings.lat_min, settings.lat_max),
        "y": grid(lon, settings.lon_min, settings.lon_max),
    }


def distinct_points(clean: DataFrame, settings: Settings) -> DataFrame:
    """One row per station and coordinate, with its row count `w` and smallest id.

    Stations below min_cluster_size rows are left out: all their rows are noise. `k` is the
    neighbour count of the core distance, at most all other rows of the station.
    """
    k = settings.min_samples or settings.min_cluster_size
    merged = (
        clean.withColumns(coordinate_key(settings))
        .groupBy("station_key", "x", "y")
        .agg(
            F.count("*").alias("w"),
            F.min("id").alias("first_id"),
            F.min(F.radians(F.round("latitude", 9))).alias("lat"),
            F.min(F.radians(F.round("longitude", 9))).alias("lon"),
        )
        .withColumns({"c": F.cos("lat"), "pid": F.monotonically_increasing_id()})
    )
    points = written(merged, "points")
    # one row per station
    sizes = points.groupBy("station_key").agg(F.sum("w").alias("size"))
    kept = sizes.filter(F.col("size") >= settings.min_cluster_size).select(
        "station_key", F.greatest(F.lit(1), F.least(F.lit(k), F.col("size") - 1)).alias("k")
    )
    return written(points.join(kept, "station_key"), "points")


def cell_key(level: Column) -> tuple[Column, Column]:
    """Level and position packed into two numbers."""
    shift = (F.lit(BITS) - level).cast("int")
    kx = F.call_function("shiftright", F.col("x"), shift) * 64 + level
    return kx.cast("bigint"), F.call_function("shiftright", F.col("y"), shift)


def _at_levels(points: DataFrame, first: int, last: int) -> DataFrame:
    levels = F.explode(F.sequence(F.lit(first), F.lit(last), F.lit(STEP)))
    kx, ky = cell_key(F.col("level"))
    return points.withColumn("level", levels).withColumns({"kx": kx, "ky": ky})


def parent_key() -> dict[str, Column]:
    level = F.col("kx") % 64
    return {
        "px": F.call_function("shiftright", F.col("kx"), F.lit(6 + STEP)) * 64 + level - STEP,
        "py": F.call_function("shiftright", F.col("ky"), F.lit(STEP)),
    }


def cells(points: DataFrame, extra: list[Column]) -> DataFrame:
    """All cells with box, point count n, row count w, and the `extra` aggregates.

    Cells are counted map-side first. Only points that still share a cell at the coarse limit
    are carried to the finer levels."""
    box = [
        F.count("*").alias("n"),
        F.sum("w").alias("w"),
        F.min("k").alias("k"),
        F.min("lat").alias("la0"),
        F.max("lat").alias("la1"),
        F.min("lon").alias("lo0"),
        F.max("lon").alias("lo1"),
        F.min("c").alias("c0"),
        F.max("c").alias("c1"),
        *extra,
    ]
    coarse = written(_at_levels(points, 0, COARSE).groupBy(*CELL).agg(*box), "cells")
    crowded = coarse.filter(f"kx % 64 = {COARSE} AND n > 1").select(*CELL)
    if crowded.isEmpty():
        return coarse.withColumns(parent_key())
    inside = _at_levels(points, COARSE, COARSE).join(crowded, CELL, "left_semi")
    fine = _at_levels(inside.select(*points.columns), COARSE + STEP, BITS).groupBy(*CELL).agg(*box)
    return written(coarse.unionByName(fine), "cells").withColumns(parent_key())


def place(points: DataFrame, cell_table: DataFrame, stop: Column) -> DataFrame:
    """Each point with its final cell: the coarsest one for which `stop` holds."""
    ends = cell_table.filter(stop).select(*CELL)
    parents = cell_table.filter(~stop).select(
        "station_key", F.col("kx").alias("px"), F.col("ky").alias("py")
    )
    roots = ends.filter("kx % 64 = 0")
    inner = ends.withColumns(parent_key()).join(
        parents, ["station_key", "px", "py"], "left_semi"
    )
    final = roots.unionByName(inner.select(*CELL))
    deepest = final.agg(F.max(F.col("kx") % 64)).first()[0] or 0
    return _at_levels(points, 0, deepest).join(final, CELL).drop("level")


def nearest(a: str, b: str) -> Column:
    """Lower bound of the angle between points of the cells in struct columns a and b."""
    zero = F.lit(0.0)
    lat = F.greatest(zero, F.col(f"{a}.la0") - F.col(f"{b}.la1"), F.col(f"{b}.la0") - F.col(f"{a}.la1"))
    lon = F.greatest(zero, F.col(f"{a}.lo0") - F.col(f"{b}.lo1"), F.col(f"{b}.lo0") - F.col(f"{a}.lo1"))
    return haversine(lat, lon, F.col(f"{a}.c0") * F.col(f"{b}.c0"))


def farthest(a: str, b: str) -> Column:
    """Upper bound of the same; with a = b a bound of the cell's diameter."""
    lat = F.greatest(F.col(f"{a}.la1") - F.col(f"{b}.la0"), F.col(f"{b}.la1") - F.col(f"{a}.la0"))
    lon = F.greatest(F.col(f"{a}.lo1") - F.col(f"{b}.lo0"), F.col(f"{b}.lo1") - F.col(f"{a}.lo0"))
    return haversine(lat, lon, F.col(f"{a}.c1") * F.col(f"{b}.c1"))


def open_side(pairs: DataFrame, side: str, kids: DataFrame, done: str) -> DataFrame:
    """Replaces the cell in struct column `side` by its children unless `done` holds.

    An equi-join on the parent key: a cell has at most 16 children, and occurs in few pairs."""
    stay = pairs.filter(f"{side}.{done}")
    split = pairs.filter(f"NOT {side}.{done}").withColumns(
        {"px": F.col(f"{side}.kx"), "py": F.col(f"{side}.ky")}
    )
    opened = split.drop(side).join(
        kids.withColumnRenamed("cell", side), ["station_key", "px", "py"]
    )
    return stay.select(*pairs.columns).unionByName(opened.select(*pairs.columns))


def as_children(cell_table: DataFrame, done: Column) -> DataFrame:
    """(station, parent, cell struct with a `done` flag)."""
    fields = [c for c in cell_table.columns if c not in ("station_key", "px", "py")]
    return cell_table.withColumn("done", done).select(
        "station_key", "px", "py", F.struct(*fields, "done").alias("cell")
    )


def window_of(*columns: str):
    return Window.partitionBy("station_key", *columns)
