"""Regularised regression trees, boosted on a histogram of binned features.

A tree sees bins only, so rows of equal bins have equal predictions, and equal gradients, at every
step of the boosting. One aggregation of the training rows to (bins, rows, sum, sum of squares)
therefore holds all that any tree needs: the gradient sums of every open node and split are sums
over its cells. That table has at most one row for each combination of bins (256 x 7 x 24 for the
forecast), whatever the number of rows, labels or weeks, so the trees grow in one task without a
Spark job a level, and the fitted model is a table of one prediction a combination: scoring is a
broadcast join with a table of that bound.

Splits maximise the second-order gain with an L2 term; both sides must hold a least number of
rows. A split must also lower the squared error by more than Akaike's criterion asks of one more
parameter, twice the mean squared error of the moment, so that trees stop at what the rows
support: without it two hundred trees follow the noise of a short history.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import prod

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridwarden.session import written

NODE_SCHEMA = "tree int, node int, feature string, upper int, n_rows double, gain double, value double"
LEAST_GAIN = 1e-6


@dataclass(frozen=True)
class Axis:
    """A feature with values 0..labels-1, dealt to `bins` bins of consecutive values."""

    name: str
    labels: int
    bins: int

    def bin_of(self) -> Column:
        """Values beyond the range fall into the bins at its ends; null stays null."""
        value = F.least(F.greatest(F.col(self.name), F.lit(0)), F.lit(self.labels - 1)).cast("bigint")
        return F.when(F.col(self.name).isNotNull(), F.floor(value * self.bins / self.labels).cast("int"))


@dataclass(frozen=True)
class Growth:
    trees: int
    rate: float
    depth: int
    l2: float
    least_rows: float
    penalty: float  # times Akaike's criterion; 0 for none


def histogram(rows: DataFrame, axes: list[Axis], label: str) -> DataFrame:
    """One row a combination of bins: the bins, n_rows, total, squares."""
    y = F.col(label).cast("double")
    return rows.groupBy(*[a.bin_of().alias(a.name) for a in axes]).agg(
        F.count("*").cast("double").alias("n_rows"), F.sum(y).alias("total"), F.sum(y * y).alias("squares")
    )


def grow(cells: pd.DataFrame, axes: list[Axis], how: Growth) -> pd.DataFrame:
    """The nodes of all trees. Node 1 is a root, 2 i and 2 i + 1 are the sides of node i; a row
    goes to the first if its bin is at most `upper`. Leaves have no feature. Tree -1 is the mean.

    Equal gains: the first feature, then the lowest bin."""
    places = [cells[a.name].to_numpy(np.int64) for a in axes]
    n, total = cells["n_rows"].to_numpy(), cells["total"].to_numpy()
    rows, squares = n.sum(), cells["squares"].sum()
    mean = total.sum() / rows
    guess = np.full(len(n), mean)
    out = [(-1, 1, None, None, rows, None, mean)]
    for tree in range(how.trees):
        gradient = n * guess - total
        error = squares - 2 * (guess * total).sum() + (guess * guess * n).sum()
        price = how.penalty * max(0.0, error / rows)
        at = np.ones(len(n), np.int64)  # the node of every cell
        slot, nodes = np.zeros(len(n), np.int64), np.ones(1, np.int64)  # of open nodes
        for depth in range(how.depth + 1):
            open_cells = np.flatnonzero(slot >= 0)
            here = slot[open_cells]
            g = np.bincount(here, gradient[open_cells], len(nodes))
            h = np.bincount(here, n[open_cells], len(nodes))
            best = np.full(len(nodes), LEAST_GAIN)
            choice = np.full((len(nodes), 2), -1)
            for nth, axis in enumerate(axes if depth < how.depth else ()):
                cell = here * axis.bins + places[nth][open_cells]
                size = len(nodes) * axis.bins
                left_g = np.bincount(cell, gradient[open_cells], size).reshape(-1, axis.bins).cumsum(1)
                left_h = np.bincount(cell, n[open_cells], size).reshape(-1, axis.bins).cumsum(1)
                right_g, right_h = g[:, None] - left_g, h[:, None] - left_h
                gain = 0.5 * (
                    left_g**2 / (left_h + how.l2) + right_g**2 / (right_h + how.l2) - (g**2 / (h + how.l2))[:, None]
                )
                gain = np.round(gain - price, 9)  # so that the order of sums decides no tie
                gain[(left_h < how.least_rows) | (right_h < how.least_rows)] = -np.inf
                top = gain.argmax(1)
                gains = gain[np.arange(len(nodes)), top]
                better = gains > best
                best[better] = gains[better]
                choice[better] = np.stack([np.full(better.sum(), nth), top[better]], 1)
            opened = choice[:, 0] >= 0
            value = -how.rate * g / (h + how.l2)
            for k, node in enumerate(nodes.tolist()):
                feature, upper = choice[k].tolist()
                split = feature >= 0
                out.append((
                    tree, node, axes[feature].name if split else None, upper if split else None, h[k],
                    best[k] if split else None, None if split else value[k],
                ))
            closed = ~opened[here]
            guess[open_cells[closed]] += value[here[closed]]
            slot[open_cells[closed]] = -1
            if not opened.any():
                break
            going = open_cells[~closed]
            of = slot[going]
            bins = np.stack(places)[choice[of, 0], going]
            at[going] = 2 * at[going] + (bins > choice[of, 1])
            parents = nodes[opened]
            nodes = np.sort(np.concatenate([2 * parents, 2 * parents + 1]))
            slot[going] = np.searchsorted(nodes, at[going])
    return pd.DataFrame(out, columns=["tree", "node", "feature", "upper", "n_rows", "gain", "value"])


def predictions(nodes: pd.DataFrame, axes: list[Axis]) -> pd.DataFrame:
    """The prediction of every combination of bins."""
    grid = np.indices([a.bins for a in axes]).reshape(len(axes), -1)
    number = {a.name: k for k, a in enumerate(axes)}
    guess = np.zeros(grid.shape[1])
    for _, tree in nodes.sort_values(["tree", "node"]).groupby("tree"):
        at = np.ones(grid.shape[1], np.int64)
        values = np.zeros(int(tree["node"].max()) + 1)
        for node, feature, upper, value in zip(tree["node"], tree["feature"], tree["upper"], tree["value"]):
            if isinstance(feature, str):
                here = at == node
                at[here] = 2 * node + (grid[number[feature], here] > upper)
            else:
                values[node] = value
        guess += values[at]
    return pd.DataFrame({a.name: grid[k] for k, a in enumerate(axes)} | {"prediction": guess})


class Trees:
    """Fitted trees: the table of their nodes, and that of the predictions."""

    def __init__(self, nodes: DataFrame, grid: DataFrame, axes: list[Axis]):
        self.nodes, self.grid, self.axes = nodes, grid, axes

    def transform(self, rows: DataFrame) -> DataFrame:
        """Adds `prediction`; null where a feature is."""
        if prod(a.bins for a in self.axes) > 1 << 20:
            raise ValueError("too many combinations of bins for a table that is broadcast")
        names = {a.name: f"__{a.name}" for a in self.axes}
        grid = self.grid.select(*[F.col(a).alias(b) for a, b in names.items()], "prediction")
        binned = rows.withColumns({b: a.bin_of() for a, b in zip(self.axes, names.values())})
        return binned.join(F.broadcast(grid), list(names.values()), "left").drop(*names.values())

    def save(self, path: str) -> None:
        spark = self.nodes.sparkSession
        self.nodes.write.mode("overwrite").parquet(f"{path}/nodes")
        self.grid.write.mode("overwrite").parquet(f"{path}/grid")
        axes = spark.createDataFrame([(a.name, a.labels, a.bins) for a in self.axes], "name string, labels long, bins int")
        axes.withColumn("nth", F.monotonically_increasing_id()).coalesce(1).write.mode("overwrite").parquet(f"{path}/axes")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Trees:
        axes = [Axis(r["name"], r["labels"], r["bins"]) for r in spark.read.parquet(f"{path}/axes").orderBy("nth").collect()]
        return cls(spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/grid"), axes)


def fit(rows: DataFrame, axes: list[Axis], label: str, how: Growth) -> Trees:
    cells = written(histogram(rows, axes, label), "cells")

    def trees(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = list(parts)
        if held:
            yield grow(pd.concat(held), axes, how)

    def grid(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = list(parts)
        if held:
            yield predictions(pd.concat(held), axes)

    nodes = written(cells.coalesce(1).mapInPandas(trees, NODE_SCHEMA), "nodes")
    schema = ", ".join(f"{a.name} int" for a in axes) + ", prediction double"
    return Trees(nodes, written(nodes.coalesce(1).mapInPandas(grid, schema), "grid"), axes)
