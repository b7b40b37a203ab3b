"""Connected components of an edge table.

A table of at most `one_task` distinct edges, counted, is solved by one task, whose memory that
number bounds. A larger one is contracted round by round: every node takes the least label around
it, by an aggregation before the shuffle, and labels are followed to the labels of their labels,
until nothing changes. No node's neighbours are gathered.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridwarden.session import written

ONE_TASK = 1_000_000  # edges


def least_labels(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All nodes, and the least node of the component of each."""
    nodes, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = ends[: len(u)], ends[len(u) :]
    label = np.arange(len(nodes))
    while len(a):
        low, high = np.minimum(label[a], label[b]), np.maximum(label[a], label[b])
        np.minimum.at(label, high, low)
        while True:
            onward = label[label]
            if (onward == label).all():
                break
            label = onward
        open_ = label[a] != label[b]
        a, b = a[open_], b[open_]
    return nodes, nodes[label]


def _solve(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held = list(parts)
    if held:
        edges = pd.concat(held)
        nodes, labels = least_labels(edges["a"].to_numpy(), edges["b"].to_numpy())
        yield pd.DataFrame({"node": nodes, "component": labels})


def components(edges: DataFrame, u: str = "u", v: str = "v", one_task: int = ONE_TASK) -> DataFrame:
    """(node, component): the least node of each component, for all nodes with an edge."""
    rows = edges.select(F.least(u, v).alias("a"), F.greatest(u, v).alias("b")).where("a < b").distinct()
    rows = written(rows, "edges")
    if rows.count() <= one_task:
        return written(rows.coalesce(1).mapInPandas(_solve, "node bigint, component bigint"), "components")
    both = rows.union(rows.select("b", "a")).toDF("node", "other")
    labels = written(rows.selectExpr("explode(array(a, b)) AS node").distinct().selectExpr("node", "node AS label"), "labels")
    while True:
        around = both.join(labels.select(F.col("node").alias("other"), "label"), "other")
        least = around.groupBy("node").agg(F.min("label").alias("least"))
        lower = written(labels.join(least, "node").selectExpr("node", "label", "least(label, least) AS lower"), "lower")
        # the label of a node is a node: where that one got a lower label, so does this one
        hooks = lower.where("lower < label").groupBy(F.col("label").alias("root")).agg(F.min("lower").alias("hook"))
        hooked = lower.join(hooks, F.col("lower") == F.col("root"), "left").select(
            "node", F.least("lower", F.coalesce("hook", "lower")).alias("now"), "label"
        )
        onward = written(hooked, "hooked")
        jump = onward.select(F.col("node").alias("at"), F.col("now").alias("then"))
        after = onward.join(jump, F.col("now") == F.col("at")).select(
            "node", F.least("now", "then").alias("label"), (F.least("now", "then") < F.col("label")).alias("moved")
        )
        after = written(after, "labels")
        if after.where("moved").isEmpty():
            return after.select("node", F.col("label").alias("component"))
        labels = after.select("node", "label")
