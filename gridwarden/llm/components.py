"""Connected components of an edge table.

A table of at most `ONE_TASK` distinct edges, counted, is solved by one task, whose memory that
number bounds. Larger tables are contracted by alternating large and small stars. Every round is
a few joins on tables in the shared folder, which go as soon as the next one is written; no node's
neighbours are gathered, as minima are aggregated before the shuffle and joined back in a join that
may be split.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridwarden.llm.common import union_find
from gridwarden.session import dropped, written


def _fingerprint(edges: DataFrame) -> tuple:
    mark = F.xxhash64("a", "b").cast("decimal(38,0)")
    return tuple(edges.agg(F.count("*"), F.sum(mark)).first())


ONE_TASK = 1_000_000  # edges


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ends = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    if not ends:
        return
    a, b = (np.concatenate(e) for e in zip(*ends))
    nodes, codes = np.unique(np.concatenate([a, b]), return_inverse=True)
    parent, find = union_find(len(nodes))
    for x, y in zip(codes[: len(a)].tolist(), codes[len(a) :].tolist()):
        x, y = find(x), find(y)
        if x < y:
            parent[y] = x
        elif y < x:
            parent[x] = y
    roots = np.fromiter(map(find, range(len(nodes))), np.int64, len(nodes))
    for start in range(0, len(nodes), 100_000):
        part = slice(start, start + 100_000)
        yield pa.RecordBatch.from_arrays(
            [pa.array(nodes[part]), pa.array(nodes[roots[part]])], names=["node", "component"]
        )


def _star(edges: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """Every (u, v) becomes (v, m), m the least neighbour of u or u itself; and the table of m."""
    least = written(
        edges.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), f"{name}-least"
    )
    return edges.join(least, "u"), least


def components(edges: DataFrame) -> DataFrame:
    """(a, b) of longs, any order, to (node, component): the least node of each component.

    Only nodes with an edge appear. Null ends are left out; loops and repeats do no harm.
    """
    now = written(
        edges.where("a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct(),
        "edges",
    )
    mark = _fingerprint(now)
    if mark[0] <= ONE_TASK:
        found = written(now.coalesce(1).mapInArrow(_solve, "node long, component long"), "components")
        dropped(now)
        return found
    while True:
        both = now.selectExpr("a AS u", "b AS v").union(now.selectExpr("b AS u", "a AS v"))
        joined, least = _star(both, "large")
        large = joined.where("v > u").selectExpr("v AS a", "m AS b")
        large = written(large.where("a <> b").distinct(), "large")
        dropped(now, least)
        down = large.selectExpr("a AS u", "b AS v")
        joined, least = _star(down, "small")
        small = joined.selectExpr("v AS a", "m AS b").union(joined.selectExpr("u AS a", "m AS b"))
        now = written(small.where("a <> b").distinct(), "small")
        dropped(large, least)
        after = _fingerprint(now)
        if after == mark:
            break
        mark = after
    roots = now.selectExpr("b AS node", "b AS component").distinct()
    found = written(now.selectExpr("a AS node", "b AS component").union(roots), "components")
    dropped(now)
    return found
