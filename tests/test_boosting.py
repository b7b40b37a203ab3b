"""Boosted trees: equality with a slow version on single rows, tables, and what they are worth."""

from __future__ import annotations

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gridwarden.config import Settings
from gridwarden.operators import boosting, forecast, rollups
from gridwarden.operators.boosting import Axis, Growth, Trees
from gridwarden.plans.catalog import clustered
from gridwarden.session import scratch_path, written

AXES = [Axis("a", 11, 5), Axis("b", 7, 7)]


def made_up_rows(seed=1, n=400):
    draw = random.Random(seed)
    rows = [(draw.randrange(11), draw.randrange(7)) for _ in range(n)]
    return [(a, b, draw.randint(0, 4) + (6 if a > 6 and b in (2, 3) else 0) + a % 3) for a, b in rows]


def slow(rows, how):
    """Boosting over single rows: every split of every node is tried on the rows themselves."""
    xs = [(a * 5 // 11, b) for a, b, _ in rows]
    ys = [float(y) for *_, y in rows]
    guess = [sum(ys) / len(ys)] * len(ys)
    for _ in range(how.trees):
        price = how.penalty * sum((y - g) ** 2 for y, g in zip(ys, guess)) / len(ys)
        slope = [g - y for y, g in zip(ys, guess)]

        def part(inside):
            return sum(slope[i] for i in inside) ** 2 / (len(inside) + how.l2)

        def leaves(inside, depth):
            best = None
            for f in (0, 1) if depth < how.depth else ():
                for cut in range(AXES[f].bins):
                    left = [i for i in inside if xs[i][f] <= cut]
                    right = [i for i in inside if xs[i][f] > cut]
                    if min(len(left), len(right)) < max(1, how.least_rows):
                        continue
                    gain = round(0.5 * (part(left) + part(right) - part(inside)) - price, 9)
                    if gain > 1e-6 and (best is None or gain > best[0]):
                        best = gain, left, right
            if best is None:
                return [inside]
            return leaves(best[1], depth + 1) + leaves(best[2], depth + 1)

        for inside in leaves(list(range(len(ys))), 0):
            step = -how.rate * sum(slope[i] for i in inside) / (len(inside) + how.l2)
            for i in inside:
                guess[i] += step
    return guess


@pytest.mark.parametrize("how", [Growth(6, 0.3, 3, 1.0, 1.0, 0.0), Growth(4, 0.5, 2, 0.0, 9.0, 0.0), Growth(9, 0.2, 4, 2.0, 1.0, 1.0)])
def test_equals_boosting_over_rows(spark, how):
    rows = made_up_rows()
    df = spark.createDataFrame(rows, "a long, b long, y long").repartition(3)
    model = boosting.fit(df, AXES, "y", how)
    got = {(r.a, r.b): r.prediction for r in model.transform(df).collect()}
    want = slow(rows, how)
    assert all(abs(got[a, b] - w) < 1e-9 for (a, b, _), w in zip(rows, want))
    assert model.nodes.where("feature IS NOT NULL").count() > 0


def test_saved_and_loaded(spark):
    df = spark.createDataFrame(made_up_rows(), "a long, b long, y long")
    model = boosting.fit(df, AXES, "y", Growth(5, 0.3, 3, 1.0, 1.0, 0.0))
    path = scratch_path(spark, "trees")
    model.save(path)
    again = Trees.load(spark, path)
    assert again.axes == AXES
    asked = spark.createDataFrame([(3, 2), (-5, 2), (0, 2), (99, 8), (10, 6), (None, 1)], "a long, b long")
    got = [{(r.a, r.b): r.prediction for r in m.transform(asked).collect()} for m in (model, again)]
    assert got[0] == got[1] and got[0][-5, 2] == got[0][0, 2] and got[0][99, 8] == got[0][10, 6]
    assert got[0][None, 1] is None and again.transform(asked).columns == ["a", "b", "prediction"]


def test_trees_follow_a_signal_and_not_noise():
    draw = np.random.default_rng(3)
    grid = pd.DataFrame([(a, b) for a in range(5) for b in range(7)], columns=["a", "b"])
    how = Growth(200, 0.08, 6, 1.0, 1.0, 1.0)
    n = np.full(len(grid), 50.0)
    for signal in (0.0, 3.0):
        truth = 5 + signal * ((grid["a"] > 2) & (grid["b"] == 4)).to_numpy()
        rows = truth[:, None] + draw.normal(0, 2, (len(grid), 50))
        cells = grid.assign(n_rows=n, total=rows.sum(1), squares=(rows**2).sum(1))
        nodes = boosting.grow(cells, AXES, how)
        found = boosting.predictions(nodes, AXES)["prediction"].to_numpy()
        assert len(found) == 35 and np.abs(found - truth).mean() < 0.2


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_default_forecast_beats_the_mean(spark, folder):
    trend = written(rollups.hourly_trend(clustered(spark, folder)), "trend")
    model = forecast.train_forecast(trend, Settings())
    flagged = trend.withColumn("held_out", forecast.split_flag(Settings()))
    mean = flagged.filter("NOT held_out").agg(F.avg(forecast.LABEL)).first()[0]
    held = flagged.filter("held_out").withColumn("prediction", F.lit(mean))
    assert model.mae < forecast.forecast_mae(held).first()[0]
    assert model.model.nodes.agg(F.max("tree")).first()[0] == 199
