"""Nearest neighbours and radii by cells against all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tributary.functions import blocks, cells
from tributary.operators import space


def points(seed, n, d=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d)) * [1, 3, 0.2][:d]
    x[: n // 4] = np.round(x[: n // 4])  # ties
    x[n // 2 : n // 2 + n // 3] = x[n // 2]  # a third of all points in one place
    return x


def frame(spark, x, keys=None):
    keys = keys or [f"s{i:04d}" for i in range(len(x))]
    return spark.createDataFrame([(k, *map(float, r)) for k, r in zip(keys, x)], "station string, a double, b double, c double").repartition(3)


@pytest.mark.parametrize("rows", [8, 50, 4096])
def test_equal_all_pairs(spark, rows):
    x = points(1, 300)
    df = frame(spark, x)
    d = blocks.distances(x, x)
    names = [f"s{i:04d}" for i in range(len(x))]
    for k in (1, 7):
        got = {}
        for r in cells.nearest(df, "station", ["a", "b", "c"], k, rows).collect():
            got.setdefault(r.station, []).append((r.distance, r.neighbour))
        for i, name in enumerate(names):
            want = sorted((d[i, j], names[j]) for j in range(len(x)) if j != i)[:k]
            assert sorted(got[name])[:k] == want
    near = {(r.station, r.neighbour): r.distance for r in cells.within(df, "station", ["a", "b", "c"], 0.4, rows).collect()}
    assert near == {(names[i], names[j]): d[i, j] for i, j in zip(*np.nonzero(d <= 0.4))}


def test_ranked_neighbours(spark):
    x = points(2, 60)
    df = frame(spark, x).union(spark.createDataFrame([("none", None, 1.0, 1.0)], "station string, a double, b double, c double"))
    d = blocks.distances(x, x)
    got = sorted((r.station, r["rank"], r.neighbour) for r in space.neighbours(df, "station", ["a", "b", "c"], 5).collect())
    assert got == [(f"s{i:04d}", r + 1, f"s{j:04d}") for i in range(60) for r, (_, j) in enumerate(sorted((d[i, j], j) for j in range(60) if j != i)[:5])]
    assert space.neighbours(df.limit(0), "station", ["a", "b", "c"], 5).count() == 0
    few = sorted((r.station, r.neighbour) for r in space.neighbours(frame(spark, x[:3]), "station", ["a", "b", "c"], 5).collect())
    assert len(few) == 6


def test_work_grows_little_more_than_points(spark):
    """Pairs of blocks that are compared: four times the points, not sixteen times the pairs."""
    rng = np.random.default_rng(3)
    count = {}
    for n in (2000, 8000):
        x = rng.uniform(size=(n, 3))
        df = frame(spark, x)
        c = cells.Cells(df, "station", ["a", "b"], 100)
        reach = c.points.select("_block").distinct().withColumn("reach", cells.F.lit(float(0.05 * (2000 / n) ** 0.5)))
        count[n] = c.pairs(reach).count()
    assert count[8000] < 6 * count[2000]


def test_points_meet_blocks_in_their_own_reach(spark):
    """One far-reaching point of a block does not take the others along, and nothing near is lost."""
    rng = np.random.default_rng(9)
    z = rng.random((2000, 2))
    df = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(z)], "station long, a double, b double")
    c = cells.Cells(df, "station", ["a", "b"], 100)
    mine = c.points.withColumn("_reach", F.when(F.col("_key") % 50 == 0, 0.5).otherwise(0.02))
    pairs = c.pairs(mine.groupBy("_block").agg(F.max("_reach").alias("reach")))

    def every(d, x, y):
        i, j = np.nonzero(d >= 0)
        return i, j, d[i, j]

    met = c.compared(mine, pairs, every, others=False).toPandas()
    sizes = {r["_block"]: r["count"] for r in c.points.groupBy("_block").count().collect()}
    by_blocks = sum(sizes[r.a] * sizes[r.b] for r in pairs.collect())
    assert not met.duplicated(["station", "neighbour"]).any() and len(met) < by_blocks / 3
    found = set(zip(met["station"], met["neighbour"]))
    far = np.sqrt(((z[:, None] - z[None]) ** 2).sum(2))
    assert all((i, j) in found for i, j in zip(*np.nonzero(far <= np.where(np.arange(2000) % 50 == 0, 0.5, 0.02)[:, None])))
