"""Exact searches among points without comparing all pairs.

Points are dealt to the leaves of a tree whose cuts come from a bounded sample; a leaf's
points are blocks of bounded size with the box around them.  Only blocks whose boxes are near
enough are compared: within a radius, or within the distance of the k-th neighbour that a
point has in its own block.  The tree decides the work, never the result.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tributary.functions import blocks
from tributary.functions.lineage import stored

#: Points of a leaf, about, where there are not more than so many leaves; boxes of all blocks
#: go to every task, so their number is bounded.
ROWS, LEAVES = 1024, 1 << 17
#: Sampled points for each leaf, and in all.
SAMPLED, SAMPLED_MOST = 64, 1 << 18


#: Blocks of points that meet a block in one task, and points whose distances it holds at a time.
TOGETHER, AT_ONCE = 16, 256


@dataclass
class Tree:
    """A complete binary tree: the axis and value at which each node is cut, row by row."""

    depth: int
    axis: np.ndarray
    cut: np.ndarray

    @classmethod
    def of(cls, sample: np.ndarray, depth: int) -> Tree:
        axis, cut = np.zeros((1 << depth) - 1, np.int64), np.full((1 << depth) - 1, np.inf)
        parts = {0: sample}
        for node in range(len(axis)):
            x = parts.pop(node)
            if len(x):
                axis[node] = int(np.ptp(x, axis=0).argmax())
                cut[node] = np.median(x[:, axis[node]])
            right = x[:, axis[node]] > cut[node] if len(x) else np.zeros(0, bool)
            if 2 * node + 2 < len(axis):
                parts[2 * node + 1], parts[2 * node + 2] = x[~right], x[right]
        return cls(depth, axis, cut)

    def leaf(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), np.int64)
        for _ in range(self.depth):
            node = 2 * node + 1 + (x[np.arange(len(x)), self.axis[node]] > self.cut[node])
        return node - ((1 << self.depth) - 1)


@dataclass
class Boxes:
    """The least and largest coordinates of each block."""

    block: np.ndarray
    low: np.ndarray
    high: np.ndarray

    def near(self, i: int, reach: float) -> np.ndarray:
        """Blocks that may have points within ``reach`` of a point in the i-th."""
        gap = np.maximum(0.0, np.maximum(self.low - self.high[i], self.low[i] - self.high))
        return np.flatnonzero(np.sqrt((gap * gap).sum(1)) <= reach * (1 + 1e-9))


class Cells:
    """Points (key, columns) in blocks, with a ``weight`` where there is one."""

    def __init__(self, df: DataFrame, key: str, columns: list[str], rows: int = ROWS, weight: str | None = None):
        self.key, self.columns = key, columns
        self.kind = dict(df.dtypes)[key]
        points = stored(df.select(F.col(key).alias("_key"), *(F.col(c).cast("double").alias(f"_{i}") for i, c in enumerate(columns)), (F.col(weight) if weight else F.lit(1.0)).cast("double").alias("_weight")).na.drop(), "points")
        self.names = [f"_{i}" for i in range(len(columns))]
        n = points.count()
        depth = min(LEAVES.bit_length() - 1, max(0, math.ceil(math.log2(max(1, n / rows)))))
        wanted = min(SAMPLED_MOST, SAMPLED << depth)
        sample = points.where(F.pmod(F.xxhash64("_key", F.lit("tree")), F.lit(1 << 30)) < min(1.0, wanted / max(1, n)) * (1 << 30)).select(*self.names)
        tree = points.sparkSession.sparkContext.broadcast(Tree.of(sample.toPandas().to_numpy(float) if depth else np.zeros((0, len(columns))), depth))
        names = self.names

        def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                yield pdf.assign(_leaf=tree.value.leaf(pdf[names].to_numpy(float)))

        schema = ", ".join([f"_key {self.kind}", *(f"{c} double" for c in names), "_weight double", "_leaf long"])
        placed = stored(points.mapInPandas(place, schema), "leaves")
        # A leaf with many more points, as where many are equal, is cut by their keys.
        most = max(rows, n >> depth)
        parts = F.ceil(F.count(F.lit(1)) / (2 * most)).alias("_parts")
        sizes = placed.groupBy("_leaf").agg(parts)
        block = F.col("_leaf") * (1 << 32) + F.pmod(F.xxhash64("_key"), F.col("_parts"))
        self.points = stored(placed.join(sizes, "_leaf").select("_key", *names, "_weight", block.alias("_block")), "blocks")
        low, high = ([f(c).alias(f"{f.__name__}{c}") for c in names] for f in (F.min, F.max))
        boxes = self.points.groupBy("_block").agg(*low, *high).toPandas()  # LEAVES, and one for each 2 * rows points more
        self.boxes = Boxes(boxes["_block"].to_numpy(np.int64), boxes[[f"min{c}" for c in names]].to_numpy(float), boxes[[f"max{c}" for c in names]].to_numpy(float))

    def pairs(self, reach: DataFrame) -> DataFrame:
        """(a, b, low, high): the blocks to compare, of (block, reach), and the box of the second."""
        shared = self.points.sparkSession.sparkContext.broadcast(self.boxes)

        def partners(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            boxes = shared.value
            at = {b: i for i, b in enumerate(boxes.block.tolist())}
            for pdf in batches:
                for block, far in zip(pdf["_block"].tolist(), pdf["reach"].tolist()):
                    near = boxes.near(at[block], far)
                    yield pd.DataFrame({"a": block, "b": boxes.block[near], "low": list(boxes.low[near]), "high": list(boxes.high[near])})

        return stored(reach.mapInPandas(partners, "a long, b long, low array<double>, high array<double>"), "pairs")

    def bounded(self, farthest: Callable) -> DataFrame:
        """Points with ``_far``: what ``farthest`` makes of their distances in their own block."""
        names = self.names

        def bound(pdf: pd.DataFrame) -> pd.DataFrame:
            x, a = pdf[names].to_numpy(float), pdf["_key"].to_numpy()
            far = [np.zeros(0)]
            for at in range(0, len(x), 1024):
                d = blocks.distances(x[at : at + 1024], x)
                d[a[at : at + 1024, None] == a[None]] = np.inf
                far.append(farthest(d, pdf.iloc[at : at + 1024], pdf))
            return pdf.assign(_far=np.concatenate(far))

        schema = ", ".join([f"_key {self.kind}", *(f"{c} double" for c in names), "_weight double", "_block long", "_far double"])
        return stored(self.points.groupBy("_block").applyInPandas(bound, schema), "bounds")

    def compared(self, mine: DataFrame, pairs: DataFrame, chosen: Callable, others: bool = True) -> DataFrame:
        """(station, neighbour, distance) of what ``chosen`` picks, as positions with values,
        from the distances of points to a block, which are infinite between rows of one key if
        only ``others`` count; ``mine`` are the points with more columns.  A point meets only
        blocks whose box is within its ``_reach``; a block is copied for each ``TOGETHER`` blocks
        that it meets."""
        names, spark = self.names, self.points.sparkSession
        own = lambda df, block: df.select(*(F.col(c).alias(block if c == "_block" else c) for c in df.columns))  # noqa: E731  columns of its own
        count = max(1, len(self.boxes.block))
        parts = max(math.ceil(count / TOGETHER), min(count, math.ceil(4 * spark.sparkContext.defaultParallelism / count)))
        part = F.pmod(F.xxhash64("a"), F.lit(parts)).alias("_part")
        gap = sum((F.greatest(F.lit(0.0), F.col("low")[i] - F.col(c), F.col(c) - F.col("high")[i]) ** 2 for i, c in enumerate(names)), F.lit(0.0))
        left = own(mine, "a").join(own(pairs, ""), "a").where(F.sqrt(gap) <= F.col("_reach") * (1 + 1e-9)).select("b", part, *(c for c in mine.columns if c != "_block"))
        right = own(self.points, "b").join(pairs.select(F.col("b").alias("b"), part).distinct(), "b")

        def work(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
            found = [pd.DataFrame(columns=["station", "neighbour", "distance"])]
            theirs, b = y[names].to_numpy(float), y["_key"].to_numpy()
            for at in range(0, len(x) if len(y) else 0, AT_ONCE):
                mine_ = x.iloc[at : at + AT_ONCE]
                d, a = blocks.distances(mine_[names].to_numpy(float), theirs), mine_["_key"].to_numpy()
                i, j, value = chosen(np.where(a[:, None] == b[None], np.inf, d) if others else d, mine_, y)
                found.append(pd.DataFrame({"station": a[i], "neighbour": b[j], "distance": value}))
            return pd.concat(found[1:] or found)

        return left.groupBy("b", "_part").cogroup(right.groupBy("b", "_part")).applyInPandas(work, f"station {self.kind}, neighbour {self.kind}, distance double")


def within(df: DataFrame, key: str, columns: list[str], threshold: float, rows: int = ROWS) -> DataFrame:
    """(station, neighbour, distance): pairs at most ``threshold`` apart, each with itself too."""
    cells = Cells(df, key, columns, rows)
    mine = cells.points.withColumn("_reach", F.lit(float(threshold)))
    reach = mine.groupBy("_block").agg(F.max("_reach").alias("reach"))

    def chosen(d: np.ndarray, x: pd.DataFrame, y: pd.DataFrame) -> tuple:
        i, j = np.nonzero(d <= threshold)
        return i, j, d[i, j]

    return cells.compared(mine, cells.pairs(reach), chosen, others=False)


def nearest(df: DataFrame, key: str, columns: list[str], k: int, rows: int = ROWS, of: DataFrame | None = None) -> DataFrame:
    """(station, neighbour, distance): the ``k`` nearest others of each point, or of those
    whose keys are in ``of``, and some more that are as near as the k-th of its own block; to
    be ranked.  Blocks hold a few times ``k`` points."""
    cells = Cells(df, key, columns, max(rows, 4 * k) if rows == ROWS else rows)
    mine = cells.bounded(lambda d, x, y: np.partition(d, k - 1, axis=1)[:, k - 1] if d.shape[1] > k else np.full(len(d), np.inf))
    if of is not None:
        mine = mine.join(of.select(F.col(of.columns[0]).alias("_key")), "_key", "left_semi")
    mine = mine.withColumn("_reach", F.col("_far"))
    pairs = cells.pairs(mine.groupBy("_block").agg(F.max("_reach").alias("reach")))

    def chosen(d: np.ndarray, x: pd.DataFrame, y: pd.DataFrame) -> tuple:
        if d.shape[1] > k:  # no more than the k nearest of a block, and those as near
            d[d > np.partition(d, k - 1, axis=1)[:, k - 1 : k]] = np.inf
        i, j = np.nonzero((d <= x["_far"].to_numpy()[:, None]) & np.isfinite(d))
        return i, j, d[i, j]

    return cells.compared(mine, pairs, chosen)
