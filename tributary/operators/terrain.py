"""Conditioning of heights on grids of any size: pits and depressions filled, flats drained.

A grid is a table of cells; tasks work on square tiles of it with the cells around them.
Each tile is flooded from its edge and leaves a spill graph of its edge cells, reduced to a
tree of least passes.  Trees of neighbouring tiles are joined and reduced again, sixteen
tiles at a time, until one is left; its solution, the least highest pass from each cell to
the outside, goes back down the same levels.  A task holds a tile or the edges of sixteen,
so its memory grows with the side of the grid at most, never with its area.
"""

from __future__ import annotations

import heapq
from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tributary.functions.lineage import stored
from tributary.operators.raster import D8

SIDE = 256
#: The node that stands for everything outside the grid.
OUTSIDE = -(2**63)
#: Two bits of each tile number go at a level: sixteen tiles become one.
BITS = 2

Edges = list[tuple[int, int, float]]


def node(rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    return (rows.astype(np.int64) << 32) | (cols.astype(np.int64) & 0xFFFFFFFF)


class Union:
    def __init__(self):
        self.parent: dict[int, int] = {}

    def root(self, x: int) -> int:
        parent = self.parent
        top = x
        while (up := parent.setdefault(top, top)) != top:
            top = up
        while x != top:
            parent[x], x = top, parent[x]
        return top


def least_passes(edges: Edges, keep) -> Edges:
    """The fewest edges that lead between all nodes with ``keep(node)`` over passes as low as
    in ``edges``: components grow by rising edges, each known by one node that is kept."""
    union, name, out = Union(), {}, []
    for a, b, w in sorted(edges, key=lambda e: e[2]):
        ra, rb = union.root(a), union.root(b)
        if ra == rb:
            continue
        one, two = (name.get(r, x if keep(x) else None) for r, x in ((ra, a), (rb, b)))
        union.parent[ra] = rb
        if one is not None and two is not None:
            out.append((one, two, w))
        name[rb] = two if two is not None else one
    return out


def levels(edges: Edges) -> dict[int, float]:
    """The lowest highest pass from the outside to each node that it reaches."""
    near: dict[int, list[tuple[int, float]]] = {}
    for a, b, w in edges:
        near.setdefault(a, []).append((b, w))
        near.setdefault(b, []).append((a, w))
    found, heap = {}, [(-np.inf, OUTSIDE)]
    while heap:
        level, at = heapq.heappop(heap)
        if at not in found:
            found[at] = level
            for to, w in near.get(at, ()):
                if to not in found:
                    heapq.heappush(heap, (max(level, w), to))
    found.pop(OUTSIDE)
    return found


class Tile:
    """A tile's cells with those around it: flat grids that reach one cell beyond them, infinite
    where there is no value; a tile of few cells is as small as these.  ``own`` are the tile's
    cells that have the first value."""

    def __init__(self, rows, cols, values: dict[str, np.ndarray], top: int, left: int, side: int):
        rows, cols = np.asarray(rows, np.int64), np.asarray(cols, np.int64)
        self.top, self.left, self.wide = int(rows.min()) - 1, int(cols.min()) - 1, int(cols.max() - cols.min()) + 3
        self.at = (rows - self.top) * self.wide + (cols - self.left)
        self.around = [dr * self.wide + dc for dr, dc in D8.values()]
        self.far = [float(np.hypot(dr, dc)) for dr, dc in D8.values()]
        self.size = (int(rows.max() - rows.min()) + 3) * self.wide
        self.values = {}
        for name, v in values.items():
            grid = np.full(self.size, np.inf)
            v = np.asarray(v, float)
            np.minimum.at(grid, self.at, np.where(np.isnan(v), np.inf, v))  # of repeated cells the lowest
            self.values[name] = grid
        there = np.unique(self.at)
        r, c = self.place(there)
        there = there[(r >= top) & (r < top + side) & (c >= left) & (c < left + side)]
        whole = self.values[next(iter(values))][there] < np.inf
        self.own, self.blank = there[whole], there[~whole]
        self.rows, self.cols = self.place(self.own)

    def place(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return at // self.wide + self.top, at % self.wide + self.left

    def mine(self) -> list[bool]:
        out = np.zeros(self.size, bool)
        out[self.own] = True
        return out.tolist()

    def names(self) -> list[int]:
        """The node of every place."""
        return node(*self.place(np.arange(self.size))).tolist()


def flooded(tile: Tile) -> tuple[np.ndarray, np.ndarray, Edges, Edges]:
    """Of a tile's cells the level at which water from its edge or the outside covers them and
    the node that it comes from; its spill graph; and the passes to other tiles."""
    z, mine, names, around = tile.values["z"].tolist(), tile.mine(), tile.names(), tile.around
    none = float("inf")
    level, label = [none] * len(z), [0] * len(z)
    graph: dict[tuple[int, int], float] = {}
    across: Edges = []
    heap: list[tuple[float, int]] = []

    def join(a: int, b: int, w: float) -> None:
        pair = (a, b) if a < b else (b, a)
        if w < graph.get(pair, none):
            graph[pair] = w

    for i in tile.own.tolist():
        open_, beside = False, False
        for d in around:
            j = i + d
            if z[j] == none:
                open_ = True
            elif not mine[j]:
                beside = True
                if names[i] < names[j]:
                    across.append((names[i], names[j], max(z[i], z[j])))
        if open_ or beside:
            level[i], label[i] = z[i], names[i] if beside else OUTSIDE
            heap.append((z[i], i))
            if open_ and beside:
                join(names[i], OUTSIDE, z[i])
    heapq.heapify(heap)
    low: deque[int] = deque()
    while heap or low:
        i = low.popleft() if low else heapq.heappop(heap)[1]
        here, name = level[i], label[i]
        for d in around:
            j = i + d
            if not mine[j]:
                continue
            if level[j] == none:
                label[j] = name
                if z[j] <= here:
                    level[j] = here
                    low.append(j)
                else:
                    level[j] = z[j]
                    heapq.heappush(heap, (z[j], j))
            elif label[j] != name:
                join(name, label[j], max(here, level[j]))
    own = tile.own
    return np.array(level)[own], np.array(label, np.int64)[own], [(a, b, w) for (a, b), w in graph.items()], across


def _tile(value: str, begin: int, side: int) -> Column:
    return F.floor((F.col(value) - begin) / side).cast("int")


def with_margin(cells: DataFrame, key: list[str], row0: int, col0: int, side: int, *values: str) -> DataFrame:
    """Cells, each in its tile (tr, tc) and in those beside which it lies."""
    near = lambda c, b: F.array_distinct(F.array(*(F.floor((F.col(c) + d - b) / side).cast("int") for d in (-1, 0, 1))))
    t = cells.select(*key, "row", "col", *values, F.explode(near("row", row0)).alias("tr"), near("col", col0).alias("_tc"))
    return t.select(*key, "row", "col", *values, "tr", F.explode("_tc").alias("tc"))


def corner(cells: DataFrame) -> tuple[int, int, int, int]:
    """First and last row and column; of an empty table zeros."""
    found = cells.agg(F.min("row"), F.min("col"), F.max("row"), F.max("col")).first()
    return tuple(0 if x is None else x for x in found)


def _of(cells: DataFrame, *columns: str) -> list[str]:
    kinds = dict(cells.dtypes)
    return [f"{c} {kinds[c]}" for c in columns]


def filled(cells: DataFrame, key: tuple[str, ...] = (), side: int = SIDE) -> DataFrame:
    """(key, row, col, z, filled): each cell raised to the lowest level at which it drains to
    the outside, over eight neighbours; stored.

    The outside is wherever a cell has no neighbour: beyond the grid, at missing cells and at
    cells without height (``filled`` null).  Of repeated cells the lowest counts, once.
    """
    key = list(key)
    cells = cells.select(*key, "row", "col", F.col("z").cast("double").alias("z"))
    row0, col0, row1, col1 = corner(cells)
    top = 0
    while max(row1 - row0, col1 - col0) // side >> BITS * top:
        top += 1
    schema = ", ".join(
        [*_of(cells, *key), "tr int", "tc int", "rows array<int>", "cols array<int>", "z array<double>", "level array<double>", "label array<long>"]
        + [f"{n}_{x} array<{t}>" for n in ("inner", "outer") for x, t in (("a", "long"), ("b", "long"), ("w", "double"))]
    )
    names = [c.split(" ")[0] for c in schema.split(", ")]

    def flood(pdf: pd.DataFrame) -> pd.DataFrame:
        tr, tc = int(pdf["tr"].iloc[0]), int(pdf["tc"].iloc[0])
        tile = Tile(pdf["row"], pdf["col"], {"z": pdf["z"]}, row0 + tr * side, col0 + tc * side, side)
        if not len(tile.own) + len(tile.blank):  # a margin without a tile
            return pd.DataFrame(columns=names)
        level, label, inner, outer = flooded(tile)
        inner = least_passes(inner, lambda n: True)
        sides = [list(x) for e in (inner, outer) for x in (zip(*e) if e else ((), (), ()))]
        first = [pdf[k].iloc[0] for k in key]
        rows, cols = tile.place(np.concatenate([tile.own, tile.blank]))
        none = np.full(len(tile.blank), np.nan)
        z, level = np.concatenate([tile.values["z"][tile.own], none]), np.concatenate([level, none])
        label = np.concatenate([label, np.full(len(none), OUTSIDE)])
        return pd.DataFrame([[*first, tr, tc, rows, cols, z, level, label, *sides]], columns=names)

    tiles = stored(with_margin(cells, key, row0, col0, side, "z").groupBy(*key, "tr", "tc").applyInPandas(flood, schema), "flooded")
    edge = [*_of(cells, *key), "tr int", "tc int", "a long", "b long", "w double"]

    def edges(prefix: str) -> DataFrame:
        zipped = F.arrays_zip(*(f"{prefix}_{x}" for x in "abw"))
        return tiles.select(*key, "tr", "tc", F.explode(zipped).alias("e")).select(*key, "tr", "tc", *(F.col(f"e.{prefix}_{x}").alias(x) for x in "abw"))

    def at(column: str, begin: int, size: int, shift: int) -> Column:
        value = F.shiftright(F.col(column), 32) if shift else F.col(column).bitwiseAND(0xFFFFFFFF)
        value = value if shift else F.when(value >= 2**31, value - 2**32).otherwise(value)
        return F.floor((value - begin) / size).cast("int")

    outer = edges("outer") if top else None
    trees = [edges("inner")]

    def group(k: int) -> DataFrame:
        """Edges of level k: those within its parts, and those between them."""
        size = side << BITS * k
        same = lambda s: (at("a", row0, s, 1) == at("b", row0, s, 1)) & (at("a", col0, s, 0) == at("b", col0, s, 0))
        between = outer.where(same(size) & ~same(size >> BITS)).select(*key, at("a", row0, size, 1).alias("tr"), at("a", col0, size, 0).alias("tc"), "a", "b", "w")
        within = trees[k - 1].withColumns({c: F.floor(F.col(c) / (1 << BITS)).cast("int") for c in ("tr", "tc")})
        return within.unionByName(between)

    def rows_of(pdf: pd.DataFrame) -> Edges:
        return list(zip(pdf["a"].tolist(), pdf["b"].tolist(), pdf["w"].tolist()))

    def framed(pdf: pd.DataFrame, columns: dict) -> pd.DataFrame:
        return pd.DataFrame({**{k: pdf[k].iloc[0] for k in [*key, "tr", "tc"]}, **columns}, index=range(len(next(iter(columns.values())))))

    def reduced(size: int):
        def work(pdf: pd.DataFrame) -> pd.DataFrame:
            def keep(n: int) -> bool:
                if n == OUTSIDE:
                    return True
                col = n & 0xFFFFFFFF
                r, c = ((n >> 32) - row0) % size, ((col - 2**32 if col >= 2**31 else col) - col0) % size
                return r in (0, size - 1) or c in (0, size - 1)

            out = least_passes(rows_of(pdf), keep)
            return framed(pdf, dict(zip("abw", map(list, zip(*out) if out else ((), (), ())))))

        return work

    for k in range(1, top):
        trees.append(stored(group(k).groupBy(*key, "tr", "tc").applyInPandas(reduced(side << BITS * k), ", ".join(edge)), "passes"))
    solved = None
    level_schema = ", ".join([*_of(cells, *key), "node long", "level double"])

    def solve(pdf: pd.DataFrame, known: pd.DataFrame | None = None) -> pd.DataFrame:
        if not len(pdf):
            return pd.DataFrame(columns=[*key, "node", "level"])
        more = [] if known is None or not len(known) else [(OUTSIDE, n, w) for n, w in zip(known["node"].tolist(), known["level"].tolist())]
        out = levels(rows_of(pdf) + more)
        return framed(pdf, {"node": list(out), "level": list(out.values())}).drop(columns=["tr", "tc"])

    for k in range(top, 0, -1):
        grouped = group(k).groupBy(*key, "tr", "tc")
        if solved is None:
            solved = stored(grouped.applyInPandas(lambda pdf: solve(pdf), level_schema), "levels")
        else:
            size = side << BITS * k
            above = solved.select(*key, at("node", row0, size, 1).alias("tr"), at("node", col0, size, 0).alias("tc"), "node", "level").groupBy(*key, "tr", "tc")
            solved = stored(grouped.cogroup(above).applyInPandas(lambda a, b: solve(a, b), level_schema), "levels")

    if solved is None:
        tiles = tiles.withColumn("known", F.array().cast("array<struct<node: long, level: double>>"))
    else:
        own = solved.groupBy(*key, at("node", row0, side, 1).alias("tr"), at("node", col0, side, 0).alias("tc")).agg(F.collect_list(F.struct("node", "level")).alias("known"))
        own = own.toDF(*(f"_{c}" for c in own.columns))
        tiles = tiles.join(own, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in [*key, "tr", "tc"]], "left").withColumnRenamed("_known", "known")

    def finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for t in pdf.to_dict("records"):
                known = {x["node"]: x["level"] for x in (t["known"] if t["known"] is not None else ())}
                reach = np.array([known.get(n, -np.inf) for n in np.asarray(t["label"]).tolist()])
                yield pd.DataFrame({**{k: t[k] for k in key}, "row": t["rows"], "col": t["cols"], "z": t["z"], "filled": np.maximum(t["level"], reach)})

    out = ", ".join([*_of(cells, *key), "row int", "col int", "z double", "filled double"])
    done = tiles.select(*key, "rows", "cols", "z", "level", "label", "known").mapInPandas(finish, out)
    return stored(done, "filled")


CODES = list(D8)


def drained(tile: Tile) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a tile's cells the flow code (0 where it is not known yet), the steps to where their
    flat drains (infinite where that is not known yet), whether they lie in a flat, and
    whether that goes on beyond the tile."""
    h, mine, around = tile.values["h"].tolist(), tile.mine(), tile.around
    none, own = float("inf"), tile.own.tolist()
    code, away, flat, goes_on = [0] * len(h), [none] * len(h), [False] * len(h), [False] * len(h)
    for i in own:
        drop, best, out = 0.0, 0, 0
        for d, c, length in zip(around, CODES, tile.far):
            low = h[i + d]
            if low == none:
                out = out or c
            elif h[i] - low > drop * length:
                drop, best = (h[i] - low) / length, c
        if best or out:
            code[i], away[i] = best or out, 0.0
        else:
            flat[i] = True
            goes_on[i] = any(h[i + d] == h[i] and not mine[i + d] for d in around)
    _walk(tile, h, flat, away, code, [i for i in own if not flat[i]])
    return tuple(np.array(x)[tile.own] for x in (code, away, flat, goes_on))


def _walk(tile: Tile, h: list, flat: list, away: list, code: list, begin: list[int]) -> None:
    """Takes steps and codes of a tile's flat cells from those of ``begin``."""
    queue = [(away[i], i) for i in begin]
    heapq.heapify(queue)
    while queue:
        n, i = heapq.heappop(queue)
        if n > away[i]:
            continue
        for d in tile.around:
            j = i + d
            if 0 <= j < len(h) and flat[j] and h[j] == h[i] and n + 1 < away[j]:
                away[j] = n + 1
                heapq.heappush(queue, (n + 1, j))
    for i in tile.own.tolist():
        if flat[i] and away[i] < float("inf"):
            at, c = min((away[i + d], c) for d, c in zip(tile.around, CODES) if h[i + d] == h[i])
            code[i] = c if at < away[i] else 0


def directions(cells: DataFrame, key: tuple[str, ...] = (), side: int = SIDE) -> DataFrame:
    """(key, row, col, z, filled, fdir, steps) of cells that have a ``filled`` height; stored.

    A cell flows down the steepest way (of equals the smallest code), else out of the grid
    where it has no neighbour (by the smallest code), else, in a flat, to the neighbour of
    its height that has the fewest ``steps`` to go to where the flat drains.  Flats that
    cross tiles are gone through in rounds that only take up their own cells.
    """
    key = list(key)
    there = cells.where("filled is not null").select(*key, F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), "z", "filled")
    row0, col0, _, _ = corner(there)
    schema = ", ".join([*_of(there, *key), "row int", "col int", "z double", "filled double", "fdir int", "steps double", "flat boolean", "crosses boolean"])
    names = [c.split(" ")[0] for c in schema.split(", ")]

    def placed(pdf: pd.DataFrame, values: dict) -> Tile:
        return Tile(pdf["row"], pdf["col"], values, row0 + int(pdf["tr"].iloc[0]) * side, col0 + int(pdf["tc"].iloc[0]) * side, side)

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        tile = placed(pdf, {"h": pdf["filled"], "z": pdf["z"]})
        if not len(tile.own):
            return pd.DataFrame(columns=names)
        code, away, flat, goes_on = drained(tile)
        own = {"row": tile.rows, "col": tile.cols, "z": tile.values["z"][tile.own], "filled": tile.values["h"][tile.own]}
        return pd.DataFrame({**{k: pdf[k].iloc[0] for k in key}, **own, "fdir": code, "steps": away, "flat": flat, "crosses": goes_on})[names]

    def onward(pdf: pd.DataFrame) -> pd.DataFrame:
        tile = placed(pdf, {"h": pdf["filled"], "steps": pdf["steps"], "flat": np.where(pdf["flat"], 1.0, 0.0)})
        if not len(tile.own):
            return pd.DataFrame(columns=flat_names)
        h, own = tile.values["h"].tolist(), tile.own
        flat, away, code = np.zeros(len(h), bool), tile.values["steps"].tolist(), [0] * len(h)
        flat[own] = tile.values["flat"][own] == 1.0
        _walk(tile, h, flat.tolist(), away, code, [i for i in range(len(h)) if away[i] < np.inf])
        away = np.array(away)[own]
        columns = {"row": tile.rows, "col": tile.cols, "filled": tile.values["h"][own], "steps": away, "flat": flat[own], "fdir": np.array(code)[own], "changed": away != tile.values["steps"][own]}
        return pd.DataFrame({**{k: pdf[k].iloc[0] for k in key}, **columns})[flat_names]

    first = stored(with_margin(there, key, row0, col0, side, "z", "filled").groupBy(*key, "tr", "tc").applyInPandas(work, schema), "directions")
    if first.where("crosses").isEmpty():
        return first.drop("flat", "crosses")

    flat_schema = ", ".join([*_of(there, *key), "row int", "col int", "filled double", "steps double", "flat boolean", "fdir int", "changed boolean"])
    flat_names = [c.split(" ")[0] for c in flat_schema.split(", ")]
    # Flat cells, and those that drain at the height of a flat in their tile or one beside it.
    heights = first.where("flat").select(*key, "filled", _tile("row", row0, side).alias("tr"), _tile("col", col0, side).alias("tc")).distinct()
    near = F.explode(F.sequence(F.col("tr") - 1, F.col("tr") + 1)), F.explode(F.sequence(F.col("tc") - 1, F.col("tc") + 1))
    heights = heights.select(*key, "filled", near[0].alias("tr"), "tc").select(*key, "filled", "tr", near[1].alias("tc")).distinct()
    heights = heights.toDF(*(f"_{c}" for c in heights.columns))
    in_tile = first.withColumns({"tr": _tile("row", row0, side), "tc": _tile("col", col0, side)})
    state = in_tile.join(heights, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in [*key, "filled", "tr", "tc"]], "left_semi")
    state = stored(state.select(*key, "row", "col", "filled", "steps", "flat", "fdir", F.lit(True).alias("changed")), "flats")
    while not state.where("changed").isEmpty():
        state = stored(with_margin(state, key, row0, col0, side, "filled", "steps", "flat").groupBy(*key, "tr", "tc").applyInPandas(onward, flat_schema), "flats")
    found = state.where("flat").select(*key, "row", "col", F.col("fdir").alias("_fdir"), F.col("steps").alias("_steps"))
    found = found.toDF(*(f"_{c}" if c in [*key, "row", "col"] else c for c in found.columns))
    out = first.join(found, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in [*key, "row", "col"]], "left")
    return stored(out.select(*key, "row", "col", "z", "filled", F.coalesce("_fdir", "fdir").alias("fdir"), F.coalesce("_steps", "steps").alias("steps")), "directions")


def conditioned(cells: DataFrame, key: tuple[str, ...] = (), side: int = SIDE) -> DataFrame:
    """Cells with heights ``filled`` and flow codes ``fdir`` by which every cell leaves the
    grid; see ``filled`` and ``directions``."""
    return directions(filled(cells, key, side), key, side)
