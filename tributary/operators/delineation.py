"""Catchments of many outlets, each in a window that grows until the catchment fits.

For every outlet a square of the grid is conditioned, the outlet snapped to a stream within
a radius, and its catchment taken.  A window without a stream, with too small a catchment or
with one that touches its edge grows by a step; a catchment that partly overlaps that of an
outlet before it is tried again with half the radius.

What an outlet finds with its first, second, third ... radius does not depend on others, so
these tries are a chain of its own; overlaps only decide how far along it the outlet goes.
All outlets go through it together: chains grow where they are needed, and each outlet
chooses anew against what those before it chose, until nothing changes.  As an outlet's
choice rests on those before it alone, that end is the one that one outlet after another
would reach.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tributary.functions.lineage import stored
from tributary.operators import raster, terrain


@dataclass(frozen=True)
class Rules:
    """Degrees, square kilometres, percent; a cell has ``degrees`` a side."""

    degrees: float
    window: float = 1.0
    window_step: float = 0.5
    window_most: float = 5.5
    radius: float = 0.05
    radius_least: float = 0.005
    least_area: float = 10.0
    streams: tuple[int, ...] = (500000, 100000, 50000, 10000, 1000)
    overlap: tuple[float, float] = (10.0, 99.0)

    def radii(self) -> list[float]:
        """Those that are tried in turn."""
        out = [self.radius]
        while (half := round(out[-1] * 0.5, 4)) >= self.radius_least and half < out[-1]:
            out.append(half)
        return out

    def cell_km2(self) -> float:
        return (self.degrees * 111.0) ** 2


def windows(cells: DataFrame, places: DataFrame, reach: Column, block: int) -> DataFrame:
    """(outlet, row, col, z): the cells within ``reach`` of each of (outlet, at_row, at_col, ...),
    by an equi-join on blocks of the grid."""
    blocks = lambda c, r: F.sequence(F.floor((F.col(c) - r) / block).cast("int"), F.floor((F.col(c) + r) / block).cast("int"))
    near = places.select("outlet", "at_row", "at_col", reach.cast("int").alias("_reach"))
    near = near.select("*", F.explode(blocks("at_row", F.col("_reach"))).alias("_br")).select("*", F.explode(blocks("at_col", F.col("_reach"))).alias("_bc"))
    placed = cells.select("row", "col", "z", F.floor(F.col("row") / block).cast("int").alias("_br"), F.floor(F.col("col") / block).cast("int").alias("_bc"))
    inside = (F.abs(F.col("row") - F.col("at_row")) <= F.col("_reach")) & (F.abs(F.col("col") - F.col("at_col")) <= F.col("_reach"))
    return placed.join(near, ["_br", "_bc"]).where(inside).select("outlet", "row", "col", "z")


def snapped(flow: DataFrame, places: DataFrame, rules: Rules) -> DataFrame:
    """(outlet, snap_row, snap_col, threshold): of (outlet, row, col, acc) and (outlet, at_row,
    at_col, radius) the nearest cell within the radius that the highest threshold which any
    has admits; of equals the first by row, then column.  The square goes from -r to r - 1."""
    r = F.greatest(F.lit(1), F.floor(F.col("radius") / rules.degrees + 1e-9).cast("int"))
    t = flow.join(places.select("outlet", "at_row", "at_col", r.alias("_r")), "outlet")
    dr, dc = F.col("row") - F.col("at_row"), F.col("col") - F.col("at_col")
    tier = F.coalesce(*(F.when(F.col("acc") >= s, i) for i, s in enumerate(sorted(rules.streams, reverse=True))))
    t = t.where((dr >= -F.col("_r")) & (dr < F.col("_r")) & (dc >= -F.col("_r")) & (dc < F.col("_r"))).withColumn("_tier", tier).where("_tier is not null")
    best = F.min(F.struct("_tier", (dr * dr + dc * dc).alias("_gap"), "row", "col"))
    levels = F.array(*map(F.lit, sorted(rules.streams, reverse=True)))
    return t.groupBy("outlet").agg(best.alias("b")).select("outlet", F.col("b.row").alias("snap_row"), F.col("b.col").alias("snap_col"), levels[F.col("b._tier")].alias("threshold"))


def at_once(window: pd.DataFrame, rules: Rules) -> tuple | None:
    """What one try in a window that a task holds comes to: snapped row and column,
    threshold, cells, whether these touch the window's edge, and their rows and columns; none
    where there is no stream.  The steps are those of ``tried`` for large windows."""
    rows, cols = window["row"].to_numpy(), window["col"].to_numpy()
    wide = int(max(np.ptp(rows), np.ptp(cols))) + 1
    tile = terrain.Tile(rows, cols, {"z": window["z"]}, int(rows.min()), int(cols.min()), wide)
    tile.values["h"] = np.full(tile.size, np.inf)
    tile.values["h"][tile.own] = terrain.flooded(tile)[0]
    own, way = tile.own.tolist(), dict(zip(raster.D8, tile.around))
    mine, code = tile.mine(), terrain.drained(tile)[0].tolist()
    to = {i: i + way[c] for i, c in zip(own, code) if c and mine[i + way[c]]}
    above: dict[int, list[int]] = {}
    for i, j in to.items():
        above.setdefault(j, []).append(i)
    acc, order = dict.fromkeys(own, 1), [i for i in own if i not in to]
    for i in order:
        order += above.get(i, [])
    for i in reversed(order):
        if i in to:
            acc[to[i]] += acc[i]
    first = window.iloc[0]
    dr, dc = tile.rows - int(first["at_row"]), tile.cols - int(first["at_col"])
    r = max(1, math.floor(first["radius"] / rules.degrees + 1e-9))
    near = np.flatnonzero((dr >= -r) & (dr < r) & (dc >= -r) & (dc < r)).tolist()
    found = min(((-s, int(dr[k] ** 2 + dc[k] ** 2), int(tile.rows[k]), int(tile.cols[k]), own[k]) for k in near for s in [max((s for s in rules.streams if acc[own[k]] >= s), default=None)] if s is not None), default=None)
    if found is None:
        return None
    inside = [found[-1]]
    for i in inside:
        inside += above.get(i, [])
    r, c = tile.place(np.array(inside))
    touches = any(((x == every.min()) | (x == every.max())).any() for x, every in ((r, tile.rows), (c, tile.cols)))
    return found[2], found[3], -found[0], len(inside), bool(touches), r.tolist(), c.tolist()


def tried_at_once(window: DataFrame, places: DataFrame, rules: Rules) -> tuple[DataFrame, DataFrame]:
    """(outlet, snap_row, snap_col, threshold, cells, touches), and the catchments' cells, of
    windows each of which a task holds."""
    spark, kind = window.sparkSession, dict(window.dtypes)["outlet"]
    names = ["outlet", "snap_row", "snap_col", "threshold", "cells", "touches", "rows", "cols"]

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        found = at_once(pdf, rules)
        return pd.DataFrame([] if found is None else [(pdf["outlet"].iloc[0], *found)], columns=names)

    # Windows look small, but each is work: a number of parts of its own.
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    rows = window.join(places.select("outlet", "at_row", "at_col", "radius"), "outlet").repartition(parts, "outlet")
    schema = f"outlet {kind}, snap_row int, snap_col int, threshold int, cells long, touches boolean, rows array<int>, cols array<int>"
    done = stored(rows.groupBy("outlet").applyInPandas(work, schema), "at-once")
    cells = F.inline(F.arrays_zip(F.col("rows").alias("row"), F.col("cols").alias("col")))
    return done.drop("rows", "cols"), done.select("outlet", cells)


def tried_by_tiles(window: DataFrame, places: DataFrame, rules: Rules, side: int) -> tuple[DataFrame, DataFrame]:
    """The same of windows of any size."""
    flow = terrain.conditioned(window, ("outlet",), side)
    acc = stored(raster.accumulation(flow, ["outlet"]), "accumulation")
    at = stored(snapped(acc, places, rules), "snapped")
    inside = raster.catchments(flow, at.select("outlet", F.col("snap_row").alias("row"), F.col("snap_col").alias("col")), ["outlet"])
    ends = window.where("z is not null").groupBy("outlet").agg(*(f(c).alias(f"_{f.__name__}_{c}") for f in (F.min, F.max) for c in ("row", "col")))
    touches = F.max((F.col("row") == F.col("_min_row")) | (F.col("row") == F.col("_max_row")) | (F.col("col") == F.col("_min_col")) | (F.col("col") == F.col("_max_col")))
    shape = inside.join(ends, "outlet").groupBy("outlet").agg(F.count(F.lit(1)).alias("cells"), touches.alias("touches"))
    return at.join(shape, "outlet", "left"), inside


def tried(cells: DataFrame, places: DataFrame, rules: Rules, side: int) -> tuple[DataFrame, DataFrame]:
    """One try of each of (outlet, at_row, at_col, window, radius): with what it comes to
    (``grow`` or ``found``), its snapped cell and size; and the cells of what is found.  A
    window that is no wider than a tile is one task's, larger ones are worked on by tiles."""
    reach = F.round(F.col("window") / rules.degrees)
    parts = []
    for small in (True, False):
        some = places.where((2 * reach + 1 <= side) == small)
        if some.isEmpty():
            continue
        # Blocks of about a first window: an outlet meets the cells around it, not a whole tile's.
        window = stored(windows(cells, some, reach, max(1, round(rules.window / rules.degrees))), "windows")
        parts.append(tried_at_once(window, some, rules) if small else tried_by_tiles(window, some, rules, side))
    results, inside = (reduce(DataFrame.unionByName, x) for x in zip(*parts))
    fits = F.coalesce((F.col("cells") * rules.cell_km2() >= rules.least_area) & ~F.col("touches"), F.lit(False))
    found = places.join(results, "outlet", "left")
    found = stored(found.withColumn("state", F.when(fits, "found").otherwise("grow")).drop("touches"), "tries")
    return found, inside.join(found.where("state = 'found'").select("outlet"), "outlet", "left_semi")


_TRY = ["outlet", "level", "window", "radius", "snap_row", "snap_col", "threshold", "cells", "state"]


def next_in_chain(cells: DataFrame, places: DataFrame, rules: Rules, side: int) -> tuple[DataFrame, DataFrame]:
    """The try of each of (outlet, at_row, at_col, level, window, radius) that fits, with its
    cells, or its failure, once windows have grown as far as they need to."""
    done, kept, open_ = None, None, places
    while not open_.isEmpty():
        found, inside = tried(cells, open_, rules, side)
        wider = F.round(F.col("window") + rules.window_step, 2)
        over = (F.col("state") == "grow") & (wider > rules.window_most)
        ends = found.where((F.col("state") == "found") | over).withColumn("state", F.when(over, "failed").otherwise(F.col("state")))
        ends = ends.select(*_TRY)
        inside = inside.join(found.select("outlet", "level"), "outlet").select("outlet", "level", "row", "col")
        done = ends if done is None else done.unionByName(ends)
        kept = inside if kept is None else kept.unionByName(inside)
        open_ = stored(found.where((F.col("state") == "grow") & ~over).select("outlet", "at_row", "at_col", "level", wider.alias("window"), "radius"), "open")
    return stored(done, "ends"), stored(kept, "catchments")


def overlapping(chosen: DataFrame, tries: DataFrame, cells: DataFrame, rules: Rules) -> DataFrame:
    """(outlet, level): the tries that partly overlap the choice of an outlet before theirs."""
    mine = tries.where("state = 'found'").select("outlet", "level", F.col("cells").alias("_n"))
    taken = chosen.where("state = 'found'").select("outlet", "level", F.col("cells").alias("_m"))
    theirs = cells.join(taken, ["outlet", "level"]).select(F.col("outlet").alias("_other"), "_m", "row", "col")
    shared = cells.join(mine, ["outlet", "level"]).join(theirs, ["row", "col"]).where("_other < outlet").groupBy("outlet", "level", "_n", "_other", "_m").agg(F.count(F.lit(1)).alias("_shared"))
    part = 100 * F.col("_shared") / F.least("_n", "_m")
    return shared.where((part > rules.overlap[0]) & (part < rules.overlap[1])).select("outlet", "level").distinct()


def delineated(cells: DataFrame, outlets: DataFrame, rules: Rules, side: int = terrain.SIDE) -> tuple[DataFrame, DataFrame]:
    """(outlet, status, window, radius, snap_row, snap_col, threshold, cells, tries) of outlets
    (outlet, row, col), a row each, and (outlet, row, col) of their catchments; both stored.

    Outlets come in order of their key, which must be unique and not null.  ``status`` is
    SUCCESS, or FAILED where no window is large enough.  With the last radius an overlap is
    accepted.  Missing cells and cells without height are outside; an outlet far from all
    cells fails.  No outlets, or no cells, give no catchments.
    """
    radii = rules.radii()
    first = outlets.select("outlet", F.col("row").alias("at_row"), F.col("col").alias("at_col"))
    need = stored(first.select("*", F.lit(0).alias("level"), F.lit(rules.window).alias("window"), F.lit(rules.radius).alias("radius")), "outlets")
    spark = cells.sparkSession
    if need.isEmpty():
        kinds = dict(outlets.dtypes)
        empty = f"outlet {kinds['outlet']}, status string, window double, radius double, snap_row int, snap_col int, threshold int, cells long, tries int"
        return spark.createDataFrame([], empty), outlets.select("outlet", "row", "col")
    tries, inside = next_in_chain(cells, need, rules, side)
    chosen = tries
    while True:
        bad = overlapping(chosen, tries, inside, rules).withColumn("_bad", F.lit(True))
        judged = tries.join(bad, ["outlet", "level"], "left")
        good = F.col("_bad").isNull() | (F.col("level") == len(radii) - 1)  # a failure is an end as well
        choice = F.coalesce(F.min(F.when(good, F.col("level"))), F.max("level") + 1)
        choice = stored(judged.groupBy("outlet").agg(choice.alias("level")), "choice")
        short = choice.join(tries.select("outlet", "level"), ["outlet", "level"], "left_anti")
        # A next try begins with the window of the last.
        radius = F.array(*map(F.lit, radii))[F.col("level")]
        last = tries.select("outlet", (F.col("level") + 1).alias("level"), "window")
        need = stored(short.join(last, ["outlet", "level"]).join(first, "outlet").select("outlet", "at_row", "at_col", "level", "window", radius.alias("radius")), "outlets")
        before = chosen.select("outlet", "level")
        if need.isEmpty() and choice.select("outlet", "level").exceptAll(before).isEmpty():
            break
        if not need.isEmpty():
            more, more_inside = next_in_chain(cells, need, rules, side)
            tries, inside = stored(tries.unionByName(more), "tries"), stored(inside.unionByName(more_inside), "catchments")
        chosen = stored(tries.join(choice, ["outlet", "level"]).select(*_TRY), "chosen")
    status = F.when(F.col("state") == "found", "SUCCESS").otherwise("FAILED").alias("status")
    table = chosen.select("outlet", status, "window", "radius", "snap_row", "snap_col", "threshold", "cells", (F.col("level") + 1).alias("tries"))
    return stored(table, "delineated"), stored(inside.join(chosen.where("state = 'found'").select("outlet", "level"), ["outlet", "level"]).select("outlet", "row", "col"), "catchments")
