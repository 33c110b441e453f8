"""Catchments on grids kept as tables of cells."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tributary.functions.lineage import cut

# Flow codes and the step they stand for (row, column).
D8 = {1: (0, 1), 2: (1, 1), 4: (1, 0), 8: (1, -1), 16: (0, -1), 32: (-1, -1), 64: (-1, 0), 128: (-1, 1)}


def downstream(cells: DataFrame, key: list[str] | None = None) -> DataFrame:
    """(key, row, col, to_row, to_col) of cells with a flow code ``fdir``."""
    step = lambda k: F.coalesce(*(F.when(F.col("fdir") == code, d[k]) for code, d in D8.items()))
    return cells.where(F.col("fdir").isin(*D8)).select(*(key or []), "row", "col", (F.col("row") + step(0)).alias("to_row"), (F.col("col") + step(1)).alias("to_col"))


def catchments(cells: DataFrame, outlets: DataFrame, key: list[str]) -> DataFrame:
    """(key, row, col): the cells of each key's grid that drain to the key's outlet, of which
    ``outlets`` has one.  Every cell points to the next one downstream, the outlet to itself;
    each round a cell takes over where its target points, so a river of n cells needs about
    log2 n rounds.  Cells that flow off the grid or in circles drop out."""
    at = outlets.select(*key, "row", "col").distinct()
    at = at.join(cells.select(*key, "row", "col"), [*key, "row", "col"], "left_semi")
    points = downstream(cells, key).dropDuplicates([*key, "row", "col"]).join(at, [*key, "row", "col"], "left_anti").withColumn("there", F.lit(False))
    points = points.join(at.select(*key), key, "left_semi") if key else points
    state = cut(points.unionByName(at.select("*", F.col("row").alias("to_row"), F.col("col").alias("to_col"), F.lit(True).alias("there"))))
    reached = state.where("there").count()
    while True:
        onward = state.select(*key, F.col("row").alias("to_row"), F.col("col").alias("to_col"), F.col("to_row").alias("next_row"), F.col("to_col").alias("next_col"), F.col("there").alias("arrives"))
        state = cut(state.join(onward, [*key, "to_row", "to_col"]).select(*key, "row", "col", F.col("next_row").alias("to_row"), F.col("next_col").alias("to_col"), F.col("arrives").alias("there")))
        before, reached = reached, state.where("there").count()
        if reached == before:
            return state.where("there").select(*key, "row", "col")


def catchment(cells: DataFrame, row: int, col: int) -> DataFrame:
    """Cells that drain to one outlet."""
    outlet = cells.sparkSession.range(1).select(F.lit(row).alias("row"), F.lit(col).alias("col"), F.lit(0).alias("_grid"))
    return catchments(cells.withColumn("_grid", F.lit(0)), outlet, ["_grid"]).drop("_grid")


def snap_outlet(cells: DataFrame, row: float, col: float, reach: float, thresholds: list[int]) -> DataFrame:
    """The nearest cell of the highest threshold that any cell in reach has."""
    inside = cells.where((F.abs(F.col("row") - row) <= reach) & (F.abs(F.col("col") - col) <= reach))
    tier = F.coalesce(*(F.when(F.col("acc") >= t, i) for i, t in enumerate(sorted(thresholds, reverse=True))))
    gap = (F.col("row") - row) ** 2 + (F.col("col") - col) ** 2
    best = F.min(F.struct(tier.alias("tier"), gap.alias("gap"), "row", "col", "acc"))
    return inside.where(tier.isNotNull()).agg(best.alias("x")).where("x is not null").select("x.row", "x.col", "x.acc", F.sqrt("x.gap").alias("distance"))


def touches_edge(cells: DataFrame, key: str, rows: int, cols: int) -> DataFrame:
    return cells.groupBy(key).agg(((F.min("row") <= 0) | (F.min("col") <= 0) | (F.max("row") >= rows - 1) | (F.max("col") >= cols - 1)).alias("touches"))


def summaries(cells: DataFrame, key: str, degrees: float, stream_from: int = 1000) -> DataFrame:
    """Area, elevations, stream length and drainage density; heights of 0 and less are null."""
    z = F.when(F.col("z") > 0, F.col("z"))
    side = degrees * 111.0
    t = cells.groupBy(key).agg(F.count(F.lit(1)).alias("cells"), F.avg(z).alias("mean_elev"), F.min(z).alias("min_elev"), F.max(z).alias("max_elev"), F.count_if(F.col("acc") > stream_from).alias("stream_cells"))
    area = F.col("cells") * (side * side)
    return t.select(key, area.alias("area_km2"), "mean_elev", "min_elev", "max_elev", (F.col("max_elev") - F.col("min_elev")).alias("relief"), (F.col("stream_cells") * 0.03).alias("stream_km"), (F.col("stream_cells") * 0.03 / area).alias("drain_density"))


def mean_slope(cells: DataFrame, key: str, cell_m: float) -> DataFrame:
    """Mean slope in degrees from central differences; cells outside count as height 0."""
    along = lambda p, o: Window.partitionBy(key, p).orderBy(o)
    z = F.coalesce("z", F.lit(0.0))

    def step(p: str, o: str):
        w = along(p, o)
        near = lambda f, d: F.when(f(o).over(w) == F.col(o) + d, f(z).over(w)).otherwise(0.0)
        return (near(F.lead, 1) - near(F.lag, -1)) / (2 * cell_m)

    s = cells.withColumn("dx", step("row", "col")).withColumn("dy", step("col", "row"))
    return s.groupBy(key).agg(F.avg(F.degrees(F.atan(F.sqrt(F.col("dx") ** 2 + F.col("dy") ** 2)))).alias("mean_slope"))


def overlaps(cells: DataFrame, key: str, low: float = 10.0, high: float = 99.0) -> DataFrame:
    """Pairs of catchments that share between ``low`` and ``high`` percent of the smaller.  The
    join is on cells, so only catchments that touch meet."""
    size = cells.groupBy(key).agg(F.count(F.lit(1)).alias("cells"))
    a, b = cells.select(F.col(key).alias("a"), "row", "col"), cells.select(F.col(key).alias("b"), "row", "col")
    shared = a.join(b, ["row", "col"]).where("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"))
    both = shared.join(size.select(F.col(key).alias("a"), F.col("cells").alias("na")), "a").join(size.select(F.col(key).alias("b"), F.col("cells").alias("nb")), "b")
    pct = 100 * F.col("shared") / F.least("na", "nb")
    return both.select("a", "b", "shared", pct.alias("percent")).where((F.col("percent") > low) & (F.col("percent") < high))


def mosaic(tiles: DataFrame) -> DataFrame:
    """One value per cell: the first tile's that has one."""
    return tiles.where("z is not null").groupBy("row", "col").agg(F.min_by("z", "tile").alias("z"))


def bbox_area(west: float, south: float, east: float, north: float, radius: float = 6371.0) -> float:
    """Square kilometres on a sphere."""
    return radius**2 * abs(math.sin(math.radians(north)) - math.sin(math.radians(south))) * abs(math.radians(east - west))


def split_bbox(box: tuple[float, float, float, float], most: float) -> list[tuple[float, float, float, float]]:
    """Halves the longer side until every part is small enough."""
    west, south, east, north = box
    if bbox_area(*box) <= most:
        return [box]
    if east - west >= north - south:
        mid = (west + east) / 2
        parts = ((west, south, mid, north), (mid, south, east, north))
    else:
        mid = (south + north) / 2
        parts = ((west, south, east, mid), (west, mid, east, north))
    return [b for p in parts for b in split_bbox(p, most)]


def flow_directions(cells: DataFrame, key: list[str] | None = None) -> DataFrame:
    """Cells with the code ``fdir`` of their steepest way down among eight neighbours, of
    equals the smallest code; 0 where none is lower.  Pits and flats stay as they are."""
    k = key or []
    ways = F.array(*(F.struct(F.lit(code).alias("code"), F.lit(r).alias("dr"), F.lit(c).alias("dc")) for code, (r, c) in D8.items()))
    # Each cell offers its height to those around it: one equi-join, whatever the grid's size.
    # Eight offers a cell are taken for few by the planner, which would broadcast them.
    offers = cells.where("z is not null").select(*k, "row", "col", "z", F.explode(ways).alias("w")).select(
        *k, (F.col("row") - F.col("w.dr")).alias("row"), (F.col("col") - F.col("w.dc")).alias("col"), F.col("w.code").alias("code"), F.sqrt(F.col("w.dr") ** 2 + F.col("w.dc") ** 2).alias("far"), F.col("z").alias("low")
    )
    drop = (F.col("z") - F.col("low")) / F.col("far")
    best = cells.select(*k, "row", "col", "z").join(offers.hint("merge"), [*k, "row", "col"]).where(drop > 0).groupBy(*k, "row", "col").agg(F.max(F.struct(drop.alias("drop"), (-F.col("code")).alias("code"))).alias("b"))
    return cells.drop("fdir").join(best.hint("merge"), [*k, "row", "col"], "left").withColumn("fdir", F.coalesce(-F.col("b.code"), F.lit(0))).drop("b")


def accumulation(cells: DataFrame, key: list[str] | None = None) -> DataFrame:
    """(key, row, col, acc): how many cells drain through each, itself included.

    Cells hand on what has reached them and then point twice as far, so a river of n cells
    needs about log2 n rounds.  Flows must not run in circles.
    """
    k = key or []
    here = cells.select(*k, "row", "col").distinct()
    state = here.join(downstream(cells, k).dropDuplicates([*k, "row", "col"]), [*k, "row", "col"], "left")
    inside = here.select(*k, F.col("row").alias("to_row"), F.col("col").alias("to_col"), F.lit(True).alias("inside"))
    state = state.join(inside, [*k, "to_row", "to_col"], "left")
    state = cut(state.select(*k, "row", "col", *(F.when(F.col("inside"), F.col(c)).alias(c) for c in ("to_row", "to_col")), F.lit(1).cast("long").alias("acc")))
    rounds = state.count().bit_length() + 1
    while not state.where("to_row is not null").isEmpty():
        if (rounds := rounds - 1) < 0:
            raise ValueError("cells flow in circles")
        got = state.where("to_row is not null").groupBy(*k, F.col("to_row").alias("row"), F.col("to_col").alias("col")).agg(F.sum("acc").alias("more"))
        onward = state.select(*k, F.col("row").alias("to_row"), F.col("col").alias("to_col"), F.col("to_row").alias("next_row"), F.col("to_col").alias("next_col"))
        moved = state.join(onward, [*k, "to_row", "to_col"], "left").select(*k, "row", "col", F.col("next_row").alias("to_row"), F.col("next_col").alias("to_col"), "acc")
        state = cut(moved.join(got, [*k, "row", "col"], "left").select(*k, "row", "col", "to_row", "to_col", (F.col("acc") + F.coalesce("more", F.lit(0))).alias("acc")))
    return state.select(*k, "row", "col", "acc")


def hillshade(cells: DataFrame, key: str, azimuth: float = 315.0, altitude: float = 45.0) -> DataFrame:
    """(key, row, col, shade) from 0 to 1; missing heights count as 0 around them and have no
    shade.  Differences are central, at the edges one-sided."""
    z = F.coalesce("z", F.lit(0.0))

    def slope(p: str, o: str):
        w = Window.partitionBy(key, p).orderBy(o)
        up = F.when(F.lead(o).over(w) == F.col(o) + 1, F.lead(z).over(w))
        down = F.when(F.lag(o).over(w) == F.col(o) - 1, F.lag(z).over(w))
        steps = up.isNotNull().cast("int") + down.isNotNull().cast("int")
        return F.when(steps > 0, (F.coalesce(up, z) - F.coalesce(down, z)) / steps).otherwise(0.0)

    s = cells.withColumns({"_dx": slope("row", "col"), "_dy": slope("col", "row")})
    tilt, aspect = F.atan(F.sqrt(F.col("_dx") ** 2 + F.col("_dy") ** 2)), F.atan2(-F.col("_dy"), F.col("_dx"))
    az, alt = math.radians(azimuth), math.radians(altitude)
    shade = math.sin(alt) * F.cos(tilt) + math.cos(alt) * F.sin(tilt) * F.cos(F.lit(az) - aspect)
    return s.select(key, "row", "col", F.when(F.col("z").isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), shade))).alias("shade"))


def centroids(cells: DataFrame, key: str, west: float, north: float, degrees: float) -> DataFrame:
    """(key, lon, lat): mean of the cells' centres."""
    return cells.groupBy(key).agg((F.lit(west) + (F.avg("col") + 0.5) * degrees).alias("lon"), (F.lit(north) - (F.avg("row") + 0.5) * degrees).alias("lat"))


def outlet_window(cells: DataFrame, row: int, col: int, reach: int) -> DataFrame:
    """One row: accumulation at an outlet, and the largest within reach."""
    inside = cells.where((F.abs(F.col("row") - row) <= reach) & (F.abs(F.col("col") - col) <= reach))
    return inside.agg(F.max(F.when((F.col("row") == row) & (F.col("col") == col), F.col("acc"))).alias("at_outlet"), F.max("acc").alias("largest"), F.count(F.lit(1)).alias("cells"))


def bbox_tiles(boxes: DataFrame, key: str, most: float) -> DataFrame:
    """(key, west, south, east, north, area_km2): the parts of each split box, of (key, west,
    south, east, north); a box that lacks a side has none."""
    sides = ["west", "south", "east", "north"]
    names = [key, *sides, "area_km2"]

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for who, *box in pdf.itertuples(index=False):
                yield pd.DataFrame([(who, *b, bbox_area(*b)) for b in split_bbox(tuple(box), most)], columns=names)

    rows = boxes.select(key, *(F.col(c).cast("double").alias(c) for c in sides)).dropna(subset=sides)
    return rows.mapInPandas(split, f"{key} {dict(boxes.dtypes)[key]}, west double, south double, east double, north double, area_km2 double")
