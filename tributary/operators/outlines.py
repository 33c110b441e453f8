"""Outlines of sets of cells: unit edges, closed rings, polygons with holes.

Edges lie in compressed files that look small enough to broadcast when their rows are not, so
tables of edges and rings are joined by sorting, and none goes through the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tributary.functions.lineage import stored

#: Sides of a cell in clockwise order, each from one corner to the next: the cell's own
#: offset to the corners where it begins and ends.
SIDES = (((0, 0), (0, 1)), ((0, 1), (1, 1)), ((1, 1), (1, 0)), ((1, 0), (0, 0)))
HALF = 1 << 30


def _edge_id(row: Column, col: Column, side: Column) -> Column:
    """One number for a side of a cell; rows and columns lie within ±2³⁰."""
    return (row.cast("long") * (4 << 31)) + (col.cast("long") + HALF) * 4 + side


def boundary(cells: DataFrame, key: list[str]) -> DataFrame:
    """(key, edge, row, col, side, r0, c0, r1, c1): the sides of cells that no other cell of
    the key has, clockwise around it.  A side between two cells comes from both, in opposite
    directions, and cancels."""
    sides = F.array(*(F.struct(F.lit(i).alias("side"), *(F.lit(x).alias(n) for n, x in zip(("a", "b", "c", "d"), (*s, *e)))) for i, (s, e) in enumerate(SIDES)))
    t = cells.select(*key, "row", "col").distinct().select(*key, "row", "col", F.explode(sides).alias("s"))
    at = lambda c, o: (F.col(c) + F.col(f"s.{o}")).alias
    t = t.select(*key, "row", "col", "s.side", at("row", "a")("r0"), at("col", "b")("c0"), at("row", "c")("r1"), at("col", "d")("c1"))
    line = [F.least("r0", "r1").alias("_r"), F.least("c0", "c1").alias("_c"), (F.col("r0") == F.col("r1")).alias("_level")]
    fields = ["row", "col", "side", "r0", "c0", "r1", "c1"]
    one = t.groupBy(*key, *line).agg(F.count(F.lit(1)).alias("n"), *(F.min(f).alias(f) for f in fields)).where("n = 1")
    return one.select(*key, _edge_id(F.col("row"), F.col("col"), F.col("side")).alias("edge"), *fields)


def linked(edges: DataFrame, key: list[str]) -> DataFrame:
    """(key, edge, next): each edge with the one that follows.  Where two cells only touch at a
    corner each ring stays with its cell, so cells that touch are two polygons."""
    out = edges.groupBy(*key, F.col("r0").alias("r1"), F.col("c0").alias("c1")).agg(F.collect_list(F.struct("row", "col", "edge")).alias("on"))
    same = F.filter("on", lambda e: (e["row"] == F.col("row")) & (e["col"] == F.col("col")))
    after = F.when(F.size("on") == 1, F.col("on")[0]["edge"]).otherwise(same[0]["edge"])
    return edges.join(out.hint("merge"), [*key, "r1", "c1"]).select(*key, "edge", after.alias("next"))


def ringed(links: DataFrame, key: list[str]) -> DataFrame:
    """(key, edge, ring, place): the least edge of each edge's ring and how many edges follow
    until the ring's last.  Edges look twice as far each round, so a ring of n edges takes
    about log2 n rounds, twice."""
    state = stored(links.select(*key, "edge", F.col("next").alias("to"), F.least("edge", "next").alias("ring"), F.lit(True).alias("moved")), "rings")
    while not state.where("moved").isEmpty():
        far = state.select(*key, F.col("edge").alias("to"), F.col("to").alias("_to"), F.col("ring").alias("_ring"))
        least = F.least("ring", "_ring")
        state = stored(state.join(far.hint("merge"), [*key, "to"]).select(*key, "edge", F.col("_to").alias("to"), least.alias("ring"), (least < F.col("ring")).alias("moved")), "rings")
    ring = state.select(*key, "edge", "ring")
    # The ring is cut before its least edge, and each edge counts those up to the cut.
    chain = links.join(ring.hint("merge"), [*key, "edge"]).withColumn("to", F.when(F.col("next") != F.col("ring"), F.col("next")))
    state = stored(chain.select(*key, "edge", "ring", "to", F.when(F.col("to").isNull(), 0).otherwise(1).cast("long").alias("place")), "places")
    while not state.where("to is not null").isEmpty():
        far = state.select(*key, F.col("edge").alias("to"), F.col("to").alias("_to"), F.col("place").alias("_place"))
        state = stored(state.join(far.hint("merge"), [*key, "to"], "left").select(*key, "edge", "ring", F.col("_to").alias("to"), (F.col("place") + F.coalesce("_place", F.lit(0))).alias("place")), "places")
    return state.select(*key, "edge", "ring", "place")


def holders(placed: DataFrame, key: list[str]) -> DataFrame:
    """(key, ring, holder): of each hole the outer ring around it, of (key, ring, hole, row, col,
    side) of edges.

    A hole's least edge is the lower side of a cell above it.  Westwards from that cell the
    first boundary is a ring of the same polygon: the outer one, or a hole that begins
    higher up.  So links from hole to hole have no circles, and are followed by doubling."""
    ring = F.col("ring")
    above = placed.where("hole").select(*key, "ring").distinct()
    above = above.select(*key, F.shiftright(ring, 33).cast("int").alias("row"), (F.shiftright(ring.bitwiseAND((1 << 33) - 1), 2) - HALF).cast("int").alias("col"), F.lit(1).alias("kind"), "ring", F.lit(None).cast("boolean").alias("hole"))
    west = placed.where("side = 3").select(*key, "row", "col", F.lit(0).alias("kind"), "ring", "hole")
    order = Window.partitionBy(*key, "row").orderBy("col", "kind")
    last = F.last(F.when(F.col("kind") == 0, F.struct("ring", "hole")), ignorenulls=True).over(order)
    state = west.unionByName(above).withColumn("to", last).where("kind = 1").select(*key, "ring", F.col("to.ring").alias("holder"), F.col("to.hole").alias("inner"))
    state = stored(state, "holders")
    while not state.where("inner").isEmpty():
        far = state.select(*key, F.col("ring").alias("holder"), F.col("holder").alias("_holder"), F.col("inner").alias("_inner"))
        state = stored(state.join(far.hint("merge"), [*key, "holder"], "left").select(*key, "ring", F.coalesce("_holder", "holder").alias("holder"), F.coalesce("_inner", F.lit(False)).alias("inner")), "holders")
    return state.select(*key, "ring", "holder")


def rings(cells: DataFrame, key: list[str]) -> DataFrame:
    """(key, ring, hole, holder, area, perimeter, corners): the rings around the cells of each
    key, and of holes the ring that holds them.

    ``area`` is in cells, negative for holes; ``corners`` are (row, col) of the grid's lines in
    order, only where the ring turns, without the first again at the end.  Rows with a null
    key or place are left out, repeated cells count once; no cells give no rings.
    """
    cells = cells.dropna(subset=[*key, "row", "col"])
    edges = stored(boundary(cells, key), "edges")
    placed = stored(edges.join(ringed(linked(edges, key), key).hint("merge"), [*key, "edge"]), "placed")
    # Twice the area by the cross products of corners, as whole numbers.
    twice = F.sum(F.col("c0").cast("long") * F.col("r1") - F.col("c1").cast("long") * F.col("r0"))
    order = Window.partitionBy(*key, "ring").orderBy(F.col("place").desc())
    before = F.lag("side").over(order)
    turns = placed.withColumn("_turn", before.isNull() | (F.col("side") != before))
    point = F.when(F.col("_turn"), F.struct((-F.col("place")).alias("at"), F.col("r0").alias("row"), F.col("c0").alias("col")))
    t = turns.groupBy(*key, "ring").agg(twice.alias("_twice"), F.count(F.lit(1)).alias("perimeter"), F.array_sort(F.collect_list(point)).alias("_points"), F.max_by("side", -F.col("place")).alias("_last"), F.max_by("side", "place").alias("_first"))
    t = t.withColumn("_points", F.when(F.col("_first") == F.col("_last"), F.slice("_points", 2, F.size("_points"))).otherwise(F.col("_points")))
    area = (F.col("_twice") / 2).cast("long")
    t = stored(t.select(*key, "ring", (area < 0).alias("hole"), area.alias("area"), "perimeter", F.transform("_points", lambda p: F.struct(p["row"].alias("row"), p["col"].alias("col"))).alias("corners")), "outlines")
    held = holders(placed.join(t.select(*key, "ring", "hole").hint("merge"), [*key, "ring"]), key)
    return t.join(held.hint("merge"), [*key, "ring"], "left").select(*key, "ring", "hole", "holder", "area", "perimeter", "corners")


def outline_sums(outlines: DataFrame, key: list[str]) -> DataFrame:
    """(key, area, perimeter, outer, holes) of all rings of a key."""
    return outlines.groupBy(*key).agg(F.sum("area").alias("area"), F.sum("perimeter").alias("perimeter"), F.count_if(~F.col("hole")).alias("outer"), F.count_if("hole").alias("holes"))


def centroids(outlines: DataFrame, key: list[str]) -> DataFrame:
    """(key, row, col): centre of mass of a key's polygons, holes taken off, in lines of the grid."""
    n = F.size("corners")
    pair = lambda f: F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0.0), lambda s, i: s + f(F.col("corners")[i], F.col("corners")[F.when(i + 1 < n, i + 1).otherwise(0)]))
    cross = lambda p, q: (p["col"] * q["row"] - q["col"] * p["row"]).cast("double")
    parts = outlines.select(*key, "area", *(pair(lambda p, q, c=c: (p[c] + q[c]) * cross(p, q)).alias(f"_{c}") for c in ("row", "col")))
    return parts.groupBy(*key).agg(*((F.sum(f"_{c}") / (6 * F.sum("area"))).alias(c) for c in ("row", "col")))


def as_parts(outlines: DataFrame, key: list[str], west: float, north: float, degrees: float) -> DataFrame:
    """(key, cells, parts): closed rings of (x, y) of each key, outer ones clockwise, each with
    its holes, which go the other way, after it."""
    point = lambda p: F.struct((F.lit(west) + p["col"] * degrees).alias("x"), (F.lit(north) - p["row"] * degrees).alias("y"))
    closed = F.transform(F.concat("corners", F.slice("corners", 1, 1)), point)
    ordered = F.struct(F.coalesce("holder", "ring").alias("of"), "hole", "ring", closed.alias("points"))
    t = outlines.groupBy(*key).agg(F.sum("area").alias("cells"), F.array_sort(F.collect_list(ordered)).alias("r"))
    return t.select(*key, "cells", F.transform("r", lambda r: r["points"]).alias("parts"))


def as_wkt(outlines: DataFrame, key: list[str], west: float, north: float, degrees: float) -> DataFrame:
    """(key, wkt): a multipolygon of each key, its holes in the rings that hold them."""
    num = lambda c: F.round(c.cast("double"), 10).cast("string")
    text = lambda p: F.concat(num(F.lit(west) + p["col"] * degrees), F.lit(" "), num(F.lit(north) - p["row"] * degrees))
    closed = F.concat("corners", F.slice("corners", 1, 1))
    rings_ = outlines.withColumn("text", F.concat(F.lit("("), F.array_join(F.transform(closed, text), ", "), F.lit(")")))
    holes = rings_.where("hole").groupBy(*key, F.col("holder").alias("ring")).agg(F.sort_array(F.collect_list("text")).alias("_holes"))
    polygons = rings_.where("not hole").join(holes, [*key, "ring"], "left")
    polygon = F.concat(F.lit("("), F.array_join(F.concat(F.array("text"), F.coalesce("_holes", F.array().cast("array<string>"))), ", "), F.lit(")"))
    many = polygons.groupBy(*key).agg(F.sort_array(F.collect_list(polygon)).alias("p"))
    return many.select(*key, F.concat(F.lit("MULTIPOLYGON ("), F.array_join("p", ", "), F.lit(")")).alias("wkt"))
