"""Outlines of cells against counts, known shapes and a fill by even crossings."""

import numpy as np
import pytest

from tributary.operators import outlines


def outlined(spark, shapes, null=()):
    rows = [(k, r, c) for k, cells in shapes.items() for r, c in cells] + list(null)
    return outlines.rings(spark.createDataFrame(rows, "name string, row int, col int").repartition(3), ["name"])


def inside(corners, y, x):
    n, hits = len(corners), 0
    for i in range(n):
        (a, p), (b, q) = corners[i], corners[(i + 1) % n]
        if (a > y) != (b > y) and p < x:
            hits += 1
    return hits % 2 == 1


def shapes():
    rng = np.random.default_rng(5)
    out = {"one": {(0, 0)}, "bar": {(2, c) for c in range(7)}, "corner": {(0, 0), (1, 1)}}
    out["frame"] = {(r, c) for r in range(5) for c in range(6)} - {(2, 2), (2, 3)}
    # a hole in which an island with a hole lies, and two holes that touch at a corner
    out["nested"] = {(r, c) for r in range(-4, 9) for c in range(-3, 10)} - {(r, c) for r in range(-2, 7) for c in range(-1, 8)} | ({(r, c) for r in range(0, 5) for c in range(1, 6)} - {(2, 3)})
    out["pinched"] = {(r, c) for r in range(6) for c in range(6)} - {(2, 2), (3, 3)}
    # holes whose way west leads over other holes
    out["chain"] = {(r, c) for r in range(12) for c in range(12)} - {(r, 2) for r in range(1, 10)} - {(r, 5) for r in range(3, 8)} - {(5, 8)}
    for k, share in enumerate((0.3, 0.5, 0.7, 0.9)):
        out[f"noise{k}"] = {(int(r), int(c)) for r, c in zip(*np.nonzero(rng.random((17, 14)) < share))}
    return out


def components(cells, ways):
    left, n = set(cells), 0
    while left:
        n += 1
        todo = [left.pop()]
        while todo:
            r, c = todo.pop()
            for a, b in ways:
                if (r + a, c + b) in left:
                    left.remove((r + a, c + b))
                    todo.append((r + a, c + b))
    return n


FOUR = [(0, 1), (1, 0), (0, -1), (-1, 0)]
EIGHT = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b]


def test_rings(spark):
    given = shapes()
    rows = outlined(spark, given, [("one", 0, 0), (None, 1, 1), ("one", None, 3)]).collect()
    by = {}
    for r in rows:
        by.setdefault(r.name, []).append(r)
    assert set(by) == set(given)
    for name, cells in given.items():
        rs = by[name]
        assert sum(r.area for r in rs) == len(cells)
        assert sum(r.perimeter for r in rs) == sum((r + a, c + b) not in cells for r, c in cells for a, b in FOUR)
        assert sum(not r.hole for r in rs) == components(cells, FOUR)
        box = {(r, c) for r in range(-6, 20) for c in range(-6, 20)}
        assert sum(r.hole for r in rs) == components(box - cells, EIGHT) - 1
        polygons = [[(p.row, p.col) for p in r.corners] for r in rs]
        for p in polygons:  # corners only, alternately along rows and columns
            assert all((p[i - 1][0] == p[i][0]) != (p[i][0] == p[(i + 1) % len(p)][0]) for i in range(len(p)))
        for r, c in box:
            assert (sum(inside(p, r + 0.5, c + 0.5) for p in polygons) % 2 == 1) == ((r, c) in cells)
        outer = {r.ring: r for r in rs if not r.hole}
        for r in rs:
            assert (r.holder is None) == (not r.hole)
            if r.hole:  # the smallest outer ring around the cell above the hole's least edge
                at = (r.ring >> 33) + 0.5, ((r.ring & (1 << 33) - 1) >> 2) - (1 << 30) + 0.5
                around = [o for o in outer.values() if inside([(p.row, p.col) for p in o.corners], *at)]
                assert r.holder == min(around, key=lambda o: o.area).ring


def test_sums_centres_and_text(spark):
    given = shapes()
    found = outlined(spark, given)
    sums = {r.name: r for r in outlines.outline_sums(found, ["name"]).collect()}
    assert (sums["nested"].outer, sums["nested"].holes) == (2, 2)
    assert (sums["corner"].outer, sums["pinched"].holes) == (2, 1)
    for r in outlines.centroids(found, ["name"]).collect():
        mean = np.mean(list(given[r.name]), axis=0) + 0.5
        assert (r.row, r.col) == pytest.approx(tuple(mean))
    wkt = {r.name: r.wkt for r in outlines.as_wkt(found, ["name"], 70.0, 20.0, 0.5).collect()}
    assert wkt["one"] == "MULTIPOLYGON (((70.0 20.0, 70.5 20.0, 70.5 19.5, 70.0 19.5, 70.0 20.0)))"
    assert wkt["nested"].count("((") == 2 and wkt["chain"].count("), (") == 3


def test_no_cells(spark):
    assert outlined(spark, {}).count() == 0


def test_edges_are_not_broadcast(spark):
    """Compressed files of edges look small; none of them goes through the driver."""
    cells = spark.range(40).selectExpr("0 as basin", "int(id div 8) as row", "int(id % 8) as col")
    edges = outlines.boundary(cells, ["basin"])
    for df in (outlines.linked(edges, ["basin"]), outlines.rings(cells, ["basin"])):
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
