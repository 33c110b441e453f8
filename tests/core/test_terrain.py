"""Conditioning of heights against a plain flood of the whole grid."""

import heapq

import numpy as np
import pytest

from tributary.operators import raster, terrain

D8 = {1: (0, 1), 2: (1, 1), 4: (1, 0), 8: (1, -1), 16: (0, -1), 32: (-1, -1), 64: (-1, 0), 128: (-1, 1)}


def plain(z):
    """Of {(row, col): height}: filled heights, steps and codes."""
    beside = lambda p: [((p[0] + a, p[1] + b), c, (a * a + b * b) ** 0.5) for c, (a, b) in D8.items()]
    level, heap = {}, [(h, p) for p, h in z.items() if any(q not in z for q, _, _ in beside(p))]
    heapq.heapify(heap)
    while heap:
        h, p = heapq.heappop(heap)
        if p not in level:
            level[p] = h
            for q, _, _ in beside(p):
                if q in z and q not in level:
                    heapq.heappush(heap, (max(h, z[q]), q))
    code, steps = {}, {}
    for p, h in level.items():
        down = [((h - level[q]) / far, -c) for q, c, far in beside(p) if q in level and level[q] < h]
        out = [c for q, c, _ in beside(p) if q not in level]
        if down or out:
            code[p], steps[p] = -max(down)[1] if down else min(out), 0
    ring = list(steps)
    while ring:
        after = []
        for p in ring:
            for q, _, _ in beside(p):
                if q in level and q not in steps and level[q] == level[p]:
                    steps[q] = steps[p] + 1
                    after.append(q)
        ring = after
    for p in level:
        if p not in code:
            code[p] = min((steps[q], c) for q, c, _ in beside(p) if q in level and level[q] == level[p])[1]
    return {p: (level[p], code[p], float(steps[p])) for p in z}


def grid(rng, rows, cols, kind, row0=0, col0=0):
    if kind == "random":
        z = rng.integers(0, 6, (rows, cols)).astype(float)
    elif kind == "bowls":  # pits in pits
        r, c = np.mgrid[:rows, :cols]
        z = np.round(((r - rows / 2) ** 2 + (c - cols / 2) ** 2) ** 0.5) + rng.integers(0, 3, (rows, cols))
    elif kind == "lake":
        z = np.ones((rows, cols))
        z[0], z[-1], z[:, 0], z[:, -1] = 5, 5, 5, 5
        z[0, cols // 3] = 1
    else:  # a winding valley that only leads out at its end
        z = np.full((rows, cols), 9.0)
        for r in range(1, rows - 1, 2):
            z[r, 1:-1] = 3.0 - r / 100
            z[r + 1, cols - 2 if r % 4 == 1 else 1] = 3.0 - r / 100
    return {(r + row0, c + col0): float(z[r, c]) for r in range(rows) for c in range(cols)}


def frame(spark, z, extra=()):
    return spark.createDataFrame([(r, c, h) for (r, c), h in z.items()] + list(extra), "row int, col int, z double").repartition(4)


@pytest.mark.parametrize("kind", ["random", "bowls", "lake", "valley"])
@pytest.mark.parametrize("side", [3, 64])
def test_equals_plain_flood(spark, kind, side):
    rng = np.random.default_rng(7)
    z = grid(rng, 23, 31, kind, -5, -7)
    for p in list(z):
        if kind in ("random", "bowls") and rng.random() < 0.02:
            del z[p]
    got = {(r.row, r.col): (r.filled, r.fdir, r.steps) for r in terrain.conditioned(frame(spark, z), side=side).collect()}
    assert got == plain(z)


def test_many_levels(spark):
    """Tiles of two cells: five levels of passes."""
    z = grid(np.random.default_rng(8), 70, 40, "random")
    got = {(r.row, r.col): r.filled for r in terrain.filled(frame(spark, z), side=2).collect()}
    assert got == {p: x[0] for p, x in plain(z).items()}


def test_grids_by_key(spark):
    rng = np.random.default_rng(9)
    grids = {k: grid(rng, 9 + k, 12, "random", 3 * k, k) for k in range(4)}
    rows = [(k, r, c, h) for k, z in grids.items() for (r, c), h in z.items()]
    df = spark.createDataFrame(rows, "name int, row int, col int, z double")
    got = {(r.name, r.row, r.col): (r.filled, r.fdir, r.steps) for r in terrain.conditioned(df, ("name",), side=4).collect()}
    assert got == {(k, *p): x for k, z in grids.items() for p, x in plain(z).items()}


def test_odd_cells(spark):
    z = grid(np.random.default_rng(10), 8, 8, "random")
    extra = [(0, 0, 99.0), (3, 3, None), (20, 20, None), (30, 30, 4.0), (30, 30, 4.0)]
    z[(30, 30)] = 4.0
    want = plain(z)
    rows = terrain.filled(frame(spark, z, extra), side=4).collect()
    got = {(r.row, r.col): r.filled for r in rows}
    assert len(rows) == len(got) and got == {p: x[0] for p, x in want.items()} | {(20, 20): None}
    assert terrain.conditioned(frame(spark, {})).count() == 0


def test_every_cell_drains(spark):
    z = grid(np.random.default_rng(11), 30, 30, "bowls")
    flow = terrain.conditioned(frame(spark, z), side=8)
    leaving = sum(1 for r in flow.collect() if (r.row + D8[r.fdir][0], r.col + D8[r.fdir][1]) not in z)
    acc = {(r.row, r.col): r.acc for r in raster.accumulation(flow).collect()}
    out = [p for r in flow.collect() if (p := (r.row, r.col)) and (r.row + D8[r.fdir][0], r.col + D8[r.fdir][1]) not in z]
    assert leaving == len(out) and sum(acc[p] for p in out) == len(z)


def test_tile_is_as_small_as_its_cells():
    """Also where some of them are its margin."""
    tile = terrain.Tile([255, 255, 256], [7, 8, 7], {"z": [1.0, 2.0, 3.0]}, 0, 0, 256)
    assert len(tile.values["z"]) == 4 * 4
    assert tile.rows.tolist() == [255, 255] and tile.cols.tolist() == [7, 8]
