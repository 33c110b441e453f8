"""Many outlets at once against one outlet after another on plain grids."""

import math

import numpy as np
import pytest

from tests.core.test_terrain import D8, plain
from tributary.operators import delineation

RULES = delineation.Rules(degrees=0.01, window=0.05, window_step=0.05, window_most=0.10, radius=0.04, radius_least=0.01, least_area=6.0, streams=(25, 8))


def one_after_another(z, outlets, rules):
    done, out = {}, {}
    for outlet in sorted(outlets):
        row, col = outlets[outlet]
        window, radius, tries = rules.window, rules.radius, 1
        while window <= rules.window_most:
            reach = round(window / rules.degrees)
            part = {p: h for p, h in z.items() if abs(p[0] - row) <= reach and abs(p[1] - col) <= reach}
            wider = round(window + rules.window_step, 2)
            flow = {p: (p[0] + D8[c][0], p[1] + D8[c][1]) for p, (_, c, _) in plain(part).items()}
            acc = dict.fromkeys(flow, 0)
            for p in flow:
                while p in flow:
                    acc[p] += 1
                    p = flow[p]
            r = max(1, int(radius / rules.degrees + 1e-9))
            near = [(p, a) for p, a in acc.items() if -r <= p[0] - row < r and -r <= p[1] - col < r]
            at = None
            for least in sorted(rules.streams, reverse=True):
                some = [((p[0] - row) ** 2 + (p[1] - col) ** 2, *p) for p, a in near if a >= least]
                if some:
                    at, threshold = min(some)[1:], least
                    break
            if at is None:
                window = wider
                continue
            cells = set()
            for p in flow:
                q = p
                while q in flow and q != at:
                    q = flow[q]
                if q == at:
                    cells.add(p)
            rows, cols = [p[0] for p in part], [p[1] for p in part]
            edge = any(p[0] in (min(rows), max(rows)) or p[1] in (min(cols), max(cols)) for p in cells)
            if len(cells) * rules.cell_km2() < rules.least_area or edge:
                window = wider
                continue
            shares = [100 * len(cells & other) / min(len(cells), len(other)) for other in done.values()]
            half = round(radius * 0.5, 4)
            if any(rules.overlap[0] < s < rules.overlap[1] for s in shares) and half >= rules.radius_least:
                radius, tries = half, tries + 1
                continue
            done[outlet] = cells
            out[outlet] = ("SUCCESS", window, radius, *at, threshold, len(cells), tries)
            break
        else:
            out[outlet] = ("FAILED",)
    return out, done


def hills(seed, rows, cols):
    rng = np.random.default_rng(seed)
    r, c = np.mgrid[:rows, :cols]
    z = 30 + 6 * np.sin(r / 5) + 5 * np.cos(c / 7 + r / 9) + rng.integers(0, 4, (rows, cols))
    return {(i, j): float(np.round(z[i, j])) for i in range(rows) for j in range(cols)}


@pytest.mark.parametrize("seed", [1])
def test_equals_one_after_another(spark, seed):
    rng = np.random.default_rng(seed)
    z = hills(seed, 40, 40)
    outlets = {i: (int(rng.integers(8, 32)), int(rng.integers(8, 32))) for i in range(16)}
    outlets[20] = (500, 500)
    want, cells = one_after_another(z, outlets, RULES)
    df = spark.createDataFrame([(r, c, h) for (r, c), h in z.items()], "row int, col int, z double").repartition(3)
    given = spark.createDataFrame([(o, r, c) for o, (r, c) in outlets.items()], "outlet int, row int, col int")
    table, inside = delineation.delineated(df, given, RULES, side=16)
    got = {}
    for r in table.collect():
        got[r.outlet] = ("SUCCESS", r.window, r.radius, r.snap_row, r.snap_col, r.threshold, r.cells, r.tries) if r.status == "SUCCESS" else ("FAILED",)
    assert got == want
    found = {}
    for r in inside.collect():
        found.setdefault(r.outlet, set()).add((r.row, r.col))
    assert found == cells
    kinds = {x[0] for x in want.values()}
    assert kinds == {"SUCCESS", "FAILED"} and {1, 2, 3} == {x[-1] for x in want.values() if len(x) > 1}


def test_small_windows_are_one_task_each(spark, monkeypatch):
    """No rounds over all windows' cells, and the same results."""

    def no_rounds(*args, **kwargs):
        raise AssertionError("tiles")

    z = hills(2, 40, 40)
    outlets = {i: (8 + 5 * i % 24, 8 + 7 * i % 24) for i in range(12)}
    want, cells = one_after_another(z, outlets, RULES)
    df = spark.createDataFrame([(r, c, h) for (r, c), h in z.items()], "row int, col int, z double")
    given = spark.createDataFrame([(o, r, c) for o, (r, c) in outlets.items()], "outlet int, row int, col int")
    monkeypatch.setattr(delineation.terrain, "conditioned", no_rounds)
    table, inside = delineation.delineated(df, given, RULES)
    got = {r.outlet: ("SUCCESS", r.window, r.radius, r.snap_row, r.snap_col, r.threshold, r.cells, r.tries) if r.status == "SUCCESS" else ("FAILED",) for r in table.collect()}
    assert got == want
    assert {(r.outlet, r.row, r.col) for r in inside.collect()} == {(o, *p) for o, own in cells.items() for p in own}


def test_no_outlets(spark):
    cells = spark.createDataFrame([(0, 0, 1.0)], "row int, col int, z double")
    none = spark.createDataFrame([], "outlet int, row int, col int")
    table, inside = delineation.delineated(cells, none, RULES)
    assert table.count() == 0 and inside.count() == 0


def test_radii():
    assert delineation.Rules(degrees=0.001).radii() == [0.05, 0.025, 0.0125, 0.0063]
    assert math.isclose(delineation.Rules(degrees=1 / 111).cell_km2(), 1.0)
