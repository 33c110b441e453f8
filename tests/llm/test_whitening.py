"""Whitening against numpy and exact whole numbers."""

import math

import numpy as np
import pytest

from tributary.llm import whitening as wh

SCHEMA = "vec_id long, embedding array<double>, label int, _x string, _id string, component string, n string"


def frame(spark, rows, schema=SCHEMA):
    return spark.createDataFrame([(i, v, 1, "a", "b", "c", "d") for i, v in rows], schema).repartition(3)


def expected(rows, components=4):
    """By length of vector: fit on distinct vectors with numpy, whole numbers in Python."""
    good = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    x = {k: tuple(math.floor(256 * c) for c in v) for k, (i, v) in enumerate(good)}
    out = []
    for dims in {len(v) for v in x.values()}:
        fit = sorted({v for v in x.values() if len(v) == dims})
        n, sums = len(fit), [sum(c) for c in zip(*fit)]
        m = np.array(fit, float).reshape(n, dims)
        cov = (m - m.mean(0)).T @ (m - m.mean(0)) / n
        values, axes = np.linalg.eigh(cov)
        values, axes = values[::-1], axes[:, ::-1]
        for k, v in x.items():
            if len(v) == dims:
                deviation = sum((n * a - s) ** 2 for a, s in zip(v, sums))
                for c in range(min(components, dims)):
                    w = (np.array(v, float) - m.mean(0)) @ axes[:, c] / np.sqrt(values[c]) if values[c] > 1e-9 else None
                    out.append((good[k][0], c + 1, n, deviation, w, values[c] / values.sum() if values.sum() else 0.0))
    return out


def check(df, rows, tolerance=1e-8):
    got = sorted(map(tuple, df.collect()), key=lambda r: (str(r[0]), r[1], r[3] or 0, abs(r[4] or 0)))
    want = sorted(expected(rows), key=lambda r: (str(r[0]), r[1], r[3], abs(r[4] or 0)))
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert [g[3] for g in got] == [w[3] if w[3] < 2**63 else None for w in want]
    signs = {}
    for g, w in zip(got, want):
        assert (g[4] is None) == (w[4] is None)
        if g[4] is not None and abs(w[4]) > 1e-3:
            signs.setdefault((g[1], g[2]), set()).add(np.sign(g[4] * w[4]))
        assert abs(abs(g[4] or 0) - abs(w[4] or 0)) < tolerance and abs(g[5] - w[5]) < 1e-10
        assert g[6] <= 1e-4
    assert all(len(s) == 1 for s in signs.values())


def test_given_embeddings(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows = [(r.vec_id, list(r.embedding)) for r in table.collect()]
    check(wh.whitened(table), rows)


def odd():
    rng = np.random.default_rng(3)
    rows = [(i, (rng.normal(size=6) * [4, 3, 2, 1, 0.5, 0.1]).tolist()) for i in range(200)]
    rows += [(300 + i, rows[0][1]) for i in range(50)] + [rows[1]] * 3 + [(None, rows[2][1])]
    rows += [(400, None), (401, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (402, [math.nan] * 6), (403, [math.inf] + [0.0] * 5), (404, [-0.0] * 6)]
    return rows


def test_odd_rows(spark):
    check(wh.whitened(frame(spark, odd())), odd())


def test_lengths_of_their_own(spark):
    rows = odd() + [(500, [1.0, 2.0]), (501, [2.0, 1.0]), (502, [0.0, 5.0]), (503, []), (504, [7.0])]
    check(wh.whitened(frame(spark, rows)), rows)


@pytest.mark.parametrize("rows", [[(1, [0.5] * 6)], [(1, [0.5, 1.0]), (2, [0.5, 3.0]), (3, [0.5, 2.0])]])
def test_no_variance(spark, rows):
    check(wh.whitened(frame(spark, rows)), rows)


def test_no_rows(spark):
    assert wh.whitened(frame(spark, [])).count() == 0
    assert wh.whitened(frame(spark, [(1, None)])).count() == 0


def test_large_entries(spark):
    """Deviations are exact beyond 2**53 and null beyond a long."""
    rows = [(i, [1e3 * i + i % 7, float(i * i)]) for i in range(60)] + [(99, [1e6, 0.0])]
    check(wh.whitened(frame(spark, rows)), rows, tolerance=1e-6)
    huge = wh.whitened(frame(spark, [(1, [1e300, 0.0]), (2, [0.0, 1.0])])).collect()
    assert len(huge) == 4 and all(r["deviation"] is None for r in huge)


def test_merged_moments_equal_one_pass():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(500, 5)) + 1e6
    whole, parts = wh.Moments(5), [wh.Moments(5) for _ in range(7)]
    for i, v in enumerate(x):
        whole.add(v)
        parts[i % 7].add(v)
    total = parts[0]
    for p in parts[1:]:
        total.merge(p)
    cov = np.cov(x.T, bias=True)
    assert np.allclose(whole.m2 / 500, cov, rtol=1e-9, atol=1e-9) and np.allclose(total.m2 / 500, cov, rtol=1e-9, atol=1e-9)


def test_symmetric_qr():
    rng = np.random.default_rng(5)
    cases = [np.zeros((0, 0)), np.zeros((3, 3)), np.eye(4), np.diag([1.0, 1, 2, 5]), np.array([[2.0]]), np.array([[0.0, 1], [1, 0]])]
    cases += [(m := rng.normal(size=(d, d))) + m.T for d in (2, 3, 10, 64, 150)] + [np.outer(v := rng.normal(size=9), v)]
    for a in cases:
        values, axes = wh.symmetric_qr(a)
        scale = np.abs(a).max(initial=1)
        assert np.allclose(values, np.sort(np.linalg.eigvalsh(a))[::-1], atol=1e-12 * scale * max(1, len(a)))
        assert np.allclose(axes @ axes.T, np.eye(len(a)), atol=1e-12 * max(1, len(a)))
        assert np.allclose(a @ axes.T, axes.T * values, atol=1e-12 * scale * max(1, len(a)))


def test_many_states_are_merged_in_levels(spark, monkeypatch):
    monkeypatch.setattr(wh, "MERGED_AT_ONCE", 2)
    check(wh.whitened(frame(spark, odd())), odd())
