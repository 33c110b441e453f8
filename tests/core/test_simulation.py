"""Regions simulated by blocks against the same regions in one task."""

import numpy as np
import pytest

from tributary.functions.distributions import drawn_ratios, lmoment_ratios, parent
from tributary.operators import homogeneity, simulation


def members_of(spark, regions):
    rows = [(name, s, int(n), *map(float, r)) for name, ratios, years in regions for s, (r, n) in enumerate(zip(ratios, years))]
    return spark.createDataFrame(rows, "region string, station long, n long, t double, t3 double, t4 double")


def planted(rng, sites, center=(0.25, 0.2, 0.15), spread=0.02):
    return np.array(center) + rng.normal(0, spread, (sites, 3)), rng.integers(8, 40, sites)


def test_draws_of_a_block_are_those_of_the_region():
    rng = np.random.default_rng(3)
    ratios, years = planted(rng, 9)
    sites = homogeneity.Sites(ratios, years.astype(float))
    whole, _ = sites.simulated(20, 5)
    part = simulation.draws(parent(*sites.means), years[4:7], int(years[:4].sum()), 20, 5)
    assert np.array_equal(part, whole[:, 4:7])


def test_blocks_give_the_same_results(spark, monkeypatch):
    """Regions just over and under the bound, one of a site, one without a parent, a null name,
    sites without ratios, extra columns."""
    rng = np.random.default_rng(8)
    regions = [("big", *planted(rng, 70)), ("small", *planted(rng, 6)), ("one", *planted(rng, 1)), ("wild", *planted(rng, 30, (0.3, 0.99, -0.9), 0)), (None, *planted(rng, 25))]
    rows = members_of(spark, regions)
    gap = spark.createDataFrame([("big", 1000, 10, None, 0.1, 0.1)], rows.schema)
    members = rows.unionByName(gap).selectExpr("*", "1 AS _block", "'x' AS sites").repartition(5)
    one_task = [homogeneity.region_heterogeneity, homogeneity.region_fits, homogeneity.polynomial_goodness]
    want = [{r.region: r for r in f(members, nsim=40).collect()} for f in one_task]
    monkeypatch.setattr(homogeneity, "MOST_SITES", 20)
    monkeypatch.setattr(simulation, "BLOCK", 16)
    for f, expected in zip(one_task, want):
        got = {r.region: r for r in f(members, nsim=40).collect()}
        assert got.keys() == expected.keys() == {"big", "small", "one", "wild", None}
        for region, row in expected.items():
            for x, y in zip(got[region], row):
                if isinstance(y, float):
                    # The means' last digits differ; the solver of the parent's shapes magnifies that.
                    assert x == pytest.approx(y, rel=1e-6, abs=1e-7, nan_ok=True)
                else:
                    assert x == y
    assert want[0]["big"].sites == 70 and np.isfinite(want[0]["big"].h1)


@pytest.mark.parametrize("ratios", [(0.2, 0.15, 0.15), (0.2, 0.1, 0.02), (0.2, 0.17, 0.17), (0.2, 0.3, 0.4)])
def test_draws_are_quantiles_of_the_stream(ratios):
    source, n, nsim = parent(*ratios), 30, 50
    stream = np.random.default_rng(5).random(nsim * 70)[nsim * 40 :]
    want = lmoment_ratios(source.quantile(stream.reshape(nsim, n)))
    assert np.allclose(drawn_ratios(source, 5, nsim, n, 40), want, rtol=1e-9, atol=1e-12)


def test_equal_regions_are_simulated_once(monkeypatch):
    calls, draws = [], simulation.draws
    monkeypatch.setattr(simulation, "draws", lambda *args: calls.append(args) or draws(*args))
    ratios, years = planted(np.random.default_rng(11), 6)
    found = [homogeneity.heterogeneity(homogeneity.Sites(ratios.copy(), years.astype(float)), 30) for _ in range(3)]
    other = homogeneity.heterogeneity(homogeneity.Sites(ratios[::-1], years[::-1].astype(float)), 30)
    assert found[0] == found[1] == found[2] != other
    assert len(calls) == 2


def test_h1_alone_takes_one_pass(spark, monkeypatch):
    """H1 by blocks from one pass is that of all three; draws are not made twice."""
    rng = np.random.default_rng(4)
    regions = [("big", *planted(rng, 70)), ("small", *planted(rng, 6)), ("one", *planted(rng, 1)), ("wild", *planted(rng, 30, (0.3, 0.99, -0.9), 0)), (None, *planted(rng, 25))]
    members = members_of(spark, regions)
    found = lambda df: {r.region: np.nan if r.h1 is None else r.h1 for r in df.collect()}
    want = found(homogeneity.region_heterogeneity(members, nsim=40))
    monkeypatch.setattr(homogeneity, "MOST_SITES", 20)
    monkeypatch.setattr(simulation, "BLOCK", 16)
    monkeypatch.setattr(simulation.Blocks, "means", None)  # the first of two passes
    got = found(homogeneity.region_h1(members, nsim=40))
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], rel=1e-6, abs=1e-7, nan_ok=True) for k in want)
