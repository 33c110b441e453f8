import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tributary.functions import blocks, special
from tributary.functions import distributions as dist
from tributary.functions.distributions import FAMILIES, fitted, kappa_ratios, lmoment_ratios, solve_kappa
from tributary.operators import cluster, homogeneity, indexflood, lmoments, maxima, names, raster, roi, selection, space, trials, validate
from tributary.operators.homogeneity import Sites, heterogeneity
from tributary.streaming import maxima as streaming


def test_tails():
    assert special.t_tail(4.563450, 83) == pytest.approx(1.72469e-05, rel=1e-4)
    assert special.f_tail(4.563450**2, 1, 83) == pytest.approx(1.72469e-05, rel=1e-4)
    for a, p in ((0.3, 0.1), (2.0, 0.5), (50.0, 0.99), (400.0, 1e-4)):
        assert special.incomplete_gamma(a, special.gamma_quantile(a, p)) == pytest.approx(p, rel=1e-9)
    assert special.gamma_quantile(1.0, 0.5) == pytest.approx(math.log(2))


def test_kappa_round_trip():
    for k, h in ((0.1, 0.0), (-0.1, -0.5), (0.3, 0.7), (-0.2, 0.3), (0.05, -0.9), (0.4, 2.0), (-0.4, 0.1), (0.0, 1.0)):
        got = solve_kappa(*kappa_ratios(k, h))
        assert got and got == pytest.approx((dist.off_zero(k), h), abs=2e-3)
        assert kappa_ratios(*got) == pytest.approx(kappa_ratios(k, h), abs=1e-6)
    assert solve_kappa(0.2, 0.5) is None and solve_kappa(math.nan, 0.1) is None and solve_kappa(0.1, -0.4) is None
    assert dist.parent(0.2, 0.2, 0.5).family == "GLO"


def test_kappa_integrals_by_sums():
    f = (np.arange(400_000) + 0.5) / 400_000
    for k, h in ((0.2, 0.5), (0.3, -0.4), (0.1, 0.0), (-0.2, 1.5)):
        y = -np.log(f) if h == 0 else (1 - f**h) / h
        want = [r * np.mean(f ** (r - 1) * y**k) for r in range(1, 5)]
        assert dist.kappa_integrals(k, h) == pytest.approx(want, rel=2e-3)
    assert dist.kappa_integrals(2.0, -0.6) is None


@pytest.mark.parametrize("family", FAMILIES)
@pytest.mark.parametrize("t3", [-0.1, 0.03, 0.15, 0.5])
def test_families_keep_moments(family, t3):
    """Moments of each fitted quantile function, by integration on the grid."""
    fit = fitted(family, 0.3, t3)
    if family == "GPA" and t3 < 0.0256:
        assert fit is None
        return
    f = dist.grid_probabilities()[::10] if family == "PE3" else dist.grid_probabilities()
    step = np.full(len(f), f[1] - f[0])
    step[[0, -1]] /= 2
    x = fit.quantile(f) * step
    l1, l2, l3, l4 = x.sum(), ((2 * f - 1) * x).sum(), ((6 * f**2 - 6 * f + 1) * x).sum(), ((20 * f**3 - 30 * f**2 + 12 * f - 1) * x).sum()
    near = 2e-2 if t3 == 0.5 else 4e-3  # the grid ends before the tails do
    assert (l1, l2 / l1, l3 / l2, l4 / l2) == pytest.approx((1, 0.3, t3, fit.kurtosis), abs=near)


def test_kurtosis_near_the_published_approximations():
    for family in FAMILIES:
        for t3 in (0.05, 0.2, 0.35):
            assert fitted(family, 0.3, t3).kurtosis == pytest.approx(homogeneity.polynomial_kurtosis(family, t3), abs=1e-3)
    assert fitted("GNO", 0.2, 1e-9).kurtosis == pytest.approx(0.1226, abs=1e-3)
    assert fitted("PE3", 0.2, 0.0).kurtosis == pytest.approx(0.1226, abs=1e-4)
    assert fitted("PE3", 0.2, 1e-5).kurtosis == pytest.approx(fitted("PE3", 0.2, 0.0).kurtosis, abs=1e-3)


def test_gev_approximation():
    fit = fitted("GEV", 0.3, 0.2)
    location, scale, k = dist.gev_by_approximation(1.0, 0.3, 0.2)
    assert (location, scale, k) == pytest.approx((fit.location, fit.scale, fit.shape), abs=2e-3)


def region(rng, n_sites, n, double=0):
    fit = fitted("GEV", 0.25, 0.17)
    out = []
    for i in range(n_sites):
        x = np.array([fit.quantile(float(u)) for u in rng.random(n)])
        if i < double:
            x = 1 + 2 * (x - 1)
        out.append(lmoment_ratios((x * (i + 1))[None])[0])
    return np.array(out), np.full(n_sites, float(n))


def test_heterogeneity_and_discordancy():
    rng = np.random.default_rng(4)
    ratios, n = region(rng, 15, 40)
    assert heterogeneity(Sites(ratios, n)).h1 < 1.5
    assert heterogeneity(Sites(ratios, n)) == heterogeneity(Sites(ratios, n))
    mixed, n = region(rng, 15, 40, double=7)
    assert heterogeneity(Sites(mixed, n)).h1 > 2
    assert np.isnan(heterogeneity(Sites(ratios[:1], n[:1])).h1)
    di = Sites(ratios, n).discordancy()
    off = ratios - ratios.mean(0)
    assert di == pytest.approx(15 / 3 * np.einsum("ij,jk,ik->i", off, np.linalg.inv(off.T @ off), off))
    assert di.sum() == pytest.approx(15) and di.argmax() != 3
    ratios[3, 1] = 0.9
    assert Sites(ratios, n).discordancy().argmax() == 3
    assert np.isnan(Sites(ratios[:4], n[:4]).discordancy()).all()


def test_dispersion_by_loops():
    rng = np.random.default_rng(6)
    sites = Sites(rng.random((4, 3)), np.array([10.0, 20.0, 30.0, 5.0]))
    w = sites.years / sites.years.sum()
    mean = sum(a * r for a, r in zip(w, sites.ratios))
    v1 = math.sqrt(sum(a * (r[0] - mean[0]) ** 2 for a, r in zip(w, sites.ratios)))
    v2 = sum(a * math.hypot(r[0] - mean[0], r[1] - mean[1]) for a, r in zip(w, sites.ratios))
    v3 = sum(a * math.hypot(r[1] - mean[1], r[2] - mean[2]) for a, r in zip(w, sites.ratios))
    assert sites.dispersion(sites.ratios) == pytest.approx([v1, v2, v3])
    stacked = np.stack([sites.ratios, sites.ratios * 2])
    assert sites.dispersion(stacked)[1] == pytest.approx([2 * v1, 2 * v2, 2 * v3])


def test_choice_finds_the_family():
    rng = np.random.default_rng(9)
    source = fitted("GPA", 0.25, 0.2)
    ratios = np.concatenate([lmoment_ratios(source.quantile(rng.random((1, 60)))) for _ in range(25)])
    c = homogeneity.choose(Sites(ratios, np.full(25, 60.0)))
    assert c.family == "GPA" and c.accepted and abs(c.z["GPA"]) < 1.64 < abs(c.z["GLO"])
    assert c.curve[100] == pytest.approx(source.quantile(0.99), rel=0.1)


def test_growth_rules():
    rng = np.random.default_rng(7)
    ratios, n = region(rng, 20, 40)
    z = rng.normal(size=(20, 3))
    grown = roi.grow(0, z, ratios, n)
    members = grown.members
    assert members[0] == 0 and n[members].sum() >= 500 and len(members) == len(set(members)) and not set(members) & set(grown.excluded())
    masked = roi.grow(0, z, ratios, n, roi.Rules(use_target_flow=False)).members
    changed = ratios.copy()
    changed[0] = 0.9
    assert roi.grow(0, z, changed, n, roi.Rules(use_target_flow=False)).members == masked
    wild = ratios.copy()
    wild[:, 0] = np.where(np.arange(20) % 2, 0.1, 0.6)
    assert roi.grow(0, z, wild, n).excluded()
    pool, h1 = roi.trimmed(Sites(ratios, n), 500)
    assert 5 <= len(pool) <= 20 and h1 == heterogeneity(pool, 200).h1


def test_growth_step_by_step():
    """The record of steps tells the whole story: replayed, it gives the members; each step's
    candidate was the nearest one untried, and its test says what was done."""
    rng = np.random.default_rng(12)
    ratios, n = region(rng, 40, 30, double=9)
    z = rng.normal(size=(40, 4))
    rules = roi.Rules(nsim_grow=60)
    seen = set()
    for target in range(12):
        grown = roi.grow(target, z, ratios, n, rules)
        members, tried = [target], {target}
        for s in grown.steps:
            gaps = ((z - z[members].mean(0)) ** 2).sum(1)
            gaps[list(tried)] = np.inf
            assert s.candidate == gaps.argmin()
            tried.add(s.candidate)
            trial = [*members, s.candidate]
            if s.reason == "discordant":
                assert len(trial) >= 7 and s.di > homogeneity.critical(len(trial))
            if s.reason.startswith("heterogeneous"):
                assert s.h1 >= 1 and s.h1 == heterogeneity(Sites(ratios[trial], n[trial]), 60).h1 and (len(trial) == 5) == (s.action == "swap")
            if s.action == "swap":
                mean = (ratios[trial, 0] * n[trial]).sum() / n[trial].sum()
                others = [i for i in trial if i != target]
                assert s.left_out == max(others, key=lambda i: abs(ratios[i, 0] - mean))
            members = trial if s.action == "add" else [i for i in trial if i != s.left_out] if s.action == "swap" else members
            assert (s.size, s.years) == (len(members), n[members].sum())
            seen.add(s.reason)
        assert members == grown.members
    assert seen >= {"", "discordant", "heterogeneous", "heterogeneous seed"}


def stations_of(spark, ratios, n, z):
    rows = [(i, *map(float, a), int(k), *map(float, r)) for i, (a, k, r) in enumerate(zip(z, n, ratios))]
    return spark.createDataFrame(rows, "station long, a double, b double, c double, n long, t double, t3 double, t4 double")


def test_regions_to_curves(spark):
    """The chain from stations to fits, against the same steps by hand."""
    rng = np.random.default_rng(13)
    ratios, n = region(rng, 14, 60)
    z = rng.normal(size=(14, 3))
    table = stations_of(spark, ratios, n, z)
    regions = roi.grown_regions(table, list("abc")).cache()
    by = {r.station: r for r in regions.collect()}
    for i in (0, 5):
        grown = roi.grow(i, z, ratios, n)
        sites = Sites(ratios[grown.members], n[grown.members])
        assert by[i].members == grown.members and by[i].h1 == heterogeneity(sites).h1 and by[i].discordancy == pytest.approx(sites.discordancy().tolist())
        assert by[i].tier == (">= 500 station-years" if by[i].pooled_years >= 500 else "candidates exhausted")
        assert by[i].excluded_discordant + by[i].excluded_heterogeneous == len(grown.excluded())
    members = roi.region_members(regions)
    assert members.where("station = 5").orderBy("order_added").select("member").toPandas()["member"].tolist() == by[5].members
    moments = stations_of(spark, ratios, n, z).select(F.col("station").alias("member"), "n", "t", "t3", "t4")
    joined = members.join(moments, "member").select(F.col("station").alias("region"), F.col("member").alias("station"), "n", "t", "t3", "t4")
    fits = {r.region: r for r in homogeneity.region_fits(joined).collect()}
    order = sorted(by[5].members)
    want = homogeneity.choose(Sites(ratios[order], n[order].astype(float)))
    assert fits[5].chosen_distribution == want.family and fits[5].q_t100 == pytest.approx(want.curve[100])
    steps = roi.step_log(regions)
    assert steps.groupBy("station").count().count() == 14
    path = roi.growth_path(regions).where("station = 5").collect()
    assert all(p.size >= 5 and p.h1 < 1 for p in path)
    summary = {r.value: r for r in roi.result_summary(regions, "roi_size", "h1").collect()}
    assert summary["roi_size"].least <= summary["roi_size"].median <= summary["roi_size"].most


def test_regions_in_rounds(spark, monkeypatch):
    """Regions that see few stations at first take the same steps as those that see all; some
    have to go on for several rounds, one far from all others too.  Ties by equal attributes."""
    monkeypatch.setattr(roi, "FIRST", 3)
    monkeypatch.setattr(roi, "MORE", 4)
    rng = np.random.default_rng(21)
    ratios, n = region(rng, 24, 30, double=9)
    z = np.round(rng.normal(size=(24, 3)), 1)
    z[7], z[20] = 9.0, z[21]
    table = stations_of(spark, ratios, n, z)
    with_gaps = table.unionByName(spark.createDataFrame([(99, None, 0.0, 0.0, 30, 0.1, 0.1, 0.1)], table.schema))
    for rules in (roi.Rules(nsim_grow=50, nsim_final=50), roi.Rules(nsim_grow=50, nsim_final=50, centroid=False, station_years=10_000)):
        got = {r.station: r for r in roi.grown_regions(with_gaps, list("abc"), rules).collect()}
        assert sorted(got) == list(range(24))
        for i in range(24):
            want = roi.grow(i, z, ratios, n, rules)
            assert got[i].members == want.members
            steps = [(s.candidate, s.action, -1 if s.left_out is None else s.left_out, s.reason, s["size"], s.years) for s in got[i].steps]
            assert steps == [(s.candidate, s.action, s.left_out, s.reason, s.size, s.years) for s in want.steps]
            assert np.allclose([np.nan if s.h1 is None else s.h1 for s in got[i].steps], [s.h1 for s in want.steps], equal_nan=True)
    alone = roi.grown_regions(table.where("station = 4"), list("abc"), rules).collect()
    assert [(r.station, r.members, r.steps) for r in alone] == [(4, [4], [])]
    assert roi.grown_regions(table.where("station < 0"), list("abc"), rules).collect() == []


def test_sight():
    """A region waits exactly where a station that it doesn't see could be next."""
    z = np.array([[0.0], [1.0], [2.0], [3.0], [9.0]])
    ratios, n = np.full((5, 3), 0.1), np.full(5, 10.0)
    seen = roi.Region(0, z[:4], homogeneity.Sites(ratios[:4], n[:4]), roi.Rules(least_size=9), sight=9.0).grown()
    assert seen.waiting is True and seen.members == [0, 1, 2, 3]
    near = roi.Region(0, z[:3], homogeneity.Sites(ratios[:3], n[:3]), roi.Rules(least_size=9), sight=2.4).grown()
    assert near.waiting and near.members == [0, 1, 2]
    assert roi.Region(0, z[:3], near.sites, near.rules, sight=2.0).grown().members == [0, 1]  # 1.5 from the centre, which moved by 0.5


def test_neighbours_by_brute_force(spark):
    rng = np.random.default_rng(2)
    z = np.round(rng.normal(size=(60, 3)), 1)  # with ties
    df = stations_of(spark, rng.random((60, 3)), np.full(60, 9), z)
    d = np.sqrt(((z[:, None] - z[None]) ** 2).sum(2))
    got = {}
    for r in space.neighbours(df, "station", list("abc"), 7).collect():
        got.setdefault(r.station, {})[r["rank"]] = r.neighbour
    for i in range(60):
        want = sorted((x for x in range(60) if x != i), key=lambda j: (d[i, j], j))[:7]
        assert [got[i][k] for k in range(1, 8)] == want
    assert space.within(df, "station", list("abc"), 1.0).count() == (d <= 1.0).sum()
    assert space.distances(df, "station", list("abc")).count() == 3600
    words = df.withColumn("station", F.concat(F.lit("s"), "station"))
    assert space.neighbours(words, "station", list("abc"), 3).count() == 180


def test_spearman_and_silhouette_by_brute_force(spark):
    rng = np.random.default_rng(3)
    x, y = np.round(rng.normal(size=200), 1), np.round(rng.normal(size=200), 1)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)], "x double, y double")
    mean_rank = lambda v: np.array([(v < a).sum() + ((v == a).sum() + 1) / 2 for a in v])
    got = space.spearman(df, "x", "y", 5).first()
    assert got.rho == pytest.approx(np.corrcoef(mean_rank(x), mean_rank(y))[0, 1]) and got.n == 200
    z = rng.normal(size=(30, 3))
    label = np.append(rng.integers(0, 3, 29), 3)  # one alone
    rows = spark.createDataFrame([(i, *map(float, a), int(c)) for i, (a, c) in enumerate(zip(z, label))], "station long, a double, b double, c double, cluster int")
    d = np.sqrt(((z[:, None] - z[None]) ** 2).sum(2))
    for r in cluster.silhouettes(rows, "station", list("abc")).collect():
        i = r.station
        mine = (label == label[i]) & (np.arange(30) != i)
        if not mine.any():
            assert r.silhouette == 0
            continue
        a, b = d[i, mine].mean(), min(d[i, label == c].mean() for c in set(label) - {label[i]})
        assert r.silhouette == pytest.approx((b - a) / max(a, b))


def shuffled(df):
    """Rows and bytes that a result's plan sends through shuffles."""
    plan = df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    return plan.count("Exchange hashpartitioning") + plan.count("Exchange rangepartitioning") + plan.count("FlatMapCoGroups")


def test_all_pairs_go_through_no_shuffle(spark):
    """Blocks are read again for each pair, not copied for it; those alike lie side by side."""
    rng = np.random.default_rng(4)
    z = np.repeat(rng.normal(size=(30, 2)), 10, axis=0)
    df = spark.createDataFrame([(i * 37 % 300, *map(float, p)) for i, p in enumerate(z)], "station long, a double, b double").localCheckpoint()
    got = space.distances(df, "station", ["a", "b"])
    assert shuffled(got) == 0
    at = {i * 37 % 300: p for i, p in enumerate(z)}
    rows = got.collect()
    assert len({(r.station, r.neighbour) for r in rows}) == len(rows) == 300 * 300
    assert all(r.distance == pytest.approx(np.sqrt(((at[r.station] - at[r.neighbour]) ** 2).sum()), abs=1e-12) for r in rows)
    runs = sum(a.distance != b.distance for a, b in zip(rows, rows[1:]))
    assert runs < 300 * 300 / 5
    pair = lambda x, y: x.assign(n=len(y))[["station", "n"]]
    sums = space.blocks.against(df, df, "station", "station", pair, "station long, n long", rows=40)
    assert shuffled(sums) == 0 and {tuple(r) for r in sums.groupBy("station").agg(F.sum("n")).collect()} == {(i, 300) for i in range(300)}


@pytest.mark.parametrize("most, size", [(1 << 26, 1024), (100, 7)])
def test_pair_correlation_by_brute_force(spark, monkeypatch, most, size):
    """Of all pairs, in one round or many, with copies, ties and a row that lacks its value."""
    monkeypatch.setattr(space.blocks.ordered, "__kwdefaults__", {"rows": size})
    rng = np.random.default_rng(5)
    z, t = np.repeat(rng.normal(size=(20, 2)).round(1), 2, axis=0), np.repeat(rng.random(20).round(1), 2)
    df = spark.createDataFrame([(*map(float, p), float(v)) for p, v in zip(z, t)] + [(0.5, 0.5, None)], "a double, b double, t double")
    i, j = np.triu_indices(40, 1)
    d, g = np.sqrt(((z[i] - z[j]) ** 2).sum(1)).round(9), np.abs(t[i] - t[j]).round(9)
    mean_rank = lambda v: np.array([(v < a).sum() + ((v == a).sum() + 1) / 2 for a in v])
    rounds, cut = [], space._rounds
    monkeypatch.setattr(space, "_rounds", lambda *a: rounds.append(cut(*a)) or rounds[-1])
    got = space.pair_correlation(df, ["a", "b"], "t", parts=3, most=most).first()
    assert got.n == 780 and got.rho == pytest.approx(np.corrcoef(mean_rank(d), mean_rank(g))[0, 1], abs=1e-12)
    assert (min(map(len, rounds)) > 1) == (most < 1000)
    assert space.pair_correlation(df.where("t is null"), ["a", "b"], "t").first() == (None, 0)


def test_combinations_too_long_for_one_number():
    d, g = np.array([1 << 40, 5, 1 << 40, 5]), np.array([1 << 30, 7, 1 << 30, 8])
    for n in (None, np.array([1, 2, 3, 4])):
        a, b, m = space._counted(d, g, n)
        assert set(zip(a.tolist(), b.tolist(), m.tolist())) == {(5, 7, 1 if n is None else 2), (5, 8, 1 if n is None else 4), (1 << 40, 1 << 30, 2 if n is None else 4)}


def test_short_and_flat_series(spark):
    rows = [(1, float(v)) for v in (1, 2, 3)] + [(2, 5.0)] * 6 + [(3, v) for v in (-2.0, -1.0, 1.0, 2.0)] + [(4, None)] * 3
    got = {r.station: r for r in lmoments.sample_lmoments(spark.createDataFrame(rows, "station int, ams double")).collect()}
    assert got[1].l1 is None and got[2].t == 0 and got[2].t3 is None and got[3].t is None and 4 not in got


def test_names(spark):
    n = spark.createDataFrame([("Koli(bk)",), ("Arni",), ("None",), (None,)], "name string")
    f = spark.createDataFrame([("river koli(bk) x",), ("arni east",), ("Arni",), ("sarni",)], "file string")
    assert {tuple(r) for r in names.fuzzy_match(n, f, "name", "file").collect()} == {("Koli(bk)", "river koli(bk) x", "whole word"), ("Arni", "Arni", "name")}
    df = spark.createDataFrame([(1, 2, 3)], "`Max Discharge cumec` int, max_discharge_date int, Year int")
    assert names.find_column(df, ["YEAR"]) == "Year" and names.find_maximum_column(df) == "Max Discharge cumec"
    with pytest.raises(ValueError):
        names.require(df, ["nothing"])


def test_components(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(90, 4)) @ rng.normal(size=(4, 4))
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "station int, a double, b double, c double, d double")
    m = space.components(df, list("abcd"))
    assert m.values.sum() == pytest.approx(4 * 90 / 89)
    assert (m.vectors[np.abs(m.vectors).argmax(0), range(4)] > 0).all()
    s = space.scores(df, m, ["station"]).orderBy("station").toPandas()[[f"pc{k}" for k in range(1, 5)]].to_numpy()
    z = (x - x.mean(0)) / x.std(0)
    gap = np.sqrt(((s[0] - s[1]) ** 2).sum()) - np.sqrt(((z[0] - z[1]) ** 2).sum())
    assert abs(gap) < 1e-9 and np.allclose(s.std(0, ddof=1) ** 2, m.values)


def test_regression(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(40, 3))
    y = 1 + 2 * x[:, 0] - x[:, 2] + rng.normal(size=40) * 0.1
    df = spark.createDataFrame([(i, *map(float, r), float(t)) for i, (r, t) in enumerate(zip(x, y))], "station int, a double, b double, c double, y double")
    g = indexflood.gram(df, list("abc"), "y")
    fit = indexflood.ols(g, list("abc"))
    beta, *_ = np.linalg.lstsq(np.c_[np.ones(40), x], y, rcond=None)
    assert np.allclose(fit["beta"], beta) and np.allclose(fit["t"], fit["beta"] / fit["se"])
    assert set(indexflood.forward_stepwise(g)) >= {"a", "c"} and indexflood.forward_stepwise(g)[0] == "a"
    loo = {r.station: r.estimate for r in indexflood.simple_leave_one_out(df, "station", "a", "y").collect()}
    keep = np.arange(40) != 5
    b, *_ = np.linalg.lstsq(np.c_[np.ones(39), x[keep, 0]], y[keep], rcond=None)
    assert loo[5] == pytest.approx(b[0] + b[1] * x[5, 0])
    full = {r.station: r.estimate for r in indexflood.leave_one_out(df, "station", list("abc"), "y").collect()}
    assert np.corrcoef(np.log10([full[i] for i in range(40)]), y)[0, 1] > 0.98


def slow_ward(z, k):
    groups = [[i] for i in range(len(z))]
    while len(groups) > k:
        cost = lambda a, b: len(a) * len(b) / (len(a) + len(b)) * ((z[a].mean(0) - z[b].mean(0)) ** 2).sum()
        i, j = min(((i, j) for i in range(len(groups)) for j in range(i)), key=lambda p: cost(groups[p[0]], groups[p[1]]))
        groups[j] += groups.pop(i)
    return sorted(map(sorted, groups))


def test_ward(spark):
    z = np.array([[0, 0], [0, 1], [5, 5], [5, 6], [20, 0]], float)
    assert cluster.ward_labels(z, np.ones(5), [3])[3].tolist() == [0, 0, 1, 1, 2]
    rng = np.random.default_rng(8)
    z = rng.normal(size=(25, 3))
    for k, labels in cluster.ward_labels(z, np.ones(25), [2, 4, 25]).items():
        assert sorted(sorted(np.flatnonzero(labels == c).tolist()) for c in range(k)) == slow_ward(z, k)
    df = spark.createDataFrame([(i, *map(float, a)) for i, a in enumerate(z)], "station long, a double, b double, c double")
    got = cluster.ward_kmeans(df, "station", list("abc"), [4]).toPandas().sort_values("station")
    label = got["ward"].to_numpy()
    assert sorted(sorted(np.flatnonzero(label == c).tolist()) for c in range(4)) == slow_ward(z, 4)
    for _ in range(50):
        centres = np.stack([z[label == c].mean(0) for c in range(4)])
        new = ((z[:, None] - centres[None]) ** 2).sum(2).argmin(1)
        if (new == label).all():
            break
        label = new
    assert got["cluster"].tolist() == label.tolist()


def test_ward_over_centres(spark, monkeypatch):
    """More stations than centres: clear clusters are still found."""
    monkeypatch.setattr(cluster, "CENTRES", 30)
    rng = np.random.default_rng(8)
    z = np.concatenate([rng.normal(size=(40, 2)) + 30 * k for k in range(3)])
    df = spark.createDataFrame([(i, *map(float, a)) for i, a in enumerate(z)], "station long, a double, b double")
    got = cluster.ward_kmeans(df, "station", ["a", "b"], [3]).toPandas().sort_values("station")["cluster"].to_numpy()
    assert all(len(set(got[40 * k : 40 * k + 40])) == 1 for k in range(3)) and len(set(got)) == 3
    sweep = {r.k: r for r in cluster.kmeans_sweep(df, "station", ["a", "b"], [2, 3, 4]).collect()}
    assert sweep[3].silhouette > max(sweep[2].silhouette, sweep[4].silhouette) and sweep[2].inertia > sweep[3].inertia


def test_transfers(spark):
    """A site of another region's kind moves there; the log tells H of both before and after."""
    rng = np.random.default_rng(5)
    low, n = region(rng, 9, 80)
    high, _ = region(rng, 9, 80)
    high[:, 0] *= 2
    rows = [(0, i, 80, *map(float, r)) for i, r in enumerate(low)] + [(1, 20 + i, 80, *map(float, r)) for i, r in enumerate(high[:8])] + [(0, 40, 80, *map(float, high[8]))]
    members = spark.createDataFrame(rows, "region int, station long, n long, t double, t3 double, t4 double")
    overlap = spark.createDataFrame([(40, m) for m in (40, 20, 21, 22, 1)] + [(1, m) for m in (1, 2, 3, 20)], "station long, member long")
    proposals = cluster.proposed_transfers(members, overlap)
    assert [tuple(r) for r in proposals.collect()] == [(40, 0, 1, 0.25)]
    log = cluster.transfer_log(members, proposals, 200)
    r = log.first()
    before = Sites(np.array([x[3:] for x in rows if x[0] == 0]), np.full(10, 80.0))
    assert r.h1_before_source == pytest.approx(heterogeneity(before, 200).h1) and r.h1_after_source < r.h1_before_source
    final = cluster.final_regions(members, log)
    assert final.where("station = 40").first().region == (1 if r.accepted else 0)
    report = {x.region: x for x in cluster.region_report(final, 100).collect()}
    assert report[0].sites + report[1].sites == 18 and report[0].advice in ("use", "split", "look at discordant sites")
    logged = spark.createDataFrame([(5, 2, 3.0, 2.0, 1.5, 1.0), (6, 2, 3.0, 2.0, 1.0, 1.5), (7, 2, 3.0, 4.0, 1.0, 0.5)], "a int, b int, bf double, af double, bt double, at double")
    assert [x[0] for x in logged.select(cluster.transfer_accepted(F.col("bf"), F.col("af"), F.col("bt"), F.col("at"))).collect()] == [True, False, False]


def test_validity_and_best_k(spark):
    rng = np.random.default_rng(8)
    z = np.concatenate([rng.normal(size=(12, 3)) + 30 * k for k in range(3)])
    ratios, n = region(rng, 36, 40)
    df = stations_of(spark, ratios, n, z)
    table = cluster.validity(df, "station", list("abc"), [2, 3, 4, 50], df.withColumn("region", F.lit(0)), 50)
    rows = {r.k: r for r in table.collect()}
    assert set(rows) == {2, 3, 4} and rows[3].silhouette > 0.9 and rows[3].davies_bouldin < 0.2 and rows[3].min_size == 12
    assert cluster.best_k(table.select("k", "silhouette", F.col("min_size").alias("min_contrib"), (F.col("min_size") >= 5).alias("testable"))).first().k == 3
    none = table.select("k", "silhouette", F.col("min_size").alias("min_contrib"), F.lit(False).alias("testable"))
    assert cluster.best_k(none).first().min_contrib == max(r.min_size for r in rows.values())


def slow_fold(x, y, i):
    """Everything anew without row i: scores, components, selection by p, fit, smearing."""
    keep = np.arange(len(y)) != i
    m, s = x[keep].mean(0), x[keep].std(0)
    values, vectors = np.linalg.eigh(np.corrcoef(x[keep].T))
    p = (x - m) / s @ vectors[:, ::-1]
    chosen = []
    while len(chosen) < p.shape[1]:
        ps = {}
        for c in range(p.shape[1]):
            if c not in chosen:
                a = np.c_[np.ones(keep.sum()), p[keep][:, [*chosen, c]]]
                b = np.linalg.lstsq(a, y[keep], rcond=None)[0]
                dof = keep.sum() - a.shape[1]
                se = math.sqrt(((y[keep] - a @ b) ** 2).sum() / dof * np.linalg.inv(a.T @ a)[-1, -1])
                ps[c] = special.t_tail(b[-1] / se, dof)
        c = min(ps, key=ps.get)
        if ps[c] >= 0.05:
            break
        chosen.append(c)
    a = np.c_[np.ones(len(y)), p[:, chosen]]
    b = np.linalg.lstsq(a[keep], y[keep], rcond=None)[0]
    return np.mean(10 ** (y[keep] - a[keep] @ b)) * 10 ** (a[i] @ b)


def test_leave_one_out_by_brute_force(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(30, 3)) * [1, 50, 0.1] + [0, 900, 5]
    y = 1 + 0.3 * x[:, 0] - 0.004 * x[:, 1] + rng.normal(size=30) * 0.1
    df = spark.createDataFrame([(i, *map(float, r), float(t)) for i, (r, t) in enumerate(zip(x, y))], "station int, a double, b double, c double, y double")
    folds = indexflood.leave_one_out(df, "station", list("abc"), "y").cache()
    got = {r.station: r for r in folds.collect()}
    for i in range(30):
        assert got[i].estimate == pytest.approx(slow_fold(x, y, i)) and got[i].observed == pytest.approx(10 ** y[i])
    s = indexflood.leave_one_out_summary(folds).first()
    e = np.log10([got[i].estimate for i in range(30)])
    assert s.r2_log10 == pytest.approx(1 - ((y - e) ** 2).sum() / ((y - y.mean()) ** 2).sum()) and 0 < s.agreement <= 1 and s.folds == 30


def test_attribute_equation_and_selection(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 3)) * [1, 50, 0.1] + [0, 900, 5]
    y = 1 + 0.3 * x[:, 0] - 0.004 * x[:, 1] + rng.normal(size=60) * 0.01
    df = spark.createDataFrame([(i, *map(float, r), float(t)) for i, (r, t) in enumerate(zip(x, y))], "station int, a double, b double, c double, y double")
    model = space.components(df, list("abc"))
    assert model.needed(1e-9) == 1 and model.needed(1.0 - 1e-12) == 3
    pcs = space.scores(df, model, ["station", "y"])
    fit = indexflood.ols(indexflood.gram(pcs, ["pc1", "pc2", "pc3"], "y"), ["pc1", "pc2", "pc3"])
    eq = {name: unit for name, unit, _ in indexflood.attribute_equation(model, fit)}
    assert (eq["a"], eq["b"]) == pytest.approx((0.3, -0.004), rel=0.05) and eq["intercept"] == pytest.approx(1, abs=0.5)
    both = indexflood.gram(df.withColumn("d", F.col("a") * 2 + F.col("c") * 1e-3), ["a", "b", "c", "d"], "y")
    chosen = indexflood.forward_adjusted(both)
    assert len({"a", "d"} & set(chosen)) == 1 and "b" in chosen  # the twin would inflate
    noise = indexflood.gram(df.withColumn("y", F.rand(3)), ["c"], "y")
    assert indexflood.forward_adjusted(noise, gain=0.5, fallback="a") == ["a"]


def test_ungauged_by_hand(spark):
    rng = np.random.default_rng(13)
    ratios, n = region(rng, 12, 60)
    z = rng.normal(size=(12, 3))
    table = stations_of(spark, ratios, n, z)
    index = spark.createDataFrame([(i, 100.0 + i, 90.0) for i in range(12)], "station long, observed double, estimate double")
    rules = roi.Rules(nsim_grow=50)
    got = {(r.station, r.period): r for r in validate.ungauged(table, list("abc"), index, rules, 60).collect()}
    own = set(roi.grow(3, z, ratios, n, rules).members) - {3}
    pool = roi.grow(3, z, ratios, n, roi.Rules(nsim_grow=50, use_target_flow=False)).members[1:]
    region_fit, site = homogeneity.choose(Sites(ratios[pool], n[pool]), 60), homogeneity.choose(Sites(ratios[[3]], n[[3]]), 60)
    r = got[3, 50]
    assert r.jaccard == pytest.approx(len(own & set(pool)) / len(own | set(pool))) and r.family == region_fit.family
    assert r.design == pytest.approx(90 * region_fit.curve[50]) and r.computed == pytest.approx(103 * site.curve[50])
    assert r.percent_error == pytest.approx(100 * (r.design - r.computed) / r.computed)
    a = spark.createDataFrame([(1, [1, 2, 3], [None] * 3), (2, [2, 1], [None] * 2)], "station long, members array<long>, discordancy array<double>")
    b = spark.createDataFrame([(1, [1, 2, 4], [None] * 3), (2, [2, 1], [None] * 2)], "station long, members array<long>, discordancy array<double>")
    assert {r.station: r.jaccard for r in validate.overlap_with(a, b).collect()} == pytest.approx({1: 1 / 3, 2: 1.0})
    curves = spark.createDataFrame([(1, 10, 2.0, 2.2, 1.0), (2, 10, 2.0, 1.8, 3.0)], "station long, period int, at_site double, roi double, cluster double")
    c = validate.compared(curves).first()
    assert (c.roi_bias, c.roi_rmse, c.cluster_rmse, c.winner) == (pytest.approx(0), pytest.approx(10), pytest.approx(50), "ROI")


def test_singular_scatter(spark):
    """Sites on a line: their scatter has no inverse."""
    rows = [(1, k, 30, 0.1 * k, 0.2 * k, 0.3 * k) for k in range(6)]
    members = spark.createDataFrame(rows, "region int, station long, n long, t double, t3 double, t4 double")
    got = {r.station: r.di for r in lmoments.discordancy(members).collect()}
    want = Sites(np.array([r[3:] for r in rows]), np.ones(6)).discordancy()
    assert [got[k] for k in range(6)] == pytest.approx(want.tolist())


def test_circular_flow(spark):
    cells = spark.createDataFrame([(0, 0, 1), (0, 1, 16), (1, 0, 1), (1, 1, 1), (1, 2, 4), (5, 5, 9)], "row int, col int, fdir int")
    assert {tuple(r) for r in raster.catchment(cells, 1, 2).collect()} == {(1, 0), (1, 1), (1, 2)}


def test_split():
    parts = raster.split_bbox((70, 10, 80, 20), 300_000)
    assert all(raster.bbox_area(*b) <= 300_000 for b in parts)
    assert sum(raster.bbox_area(*b) for b in parts) == pytest.approx(raster.bbox_area(70, 10, 80, 20))


def test_selection(spark):
    df = spark.createDataFrame([(1.0, float("nan")), (0.0, 1.0), (None, 2.0), (4.0, 5.0)], "obs double, est double")
    assert [r[0] for r in df.select(selection.percent_error(F.col("est"), F.col("obs"))).collect()] == [None, None, None, 25.0]
    assert selection.without_constants(spark.createDataFrame([(1, 2), (1, 3)], "a int, b int"), ["a", "b"]).columns == ["b"]


def test_stream(spark, tmp_path):
    spark.sql("select 1L as station, timestamp'2024-01-01 05:00' as ts, 3.0d as v union all select 1L, timestamp'2024-01-01 09:00', 7.0d union all select 1L, timestamp'2024-01-09', -1.0d union all select 1L, timestamp'2024-01-10', 2.0d").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("station long, ts timestamp, v double").parquet(str(tmp_path / "in"))
    q = streaming.block_maxima(stream, "station", "ts", "v").writeStream.format("memory").queryName("maxima").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert [(r.station, r.ams) for r in spark.table("maxima").collect()] == [(1, 7.0)]


def test_tested_regions_edges(spark):
    """Four sites are too few; nine alike and one far off are cleaned; an empty table is empty."""
    rows = [(1, k, 30, 0.2 + 0.01 * k, 0.1, 0.15) for k in range(4)]
    rows += [(2, k, 30, 0.2 + 0.002 * k, 0.1 + 0.004 * (k * 7 % 9), 0.15 + 0.003 * (k * 5 % 9)) for k in range(9)] + [(2, 99, 30, 0.6, 0.7, 0.9)]
    members = spark.createDataFrame(rows, "region int, station long, n long, t double, t3 double, t4 double")
    got = {r.region: r for r in homogeneity.tested_regions(members, nsim=50).collect()}
    assert got[1].note == "too few sites to test" and got[1].chosen_distribution is None
    assert got[2].discordant == ["99"] and got[2].note == "discordant sites removed" and got[2].h1 < got[2].h1_all
    assert homogeneity.tested_regions(members.where("false")).count() == 0


def test_accumulation(spark):
    """A line of seven cells, the last flowing off the grid; circles are reported."""
    line = spark.createDataFrame([(0, c, 1) for c in range(7)], "row int, col int, fdir int")
    assert {r.col: r.acc for r in raster.accumulation(line).collect()} == {c: c + 1 for c in range(7)}
    with pytest.raises(ValueError):
        raster.accumulation(spark.createDataFrame([(0, 0, 1), (0, 1, 16)], "row int, col int, fdir int"))
    assert raster.accumulation(line.where("false")).count() == 0


def test_flow_directions(spark):
    z = spark.createDataFrame([(0, 0, 5.0), (0, 1, 3.0), (1, 1, 2.0), (1, 0, None)], "row int, col int, z double")
    assert {(r.row, r.col): r.fdir for r in raster.flow_directions(z).collect()} == {(0, 0): 2, (0, 1): 4, (1, 1): 0, (1, 0): 0}
    # Eight offers a cell look small to the planner; they must not go through the driver.
    assert "Broadcast" not in raster.flow_directions(z)._jdf.queryExecution().executedPlan().toString()


def test_regression_keeps_digits(spark):
    """A predictor of large mean and small spread."""
    x = 4e6 + np.arange(50.0)
    d = spark.createDataFrame([(float(v), 3.0 + 1e-3 * (float(v) - 4e6)) for v in x], "x double, y double")
    fit = indexflood.ols(indexflood.gram(d, ["x"], "y"), ["x"])
    assert fit["beta"][1] == pytest.approx(1e-3, rel=1e-3)


def test_random_spread_repeats(spark):
    v = spark.createDataFrame([(float(k),) for k in range(20)], "t double")
    one, two = (sorted(map(tuple, space.random_spread(v, "t", reps=40).repartition(n).collect())) for n in (1, 3))
    assert one == two and len(one) == 40
    assert space.random_spread(v.limit(3), "t").count() == 0


def test_ungauged_query_runs_all_simulations(spark, sf_dir, monkeypatch):
    import inspect

    from tributary.plans import numeric

    call = inspect.signature(validate.ungauged)
    monkeypatch.setattr(validate, "ungauged", lambda *a, **k: call.bind(*a, **k))
    bound = numeric.ungauged_test(spark, sf_dir)
    bound.apply_defaults()
    assert bound.arguments["nsim"] == 500


def test_ranges_of_cluster_numbers(spark, sf_dir, monkeypatch):
    """As the reference: its validity table has 2 to 15, its choice is of 3 to 8."""
    from tributary.plans import regional

    tried = []
    monkeypatch.setattr(cluster, "validity", lambda df, key, columns, ks, members: tried.append(ks) or spark.createDataFrame([(k, k / 10, 5, 5) for k in ks], "k int, silhouette double, min_size int, min_contrib int"))
    regional.cluster_validity(spark, sf_dir)
    assert regional.chosen_k(spark, sf_dir).first().k == 8
    assert tried == [list(range(2, 16)), list(range(3, 9))]


def test_small_selections(spark):
    df = spark.createDataFrame([(1, "b", 2.0), (1, "a", 3.0), (2, None, None)], "g int, o string, x double")
    assert selection.capped(df, "x", None).count() == 3 and selection.capped(df, "x", 2.5).count() == 1
    assert [tuple(r) for r in selection.group_summary(df, "g", ["x"], [F.col("o")], ["x"]).orderBy("g").collect()] == [(1, 3.0, 2, 5.0), (2, None, 1, None)]
    one, two = (selection.sampled(df.repartition(k), "x", 2).collect() for k in (1, 3))
    assert one == two and len(one) == 2
    text = spark.createDataFrame([("s", "1899-01-01T00:00:00", 9.0), ("s", "2001-05-01T10:00:00", -2.0), ("s", "2001-06-01T10:00:00", -1.0), ("s", "junk", 5.0), ("s", "2002-01-01T00:00:00", None)], "s string, w string, v double")
    assert [tuple(r) for r in maxima.annual_maxima(text, "s", "w", "v").collect()] == [("s", 2001, -1.0)]
    short = spark.createDataFrame([("a", 1, 2.0, 10), ("a", 1, 5.0, 2), ("a", 2, 4.0, 10)], "s string, b int, v double, n int")
    assert {r.block: r.ams for r in maxima.block_maxima(short, "s", "b", "v", "n", 5).collect()} == {1: 2.0, 2: 4.0}
    n = spark.createDataFrame([("Koli", "file seven")], "name string, stated string")
    f = spark.createDataFrame([("koli",), ("File Seven",)], "file string")
    assert [tuple(r) for r in names.fuzzy_match(n, f, "name", "file", "stated").collect()] == [("Koli", "File Seven", "stated file")]
    parts = [spark.createDataFrame([(1, "SUCCESS")], "a int, status string"), spark.createDataFrame([(2, "no DEM")], "a int, reason string")]
    assert selection.outer_statuses(parts).columns == ["a", "status", "reason"]


def test_generalised_normal_by_approximation(spark):
    """Against the numerical fit, and quantiles from the normal distribution itself."""
    from statistics import NormalDist

    t3 = [-0.6, -0.2, -1e-12, 0.0, 0.05, 0.3, 0.6, 0.93, 0.97]
    df = spark.createDataFrame([(i, 0.3, x) for i, x in enumerate(t3)], "region int, t_r double, t3_r double")
    got = {(r.region, r.period): r.q for r in lmoments.growth_curve_gno(df).collect()}
    assert {i for i, _ in got} == set(range(8))
    for i, x in enumerate(t3[:8]):
        fit = dist.fitted("GNO", 0.3, x)
        upper, lower = (sum(c * x ** (2 * j) for j, c in enumerate(cs)) for cs in lmoments.NORMAL_SHAPE)
        k = -x * upper / lower
        for p in (2, 100):
            z = NormalDist().inv_cdf(1 - 1 / p)
            if abs(k) < 1e-8:
                want = 1 + 0.3 * math.sqrt(math.pi) * z
            else:
                a = 0.3 * k * math.exp(-k * k / 2) / math.erf(k / 2)
                want = 1 - a * (1 - math.exp(k * k / 2)) / k + a * (1 - math.exp(-k * z)) / k
            assert got[i, p] == pytest.approx(want, rel=1e-12)
            if fit is not None and abs(x) <= 0.3:
                assert got[i, p] == pytest.approx(fit.quantile(1 - 1 / p), rel=1e-2)  # whose grid cuts the tails


def test_components_without_variance_or_independence(spark):
    rng = np.random.default_rng(4)
    a, b = rng.normal(size=(2, 40))
    df = spark.createDataFrame([(float(x), 7.0, float(y), float(2 * x - 3 * y)) for x, y in zip(a, b)], "a double, same double, b double, c double")
    model = space.components(df, ["a", "same", "b", "c"])
    assert model.columns == ["a", "b", "c"] and np.isfinite(model.values).all() and abs(model.values[-1]) < 1e-9
    assert model.values.sum() == pytest.approx(3 * 40 / 39)
    with pytest.raises(ValueError, match="varies"):
        space.components(df, ["same"])


def test_contributing_sites_of_clusters(spark):
    """Stations without moments count for a cluster's size, not for what it contributes."""
    rng = np.random.default_rng(6)
    z = np.concatenate([rng.normal(size=(12, 2)), rng.normal(size=(9, 2)) + 20])
    df = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(z)], "station long, a double, b double")
    members = spark.createDataFrame([(i, 20, 0.3, 0.2, 0.15, 0) for i in range(16)], "station long, n int, t double, t3 double, t4 double, region int")
    (row,) = cluster.validity(df, "station", ["a", "b"], [2], members, nsim=20).collect()
    assert (row.min_size, row.min_contrib) == (9, 4)


def test_passes_of_transfers(spark):
    """Passes go on until none moves; each is what one pass makes of the regions before it."""
    rng = np.random.default_rng(15)
    low, _ = region(rng, 20, 60)
    scale = np.repeat([1.0, 2.0], 10)
    ratios = low.copy()
    ratios[:, 0] *= scale
    place = [0] * 8 + [1] * 2 + [1] * 8 + [0] * 2  # two of each kind in the other's region
    members = spark.createDataFrame([(i, place[i], 60, *map(float, r)) for i, r in enumerate(ratios)], "station long, region int, n long, t double, t3 double, t4 double")
    overlap = spark.createDataFrame([(i, j) for i in range(20) for j in range(20) if scale[i] == scale[j]], "station long, member long")
    log, final = cluster.transfer_passes(members, overlap, 100)
    rows, last = log.collect(), final.collect()
    number = max(r.pass_ for r in rows)
    assert number > 2 and not any(r.accepted for r in rows if r.pass_ == number)
    now = members
    for k in range(1, number + 1):
        mine = sorted((r.station, r.source, r.goal, r.accepted) for r in rows if r.pass_ == k)
        alone = cluster.transfer_log(now, cluster.proposed_transfers(now.select("station", "region"), overlap), 100)
        assert mine == sorted((r.station, r.source, r.goal, r.accepted) for r in alone.collect())
        now = cluster.stored(cluster.final_regions(now, alone), "test")
    assert sorted(map(tuple, now.select("station", "region").collect())) == sorted((r.station, r.region) for r in last)
    assert any(r.region != place[r.station] for r in last)
    assert cluster.proposed_transfers(final.select("station", "region"), overlap).count() < cluster.proposed_transfers(members.select("station", "region"), overlap).count()


def test_moves_do_not_meet_and_published_outcomes(spark):
    rows = [(1, 10, 20, 3.0, True), (2, 20, 30, 2.0, True), (3, 30, 40, 1.0, True), (4, 50, 60, 9.0, True), (5, 70, 80, 0.1, False), (6, 60, 50, 9.0, True)]
    log = spark.createDataFrame([(s, a, b, h, 0.0, x) for s, a, b, h, x in rows], "station long, source int, goal int, h1_after_source double, h1_after_goal double, accepted boolean")
    assert sorted(map(tuple, cluster.free_moves(log).collect())) == [(3, 40), (4, 60)]
    # Published H of both regions before and after, and what became of the site.
    known = [(7.896, 6.631, 8.761, 9.088, False), (9.678, 10.103, 7.896, 8.132, False), (8.761, 8.451, 9.678, 9.644, True), (8.688, 9.178, 9.088, 8.990, False), (7.896, 6.631, 8.451, 8.902, False), (10.378, 9.828, 7.896, 8.132, False)]
    found = spark.createDataFrame(known, "bf double, af double, bt double, at double, accepted boolean")
    assert found.where(cluster.transfer_accepted(F.col("bf"), F.col("af"), F.col("bt"), F.col("at")) != F.col("accepted")).isEmpty()


def test_checked_distances_by_blocks(spark):
    """The same row as from tables of all pairs, and no table of pairs on the way."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(150, 2))
    turned = x @ np.array([[0.6, -0.8], [0.8, 0.6]])
    off = turned + np.where(np.arange(150)[:, None] == 7, 0.01, 0.0)
    tables = [spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(t)], "station int, a double, b double") for t in (x, turned, off)]
    for other in tables[1:]:
        pairs = space.same_distances(space.distances(tables[0], "station", ["a", "b"]), space.distances(other, "station", ["a", "b"])).first()
        got = space.checked_distances(tables[0], other, "station", ["a", "b"], ["a", "b"], rows=40)
        assert got.first() == pairs and got.first().pairs == 150 * 150
    assert not got.first().same
    assert tuple(space.checked_distances(tables[0].where("false"), other, "station", ["a", "b"], ["a", "b"]).first()) == (None, None, None, 0)


def test_all_numbers_of_clusters_together(spark, monkeypatch):
    """A table of labels whatever the numbers of clusters and rounds, and silhouettes and
    scatter of each number as by itself."""
    rng = np.random.default_rng(11)
    df = spark.createDataFrame([(i, *map(float, rng.normal(size=2))) for i in range(90)], "station int, a double, b double").localCheckpoint()
    held, kept = [], cluster.stored
    monkeypatch.setattr(cluster, "stored", lambda df, label: held.append(label) or kept(df, label))
    ks = [1, 2, 5, 90]
    labels = cluster.ward_kmeans(df, "station", ["a", "b"], ks)
    assert held.count("assigned") == 1
    means = {r.k: r.silhouette for r in cluster.mean_silhouettes(df, labels, "station", ["a", "b"], block=20).collect()}
    scatter = {r.k: r.davies_bouldin for r in cluster.davies_bouldin(df.join(labels, "station"), ["a", "b"], by=("k",)).collect()}
    assert sorted(means) == ks and 1 not in scatter
    for k in (2, 5):
        one = df.join(labels.where(F.col("k") == k), "station")
        alone = cluster.ward_kmeans(df, "station", ["a", "b"], [k])
        assert one.select("station", "ward", "cluster").exceptAll(alone.select("station", "ward", "cluster")).isEmpty()
        assert means[k] == pytest.approx(cluster.silhouettes(one, "station", ["a", "b"]).agg(F.avg("silhouette")).first()[0], abs=1e-12)
        assert scatter[k] == pytest.approx(cluster.davies_bouldin(one, ["a", "b"]).first()[0], rel=1e-12)
    assert means[1] == 0 and means[90] == 0


def test_sweep_takes_distances_once(spark, monkeypatch):
    rng = np.random.default_rng(12)
    df = spark.createDataFrame([(i, *map(float, rng.normal(size=2))) for i in range(60)], "station int, a double, b double").localCheckpoint()
    taken, against = [], cluster.blocks.against
    monkeypatch.setattr(cluster.blocks, "against", lambda *a: taken.append(1) or against(*a))
    assert sorted(r.k for r in cluster.kmeans_sweep(df, "station", ["a", "b"], [2, 3, 4, 61]).collect()) == [2, 3, 4] and len(taken) == 1


def test_targets_at_one_place_grow_together(spark, monkeypatch):
    """Copies of stations: a place is a group of its own, cut up where its targets see too much."""
    rng = np.random.default_rng(21)
    z, ratios = np.repeat(rng.normal(size=(12, 2)), 6, axis=0), np.repeat(np.array([0.2, 0.15, 0.15]) + rng.normal(0, 0.02, (12, 3)), 6, axis=0)
    rows = [(s, *map(float, z[s]), 20 + s // 6, *map(float, ratios[s])) for s in range(72)]
    stations = spark.createDataFrame(rows, "station long, x double, y double, n long, t double, t3 double, t4 double")
    rules = roi.Rules(station_years=150, nsim_grow=30, nsim_final=30)
    want = {}
    for s in range(72):
        region = roi.grow(s, z, ratios, np.array([r[3] for r in rows], float), rules)
        want[s] = (region.members, [x.action for x in region.steps])
    for together in (1 << 15, 150):
        monkeypatch.setattr(roi, "TOGETHER", together)
        monkeypatch.setattr(roi, "FIRST", 30)
        groups = roi.grown_regions(stations, ["x", "y"], rules)
        assert {r.station: (r.members, [x.action for x in r.steps]) for r in groups.collect()} == want


def test_small_tables_are_dealt_out(spark):
    """Regions, pools and blocks of few bytes still go to more than one task."""
    rows = spark.range(40).select(F.col("id").alias("station"), F.col("id").alias("region"), F.lit(20).alias("n"), F.lit(0.2).alias("t"), F.lit(0.15).alias("t3"), F.lit(0.16).alias("t4"))
    tasks = lambda df: df.select(F.spark_partition_id().alias("p")).distinct().count()
    assert tasks(homogeneity.region_fits(rows, nsim=5)) > 4
    assert tasks(homogeneity.tested_regions(rows, nsim=5)) > 4
    pools = rows.select("station", (F.col("station") + 1).alias("neighbour"), F.lit(1).alias("rank"), "n", "t", "t3", "t4")
    assert tasks(roi.trimmed_pools(pools, 500, nsim=5)) > 4
    pair = lambda x, y: x[["station"]]
    assert tasks(blocks.against(rows, rows, "station", "station", pair, "station long")) > 4


def test_regions_before_transfers_are_simulated_once(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(i % 2, i, 20, *map(float, rng.uniform(0.1, 0.3, 3))) for i in range(14)]
    members = spark.createDataFrame(rows, "region int, station long, n long, t double, t3 double, t4 double")
    proposals = spark.createDataFrame([(i, i % 2, 1 - i % 2, 0.2) for i in range(6)], "station long, source int, goal int, fraction double")
    regions, simulate = [], cluster.region_heterogeneity

    def counted(df, region="region", nsim=500):
        regions.append(df.select(region).distinct().count())
        return simulate(df, region, nsim)

    monkeypatch.setattr(cluster, "region_heterogeneity", counted)
    log = {r.station: r for r in cluster.transfer_log(members, proposals, 20).collect()}
    assert sum(regions) == 2 * 6 + 2
    alone = {r.region: r.h1 for r in simulate(members, "region", 20).collect()}
    assert all((r.h1_before_source, r.h1_before_goal) == (alone[r.source], alone[r.goal]) for r in log.values()) and len(log) == 6


def test_two_rules_in_rounds(spark, monkeypatch):
    """Regions that wait with unlike numbers of steps by two rules go on as those that see all."""
    rng = np.random.default_rng(21)
    ratios, n = region(rng, 16, 30, double=6)
    table = stations_of(spark, ratios, n, rng.normal(size=(16, 3)))
    rules = [roi.Rules(nsim_grow=30, station_years=60), roi.Rules(nsim_grow=30, station_years=10_000)]
    work = lambda names, regions: [{"station": names[r.target], "rule": i, "members": [names[m] for m in r.members], "steps": len(r.steps)} for i, r in enumerate(regions)]
    grown = lambda: sorted(map(tuple, roi.over_targets(table, list("abc"), rules, work, "station: long, rule: int, members: array<long>, steps: int").collect()))
    whole = grown()
    monkeypatch.setattr(roi, "FIRST", 5)
    monkeypatch.setattr(roi, "MORE", 2)
    assert grown() == whole and len(whole) == 32
    assert any(a[3] != b[3] for a, b in zip(whole[::2], whole[1::2]))


def test_trials_by_sums(spark, monkeypatch):
    """Trials from sums at nodes are those of regions simulated whole with the same draws; a
    site without ratios and a region of a site are tried too."""
    rng = np.random.default_rng(12)
    ratios = np.array([0.1, -0.3, 0.16]) + rng.normal(0, (0.01, 0.05, 0.05), (480, 3))
    rows = [(int(i < 300), i, int(rng.integers(20, 30)), *map(float, r)) for i, r in enumerate(ratios)]
    members = spark.createDataFrame([*rows, (0, 900, 20, None, 0.1, 0.1), (7, 901, 20, 0.1, 0.1, 0.1)], "region int, station long, n long, t double, t3 double, t4 double")
    proposals = spark.createDataFrame([*((i, int(i < 300), int(i >= 300), 0.2) for i in range(270, 330)), (900, 0, 1, 0.1), (901, 7, 1, 0.1)], "station long, source int, goal int, fraction double")
    wanted = proposals.selectExpr("station", "inline(array(struct(-1 AS sign, source AS region), struct(1 AS sign, goal AS region)))")
    tried = trials.Trials(members, wanted, 40, homogeneity.SEED)
    assert tried.few.count() == 3 and tried.many.count() == 121  # a site without ratios, and a region of one that a site leaves
    logs = [{r.station: r for r in cluster.transfer_log(members, proposals, 40).collect()}]
    monkeypatch.setattr(trials, "ENOUGH", 1000)
    assert trials.Trials(members, wanted, 40, homogeneity.SEED).few.count() == 124
    logs.append({r.station: r for r in cluster.transfer_log(members, proposals, 40).collect()})
    monkeypatch.setattr(homogeneity, "MOST_SITES", 100)  # the same by blocks, whose sites keep their places
    logs.append({r.station: r for r in cluster.transfer_log(members, proposals, 40).collect()})
    assert len(logs[0]) == 62 and logs[0].keys() == logs[1].keys() == logs[2].keys()
    columns = ["h1_before_source", "h1_after_source", "h1_before_goal", "h1_after_goal", "accepted"]
    for i, row in logs[0].items():
        for log in logs[1:]:
            assert [np.nan if row[c] is None else row[c] for c in columns] == pytest.approx([np.nan if log[i][c] is None else log[i][c] for c in columns], rel=1e-6, abs=1e-7, nan_ok=True)
    mine = np.array([r[3:] for r in rows if r[0] == 1 and r[1] != 280]), np.array([float(r[2]) for r in rows if r[0] == 1 and r[1] != 280])
    place = np.delete(np.cumsum([0, *(r[2] for r in rows[:299])]), 280)
    assert logs[0][280].h1_after_source == pytest.approx(heterogeneity(Sites(*mine, place), 40).h1, rel=1e-6)


def test_distances_are_worked_out_once(spark, tmp_path):
    """Both ways of a pair come from one distance, and a file of them is shorter than its distances."""
    rng = np.random.default_rng(6)
    z = rng.normal(size=(2500, 2))
    df = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(z)], "station long, a double, b double")
    got = space.distances(df, "station", ["a", "b"])
    got.write.option("compression", "snappy").parquet(str(tmp_path / "pairs"))
    rows = spark.read.parquet(str(tmp_path / "pairs")).toPandas()
    assert len(rows) == 2500 * 2500 and not rows.duplicated(["station", "neighbour"]).any()
    x, y = z[rows["station"]], z[rows["neighbour"]]
    assert np.allclose(rows["distance"], np.sqrt(((x - y) ** 2).sum(1)), atol=1e-12)
    assert sum(f.stat().st_size for f in (tmp_path / "pairs").glob("*.parquet")) < 0.8 * 8 * len(rows)
