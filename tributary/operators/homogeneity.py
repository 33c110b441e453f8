"""Heterogeneity, distribution choice and growth curves of regions, by simulation.

Every call seeds its own generator, so a retried or speculative task gives the same numbers.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property, lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tributary.functions.blocks import spread
from tributary.functions.distributions import FAMILIES, RETURN_PERIODS, Fit, fitted, parent
from tributary.functions.lineage import stored
from tributary.operators import simulation
from tributary.operators.lmoments import CRITICAL, KURTOSIS

# The seed, and the sizes and bounds of tests.
SEED = 20260924
NSIM = 500
ACCEPT = 1.64
#: Discordancy needs so many sites.
LEAST_SITES = 5
#: Regions of more sites are simulated by blocks; ``simulation`` says how the results agree.
MOST_SITES = 2048
#: Results of regions of so many sites at most are kept in a process.
REMEMBERED = 64


@dataclass
class Sites:
    """A region: (t, t3, t4) and record length of each site, and the years before each one's
    draws where they don't follow each other."""

    ratios: np.ndarray
    years: np.ndarray
    places: np.ndarray | None = None

    def __len__(self) -> int:
        return len(self.years)

    def only(self, which) -> Sites:
        return Sites(self.ratios[which], self.years[which], None if self.places is None else self.places[which])

    def content(self) -> tuple[bytes, bytes, bytes | None]:
        return np.asarray(self.ratios, float).tobytes(), np.asarray(self.years, float).tobytes(), None if self.places is None else np.asarray(self.places, np.int64).tobytes()

    @classmethod
    def of_content(cls, ratios: bytes, years: bytes, places: bytes | None) -> Sites:
        return cls(np.frombuffer(ratios).reshape(-1, 3), np.frombuffer(years), None if places is None else np.frombuffer(places, np.int64))

    @cached_property
    def share(self) -> np.ndarray:
        return self.years / self.years.sum()

    @cached_property
    def means(self) -> np.ndarray:
        return self.share @ self.ratios

    def dispersion(self, ratios: np.ndarray) -> np.ndarray:
        """V1, V2, V3 of the sites' ratios, or of simulations of them in front."""
        off = (ratios - np.einsum("s,...sk->...k", self.share, ratios)[..., None, :]) ** 2
        first = np.sqrt(off[..., 0] @ self.share)
        return np.stack([first, np.sqrt(off[..., :2].sum(-1)) @ self.share, np.sqrt(off[..., 1:].sum(-1)) @ self.share], -1)

    def simulated(self, nsim: int, seed: int) -> tuple[np.ndarray, str] | None:
        """Ratios of simulated regions (simulation, site, ratio) and the parent's name; each
        site's draws follow those of the site before in one stream."""
        source = parent(*self.means)
        if source is None:
            return None
        return simulation.draws(source, self.years, 0 if self.places is None else self.places, nsim, seed), source.family

    def discordancy(self) -> np.ndarray:
        """Each site's distance from the region's centre in units of its scatter; a singular
        scatter is solved in the least-squares sense.  NaN for too few sites."""
        if len(self) < LEAST_SITES:
            return np.full(len(self), np.nan)
        off = self.ratios - self.ratios.mean(0)
        solved = np.linalg.lstsq(off.T @ off, off.T, rcond=None)[0]
        return len(self) / 3 * (off.T * solved).sum(0)


def critical(sites: int) -> float:
    return CRITICAL[sites - LEAST_SITES] if LEAST_SITES <= sites < LEAST_SITES + len(CRITICAL) else 3.0 if sites > LEAST_SITES else np.nan


@dataclass(frozen=True)
class Heterogeneity:
    h1: float = np.nan
    h2: float = np.nan
    h3: float = np.nan
    source: str = "none"


def heterogeneity(sites: Sites, nsim: int = NSIM, seed: int = SEED) -> Heterogeneity:
    """How far the sites' dispersion lies over that of homogeneous regions.  As a seed gives
    the same draws every time, equal small regions are simulated once in a process."""
    if len(sites) > REMEMBERED:
        return _heterogeneity(sites, nsim, seed)
    return _remembered_heterogeneity(*sites.content(), nsim, seed)


def _heterogeneity(sites: Sites, nsim: int, seed: int) -> Heterogeneity:
    found = sites.simulated(nsim, seed) if len(sites) > 1 else None
    if found is None:
        return Heterogeneity()
    by_chance = sites.dispersion(found[0])
    with np.errstate(divide="ignore", invalid="ignore"):
        h = (sites.dispersion(sites.ratios) - by_chance.mean(0)) / by_chance.std(0, ddof=1)
    return Heterogeneity(*map(float, h), found[1])


@lru_cache(maxsize=8192)
def _remembered_heterogeneity(ratios: bytes, years: bytes, places: bytes | None, nsim: int, seed: int) -> Heterogeneity:
    return _heterogeneity(Sites.of_content(ratios, years, places), nsim, seed)


@dataclass(frozen=True)
class Choice:
    """All families' Z, the chosen family and its growth curve."""

    means: tuple[float, float, float]
    z: dict[str, float]
    family: str | None
    accepted: bool
    curve: dict[int, float]


def kurtosis_error(sites: Sites, nsim: int, seed: int) -> tuple[float, float]:
    """Bias and deviation of the regional L-kurtosis, by simulation."""
    if len(sites) <= REMEMBERED:
        return _remembered_error(*sites.content(), nsim, seed)
    return _kurtosis_error(sites, nsim, seed)


@lru_cache(maxsize=8192)
def _remembered_error(ratios: bytes, years: bytes, places: bytes | None, nsim: int, seed: int) -> tuple[float, float]:
    return _kurtosis_error(Sites.of_content(ratios, years, places), nsim, seed)


def _kurtosis_error(sites: Sites, nsim: int, seed: int) -> tuple[float, float]:
    found = sites.simulated(nsim, seed)
    if found is None:
        return np.nan, np.nan
    t4 = found[0][..., 2] @ sites.share
    return float(t4.mean() - sites.means[2]), float(t4.std(ddof=1))


def goodness(means, error: tuple[float, float], kurtosis: Callable[[str], float]) -> dict[str, float]:
    """Z of each family, whose L-kurtosis is given, from the region's means and the simulated
    error of its L-kurtosis; NaN where it has none or nothing could be simulated."""
    bias, sigma = error
    return {f: float((kurtosis(f) - means[2] + bias) / sigma) if sigma > 0 else np.nan for f in FAMILIES}


def best(z: dict[str, float]) -> tuple[str | None, int]:
    """The family with the smallest Z among those accepted, else among all; how many are accepted."""
    known = [f for f in FAMILIES if np.isfinite(z[f])]
    accepted = [f for f in known if abs(z[f]) <= ACCEPT]
    return min(accepted or known, key=lambda f: abs(z[f]), default=None), len(accepted)


def chosen(means, error: tuple[float, float]) -> Choice:
    """The best family of a region with these means and this simulated error, and its curve."""
    fits: dict[str, Fit | None] = {f: fitted(f, *means[:2]) for f in FAMILIES}
    z = goodness(means, error, lambda f: fits[f].kurtosis if fits[f] else np.nan)
    family, accepted = best(z)
    curve = {p: fits[family].quantile(1 - 1 / p) if family else np.nan for p in RETURN_PERIODS}
    return Choice(tuple(map(float, means)), z, family, accepted > 0, curve)


def choose(sites: Sites, nsim: int = NSIM, seed: int = SEED) -> Choice:
    return chosen(sites.means, kurtosis_error(sites, nsim, seed))


def polynomial_kurtosis(family: str, t3: float) -> float:
    return sum(a * t3**k for k, a in enumerate(KURTOSIS[family]))


def by_region(members: DataFrame, region: str, work: Callable[[pd.DataFrame, Sites], tuple | None], fields: str) -> DataFrame:
    """One row (region, what ``work`` gives) for each region whose members have ratios; a
    region is a group of its own, of a few sites' moments, not their data.  A column ``_before``
    says where each site's draws begin."""
    names = [region, *(f.split()[0] for f in fields.split(", "))]
    given = [c for c in ("_before",) if c in members.columns]

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.dropna(subset=["t", "t3", "t4"]).sort_values("station")
        sites = Sites(rows[["t", "t3", "t4"]].to_numpy(float), rows["n"].to_numpy(float), rows["_before"].to_numpy(np.int64) if given else None)
        found = work(rows, sites) if len(rows) else None
        return pd.DataFrame([] if found is None else [(pdf[region].iloc[0], *found)], columns=names)

    kind = dict(members.dtypes)[region]
    return spread(members.select(region, "station", "n", "t", "t3", "t4", *given), region).groupBy(region).applyInPandas(one, f"{region} {kind}, {fields}")


def by_size(members: DataFrame, region: str) -> tuple[DataFrame, DataFrame | None]:
    """Members, stored, of the regions that a task can hold and of larger ones, if there are any."""
    rows = stored(members.select(region, "station", "n", "t", "t3", "t4", *(c for c in ("_before",) if c in members.columns)), "members")
    large = stored(rows.groupBy(region).agg(F.count(F.lit(1)).alias("_sites")).where(F.col("_sites") > MOST_SITES).select(region), "large")
    if large.isEmpty():
        return rows, None
    large = large.withColumnRenamed(region, "_large")
    same = F.col(region).eqNullSafe(F.col("_large"))
    return rows.join(large, same, "left_anti"), rows.join(large, same, "left_semi")


def by_kurtosis(blocks: simulation.Blocks, work: Callable[[int, np.ndarray, tuple[float, float]], tuple], fields: str) -> DataFrame:
    """A row (region, what ``work`` gives of sites, means and error) for each region in blocks."""
    names = [blocks.region, *(f.split()[0] for f in fields.split(", "))]

    def each(batches):
        for pdf in batches:
            yield pd.DataFrame([(r[0], *work(int(r[1]), np.array(r[2:5]), (r[5], r[6]))) for r in pdf.itertuples(index=False)], columns=names)

    return blocks.kurtosis().mapInPandas(each, f"{blocks.region} {blocks.kind}, {fields}")


def region_heterogeneity(members: DataFrame, region: str = "region", nsim: int = NSIM) -> DataFrame:
    """(region, sites, pooled, h1, h2, h3, simulated_by); H is NaN for regions of one site.
    Draws of sites begin at ``_before`` where there is such a column."""
    members, large = by_size(members, region)

    def work(rows: pd.DataFrame, sites: Sites) -> tuple:
        h = heterogeneity(sites, nsim)
        return len(sites), int(sites.years.sum()), h.h1, h.h2, h.h3, h.source

    small = by_region(members, region, work, "sites long, pooled long, h1 double, h2 double, h3 double, simulated_by string")
    return small.unionByName(simulation.Blocks(large, region, nsim, SEED).heterogeneity()) if large else small


def region_h1(members: DataFrame, region: str = "region", nsim: int = NSIM) -> DataFrame:
    """(region, h1) of ``region_heterogeneity``; large regions are simulated once, not twice."""
    members, large = by_size(members, region)
    small = by_region(members, region, lambda rows, sites: (heterogeneity(sites, nsim).h1,), "h1 double")
    return small.unionByName(simulation.Blocks(large, region, nsim, SEED).h1()) if large else small


def by_error(members: DataFrame, region: str, nsim: int, row: Callable[[int, np.ndarray, tuple[float, float]], tuple], fields: str) -> DataFrame:
    """What ``row`` gives of each region's number of sites, means and error of L-kurtosis."""
    members, large = by_size(members, region)
    small = by_region(members, region, lambda rows, sites: row(len(sites), sites.means, kurtosis_error(sites, nsim, SEED)), fields)
    return small.unionByName(by_kurtosis(simulation.Blocks(large, region, nsim, SEED), row, fields)) if large else small


FITTED = "t_r double, t3_r double, t4_r double, chosen_distribution string, chosen_accepted boolean, " + ", ".join([f"z_{f.lower()} double" for f in FAMILIES] + [f"q_t{p} double" for p in RETURN_PERIODS])


def region_fits(members: DataFrame, region: str = "region", nsim: int = NSIM) -> DataFrame:
    """Means, chosen family, Z of all families and the growth curve of each region."""

    def row(sites: int, means: np.ndarray, error: tuple[float, float]) -> tuple:
        c = chosen(means, error)
        return sites, *c.means, c.family, c.accepted, *c.z.values(), *c.curve.values()

    return by_error(members, region, nsim, row, "sites long, " + FITTED)


def curve_rows(fits: DataFrame, region: str = "region") -> DataFrame:
    """(region, family, period, q) of fitted regions, a row for each return period."""
    each = F.array(*(F.struct(F.lit(p).alias("period"), F.col(f"q_t{p}").alias("q")) for p in RETURN_PERIODS))
    return fits.select(region, F.col("chosen_distribution").alias("family"), F.inline(each)).where("family is not null")


def polynomial_goodness(members: DataFrame, region: str = "region", nsim: int = NSIM) -> DataFrame:
    """Z of all families by their polynomials of L-kurtosis, and the best of the accepted
    ones, else of all."""

    def row(sites: int, means: np.ndarray, error: tuple[float, float]) -> tuple:
        z = goodness(means, error, lambda f: polynomial_kurtosis(f, means[1]))
        return sites, *best(z), *z.values()

    return by_error(members, region, nsim, row, "sites long, family string, accepted long, " + ", ".join(f"z_{f.lower()} double" for f in FAMILIES))


def family_curve(regions: DataFrame, family: str, *keys: str) -> DataFrame:
    """(keys..., period, q) of one family for all regions that it can be fitted to; each
    region is fitted once."""
    keys = keys or ("region",)
    names = [*keys, "period", "q"]

    def work(batches):
        for pdf in batches:
            fits = [fitted(family, t, t3) for t, t3 in zip(pdf["t_r"], pdf["t3_r"])]
            q = [(*row, p, x) for row, f in zip(pdf[list(keys)].itertuples(index=False), fits) if f for p, x in zip(RETURN_PERIODS, f.quantile(1 - 1 / np.array(RETURN_PERIODS)))]
            yield pd.DataFrame(q, columns=names)

    kinds = dict(regions.dtypes)
    return regions.select(*keys, "t_r", "t3_r").mapInPandas(work, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", period int, q double")


def tested_regions(members: DataFrame, region: str = "region", nsim: int = NSIM) -> DataFrame:
    """Fixed regions: discordant sites, H with and without them, and the distribution that fits
    the cleaned region.  A region is cleaned where five sites or more remain; one of fewer
    than five sites is not tested, as ``note`` says."""
    fields = "sites long, pooled long, critical double, max_di double, discordant array<string>, h1_all double, h1 double, h2 double, h3 double, simulated_by string, chosen_distribution string, note string"

    def work(rows: pd.DataFrame, sites: Sites) -> tuple:
        head = len(sites), int(sites.years.sum())
        if len(sites) < LEAST_SITES:
            return *head, np.nan, np.nan, [], *(np.nan,) * 4, "none", None, "too few sites to test"
        limit, di = critical(len(sites)), sites.discordancy()
        fine = di <= limit
        cleaned = sites.only(fine) if not fine.all() and fine.sum() >= LEAST_SITES else sites
        every = heterogeneity(sites, nsim)
        h = every if cleaned is sites else heterogeneity(cleaned, nsim)
        note = "discordant sites removed" if cleaned is not sites else "" if fine.all() else "too few sites left without the discordant ones"
        return *head, limit, float(di.max()), rows["station"][~fine].astype(str).tolist(), every.h1, h.h1, h.h2, h.h3, h.source, choose(cleaned, nsim).family, note

    return by_region(members, region, work, fields)
