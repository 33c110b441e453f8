"""Simulation of regions with more sites than one task should hold.

Sites lie in blocks of bounded size.  A site's draws begin where those of the sites before it
end, so a block moves the generator on to its first site and draws what the whole region would
draw there.  A first pass gives every simulated region's means as sums over blocks, a second
one its dispersion about them.  Sums are added up in another order than on one machine, so
the means' last digits may differ, which the solver of the parent's shapes magnifies: results
agree to about eight digits, where the parent's shape is next to 0 to about four.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tributary.functions.blocks import spread
from tributary.functions.distributions import drawn_ratios, parent
from tributary.functions.lineage import stored

#: Sites of a block at most.
BLOCK = 512
RATIOS = ["t", "t3", "t4"]


def draws(source, years: np.ndarray, before: int | np.ndarray, nsim: int, seed: int) -> np.ndarray:
    """Ratios (simulation, site, ratio) of sites whose region has ``before`` years before them,
    or before each of them."""
    years = np.asarray(years, np.int64)
    earlier = before + np.cumsum(years) - years if np.ndim(before) == 0 else np.asarray(before, np.int64)
    return np.stack([drawn_ratios(source, seed, nsim, n, at) for n, at in zip(years.tolist(), earlier.tolist())], 1)


def drawn(pdf: pd.DataFrame, nsim: int, seed: int) -> tuple[str, np.ndarray, np.ndarray] | None:
    """The parent's name, the years and the ratios of a block's simulated sites."""
    pdf = pdf.sort_values("_before", kind="stable")
    source = parent(*pdf[[f"{c}_r" for c in RATIOS]].iloc[0])
    if source is None:
        return None
    years = pdf["n"].to_numpy(float)
    return source.family, years, draws(source, years, pdf["_before"].to_numpy(), nsim, seed)


class Blocks:
    """Members (region, station, n, t, t3, t4) of regions in blocks, in order of their station;
    those without ratios take no part.  A column ``_before`` says where each one's draws begin."""

    def __init__(self, members: DataFrame, region: str, nsim: int, seed: int):
        self.nsim, self.seed, self.region = nsim, seed, region
        self.kind = dict(members.dtypes)[region]
        rows = members.select(F.col(region).alias("_name"), "station", F.col("n").cast("double").alias("n"), *(F.col(c).cast("double").alias(c) for c in RATIOS), (F.col("_before") if "_before" in members.columns else F.lit(None)).cast("long").alias("_given")).dropna(subset=RATIOS)
        # A number for each region, as a name may be null.
        whole = rows.groupBy("_name").agg(F.count(F.lit(1)).alias("sites"), F.sum("n").alias("years"), *(F.try_divide(F.sum(F.col("n") * F.col(c)), F.sum("n")).alias(f"{c}_r") for c in RATIOS))
        self.whole = stored(whole.withColumn("_region", F.monotonically_increasing_id()), "whole")
        number = self.whole.select(F.col("_name").alias("_other"), "_region", *(f"{c}_r" for c in RATIOS))
        known = rows.join(number, F.col("_name").eqNullSafe(F.col("_other"))).drop("_name", "_other")
        dealt = stored(known.repartitionByRange("_region", "station").withColumn("_part", F.spark_partition_id()), "dealt")
        part = ["_region", "_part"]
        # The years before each part of a region, of which there are few, then those inside it.
        totals = dealt.groupBy(*part).agg(F.sum("n").alias("_total"))
        earlier = totals.select(*part, (F.sum("_total").over(Window.partitionBy("_region").orderBy("_part")) - F.col("_total")).alias("_earlier"))
        w = Window.partitionBy(*part).orderBy("station")
        placed = dealt.withColumns({"_inside": F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), "_block": F.floor((F.row_number().over(w) - 1) / BLOCK)})
        before = F.coalesce("_given", (F.col("_earlier") + F.coalesce("_inside", F.lit(0.0))).cast("long")).alias("_before")
        self.sites = stored(placed.join(earlier, part).select(*part, "_block", "station", "n", *RATIOS, *(f"{c}_r" for c in RATIOS), before), "sites")

    def _regional(self, sums: DataFrame, names: list[str]) -> DataFrame:
        """(_region, sim, names..., source): sums over blocks for a year of the region."""
        total = sums.groupBy("_region", "sim").agg(F.first("source").alias("source"), *(F.sum(c).alias(c) for c in names))
        return total.join(self.whole.select("_region", "years"), "_region").select("_region", "sim", "source", *((F.col(c) / F.col("years")).alias(c) for c in names))

    def means(self) -> DataFrame:
        """(_region, sim, t, t3, t4, source): means of every simulated region, stored."""
        nsim, seed, columns = self.nsim, self.seed, ["_region", "sim", *RATIOS, "source"]

        def work(pdf: pd.DataFrame) -> pd.DataFrame:
            found = drawn(pdf, nsim, seed)
            if found is None:
                return pd.DataFrame(columns=columns)
            source, years, ratios = found
            sums = dict(zip(RATIOS, np.einsum("s,nsk->kn", years, ratios)))
            return pd.DataFrame({"_region": pdf["_region"].iloc[0], "sim": np.arange(nsim), **sums, "source": source})[columns]

        schema = "_region long, sim int, t double, t3 double, t4 double, source string"
        return stored(self._regional(spread(self.sites, "_region", "_part", "_block").groupBy("_region", "_part", "_block").applyInPandas(work, schema), RATIOS), "means")

    def dispersions(self) -> DataFrame:
        """(_region, sim, v1, v2, v3, source) of every simulated region."""
        nsim, seed, columns = self.nsim, self.seed, ["_region", "sim", "v1", "v2", "v3", "source"]
        key = ["_region", "_part", "_block"]
        # Columns of its own.
        centres = self.sites.select(*(F.col(c).alias(c) for c in key)).distinct().join(self.means().drop("source"), "_region")

        def work(pdf: pd.DataFrame, centre: pd.DataFrame) -> pd.DataFrame:
            found = drawn(pdf, nsim, seed) if len(pdf) and len(centre) else None
            if found is None:
                return pd.DataFrame(columns=columns)
            source, years, ratios = found
            off = (ratios - centre.sort_values("sim")[RATIOS].to_numpy(float)[:, None]) ** 2
            sums = [off[..., 0] @ years, np.sqrt(off[..., :2].sum(-1)) @ years, np.sqrt(off[..., 1:].sum(-1)) @ years]
            return pd.DataFrame({"_region": pdf["_region"].iloc[0], "sim": np.arange(nsim), "v1": sums[0], "v2": sums[1], "v3": sums[2], "source": source})[columns]

        schema = "_region long, sim int, v1 double, v2 double, v3 double, source string"
        sums = spread(self.sites, *key).groupBy(*key).cogroup(spread(centres, *key).groupBy(*key)).applyInPandas(work, schema)
        return self._regional(sums, ["v1", "v2", "v3"]).withColumn("v1", F.sqrt("v1"))

    def observed(self) -> DataFrame:
        """(_region, o1, o2, o3): the dispersions of the sites themselves."""
        a, b, c = ((F.col(x) - F.col(f"{x}_r")) ** 2 for x in RATIOS)
        mean = lambda x: F.sum(F.col("n") * x) / F.sum("n")
        return self.sites.groupBy("_region").agg(F.sqrt(mean(a)).alias("o1"), mean(F.sqrt(a + b)).alias("o2"), mean(F.sqrt(b + c)).alias("o3"))

    def heterogeneity(self) -> DataFrame:
        """(region, sites, pooled, h1, h2, h3, simulated_by)."""
        stats = [f(v).alias(f"{n}{v}") for v in ("v1", "v2", "v3") for n, f in (("m", F.avg), ("s", F.stddev_samp))]
        chance = self.dispersions().groupBy("_region").agg(*stats, F.first("source").alias("source"))
        rows = self.whole.join(self.observed(), "_region").join(chance, "_region", "left")
        h = (_over(F.col(f"o{i}") - F.col(f"mv{i}"), F.col(f"sv{i}")).alias(f"h{i}") for i in (1, 2, 3))
        return rows.select(F.col("_name").alias(self.region), "sites", F.col("years").cast("long").alias("pooled"), *h, F.coalesce("source", F.lit("none")).alias("simulated_by"))

    def h1(self) -> DataFrame:
        """(region, h1) alone, from one pass: the dispersion of a simulated region's L-CV needs
        no more than their sum and that of their squares, taken about the region's own mean."""
        nsim, seed, columns = self.nsim, self.seed, ["_region", "sim", "first", "second", "source"]

        def work(pdf: pd.DataFrame) -> pd.DataFrame:
            found = drawn(pdf, nsim, seed)
            if found is None:
                return pd.DataFrame(columns=columns)
            source, years, ratios = found
            off = ratios[..., 0] - pdf["t_r"].iloc[0]
            return pd.DataFrame({"_region": pdf["_region"].iloc[0], "sim": np.arange(nsim), "first": off @ years, "second": (off * off) @ years, "source": source})[columns]

        key = ["_region", "_part", "_block"]
        sums = spread(self.sites, *key).groupBy(*key).applyInPandas(work, "_region long, sim int, first double, second double, source string")
        v1 = F.sqrt(F.greatest(F.col("second") - F.col("first") ** 2, F.lit(0.0)))
        chance = self._regional(sums, ["first", "second"]).groupBy("_region").agg(F.avg(v1).alias("m"), F.stddev_samp(v1).alias("s"))
        rows = self.whole.join(self.observed(), "_region").join(chance, "_region", "left")
        return rows.select(F.col("_name").alias(self.region), _over(F.col("o1") - F.col("m"), F.col("s")).alias("h1"))

    def kurtosis(self) -> DataFrame:
        """(region, sites, t_r, t3_r, t4_r, bias, sigma) of the regional L-kurtosis; the last
        two are null where nothing could be simulated."""
        chance = self.means().groupBy("_region").agg(F.avg("t4").alias("_t4"), F.stddev_samp("t4").alias("sigma"))
        rows = self.whole.join(chance, "_region", "left")
        return rows.select(F.col("_name").alias(self.region), "sites", *(f"{c}_r" for c in RATIOS), (F.col("_t4") - F.col("t4_r")).alias("bias"), "sigma")


def _over(a: Column, b: Column) -> Column:
    """A quotient as floating-point numbers have it, NaN for what is unknown."""
    by_zero = F.when(a > 0, F.lit(float("inf"))).when(a < 0, F.lit(float("-inf"))).otherwise(F.lit(float("nan")))
    return F.coalesce(F.when(b == 0, by_zero).otherwise(F.try_divide(a, b)), F.lit(float("nan")))
