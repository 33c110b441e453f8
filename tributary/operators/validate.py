"""Leave-one-out tests of regions, growth curves and the whole ungauged chain."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tributary.functions.distributions import RETURN_PERIODS
from tributary.operators import lmoments
from tributary.operators.homogeneity import choose, family_curve
from tributary.operators.roi import Region, Rules, over_targets, region_members
from tributary.operators.selection import percent_error


def ungauged(stations: DataFrame, columns: list[str], index: DataFrame, rules: Rules = Rules(), nsim: int = 500) -> DataFrame:
    """(station, period, jaccard, family, q_pool, q_site, design, computed, percent_error).

    For each station the region is grown with and without its own flow; the pool's curve
    times the leave-one-out index (``station, observed, estimate``) is held against the
    station's own fit times its own mean.  Stations are spread over the cluster.
    """

    def work(names: list, regions: list[Region]) -> list[dict]:
        target, sites = regions[0].target, regions[0].sites
        own, pool = set(regions[0].members) - {target}, regions[1].members[1:]
        if not pool:
            return []
        union = own | set(pool)
        overlap = len(own & set(pool)) / len(union) if union else 1.0
        region, site = choose(sites.only(pool), nsim), choose(sites.only([target]), nsim)
        return [{"station": names[target], "period": p, "jaccard": overlap, "family": region.family, "q_pool": region.curve[p], "q_site": site.curve[p]} for p in RETURN_PERIODS]

    fields = f"station: {dict(stations.dtypes)['station']}, period: int, jaccard: double, family: string, q_pool: double, q_site: double"
    curves = over_targets(stations, columns, [rules, replace(rules, use_target_flow=False)], work, fields)
    both = curves.join(index.select("station", "observed", "estimate"), "station")
    both = both.withColumns({"design": F.col("q_pool") * F.col("estimate"), "computed": F.col("q_site") * F.col("observed")})
    return both.select("station", "period", "jaccard", "family", "q_pool", "q_site", "design", "computed", percent_error(F.col("design"), F.col("computed")).alias("percent_error"))


def overlap_with(regions: DataFrame, others: DataFrame) -> DataFrame:
    """Jaccard index of two sets of regions' members, without the station itself."""
    a = region_members(regions).where("member <> station").select("station", "member").withColumn("a", F.lit(1))
    b = region_members(others).where("member <> station").select("station", "member").withColumn("b", F.lit(1))
    both = a.join(b, ["station", "member"], "full_outer").groupBy("station").agg(F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("shared"), F.count(F.lit(1)).alias("any"))
    return both.select("station", (F.col("shared") / F.col("any")).alias("jaccard"))


def curves_without_target(members: DataFrame, pools: DataFrame, family: str, least: int = 5) -> DataFrame:
    """(station, period, at_site, roi, cluster): growth factors of a station's own record, of
    its pool, and of its region less itself; null where fewer than ``least`` sites are left.

    Region sums less the station's own terms give its fold, so no fold reads the members again.
    """
    w = ["n", "nt", "nt3"]
    m = members.select("station", "region", "n", "t", "t3").withColumns({"nt": F.col("n") * F.col("t"), "nt3": F.col("n") * F.col("t3")})
    whole = m.groupBy("region").agg(*(F.sum(c).alias(f"all_{c}") for c in w), F.count(F.lit(1)).alias("sites"))
    rest = m.join(whole, "region").where(F.col("sites") > least).select("station", *((F.col(f"all_{c}") - F.col(c)).alias(c) for c in w))
    pooled = pools.select(F.col("station").alias("target"), F.col("neighbour").alias("station")).join(m, "station").where("station <> target")
    pooled = pooled.groupBy(F.col("target").alias("station")).agg(*(F.sum(c).alias(c) for c in w), F.count(F.lit(1)).alias("sites")).where(F.col("sites") >= least)
    parts = {"at_site": m, "roi": pooled, "cluster": rest}
    tagged = [p.select(F.lit(k).alias("kind"), "station", (F.col("nt") / F.col("n")).alias("t_r"), (F.col("nt3") / F.col("n")).alias("t3_r")) for k, p in parts.items()]
    every = tagged[0].unionByName(tagged[1]).unionByName(tagged[2])
    # The logistic curve is an expression; the others are fitted.
    curves = lmoments.growth_curve_glo(every.where("abs(t3_r) <= 0.9"), "kind", "station") if family == "GLO" else family_curve(every, family, "kind", "station")
    one = lambda k: F.max(F.when(F.col("kind") == k, F.col("q"))).alias(k)
    return curves.groupBy("station", "period").agg(*map(one, parts)).where("at_site is not null")


def compared(curves: DataFrame) -> DataFrame:
    """Bias and root mean square of both methods' percent errors by period, and the better."""
    errors = curves.select("period", *((100 * (F.col(c) / F.col("at_site") - 1)).alias(c) for c in ("roi", "cluster")))
    rms = lambda c: F.sqrt(F.avg(F.col(c) * F.col(c)))
    return errors.groupBy("period").agg(
        F.avg("roi").alias("roi_bias"), rms("roi").alias("roi_rmse"), F.avg("cluster").alias("cluster_bias"), rms("cluster").alias("cluster_rmse"), F.when(rms("roi") < rms("cluster"), "ROI").otherwise("cluster").alias("winner")
    )
