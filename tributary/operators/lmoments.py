"""L-moments of samples and regions, discordancy and dispersion."""

from __future__ import annotations

import math
from functools import reduce
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def sample_lmoments(values: DataFrame, station: str = "station", x: str = "ams") -> DataFrame:
    """(station, n, l1, l2, t, t3, t4) from unbiased probability-weighted moments.

    Fewer than four values give null moments; a zero mean null ``t``; a constant sample null
    ``t3`` and ``t4``.
    """
    w = Window.partitionBy(station)
    rows = values.where(F.col(x).isNotNull()).select(F.col(station).alias("station"), F.col(x).cast("double").alias("x"))
    rows = rows.withColumn("j", F.row_number().over(Window.partitionBy("station").orderBy("x")).cast("double")).withColumn("n", F.count(F.lit(1)).over(w.partitionBy("station")).cast("double"))
    w1 = (F.col("j") - 1) / F.nullif(F.col("n") - 1, F.lit(0.0))
    w2 = w1 * (F.col("j") - 2) / F.nullif(F.col("n") - 2, F.lit(0.0))
    w3 = w2 * (F.col("j") - 3) / F.nullif(F.col("n") - 3, F.lit(0.0))
    b = rows.groupBy("station").agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("b0"), *(F.avg(wk * F.col("x")).alias(f"b{k}") for k, wk in enumerate((w1, w2, w3), 1)))
    whole = F.col("n") >= 4
    b0, b1, b2, b3 = (F.when(whole, F.col(f"b{k}")) for k in range(4))
    l2 = 2 * b1 - b0
    m = b.select("station", "n", b0.alias("l1"), l2.alias("l2"), (6 * b2 - 6 * b1 + b0).alias("l3"), (20 * b3 - 30 * b2 + 12 * b1 - b0).alias("l4"))
    flat = F.abs("l2") > 1e-12 * F.abs("l1")
    return m.select("station", "n", "l1", "l2", F.when(F.col("l1") != 0, F.col("l2") / F.col("l1")).alias("t"), F.when(flat, F.col("l3") / F.col("l2")).alias("t3"), F.when(flat, F.col("l4") / F.col("l2")).alias("t4"))


def regional_means(members: DataFrame, region: str = "region") -> DataFrame:
    """Record-length-weighted means of the ratios, pooled length and size of each region."""
    mean = lambda c: F.sum(F.col("n") * F.col(c)) / F.sum("n")
    return members.groupBy(region).agg(F.count(F.lit(1)).alias("sites"), F.sum("n").alias("pooled"), mean("t").alias("t_r"), mean("t3").alias("t3_r"), mean("t4").alias("t4_r"))


def dispersion(members: DataFrame, region: str = "region") -> DataFrame:
    """V1, V2 and V3 of each region."""
    both = members.join(regional_means(members, region).drop("sites", "pooled"), region)
    d1, d3, d4 = F.col("t") - F.col("t_r"), F.col("t3") - F.col("t3_r"), F.col("t4") - F.col("t4_r")
    mean = lambda x: F.sum(F.col("n") * x) / F.sum("n")
    return both.groupBy(region).agg(F.sqrt(mean(d1 * d1)).alias("v1"), mean(F.sqrt(d1 * d1 + d3 * d3)).alias("v2"), mean(F.sqrt(d3 * d3 + d4 * d4)).alias("v3"))


# Critical discordancy for 5 to 14 sites; 3 from 15 on.
CRITICAL = (1.333, 1.648, 1.917, 2.140, 2.329, 2.491, 2.632, 2.757, 2.869, 2.971)


def critical_discordancy(sites: Column) -> Column:
    return F.when(sites < 5, F.lit(None).cast("double")).when(sites > 14, F.lit(3.0)).otherwise(F.element_at(F.array(*map(F.lit, CRITICAL)), (sites - 4).cast("int")))


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _inverse(uu: pd.Series, uv: pd.Series, uw: pd.Series, vv: pd.Series, vw: pd.Series, ww: pd.Series) -> pd.Series:
    """(uu, uv, uw, vv, vw, ww) of the pseudo-inverse of each symmetric matrix."""
    m = np.stack([uu, uv, uw, uv, vv, vw, uw, vw, ww], -1).astype(float).reshape(-1, 3, 3)
    fine = np.isfinite(m).all((1, 2))
    out = np.full(m.shape, np.nan)
    out[fine] = np.linalg.pinv(m[fine], rcond=1e-12, hermitian=True)
    return pd.Series(list(out[:, [0, 0, 0, 1, 1, 2], [0, 1, 2, 1, 2, 2]]))


def discordancy(members: DataFrame, region: str = "region") -> DataFrame:
    """(region, station, di, critical): null for regions of fewer than five sites.  Nine sums
    and the (pseudo-)inverse of a 3 by 3 matrix for each region; sites are an expression."""
    names = ("uu", "uv", "uw", "vv", "vw", "ww")
    means = members.groupBy(region).agg(F.count(F.lit(1)).alias("sites"), *(F.avg(c).alias(f"m_{c}") for c in ("t", "t3", "t4")))
    d = members.join(means, region).select(region, "station", "sites", *((F.col(c) - F.col(f"m_{c}")).alias(k) for c, k in (("t", "u"), ("t3", "v"), ("t4", "w"))))
    s = d.groupBy(region).agg(*(F.sum(F.col(a) * F.col(b)).alias(a + b) for a, b in names)).select(region, _inverse(*names).alias("inverse"))
    form = sum(((1 if a == b else 2) * F.col(a) * F.col(b) * F.col("inverse")[k] for k, (a, b) in enumerate(names)), F.lit(0.0))
    di = F.when(F.col("sites") >= 5, F.col("sites") / 3.0 * form)
    return d.join(s, region).select(region, "station", di.alias("di"), critical_discordancy(F.col("sites")).alias("critical"))


# L-kurtosis as a polynomial of L-skewness, powers 0 to 8.
KURTOSIS = {
    "GLO": (0.16667, 0, 0.83333, 0, 0, 0, 0, 0, 0),
    "GEV": (0.10701, 0.11090, 0.84838, -0.06669, 0.00567, -0.04208, 0.03763, 0, 0),
    "GPA": (0, 0.20196, 0.95924, -0.20096, 0.04061, 0, 0, 0, 0),
    "GNO": (0.12282, 0, 0.77518, 0, 0.12279, 0, -0.13638, 0, 0.11368),
    "PE3": (0.12240, 0, 0.30115, 0, 0.95812, 0, -0.57488, 0, 0.19383),
}


def model_kurtosis(family: str, t3: Column) -> Column:
    return sum((F.lit(float(a)) * F.pow(t3, F.lit(float(k))) for k, a in enumerate(KURTOSIS[family]) if a), F.lit(0.0))


def nearest_family(regions: DataFrame, region: str = "region") -> DataFrame:
    """The family whose L-kurtosis at the region's L-skewness is nearest; of equals the first."""
    each = F.array(*(F.struct(F.abs(model_kurtosis(f, F.col("t3_r")) - F.col("t4_r")).alias("gap"), F.lit(k).alias("k"), F.lit(f).alias("family")) for k, f in enumerate(KURTOSIS)))
    return regions.withColumn("x", F.array_min(each)).select(region, F.col("x.family").alias("family"), F.col("x.gap").alias("gap"))


RETURN_PERIODS = (2, 5, 10, 25, 50, 100)


def growth_curve_glo(regions: DataFrame, *keys: str) -> DataFrame:
    """(keys..., period, q): generalised logistic curves with mean 1."""
    keys = keys or ("region",)
    k = -F.col("t3_r")
    a = F.when(F.abs(k) > 1e-6, F.col("t_r") * F.sin(k * F.pi()) / (k * F.pi())).otherwise(F.col("t_r"))
    x = F.when(F.abs(k) > 1e-6, 1 - a * (1 / k - F.pi() / F.sin(k * F.pi()))).otherwise(F.lit(1.0))
    rows = regions.select(*keys, k.alias("k"), a.alias("a"), x.alias("x"), F.explode(F.array(*map(F.lit, RETURN_PERIODS))).alias("period"))
    odds = F.lit(1.0) / (F.col("period") - 1)  # (1 - F) / F
    q = F.when(F.abs("k") > 1e-6, F.col("x") + F.col("a") / F.col("k") * (1 - F.pow(odds, F.col("k")))).otherwise(F.col("x") - F.col("a") * F.ln(odds))
    return rows.select(*keys, "period", q.alias("q"))


def growth_curve_gpa(regions: DataFrame, *keys: str) -> DataFrame:
    """Generalised Pareto curves, where the L-skewness is in the range that can be fitted."""
    keys = keys or ("region",)
    fine = regions.where("t3_r > 0.0256 and t3_r < 0.905")
    k = (1 - 3 * F.col("t3_r")) / (1 + F.col("t3_r"))
    rows = fine.select(*keys, k.alias("k"), ((1 + k) * (2 + k) * F.col("t_r")).alias("a"), (1 - F.col("t_r") * (2 + k)).alias("x"), F.explode(F.array(*map(F.lit, RETURN_PERIODS))).alias("period"))
    s = F.lit(1.0) / F.col("period")
    q = F.when(F.abs("k") > 1e-9, F.col("x") + F.col("a") / F.col("k") * (1 - F.pow(s, F.col("k")))).otherwise(F.col("x") - F.col("a") * F.ln(s))
    return rows.select(*keys, "period", q.alias("q"))


def growth_curve_gev(regions: DataFrame, *keys: str) -> DataFrame:
    """Generalised extreme-value curves by the published approximation of the shape.  Gamma
    comes from Stirling's series, taken eight further up."""
    keys = keys or ("region",)
    c = 2 / (3 + F.col("t3_r")) - math.log(2) / math.log(3)
    rows = regions.select(*keys, "t_r", (7.8590 * c + 2.9554 * c * c).alias("k"))
    rows = rows.withColumn("k", F.when(F.abs("k") >= 1e-4, F.col("k")).when(F.col("k") < 0, -1e-4).otherwise(1e-4))
    y = F.col("k") + 9  # gamma(1 + k) = gamma(k + 9) / ((k + 1)...(k + 8))
    stirling = (y - 0.5) * F.ln(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5)
    rows = rows.withColumn("g", F.exp(stirling) / reduce(lambda a, b: a * b, (F.col("k") + i for i in range(1, 9))))
    rows = rows.withColumn("a", F.col("t_r") * F.col("k") / ((1 - F.pow(F.lit(2.0), -F.col("k"))) * F.col("g")))
    rows = rows.withColumn("x", 1 - F.col("a") * (1 - F.col("g")) / F.col("k")).withColumn("period", F.explode(F.array(*map(F.lit, RETURN_PERIODS))))
    q = F.col("x") + F.col("a") / F.col("k") * (1 - F.pow(-F.ln(1 - 1 / F.col("period")), F.col("k")))
    return rows.select(*keys, "period", q.alias("q"))


# The rational approximation of the generalised normal's shape.
NORMAL_SHAPE = ((2.0466534, -3.6544371, 1.8396733, -0.20360244), (1.0, -2.0182173, 1.2033464, -0.40077113))


def error_function(x: Column, terms: int = 60) -> Column:
    """erf by its series of positive terms; for |x| up to three to the last digits."""
    factors = [1.0]
    for n in range(1, terms):
        factors.append(factors[-1] * 2 / (2 * n + 1))
    series = F.aggregate(F.array(*map(F.lit, reversed(factors))), F.lit(0.0), lambda total, c: total * x * x + c)
    return 2 / math.sqrt(math.pi) * F.exp(-x * x) * x * series


def growth_curve_gno(regions: DataFrame, *keys: str) -> DataFrame:
    """Generalised normal curves by the published approximation of the shape, good for an
    L-skewness within 0.94 either way; beyond it there is no curve."""
    keys = keys or ("region",)
    square = F.col("t3_r") * F.col("t3_r")
    upper, lower = (sum((F.pow(square, F.lit(float(i))) * c for i, c in enumerate(cs)), F.lit(0.0)) for cs in NORMAL_SHAPE)
    rows = regions.where("abs(t3_r) <= 0.94").select(*keys, "t_r", (-F.col("t3_r") * upper / lower).alias("k"))
    k, flat = F.col("k"), F.abs("k") < 1e-8
    a = F.when(flat, F.col("t_r") * math.sqrt(math.pi)).otherwise(F.col("t_r") * k * F.exp(-k * k / 2) / error_function(k / 2))
    rows = rows.withColumn("a", a).withColumn("x", F.when(flat, 1.0).otherwise(1 - F.col("a") * (1 - F.exp(k * k / 2)) / k))
    points = F.array(*(F.struct(F.lit(p).alias("period"), F.lit(NormalDist().inv_cdf(1 - 1 / p)).alias("z")) for p in RETURN_PERIODS))
    rows = rows.select(*keys, "k", "a", "x", F.inline(points))
    q = F.col("x") + F.when(F.abs("k") < 1e-8, F.col("a") * F.col("z")).otherwise(F.col("a") * (1 - F.exp(-F.col("k") * F.col("z"))) / F.col("k"))
    return rows.select(*keys, "period", q.alias("q"))


def design_values(curves: DataFrame, index: DataFrame, region: str = "region") -> DataFrame:
    """Q(T) = mu q(T) for every station; null where mu is."""
    return index.join(curves, region).select("station", "period", (F.col("mu") * F.col("q")).alias("design"))
