"""Summaries of attributes and errors."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def long(df: DataFrame, columns: list[str], *keep: str) -> DataFrame:
    """(keep..., attribute, x): a row for each value."""
    return df.select(*keep, F.explode(F.map_from_arrays(F.array(*map(F.lit, columns)), F.array(*(F.col(c).cast("double") for c in columns)))).alias("attribute", "x"))


def describe(df: DataFrame, columns: list[str]) -> DataFrame:
    """Count, mean, sd (n-1), extremes and quartiles (linear) of each column."""
    q = lambda p: F.percentile("x", F.lit(p))
    return long(df, columns).groupBy("attribute").agg(
        F.count("x").alias("n"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"), F.min("x").alias("min"), q(0.25).alias("q25"), q(0.5).alias("q50"), q(0.75).alias("q75"), F.max("x").alias("max")
    )


def adjusted_skewness(x: Column | str) -> Column:
    """Sample skewness without bias; null for fewer than three values."""
    n = F.count(x)
    return F.when(n > 2, F.skewness(x) * F.sqrt(n * (n - 1)) / (n - 2))


def correlations(df: DataFrame, columns: list[str], least: int = 2) -> DataFrame:
    """(a, b, r, n) of each pair of columns, over rows that have both, finite; pairs with
    ``least`` rows or more.  One pass over the data."""
    exprs = []
    for a, b in combinations(columns, 2):
        fine = F.col(a).isNotNull() & F.col(b).isNotNull() & (F.abs(a) < float("inf")) & (F.abs(b) < float("inf")) & ~F.isnan(a) & ~F.isnan(b)
        exprs.append(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.corr(F.when(fine, F.col(a)), F.when(fine, F.col(b))).alias("r"), F.count_if(fine).alias("n")))
    return df.agg(F.array(*exprs).alias("x")).select(F.inline("x")).where(F.col("n") >= least)


def histogram(df: DataFrame, x: str, bins: int = 10) -> DataFrame:
    """Equal bins between the extremes; the last holds its upper end."""
    ends = df.agg(F.min(x).alias("low"), F.max(x).alias("high"))
    at = F.least(F.lit(bins - 1), F.floor((F.col(x) - F.col("low")) / (F.col("high") - F.col("low")) * bins)).cast("int")
    counts = df.where(F.col(x).isNotNull()).join(F.broadcast(ends)).groupBy(F.coalesce(at, F.lit(0)).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin")).join(F.broadcast(counts), "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


def error_quantiles(errors: DataFrame, by: str, error: str) -> DataFrame:
    q = lambda p: F.percentile(F.abs(error), F.lit(p))
    return errors.groupBy(by).agg(q(0.25).alias("q25"), q(0.5).alias("q50"), q(0.75).alias("q75"))


def error_summary(errors: DataFrame, by: str, error: str) -> DataFrame:
    """Bias, root mean square, median size, and shares within 25 and 50."""
    e = F.col(error)
    share = lambda most: F.avg((F.abs(e) <= most).cast("double")) * 100
    return errors.groupBy(by).agg(F.avg(e).alias("bias"), F.sqrt(F.avg(e * e)).alias("rmse"), F.percentile(F.abs(e), F.lit(0.5)).alias("median_abs"), share(25).alias("within_25"), share(50).alias("within_50"))


def flow_ratios(df: DataFrame, key: str, largest: str, mean: str, smallest: str) -> DataFrame:
    """Share of zero minima, mean of maximum to minimum (infinite ones left out) and of
    maximum to mean, per key."""
    return df.groupBy(F.col(key).alias("key")).agg(
        F.avg((F.col(smallest) <= 0).cast("double")).alias("zero_share"),
        F.avg(F.when(F.col(smallest) > 0, F.col(largest) / F.col(smallest))).alias("max_over_min"),
        F.avg(F.when(F.col(mean) != 0, F.col(largest) / F.col(mean))).alias("peak_to_mean"),
    )


def split_means(df: DataFrame, by: str, threshold: float, x: str, more_than: int = 2) -> DataFrame:
    """Means of ``x`` on both sides of a threshold, each from more than so many rows."""
    low, high = F.col(by) <= threshold, F.col(by) > threshold
    side = lambda c: F.when(F.count_if(c & F.col(x).isNotNull()) > more_than, F.avg(F.when(c, F.col(x))))
    return df.agg(side(low).alias("mean_low"), side(high).alias("mean_high"))


def region_profile(df: DataFrame, region: str, attributes: list[str], contributing: str) -> DataFrame:
    """Medians of attributes, members and contributing members of each region."""
    return df.groupBy(region).agg(F.count(F.lit(1)).alias("members"), F.count_if(contributing).alias("contributing"), *(F.median(a).alias(f"median_{a}") for a in attributes))


def value_counts(df: DataFrame, c: str) -> DataFrame:
    return df.groupBy(F.col(c).alias("value")).agg(F.count(F.lit(1)).alias("n"))


def ranked(df: DataFrame, by: list[Column], k: int, *partition: str) -> DataFrame:
    """The first ``k`` rows (of each partition) with their rank."""
    w = Window.partitionBy(*partition).orderBy(*by)
    if not partition:  # Spark's own top-k; the rank is over k rows only
        return df.orderBy(*by).limit(k).withColumn("rank", F.row_number().over(Window.orderBy(*by)).cast("long"))
    return df.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)
