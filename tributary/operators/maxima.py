"""Block maxima of a value per station, with quality checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def numeric(c: str) -> Column:
    """A double, or null for text that is none and for NaN."""
    x = F.col(c).try_cast("double")
    return F.when(~F.isnan(x), x)


def block_maxima(obs: DataFrame, station: str, block: Column | str, value: str, n_obs: str | None = None, least_obs: int = 0) -> DataFrame:
    """(station, block, ams): the largest positive value of each block; rows that count fewer
    than ``least_obs`` observations are left out where that is over 0."""
    rows = obs.select(F.col(station).alias("station"), (F.col(block) if isinstance(block, str) else block).alias("block"), numeric(value).alias("v"), *([F.col(n_obs).alias("n_obs")] if n_obs else []))
    rows = rows.where("v > 0 and block is not null")
    if n_obs and least_obs > 0:
        rows = rows.where(F.col("n_obs") >= least_obs)
    return rows.groupBy("station", "block").agg(F.max("v").alias("ams"))


def quality(ams: DataFrame, jump: float = 10.0) -> DataFrame:
    """A row per station: blocks, median, maximum, their ratio, blocks over ``jump`` times
    the median and under its ``jump``-th part as ``block:value`` lists, and a flag.  One
    aggregation gives the figures and the series, which the lists are filtered from."""
    stats = ams.groupBy("station").agg(
        F.count_distinct("block").alias("years_used"), F.median("ams").alias("median_annual_max"), F.max("ams").alias("max_annual_max"), F.sort_array(F.collect_list(F.struct(F.col("block").cast("string").alias("block"), "ams"))).alias("series")
    )
    median = F.col("median_annual_max")
    item = lambda x: F.concat_ws(":", x["block"], F.round(x["ams"], 2).cast("string"))
    listed = lambda keep: F.array_join(F.transform(F.filter("series", keep), item), ";")
    lists = {"years_gt_10x_median": listed(lambda x: x["ams"] > jump * median), "years_lt_median_over_10": listed(lambda x: x["ams"] < median / jump)}
    flag = F.when((F.col("years_gt_10x_median") != "") | (F.col("years_lt_median_over_10") != ""), "check").otherwise("")
    return stats.withColumns(lists).drop("series").withColumn("max_over_median", F.col("max_annual_max") / median).withColumn("flag", flag)


def annual_maxima(series: DataFrame, station: str, time: str, value: str, format: str = "yyyy-MM-dd'T'HH:mm:ss", after: int = 1900) -> DataFrame:
    """(station, block, ams) of a series at any step: the text of a time is parsed, a bad one
    dropped; years up to ``after`` are left out.  Values need not be positive."""
    when = F.try_to_timestamp(F.col(time), F.lit(format)) if dict(series.dtypes)[time] == "string" else F.col(time)
    rows = series.select(F.col(station).alias("station"), F.year(when).alias("block"), numeric(value).alias("v"))
    return rows.where((F.col("block") > after) & F.col("v").isNotNull()).groupBy("station", "block").agg(F.max("v").alias("ams"))


def partial_blocks(obs: DataFrame, station: str, n_obs: str, full: int = 292) -> DataFrame:
    """Blocks with fewer than ``full`` observations, per station."""
    return obs.groupBy(F.col(station).alias("station")).agg(F.count_if(F.col(n_obs) < full).alias("partial_blocks"), F.count(F.lit(1)).alias("blocks"))


def extremes(obs: DataFrame, key: str, largest: str, smallest: str) -> DataFrame:
    """The key's maximum of one column and minimum of another."""
    return obs.groupBy(F.col(key).alias("station")).agg(F.max(numeric(largest)).alias("largest"), F.min(numeric(smallest)).alias("smallest"))


def long_enough(ams: DataFrame, more_than: int = 15) -> DataFrame:
    """Maxima of stations with more than so many blocks."""
    enough = ams.groupBy("station").agg(F.count_distinct("block").alias("n")).where(F.col("n") > more_than)
    return ams.join(enough.select("station"), "station", "left_semi")


def identical_series(ams: DataFrame) -> DataFrame:
    """Stations whose whole series, to six digits, an earlier station has too."""
    item = F.struct("block", F.round("ams", 6).alias("ams"))
    sign = ams.groupBy("station").agg(F.array_sort(F.collect_list(item)).alias("series"))
    first = sign.groupBy("series").agg(F.min("station").alias("kept"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return sign.join(first, "series").where("station <> kept").select("station", "kept")
