"""Filters, classes and status of stations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def successful(status: Column) -> Column:
    return F.upper(F.trim(status)) == "SUCCESS"


def marked(name: Column, words: list[str]) -> Column:
    """The name holds one of the words, in any case; a null name doesn't."""
    return F.coalesce(F.lower(name).rlike("|".join(words)), F.lit(False))


def first_reason(checks: list[tuple[Column, Column | str]], kept: str = "kept") -> Column:
    """The reason of the first check that holds."""
    out = F.lit(kept)
    for check, reason in reversed(checks):
        out = F.when(check, reason if isinstance(reason, Column) else F.lit(reason)).otherwise(out)
    return out


def missing_list(columns: list[str]) -> Column:
    """Names of the columns that are null, separated by commas."""
    return F.array_join(F.filter(F.array(*(F.when(F.col(c).isNull(), F.lit(c)) for c in columns)), lambda x: x.isNotNull()), ", ")


def distinct_names(df: DataFrame, name: str, row: str) -> DataFrame:
    """Adds ``unique_name``: all copies of a repeated name get their row's number."""
    n = F.count(F.lit(1)).over(Window.partitionBy(name))
    return df.withColumn("unique_name", F.when(n > 1, F.concat(F.col(name), F.lit("__row"), F.col(row).cast("string"))).otherwise(F.col(name)))


def repeated(df: DataFrame, keys: list[str], listed: str) -> DataFrame:
    """Every key that repeats, with what shares it."""
    items = F.array_join(F.array_sort(F.collect_list(F.col(listed).cast("string"))), ";")
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies"), items.alias("members")).where("copies > 1")


def floored_log(x: Column, floor: float = 1e-6) -> Column:
    return F.ln(F.greatest(x, F.lit(floor)))


def logged_if_positive(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns that are positive throughout turn into ``log10_`` ones."""
    low = df.agg(*(F.min(c).alias(c) for c in columns)).first()
    keep = [c for c in df.columns if c not in columns]
    return df.select(*keep, *(F.log10(c).alias(f"log10_{c}") if low[c] is not None and low[c] > 0 else F.col(c) for c in columns))


def without_constants(df: DataFrame, columns: list[str]) -> DataFrame:
    kinds = df.agg(*(F.count_distinct(c).alias(c) for c in columns)).first()
    return df.drop(*(c for c in columns if kinds[c] <= 1))


def homogeneity_class(h: Column) -> Column:
    return F.when(h < 1, "acceptably homogeneous").when(h < 2, "possibly heterogeneous").otherwise("definitely heterogeneous")


def slope_class(degrees: Column) -> Column:
    return F.when(degrees < 2, "<2").when(degrees < 5, "2-5").when(degrees < 15, "5-15").when(degrees < 30, "15-30").otherwise(">=30")


def acceptance(years: Column, least: int = 500) -> Column:
    return F.when(years >= least, f">= {least} station-years").otherwise("candidates exhausted")


def percent_error(estimate: Column, observed: Column) -> Column:
    """Null where the observed value is null, zero or not finite."""
    fine = observed.isNotNull() & (observed != 0) & ~F.isnan(observed) & (F.abs(observed) < float("inf")) & ~F.isnan(estimate)
    return F.when(fine, 100 * (estimate - observed) / observed)


def clipped(x: Column, low: float, high: float) -> Column:
    return F.when(x.isNotNull(), F.greatest(F.least(x, F.lit(high)), F.lit(low)))


def outer_statuses(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def not_done(todo: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """What a resumed run still has to do: keys without a success so far."""
    return todo.join(done.where(successful(F.col("status"))).select(key), key, "left_anti")


def capped(df: DataFrame, x: str, most: float | None) -> DataFrame:
    """Rows with ``x`` up to ``most``, where there is a cap; a null is left out by one."""
    return df if most is None else df.where(F.col(x) <= most)


def status_with_quality(status: DataFrame, quality: DataFrame, on: str) -> DataFrame:
    """Every row of ``status`` with the quality of its series, where there is any."""
    return quality.join(status, on, "right")


def first_kept(table: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """One row for each key: the first in ``order``."""
    w = Window.partitionBy(key).orderBy(*order)
    return table.withColumn("_place", F.row_number().over(w)).where("_place = 1").drop("_place")


def looked_up(df: DataFrame, table: DataFrame, key: str, value: str, order: list[Column]) -> DataFrame:
    """``df`` with a value looked up by key, null where there is none."""
    return df.join(first_kept(table, key, order).select(key, value), key, "left")


def group_summary(df: DataFrame, group: str, firsts: list[str], order: list[Column], sums: list[str]) -> DataFrame:
    """Per group: the values of its first row in ``order``, rows, and sums."""
    first = F.min(F.struct(*(c.alias(f"_o{k}") for k, c in enumerate(order)), *firsts)).alias("_first")
    out = df.groupBy(group).agg(first, F.count(F.lit(1)).alias("rows"), *(F.sum(c).alias(f"sum_{c}") for c in sums))
    return out.select(group, *(F.col(f"_first.{c}").alias(c) for c in firsts), "rows", *(f"sum_{c}" for c in sums))


def in_pairs(pairs: DataFrame, *sides: str) -> DataFrame:
    """Each name that stands on either side of a pair, once."""
    return pairs.select(F.explode(F.array(*sides)).alias("station")).distinct()


def sampled(df: DataFrame, key: str, rows: int, seed: int = 42) -> DataFrame:
    """The same ``rows`` rows whenever it is asked for: those whose keys' hashes are least."""
    return df.orderBy(F.xxhash64(F.lit(seed), F.col(key)), key).limit(rows)
