"""Station names, file names and dirty column names."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def normalised(c: Column) -> Column:
    """Lower case, letters and digits only."""
    return F.regexp_replace(F.lower(c), "[^a-z0-9]", "")


def stem(path: Column) -> Column:
    """A path's file name without its extension."""
    return F.regexp_replace(F.regexp_extract(path, r"([^/\\]*)$", 1), r"\.[^.]*$", "")


def station_key(c: Column) -> Column:
    """Key of a discharge file's name."""
    return F.regexp_replace(F.regexp_replace(normalised(F.regexp_replace(c, r"\.[^.]*$", "")), "^riverwaterdischarge", ""), "streamflow$", "")


def safe_filename(c: Column) -> Column:
    return F.regexp_replace(F.trim(F.regexp_replace(c, r"[^\p{L}\p{N}_\- ]", "_")), " ", "_")


def without_suffixes(c: Column, suffixes: list[str]) -> Column:
    """Suffixes are taken off one after the other, so several can go."""
    return reduce(lambda x, s: F.regexp_replace(x, rf"\Q{s}\E$", ""), suffixes, c)


def station_of_file(rows: DataFrame, path: str, station: str | None, suffixes: list[str]) -> DataFrame:
    """(path, station): the first name in a file, else its stem without suffixes."""
    fallback = F.trim(without_suffixes(stem(F.col(path)), suffixes))
    if station is None:
        return rows.select(F.col(path).alias("path")).distinct().select("path", without_suffixes(stem(F.col("path")), suffixes).alias("station"))
    first = F.first(F.col(station), ignorenulls=True)
    return rows.groupBy(F.col(path).alias("path")).agg(first.alias("named"), F.first(fallback).alias("fallback")).select("path", F.coalesce("named", "fallback").alias("station"))


def find_column(df: DataFrame, candidates: list[str]) -> str | None:
    """The column that the first fitting candidate names, whatever its case and signs."""
    plain = lambda s: re.sub("[^a-z0-9]", "", s.lower())
    have = {plain(c): c for c in reversed(df.columns)}
    return next((have[plain(c)] for c in candidates if plain(c) in have), None)


def find_maximum_column(df: DataFrame) -> str | None:
    """A column of maxima of a flow: says so, and is no date or day."""
    for c in df.columns:
        low = c.lower()
        if "max" in low and re.search("discharge|flow|cumec|q", low) and not re.search("date|doy|day", low):
            return c
    return None


def require(df: DataFrame, columns: list[str]) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"columns {', '.join(missing)} are missing; there are {', '.join(df.columns)}")
    return df


def fuzzy_match(names: DataFrame, files: DataFrame, name: str, file: str, stated: str | None = None) -> DataFrame:
    """(name, file, matched_by): a file whose stem is the stated one, else the name, else
    holds the name as a whole word; of several the shortest, then the first.

    The first two ways are equi-joins.  For the third, stems are cut into runs of words, so
    that it is an equi-join too.
    """
    n = names.select(F.col(name).alias("name"), F.lower(F.trim(name)).alias("key"), (F.lower(F.trim(stated)) if stated else F.lit(None).cast("string")).alias("stated")).distinct()
    f = files.select(F.col(file).alias("file"), F.lower(F.trim(file)).alias("low")).distinct()
    exact = lambda on, tier: n.join(f, F.col(on) == F.col("low")).select("name", "file", F.lit(tier).alias("tier"))
    # Every run of characters that no letter or digit touches.
    spans = f.select("file", F.explode(_runs(F.col("low"))).alias("key")).distinct()
    words = n.join(spans, "key").select("name", "file", F.lit(3).alias("tier"))
    found = exact("stated", 1).union(exact("key", 2)).union(words)
    best = found.groupBy("name").agg(F.min(F.struct("tier", F.length("file").alias("size"), "file")).alias("x"))
    how = F.element_at(F.array(F.lit("stated file"), F.lit("name"), F.lit("whole word")), F.col("x.tier"))
    return best.select("name", F.col("x.file").alias("file"), how.alias("matched_by"))


def _runs(low: Column) -> Column:
    cut = F.split(low, r"(?<=[^a-z0-9])|(?=[^a-z0-9])")
    n = F.size(cut)
    outside = lambda k: (k < 1) | (k > n) | F.coalesce(F.try_element_at(cut, F.greatest(k, F.lit(1)).cast("int")), F.lit("")).rlike("^[^a-z0-9]*$")
    ends = lambda i: F.filter(F.sequence(i, n), lambda j: outside(j + 1))
    begins = F.filter(F.sequence(F.lit(1), n), lambda i: outside(i - 1))
    return F.flatten(F.transform(begins, lambda i: F.transform(ends(i), lambda j: F.array_join(F.slice(cut, i, j - i + 1), ""))))
