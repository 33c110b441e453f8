"""Station files as tables, with what was rejected and why.

Files of one folder may differ in delimiter, in columns and in their order: they are grouped
by their first line, each group is read by its own names, and the groups are united by what
the columns mean.  A file that lacks a column is rejected by itself.
"""

from __future__ import annotations

import csv
import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tributary.operators import names
from tributary.operators.maxima import numeric

DELIMITERS = ",;\t|"


@dataclass
class Group:
    """Files with the same first line, as text columns with trimmed names, with ``_path`` and where
    the split begins that a row is in."""

    columns: list[str]
    delimiter: str
    rows: DataFrame


def _path(uri: str = "_metadata.file_path") -> Column:
    """A path as it is written, in one form for local files."""
    return F.regexp_replace(F.url_decode(F.replace(F.col(uri), F.lit("+"), F.lit("%2B"))), "^file:/+", "file:/")


def list_files(spark: SparkSession, path: str, pattern: str = "*.csv") -> DataFrame:
    """(path, size) of the files of a folder and those below.  Readers skip empty files, so
    these come from the listing, which the driver has for every read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
    named = spark.createDataFrame([(f,) for f in files.inputFiles()], "uri string").select(_path("uri").alias("path"))
    sizes = files.select(_path().alias("path"), F.col("length").alias("size"))
    return named.join(sizes, "path", "left").select("path", F.coalesce("size", F.lit(0)).alias("size"))


def sniffed(line: str) -> tuple[str, list[str]]:
    """The delimiter that splits a first line most, and its trimmed columns; a repeated name
    gets a number."""
    delimiter = max(DELIMITERS, key=line.count)
    columns: list[str] = []
    for c in next(csv.reader([line], delimiter=delimiter), []):
        c = c.strip().lstrip("﻿") or "column"
        columns.append(c if c not in columns else f"{c}_{len(columns)}")
    return delimiter, columns


def read_groups(spark: SparkSession, path: str, pattern: str = "*.csv") -> tuple[list[Group], DataFrame]:
    """(groups, rejects): a group for each first line, and files without a line.  The driver
    sees one line a kind of file and the names of files, as for any read."""
    text = spark.read.option("pathGlobFilter", pattern).option("recursiveFileLookup", True).text(path)
    place = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    first = text.select(_path().alias("path"), "value", place.alias("place")).groupBy("path").agg(F.min_by("value", "place").alias("line"))
    kinds = first.groupBy("line").agg(F.sort_array(F.collect_list("path")).alias("paths")).collect()
    groups = []
    for line, paths in sorted((r["line"], r["paths"]) for r in kinds):
        delimiter, columns = sniffed(line)
        schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
        rows = spark.read.option("header", True).option("sep", delimiter).option("ignoreLeadingWhiteSpace", True).schema(schema).csv([re.sub(r"([\\\[\]{}*?])", r"\\\1", p) for p in paths])
        groups.append(Group(columns, delimiter, rows.select("*", _path().alias("_path"), F.col("_metadata.file_block_start").alias("_split"))))
    empty = list_files(spark, path, pattern).join(first.select("path"), "path", "left_anti")
    return groups, empty.select("path", F.lit("no line").alias("reason"))


def _files(group: Group, reason: str) -> DataFrame:
    return group.rows.select(F.col("_path").alias("path")).distinct().withColumn("reason", F.lit(reason))


def _named(group: Group, suffixes: tuple[str, ...]) -> DataFrame:
    """(path, station) of each file."""
    return names.station_of_file(group.rows, "_path", names.find_column(group.rows, ["station", "station_name"]), list(suffixes))


def _united(parts: list[DataFrame], spark: SparkSession, schema: str) -> DataFrame:
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], schema)


def streamflow(spark: SparkSession, path: str, suffixes: tuple[str, ...] = ("_streamflow",)) -> tuple[DataFrame, DataFrame]:
    """(observations, rejects): (station, file, year, n_obs, value) with value > 0, and a row
    (path, reason) for each file that gives none."""
    groups, rejects = read_groups(spark, path)
    good = []
    for g in groups:
        year, flow, n_obs = names.find_column(g.rows, ["year"]), names.find_maximum_column(g.rows), names.find_column(g.rows, ["n_obs", "nobs"])
        if not year or not flow:
            rejects = rejects.unionByName(_files(g, "no column of years" if not year else "no column of maxima"))
            continue
        who = _named(g, suffixes)
        n = numeric(n_obs) if n_obs else F.lit(None).cast("double")
        rows = g.rows.select(F.col("_path").alias("path"), numeric(year).cast("int").alias("year"), n.alias("n_obs"), numeric(flow).alias("value")).where("value > 0 and year is not null")
        good.append(rows.join(who, "path").select("station", names.stem(F.col("path")).alias("file"), "year", "n_obs", "value"))
        rejects = rejects.unionByName(who.join(rows.select("path").distinct(), "path", "left_anti").select("path", F.lit("no positive maxima").alias("reason")))
    return _united(good, spark, "station string, file string, year int, n_obs double, value double"), rejects


def climate(spark: SparkSession, path: str, largest: list[str], smallest: list[str], suffixes: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """(extremes, rejects): (key, largest, smallest) of all files of a station, and files that
    have neither column."""
    groups, rejects = read_groups(spark, path)
    parts = []
    for g in groups:
        high, low = names.find_column(g.rows, largest), names.find_column(g.rows, smallest)
        if not high and not low:
            rejects = rejects.unionByName(_files(g, "no column of values"))
            continue
        value = lambda c: numeric(c) if c else F.lit(None).cast("double")
        rows = g.rows.select(F.col("_path").alias("path"), value(high).alias("high"), value(low).alias("low"))
        parts.append(rows.groupBy("path").agg(F.max("high").alias("high"), F.min("low").alias("low")).join(_named(g, suffixes), "path").select("station", "high", "low"))
    rows = _united(parts, spark, "station string, high double, low double")
    return rows.groupBy(names.normalised(F.col("station")).alias("key")).agg(F.max("high").alias("largest"), F.min("low").alias("smallest")), rejects


def _numbered(rows: DataFrame) -> DataFrame:
    """Rows with ``excel_row``: their place in their split, after the rows of the splits before
    it, so that no task sorts a whole file."""
    split = ["_path", "_split"]
    sizes = rows.groupBy(*split).agg(F.count(F.lit(1)).alias("_rows"))
    earlier = sizes.select(*(F.col(c).alias(c) for c in split), (F.sum("_rows").over(Window.partitionBy("_path").orderBy("_split")) - F.col("_rows")).alias("_earlier"))
    inside = F.row_number().over(Window.partitionBy(*split).orderBy("_order"))
    placed = rows.withColumn("_order", F.monotonically_increasing_id()).withColumn("_inside", inside)
    return placed.join(earlier, split).withColumn("excel_row", (F.col("_earlier") + F.col("_inside") + 1).cast("int")).drop("_order", "_inside", "_earlier")


def morphometry(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(rows, rejects): successful rows of all files with a normalised key and ``excel_row``,
    their line in a spreadsheet, counted before filtering."""
    groups, rejects = read_groups(spark, path)
    parts = []
    for g in groups:
        status, station = names.find_column(g.rows, ["status"]), names.find_column(g.rows, ["station", "station_name"])
        if not status or not station:
            rejects = rejects.unionByName(_files(g, "no status" if not status else "no station"))
            continue
        numbered = _numbered(g.rows)
        fine = numbered.where(F.upper(F.trim(F.col(status))) == "SUCCESS").withColumn("key", names.normalised(F.col(station)))
        parts.append(fine.drop("_path", "_split"))
    if not parts:
        return spark.createDataFrame([], "station string, status string, excel_row int, key string"), rejects
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts), rejects


def with_climate(stations: DataFrame, *climates: tuple[DataFrame, str]) -> DataFrame:
    """Left joins on the key; columns that are already there are replaced."""
    for table, prefix in climates:
        fresh = table.select("key", F.col("largest").alias(f"{prefix}_max"), F.col("smallest").alias(f"{prefix}_min"))
        stations = stations.drop(f"{prefix}_max", f"{prefix}_min").join(fresh, "key", "left")
    return stations


def write_table(df: DataFrame, path: str, form: str = "parquet", mode: str = "errorifexists") -> None:
    """Arrays become ``;`` lists where the form is text."""
    if form == "csv":
        df = df.select(*(F.array_join(F.col(c).cast("array<string>"), ";").alias(c) if t.startswith("array") else F.col(c) for c, t in df.dtypes))
        df.write.mode(mode).option("header", True).csv(path)
    else:
        df.write.mode(mode).format(form).save(path)


def report_lines(title: str, table: DataFrame, order: list[Column]) -> DataFrame:
    """(line): a title, then a line of ``column value`` pairs for each row of a small table."""
    pairs = F.concat_ws("  ", *(F.concat(F.lit(f"{c} "), F.coalesce(F.col(c).cast("string"), F.lit("n/a"))) for c in table.columns))
    body = table.select(F.row_number().over(Window.orderBy(*order)).alias("k"), pairs.alias("line"))
    head = table.sparkSession.createDataFrame([(-1, title), (0, "-" * len(title))], "k int, line string")
    return head.unionByName(body).orderBy("k").select("line")


def write_report(lines: DataFrame, path: str) -> None:
    """One text file, in order of the lines; a report is small."""
    lines.coalesce(1).write.mode("overwrite").text(path)


def failure_log(*parts: tuple[DataFrame, str]) -> DataFrame:
    """(name, status, reason) of tables with these columns or fewer, each with its status
    (SUCCESS, FAILED or CRASHED) unless it has one."""
    def one(df: DataFrame, status: str) -> DataFrame:
        have = set(df.columns)
        return df.select("name", (F.col("status") if "status" in have else F.lit(status)).alias("status"), (F.col("reason") if "reason" in have else F.lit(None).cast("string")).alias("reason"))

    return reduce(DataFrame.unionByName, [one(df, status) for df, status in parts])
