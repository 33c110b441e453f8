"""Queries on sources and sinks: files are written to the shared folder and read again."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from tributary.functions.lineage import fresh_path
from tributary.plans.catalogue import query
from tributary.plans.standins import rounded, table
from tributary.sources import tables, workbooks
from tributary.sources.folders import write_files

_FLOW = """f AS (SELECT n_nationkey, n_name, strftime(l_shipdate, '%Y')::INT AS year, count(*) AS n_obs, max(l_extendedprice) AS value
FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey GROUP BY ALL)"""


def _flow(spark, sf_dir):
    """Largest price of each nation and year."""
    n = table(spark, sf_dir, "supplier").join(F.broadcast(table(spark, sf_dir, "nation")), F.col("s_nationkey") == F.col("n_nationkey"))
    rows = table(spark, sf_dir, "lineitem").join(n, F.col("l_suppkey") == F.col("s_suppkey"))
    return rows.groupBy("n_nationkey", "n_name", F.year("l_shipdate").alias("year")).agg(F.count(F.lit(1)).alias("n_obs"), F.max("l_extendedprice").alias("value"))


def _flow_files(spark, sf_dir) -> str:
    """A file a nation, of three kinds: commas; semicolons, other names in another order; and
    without a column of maxima.  Every fifth year has a value that is none."""
    path, flow = fresh_path(spark, "flow"), _flow(spark, sf_dir)
    value = F.when(F.col("year") % 5 == 0, "bad").otherwise(F.col("value").cast("string"))
    flow = flow.withColumn("part", F.col("n_nationkey")).repartition("n_nationkey")
    kind = F.col("n_nationkey") % 3
    one = flow.where(kind == 0).select("part", F.col("n_name").alias("station"), "year", "n_obs", value.alias("max_discharge_cumec"), F.lit("x").alias("max_discharge_date"))
    two = flow.where(kind == 1).select("part", value.alias("Max Flow"), "n_obs", F.col("year").alias("Year"), F.col("n_name").alias("Station"))
    three = flow.where(kind == 2).select("part", "year", F.col("n_name").alias("station"))
    for rows, sep, name in ((one, ",", "a"), (two, ";", "b"), (three, ",", "c")):
        rows.write.option("header", True).option("sep", sep).partitionBy("part").csv(f"{path}/{name}")
    return path


@query(f"WITH {_FLOW} SELECT n_name AS station, year, n_obs::DOUBLE AS n_obs, round(value, 4) AS value FROM f WHERE n_nationkey % 3 < 2 AND year % 5 <> 0 AND value > 0")
def source_streamflow(spark, sf_dir):
    """Files that differ in delimiter, names and order of columns, read as one table."""
    good, _ = tables.streamflow(spark, _flow_files(spark, sf_dir))
    return rounded(good.select("station", "year", "n_obs", "value"), 4)


@query(f"WITH {_FLOW} SELECT 'no column of maxima' AS reason, count(DISTINCT n_nationkey) AS files FROM f WHERE n_nationkey % 3 = 2 HAVING count(*) > 0")
def source_rejects(spark, sf_dir):
    """Each file that can't be used, with the reason, by reason."""
    _, rejects = tables.streamflow(spark, _flow_files(spark, sf_dir))
    return rejects.groupBy("reason").agg(F.count(F.lit(1)).alias("files")).where("reason <> 'no positive maxima'")


@query(f"WITH {_FLOW} SELECT regexp_replace(lower(n_name), '[^a-z0-9]', '', 'g') AS key, round(max(value), 4) AS largest, round(min(value), 4) AS smallest FROM f GROUP BY 1")
def source_climate(spark, sf_dir):
    """Extremes of all files of a station; its name comes from the file's folder or column."""
    path = fresh_path(spark, "climate")
    rows = _flow(spark, sf_dir).withColumn("part", F.col("n_nationkey")).repartition("n_nationkey")
    rows.select("part", F.col("n_name").alias("Station Name"), F.col("value").alias("Rain Max"), F.col("value").alias("rain_min")).write.option("header", True).option("sep", "\t").partitionBy("part").csv(path)
    found, _ = tables.climate(spark, path, ["rain_max", "max"], ["rain_min", "min"], ())
    return rounded(found, 4)


@query("""WITH s AS (SELECT *, row_number() OVER (ORDER BY s_suppkey) + 1 AS excel_row FROM supplier), c AS (SELECT s_nationkey, max(s_acctbal) AS rain_max, min(s_acctbal) AS rain_min FROM supplier GROUP BY 1)
SELECT s_name AS station, excel_row::INT AS excel_row, regexp_replace(lower(s_name), '[^a-z0-9]', '', 'g') AS key, rain_max, rain_min
FROM s LEFT JOIN c ON c.s_nationkey = s.s_suppkey WHERE s_suppkey % 4 <> 1""")
def source_morphometry(spark, sf_dir):
    """Successful rows of a file with their lines, joined to climate columns that replace
    those of the file."""
    path = fresh_path(spark, "morphometry")
    s = table(spark, sf_dir, "supplier")
    status = F.when(F.col("s_suppkey") % 4 == 1, "FAILED").otherwise(" success ")
    s.orderBy("s_suppkey").coalesce(1).select(status.alias("Status"), F.col("s_name").alias("station"), F.lit(0.0).alias("rain_max")).write.option("header", True).option("sep", "|").csv(path)
    rows, _ = tables.morphometry(spark, path)
    climate = s.groupBy("s_nationkey").agg(F.max("s_acctbal").alias("largest"), F.min("s_acctbal").alias("smallest")).join(s.select(F.col("s_suppkey").cast("int").alias("s_nationkey"), F.regexp_replace(F.lower("s_name"), "[^a-z0-9]", "").alias("key")), "s_nationkey")
    return tables.with_climate(rows, (climate, "rain")).select("station", "excel_row", "key", "rain_max", "rain_min")


@query("SELECT n_regionkey::VARCHAR AS region, string_agg(n_name, ';' ORDER BY n_name) AS members FROM nation GROUP BY 1")
def csv_sink(spark, sf_dir):
    """A table with a list, written as text and read again."""
    path = fresh_path(spark, "sink")
    lists = table(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").alias("region")).agg(F.sort_array(F.collect_list("n_name")).alias("members"))
    tables.write_table(lists, path, "csv")
    return spark.read.option("header", True).csv(path)


@query("""SELECT o_orderkey::VARCHAR AS name, CASE o_orderstatus WHEN 'F' THEN 'SUCCESS' WHEN 'O' THEN 'FAILED' ELSE 'CRASHED' END AS status, CASE WHEN o_orderstatus = 'O' THEN o_orderpriority END AS reason FROM orders""")
def failure_log(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("name"), "o_orderstatus", "o_orderpriority")
    done, failed = o.where("o_orderstatus = 'F'"), o.where("o_orderstatus = 'O'").withColumn("reason", F.col("o_orderpriority"))
    crashed = o.where("o_orderstatus not in ('F', 'O')")
    return tables.failure_log((done.select("name"), "SUCCESS"), (failed.select("name", "reason"), "FAILED"), (crashed.select("name"), "CRASHED"))


@query("SELECT 'Orders by status' AS line UNION ALL SELECT '----------------' UNION ALL SELECT 'status ' || o_orderstatus || '  n ' || count(*) FROM orders GROUP BY o_orderstatus")
def text_report(spark, sf_dir):
    """A report as lines of text, written and read again."""
    path = fresh_path(spark, "report")
    counts = table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count(F.lit(1)).alias("n"))
    tables.write_report(tables.report_lines("Orders by status", counts, [F.col("status")]), path)
    return spark.read.text(path).select(F.col("value").alias("line"))



@query(f"WITH {_FLOW} SELECT n_name AS station, n_nationkey::DOUBLE AS latitude, year, value FROM f")
def source_workbooks(spark, sf_dir):
    """A workbook a nation, written and read again: its name and a figure by their cells, and
    a series from the fourth row on."""

    def book(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("year")
        rows = [["Station", pdf["n_name"].iloc[0]], ["Latitude", int(pdf["n_nationkey"].iloc[0])], [], *([int(y), None, float(v)] for y, v in zip(pdf["year"], pdf["value"]))]
        return pd.DataFrame({"name": [f"nation {pdf['n_nationkey'].iloc[0]}.xlsx"], "content": [workbooks.workbook(rows)]})

    path = fresh_path(spark, "workbooks")
    write_files(_flow(spark, sf_dir).groupBy("n_nationkey").applyInPandas(book, "name string, content binary"), path)
    cells, _ = workbooks.read_workbooks(spark, path)
    head = workbooks.addressed(cells, station=(0, 1), latitude=(1, 1))
    series = workbooks.series(cells, 3, year=0, value=2)
    return head.join(series, "path").select("station", F.col("latitude").cast("double").alias("latitude"), F.col("year").cast("int").alias("year"), F.col("value").cast("double").alias("value"))
