"""The driver's tables seen as stations, observations and attributes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.functions.lineage import stored
from tributary.operators import lmoments, maxima

ATTRIBUTES = ["quantity", "discount", "price", "tax", "balance"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def month(c: str) -> Column:
    return F.date_format(c, "yyyy-MM")


def monthly_maxima(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxima.block_maxima(table(spark, sf_dir, "lineitem"), "l_suppkey", month("l_shipdate"), "l_extendedprice")


def moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lmoments.sample_lmoments(monthly_maxima(spark, sf_dir))


def nation_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stations' moments with their nation as region."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("station"), F.col("s_nationkey").alias("region"))
    return moments(spark, sf_dir).join(s, "station")


def day_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' daily maxima, a table of positive skew, in ten regions."""
    ams = maxima.block_maxima(table(spark, sf_dir, "events"), "user_id", F.date_format("ts", "yyyy-MM-dd"), "value")
    return lmoments.sample_lmoments(ams).withColumn("region", (F.col("station") % 10).cast("int"))


def attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("station")).agg(
        F.avg("l_quantity").alias("quantity"), F.avg("l_discount").alias("discount"), F.avg("l_extendedprice").alias("price"), F.avg("l_tax").alias("tax")
    )
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("station"), F.col("s_acctbal").alias("balance"), F.col("s_nationkey").alias("region"))
    return a.join(s, "station")


def stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(station, attributes, region, n, l1, l2, t, t3, t4), stored: suppliers with means of
    their lines and moments of their monthly maxima, from one pass over the lines."""
    means = {"quantity": "l_quantity", "discount": "l_discount", "price": "l_extendedprice", "tax": "l_tax"}
    sums = [F.sum(F.col(c).cast("double")).alias(f"s_{a}") for a, c in means.items()]
    monthly = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("station"), F.trunc("l_shipdate", "month").alias("block"))
    monthly = monthly.agg(F.max(F.when(F.col("l_extendedprice") > 0, maxima.numeric("l_extendedprice"))).alias("ams"), *sums, *(F.count(c).alias(f"n_{a}") for a, c in means.items()))
    monthly = stored(monthly, "monthly")
    a = monthly.groupBy("station").agg(*((F.sum(f"s_{a}") / F.sum(f"n_{a}")).alias(a) for a in means))
    m = lmoments.sample_lmoments(monthly.where("block is not null and ams is not null"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("station"), F.col("s_acctbal").cast("double").alias("balance"), F.col("s_nationkey").alias("region"))
    return stored(a.join(s, "station").join(m, "station", "left"), "stations")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*(F.round(F.col(c), digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


# The same tables in SQL, for the reference queries.
AMS = """ams AS (SELECT l_suppkey AS station, strftime(l_shipdate, '%Y-%m') AS block, max(l_extendedprice) AS ams
  FROM lineitem WHERE l_extendedprice > 0 GROUP BY ALL)"""


def moments_sql(source: str = "ams", name: str = "lm") -> str:
    return f"""{name}_r AS (SELECT station, ams AS x, row_number() OVER (PARTITION BY station ORDER BY ams)::DOUBLE AS j, count(*) OVER (PARTITION BY station)::DOUBLE AS n FROM {source}),
{name}_b AS (SELECT station, count(*) AS n, avg(x) AS b0, avg((j-1)/(n-1)*x) AS b1, avg((j-1)/(n-1)*(j-2)/(n-2)*x) AS b2,
  avg((j-1)/(n-1)*(j-2)/(n-2)*(j-3)/(n-3)*x) AS b3 FROM {name}_r WHERE n >= 4 GROUP BY station),
{name} AS (SELECT station, n, b0 AS l1, 2*b1-b0 AS l2, (2*b1-b0)/b0 AS t, (6*b2-6*b1+b0)/(2*b1-b0) AS t3, (20*b3-30*b2+12*b1-b0)/(2*b1-b0) AS t4 FROM {name}_b)"""


MEMBERS = AMS + ",\n" + moments_sql() + ",\nm AS (SELECT lm.*, s_nationkey AS region FROM lm JOIN supplier ON s_suppkey = station)"
REGIONS = "reg AS (SELECT region, count(*) AS sites, sum(n)::BIGINT AS pooled, sum(n*t)/sum(n) AS t_r, sum(n*t3)/sum(n) AS t3_r, sum(n*t4)/sum(n) AS t4_r FROM m GROUP BY region)"
DAYS = """ams AS (SELECT user_id AS station, strftime(ts, '%Y-%m-%d') AS block, max(value) AS ams FROM events WHERE value > 0 GROUP BY ALL),
""" + moments_sql() + ",\nm AS (SELECT *, (station % 10)::INT AS region FROM lm)"
ATTRS = """a AS (SELECT l_suppkey AS station, avg(l_quantity) AS quantity, avg(l_discount) AS discount, avg(l_extendedprice) AS price, avg(l_tax) AS tax
  FROM lineitem GROUP BY 1),
att AS (SELECT a.*, s_acctbal AS balance, s_nationkey AS region FROM a JOIN supplier ON s_suppkey = station)"""
