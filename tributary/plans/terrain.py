"""Queries on a grid with real pits: parts, 64 to a row, with their size as height."""

from __future__ import annotations

from pyspark.sql import functions as F

from tributary.functions.lineage import fresh_path
from tributary.operators import delineation, outlines, terrain
from tributary.plans.catalogue import query
from tributary.plans.standins import rounded, table
from tributary.sources import geotiff, shapefile

FIELD = "cells AS (SELECT (p_partkey // 64)::INT AS row, (p_partkey % 64)::INT AS col, p_size::DOUBLE AS z FROM part)"
_WAYS = "ways AS (SELECT * FROM (VALUES (1,0,1),(2,1,1),(4,1,0),(8,1,-1),(16,0,-1),(32,-1,-1),(64,-1,0),(128,-1,1)) v(code, dr, dc))"
# A cell is flooded up to the least height at which it joins the outside.
_FLOOD = f"""{FIELD}, {_WAYS}, heights AS (SELECT DISTINCT z AS h FROM cells),
rim AS (SELECT a.row, a.col, a.z FROM cells a, ways LEFT JOIN cells b ON b.row = a.row + dr AND b.col = a.col + dc GROUP BY ALL HAVING count(b.row) < 8),
reach AS (SELECT row, col, h FROM rim JOIN heights ON z <= h
  UNION SELECT c.row, c.col, reach.h FROM reach, ways JOIN cells c ON c.row = reach.row + dr AND c.col = reach.col + dc AND c.z <= reach.h),
full_ AS (SELECT cells.row, cells.col, any_value(z) AS z, min(h) AS filled FROM cells JOIN reach ON reach.row = cells.row AND reach.col = cells.col GROUP BY ALL)"""


def field(spark, sf_dir):
    key = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(F.expr("int(p_partkey div 64)").alias("row"), (key % 64).cast("int").alias("col"), F.col("p_size").cast("double").alias("z"))


@query(f"WITH RECURSIVE {_FLOOD} SELECT row, col, z, filled FROM full_")
def conditioned_heights(spark, sf_dir):
    return terrain.filled(field(spark, sf_dir))


@query(f"""WITH RECURSIVE {_FLOOD},
beside AS (SELECT a.row, a.col, a.filled, code, b.row AS to_row, b.col AS to_col, b.filled AS low, (a.filled - b.filled) / sqrt(dr*dr + dc*dc) AS fall
  FROM full_ a CROSS JOIN ways LEFT JOIN full_ b ON b.row = a.row + dr AND b.col = a.col + dc),
down AS (SELECT row, col, code FROM beside WHERE low IS NULL OR fall > 0 QUALIFY row_number() OVER (PARTITION BY row, col ORDER BY low IS NULL, fall DESC, code) = 1),
away(row, col, steps) USING KEY (row, col) AS (SELECT row, col, 0 FROM down
  UNION SELECT b.row, b.col, min(a.steps) + 1 FROM away a JOIN beside b ON b.to_row = a.row AND b.to_col = a.col AND b.low = b.filled
  WHERE NOT EXISTS (SELECT 1 FROM recurring.away r WHERE r.row = b.row AND r.col = b.col) GROUP BY b.row, b.col),
on_ AS (SELECT b.row, b.col, code FROM beside b JOIN away a ON a.row = b.to_row AND a.col = b.to_col WHERE low = filled AND NOT EXISTS (SELECT 1 FROM down d WHERE d.row = b.row AND d.col = b.col)
  QUALIFY row_number() OVER (PARTITION BY b.row, b.col ORDER BY a.steps, code) = 1)
SELECT f.row, f.col, f.filled, coalesce(down.code, on_.code)::INT AS fdir, away.steps::DOUBLE AS steps FROM full_ f LEFT JOIN down ON down.row = f.row AND down.col = f.col
LEFT JOIN on_ ON on_.row = f.row AND on_.col = f.col JOIN away ON away.row = f.row AND away.col = f.col""")
def drained_directions(spark, sf_dir):
    return terrain.conditioned(field(spark, sf_dir)).select("row", "col", "filled", "fdir", "steps")


# Rings less holes by Euler's formula: cells less pairs side by side plus full squares of four.
@query(f"""WITH {FIELD}, m AS (SELECT row // 16 AS basin, row, col FROM cells WHERE z > 15),
n AS (SELECT a.basin, a.row, a.col, e.row IS NOT NULL AS e, s.row IS NOT NULL AS s, d.row IS NOT NULL AS d FROM m a
  LEFT JOIN m e ON e.basin = a.basin AND e.row = a.row AND e.col = a.col + 1 LEFT JOIN m s ON s.basin = a.basin AND s.row = a.row + 1 AND s.col = a.col
  LEFT JOIN m d ON d.basin = a.basin AND d.row = a.row + 1 AND d.col = a.col + 1)
SELECT basin::INT AS basin, count(*) AS area, 4*count(*) - 2*(count(*) FILTER (WHERE e) + count(*) FILTER (WHERE s)) AS perimeter,
  count(*) - count(*) FILTER (WHERE e) - count(*) FILTER (WHERE s) + count(*) FILTER (WHERE e AND s AND d) AS rings_less_holes,
  round(avg(row) + 0.5, 6) AS row, round(avg(col) + 0.5, 6) AS col FROM n GROUP BY basin""")
def mask_outlines(spark, sf_dir):
    cells = field(spark, sf_dir).where("z > 15").select(F.expr("int(row div 16)").alias("basin"), "row", "col")
    found = outlines.rings(cells, ["basin"])
    sums = outlines.outline_sums(found, ["basin"]).select("basin", "area", "perimeter", (F.col("outer") - F.col("holes")).alias("rings_less_holes"))
    return rounded(sums.join(outlines.centroids(found, ["basin"]), "basin"))


@query()
def delineated_outlets(spark, sf_dir):
    """Suppliers as outlets over the whole grid, each in its own growing window."""
    at = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("outlet"), F.expr("int(s_suppkey * 5 div 16)").alias("row"), F.expr("int(s_suppkey * 29 % 64)").alias("col"))
    rules = delineation.Rules(degrees=0.01, window=0.06, window_step=0.04, window_most=0.10, radius=0.02, radius_least=0.01, least_area=6.0, streams=(40, 12, 4))
    return delineation.delineated(field(spark, sf_dir), at, rules)[0]


@query(f"WITH {FIELD} SELECT (row // 16)::INT AS basin, count(*) AS cells, round(count(*) * 0.25, 6) AS area FROM cells WHERE z > 15 GROUP BY ALL")
def shapefile_outlines(spark, sf_dir):
    """Outlines written as polygons and read again; their area is that of the cells."""
    cells = field(spark, sf_dir).where("z > 15").select(F.expr("int(row div 16)").alias("basin"), "row", "col")
    rings = outlines.rings(cells, ["basin"])
    path = fresh_path(spark, "shapes")
    shapefile.write_shapes(outlines.as_parts(rings, ["basin"], 70.0, 20.0, 0.5).withColumn("shape", F.lit("polygon")), path)
    read = shapefile.read_shapes(spark, path)
    ring = lambda p: F.aggregate(F.sequence(F.lit(1), F.size(p) - 1), F.lit(0.0), lambda s, i: s + p[i - 1]["y"] * p[i]["x"] - p[i]["y"] * p[i - 1]["x"]) / 2
    area = F.aggregate(F.transform("parts", ring), F.lit(0.0), lambda s, x: s + x)
    return rounded(read.select(F.col("basin").cast("int").alias("basin"), "cells", area.alias("area")))


@query("SELECT c_custkey AS id, c_name AS name, c_acctbal AS balance, (c_custkey % 360) - 180.0::DOUBLE AS x, (c_custkey % 180) / 2.0::DOUBLE AS y FROM customer WHERE (c_custkey % 360) - 180 >= -90 AND c_custkey % 180 < 100")
def shapefile_points(spark, sf_dir):
    """Customers as points with their columns; what lies outside a box is not decoded."""
    c = table(spark, sf_dir, "customer").withColumns({"x": F.col("c_custkey") % 360 - 180.0, "y": (F.col("c_custkey") % 180) / 2.0})
    parts = F.array(F.array(F.struct("x", "y"))).alias("parts")
    path = fresh_path(spark, "points")
    shapefile.write_shapes(c.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"), F.lit("point").alias("shape"), parts), path)
    read = shapefile.read_shapes(spark, path).where("xmin >= -90.0 and ymax < 50.0")
    return read.select("id", "name", "balance", F.col("xmin").alias("x"), F.col("ymin").alias("y"))


@query(f"WITH {FIELD} SELECT row, col, z FROM cells WHERE row BETWEEN 3 AND 20 AND col BETWEEN 10 AND 40")
def raster_window(spark, sf_dir):
    """Heights written as tiles, of which a window is read by the blocks that it touches."""
    path = fresh_path(spark, "raster")
    geotiff.write_raster(field(spark, sf_dir), path, 70.0, 20.0, 0.01, side=32)
    read = geotiff.read_raster(spark, path, (70.10, 19.79, 70.41, 19.97))
    place = lambda c, f: F.round((F.col(c) - f) / 0.01 - 0.5).cast("int")
    return read.select((-F.round((F.col("y") - 20.0) / 0.01 + 0.5)).cast("int").alias("row"), place("x", 70.0).alias("col"), "z")
