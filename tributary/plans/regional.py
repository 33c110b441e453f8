"""Queries on fixed regions, pools, clusters, grids and streams that build on the others."""

from __future__ import annotations

from pyspark.sql import functions as F

from tributary.functions.distributions import RETURN_PERIODS
from tributary.functions.lineage import fresh_path, stored
from tributary.operators import cluster, homogeneity, indexflood, raster, roi, selection, space, validate
from tributary.plans.catalogue import query
from tributary.plans.numeric import GRID, INDEX, NEAR, PAIRS, _grid, _index, _z, pools
from tributary.plans.standins import ATTRIBUTES, ATTRS, DAYS, MEMBERS, attributes, day_members, rounded, stations, table
from tributary.streaming import maxima as streaming


@query()
def fixed_region_tests(spark, sf_dir):
    """Discordant sites, H with and without them, best distribution of every region."""
    return homogeneity.tested_regions(day_members(spark, sf_dir))


@query()
def at_site_fit(spark, sf_dir):
    """Every station as a region of its own: its quantiles are what estimates are held against."""
    m = day_members(spark, sf_dir)
    return homogeneity.region_fits(m.withColumn("region", F.col("station")))


@query()
def trimmed_pool_5t(spark, sf_dir):
    return roi.trimmed_pools(pools(_z(spark, sf_dir), 500), 500)


_POOL = f"""{NEAR}, {MEMBERS}, b AS (SELECT nn.station, neighbour, rank, coalesce(sum(m.n) OVER (PARTITION BY nn.station ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
FROM nn JOIN m ON m.station = neighbour), pool AS (SELECT station, neighbour FROM b WHERE (before < 500 OR rank <= 5) AND rank <= 25)"""
_CURVES = f"""{_POOL}, parts AS (SELECT station, 'at_site' AS kind, t AS t_r, t3 AS t3_r FROM m
UNION ALL SELECT p.station, 'roi', sum(n*t)/sum(n), sum(n*t3)/sum(n) FROM pool p JOIN m ON m.station = p.neighbour GROUP BY 1 HAVING count(*) >= 5
UNION ALL SELECT a.station, 'cluster', sum(b.n*b.t)/sum(b.n), sum(b.n*b.t3)/sum(b.n) FROM m a JOIN m b ON a.region = b.region AND a.station <> b.station GROUP BY 1 HAVING count(*) >= 5),
f AS (SELECT *, -t3_r AS k, t_r*sin(t3_r*pi())/(t3_r*pi()) AS a FROM parts WHERE t3_r BETWEEN -0.9 AND 0.9),
q AS (SELECT station, kind, period, 1 - a*(1/k - pi()/sin(k*pi())) + a/k*(1 - pow(1.0/(period-1), k)) AS q FROM f, (SELECT unnest({list(RETURN_PERIODS)})::INT AS period)),
c AS (SELECT station, period, max(q) FILTER (WHERE kind='at_site') AS at_site, max(q) FILTER (WHERE kind='roi') AS roi, max(q) FILTER (WHERE kind='cluster') AS cluster FROM q GROUP BY ALL HAVING at_site IS NOT NULL)"""


@query(f"WITH {_CURVES} SELECT station, period, round(at_site,4) AS at_site, round(roi,4) AS roi, round(cluster,4) AS cluster FROM c")
def growth_loo_glo(spark, sf_dir):
    """Pool and region against the station's own curve, with the closed form to check by."""
    z = _z(spark, sf_dir)
    return rounded(validate.curves_without_target(z.where("l1 is not null"), pools(z, 500), "GLO"), 4)


@query()
def growth_loo_gno(spark, sf_dir):
    z = _z(spark, sf_dir)
    return validate.compared(validate.curves_without_target(z.where("l1 is not null"), pools(z, 500), "GNO"))


@query(f"""WITH {NEAR}, {MEMBERS}, s AS (SELECT station, neighbour FROM nn WHERE rank <= 4 UNION ALL SELECT station, station FROM z)
SELECT s.station, round(stddev_pop(m.t), 6) AS spread FROM s JOIN m ON m.station = s.neighbour GROUP BY 1""")
def neighbour_spread(spark, sf_dir):
    z = _z(spark, sf_dir)
    return rounded(space.neighbour_spread(z, "station", ATTRIBUTES, z.where("l1 is not null"), "t"))


@query()
def neighbour_similarity(spark, sf_dir):
    """Median spread of neighbours' L-CV against that of 2,000 random sets, and the gain in percent."""
    z = _z(spark, sf_dir)
    m = z.where("l1 is not null")
    near = space.neighbour_spread(z, "station", ATTRIBUTES, m, "t").agg(F.median("spread").alias("near"))
    both = near.crossJoin(space.random_spread(m, "t").agg(F.median("spread").alias("random")))  # one row each
    return both.withColumn("gain", 100 * (1 - F.col("near") / F.col("random")))


@query(f"WITH {PAIRS} SELECT true AS symmetric, true AS zero_diagonal, true AS same, count(*) AS pairs FROM d")
def distance_checks(spark, sf_dir):
    """With all components kept, distances of scores are those of standard scores."""
    z = _z(spark, sf_dir)
    scores = space.scores(z, space.components(z, ATTRIBUTES), ["station"])
    return space.checked_distances(scores, z, "station", [f"pc{k + 1}" for k in range(len(ATTRIBUTES))], ATTRIBUTES)


@query()
def top_loadings(spark, sf_dir):
    return space.loading_table(spark, space.components(attributes(spark, sf_dir), ATTRIBUTES)).where("rank <= 3")


def _validity(spark, sf_dir, ks: list[int]):
    z = _z(spark, sf_dir)
    return cluster.validity(z, "station", ATTRIBUTES, ks, z.where("l1 is not null").select("station", "n", "t", "t3", "t4", F.lit(0).alias("region")))


@query()
def cluster_validity(spark, sf_dir):
    return _validity(spark, sf_dir, list(range(2, 16)))


@query()
def chosen_k(spark, sf_dir):
    table = _validity(spark, sf_dir, list(range(3, 9)))
    return cluster.best_k(table.select("k", "silhouette", "min_contrib", (F.col("min_contrib") >= 5).alias("testable")))


def _clustered(spark, sf_dir):
    """Stations with moments in six of Ward's clusters, and their regions of influence."""
    z = _z(spark, sf_dir)
    labels = cluster.ward_kmeans(z, "station", ATTRIBUTES, [6]).select("station", F.col("cluster").alias("region"))
    members = stored(z.where("l1 is not null").drop("region").join(labels, "station").select("station", "region", "n", "t", "t3", "t4"), "members")
    regions = stored(roi.grown_regions(z, ATTRIBUTES), "regions")
    return members, regions


@query()
def site_transfers(spark, sf_dir):
    """Sites whose region of influence lies elsewhere, tried pass by pass in the cluster that
    holds it until none moves."""
    members, regions = _clustered(spark, sf_dir)
    return cluster.transfer_passes(members, roi.region_members(regions))[0]


@query()
def final_region_report(spark, sf_dir):
    """Clusters after all passes of transfers, tested, with advice."""
    members, regions = _clustered(spark, sf_dir)
    return cluster.region_report(cluster.transfer_passes(members, roi.region_members(regions))[1])


@query(f"WITH {INDEX}, f AS (SELECT regr_slope(y, price) AS b, regr_intercept(y, price) AS a FROM x) SELECT station, round(b*price + y - (a + b*price), 6) AS component_residual FROM x, f")
def component_residual(spark, sf_dir):
    d = _index(spark, sf_dir)
    fit = indexflood.ols(indexflood.gram(d, ["price"], "y"), ["price"])
    return rounded(indexflood.partial_residuals(d, fit, "price", "y").select("station", "component_residual"))


@query(f"WITH {ATTRS} SELECT station, round(price, 4) AS price FROM att")
def drop_constants(spark, sf_dir):
    a = attributes(spark, sf_dir).select("station", F.round("price", 4).alias("price"), F.lit(3).alias("always"))
    return selection.without_constants(a, ["price", "always"])


@query(f"""WITH {GRID}, d AS (SELECT * FROM (VALUES (1,0,1),(2,1,1),(4,1,0),(8,1,-1),(16,0,-1),(32,-1,-1),(64,-1,0),(128,-1,1)) v(code, dr, dc)),
s AS (SELECT a.row, a.col, code, (a.z-b.z)/sqrt(dr*dr+dc*dc) AS fall FROM cells a, d JOIN cells b ON b.row = a.row+dr AND b.col = a.col+dc WHERE a.z > b.z),
p AS (SELECT row, col, code FROM s QUALIFY row_number() OVER (PARTITION BY row, col ORDER BY fall DESC, code) = 1)
SELECT cells.row, cells.col, coalesce(code, 0)::INT AS fdir FROM cells LEFT JOIN p ON p.row = cells.row AND p.col = cells.col""")
def flow_directions(spark, sf_dir):
    return raster.flow_directions(_grid(spark, sf_dir)).select("row", "col", "fdir")


@query(f"""WITH RECURSIVE {GRID}, e AS (SELECT row, col, row + (fdir=4)::INT AS tr, col + (fdir=1)::INT AS tc FROM cells),
walk AS (SELECT row AS sr, col AS sc, row, col FROM cells UNION ALL SELECT walk.sr, walk.sc, c.row, c.col FROM walk JOIN e ON e.row = walk.row AND e.col = walk.col JOIN cells c ON c.row = e.tr AND c.col = e.tc)
SELECT row, col, count(*) AS acc FROM walk GROUP BY ALL""")
def flow_accumulation(spark, sf_dir):
    return raster.accumulation(_grid(spark, sf_dir))


_STEP = """(CASE WHEN lead({o}) OVER {w} IS NULL OR lag({o}) OVER {w} IS NULL THEN 1.0 ELSE 0.5 END) * (coalesce(lead(z) OVER {w}, z) - coalesce(lag(z) OVER {w}, z))"""


@query(f"""WITH {GRID}, g AS (SELECT basin, row, col, {_STEP.format(o='col', w='(PARTITION BY basin, row ORDER BY col)')} AS dx, {_STEP.format(o='row', w='(PARTITION BY basin, col ORDER BY row)')} AS dy FROM cells),
a AS (SELECT *, atan(sqrt(dx*dx+dy*dy)) AS tilt, atan2(-dy, dx) AS aspect FROM g)
SELECT basin, row, col, round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, sin(radians(45))*cos(tilt) + cos(radians(45))*sin(tilt)*cos(radians(315)-aspect))), 6) AS shade FROM a""")
def hillshade(spark, sf_dir):
    return rounded(raster.hillshade(_grid(spark, sf_dir), "basin"))


@query(f"WITH {GRID} SELECT basin, round(76 + (avg(col)+0.5)*0.01, 6) AS lon, round(12 - (avg(row)+0.5)*0.01, 6) AS lat FROM cells GROUP BY 1")
def catchment_centroids(spark, sf_dir):
    return rounded(raster.centroids(_grid(spark, sf_dir), "basin", 76.0, 12.0, 0.01))


@query(f"WITH {GRID} SELECT max(acc) FILTER (WHERE row = 5 AND col = 10) AS at_outlet, max(acc) AS largest, count(*) AS cells FROM cells WHERE abs(row-5) <= 5 AND abs(col-10) <= 5")
def outlet_window(spark, sf_dir):
    return raster.outlet_window(_grid(spark, sf_dir), 5, 10, 5)


_AREA = "6371.0*6371.0*(sin(radians(north))-sin(radians(south)))*radians(east-west)"


@query(f"""WITH RECURSIVE b AS (SELECT s_suppkey AS station, CAST(s_acctbal AS DOUBLE)/60.0::DOUBLE AS lon, (s_suppkey*7919 % 1200)/10.0::DOUBLE - 60.0::DOUBLE AS lat, 1.0::DOUBLE + s_nationkey/10.0::DOUBLE AS half FROM supplier),
t AS (SELECT station, lon-half AS west, lat-half AS south, lon+half AS east, lat+half AS north FROM b UNION ALL
SELECT station, CASE WHEN wide AND part = 1 THEN (west+east)/2 ELSE west END, CASE WHEN NOT wide AND part = 1 THEN (south+north)/2 ELSE south END,
CASE WHEN wide AND part = 0 THEN (west+east)/2 ELSE east END, CASE WHEN NOT wide AND part = 0 THEN (south+north)/2 ELSE north END
FROM (SELECT *, east-west >= north-south AS wide FROM t WHERE {_AREA} > 50000), (SELECT unnest([0,1]) AS part))
SELECT station, round(west,6) AS west, round(south,6) AS south, round(east,6) AS east, round(north,6) AS north, round({_AREA}, 4) AS area_km2 FROM t WHERE {_AREA} <= 50000""")
def bbox_tiles(spark, sf_dir):
    """A box around each supplier's place, cut into parts of 50,000 square kilometres or less."""
    s = table(spark, sf_dir, "supplier")
    place = s.select(F.col("s_suppkey").alias("station"), (F.col("s_acctbal").cast("double") / 60).alias("lon"), ((F.col("s_suppkey") * 7919 % 1200) / 10 - 60).alias("lat"), (1 + F.col("s_nationkey") / 10).alias("half"))
    boxes = place.selectExpr("station", "lon - half AS west", "lat - half AS south", "lon + half AS east", "lat + half AS north")
    return rounded(raster.bbox_tiles(boxes, "station", 50_000.0)).withColumn("area_km2", F.round("area_km2", 4))


@query("""WITH b AS (SELECT user_id AS station, date_trunc('day', ts) AS d, max(value) AS ams FROM events WHERE value > 0 GROUP BY ALL)
SELECT station, strftime(d, '%Y-%m-%d') AS block, ams FROM b WHERE d + INTERVAL 1 DAY <= (SELECT max(ts) FROM events WHERE value > 0) - INTERVAL 1 DAY""")
def stream_daily_maxima(spark, sf_dir):
    """The events as a stream: blocks that the watermark has closed."""
    # As a pattern the path may be a folder or, as in tests, one file.
    stream = spark.readStream.schema(table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events.parque[t]").withColumn("ts", F.col("ts").cast("timestamp"))
    found = streaming.final_blocks(stream, "user_id", "ts", "value", fresh_path(spark, "stream"))
    return found.select("station", F.date_format("block_start", "yyyy-MM-dd").alias("block"), "ams")
