"""Numerical queries: spaces, pools, simulation, regression, clusters, grids."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import functions as F

from tributary.functions.distributions import RETURN_PERIODS
from tributary.functions.lineage import stored
from tributary.operators import cluster, homogeneity, indexflood, lmoments, raster, roi, space, validate
from tributary.plans.catalogue import query
from tributary.plans.standins import ATTRIBUTES, ATTRS, DAYS, MEMBERS, REGIONS, attributes, day_members, nation_members, rounded, stations, table

Z = ", ".join(f"({c}-avg({c}) OVER ())/stddev_pop({c}) OVER () AS {c}" for c in ATTRIBUTES)
ZED = f"{ATTRS}, z AS (SELECT station, region, {Z} FROM att)"
PAIRS = f"{ZED}, d AS (SELECT p.station, q.station AS neighbour, sqrt({'+'.join(f'(p.{c}-q.{c})^2' for c in ATTRIBUTES)}) AS distance FROM z p, z q)"
NEAR = f"{PAIRS}, nn AS (SELECT *, row_number() OVER (PARTITION BY station ORDER BY distance, neighbour) AS rank FROM d WHERE station <> neighbour)"


def _z(spark, sf_dir):
    """Stations with standard scores of their attributes, and their moments, stored."""
    return stored(space.standardised(stations(spark, sf_dir), ATTRIBUTES), "scores")


@query(f"WITH {ZED} SELECT station, region, {', '.join(f'round({c},6) AS {c}' for c in ATTRIBUTES)} FROM z")
def zscore_pop(spark, sf_dir):
    return rounded(_z(spark, sf_dir).select("station", "region", *ATTRIBUTES))


@query()
def pca_variance(spark, sf_dir):
    return space.variance_table(spark, space.components(attributes(spark, sf_dir), ATTRIBUTES))


@query()
def pca_loadings(spark, sf_dir):
    return space.loading_table(spark, space.components(attributes(spark, sf_dir), ATTRIBUTES))


@query()
def pca_scores(spark, sf_dir):
    a = attributes(spark, sf_dir)
    return space.scores(a, space.components(a, ATTRIBUTES), ["station"])


@query(f"WITH {PAIRS} SELECT station, neighbour, round(distance, 6) AS distance FROM d")
def pairwise_distance(spark, sf_dir):
    return rounded(space.distances(_z(spark, sf_dir), "station", ATTRIBUTES))


@query(f"WITH {NEAR} SELECT station, neighbour, round(distance,6) AS distance, rank FROM nn WHERE rank <= 15")
def knn15(spark, sf_dir):
    return rounded(space.neighbours(_z(spark, sf_dir), "station", ATTRIBUTES, 15))


@query(f"WITH {PAIRS}, {MEMBERS} SELECT d.station, count(*) AS members, sum(m.n)::BIGINT AS station_years FROM d JOIN m ON m.station = d.neighbour WHERE distance <= 1.5 GROUP BY 1")
def threshold_roi(spark, sf_dir):
    z = _z(spark, sf_dir)
    n = z.where("n is not null and l1 is not null").select(F.col("station").alias("neighbour"), "n")
    return space.within(z, "station", ATTRIBUTES, 1.5).join(n, "neighbour").groupBy("station").agg(F.count(F.lit(1)).alias("members"), F.sum("n").alias("station_years"))


def pools(z, years: int):
    """Nearest stations with moments until so many years are pooled."""
    m = z.where("l1 is not null").select(F.col("station").alias("neighbour"), "n", "t", "t3", "t4")
    return roi.pools_by_years(space.neighbours(z, "station", ATTRIBUTES, 25).drop("rank").join(m, "neighbour"), years)


@query(f"""WITH {NEAR}, {MEMBERS}, p AS (SELECT nn.station, neighbour, distance, rank, coalesce(sum(m.n) OVER (PARTITION BY nn.station ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
FROM nn JOIN m ON m.station = neighbour) SELECT station, neighbour, rank FROM p WHERE (before < 500 OR rank <= 5) AND rank <= 25""")
def pool_5t(spark, sf_dir):
    return pools(_z(spark, sf_dir), 500).select("station", "neighbour", "rank")


@query(f"""WITH {NEAR}, s AS (SELECT station, list(neighbour) AS a FROM nn WHERE rank <= 10 GROUP BY 1), t AS (SELECT station, list(neighbour) AS b FROM nn WHERE rank BETWEEN 5 AND 15 GROUP BY 1)
SELECT station, round(len(list_intersect(a,b)) / len(list_distinct(list_concat(a,b))), 6) AS jaccard FROM s JOIN t USING (station)""")
def jaccard_overlap(spark, sf_dir):
    n = space.neighbours(_z(spark, sf_dir), "station", ATTRIBUTES, 15)
    both = n.groupBy("station").agg(F.collect_list(F.when(F.col("rank") <= 10, F.col("neighbour"))).alias("a"), F.collect_list(F.when(F.col("rank") >= 5, F.col("neighbour"))).alias("b"))
    return rounded(both.select("station", roi.jaccard(F.col("a"), F.col("b")).alias("jaccard")))


def _rank(c: str) -> str:
    return f"(rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1)/2.0)"


@query(f"""WITH {PAIRS}, {MEMBERS}, e AS (SELECT round(d.distance,9) AS dist, round(abs(a.t-b.t),9) AS gap FROM d JOIN m a ON a.station = d.station JOIN m b ON b.station = d.neighbour WHERE d.station < d.neighbour),
r AS (SELECT {_rank('dist')} AS ra, {_rank('gap')} AS rb FROM e) SELECT round(corr(ra, rb), 6) AS rho, count(*) AS n FROM r""")
def spearman_distance(spark, sf_dir):
    return rounded(space.pair_correlation(_z(spark, sf_dir).where("l1 is not null"), ATTRIBUTES, "t"))


@query()
def heterogeneity_h123(spark, sf_dir):
    return homogeneity.region_heterogeneity(day_members(spark, sf_dir))


@query()
def zdist_fit(spark, sf_dir):
    return homogeneity.region_fits(day_members(spark, sf_dir))


@query()
def z_polynomials(spark, sf_dir):
    """Z of each family by the polynomials of its L-kurtosis, with bias and deviation from
    simulation."""
    return homogeneity.polynomial_goodness(day_members(spark, sf_dir))


def grown(spark, sf_dir, rules: roi.Rules = roi.Rules()):
    z = _z(spark, sf_dir)
    return z, stored(roi.grown_regions(z, ATTRIBUTES, rules), "regions")


@query()
def roi_growth(spark, sf_dir):
    """Size, tier, H, members with their discordancy, and what was left out, of every region."""
    return grown(spark, sf_dir)[1].drop("steps")


@query()
def roi_growth_ungauged(spark, sf_dir):
    """The target's own flow is masked."""
    return roi.region_members(grown(spark, sf_dir, roi.Rules(use_target_flow=False))[1])


@query()
def roi_step_log(spark, sf_dir):
    """Every candidate of every region and what became of it."""
    return roi.step_log(grown(spark, sf_dir)[1])


@query()
def roi_growth_path(spark, sf_dir):
    return roi.growth_path(grown(spark, sf_dir)[1])


@query()
def roi_result_summary(spark, sf_dir):
    """Least, median and largest of the regions' results."""
    return roi.result_summary(grown(spark, sf_dir)[1], "roi_size", "pooled_years", "h1", "excluded_discordant", "excluded_heterogeneous")


@query()
def roi_fits(spark, sf_dir):
    """The whole chain: regions grown, distributions fitted to their members, growth curves,
    design values of every station and return period."""
    z, regions = grown(spark, sf_dir)
    moments = z.where("l1 is not null").select(F.col("station").alias("member"), "n", "t", "t3", "t4")
    members = roi.region_members(regions).join(moments, "member").select(F.col("station").alias("region"), F.col("member").alias("station"), "n", "t", "t3", "t4")
    curves = homogeneity.curve_rows(stored(homogeneity.region_fits(members), "fits")).withColumnRenamed("region", "station")
    mean = z.select("station", F.col("l1").alias("mu"))
    tiers = regions.select("station", "tier")
    return curves.join(mean, "station").join(tiers, "station").select("station", "tier", "family", "period", "q", (F.col("mu") * F.col("q")).alias("design"))


@query(f"""WITH {MEMBERS}, {REGIONS}, r AS (SELECT region, t_r, t3_r, -t3_r AS k FROM reg WHERE t3_r BETWEEN -0.9 AND 0.9)
SELECT region, period, round(1 - t_r*sin(k*pi())/(k*pi())*(1/k - pi()/sin(k*pi())) + t_r*sin(k*pi())/(k*pi())/k*(1 - pow(1.0/(period-1), k)), 4) AS q
FROM r, (SELECT unnest({list(RETURN_PERIODS)})::INT AS period)""")
def glo_fitted_curve(spark, sf_dir):
    """The numerical fit, against the closed form."""
    return rounded(homogeneity.family_curve(lmoments.regional_means(nation_members(spark, sf_dir)), "GLO"), 4)


def _family(name: str):
    def f(spark, sf_dir):
        return homogeneity.family_curve(lmoments.regional_means(day_members(spark, sf_dir)), name)

    f.__name__ = f"{name.lower()}_growth_curve"
    return f


for _name in ("GNO", "PE3"):
    query()(_family(_name))


_GEV = f"""WITH {DAYS}, {REGIONS}, c AS (SELECT region, t_r, 2/(3+t3_r) - ln(2)/ln(3) AS c FROM reg), k AS (SELECT region, t_r, 7.8590*c + 2.9554*c*c AS k FROM c),
g AS (SELECT region, t_r, k, gamma(1+k) AS g FROM k), a AS (SELECT *, t_r*k/((1-pow(2,-k))*g) AS a FROM g)
SELECT region, period, round(1 - a*(1-g)/k + a/k*(1 - pow(-ln(1-1.0/period), k)), {{digits}}) AS q FROM a, (SELECT unnest({list(RETURN_PERIODS)})::INT AS period)"""


_NORMALS = ", ".join(f"({p}, {NormalDist().inv_cdf(1 - 1 / p)!r}::DOUBLE)" for p in RETURN_PERIODS)


# erf from its alternating series, term by term.
@query(f"""WITH {DAYS}, {REGIONS}, s AS (SELECT region, t_r, -t3_r*(2.0466534-3.6544371*pow(t3_r,2)+1.8396733*pow(t3_r,4)-0.20360244*pow(t3_r,6))/(1-2.0182173*pow(t3_r,2)+1.2033464*pow(t3_r,4)-0.40077113*pow(t3_r,6)) AS k FROM reg),
e AS (SELECT *, 2/sqrt(pi())*list_sum(list_transform(range(30), lambda n: pow(-1, n)*pow(k/2, 2*n+1)/(factorial(n::INT)::DOUBLE*(2*n+1)))) AS erf FROM s), a AS (SELECT *, t_r*k*exp(-k*k/2)/erf AS a FROM e)
SELECT region, period::INT AS period, round(1 - a*(1-exp(k*k/2))/k + a*(1-exp(-k*z))/k, 6) AS q FROM a, (VALUES {_NORMALS}) v(period, z)""")
def gno_closed_form(spark, sf_dir):
    return rounded(lmoments.growth_curve_gno(lmoments.regional_means(day_members(spark, sf_dir))))


@query(_GEV.format(digits=6))
def gev_closed_form(spark, sf_dir):
    return rounded(lmoments.growth_curve_gev(lmoments.regional_means(day_members(spark, sf_dir))))


@query(f"""WITH RECURSIVE {DAYS}, {REGIONS}, b AS (SELECT region, t_r, t3_r, -0.9::DOUBLE AS lo, 0.91::DOUBLE AS hi, 0 AS i FROM reg WHERE t3_r BETWEEN -0.294 AND 0.898 UNION ALL
SELECT region, t_r, t3_r, CASE WHEN up THEN m ELSE lo END, CASE WHEN up THEN hi ELSE m END, i + 1 FROM (SELECT *, (lo+hi)/2 AS m, 2*(1-pow(3,-(lo+hi)/2))/(1-pow(2,-(lo+hi)/2)) - 3 > t3_r AS up FROM b WHERE i < 60)),
k AS (SELECT region, t_r, (lo+hi)/2 AS k FROM b WHERE i = 60), g AS (SELECT region, t_r, k, gamma(1+k) AS g FROM k), a AS (SELECT *, t_r*k/((1-pow(2,-k))*g) AS a FROM g)
SELECT region, period, round(1 - a*(1-g)/k + a/k*(1 - pow(-ln(1-1.0/period), k)), 5) AS q FROM a, (SELECT unnest({list(RETURN_PERIODS)})::INT AS period)""")
def gev_growth_curve(spark, sf_dir):
    """The numerical fit, against sixty halvings of the shape."""
    return rounded(homogeneity.family_curve(lmoments.regional_means(day_members(spark, sf_dir)), "GEV"), 5)


def _normal_equations(source: str, columns: list[str], y: str) -> str:
    """SQL for a least-squares fit by Gauss-Jordan steps on the cross products, one CTE a
    step: (term, b)."""
    terms = ["1.0::DOUBLE", *columns]
    p = len(terms)
    cells = ", ".join(f"sum({terms[i]}*{terms[j] if j < p else y}) AS m{i}_{j}" for i in range(p) for j in range(p + 1))
    sql = f"s0 AS (SELECT {cells} FROM {source})"
    for k in range(p):
        step = ", ".join(f"m{k}_{j}/m{k}_{k} AS m{i}_{j}" if i == k else f"m{i}_{j} - m{i}_{k}*m{k}_{j}/m{k}_{k} AS m{i}_{j}" for i in range(p) for j in range(p + 1))
        sql += f", s{k + 1} AS (SELECT {step} FROM s{k})"
    names = ["intercept", *columns]
    return sql + ", beta AS (" + " UNION ALL ".join(f"SELECT '{names[i]}' AS term, m{i}_{p} AS b FROM s{p}" for i in range(p)) + ")"


_FOUR = ATTRIBUTES[:2] + ATTRIBUTES[3:]


@query(f"WITH {ZED}, {_normal_equations('z', _FOUR, 'price')} SELECT term, round(b, 6) + 0::DOUBLE AS b FROM beta")
def ols_multi(spark, sf_dir):
    fit = indexflood.ols(indexflood.gram(_z(spark, sf_dir), _FOUR, "price"), _FOUR)
    return indexflood.coefficient_table(spark, fit).select("term", (F.round("b", 6) + F.lit(0.0)).alias("b"))  # no negative zero


@query()
def ols_multi_tests(spark, sf_dir):
    """All coefficients with errors, t and p."""
    return indexflood.coefficient_table(spark, indexflood.ols(indexflood.gram(_z(spark, sf_dir), _FOUR, "price"), _FOUR))


@query(f"WITH {ATTRS} SELECT 'quantity' AS attribute, round(1/(1-corr(quantity,price)^2),6) AS vif FROM att UNION ALL SELECT 'price', round(1/(1-corr(quantity,price)^2),6) FROM att")
def vif(spark, sf_dir):
    g = indexflood.gram(attributes(spark, sf_dir), ["quantity", "price"], "balance")
    return rounded(spark.createDataFrame(list(indexflood.vif(g, ["quantity", "price"]).items()), "attribute string, vif double"))


def _index(spark, sf_dir):
    """Attributes with log10 of the mean maximum."""
    return stations(spark, sf_dir).where("l1 is not null").withColumn("y", F.log10("l1"))


INDEX = f"{ATTRS}, {MEMBERS}, x AS (SELECT att.*, log10(l1) AS y FROM att JOIN m USING (station))"


@query(f"""WITH {INDEX}, f AS (SELECT regr_slope(y, price) AS b, regr_intercept(y, price) AS a FROM x)
SELECT round(avg(pow(10, y - (a + b*price))), 6) AS smearing FROM x, f""")
def duan_smearing(spark, sf_dir):
    d = _index(spark, sf_dir)
    fit = indexflood.ols(indexflood.gram(d, ["price"], "y"), ["price"])
    return rounded(d.agg(F.avg(F.pow(F.lit(10.0), F.col("y") - indexflood.predicted(fit))).alias("smearing")))


@query(f"""WITH {INDEX}, s AS (SELECT count(*)-1 AS n, sum(price) sx, sum(y) sy, sum(price*price) sxx, sum(price*y) sxy FROM x),
f AS (SELECT station, y, price, n, sx-price AS sx, sy-y AS sy, sxx-price*price AS sxx, sxy-price*y AS sxy FROM x, s),
g AS (SELECT *, (n*sxy-sx*sy)/(n*sxx-sx*sx) AS b FROM f) SELECT station, round((sy-b*sx)/n + b*price, 6) AS estimate, round(y,6) AS observed FROM g""")
def loo_simple_regression(spark, sf_dir):
    return rounded(indexflood.simple_leave_one_out(_index(spark, sf_dir), "station", "price", "y"))


@query()
def loo_index_flood(spark, sf_dir):
    return indexflood.leave_one_out(_index(spark, sf_dir), "station", ATTRIBUTES, "y")


@query()
def loo_index_summary(spark, sf_dir):
    """R2 on log10 and how many folds agree on their predictors."""
    return indexflood.leave_one_out_summary(stored(loo_index_flood(spark, sf_dir), "folds"))


@query()
def forward_stepwise(spark, sf_dir):
    d = _index(spark, sf_dir)
    model = space.components(d, ATTRIBUTES)
    pcs = space.scores(d, model, ["station", "y"])
    g = indexflood.gram(pcs, [f"pc{k + 1}" for k in range(len(ATTRIBUTES))], "y")
    return indexflood.coefficient_table(spark, indexflood.ols(g, indexflood.forward_stepwise(g)))


@query()
def forward_adjusted(spark, sf_dir):
    g = indexflood.gram(_index(spark, sf_dir), ATTRIBUTES, "y")
    return indexflood.coefficient_table(spark, indexflood.ols(g, indexflood.forward_adjusted(g, fallback="price")))


@query()
def attribute_equation(spark, sf_dir):
    d = _index(spark, sf_dir)
    model = space.components(d, ATTRIBUTES)
    g = indexflood.gram(space.scores(d, model, ["station", "y"]), [f"pc{k + 1}" for k in range(len(ATTRIBUTES))], "y")
    return spark.createDataFrame(indexflood.attribute_equation(model, indexflood.ols(g, indexflood.forward_stepwise(g))), "attribute string, coef_per_unit double, coef_per_1sd double")


@query()
def kmeans_clusters(spark, sf_dir):
    return cluster.kmeans(_z(spark, sf_dir), ATTRIBUTES, 4).select("station", "cluster")


@query()
def ward_kmeans(spark, sf_dir):
    return cluster.ward_kmeans(_z(spark, sf_dir), "station", ATTRIBUTES, [4]).drop("k")


@query()
def kmeans_sweep(spark, sf_dir):
    """Inertia and silhouette of K-means for 2 to 12 clusters."""
    return cluster.kmeans_sweep(_z(spark, sf_dir), "station", ATTRIBUTES, list(range(2, 13)))


@query(f"""WITH {PAIRS}, c AS (SELECT station, region % 4 AS cluster FROM z), p AS (SELECT d.station, a.cluster, b.cluster AS theirs, avg(distance) AS m FROM d JOIN c a ON a.station=d.station JOIN c b ON b.station=d.neighbour
WHERE d.station <> d.neighbour GROUP BY ALL), s AS (SELECT station, min(m) FILTER (WHERE cluster=theirs) AS a, min(m) FILTER (WHERE cluster<>theirs) AS b FROM p GROUP BY 1)
SELECT station, round(CASE WHEN a IS NULL OR b IS NULL THEN 0 ELSE (b-a)/greatest(a,b) END, 6) AS silhouette FROM s""")
def silhouette(spark, sf_dir):
    z = _z(spark, sf_dir).withColumn("cluster", F.col("region") % 4)
    return rounded(cluster.silhouettes(z, "station", ATTRIBUTES))


@query(f"""WITH {ZED}, c AS (SELECT region % 4 AS cluster, {', '.join(f'avg({c}) AS {c}' for c in ATTRIBUTES)} FROM z GROUP BY 1),
s AS (SELECT c.*, x.s FROM c JOIN (SELECT region % 4 AS cluster, avg(sqrt({'+'.join(f'(z.{c}-c.{c})^2' for c in ATTRIBUTES)})) AS s FROM z JOIN c ON c.cluster = region % 4 GROUP BY 1) x USING (cluster)),
r AS (SELECT a.cluster, max((a.s+b.s)/sqrt({'+'.join(f'(a.{c}-b.{c})^2' for c in ATTRIBUTES)})) AS r FROM s a JOIN s b ON a.cluster <> b.cluster GROUP BY 1)
SELECT round(avg(r), 6) AS davies_bouldin, count(*) AS clusters FROM r""")
def davies_bouldin(spark, sf_dir):
    return rounded(cluster.davies_bouldin(_z(spark, sf_dir).withColumn("cluster", F.col("region") % 4), ATTRIBUTES))


# Parts as cells of a grid, 20 to a row, with their size as height: each flows to the east or
# south, as its place says, so rivers grow with the table.
GRID = """cells AS (SELECT row, col, CASE WHEN (row*7+col*3) % 5 < 2 THEN 1 ELSE 4 END AS fdir, (row*col)::BIGINT AS acc, z, (row // 10)::INT AS basin
FROM (SELECT (p_partkey // 20)::INT AS row, (p_partkey % 20)::INT AS col, (p_size - 2)::DOUBLE AS z FROM part))"""


def _grid(spark, sf_dir):
    d = table(spark, sf_dir, "part").select(F.expr("int(p_partkey div 20)").alias("row"), (F.col("p_partkey") % 20).cast("int").alias("col"), (F.col("p_size") - 2).cast("double").alias("z"))
    r, c = F.col("row"), F.col("col")
    return d.select("row", "col", F.when((r * 7 + c * 3) % 5 < 2, 1).otherwise(4).alias("fdir"), (r * c).cast("long").alias("acc"), "z", F.expr("int(row div 10)").alias("basin"))


@query(f"""WITH RECURSIVE {GRID}, e AS (SELECT row, col, row + (fdir=4)::INT AS tr, col + (fdir=1)::INT AS tc FROM cells),
up AS (SELECT 9 AS row, 15 AS col UNION SELECT e.row, e.col FROM e JOIN up ON e.tr = up.row AND e.tc = up.col) SELECT row::INT AS row, col::INT AS col FROM up""")
def flow_bfs(spark, sf_dir):
    return raster.catchment(_grid(spark, sf_dir), 9, 15)


@query(f"""WITH {GRID}, c AS (SELECT *, CASE WHEN acc >= 50 THEN 0 WHEN acc >= 20 THEN 1 WHEN acc >= 5 THEN 2 END AS tier, (row-5)^2+(col-10)^2 AS gap FROM cells WHERE abs(row-5) <= 5 AND abs(col-10) <= 5)
SELECT row, col, acc, round(sqrt(gap), 6) AS distance FROM c WHERE tier IS NOT NULL ORDER BY tier, gap, row, col LIMIT 1""")
def snap_outlet(spark, sf_dir):
    return rounded(raster.snap_outlet(_grid(spark, sf_dir), 5, 10, 5, [5, 20, 50]))


@query(f"""WITH {GRID}, s AS (SELECT basin, count(*) AS n, avg(z) FILTER (WHERE z > 0) AS mean_elev, min(z) FILTER (WHERE z > 0) AS min_elev, max(z) FILTER (WHERE z > 0) AS max_elev, count(*) FILTER (WHERE acc > 100) AS st FROM cells GROUP BY 1)
SELECT basin, round(n*(0.01*111)^2, 6) AS area_km2, round(mean_elev,6) AS mean_elev, min_elev, max_elev, max_elev-min_elev AS relief, round(st*0.03::DOUBLE,6) AS stream_km, round(st*0.03::DOUBLE/(n*(0.01*111)^2),6) AS drain_density FROM s""")
def catchment_summary(spark, sf_dir):
    return rounded(raster.summaries(_grid(spark, sf_dir), "basin", 0.01, 100))


@query(f"""WITH {GRID}, s AS (SELECT basin, row, col, coalesce(z,0) AS z FROM cells), g AS (SELECT basin,
(coalesce(lead(z) OVER (PARTITION BY basin, row ORDER BY col),0) - coalesce(lag(z) OVER (PARTITION BY basin, row ORDER BY col),0))/60 AS dx,
(coalesce(lead(z) OVER (PARTITION BY basin, col ORDER BY row),0) - coalesce(lag(z) OVER (PARTITION BY basin, col ORDER BY row),0))/60 AS dy FROM s)
SELECT basin, round(avg(degrees(atan(sqrt(dx*dx+dy*dy)))),6) AS mean_slope FROM g GROUP BY 1""")
def mean_slope(spark, sf_dir):
    return rounded(raster.mean_slope(_grid(spark, sf_dir), "basin", 30.0))


@query(f"WITH {GRID} SELECT basin, (min(row) <= 0 OR min(col) <= 0 OR max(row) >= (SELECT max(row) FROM cells) OR max(col) >= 19) AS touches FROM cells WHERE col BETWEEN 2 AND 17 GROUP BY 1")
def boundary_touch(spark, sf_dir):
    cells = _grid(spark, sf_dir)
    rows = cells.agg(F.max("row")).first()[0] + 1
    return raster.touches_edge(cells.where("col between 2 and 17"), "basin", rows, 20)


_BASINS = "k AS (SELECT (row+col)//13 AS b, row, col FROM cells UNION SELECT (row+col+5)//13 + 100, row, col FROM cells)"


@query(f"""WITH {GRID}, {_BASINS}, n AS (SELECT b, count(*) AS n FROM k GROUP BY 1), p AS (SELECT x.b AS a, y.b AS b, count(*) AS shared FROM k x JOIN k y ON x.row=y.row AND x.col=y.col AND x.b < y.b GROUP BY ALL)
SELECT a::INT AS a, p.b::INT AS b, shared, round(100.0*shared/least(na.n, nb.n), 6) AS percent FROM p JOIN n na ON na.b = a JOIN n nb ON nb.b = p.b WHERE 100.0*shared/least(na.n, nb.n) > 10 AND 100.0*shared/least(na.n, nb.n) < 99""")
def overlap_pairs(spark, sf_dir):
    g = _grid(spark, sf_dir)
    k = g.select(F.expr("int((row+col) div 13)").alias("basin"), "row", "col").union(g.select(F.expr("int((row+col+5) div 13 + 100)"), "row", "col"))
    return rounded(raster.overlaps(k, "basin"))


@query(f"WITH {GRID}, t AS (SELECT row, col, 1 AS tile, CASE WHEN z > 10 THEN z END AS z FROM cells UNION ALL SELECT row, col, 2, z FROM cells) SELECT row, col, arg_min(z, tile) AS z FROM t WHERE z IS NOT NULL GROUP BY ALL")
def mosaic(spark, sf_dir):
    g = _grid(spark, sf_dir)
    return raster.mosaic(g.select("row", "col", F.lit(1).alias("tile"), F.when(F.col("z") > 10, F.col("z")).alias("z")).union(g.select("row", "col", F.lit(2), "z")))


@query()
def ungauged_test(spark, sf_dir):
    z = _z(spark, sf_dir)
    y = z.where("l1 is not null").withColumn("y", F.log10("l1"))  # scores serve as attributes do
    return validate.ungauged(z, ATTRIBUTES, indexflood.leave_one_out(y, "station", ATTRIBUTES, "y"))
