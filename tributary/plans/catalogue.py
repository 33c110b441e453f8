"""All registered queries with their reference SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.operators import lmoments, maxima, names, profile, selection
from tributary.plans.standins import AMS, ATTRIBUTES, ATTRS, DAYS, MEMBERS, REGIONS, attributes, day_members, moments, moments_sql, month, monthly_maxima, nation_members, rounded, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its name, with reference SQL where there is any."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from tributary.plans import files, numeric, regional, terrain  # noqa: F401  register more

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return ORACLES


def _glo(region_sql: str) -> str:
    return f"""WITH {region_sql}, {REGIONS},
p AS (SELECT region, -t3_r AS k, t_r FROM reg), q AS (SELECT region, k, t_r*sin(k*pi())/(k*pi()) AS a FROM p),
r AS (SELECT region, k, a, 1 - a*(1/k - pi()/sin(k*pi())) AS x FROM q)
SELECT region, period, round(x + a/k*(1 - pow(1.0/(period-1), k)), 6) AS q FROM r, (SELECT unnest([2,5,10,25,50,100])::INT AS period)"""


@query("""WITH o AS (SELECT l_suppkey AS station, strftime(l_shipdate, '%Y') AS block, date_trunc('month', l_shipdate) AS m, count(*) AS n, max(l_extendedprice) AS v FROM lineitem GROUP BY ALL)
SELECT station, block, max(v) AS ams FROM o WHERE n >= 3 AND v > 0 GROUP BY ALL""")
def least_observations(spark, sf_dir):
    """Yearly maxima of months that count three lines or more."""
    months = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", F.trunc("l_shipdate", "month").alias("month")).agg(F.count(F.lit(1)).alias("n"), F.max("l_extendedprice").alias("v"))
    return maxima.block_maxima(months, "l_suppkey", F.date_format("month", "yyyy"), "v", "n", 3)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Design values of every station: maxima, L-moments, regional curve, Q(T) = mu q(T)."""
    members = nation_members(spark, sf_dir)
    curves = lmoments.growth_curve_glo(lmoments.regional_means(members))
    return rounded(lmoments.design_values(curves, members.select("station", "region", F.col("l1").alias("mu"))), 3)


@query(f"WITH {AMS} SELECT station, block, round(ams, 6) AS ams FROM ams")
def annual_max_series(spark, sf_dir):
    return rounded(monthly_maxima(spark, sf_dir))


@query("SELECT user_id AS station, strftime(ts, '%Y-%m-%d') AS block, round(max(value), 6) AS ams FROM events WHERE value > 0 GROUP BY ALL")
def block_max_positive(spark, sf_dir):
    return rounded(maxima.block_maxima(table(spark, sf_dir, "events"), "user_id", F.date_format("ts", "yyyy-MM-dd"), "value"))


@query(f"""WITH {AMS}, s AS (SELECT station, count(DISTINCT block) AS years_used, median(ams) AS med, max(ams) AS mx FROM ams GROUP BY station),
j AS (SELECT ams.*, med FROM ams JOIN s USING (station)),
l AS (SELECT station, count(*) FILTER (WHERE ams > 1.2*med) AS high, count(*) FILTER (WHERE ams < med/1.2) AS low FROM j GROUP BY station)
SELECT station, years_used, round(med, 4) AS median_annual_max, round(mx, 4) AS max_annual_max, round(mx/med, 4) AS max_over_median,
high AS n_high, low AS n_low, CASE WHEN high + low > 0 THEN 'check' ELSE '' END AS flag FROM s JOIN l USING (station)""")
def station_qc(spark, sf_dir):
    q = maxima.quality(monthly_maxima(spark, sf_dir), 1.2)
    n = lambda c: F.when(F.col(c) == "", 0).otherwise(F.size(F.split(c, ";"))).cast("long")
    return rounded(q.select("station", "years_used", "median_annual_max", "max_annual_max", "max_over_median", n("years_gt_10x_median").alias("n_high"), n("years_lt_median_over_10").alias("n_low"), "flag"), 4)


@query("""WITH o AS (SELECT l_suppkey AS station, strftime(l_shipdate, '%Y-%m') AS block, count(*) AS n_obs FROM lineitem GROUP BY ALL)
SELECT station, count(*) FILTER (WHERE n_obs < 6) AS partial_blocks, count(*) AS blocks FROM o GROUP BY station""")
def partial_count(spark, sf_dir):
    o = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("station"), month("l_shipdate").alias("block")).agg(F.count(F.lit(1)).alias("n_obs"))
    return maxima.partial_blocks(o, "station", "n_obs", 6)


@query("SELECT user_id AS station, max(value) AS largest, min(value) AS smallest FROM events GROUP BY 1")
def climate_extremes(spark, sf_dir):
    return maxima.extremes(table(spark, sf_dir, "events"), "user_id", "value", "value")


@query("""WITH a AS (SELECT user_id AS station, strftime(ts, '%Y-%m-%d') AS block, max(value) AS ams FROM events WHERE value > 0 GROUP BY ALL)
SELECT station, block, ams FROM a WHERE station IN (SELECT station FROM a GROUP BY 1 HAVING count(DISTINCT block) > 15)""")
def record_length_filter(spark, sf_dir):
    return maxima.long_enough(maxima.block_maxima(table(spark, sf_dir, "events"), "user_id", F.date_format("ts", "yyyy-MM-dd"), "value"))


@query("SELECT p_partkey, regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g') AS key FROM part")
def normalise_names(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", names.normalised(F.col("p_name")).alias("key"))


@query("""SELECT page_id, regexp_replace(regexp_replace(regexp_replace(lower(regexp_replace(url, '\\.[^.]*$', '')), '[^a-z0-9]', '', 'g'), '^riverwaterdischarge', ''), 'streamflow$', '') AS key FROM pages""")
def norm_key(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", names.station_key(F.col("url")).alias("key"))


@query(r"SELECT page_id, replace(trim(regexp_replace(url, '[^\p{L}\p{N}_\- ]', '_', 'g')), ' ', '_') AS name FROM pages")
def safe_filename(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", names.safe_filename(F.col("url")).alias("name"))


@query(r"SELECT page_id, regexp_replace(regexp_extract(url, '([^/\\]*)$', 1), '\.[^.]*$', '') AS stem FROM pages")
def file_stem(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", names.stem(F.col("url")).alias("stem"))


@query("""WITH f AS (SELECT DISTINCT p_type AS file, lower(trim(p_type)) AS low FROM part),
n AS (SELECT DISTINCT w AS name, lower(trim(w)) AS key FROM (SELECT unnest(string_split(p_type, ' ')) AS w FROM part UNION ALL SELECT p_type FROM part)),
c AS (SELECT name, file, CASE WHEN low = key THEN 2 ELSE 3 END AS tier FROM n JOIN f
  ON low = key OR regexp_matches(low, '(^|[^0-9a-z])' || key || '([^0-9a-z]|$)'))
SELECT name, file, CASE tier WHEN 2 THEN 'name' ELSE 'whole word' END AS matched_by FROM
  (SELECT *, row_number() OVER (PARTITION BY name ORDER BY tier, length(file), file) AS k FROM c) WHERE k = 1""")
def fuzzy_match_whole_word(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    words = part.select(F.explode(F.split("p_type", " ")).alias("name")).union(part.select("p_type"))
    return names.fuzzy_match(words, part.select(F.col("p_type").alias("file")), "name", "file")


@query("""SELECT s_suppkey, CASE WHEN contains(lower(s_name), '7') THEN 'name marked' WHEN o.n IS NULL THEN 'no file' WHEN o.n <= 590 THEN 'too short'
WHEN s_acctbal < 0 THEN 'missing: s_acctbal' ELSE 'kept' END AS status
FROM supplier LEFT JOIN (SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1) o ON l_suppkey = s_suppkey""")
def first_fail_reason(spark, sf_dir):
    n = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"))
    s = table(spark, sf_dir, "supplier").withColumn("s_acctbal", F.when(F.col("s_acctbal") >= 0, F.col("s_acctbal")))
    lacks = selection.missing_list(["s_acctbal"])
    status = selection.first_reason([(selection.marked(F.col("s_name"), ["7"]), "name marked"), (F.col("n").isNull(), "no file"), (F.col("n") <= 590, "too short"), (lacks != "", F.concat(F.lit("missing: "), lacks))])
    return s.join(n, s.s_suppkey == n.l_suppkey, "left").select("s_suppkey", status.alias("status"))


@query("""SELECT p_brand, p_size, count(*) AS copies, string_agg(p_partkey::VARCHAR, ';' ORDER BY p_partkey::VARCHAR) AS members
FROM part GROUP BY ALL HAVING count(*) > 1""")
def dup_keep_false(spark, sf_dir):
    return selection.repeated(table(spark, sf_dir, "part"), ["p_brand", "p_size"], "p_partkey")


_SERIES = """ams AS (SELECT user_id AS station, strftime(ts, '%Y-%m-%d') AS block, max(value) AS ams FROM events WHERE value > 0 GROUP BY ALL)"""


@query(f"""WITH {_SERIES}, e AS (SELECT * FROM ams UNION ALL SELECT station + 1000000, block, ams FROM ams WHERE ams < 50 OR station % 2 = 0),
s AS (SELECT station, list((block, round(ams, 6)) ORDER BY block) AS sig FROM e GROUP BY 1), f AS (SELECT sig, min(station) AS kept, count(*) n FROM s GROUP BY 1)
SELECT station, kept FROM s JOIN f USING (sig) WHERE n > 1 AND station <> kept""")
def dup_series_signature(spark, sf_dir):
    """All users' daily maxima beside copies under new ids, some of which lack days."""
    ams = maxima.block_maxima(table(spark, sf_dir, "events"), "user_id", F.date_format("ts", "yyyy-MM-dd"), "value")
    copies = ams.where("ams < 50 or station % 2 = 0").withColumn("station", F.col("station") + 1_000_000)
    return maxima.identical_series(ams.unionByName(copies))


@query("SELECT p_partkey, CASE WHEN count(*) OVER (PARTITION BY p_name) > 1 THEN p_name || '__row' || p_partkey ELSE p_name END AS unique_name FROM part")
def unique_suffix(spark, sf_dir):
    return selection.distinct_names(table(spark, sf_dir, "part"), "p_name", "p_partkey").select("p_partkey", "unique_name")


_LONG = ATTRS + ", l AS (SELECT station, attribute, x FROM att UNPIVOT (x FOR attribute IN (quantity, discount, price, tax, balance)))"


@query(f"""WITH {_LONG} SELECT attribute, count(x) AS n, round(avg(x),4) AS mean, round(stddev_samp(x),4) AS std, round(min(x),4) AS min, round(quantile_cont(x,0.25),4) AS q25,
round(quantile_cont(x,0.5),4) AS q50, round(quantile_cont(x,0.75),4) AS q75, round(max(x),4) AS max FROM l GROUP BY attribute""")
def describe_attrs(spark, sf_dir):
    return rounded(profile.describe(attributes(spark, sf_dir), ATTRIBUTES), 4)


@query(f"WITH {_LONG} SELECT attribute, round(skewness(x), 6) AS skew FROM l GROUP BY attribute")
def adj_skewness(spark, sf_dir):
    return rounded(profile.long(attributes(spark, sf_dir), ATTRIBUTES).groupBy("attribute").agg(profile.adjusted_skewness("x").alias("skew")))


_ORDER = "CASE {0} WHEN 'quantity' THEN 1 WHEN 'discount' THEN 2 WHEN 'price' THEN 3 WHEN 'tax' THEN 4 ELSE 5 END"


@query(f"""WITH {_LONG} SELECT p.attribute AS a, q.attribute AS b, round(corr(p.x, q.x), 6) AS r, count(*) AS n FROM l p JOIN l q USING (station)
WHERE {_ORDER.format('p.attribute')} < {_ORDER.format('q.attribute')} GROUP BY ALL""")
def corr_pairs(spark, sf_dir):
    return rounded(profile.correlations(attributes(spark, sf_dir), ATTRIBUTES, 6))


@query(f"WITH {AMS}, {moments_sql()} SELECT station, n, round(l1,4) AS l1, round(l2,4) AS l2, round(t,6) AS t, round(t3,6) AS t3, round(t4,6) AS t4 FROM lm")
def lmoments_at_site(spark, sf_dir):
    m = moments(spark, sf_dir)
    return rounded(m.withColumns({c: F.round(c, 4) for c in ("l1", "l2")}))


@query(f"WITH {MEMBERS}, {REGIONS} SELECT region, sites, pooled, round(t_r,6) AS t_r, round(t3_r,6) AS t3_r, round(t4_r,6) AS t4_r FROM reg")
def regional_weighted_lmoments(spark, sf_dir):
    return rounded(lmoments.regional_means(nation_members(spark, sf_dir)))


@query(f"""WITH {MEMBERS}, {REGIONS} SELECT region, round(sqrt(sum(n*(t-t_r)^2)/sum(n)),6) AS v1, round(sum(n*sqrt((t-t_r)^2+(t3-t3_r)^2))/sum(n),6) AS v2,
round(sum(n*sqrt((t3-t3_r)^2+(t4-t4_r)^2))/sum(n),6) AS v3 FROM m JOIN reg USING (region) GROUP BY region""")
def v_statistics(spark, sf_dir):
    return rounded(lmoments.dispersion(nation_members(spark, sf_dir)))


@query(f"""WITH {DAYS}, mm AS (SELECT region, count(*) AS s, avg(t) a, avg(t3) b, avg(t4) c FROM m GROUP BY region),
d AS (SELECT region, station, s, t-a AS u, t3-b AS v, t4-c AS w FROM m JOIN mm USING (region)),
q AS (SELECT region, sum(u*u) uu, sum(u*v) uv, sum(u*w) uw, sum(v*v) vv, sum(v*w) vw, sum(w*w) ww FROM d GROUP BY region),
z AS (SELECT *, uu*(vv*ww-vw*vw) - uv*(uv*ww-uw*vw) + uw*(uv*vw-uw*vv) AS det FROM q)
SELECT region, station, round(CASE WHEN s >= 5 THEN s/3.0*(u*u*(vv*ww-vw*vw)+v*v*(uu*ww-uw*uw)+w*w*(uu*vv-uv*uv)+2*u*v*(uw*vw-uv*ww)+2*u*w*(uv*vw-uw*vv)+2*v*w*(uv*uw-uu*vw))/det END, 6) AS di,
CASE WHEN s < 5 THEN NULL WHEN s > 14 THEN 3.0::DOUBLE ELSE [1.333,1.648,1.917,2.140,2.329,2.491,2.632,2.757,2.869,2.971][s-4]::DOUBLE END AS critical FROM d JOIN z USING (region)""")
def discordancy(spark, sf_dir):
    return rounded(lmoments.discordancy(day_members(spark, sf_dir)))


@query(_glo(MEMBERS))
def glo_growth_curve(spark, sf_dir):
    return rounded(lmoments.growth_curve_glo(lmoments.regional_means(nation_members(spark, sf_dir))))


@query(f"""WITH {DAYS}, {REGIONS}, p AS (SELECT region, t_r, (1-3*t3_r)/(1+t3_r) AS k FROM reg WHERE t3_r > 0.0256 AND t3_r < 0.905)
SELECT region, period, round(1 - t_r*(2+k) + (1+k)*(2+k)*t_r/k*(1-pow(1.0/period, k)), 6) AS q FROM p, (SELECT unnest([2,5,10,25,50,100])::INT AS period)""")
def gpa_growth_curve(spark, sf_dir):
    return rounded(lmoments.growth_curve_gpa(lmoments.regional_means(day_members(spark, sf_dir))))


def _poly(family: str) -> str:
    return "+".join(f"({a})*pow(t3_r,{k})" for k, a in enumerate(lmoments.KURTOSIS[family]) if a)


@query(f"WITH {MEMBERS}, {REGIONS} SELECT region, {', '.join(f'round({_poly(f)},6) AS {f.lower()}' for f in lmoments.KURTOSIS)} FROM reg")
def dist_t4_poly(spark, sf_dir):
    r = lmoments.regional_means(nation_members(spark, sf_dir))
    return rounded(r.select("region", *(lmoments.model_kurtosis(f, F.col("t3_r")).alias(f.lower()) for f in lmoments.KURTOSIS)))


@query(f"""WITH {MEMBERS}, {REGIONS}, g AS ({' UNION ALL '.join(f"SELECT region, {k} AS k, '{f}' AS family, abs({_poly(f)} - t4_r) AS gap FROM reg" for k, f in enumerate(lmoments.KURTOSIS))})
SELECT region, arg_min(family, gap) AS family, round(min(gap), 6) AS gap FROM g GROUP BY region""")
def best_dist_by_z(spark, sf_dir):
    return rounded(lmoments.nearest_family(lmoments.regional_means(nation_members(spark, sf_dir))))


@query(f"""WITH c AS ({_glo(MEMBERS)}), {MEMBERS} SELECT station, period, round(l1*c2.q, 3) AS design FROM m JOIN (
WITH {REGIONS}, p AS (SELECT region, -t3_r AS k, t_r FROM reg), q AS (SELECT region, k, t_r*sin(k*pi())/(k*pi()) AS a FROM p),
r AS (SELECT region, k, a, 1 - a*(1/k - pi()/sin(k*pi())) AS x FROM q)
SELECT region, period, x + a/k*(1 - pow(1.0/(period-1), k)) AS q FROM r, (SELECT unnest([2,5,10,25,50,100])::INT AS period)) c2 USING (region)""")
def design_flood(spark, sf_dir):
    return flagship(spark, sf_dir)


@query(f"WITH {MEMBERS} SELECT station, region, round(t, 6) AS t FROM m WHERE t <= 0.12")
def lcv_cap(spark, sf_dir):
    return rounded(selection.capped(nation_members(spark, sf_dir), "t", 0.12).select("station", "region", "t"))


@query(f"""WITH {AMS}, q AS (SELECT station, count(DISTINCT block) AS years_used, round(max(ams), 4) AS max_annual_max FROM ams GROUP BY 1 HAVING station % 3 > 0)
SELECT s_suppkey AS station, CASE WHEN s_acctbal < 0 THEN 'in debt' ELSE 'kept' END AS status, years_used, max_annual_max FROM supplier LEFT JOIN q ON station = s_suppkey""")
def status_quality_join(spark, sf_dir):
    """Every station's status with the quality of its series, where one was found."""
    q = maxima.quality(monthly_maxima(spark, sf_dir)).where("station % 3 > 0").select("station", "years_used", F.round("max_annual_max", 4).alias("max_annual_max"))
    status = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("station"), F.when(F.col("s_acctbal") < 0, "in debt").otherwise("kept").alias("status"))
    return selection.status_with_quality(status, q, "station").select("station", "status", "years_used", "max_annual_max")


@query("""SELECT c_custkey AS o_custkey, o_totalprice FROM customer LEFT JOIN (SELECT o_custkey, arg_min(o_totalprice, (o_orderdate, o_orderkey)) AS o_totalprice FROM orders GROUP BY 1) ON o_custkey = c_custkey""")
def first_kept_lookup(spark, sf_dir):
    """Each customer's first order, null where there is none."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"))
    return selection.looked_up(c, table(spark, sf_dir, "orders"), "o_custkey", "o_totalprice", [F.col("o_orderdate"), F.col("o_orderkey")])


@query("""SELECT o_custkey, arg_min(o_orderstatus, (o_orderdate, o_orderkey)) AS o_orderstatus, arg_min(o_orderpriority, (o_orderdate, o_orderkey)) AS o_orderpriority,
count(*) AS rows, round(sum(o_totalprice), 2) AS sum_o_totalprice FROM orders GROUP BY 1""")
def group_first_summary(spark, sf_dir):
    g = selection.group_summary(table(spark, sf_dir, "orders"), "o_custkey", ["o_orderstatus", "o_orderpriority"], [F.col("o_orderdate"), F.col("o_orderkey")], ["o_totalprice"])
    return g.withColumn("sum_o_totalprice", F.round("sum_o_totalprice", 2))


@query("""WITH p AS (SELECT l_suppkey AS a, l_partkey AS b FROM lineitem WHERE l_discount > 0.09 AND l_tax > 0.07) SELECT DISTINCT station FROM (SELECT a AS station FROM p UNION ALL SELECT b FROM p)""")
def bad_stations(spark, sf_dir):
    """All that stand on either side of a marked pair."""
    pairs = table(spark, sf_dir, "lineitem").where("l_discount > 0.09 and l_tax > 0.07")
    return selection.in_pairs(pairs, "l_suppkey", "l_partkey")


@query()
def seeded_sample(spark, sf_dir):
    return selection.sampled(table(spark, sf_dir, "supplier").select("s_suppkey", "s_name"), "s_suppkey", 15)


@query("""WITH e AS (SELECT user_id, CASE WHEN event_id % 7 = 0 THEN 'no time' ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S') END AS w, value FROM events)
SELECT user_id AS station, year(try_strptime(w, '%Y-%m-%dT%H:%M:%S'))::INT AS block, round(max(value), 6) AS ams FROM e WHERE try_strptime(w, '%Y-%m-%dT%H:%M:%S') IS NOT NULL AND value IS NOT NULL AND year(try_strptime(w, '%Y-%m-%dT%H:%M:%S')) > 1900 GROUP BY ALL""")
def parsed_time_maxima(spark, sf_dir):
    """A series at any step with its times as text, some of them bad."""
    e = table(spark, sf_dir, "events")
    when = F.when(F.col("event_id") % 7 == 0, "no time").otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"))
    return rounded(maxima.annual_maxima(e.select("user_id", when.alias("w"), "value"), "user_id", "w", "value"))


_ERR = "e AS (SELECT l_linenumber AS period, 100*(l_discount - l_tax)/l_tax AS err FROM lineitem WHERE l_tax <> 0)"


def _errors(spark, sf_dir):
    e = selection.percent_error(F.col("l_discount"), F.col("l_tax"))
    return table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("period"), e.alias("err")).where("err is not null")


@query(f"WITH {_ERR} SELECT period, round(quantile_cont(abs(err),0.25),6) AS q25, round(quantile_cont(abs(err),0.5),6) AS q50, round(quantile_cont(abs(err),0.75),6) AS q75 FROM e GROUP BY 1")
def error_quantiles(spark, sf_dir):
    return rounded(profile.error_quantiles(_errors(spark, sf_dir), "period", "err"))


@query(f"""WITH {_ERR} SELECT period, round(avg(err),6) AS bias, round(sqrt(avg(err*err)),6) AS rmse, round(quantile_cont(abs(err),0.5),6) AS median_abs,
round(100*avg((abs(err)<=25)::INT),6) AS within_25, round(100*avg((abs(err)<=50)::INT),6) AS within_50 FROM e GROUP BY 1""")
def bias_rmse(spark, sf_dir):
    return rounded(profile.error_summary(_errors(spark, sf_dir), "period", "err"))


@query("""WITH x AS (SELECT min(o_totalprice) lo, max(o_totalprice) hi FROM orders),
h AS (SELECT least(9, floor((o_totalprice-lo)/(hi-lo)*10))::INT AS bin, count(*) AS n FROM orders, x GROUP BY 1)
SELECT i::INT AS bin, coalesce(n, 0) AS n FROM range(10) r(i) LEFT JOIN h ON h.bin = i""")
def histogram_10(spark, sf_dir):
    return profile.histogram(table(spark, sf_dir, "orders"), "o_totalprice")


@query("""SELECT l_suppkey AS key, round(avg((l_tax<=0)::INT),6) AS zero_share, round(avg(CASE WHEN l_tax>0 THEN l_quantity/l_tax END),4) AS max_over_min,
round(avg(CASE WHEN l_discount<>0 THEN l_quantity/l_discount END),4) AS peak_to_mean FROM lineitem GROUP BY 1""")
def zero_fraction(spark, sf_dir):
    r = profile.flow_ratios(table(spark, sf_dir, "lineitem"), "l_suppkey", "l_quantity", "l_discount", "l_tax")
    return rounded(r.withColumns({c: F.round(c, 4) for c in ("max_over_min", "peak_to_mean")}))


@query(f"WITH {ATTRS} SELECT round(avg(price) FILTER (WHERE quantity <= 25.5),4) AS mean_low, round(avg(price) FILTER (WHERE quantity > 25.5),4) AS mean_high FROM att")
def split_means(spark, sf_dir):
    return rounded(profile.split_means(attributes(spark, sf_dir), "quantity", 25.5, "price"), 4)


@query("SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders QUALIFY rank <= 10")
def top10(spark, sf_dir):
    return profile.ranked(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), F.asc("o_orderkey")], 10)


@query(f"WITH {ATTRS} SELECT region, count(*) AS members, count(*) FILTER (WHERE balance > 0) AS contributing, round(median(price),4) AS median_price, round(median(quantity),4) AS median_quantity FROM att GROUP BY 1")
def region_profile(spark, sf_dir):
    a = attributes(spark, sf_dir).withColumn("contributes", F.col("balance") > 0)
    return rounded(profile.region_profile(a, "region", ["price", "quantity"], "contributes"), 4)


@query("SELECT event_type AS value, count(*) AS n FROM events GROUP BY 1")
def value_counts(spark, sf_dir):
    return profile.value_counts(table(spark, sf_dir, "events"), "event_type")


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity<2 THEN '<2' WHEN l_quantity<5 THEN '2-5' WHEN l_quantity<15 THEN '5-15' WHEN l_quantity<30 THEN '15-30' ELSE '>=30' END AS class FROM lineitem")
def slope_classes(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", selection.slope_class(F.col("l_quantity")).alias("class"))


@query("SELECT l_suppkey AS station, CASE WHEN avg(l_tax)*25<1 THEN 'acceptably homogeneous' WHEN avg(l_tax)*25<2 THEN 'possibly heterogeneous' ELSE 'definitely heterogeneous' END AS h_class, CASE WHEN count(*)>=600 THEN '>= 600 station-years' ELSE 'candidates exhausted' END AS tier FROM lineitem GROUP BY 1")
def homogeneity_classes(spark, sf_dir):
    g = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("station")).agg((F.avg("l_tax") * 25).alias("h"), F.count(F.lit(1)).alias("n"))
    return g.select("station", selection.homogeneity_class(F.col("h")).alias("h_class"), selection.acceptance(F.col("n"), 600).alias("tier"))


@query(f"WITH {ATTRS} SELECT station, round(ln(greatest(balance, 1e-6)),6) AS log_balance, round(greatest(-200, least(200, balance)),6) AS clipped FROM att")
def floored_log(spark, sf_dir):
    return rounded(attributes(spark, sf_dir).select("station", selection.floored_log(F.col("balance")).alias("log_balance"), selection.clipped(F.col("balance"), -200, 200).alias("clipped")))


@query(f"WITH {ATTRS} SELECT station, region, round(balance - 1e6, 2) AS deficit, round(log10(quantity),6) AS log10_quantity, round(log10(price),6) AS log10_price FROM att")
def conditional_log10(spark, sf_dir):
    a = attributes(spark, sf_dir).select("station", "region", F.round(F.col("balance") - 1e6, 2).alias("deficit"), "quantity", "price")
    return rounded(selection.logged_if_positive(a, ["deficit", "quantity", "price"]).select("station", "region", "deficit", "log10_quantity", "log10_price"))


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE upper(trim(o_orderstatus)) = 'F')")
def resume_anti_join(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    done = o.select("o_orderkey", F.when(F.col("o_orderstatus") == "F", " success ").otherwise("FAILED").alias("status"))
    return selection.not_done(o.select("o_orderkey"), done, "o_orderkey")
