"""Queries over series in time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.operators import temporal as T
from geoloom.operators import zonal as Z

from .registry import query
from .roles import CUBE, FLOW, MONTHLY, cube, flow, monthly, red_in_order, table


def _round(df: DataFrame, *columns: str, n: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, n) for c in columns})


_WY = "CAST(year({0}) + CAST(month({0}) >= 10 AS INT) AS INT)"


@query(f"""WITH {FLOW} SELECT site, {_WY.format('day')} AS wy, round(sum(value), 6) AS total, round(avg(value), 6) AS mean,
  round(avg(CASE WHEN month(day) IN (6, 7, 8) THEN value END), 6) AS season_mean, count(value) AS n FROM flow GROUP BY 1, 2 HAVING count(value) > 50""")
def water_year_annual(spark: SparkSession, d: str) -> DataFrame:
    return _round(T.annual(flow(spark, d), ["site"], "day", "value", complete=50), "total", "mean", "season_mean")


@query("""WITH s AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS period, sum(o_totalprice) AS total, avg(o_totalprice) AS mean, count(o_totalprice) AS n FROM orders GROUP BY 1),
p AS (SELECT CAST(unnest(generate_series(CAST((SELECT min(period) FROM s) AS TIMESTAMP), CAST((SELECT max(period) FROM s) AS TIMESTAMP), INTERVAL 1 MONTH)) AS DATE) AS period)
SELECT period, round(coalesce(total, 0), 4) AS total, round(mean, 4) AS mean, coalesce(n, 0) AS n FROM p LEFT JOIN s USING (period)""")
def monthly_resample(spark: SparkSession, d: str) -> DataFrame:
    return _round(T.resampled(table(spark, d, "orders"), "o_orderdate", "o_totalprice"), "total", "mean", n=4)


@query(f"""WITH {FLOW}, g AS (SELECT quantile_cont(value, 0.9) AS t FROM flow WHERE year(day) BETWEEN 1996 AND 1998)
SELECT CAST(year(day) AS INT) AS year, count_if(value > t) AS days, round(max(t), 6) AS threshold FROM flow, g GROUP BY 1""")
def threshold_days(spark: SparkSession, d: str) -> DataFrame:
    return _round(T.days_over(flow(spark, d), "day", "value", 0.9, (1996, 1998)), "threshold")


@query(f"""WITH {FLOW}, s AS (SELECT site, {_WY.format('day')} AS wy, day, value FROM flow WHERE value IS NOT NULL),
t AS (SELECT *, CAST(day - make_date(wy - 1, 10, 1) AS INT) AS since FROM s)
SELECT site, wy, count(*) AS n, max(value) AS peak, arg_max(since, value * 1000 - since) AS peak_day, min(CASE WHEN value > 20 THEN since END) AS onset, max(CASE WHEN value > 20 THEN since END) AS "end", count_if(value > 20) AS season_days
FROM t GROUP BY 1, 2 HAVING count(*) >= 60""")
def season_metrics(spark: SparkSession, d: str) -> DataFrame:
    return T.season_metrics(flow(spark, d), "site", "day", "value", above=20, least=60)


@query(f"""WITH {FLOW}, l AS (SELECT site, quantile_cont(value, 0.1) AS lim FROM flow GROUP BY 1),
r AS (SELECT f.site, {_WY.format('day')} AS wy, day, value, lim, avg(value) OVER w AS a, count(value) OVER w AS k FROM flow f JOIN l ON f.site = l.site
  WINDOW w AS (PARTITION BY f.site, {_WY.format('day')} ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)),
q AS (SELECT site, wy, day, value, lim, CASE WHEN k = 7 THEN round(a, 9) END AS a FROM r),
o AS (SELECT site, wy, day, a, row_number() OVER (PARTITION BY site, wy ORDER BY a, day) AS k FROM q WHERE a IS NOT NULL)
SELECT q.site, q.wy, count(*) AS n, round(min(q.a), 6) AS low, min(CASE WHEN o.k = 1 THEN o.day END) AS low_day, count_if(value < lim) AS days_below, round(avg(value), 6) AS mean
FROM q LEFT JOIN o ON q.site = o.site AND q.wy = o.wy AND q.day = o.day GROUP BY 1, 2 HAVING count(*) >= 60""")
def low_flow(spark: SparkSession, d: str) -> DataFrame:
    return _round(T.low_flow(flow(spark, d), "site", "day", "value", least=60), "low", "mean")


@query(f"""WITH {FLOW}, g AS (SELECT site FROM flow GROUP BY site HAVING (max(day) - min(day) + 1) / 365.25 >= 6.5 AND 1 - count(DISTINCT day) / (max(day) - min(day) + 1) <= 0.8)
SELECT site, count(*) AS n, sum(value) AS total FROM flow WHERE site IN (SELECT site FROM g) GROUP BY site""")
def record_length_filter(spark: SparkSession, d: str) -> DataFrame:
    kept = T.long_records(flow(spark, d), "site", "day", 6.5, 0.8)
    return kept.groupBy("site").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


_LON, _LAT = "-106 + user_id % 50 * 0.01", "40 + user_id % 30 * 0.01"


@query(f"""WITH g AS (SELECT CAST(ts AS DATE) AS day, count(*) AS detections, avg({_LON}) AS lon, avg({_LAT}) AS lat, avg(value) AS mean, max(value) AS largest, sum(value) AS total FROM events GROUP BY 1)
SELECT day, detections, round(lon, 6) AS lon, round(lat, 6) AS lat, round(mean, 6) AS mean, largest, round(total, 4) AS total, CAST(sum(detections) OVER w AS BIGINT) AS running, round(sum(total) OVER w, 4) AS running_total,
  round(sqrt(power((lon - lag(lon) OVER (ORDER BY day)) * 111 * cos(radians(lat)), 2) + power((lat - lag(lat) OVER (ORDER BY day)) * 111, 2)), 6) AS shift_km
FROM g WINDOW w AS (ORDER BY day ROWS UNBOUNDED PRECEDING)""")
def progression(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumns({"lon": F.expr(f"CAST({_LON} AS DOUBLE)"), "lat": F.expr(f"CAST({_LAT} AS DOUBLE)")})
    out = T.progression(e, "ts", "value", "lon", "lat")
    return _round(_round(out, "lon", "lat", "mean", "shift_km"), "total", "running_total", n=4)


@query("SELECT CAST(ts AS DATE) AS day, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1 ORDER BY round(sum(value), 4) DESC, day LIMIT 5")
def top_run_days(spark: SparkSession, d: str) -> DataFrame:
    by = table(spark, d, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return by.orderBy(F.desc("total"), "day").limit(5)


@query("""WITH g AS (SELECT CAST(year(o_orderdate) AS INT) AS y, sum(o_totalprice) / 1e6 AS a FROM orders WHERE o_orderstatus = 'F' GROUP BY 1),
r AS (SELECT coalesce(sum(a), 0) AS burned, max(y) - min(y) + 1 AS period, count_if(a > 0) AS active_years FROM g)
SELECT round(burned, 6) AS burned, CAST(period AS INT) AS period, active_years, round(coalesce(period / nullif(burned / 5000, 0), 'Infinity'::DOUBLE), 6) AS rotation, round(100 * burned / 5000, 6) AS pct_burned, round(100 * burned / 5000 / period, 6) AS annual_pct,
  CASE WHEN period / (burned / 5000) / 20 >= 3 THEN 'far longer' WHEN period / (burned / 5000) / 20 >= 1.5 THEN 'longer' WHEN period / (burned / 5000) / 20 >= 0.67 THEN 'similar' ELSE 'shorter' END AS era FROM r""")
def fire_rotation(spark: SparkSession, d: str) -> DataFrame:
    by = table(spark, d, "orders").where("o_orderstatus = 'F'").groupBy(F.year("o_orderdate").alias("y")).agg((F.sum("o_totalprice") / 1e6).alias("a"))
    out = T.rotation(by, "y", "a", 5000.0).withColumn("era", T.era_comparison(F.col("rotation"), F.lit(20.0)))
    return _round(out, "burned", "rotation", "pct_burned", "annual_pct")


@query("""WITH g AS (SELECT CAST(year(o_orderdate) AS INT) AS year, sum(o_totalprice) AS a FROM orders GROUP BY 1)
SELECT CAST(y AS INT) AS year, round(coalesce(a, 0), 4) AS total FROM range(1990, 2005) t(y) LEFT JOIN g ON g.year = y""")
def burned_by_year(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").withColumn("y", F.year("o_orderdate"))
    return _round(T.by_year(o, "y", "o_totalprice", (1990, 2004)), "total", n=4)


@query("SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS n FROM orders WHERE o_orderdate >= DATE '1996-01-01' AND o_orderdate < DATE '1997-07-01' GROUP BY 1")
def partial_date_slice(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").withColumn("day", F.to_date("o_orderdate"))
    return T.labelled(o, "day", "1996", "1997-06").groupBy("day").agg(F.count("*").alias("n"))


@query("SELECT c_custkey AS id, c_acctbal AS balance FROM customer ORDER BY abs(c_acctbal) DESC, c_custkey LIMIT 20")
def largest_by_size(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"))
    return c.orderBy(F.desc(F.abs("balance")), "id").limit(20)


@query("""SELECT CAST(month(o_orderdate) AS INT) AS month, CAST(day(o_orderdate) AS INT) AS day_of_month, round(avg(o_totalprice), 4) AS mean, round(stddev_samp(o_totalprice), 4) AS sd FROM orders GROUP BY 1, 2""")
def doy_climatology(spark: SparkSession, d: str) -> DataFrame:
    return _round(T.climatology(table(spark, d, "orders"), "o_orderdate", "o_totalprice"), "mean", "sd", n=4)


@query("""WITH u AS (SELECT o_orderkey AS id, o_orderpriority AS k, o_totalprice AS v, CAST(year(o_orderdate) < 1998 AS INT) AS f FROM orders),
w AS (SELECT id, f, sum(f) OVER (PARTITION BY k ORDER BY v) - sum(f) OVER (PARTITION BY k, v) AS below, sum(f) OVER (PARTITION BY k) AS n FROM u)
SELECT id, round(100.0 * below / nullif(n, 0), 6) AS percentile FROM w WHERE f = 0""")
def percentile_of_score(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("k"), F.col("o_totalprice").alias("v"), F.year("o_orderdate").alias("y"))
    out = T.percentile_of_score(o.where("y < 1998").select("k", "v"), o.where("y >= 1998").select("id", "k", "v"), "v", ["k"])
    return _round(out.select("id", "percentile"), "percentile")


@query("""WITH g AS (SELECT l_returnflag, avg(CASE WHEN year(l_shipdate) <= 1997 THEN l_extendedprice END) AS p, avg(CASE WHEN year(l_shipdate) >= 1999 THEN l_extendedprice END) AS f FROM lineitem GROUP BY 1), c AS (SELECT f - p AS c FROM g WHERE f - p IS NOT NULL)
SELECT round(avg(c), 4) AS mean, round(median(c), 4) AS median, round(min(c), 4) AS least, round(max(c), 4) AS most, round(stddev_pop(c), 4) AS spread, count(*) AS models, bool_and(c > 0) OR bool_and(c < 0) AS agree FROM c""")
def ensemble_delta(spark: SparkSession, d: str) -> DataFrame:
    y = F.year("l_shipdate")
    return _round(T.ensemble_delta(table(spark, d, "lineitem"), "l_returnflag", "l_extendedprice", y <= 1997, y >= 1999), "mean", "median", "least", "most", "spread", n=4)


_STEP = "CAST((year(month) - 1995) * 12 + month(month) AS INT)"


@query(f"""WITH {MONTHLY}, s AS (SELECT region, {_STEP} AS t, value FROM monthly), b AS (SELECT region, avg(value) AS mu, stddev_samp(value) AS sd, count(value) AS n FROM s WHERE t <= 30 GROUP BY 1),
o AS (SELECT s.region, t, coalesce(abs(value - mu) > 0.5 * sd AND n >= 10 AND sd > 0, false) AS out FROM s JOIN b USING (region)),
i AS (SELECT *, row_number() OVER (PARTITION BY region ORDER BY t) - row_number() OVER (PARTITION BY region, out ORDER BY t) AS g FROM o),
k AS (SELECT region, g, count(*) AS n, list_sort(list(t)) AS ts FROM i WHERE out GROUP BY 1, 2 HAVING count(*) >= 3)
SELECT r.region, CAST(min(ts[3]) - 2 AS INT) AS emerged FROM (SELECT DISTINCT region FROM s) r LEFT JOIN k USING (region) GROUP BY 1""")
def emergence(spark: SparkSession, d: str) -> DataFrame:
    s = monthly(spark, d).withColumn("t", F.expr(_STEP))
    return T.emergence(s, ["region"], "t", "value", (0, 30), 0.5, 3)


@query("""WITH w AS (SELECT unnest([DATE '1996-02-29', DATE '1998-07-15', DATE '2001-01-01']) AS wanted),
p AS (SELECT o_custkey AS customer, wanted, CAST(o_orderdate AS DATE) AS day, o_orderkey AS id, abs(CAST(o_orderdate AS DATE) - wanted) AS away FROM orders, w)
SELECT customer, wanted, day, id FROM p QUALIFY row_number() OVER (PARTITION BY customer, wanted ORDER BY away, day, id) = 1""")
def nearest_date(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("customer"), F.to_date("o_orderdate").alias("day"), F.col("o_orderkey").alias("id"))
    o = o.groupBy("customer", "day").agg(F.min("id").alias("id"))
    dates = spark.createDataFrame([("1996-02-29",), ("1998-07-15",), ("2001-01-01",)], "wanted string").select(F.to_date("wanted").alias("wanted"))
    return T.nearest_in_time(o, ["customer"], "day", dates)


@query(f"""WITH {MONTHLY}, r AS (SELECT *, sum(value) OVER w AS s, count(value) OVER w AS k FROM monthly WINDOW w AS (PARTITION BY region ORDER BY month ROWS BETWEEN 2 PRECEDING AND CURRENT ROW))
SELECT region, month, round(CASE WHEN k = 3 THEN s END, 4) AS rolled FROM r""")
def rolling_sum(spark: SparkSession, d: str) -> DataFrame:
    return _round(T.rolling(monthly(spark, d), ["region"], "month", "value", 3).select("region", "month", "rolled"), "rolled", n=4)


@query(f"""WITH {CUBE} SELECT cell, round(CAST(count_if(red < 5) AS DOUBLE) / nullif(count(red), 0), 6) AS frequency FROM cube GROUP BY cell""")
def bare_frequency(spark: SparkSession, d: str) -> DataFrame:
    return _round(Z.bare_frequency(red_in_order(spark, d), "cell", "red", 5), "frequency")


@query(f"""WITH {CUBE} SELECT cell, round(median(nir), 9) AS median, round(regr_slope(nir, epoch(make_date(year, 1, 1)) / 31557600.0), 5) AS slope, count(*) AS n FROM cube GROUP BY cell""")
def time_median_trend(spark: SparkSession, d: str) -> DataFrame:
    when = F.to_timestamp(F.make_date("year", F.lit(1), F.lit(1)))
    out = cube(spark, d).withColumn("ts", when).groupBy("cell").agg(F.round(F.median("nir"), 9).alias("median"), F.round(T.trend_slope("nir", F.col("ts")), 5).alias("slope"), F.count("*").alias("n"))
    return out


@query(f"""WITH {FLOW}, i AS (SELECT site, day, value > 40 AS f, row_number() OVER (PARTITION BY site ORDER BY day) - row_number() OVER (PARTITION BY site, value > 40 ORDER BY day) AS g FROM flow)
SELECT site, min(day) AS start, max(day) AS "end", count(*) AS n FROM i WHERE f GROUP BY site, g HAVING count(*) >= 3""")
def persistence_runs(spark: SparkSession, d: str) -> DataFrame:
    return T.islands(flow(spark, d), ["site"], "day", F.col("value") > 40).where("n >= 3")
