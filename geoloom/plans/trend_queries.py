"""Queries of trends, drought and recovery."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.operators import raster as R
from geoloom.operators import trends as T

from .registry import query
from .roles import CUBE, FLOW, MONTHLY, cells, cube, flow, monthly

_T = "CAST((year(month) - 1995) * 12 + month(month) AS INT)"
_S = f"{MONTHLY}, s AS (SELECT region, {_T} AS t, value AS v FROM monthly), p AS (SELECT a.region, b.t - a.t AS dt, b.v - a.v AS dv FROM s a JOIN s b ON a.region = b.region AND b.t > a.t)"


def _series(spark, d) -> DataFrame:
    return monthly(spark, d).select("region", F.expr(_T).alias("t"), "value", "month")


@query(f"""WITH {_S}, m AS (SELECT region, median(dv / dt) AS m FROM p GROUP BY 1), b AS (SELECT region, count(*) AS n, median(v) AS mv, median(t) AS mt FROM s GROUP BY 1)
SELECT region, n, round(m * 120, 4) AS slope, round(mv - m * mt, 4) AS intercept FROM b JOIN m USING (region) WHERE n >= 10""")
def theil_sen_slope(spark: SparkSession, d: str) -> DataFrame:
    out = T.theil_sen(_series(spark, d), ["region"], "t", "value", 120.0)
    return out.withColumns({c: F.round(c, 4) for c in ("slope", "intercept")})


@query(f"""WITH {_S}, q AS (SELECT region, sum(sign(dv)) AS s FROM p GROUP BY 1), c AS (SELECT region, count(*) AS c FROM s GROUP BY region, v), t AS (SELECT region, sum(c) AS n, sum(c * (c - 1) * (2 * c + 5)) AS ties FROM c GROUP BY 1),
v AS (SELECT region, n, CAST(s AS DOUBLE) AS s, (n * (n - 1) * (2 * n + 5) - ties) / 18.0 AS var FROM t JOIN q USING (region))
SELECT region, CAST(n AS BIGINT) AS n, s, round(s / (n * (n - 1) / 2), 9) AS tau, round(var, 6) AS variance, round((s - sign(s)) / sqrt(var), 6) AS z FROM v WHERE n >= 10""")
def mk_statistic(spark: SparkSession, d: str) -> DataFrame:
    out = T.mann_kendall(_series(spark, d), ["region"], "t", "value")
    return out.withColumns({"tau": F.round("tau", 9), "variance": F.round("variance", 6), "z": F.round("z", 6)})


@query()
def trend_table(spark: SparkSession, d: str) -> DataFrame:
    """Slopes with intervals and corrected p, and false-discovery values over the regions."""
    return T.fdr(T.trend_table(_series(spark, d), ["region"], "t", "value", 120.0), "p_corrected")


@query()
def trend_map(spark: SparkSession, d: str) -> DataFrame:
    """A trend for each site's daily series, by position."""
    from pyspark.sql.window import Window

    f = flow(spark, d).groupBy("site", F.trunc("day", "MM").alias("m")).agg(F.avg("value").alias("value"))
    return T.trend_table(f.withColumn("i", F.row_number().over(Window.partitionBy("site").orderBy("m"))), ["site"], "i", "value")


@query("""WITH t AS (SELECT c_custkey AS id, (abs(c_acctbal) % 1000) / 1000 AS p, c_mktsegment AS k FROM customer), r AS (SELECT *, p * count(*) OVER (PARTITION BY k) / row_number() OVER (PARTITION BY k ORDER BY p, id) AS raw FROM t)
SELECT id, round(least(min(raw) OVER (PARTITION BY k ORDER BY p, id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 1), 6) AS q FROM r""")
def fdr_qvalues(spark: SparkSession, d: str) -> DataFrame:
    t = spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("id"), (F.abs("c_acctbal") % 1000 / 1000).alias("p"), F.col("c_mktsegment").alias("k"))
    return T.fdr(t, "p", ["k"]).select("id", F.round("q", 6).alias("q"))


@query()
def spi(spark: SparkSession, d: str) -> DataFrame:
    return T.spi(_flow_months(spark, d), ["site"], "month", "value", 1)


@query()
def spei(spark: SparkSession, d: str) -> DataFrame:
    return T.spei(_flow_months(spark, d), ["site"], "month", "value", "demand", 1)


def _flow_months(spark, d) -> DataFrame:
    """Weeks of the flow by site as a stand-in for a long monthly record: month
    labels are counted on from 1981, so that calendar months repeat often enough."""
    days = F.floor(F.datediff("day", F.lit("1995-01-01")) / 7).cast("int")
    f = flow(spark, d).groupBy("site", days.alias("k")).agg(F.sum("value").alias("value"), F.avg("value").alias("demand"))
    return f.select("site", F.add_months(F.lit("1981-01-01"), F.col("k")).alias("month"), "value", "demand")


@query()
def recovery_fit(spark: SparkSession, d: str) -> DataFrame:
    k = cube(spark, d).join(cells(spark, d).select("cell", R.severity_class("slope", edges=(15, 30, 45)).alias("class")), "cell")
    return T.recovery_fit(k.groupBy("class", "year").agg(F.avg("nir").alias("value")), ["class"], "year", "value")


_SLOPES = "SELECT n_regionkey AS region, regr_slope({v}, {t}) AS s FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1"


@query("WITH a AS (" + _SLOPES.format(v="o_totalprice", t="CAST(CAST(o_orderdate AS DATE) - DATE '1990-01-01' AS DOUBLE)") + "), b AS (" + _SLOPES.format(v="CAST(c_acctbal AS DOUBLE)", t="o_totalprice") + """)
SELECT region, round(a.s, 6) AS price, round(b.s, 6) AS balance FROM a FULL JOIN b USING (region)""")
def hazard_table(spark: SparkSession, d: str) -> DataFrame:
    """One row a region from several trend tables."""
    from geoloom.operators import composite as C

    t = lambda n: spark.read.parquet(f"{d}/{n}.parquet")
    o = t("orders").join(t("customer"), F.expr("o_custkey = c_custkey")).join(t("nation"), F.expr("c_nationkey = n_nationkey"))
    day = F.datediff("o_orderdate", F.lit("1990-01-01")).cast("double")
    slopes = {n: o.groupBy(F.col("n_regionkey").alias("region")).agg(F.regr_slope(v, x).alias("slope")) for n, v, x in (("price", F.col("o_totalprice"), day), ("balance", F.col("c_acctbal").cast("double"), F.col("o_totalprice")))}
    return C.hazards("region", slopes).withColumns({c: F.round(c, 6) for c in slopes})
