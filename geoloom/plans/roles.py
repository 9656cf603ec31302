"""The tables in the roles that operators expect, in Spark and in SQL.

cells: `part` as a grid of 40 columns; cube: `lineitem` as yearly scenes of the
cells; flow: `lineitem` as daily series of sites; monthly: `orders` as monthly
series of regions; assets: `customer` as points."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from geoloom.functions.sizes import small

WIDTH = 40


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr(
        "p_partkey AS cell", f"CAST(p_partkey DIV {WIDTH} AS INT) AS y", f"CAST(p_partkey % {WIDTH} AS INT) AS x",
        "p_retailprice AS elevation", "CAST(p_size AS DOUBLE) AS slope", "p_brand AS zone", "p_type AS kind",
    )


def cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("cell"), F.year("l_shipdate").alias("year"))
    return rows.agg((F.avg("l_extendedprice") / 1000).alias("nir"), (F.avg("l_discount") * 100).alias("red"), (F.avg("l_tax") * 100).alias("swir"))


def red_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(cell, year, red) of `cube`, each sum in the order of the file's rows. A
    mean that meets a threshold but for its last digit is then below it or not
    whatever partitions the rows fall into."""
    t = table(spark, sf_dir, "lineitem")
    at = F.col("_metadata.row_index") if len(t.inputFiles()) == 1 else F.struct("_metadata.file_path", "_metadata.row_index")
    rows = t.select(F.col("l_partkey").alias("cell"), F.year("l_shipdate").alias("year"), "l_discount", at.alias("at")).repartition("cell")
    upto = F.avg("l_discount").over(Window.partitionBy("cell", "year").orderBy("at").rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("upto", upto).groupBy("cell", "year").agg((F.max_by("upto", "at") * 100).alias("red"))


def flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("site"), F.to_date("l_shipdate").alias("day"))
    return rows.agg(F.sum("l_quantity").alias("value"))


def monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(region, month, value): the mean order total."""
    where = table(spark, sf_dir, "customer").join(small(table(spark, sf_dir, "nation")), F.expr("c_nationkey = n_nationkey"))
    rows = table(spark, sf_dir, "orders").join(where.select("c_custkey", "n_regionkey"), F.expr("o_custkey = c_custkey"))
    return rows.groupBy(F.col("n_regionkey").alias("region"), F.to_date(F.trunc("o_orderdate", "MM")).alias("month")).agg(F.round(F.avg("o_totalprice"), 4).alias("value"))


def assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").selectExpr(
        "c_custkey AS asset", "(c_custkey * 7 % 4000) / 100.0D AS px", "(c_custkey * 13 % 5000) / 100.0D AS py", "c_acctbal AS worth", "c_mktsegment AS segment"
    )


CELLS = f"""cells AS (SELECT p_partkey AS cell, CAST(p_partkey // {WIDTH} AS INT) AS y, CAST(p_partkey % {WIDTH} AS INT) AS x,
  p_retailprice AS elevation, CAST(p_size AS DOUBLE) AS slope, p_brand AS zone, p_type AS kind FROM part)"""
CUBE = """cube AS (SELECT l_partkey AS cell, year(l_shipdate) AS year, avg(l_extendedprice) / 1000 AS nir,
  avg(l_discount) * 100 AS red, avg(l_tax) * 100 AS swir FROM lineitem GROUP BY 1, 2)"""
FLOW = "flow AS (SELECT l_suppkey AS site, CAST(l_shipdate AS DATE) AS day, sum(l_quantity) AS value FROM lineitem GROUP BY 1, 2)"
MONTHLY = """monthly AS (SELECT n_regionkey AS region, CAST(date_trunc('month', o_orderdate) AS DATE) AS month, round(avg(o_totalprice), 4) AS value
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2)"""
ASSETS = """assets AS (SELECT c_custkey AS asset, (c_custkey * 7 % 4000) / 100.0 AS px, (c_custkey * 13 % 5000) / 100.0 AS py,
  c_acctbal AS worth, c_mktsegment AS segment FROM customer)"""


def clip(e: str, lo: float = 0, hi: float = 1) -> str:
    """SQL of a clipped value, NULL for NULL."""
    return f"(CASE WHEN ({e}) IS NOT NULL THEN least(greatest({e}, {lo}), {hi}) END)"


def norm(e: str, lo: str, hi: str, invert: bool = False) -> str:
    """SQL of a value between two bounds as 0 to 1; 0 where they coincide."""
    out = f"(CASE WHEN ({e}) IS NULL THEN NULL WHEN {hi} - {lo} < 1e-12 THEN 0 ELSE least(greatest((({e}) - {lo}) / nullif({hi} - {lo}, 0), 0), 1) END)"
    return f"(1 - {out})" if invert else out
