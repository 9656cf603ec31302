"""Queries of the cell algebra."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.functions.columns import classed, clip
from geoloom.operators import raster as R
from geoloom.operators import zonal as Z

from .registry import query
from .roles import CELLS, CUBE, cells, clip as C, cube, norm as N


def _scenes(spark, d, pre=1996, post=2000) -> DataFrame:
    """Burn ratios of two years side by side, by one conditional aggregate."""
    rows = cube(spark, d).where(F.col("year").isin(pre, post)).withColumn("nbr", R.nbr())
    out = rows.groupBy("cell").agg(*(F.max(F.when(F.col("year") == y, F.col("nbr"))).alias(c) for y, c in ((pre, "pre"), (post, "post"))))
    return out.where("pre IS NOT NULL AND post IS NOT NULL")


_SCENES = f"""{CUBE}, nbrs AS (SELECT cell, year, (nir - swir) / (nir + swir + 1e-9) AS nbr FROM cube WHERE year IN (1996, 2000)),
scenes AS (SELECT a.cell, a.nbr AS pre, b.nbr AS post FROM nbrs a JOIN nbrs b ON a.cell = b.cell AND a.year = 1996 AND b.year = 2000)"""


def _r(**columns):
    return [F.round(v, 6).alias(k) if hasattr(v, "alias") else F.round(F.col(v), 6).alias(k) for k, v in columns.items()]


@query(f"""WITH {CELLS}, g AS (SELECT quantile_cont(slope, 0.02) AS a, quantile_cont(slope, 0.98) AS b, quantile_cont(elevation, 0.02) AS c, quantile_cont(elevation, 0.98) AS d FROM cells),
n AS (SELECT zone, {C(N('slope', 'a', 'b') + ' * ' + N('elevation', 'c', 'd'))} AS risk FROM cells, g), t AS (SELECT count(*) AS total FROM n)
SELECT zone, count(*) AS n_cells, round(avg(risk), 6) AS mean_risk, round(max(risk), 6) AS max_risk, round(100.0 * count_if(risk > 0.5) / count(*), 6) AS pct_of_zone,
  round(100.0 * count_if(risk > 0.5) / any_value(total), 6) AS pct_of_grid FROM n, t GROUP BY zone HAVING count(*) >= 5""")
def zonal_risk_ranking(spark: SparkSession, d: str) -> DataFrame:
    """Zones by mean delivery risk; the order is the result's, ties by zone."""
    n = R.normalized(cells(spark, d), {"slope": False, "elevation": False}).withColumn("risk", R.delivery_risk("slope_n", "elevation_n"))
    out = Z.zonal(n, "zone", "risk", 0.5, least=5)
    return out.select("zone", "n_cells", *_r(mean_risk="mean", max_risk="max", pct_of_zone="pct_of_zone", pct_of_grid="pct_of_grid")).orderBy(F.desc("mean_risk"), "zone")


@query(f"""WITH {CUBE} SELECT cell, year, round((nir - red) / (nir + red + 1e-9), 6) AS ndvi, round((nir - swir) / (nir + swir + 1e-9), 6) AS nbr,
  round((nir - swir) / nullif(nir + swir, 0), 6) AS nbr_plain, round((nir - red) / nullif(nir + red, 0), 6) AS ndmi,
  round((nir - red) / (nir + red + 1e-9) * (1 - 0.5 * least(swir / 8, 1)), 6) AS fuel FROM cube""")
def spectral_indices(spark: SparkSession, d: str) -> DataFrame:
    rows = cube(spark, d).withColumn("v", R.ndvi()).withColumn("drought", clip(F.col("swir") / 8))
    return rows.select("cell", "year", *_r(ndvi="v", nbr=R.nbr(), nbr_plain=R.nbr(epsilon=0), ndmi=R.ndmi("nir", "red"), fuel=R.fuel_proxy("v", "drought")))


@query(f"""WITH {_SCENES}, o AS (SELECT median((pre - post) * 1000) AS o FROM scenes WHERE pre > 0.88)
SELECT cell, round(pre - post, 6) AS dnbr_plain, round((pre - post) * 1000 - o, 5) AS dnbr, round(((pre - post) * 1000 - o) / sqrt(greatest(abs(pre), 0.001)), 5) AS rdnbr FROM scenes, o""")
def change_index(spark: SparkSession, d: str) -> DataFrame:
    s = _scenes(spark, d)
    offset = R.dnbr_offset(s.withColumn("raw", R.dnbr("pre", "post")), "raw", F.col("pre") > 0.88)
    s = s.crossJoin(F.broadcast(offset))
    return s.select("cell", F.round(R.dnbr("pre", "post", scale=1.0), 6).alias("dnbr_plain"), F.round(R.dnbr("pre", "post", F.col("offset")), 5).alias("dnbr"), F.round(R.rdnbr("pre", "post", F.col("offset")), 5).alias("rdnbr"))


def _classes(e: str, edges) -> str:
    return " + ".join(f"CAST({e} >= {x} AS INT)" for x in edges)


@query(f"""WITH {_SCENES}, k AS (SELECT {_classes('(pre - post) * 2000', R.SEVERITY_EDGES['dnbr'])} AS c FROM scenes), t AS (SELECT count(c) AS total FROM k)
SELECT c.c AS class, count(k.c) AS cells, round(count(k.c) * 0.09, 1) AS hectares, round(count(k.c) * 0.09 * 2.471, 1) AS acres, round(100.0 * count(k.c) / any_value(total), 1) AS pct
FROM (SELECT unnest([0, 1, 2, 3]) AS c) c CROSS JOIN t LEFT JOIN k ON k.c = c.c GROUP BY c.c""")
def severity_classes(spark: SparkSession, d: str) -> DataFrame:
    k = _scenes(spark, d).select(R.severity_class((F.col("pre") - F.col("post")) * 2000).alias("class"))
    return Z.severity_summary(k, "class")


@query(f"WITH {_SCENES} SELECT cell, CAST({_classes('pre - post', R.BURN_EDGES)} AS INT) AS burn_class FROM scenes")
def burn_classes(spark: SparkSession, d: str) -> DataFrame:
    return _scenes(spark, d).select("cell", R.burn_class(F.col("pre") - F.col("post")).alias("burn_class"))


_FUEL = " ".join(f"WHEN 90 + p_size * 3 IN ({', '.join(map(str, codes))}) THEN {v}" for v, codes in R.FUEL_GROUPS.items())


@query(f"SELECT p_partkey AS cell, CASE {_FUEL} END AS hazard FROM part")
def code_lookup_score(spark: SparkSession, d: str) -> DataFrame:
    return cells(spark, d).select("cell", R.fuel_hazard((90 + F.col("slope") * 3).cast("int")).alias("hazard"))


@query(f"WITH {CELLS} SELECT cell, round(cbrt({C('slope * 2 / 100')} * {C('1 - (elevation / 100 - 2) / 6')} * {C('(cell % 20) / 100.0 / 0.15')}), 6) AS potential FROM cells")
def canopy_geometric_mean(spark: SparkSession, d: str) -> DataFrame:
    c = cells(spark, d).select("cell", (F.col("slope") * 2).alias("cc"), (F.col("elevation") / 100).alias("cbh"), (F.col("cell") % 20 / 100).alias("cbd"))
    return c.select("cell", F.round(R.crown_fire_potential(), 6).alias("potential"))


@query(f"""WITH {CELLS}, g AS (SELECT min(slope) a, max(slope) - min(slope) + 1e-9 b, min(elevation) c, max(elevation) - min(elevation) + 1e-9 d FROM cells),
m AS (SELECT cell, (slope - a) / b AS s, (elevation - c) / d AS e, (cell % 10) / 10.0 AS burn FROM cells, g),
x AS (SELECT cell, burn, {C('0.4 * s + 0.4 * burn + 0.2 * e')} AS ero, {C('0.4 * (1 - e) + 0.3 * burn + 0.3 * s')} AS soil FROM m)
SELECT cell, round(ero, 6) AS erosion, round(soil, 6) AS soil, round(1 - {C('(0.5 * ero + 0.5 * soil) * (1 - 0.3 * burn)')}, 6) AS resilience, round({C('soil + 0.5 * burn')}, 6) AS post_fire FROM x""")
def minmax_composites(spark: SparkSession, d: str) -> DataFrame:
    m = R.minmax(cells(spark, d).withColumn("burn", F.col("cell") % 10 / 10), ["slope", "elevation"])
    x = m.withColumns({"ero": R.erosion_susceptibility("slope_m", "burn", "elevation_m"), "sv": R.soil_vulnerability("elevation_m", "burn", "slope_m")})
    return x.select("cell", *_r(erosion="ero", soil="sv", resilience=R.resilience_index("ero", "sv", "burn"), post_fire=R.post_fire_vulnerability("sv", "burn")))


@query(f"""WITH {CELLS}, l AS (SELECT cell, slope, elevation, CASE WHEN cell % 7 <> 0 THEN (cell % 10) / 10.0 END AS veg FROM cells),
g AS (SELECT quantile_cont(slope, 0.02) a, quantile_cont(slope, 0.98) b, quantile_cont(elevation, 0.02) c, quantile_cont(elevation, 0.98) d FROM l),
n AS (SELECT cell, veg, {N('slope', 'a', 'b')} AS s, {N('slope', 'a', 'b', True)} AS si, {N('elevation', 'c', 'd', True)} AS ei, {N('elevation', 'c', 'd')} AS e FROM l, g)
SELECT cell, round((e + si + ei) / 3, 6) AS degradation,
  round({C('0.05 + 0.95 * (CASE WHEN veg IS NULL THEN s ELSE (s + veg) / 2 END)', 0.05)}, 6) AS transfer,
  round({C('(coalesce(veg * 0.4, 0) + e * 0.2 + s * 0.4) / (CASE WHEN veg IS NULL THEN 0.6 ELSE 1.0 END)')}, 6) AS function_index,
  round(0.3 * e + 0.3 * ei + 0.25 * s + 0.15 * s, 6) AS prefire FROM n""")
def percentile_composites(spark: SparkSession, d: str) -> DataFrame:
    rows = cells(spark, d).withColumn("veg", F.when(F.col("cell") % 7 != 0, F.col("cell") % 10 / 10))
    n = R.normalized(rows, {"slope": False, "elevation": False}).withColumns({"si": 1 - F.col("slope_n"), "ei": 1 - F.col("elevation_n")})
    return n.select("cell", *_r(degradation=R.degradation("elevation_n", "si", "ei"), transfer=R.transfer_weight(["slope_n", "veg"]), function_index=R.landscape_function({"veg": 0.4, "elevation_n": 0.2, "slope_n": 0.4}), prefire=R.prefire_condition("elevation_n", "ei", "slope_n", "slope_n")))


@query(f"""WITH {CUBE}, b AS (SELECT cell, nir AS pre FROM cube WHERE year = 1996), r AS (SELECT c.cell, c.year, {C('CASE WHEN pre > 20 THEN c.nir / pre END', 0, 1.5)} AS r, red / 10 AS v, swir / 8 AS burn FROM cube c JOIN b USING (cell))
SELECT cell, year, round(r, 6) AS ratio, round({C('v + 0.5 * burn * (1 - ' + C('r') + ')')}, 6) AS vulnerability FROM r""")
def recovery_ratio(spark: SparkSession, d: str) -> DataFrame:
    c = cube(spark, d)
    r = c.join(c.where("year = 1996").select("cell", F.col("nir").alias("pre")), "cell").withColumns({"r": R.recovery_ratio("nir", "pre", 20), "v": F.col("red") / 10, "burn": F.col("swir") / 8})
    return r.select("cell", "year", *_r(ratio="r", vulnerability=R.post_fire_vulnerability("v", "burn", "r")))


@query(f"""WITH {CELLS}, k AS (SELECT CAST({_classes('elevation', (950, 1000, 1050))} AS INT) * 10 + CAST({_classes('slope', (10, 25))} AS INT) AS stratum, cell, slope, elevation, kind = 'PROMO' AS treated FROM cells),
kept AS (SELECT * FROM k WHERE treated OR stratum IN (SELECT stratum FROM k WHERE treated))
SELECT m.name AS layer, round(avg(CASE WHEN treated THEN m.v END), 6) AS treated_mean, round(avg(CASE WHEN NOT treated THEN m.v END), 6) AS control_mean
FROM (SELECT 'slope' AS name, slope AS v, treated FROM kept UNION ALL SELECT 'elevation', elevation, treated FROM kept) m GROUP BY m.name""")
def matched_controls(spark: SparkSession, d: str) -> DataFrame:
    k = cells(spark, d).withColumns({"stratum": R.stratum(classed("elevation", (950, 1000, 1050)), classed("slope", (10, 25))), "treated": F.col("kind") == "PROMO"})
    kept = Z.matched(k, "stratum", "treated")
    out = Z.balance(kept, "treated", ["slope", "elevation"])
    return out.select("layer", *_r(treated_mean="treated_mean", control_mean="control_mean"))
