"""Queries of joins by place and of moving windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.operators import raster as R
from geoloom.operators import spatial as S
from geoloom.operators import window2d as V
from geoloom.operators import zonal as Z

from .registry import query
from .roles import ASSETS, CELLS, CUBE, assets, cells, cube

RINGS = {
    "north": [(0.503, 30.207), (39.411, 30.207), (39.411, 49.713), (20.117, 44.319), (0.503, 49.713)],
    "south": [(2.207, 1.113), (30.309, 3.417), (25.711, 20.903), (5.113, 18.207)],
    "ridge": [(10.117, 10.219), (38.523, 33.707), (37.109, 36.811), (9.203, 13.317)],
    "empty": [(90.5, 90.5), (91.5, 90.5), (91.5, 91.5)],
}


def _ray(px: str, py: str, ring) -> str:
    parts = []
    for (x1, y1), (x2, y2) in zip(ring, [*ring[1:], ring[0]]):
        parts.append(f"CAST((({y1} > {py}) <> ({y2} > {py})) AND {px} < ({x2} - {x1}) * ({py} - {y1}) / nullif({y2} - {y1}, 0) + {x1} AS INT)".replace("--", "- -"))
    return "((" + " + ".join(f"coalesce({p}, 0)" for p in parts) + ") % 2 = 1)"


def _within(px: str, py: str, names=RINGS) -> str:
    return " UNION ALL ".join(f"SELECT *, '{k}' AS name, {i} AS nth FROM pts WHERE {_ray(px, py, RINGS[k])}" for i, k in enumerate(RINGS) if k in names)


@query(f"""WITH {ASSETS}, pts AS (SELECT asset, px, py FROM assets), h AS ({_within('px', 'py')}), j AS (SELECT a.asset, h.name FROM assets a LEFT JOIN h ON a.asset = h.asset)
SELECT name AS status, count(*) AS assets, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS pct FROM j GROUP BY name""")
def points_in_polygons(spark: SparkSession, d: str) -> DataFrame:
    j = S.points_in_polygons(assets(spark, d), "px", "py", S.polygons(spark, RINGS), "left")
    return S.status_exposure(j.withColumnRenamed("name", "status"), "status").withColumn("pct", F.round("pct", 6))


@query(f"""WITH {ASSETS}, pts AS (SELECT asset, px, py, worth FROM assets), h AS ({_within('px', 'py')})
SELECT name AS place, count(*) AS structures, count_if(worth > 7000) AS high, count_if(worth > 3000) AS moderate FROM h GROUP BY name""")
def community_exposure(spark: SparkSession, d: str) -> DataFrame:
    j = S.points_in_polygons(assets(spark, d), "px", "py", S.polygons(spark, RINGS), tile=8.0)
    return j.groupBy(F.col("name").alias("place")).agg(F.count("*").alias("structures"), F.count_if(F.col("worth") > 7000).alias("high"), F.count_if(F.col("worth") > 3000).alias("moderate"))


@query(f"""WITH {CELLS}, pts AS (SELECT cell, CAST(x AS DOUBLE) AS px, CAST(y AS DOUBLE) AS py FROM cells), h AS ({_within('px', 'py')}), b AS (SELECT cell, arg_max(name, nth) AS burned FROM h GROUP BY cell)
SELECT b.burned AS zone, count(*) AS n, round(avg(slope), 6) AS slope FROM cells c LEFT JOIN b ON c.cell = b.cell GROUP BY 1""")
def polygon_zones(spark: SparkSession, d: str) -> DataFrame:
    z = S.burned_zones(cells(spark, d), "x", "y", S.polygons(spark, RINGS))
    return z.groupBy(F.col("burned").alias("zone")).agg(F.count("*").alias("n"), F.round(F.avg("slope"), 6).alias("slope"))


@query(f"""WITH {CELLS}, pts AS (SELECT cell, CAST(x AS DOUBLE) AS px, CAST(y AS DOUBLE) AS py FROM cells), h AS ({_within('px', 'py', ('south', 'ridge'))})
SELECT cell, elevation FROM cells WHERE cell NOT IN (SELECT cell FROM h)""")
def avoidance_mask(spark: SparkSession, d: str) -> DataFrame:
    mask = S.polygons(spark, {k: RINGS[k] for k in ("south", "ridge")})
    return S.avoided(cells(spark, d), "x", "y", mask).select("cell", "elevation")


_SAMPLE = "s AS (SELECT a.*, c.zone, c.slope FROM assets a JOIN cells c ON c.x = least(greatest(CAST(floor(px + 0.5) AS INT), 0), 39) AND c.y = least(greatest(CAST(floor(py + 0.5) AS INT), 0), 49))"


@query(f"WITH {CELLS}, {ASSETS}, {_SAMPLE} SELECT zone, count(*) AS assets, round(sum(worth), 4) AS total FROM s GROUP BY zone")
def nearest_cell_exposure(spark: SparkSession, d: str) -> DataFrame:
    s = S.nearest_cells(assets(spark, d), "px", "py", cells(spark, d), 1.0, (40, 50))
    return S.exposure_by_zone(s, "zone", "worth").withColumn("total", F.round("total", 4))


@query(f"""WITH {CELLS}, {ASSETS}, k AS (SELECT unnest([0.8, 1.5]) AS decay),
n AS (SELECT asset, decay, slope, sqrt(power(px - x, 2) + power(py - y, 2)) AS away FROM assets JOIN cells ON x BETWEEN px - 4.5 AND px + 4.5 AND y BETWEEN py - 4.5 AND py + 4.5, k),
e AS (SELECT asset, decay, sum(slope * exp(-away / decay)) / sum(exp(-away / decay)) AS exposure FROM n WHERE away <= 3 * decay GROUP BY 1, 2)
SELECT a.asset, CAST(k.decay AS DOUBLE) AS decay, round(exposure, 4) AS exposure FROM assets a CROSS JOIN k LEFT JOIN e ON e.asset = a.asset AND e.decay = k.decay""")
def distance_weighted_exposure(spark: SparkSession, d: str) -> DataFrame:
    return S.distance_weighted(assets(spark, d), "asset", "px", "py", cells(spark, d), "slope", (0.8, 1.5)).withColumn("exposure", F.round("exposure", 4))


# The grid as degrees: a hundredth of one a cell from 10 E, 40 N.
_GRID = "g AS (SELECT 10 + x / 100.0 AS x, 40 + y / 100.0 AS y, slope FROM cells), p AS (SELECT asset, 10 + px / 100.0 AS px, 40 + py / 100.0 AS py FROM assets)"


@query(f"""WITH {CELLS}, {ASSETS}, {_GRID}, m AS (SELECT 111 * cos(radians(avg(y))) AS e FROM (SELECT DISTINCT y FROM g)),
n AS (SELECT asset, slope, sqrt(power((px - x) * e, 2) + power((py - y) * 111, 2)) AS away FROM p JOIN g ON x BETWEEN px - 0.1 AND px + 0.1 AND y BETWEEN py - 0.1 AND py + 0.1, m),
e AS (SELECT asset, sum(slope * exp(-away / 2)) / sum(exp(-away / 2)) AS exposure FROM n WHERE away <= 6 GROUP BY 1)
SELECT asset, CAST(2 AS DOUBLE) AS decay, round(exposure, 4) AS exposure FROM p LEFT JOIN e USING (asset)""")
def distance_weighted_km(spark: SparkSession, d: str) -> DataFrame:
    g = cells(spark, d).select((10 + F.col("x") / 100.0).alias("x"), (40 + F.col("y") / 100.0).alias("y"), "slope")
    p = assets(spark, d).select("asset", (10 + F.col("px") / 100.0).alias("px"), (40 + F.col("py") / 100.0).alias("py"))
    return S.distance_weighted(p, "asset", "px", "py", g, "slope", (2.0,), degrees=True).withColumn("exposure", F.round("exposure", 4))


_AREAS = [("trust", 0.0, 0.0, 12.0, 9.0), ("fee", 8.0, 4.0, 21.5, 17.0), ("allotted", 3.0, 14.0, 9.5, 23.0), ("trust", 18.0, 1.0, 23.0, 6.0)]


@query(f"""WITH a AS (SELECT * FROM (VALUES {', '.join(map(str, _AREAS))}) t(status, minx, miny, maxx, maxy)), g AS (SELECT gx, gy FROM (SELECT unnest(range(0, 5)) AS gx), (SELECT unnest(range(0, 5)) AS gy)),
h AS (SELECT gx, gy, count(DISTINCT status) AS n, string_agg(DISTINCT status, '|' ORDER BY status) AS s FROM g JOIN a ON minx < gx * 5 + 5 AND maxx > gx * 5 AND miny < gy * 5 + 5 AND maxy > gy * 5 GROUP BY 1, 2)
SELECT g.gx, g.gy, coalesce(n, 0) AS n_statuses, s AS statuses FROM g LEFT JOIN h USING (gx, gy)""")
def status_complexity(spark: SparkSession, d: str) -> DataFrame:
    return S.status_complexity(spark.createDataFrame(_AREAS, "status string, minx double, miny double, maxx double, maxy double"), 5.0)


@query(f"""WITH {CELLS}, {ASSETS}, p AS (SELECT least(greatest(CAST(floor(px + 0.5) AS INT), 0), 39) AS x, least(greatest(CAST(floor(py + 0.5) AS INT), 0), 49) AS y, count(*) AS n FROM assets GROUP BY 1, 2),
g AS (SELECT c.*, coalesce(n, 0) AS n FROM cells c LEFT JOIN p USING (x, y)),
a AS (SELECT *, sum(n) OVER w AS s, count(n) OVER w AS k FROM g WINDOW w AS (PARTITION BY x ORDER BY y RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING)),
b AS (SELECT *, sum(s) OVER w / sum(k) OVER w AS density FROM a WINDOW w AS (PARTITION BY y ORDER BY x RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING)),
c AS (SELECT CASE WHEN density >= 0.8 AND slope / 50 >= 0.5 THEN 2 WHEN density >= 0.8 THEN 1 ELSE 0 END AS class, slope > 30 AS hot FROM b)
SELECT CAST(class AS INT) AS class, count(*) AS cells, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS pct, round(count_if(hot) / greatest(count(*), 1), 6) AS hot_share FROM c GROUP BY class""")
def point_density_wui(spark: SparkSession, d: str) -> DataFrame:
    g = S.point_density(cells(spark, d), assets(spark, d), "px", "py", 1.0, (40, 50))
    m = V.box_mean(g, "points", 2).withColumn("veg", F.col("slope") / 50)
    k = m.select(R.wui_class("points_mean", "veg", 0.8).alias("class"), (F.col("slope") > 30).alias("hot"))
    by = k.groupBy("class").agg(F.count("*").alias("cells"), F.count_if("hot").alias("hits"))
    out = by.crossJoin(F.broadcast(by.agg(F.sum("cells").alias("all"))))
    return out.select("class", "cells", F.round(100.0 * F.col("cells") / F.col("all"), 6).alias("pct"), F.round(F.col("hits") / F.greatest("cells", F.lit(1)), 6).alias("hot_share"))


def _moments(inner: str, part: str, order: str) -> str:
    return f"SELECT *, {', '.join(f'sum({c}_0) OVER w AS {c}_1, sum({c}_n0) OVER w AS {c}_n1' for c in ('a', 'b', 'ab', 'aa', 'bb'))} FROM {inner} WINDOW w AS (PARTITION BY {part} ORDER BY {order} RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING)"


_STEP0 = ", ".join(f"coalesce({e}, 0) AS {c}_0, CAST(({e}) IS NOT NULL AS INT) AS {c}_n0" for c, e in (("a", "a"), ("b", "b"), ("ab", "a * b"), ("aa", "a * a"), ("bb", "b * b")))
_SWAP = ", ".join(f"{c}_1 AS {c}_0, {c}_n1 AS {c}_n0" for c in ("a", "b", "ab", "aa", "bb"))
_M = {c: f"(CASE WHEN {c}_n1 >= 8 THEN {c}_1 / {c}_n1 END)" for c in ("a", "b", "ab", "aa", "bb")}


@query(f"""WITH {CELLS}, l AS (SELECT cell, y, x, CASE WHEN slope > 2 THEN slope / 50 END AS a, elevation / 1000 AS b FROM cells), z AS (SELECT cell, y, x, {_STEP0} FROM l),
p AS ({_moments('z', 'x', 'y')}), q AS (SELECT cell, y, x, {_SWAP} FROM p), r AS ({_moments('q', 'y', 'x')}),
m AS (SELECT cell, {_M['a']} AS a, {_M['b']} AS b, {_M['ab']} AS ab, {_M['aa']} AS aa, {_M['bb']} AS bb FROM r),
s AS (SELECT cell, ab - a * b AS cov, sqrt(greatest(aa - a * a, 0)) * sqrt(greatest(bb - b * b, 0)) AS sd FROM m)
SELECT cell, round(CASE WHEN sd > 1e-9 THEN cov / sd END, 5) AS r FROM s""")
def moving_window_corr(spark: SparkSession, d: str) -> DataFrame:
    l = cells(spark, d).select("cell", "y", "x", F.when(F.col("slope") > 2, F.col("slope") / 50).alias("a"), (F.col("elevation") / 1000).alias("b"))
    return V.coupling(l, "a", "b", 5).select("cell", F.round("r", 5).alias("r"))


@query(f"""WITH {CELLS}, g AS (SELECT cell, coalesce((lead(elevation) OVER v - lag(elevation) OVER v) / 2, lead(elevation) OVER v - elevation, elevation - lag(elevation) OVER v, 0) AS dy,
  coalesce((lead(elevation) OVER h - lag(elevation) OVER h) / 2, lead(elevation) OVER h - elevation, elevation - lag(elevation) OVER h, 0) AS dx FROM cells WINDOW v AS (PARTITION BY x ORDER BY y), h AS (PARTITION BY y ORDER BY x))
SELECT cell, round(dy, 6) AS dy, round(dx, 6) AS dx, round(degrees(atan(sqrt(dy * dy + dx * dx))), 6) AS slope_deg FROM g""")
def slope_gradient(spark: SparkSession, d: str) -> DataFrame:
    out = V.slope_degrees(cells(spark, d), "elevation")
    return out.select("cell", *(F.round(c, 6).alias(c) for c in ("dy", "dx", "slope_deg")))


@query(f"""WITH {CELLS}, s AS (SELECT max(y) + 1 AS ny, max(x) + 1 AS nx FROM cells)
SELECT CAST(y // 8 AS INT) AS by, CAST(x // 8 AS INT) AS bx, round(avg(elevation), 6) AS elevation, round(avg(slope), 6) AS slope, count(*) AS cells FROM cells, s WHERE y < ny - ny % 8 AND x < nx - nx % 8 GROUP BY 1, 2""")
def coarsen_release(spark: SparkSession, d: str) -> DataFrame:
    out = Z.coarsened(cells(spark, d), 8, "avg", ("elevation", "slope"))
    return out.withColumns({c: F.round(c, 6) for c in ("elevation", "slope")})


_SCENE = f"""{CUBE}, s AS (SELECT cell, max(CASE WHEN year = 1996 THEN nir END) AS pre, max(CASE WHEN year = 2000 THEN nir END) AS post FROM cube GROUP BY cell),
j AS (SELECT s.*, zone, slope FROM s JOIN cells USING (cell) WHERE pre IS NOT NULL AND post IS NOT NULL)"""


def _pairs(spark, d) -> DataFrame:
    s = cube(spark, d).groupBy("cell").agg(*(F.max(F.when(F.col("year") == y, F.col("nir"))).alias(c) for y, c in ((1996, "pre"), (2000, "post"))))
    return s.join(cells(spark, d).select("cell", "zone", "slope"), "cell").where("pre IS NOT NULL AND post IS NOT NULL")


@query(f"""WITH {CELLS}, {_SCENE}, e AS (SELECT avg(CASE WHEN slope > 25 THEN pre END) AS a, avg(CASE WHEN slope > 25 THEN post END) AS b, avg(CASE WHEN NOT slope > 25 THEN pre END) AS c, avg(CASE WHEN NOT slope > 25 THEN post END) AS d, count_if(slope > 25) AS t, count_if(NOT slope > 25) AS k FROM j)
SELECT round(a, 6) AS treated_before, round(b, 6) AS treated_after, round(c, 6) AS control_before, round(d, 6) AS control_after, t AS n_treated, k AS n_control, round((b - a) - (d - c), 6) AS estimate FROM e""")
def did_estimate(spark: SparkSession, d: str) -> DataFrame:
    out = Z.difference_in_differences(_pairs(spark, d), "pre", "post", F.col("slope") > 25)
    return out.withColumns({c: F.round(c, 6) for c in ("treated_before", "treated_after", "control_before", "control_after", "estimate")})


@query(f"""WITH {CELLS}, {_SCENE}, k AS (SELECT avg(post - pre) AS drift FROM j WHERE slope <= 25)
SELECT zone, count(*) AS n_cells, round(avg(post - pre) - any_value(drift), 6) AS estimate FROM j, k WHERE slope > 25 GROUP BY zone HAVING count(*) >= 20""")
def did_by_group(spark: SparkSession, d: str) -> DataFrame:
    return Z.difference_by_group(_pairs(spark, d), "pre", "post", "zone", F.col("slope") <= 25, 20).withColumn("estimate", F.round("estimate", 6))


@query(f"""WITH {CELLS}, {CUBE}, j AS (SELECT year, nir, slope > 25 AS t FROM cube JOIN cells USING (cell)), g AS (SELECT year, avg(CASE WHEN t THEN nir END) - avg(CASE WHEN NOT t THEN nir END) AS gap FROM j WHERE year < 2000 GROUP BY year)
SELECT round(regr_slope(gap, year), 6) AS drift, count(gap) AS years FROM g""")
def parallel_trends(spark: SparkSession, d: str) -> DataFrame:
    j = cube(spark, d).join(cells(spark, d).select("cell", "slope"), "cell")
    return Z.parallel_trends(j, "nir", F.col("slope") > 25, "year", 2000).withColumn("drift", F.round("drift", 6))


@query(f"""WITH {CELLS}, {_SCENE}, c AS (SELECT CAST(slope >= 15 AS INT) + CAST(slope >= 30 AS INT) + CAST(slope >= 45 AS INT) AS class, cell, year, nir FROM cube JOIN cells USING (cell)),
m AS (SELECT DISTINCT class, cell FROM c), p AS (SELECT class, count(*) AS n, avg(cube.nir) AS before FROM m LEFT JOIN cube ON cube.cell = m.cell AND year = 1996 GROUP BY class)
SELECT CAST(class AS INT) AS class, CAST(year AS INT) AS year, any_value(n) AS n, round(avg(nir), 6) AS mean, round(any_value(before), 6) AS before, CASE WHEN any_value(before) > 0.05 THEN round(avg(nir) / any_value(before), 6) END AS ratio
FROM c JOIN p USING (class) WHERE n >= 100 GROUP BY class, year""")
def recovery_by_class(spark: SparkSession, d: str) -> DataFrame:
    c = cube(spark, d)
    k = c.join(cells(spark, d).select("cell", R.severity_class("slope", edges=(15, 30, 45)).alias("class")), "cell").join(c.where("year = 1996").select("cell", F.col("nir").alias("before")), "cell", "left")
    return Z.recovery_by_class(k, "cell", "class", "year", "nir", "before").withColumns({x: F.round(x, 6) for x in ("mean", "before", "ratio")})


_BINS = f"""WITH {CELLS}, k AS (SELECT elevation AS p, CAST(slope >= 15 AS INT) + CAST(slope >= 30 AS INT) + CAST(slope >= 45 AS INT) AS s FROM cells), q AS (SELECT list_distinct(quantile_cont(p, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0])) AS d FROM k), e AS (SELECT list_sort(d) AS e FROM q),
b AS (SELECT CAST(len(list_filter(e[2 : len(e) - 1], lambda v: v <= p)) AS INT) AS bin, e, s FROM k, e), bins AS (SELECT bin, round(any_value(e[bin + 1]), 6) AS predictor_lo, round(any_value(e[bin + 2]), 6) AS predictor_hi, count(*) AS n, round(avg(s), 6) AS mean_severity, round(100.0 * avg(CAST(s = 3 AS INT)), 6) AS pct_high FROM b GROUP BY bin HAVING count(*) >= 50)"""


def _bins(spark: SparkSession, d: str) -> DataFrame:
    k = cells(spark, d).select("elevation", R.severity_class("slope", edges=(15, 30, 45)).alias("sev"))
    return Z.predictor_bins(k, "elevation", "sev").withColumns({x: F.round(x, 6) for x in ("predictor_lo", "predictor_hi", "mean_severity", "pct_high")})


@query(_BINS + " SELECT * FROM bins")
def predictor_bins(spark: SparkSession, d: str) -> DataFrame:
    return _bins(spark, d)


def _rho(a: str, b: str, rows: str) -> str:
    """SQL of the rank correlation of two columns and its p: the finite series of Student's t."""
    r = lambda c: f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0"
    return f""", r AS (SELECT {r(a)} AS ra, {r(b)} AS rb FROM {rows}), c AS (SELECT corr(ra, rb) AS rho, count(*) AS n, CAST(count(*) - 2 AS INT) AS f FROM r),
t AS (SELECT *, atan(abs(rho) * sqrt(f / nullif(1 - rho * rho, 0)) / sqrt(f)) AS a FROM c),
u AS (SELECT *, CASE WHEN f % 2 = 0 THEN sin(a) * list_sum(list_transform(range(0, f // 2), lambda j: exp(lgamma(j + 0.5) - lgamma(j + 1)) / sqrt(pi()) * pow(cos(a), 2 * j)))
  ELSE 2 / pi() * (a + CASE WHEN f > 1 THEN sin(a) * list_sum(list_transform(range(0, (f - 1) // 2), lambda j: exp(lgamma(j + 1) - lgamma(j + 1.5)) * sqrt(pi()) / 2 * pow(cos(a), 2 * j + 1))) ELSE 0 END) END AS inside FROM t)
SELECT CASE WHEN n > 2 THEN round(rho, 6) END AS rho, n, CASE WHEN n > 2 THEN round(greatest(1 - inside, 0), 6) END AS p FROM u"""


@query(_BINS + _rho("predictor_lo", "pct_high", "bins"))
def predictor_correlation(spark: SparkSession, d: str) -> DataFrame:
    return Z.spearman(_bins(spark, d), "predictor_lo", "pct_high").withColumns({"rho": F.round("rho", 6), "p": F.round("p", 6)})


@query(f"WITH {CELLS}, g AS (SELECT round(avg(elevation), 9) AS a, round(avg(slope), 9) AS b FROM cells GROUP BY zone)" + _rho("a", "b", "g"))
def zone_rank_correlation(spark: SparkSession, d: str) -> DataFrame:
    g = cells(spark, d).groupBy("zone").agg(F.round(F.avg("elevation"), 9).alias("a"), F.round(F.avg("slope"), 9).alias("b"))
    return Z.spearman(g, "a", "b").withColumns({"rho": F.round("rho", 6), "p": F.round("p", 6)})


@query("""WITH t AS (SELECT count(*) AS total, count_if(regexp_matches(lower(o_orderpriority), 'missing|undeterm|not specified')) AS u FROM orders)
SELECT o_orderpriority AS cause, count(*) AS n, round(median(o_totalprice), 4) AS median, round(avg(o_totalprice), 4) AS mean, max(o_totalprice) AS largest, count_if(o_totalprice > 200000) AS n_large,
  round(100.0 * count(*) / any_value(total), 6) AS pct, round(100.0 * any_value(u) / any_value(total), 6) AS pct_undetermined FROM orders, t WHERE o_orderpriority IS NOT NULL GROUP BY 1""")
def cause_profile(spark: SparkSession, d: str) -> DataFrame:
    out = Z.cause_profile(spark.read.parquet(f"{d}/orders.parquet"), "o_orderpriority", "o_totalprice", 200_000)
    return out.withColumns({"median": F.round("median", 4), "mean": F.round("mean", 4), "pct": F.round("pct", 6), "pct_undetermined": F.round("pct_undetermined", 6)})
