"""Queries of flow over the grid."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.functions.sizes import shuffled
from geoloom.operators import hydro as H

from .registry import query
from .roles import CELLS, cells

_D8 = f"""{CELLS}, off AS (SELECT * FROM (VALUES {', '.join(f'({k}, {a}, {b}, {H.DISTANCE[k]!r})' for k, (a, b) in enumerate(H.OFFSETS))}) t(k, dy, dx, dist)),
drops AS (SELECT c.cell, o.k, o.dist, n.cell AS nxt, (c.elevation - n.elevation) / o.dist AS drop_ FROM cells c CROSS JOIN off o JOIN cells n ON n.y = c.y + o.dy AND n.x = c.x + o.dx),
best AS (SELECT cell, k, dist, nxt FROM drops WHERE drop_ > 0 QUALIFY row_number() OVER (PARTITION BY cell ORDER BY drop_ DESC, k) = 1),
edges AS (SELECT c.cell, c.slope, c.elevation, b.k, b.nxt, b.dist FROM cells c LEFT JOIN best b USING (cell))"""
_UP = "walk AS (SELECT cell AS origin, cell AS spot FROM edges UNION ALL SELECT w.origin, e.nxt FROM walk w JOIN edges e ON w.spot = e.cell WHERE e.nxt IS NOT NULL)"
_PATH = """path AS (SELECT cell AS origin, cell AS spot, 0.0::DOUBLE AS cost FROM edges UNION ALL
  SELECT p.origin, e.nxt, p.cost + e.step FROM path p JOIN costs e ON p.spot = e.cell WHERE e.nxt IS NOT NULL AND NOT e.stop),
last AS (SELECT p.origin AS cell, p.spot, p.cost FROM path p JOIN costs e ON p.spot = e.cell WHERE e.nxt IS NULL OR e.stop)"""


def _edges(spark, d) -> DataFrame:
    c = cells(spark, d)
    return H.flow_edges(H.flow_direction(c)).join(shuffled(c.select("cell", "slope", "elevation")), "cell")


@query(f"WITH {_D8} SELECT cell, CAST(coalesce(k, -1) AS TINYINT) AS direction FROM edges")
def flow_direction(spark: SparkSession, d: str) -> DataFrame:
    return H.flow_direction(cells(spark, d)).select("cell", "direction")


@query(f"WITH RECURSIVE {_D8}, {_UP} SELECT spot AS cell, CAST(count(*) AS DOUBLE) AS accumulation FROM walk GROUP BY 1")
def flow_accumulation(spark: SparkSession, d: str) -> DataFrame:
    return H.accumulate(_edges(spark, d))


@query(f"WITH RECURSIVE {_D8}, {_UP}, acc AS (SELECT spot AS cell, count(*) AS n FROM walk GROUP BY 1) SELECT count(*) AS cells, round(avg(n), 6) AS mean_upstream, max(n)::DOUBLE AS most, round(count(*) / (SELECT count(*) FROM cells), 6) AS ratio FROM acc WHERE n >= 6")
def stream_cells(spark: SparkSession, d: str) -> DataFrame:
    s = H.streams(H.accumulate(_edges(spark, d)), 6)
    total = cells(spark, d).agg(F.count("*").alias("total"))
    out = s.agg(F.count("*").alias("cells"), F.round(F.avg("accumulation"), 6).alias("mean_upstream"), F.max("accumulation").alias("most"))
    return out.crossJoin(F.broadcast(total)).withColumn("ratio", F.round(F.col("cells") / F.col("total"), 6)).drop("total")


@query(f"WITH RECURSIVE {_D8}, {_UP}, acc AS (SELECT spot AS cell, count(*) AS n FROM walk GROUP BY 1), costs AS (SELECT e.cell, nxt, dist AS step, n >= 6 AS stop FROM edges e JOIN acc USING (cell)), {_PATH} SELECT cell, round(cost, 6) AS distance, spot AS last FROM last")
def distance_to_stream(spark: SparkSession, d: str) -> DataFrame:
    e = _edges(spark, d)
    e = e.join(shuffled(H.accumulate(e)), "cell")
    return H.downstream(e, F.col("dist"), F.col("accumulation") >= 6).select("cell", F.round("cost", 6).alias("distance"), "last")


@query(f"""WITH RECURSIVE {_D8}, sw AS (SELECT *, greatest(tan(radians(slope)), 0.005) AS s, least(greatest((cell % 10) / 10.0, 0.01), 1) AS w FROM edges), {_UP},
acc AS (SELECT k.spot AS cell, count(*) AS n, sum(w) AS sw, sum(s) AS ss FROM walk k JOIN sw ON sw.cell = k.origin GROUP BY 1), costs AS (SELECT e.cell, nxt, dist / (w * s) AS step, n >= 8 AS stop FROM sw e JOIN acc USING (cell)), {_PATH}
SELECT cell, round(log10((sw / n) * (ss / n) * sqrt(n) / CASE WHEN cost <= 0 THEN 0.5 ELSE cost END), 6) AS ic FROM last JOIN acc USING (cell)""")
def connectivity(spark: SparkSession, d: str) -> DataFrame:
    e = _edges(spark, d).withColumn("impedance", F.col("cell") % 10 / 10)
    return H.connectivity(e, 8).withColumn("ic", F.round("ic", 6))


@query(f"""WITH RECURSIVE {_D8}, costs AS (SELECT cell, nxt, 0.0 AS step, false AS stop FROM edges), {_PATH}, s AS (SELECT spot AS sink, count(*) AS n FROM last GROUP BY 1),
k AS (SELECT sink, n, row_number() OVER (ORDER BY elevation, sink) AS basin FROM s JOIN cells ON cell = sink) SELECT cell, CAST(basin AS INT) AS basin FROM last JOIN k ON spot = sink WHERE n >= 5""")
def subwatersheds(spark: SparkSession, d: str) -> DataFrame:
    c = cells(spark, d)
    return H.subwatersheds(_edges(spark, d), c.select("cell", F.col("elevation").alias("height")), 5)


@query()
def fill_depressions(spark: SparkSession, d: str) -> DataFrame:
    return H.fill_depressions(cells(spark, d)).select("cell", "filled")
