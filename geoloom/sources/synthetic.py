"""Synthetic grids and points for tests and demonstrations. Seeded by hashes of
place, so that results don't depend on partitions or processes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.operators.window2d import box_mean, reflected, slope_degrees

#: Regions: name, bounding box (west, south, east, north), tags, burned area in hectares.
REGIONS = [
    ("poudre", (-105.85, 40.55, -105.45, 40.85), ["forest", "burned", "water supply"], 84_544.0),
    ("sandhills", (-101.6, 42.0, -101.0, 42.4), ["grassland"], 0.0),
    ("salt_basin", (-105.3, 31.6, -104.7, 32.0), ["desert"], 0.0),
]


def regions(spark: SparkSession) -> DataFrame:
    """(name, bbox, tags, burned_ha, lon, lat) with the box's centre."""
    df = spark.createDataFrame(REGIONS, "name string, bbox struct<west:double,south:double,east:double,north:double>, tags array<string>, burned_ha double")
    return df.withColumns({"lon": (F.col("bbox.west") + F.col("bbox.east")) / 2, "lat": (F.col("bbox.south") + F.col("bbox.north")) / 2})


def grid(spark: SparkSession, bbox: tuple[float, float, float, float], step: float = 0.002) -> DataFrame:
    """(cell, y, x, lon, lat) of a half-open grid over a box."""
    w, s, e, n = bbox
    nx, ny = (max(0, int(-(-(b - a) // step))) if abs((b - a) / step - round((b - a) / step)) > 1e-6 else round((b - a) / step) for a, b in ((w, e), (s, n)))
    cells = spark.range(nx * ny).withColumnRenamed("id", "cell")
    y, x = F.expr(f"CAST(cell DIV {max(nx, 1)} AS INT)"), (F.col("cell") % max(nx, 1)).cast("int")
    return cells.select("cell", y.alias("y"), x.alias("x")).select("*", (F.lit(w) + F.col("x") * step).alias("lon"), (F.lit(s) + F.col("y") * step).alias("lat"))


def noise(seed: int, *keys) -> Column:
    """A uniform value in [0, 1) for the keys."""
    return F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(1 << 40)) / float(1 << 40)


def smooth_field(cells: DataFrame, name: str, seed: int, smoothness: int = 9) -> DataFrame:
    """cells with a smooth random layer in [0, 1]: noise, mirrored at the border,
    box means, then its range."""
    half = smoothness // 2
    n = reflected(cells.select("y", "x").withColumn("v", noise(seed, "y", "x")), half)
    m = box_mean(n, "v", half).select("y", "x", "v_mean")
    out = cells.join(m, ["y", "x"])
    ends = out.agg(F.min("v_mean").alias("_lo"), F.max("v_mean").alias("_hi"))
    return out.crossJoin(F.broadcast(ends)).withColumn(name, (F.col("v_mean") - F.col("_lo")) / (F.col("_hi") - F.col("_lo") + 1e-9)).drop("v_mean", "_lo", "_hi")


def optical_scene(spark: SparkSession, bbox, date: str, seed: int = 0, step: float = 0.002) -> DataFrame:
    """red, nir, swir16 as functions of one vegetation field and noise."""
    import zlib

    s = seed + zlib.crc32(date.encode())
    f = smooth_field(grid(spark, bbox, step), "veg", s)
    jitter = lambda k: 0.02 * (noise(s + k, "y", "x") - 0.5)
    bands = {"red": 0.25 - 0.18 * F.col("veg") + jitter(1), "nir": 0.2 + 0.3 * F.col("veg") + jitter(2), "swir16": 0.3 - 0.15 * F.col("veg") + jitter(3)}
    return f.withColumns({k: F.greatest(v, F.lit(0.0)) for k, v in bands.items()}).drop("veg").withColumn("date", F.lit(date).cast("date"))


def burn_severity(spark: SparkSession, bbox, seed: int = 1, step: float = 0.002) -> DataFrame:
    f = smooth_field(grid(spark, bbox, step), "f", seed)
    span = f.agg(F.min("lat").alias("_a"), F.max("lat").alias("_b"))
    north = (F.col("lat") - F.col("_a")) / (F.col("_b") - F.col("_a") + 1e-9)
    v = F.col("f") * (0.4 + 0.6 * north) - 0.15
    return f.crossJoin(F.broadcast(span)).withColumn("burn_severity", F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0))).drop("f", "_a", "_b")


def terrain(spark: SparkSession, bbox, seed: int = 2, step: float = 0.002) -> DataFrame:
    f = smooth_field(grid(spark, bbox, step), "f", seed, 15)
    rise = (F.lit(bbox[2]) - F.col("lon")) / (bbox[2] - bbox[0])
    f = f.withColumn("elevation_m", 1700 + 900 * rise + 400 * F.col("f")).drop("f")
    return slope_degrees(f, "elevation_m", 111_000.0 * step).drop("dy", "dx")


def soil(spark: SparkSession, bbox, seed: int = 3, step: float = 0.002) -> DataFrame:
    f = grid(spark, bbox, step)
    for k, (name, lo, hi) in enumerate((("organic_matter_pct", 2, 8), ("sand_fraction_pct", 30, 70), ("runoff_potential", 0, 1))):
        f = smooth_field(f, "f", seed + k).withColumn(name, lo + (hi - lo) * F.col("f")).drop("f")
    return f


def detections(spark: SparkSession, bbox, start: str, end: str, n: int = 40, seed: int = 4) -> DataFrame:
    """n points evenly spread over the dates."""
    w, s, e, nn = bbox
    days = F.datediff(F.lit(end), F.lit(start))
    i = F.col("id")
    when = F.date_add(F.lit(start).cast("date"), F.floor(i * days / max(n - 1, 1)).cast("int"))
    return spark.range(n).select((w + (e - w) * noise(seed, "id")).alias("lon"), (s + (nn - s) * noise(seed + 1, "id")).alias("lat"), when.alias("acq_date"), (F.lit(5.0) + 95 * noise(seed + 2, "id")).alias("frp"), (50 + F.floor(50 * noise(seed + 3, "id"))).cast("int").alias("confidence"))


def soil_moisture(spark: SparkSession, bbox, start: str, end: str, seed: int = 5, step: float = 0.05) -> DataFrame:
    """A yearly wave with noise for each cell and day."""
    days = spark.sql(f"SELECT explode(sequence(DATE '{start}', DATE '{end}')) AS time")
    g = grid(spark, bbox, step).crossJoin(F.broadcast(days))
    wave = 0.22 + 0.08 * F.sin(F.dayofyear("time") * (2 * 3.141592653589793 / 365.25))
    return g.withColumn("soil_moisture", wave + 0.04 * (noise(seed, "y", "x", "time") - 0.5))
