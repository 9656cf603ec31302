"""File-backed sources. Filters are plain predicates on columns, so that they
reach the scan; fill values and units are mended as rows are read."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.functions.columns import clean
from geoloom.sources.parse import resolved

Box = tuple[float, float, float, float]

#: Columns of daily weather by the short code of the variable.
WEATHER = {"pr": "precipitation_amount", "pet": "potential_evapotranspiration", "tmmx": "air_temperature_max", "tmmn": "air_temperature_min", "vpd": "mean_vapor_pressure_deficit", "erc": "energy_release_component", "rmax": "relative_humidity_max", "rmin": "relative_humidity_min", "vs": "wind_speed", "srad": "shortwave_radiation", "fm100": "fuel_moisture_100h", "fm1000": "fuel_moisture_1000h"}
#: Divisors that turn stored canopy and fuel layers into units.
CANOPY_SCALE = {"cbh": 10.0, "ch": 10.0, "cbd": 100.0}
INTAKES = [("Upper intake", -105.51, 40.70), ("Canyon intake", -105.25, 40.67), ("City intake", -105.15, 40.62)]


def within(box: Box, lon: str = "lon", lat: str = "lat") -> Column:
    return F.col(lon).between(box[0], box[2]) & F.col(lat).between(box[1], box[3])


def cells(spark: SparkSession, path: str, box: Box | None = None, columns: Sequence[str] | None = None) -> DataFrame:
    """A cell table (Parquet), NaN as NULL. Written sorted by (y, x), its row
    groups let the box prune."""
    df = spark.read.parquet(path)
    if box:
        df = df.where(within(box))
    if columns:
        df = df.select(*columns)
    return df.withColumns({c: clean(c) for c, k in df.dtypes if k in ("double", "float")})


def weather(spark: SparkSession, path: str, variables: Iterable[str], box: Box, start: str, end: str) -> DataFrame:
    """Daily weather, kelvin as Celsius."""
    names = [WEATHER[v] for v in variables]
    df = spark.read.parquet(path).where(within(box) & F.col("day").between(F.lit(start).cast("date"), F.lit(end).cast("date"))).select("day", "lon", "lat", *names)
    return df.withColumns({n: F.col(n) - 273.15 for n in names if n.startswith("air_temperature")})


def blocks(start_year: int, end_year: int, size: int = 5, first: int = 1950) -> list[tuple[int, int]]:
    """The (first, last) years of the projections' files that overlap a span."""
    lo = first + (start_year - first) // size * size
    return [(y, y + size - 1) for y in range(lo, end_year + 1, size)]


def projections(spark: SparkSession, path: str, variable: str, models: Sequence[str], scenario: str, box: Box, start_year: int, end_year: int) -> DataFrame:
    """(model, time, lon, lat, value): partitions by model, scenario and block
    prune; longitudes of 0 to 360 are wrapped. Models without files have no rows."""
    df = spark.read.parquet(path).where(F.col("model").isin(list(models)) & (F.col("scenario") == scenario) & F.col("block").isin([a for a, _ in blocks(start_year, end_year)]))
    lon = F.when(F.col("lon") > 180, F.col("lon") - 360).otherwise(F.col("lon"))
    df = df.withColumn("lon", lon).where(within(box) & F.year("time").between(start_year, end_year))
    value = F.col(variable) - 273.15 if variable.startswith("tas") else F.col(variable)
    return df.select("model", "time", "lon", "lat", value.alias("value"))


def soil_moisture(spark: SparkSession, path: str, box: Box, start: str, end: str) -> DataFrame:
    df = spark.read.parquet(path).where(within(box) & F.col("time").between(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")))
    return df.withColumn("soil_moisture", F.when(F.col("soil_moisture") > -9990, clean("soil_moisture")))


def scene(catalog: DataFrame, date: str, box: Box, days: int = 15, cloud: float = 20.0) -> DataFrame:
    """The catalogue row nearest in time among scenes that meet the box and aren't cloudy."""
    away = F.abs(F.datediff("date", F.lit(date)))
    hit = catalog.where((F.col("cloud_pct") < cloud) & (away <= days) & (F.col("west") <= box[2]) & (F.col("east") >= box[0]) & (F.col("south") <= box[3]) & (F.col("north") >= box[1]))
    return hit.agg(F.min_by(F.struct(*catalog.columns), F.struct(away, "date", "id")).alias("s")).where("s IS NOT NULL").select("s.*")


def reflectance(df: DataFrame, bands: Sequence[str]) -> DataFrame:
    return df.withColumns({b: F.when(F.col(b) > 0, F.col(b) / 10_000) for b in bands})


def severity_raster(df: DataFrame, box: Box, column: str = "severity") -> DataFrame:
    """Cells of the box, 0 as NULL, as 0 to 1 over their range."""
    d = df.where(within(box)).withColumn(column, F.when(F.col(column) != 0, F.col(column)))
    ends = d.agg(F.min(column).alias("_lo"), F.max(column).alias("_hi"))
    return d.crossJoin(F.broadcast(ends)).withColumn(column, (F.col(column) - F.col("_lo")) / (F.col("_hi") - F.col("_lo") + 1e-9)).drop("_lo", "_hi")


def canopy(df: DataFrame) -> DataFrame:
    """Stored canopy layers in units; codes of 0 and less are no canopy, NULL."""
    return df.withColumns({c: F.when(F.col(c) > 0, F.col(c) / s) for c, s in CANOPY_SCALE.items() if c in df.columns})


def elevation_tiles(df: DataFrame) -> DataFrame:
    """One elevation a cell: the mean of overlapping tiles."""
    return df.groupBy("cell", "y", "x").agg(F.avg("elevation_m").alias("elevation_m"))


def detections(spark: SparkSession, paths: Sequence[str], start: str, end: str, box: Box | None = None) -> DataFrame:
    """Active-fire CSV files of overlapping windows, each detection once."""
    df = spark.read.option("header", True).csv(list(paths))
    named = resolved(df, {"lon": ("longitude", "lon"), "lat": ("latitude", "lat"), "acq_date": ("acq_date",), "frp": ("frp",), "confidence": ("confidence",)})
    out = named.select(*[F.expr(f"try_cast({c} AS double)").alias(c) for c in ("lon", "lat")], F.expr("try_cast(acq_date AS date)").alias("acq_date"), F.expr("try_cast(frp AS double)").alias("frp"), F.expr("try_cast(confidence AS int)").alias("confidence"))
    out = out.where(F.col("acq_date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    return (out.where(within(box)) if box else out).dropDuplicates()


def joined_rings(rings) -> Column:
    """Rings as one: after each, back to its start and to the first ring's. The
    ways between are gone both ways, so that they cancel in an even-odd test and
    holes and further parts count as they should."""
    first = rings[0][0]
    chain = F.aggregate(rings, F.slice(rings[0], 1, 0), lambda a, r: F.concat(a, r, F.array(r[0], first)))
    return F.when(F.size(rings) > 1, chain).otherwise(rings[0])


def features(spark: SparkSession, path: str, properties: Mapping[str, str], where: str | None = None, box: Box | None = None) -> DataFrame:
    """GeoJSON features or Esri JSON ones: properties by name and type, and the
    geometry as array<struct<x, y>> `ring`: the rings of a polygon with holes or
    of several polygons as joined_rings, the points of a line, or one point.
    `where` is a condition on the properties; `box` keeps what meets it."""
    props = ", ".join(f"`{k}`: {t}" for k, t in properties.items())
    schema = f"features array<struct<properties: struct<{props}>, attributes: struct<{props}>, geometry: struct<type: string, coordinates: string, rings: string, paths: string, x: double, y: double>>>"
    f = spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("features").alias("f"))
    values = [F.coalesce(F.col("f.properties")[k], F.col("f.attributes")[k]).alias(k) for k in properties]
    g = F.col("f.geometry")
    depth = lambda text, n: F.from_json(text, "array<" * n + "double" + ">" * n)
    kind = g["type"]
    rings = F.coalesce(depth(g["rings"], 3), F.when(kind == "Polygon", depth(g["coordinates"], 3)).when(kind == "MultiPolygon", F.flatten(depth(g["coordinates"], 4))))
    line = F.coalesce(F.flatten(depth(g["paths"], 3)), F.when(kind == "LineString", depth(g["coordinates"], 2)).when(kind == "MultiLineString", F.flatten(depth(g["coordinates"], 3))))
    point = F.when(g["x"].isNotNull(), F.array(F.array(g["x"], g["y"]))).when(kind == "Point", F.array(depth(g["coordinates"], 1)))
    chain = F.coalesce(F.when(rings.isNotNull(), joined_rings(rings)), line, point)
    out = f.select(*values, F.transform(chain, lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))).alias("ring"))
    if where:
        out = out.where(where)
    if box:
        d = boxed(out).where((F.col("minx") <= box[2]) & (F.col("maxx") >= box[0]) & (F.col("miny") <= box[3]) & (F.col("maxy") >= box[1]))
        out = d.select(out.columns)
    return out


#: Digits of a watershed's code by level.
LEVELS = {"region": 2, "subregion": 4, "basin": 6, "subbasin": 8, "watershed": 10, "subwatershed": 12}


def watersheds(spark: SparkSession, path: str, level: int | str, box: Box | None = None) -> DataFrame:
    """(code, name, ring) of the watersheds of a level, by name or digits, whose
    codes are in the property huc<digits>."""
    digits = LEVELS.get(level, level)
    if digits not in LEVELS.values():
        raise ValueError(f"levels are {LEVELS}")
    return features(spark, path, {f"huc{digits}": "string", "name": "string"}, box=box).withColumnRenamed(f"huc{digits}", "code")


def boxed(df: DataFrame) -> DataFrame:
    """df with the bounding box of its rings."""
    xs, ys = F.transform("ring", lambda p: p["x"]), F.transform("ring", lambda p: p["y"])
    return df.withColumns({"minx": F.array_min(xs), "miny": F.array_min(ys), "maxx": F.array_max(xs), "maxy": F.array_max(ys)})


def perimeters(df: DataFrame, box: Box, years: tuple[int, int] | None = None, least_acres: float = 1000) -> DataFrame:
    """Fire perimeters of a size that meet the box; acres are read whatever their type."""
    d = boxed(df).withColumn("acres", F.expr("try_cast(acres AS double)"))
    d = d.where((F.col("acres") >= least_acres) & (F.col("minx") <= box[2]) & (F.col("maxx") >= box[0]) & (F.col("miny") <= box[3]) & (F.col("maxy") >= box[1]))
    return d.where(F.col("year").between(*years)) if years else d


def flowlines(df: DataFrame, least_order: int | None = None) -> DataFrame:
    return df if least_order is None else df.where(F.col("stream_order") >= least_order)


def buildings(raw: DataFrame, column: str = "raw") -> DataFrame:
    """(id, lon, lat, building) of an overpass-style response: ways by their centres."""
    schema = "struct<elements:array<struct<id:bigint,lat:double,lon:double,center:struct<lat:double,lon:double>,tags:map<string,string>>>>"
    e = raw.select(F.explode(F.from_json(column, schema)["elements"]).alias("e"))
    return e.select("e.id", F.coalesce("e.lon", "e.center.lon").alias("lon"), F.coalesce("e.lat", "e.center.lat").alias("lat"), F.coalesce(F.try_element_at("e.tags", F.lit("building")), F.lit("yes")).alias("building"))


def intakes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(INTAKES, "name string, lon double, lat double")


def stations(df: DataFrame, box: Box, state: str | None = None) -> DataFrame:
    d = df.where(within(box))
    return d.where(F.col("state") == state) if state else d


def ignitions(df: DataFrame, box: Box, start_year: int, end_year: int) -> DataFrame:
    """Rows of a fire-occurrence table, Parquet or JDBC: BETWEEN is pushed down."""
    return df.where(within(box) & F.col("fire_year").between(start_year, end_year))


def soil_properties(mapunit: DataFrame, component: DataFrame, horizon: DataFrame, units: DataFrame | None = None) -> DataFrame:
    """Surface horizons of a soil survey's components: map units joined to
    components by mukey and to the horizons that begin at depth 0 by cokey, of the
    map units in `units` (mukey, repeats allowed) if it is given."""
    if units is not None:
        mapunit = mapunit.join(units.select("mukey"), "mukey", "left_semi")
    return mapunit.join(component, "mukey").join(horizon.where("hzdept_r = 0"), "cokey")


def boundary(gatekeeper, spark: SparkSession, path: str, name: str) -> DataFrame:
    """Gated: boundaries whose names have `name`, in any case; an error if there are none."""
    from geoloom.governance import Tier

    gatekeeper.check(Tier.PUBLIC, "boundaries")
    out = spark.read.parquet(path).where(F.upper("name").contains(name.upper()))
    if not out.limit(1).count():
        raise ValueError(f"no boundary is called {name}")
    return out
