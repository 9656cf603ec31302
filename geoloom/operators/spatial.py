"""Joins by place: points in polygons, nearest cells, distance decay, overlap."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoloom.functions.columns import in_polygon
from geoloom.functions.sizes import is_small, shuffled, small


def polygons(spark, rings: Mapping[str, Sequence[tuple[float, float]]]) -> DataFrame:
    """(name, ring, minx, miny, maxx, maxy, nth) of literal rings."""
    rows = [(k, [(float(a), float(b)) for a, b in r], i) for i, (k, r) in enumerate(rings.items())]
    df = spark.createDataFrame(rows, "name string, ring array<struct<x:double,y:double>>, nth int")
    edge = lambda f, c: f(F.transform("ring", lambda p: p[c]))
    return df.withColumns({"minx": edge(F.array_min, "x"), "miny": edge(F.array_min, "y"), "maxx": edge(F.array_max, "x"), "maxy": edge(F.array_max, "y")})


def points_in_polygons(points: DataFrame, px: str, py: str, shapes: DataFrame, how: str = "inner", tile: float | None = None) -> DataFrame:
    """Points with each polygon that they are in; `left` keeps the others. The
    bounding box is tested before the ring. Polygons of few bytes are broadcast;
    others are joined by the square tiles that the boxes touch, of side `tile`,
    by default twice the mean side of a box."""
    x, y = F.col(px), F.col(py)
    inside = x.between(F.col("minx"), F.col("maxx")) & y.between(F.col("miny"), F.col("maxy")) & in_polygon(x, y, F.col("ring"))
    if tile is None and is_small(shapes):
        return points.join(F.broadcast(shapes), inside, how)
    if tile is None:
        tile = shapes.select(F.avg((F.col("maxx") - F.col("minx") + F.col("maxy") - F.col("miny")))).first()[0] or 1.0
    span = lambda a, b: F.sequence(F.floor(F.col(a) / tile), F.floor(F.col(b) / tile))
    tiled = shapes.withColumn("_tx", F.explode(span("minx", "maxx"))).withColumn("_ty", F.explode(span("miny", "maxy")))
    p = points.withColumns({"_px": F.floor(x / tile), "_py": F.floor(y / tile)})
    return p.join(tiled, (F.col("_px") == F.col("_tx")) & (F.col("_py") == F.col("_ty")) & inside, how).drop("_px", "_py", "_tx", "_ty")


def burned_zones(cells: DataFrame, x: str, y: str, shapes: DataFrame) -> DataFrame:
    """cells with `zone`, the polygon that holds the centre; the last one wins."""
    hit = points_in_polygons(cells.select("cell", x, y), x, y, shapes)
    return cells.join(hit.groupBy("cell").agg(F.max_by("name", "nth").alias("burned")), "cell", "left")


def cell_index(value, origin: float, step: float, size: int) -> Column:
    """Index of the grid cell nearest to a coordinate, clamped to the grid."""
    at = F.floor((F.col(value) - origin) / step + 0.5).cast("int")
    return F.when(F.col(value).isNotNull(), F.least(F.greatest(at, F.lit(0)), F.lit(size - 1)))


def nearest_cells(points: DataFrame, px: str, py: str, cells: DataFrame, step: float, size: tuple[int, int], most: float | None = None) -> DataFrame:
    """points with the layers of the nearest cell of a grid (x, y) from the
    origin: an equi-join on computed indices. Beyond `most` away, none."""
    p = points.withColumns({"x": cell_index(px, 0.0, step, size[0]), "y": cell_index(py, 0.0, step, size[1])})
    if most is not None:
        p = p.where(F.hypot(F.col(px) - F.col("x") * step, F.col(py) - F.col("y") * step) <= most)
    return p.join(cells, ["x", "y"])


def exposure_by_zone(sampled: DataFrame, zone: str, value: str) -> DataFrame:
    return sampled.groupBy(zone).agg(F.count("*").alias("assets"), F.sum(value).alias("total"))


KM_PER_DEGREE = 111.0


def in_km(df: DataFrame, lon: str, lat: str, cells: DataFrame, y: str = "y") -> DataFrame:
    """df with `lon` and `lat`, degrees, as kilometres; a degree of longitude is
    that of the mean latitude of the rows of the grid `cells`."""
    mean = cells.select(y).distinct().agg(F.radians(F.avg(y)).alias("_mean"))
    wide = df.crossJoin(F.broadcast(mean))  # one row
    return wide.withColumns({lon: F.col(lon) * KM_PER_DEGREE * F.cos("_mean"), lat: F.col(lat) * KM_PER_DEGREE}).drop("_mean")


def distance_weighted(assets: DataFrame, key: str, px: str, py: str, cells: DataFrame, hazard: str, decays: Sequence[float], degrees: bool = False) -> DataFrame:
    """(asset, decay, exposure): mean hazard of the cells within three decay
    lengths, weighted by exp(-distance / decay); NULL for an asset with none in
    reach. With `degrees`, positions are degrees and decays kilometres. A band
    join: both sides carry the square of side 3 decays, cells repeat to the
    squares around theirs. Cells whose square isn't beside the box of the assets'
    squares meet none and are left out. The repeated cells are never broadcast:
    Spark takes them for the size of their file."""
    if degrees:
        assets, cells = in_km(assets, px, py, cells), in_km(cells, "x", "y", cells)
    parts = []
    for decay in decays:
        reach = 3.0 * decay
        bin_ = lambda c: F.floor(F.col(c) / reach)
        around = F.array(F.lit(-1), F.lit(0), F.lit(1))
        a = assets.select(key, px, py, bin_(px).alias("bx"), bin_(py).alias("by"))
        box = a.agg(*[f(b).alias(f"_{f.__name__}_{b}") for b in ("bx", "by") for f in (F.min, F.max)])  # one row
        beside = lambda c, b: bin_(c).between(F.col(f"_min_{b}") - 1, F.col(f"_max_{b}") + 1)
        c = cells.where(F.col(hazard).isNotNull()).select(F.col("x").alias("cx"), F.col("y").alias("cy"), F.col(hazard).alias("h"))
        c = c.join(F.broadcast(box), beside("cx", "bx") & beside("cy", "by")).select("cx", "cy", "h")
        c = c.select("*", F.explode(F.transform(around, lambda d: bin_("cx") + d)).alias("bx")).select("*", F.explode(F.transform(around, lambda d: bin_("cy") + d)).alias("by"))
        away = F.hypot(F.col(px) - F.col("cx"), F.col(py) - F.col("cy"))
        near = a.join(shuffled(c), ["bx", "by"]).withColumn("away", away).where(F.col("away") <= reach).withColumn("w", F.exp(-F.col("away") / decay))
        found = near.groupBy(key).agg(F.try_divide(F.sum(F.col("h") * F.col("w")), F.sum("w")).alias("exposure"))
        parts.append(assets.select(key).join(found, key, "left").withColumn("decay", F.lit(float(decay))))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select(key, "decay", "exposure")


def status_complexity(areas: DataFrame, step: float) -> DataFrame:
    """(gx, gy, n_statuses, statuses) of each square of a grid over the areas
    (status, minx, miny, maxx, maxy): how many statuses meet there, 0 too."""
    b = areas.agg(F.min("minx").alias("x0"), F.min("miny").alias("y0"), F.max("maxx").alias("x1"), F.max("maxy").alias("y1"))
    n = lambda lo, hi: F.ceil((F.col(hi) - F.col(lo)) / step)
    grid = b.where("x0 IS NOT NULL").select("x0", "y0", F.explode(F.sequence(F.lit(0), n("x0", "x1") - 1)).alias("gx"), n("y0", "y1").alias("ny"))
    grid = grid.select("x0", "y0", "gx", F.explode(F.sequence(F.lit(0), F.col("ny") - 1)).alias("gy"))
    lo_x, lo_y = F.col("x0") + F.col("gx") * step, F.col("y0") + F.col("gy") * step
    meet = (F.col("minx") < lo_x + step) & (F.col("maxx") > lo_x) & (F.col("miny") < lo_y + step) & (F.col("maxy") > lo_y)
    hits = grid.join(small(areas), meet).groupBy("gx", "gy").agg(F.count_distinct("status").alias("n_statuses"), F.array_join(F.array_sort(F.collect_set("status")), "|").alias("statuses"))
    return grid.select("gx", "gy").join(hits, ["gx", "gy"], "left").na.fill(0, ["n_statuses"])


def avoided(cells: DataFrame, x: str, y: str, mask: DataFrame) -> DataFrame:
    """The cells outside every polygon of a mask. A mask with attributes beyond
    its shape is refused: it would tell what it hides."""
    extra = set(mask.columns) - {"name", "ring", "minx", "miny", "maxx", "maxy", "nth"}
    if extra:
        raise ValueError(f"the mask has attributes: {sorted(extra)}")
    px, py = F.col(x), F.col(y)
    inside = px.between(F.col("minx"), F.col("maxx")) & py.between(F.col("miny"), F.col("maxy")) & in_polygon(px, py, F.col("ring"))
    return cells.join(small(mask), inside, "left_anti")


def status_exposure(joined: DataFrame, status: str) -> DataFrame:
    """Count and share of assets by status; those without one make a group."""
    by = joined.groupBy(status).agg(F.count("*").alias("assets"))
    total = joined.agg(F.count("*").alias("total"))
    return by.crossJoin(F.broadcast(total)).select(status, "assets", (100.0 * F.col("assets") / F.col("total")).alias("pct"))


def point_density(cells: DataFrame, points: DataFrame, px: str, py: str, step: float, size: tuple[int, int]) -> DataFrame:
    """cells with `points`, how many points fall into each."""
    p = points.select(cell_index(px, 0.0, step, size[0]).alias("x"), cell_index(py, 0.0, step, size[1]).alias("y"))
    return cells.join(p.groupBy("x", "y").agg(F.count("*").alias("points")), ["x", "y"], "left").na.fill(0, ["points"])
