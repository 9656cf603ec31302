"""Sources that ask a gatekeeper before anything is read. `read` is a function
(spark, path) and Parquet is read without it; a refusal is logged and raised
before `read` is called."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.governance import Gatekeeper, Tier
from geoloom.sources.files import Box, boxed, features, ignitions

Read = Callable[[SparkSession, str], DataFrame]


def _lower(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.lower() for c in df.columns])


def _number(df: DataFrame, names: Sequence[str]) -> Column | None:
    """The first of the columns that exists, as a number; NULL where it is none."""
    name = next((c for c in names if c in df.columns), None)
    return None if name is None else F.expr(f"try_cast(`{name}` AS double)")


def land_status(gatekeeper: Gatekeeper, spark: SparkSession, path: str, properties: dict[str, str], box: Box | None = None) -> DataFrame:
    """Parcels by kind of ownership from GeoJSON, with names in lower case."""
    gatekeeper.check(Tier.PUBLIC, "land_status", "read land status")
    return _lower(features(spark, path, properties, box=box))


def fire_history(gatekeeper: Gatekeeper, spark: SparkSession, path: str, box: Box, start_year: int = 1984, end_year: int = 2024, least_acres: float = 500, read: Read | None = None) -> DataFrame:
    """Perimeters (with `ring`) that meet the box, of a span of years and a size.
    Years and acres come from whichever known column there is; where there is
    none, nothing is filtered by it, and values that aren't numbers go."""
    gatekeeper.check(Tier.PUBLIC, "fire_history", "read fire history")
    d = boxed(_lower(read(spark, path) if read else spark.read.parquet(path)))
    d = d.where((F.col("minx") <= box[2]) & (F.col("maxx") >= box[0]) & (F.col("miny") <= box[3]) & (F.col("maxy") >= box[1]))
    if (year := _number(d, ("year", "fire_year", "ig_year", "startyear"))) is not None:
        d = d.withColumn("fire_year", year.cast("int")).where(F.col("fire_year").between(start_year, end_year))
    if (acres := _number(d, ("acres", "burnbndac", "fire_acres"))) is not None:
        d = d.withColumn("acres", acres).where(F.col("acres") >= least_acres)
    return d


def fire_records(gatekeeper: Gatekeeper, spark: SparkSession, path: str, box: Box, start_year: int = 1992, end_year: int = 2020, read: Read | None = None) -> DataFrame:
    """Ignitions of a box and a span of years. `read` may be a JDBC read of a
    database file: the ranges are plain predicates, so they are pushed down."""
    gatekeeper.check(Tier.PUBLIC, "ignitions", "read ignition records")
    d = _lower(read(spark, path) if read else spark.read.parquet(path))
    d = d.withColumnsRenamed({"longitude": "lon", "latitude": "lat"})
    return ignitions(d, box, start_year, end_year)
