"""Writing results. Releases pass the publication gate first."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_cube(df: DataFrame, path: str, by: Sequence[str] = ("time",)) -> None:
    """Cells as Parquet, partitioned by time and sorted so that boxes prune."""
    df.repartition(*by).sortWithinPartitions(*by, *[c for c in ("y", "x") if c in df.columns]).write.mode("overwrite").partitionBy(*by).parquet(path)


def read_cube(spark, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_csv(df: DataFrame, path: str, single: bool = True) -> None:
    """A table of results with a header; one file for reports."""
    (df.coalesce(1) if single else df).write.mode("overwrite").option("header", True).csv(path)


def write_geojson(df: DataFrame, path: str, ring: str = "ring") -> None:
    """Features as lines of GeoJSON text."""
    pairs = F.transform(ring, lambda p: F.array(p["x"], p["y"]))
    rest = F.struct(*[c for c in df.columns if c != ring])
    feature = F.struct(F.lit("Feature").alias("type"), rest.alias("properties"), F.struct(F.lit("Polygon").alias("type"), F.array(pairs).alias("coordinates")).alias("geometry"))
    df.select(F.to_json(feature).alias("value")).write.mode("overwrite").text(path)


def publish(df: DataFrame, path: str, gatekeeper, approved: bool, record: str | None, provenance=None) -> None:
    """Gate, then CSV; with it the provenance text as a table of lines."""
    gatekeeper.check_publication(approved, record)
    write_csv(df, path)
    if provenance is not None:
        lines = [(t,) for t in provenance.markdown().split("\n")]
        df.sparkSession.createDataFrame(lines, "value string").coalesce(1).write.mode("overwrite").text(f"{path.rstrip('/')}-provenance")
