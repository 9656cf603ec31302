"""Scenes put together: stacks over time and merged layers."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stacked(scenes: Mapping[str, DataFrame], build: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Scenes by date as one table with `time`; `build` maps each scene first."""
    parts = [(build(s) if build else s).withColumn("time", F.lit(t).cast("date")) for t, s in scenes.items()]
    if not parts:
        raise ValueError("no scenes")
    return reduce(DataFrame.unionByName, parts)


def merged(layers: Sequence[DataFrame], keys: Sequence[str] = ("cell", "y", "x")) -> DataFrame:
    """Layers of one grid side by side: inner joins on the cell."""
    return reduce(lambda a, b: a.join(b, list(keys)), layers)


def spatial_mean(df: DataFrame, value: str, by: Sequence[str] = ("time",)) -> DataFrame:
    return df.groupBy(*by).agg(F.avg(value).alias(value))
