"""Nested and overlapping inputs as flat tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def flattened(df: DataFrame, column: str, schema: str) -> DataFrame:
    """df with the fields of a JSON text column; NULL where it doesn't parse."""
    parsed = F.from_json(column, schema)
    return df.withColumn("_j", parsed).select(*df.columns, "_j.*")


def station_series(raw: DataFrame, column: str = "raw") -> DataFrame:
    """(triplet, date, value) of nested station -> data -> values JSON; values
    that are no numbers are NULL."""
    schema = "array<struct<stationTriplet:string,data:array<struct<values:array<struct<date:string,value:string>>>>>>"
    s = raw.select(F.explode(F.from_json(column, schema)).alias("s"))
    v = s.select(F.col("s.stationTriplet").alias("triplet"), F.explode("s.data").alias("d")).select("triplet", F.explode("d.values").alias("v"))
    return v.select("triplet", F.to_date("v.date").alias("date"), F.expr("try_cast(v.value AS double)").alias("value"))


def gauge_series(raw: DataFrame, column: str = "raw") -> DataFrame:
    """(site_no, site_name, lat, lon, date, value) of a gauge service's JSON; negative flows are NULL."""
    site = "sourceInfo:struct<siteName:string,siteCode:array<struct<value:string>>,geoLocation:struct<geogLocation:struct<latitude:double,longitude:double>>>"
    schema = f"struct<value:struct<timeSeries:array<struct<{site},values:array<struct<value:array<struct<value:string,dateTime:string>>>>>>>>"
    t = raw.select(F.explode(F.from_json(column, schema)["value"]["timeSeries"]).alias("t"))
    v = t.select(F.col("t.sourceInfo").alias("i"), F.explode("t.values").alias("b")).select("i", F.explode("b.value").alias("v"))
    value = F.expr("try_cast(v.value AS double)")
    place = F.col("i.geoLocation.geogLocation")
    return v.select(F.col("i.siteCode")[0]["value"].alias("site_no"), F.col("i.siteName").alias("site_name"), place["latitude"].alias("lat"), place["longitude"].alias("lon"), F.to_date(F.substring("v.dateTime", 1, 10)).alias("date"), F.when(value >= 0, value).alias("value"))


def resolved(df: DataFrame, wanted: dict[str, Sequence[str]]) -> DataFrame:
    """df with the first column found of each list under its wanted name, names
    compared in lower case; NULL where there is none."""
    names = {c.lower(): c for c in df.columns}
    out: list[Column] = []
    for name, options in wanted.items():
        hit = next((names[o.lower()] for o in options if o.lower() in names), None)
        out.append((F.col(f"`{hit}`") if hit else F.lit(None)).alias(name))
    return df.select(*out)


def windows(df: DataFrame, ts: str, days: int, overlap: int = 0) -> list[DataFrame]:
    """The feed as requests of `days` days would give it, overlapping."""
    lo, hi = df.agg(F.min(ts), F.max(ts)).first()
    if lo is None:
        return [df]
    span = (hi - lo).days // days + 1
    start = F.lit(lo).cast("date")
    return [df.where((F.to_date(ts) >= F.date_add(start, i * days)) & (F.to_date(ts) < F.date_add(start, (i + 1) * days + overlap))) for i in range(span)]


def merged(parts: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """All parts, a row of equal keys once."""
    return reduce(DataFrame.unionByName, parts).dropDuplicates(list(keys))
