"""Checks of size before a side is broadcast, and orders of whole tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .lineage import cut

#: A side is broadcast if it has at most so many bytes.
BROADCAST_BYTES = 32 << 20
_UNKNOWN = 1 << 52


def size_of(df: DataFrame) -> int:
    """Bytes of a DataFrame: what its plan says of files and literal rows, or
    else the lengths of its rows as JSON, in one aggregate."""
    known = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    if known < _UNKNOWN:
        return known
    return df.select(F.sum(F.length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]))))).first()[0] or 0


def is_small(df: DataFrame, most: int = BROADCAST_BYTES) -> bool:
    return size_of(df) <= most


def small(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """df with a broadcast hint if its bytes are few; else Spark decides."""
    return F.broadcast(df) if is_small(df, most) else df


def shuffled(df: DataFrame) -> DataFrame:
    """df never broadcast in a join. Spark takes a table for the bytes of its
    file; in memory, repeated or well compressed rows are many times that."""
    return df.hint("merge")


def running(df: DataFrame, order: Column, how: str = "sum", value: str | None = None, out: str = "running", name: str = "running", keys: Sequence[str] = ()) -> DataFrame:
    """df with a running sum or minimum over the whole table, or for each of
    `keys`, by ranges: each partition runs by itself and adds what the ones
    before it have. Rows that are equal in `keys` and `order` fall into one
    partition. What is carried on is a row for each partition at most, as keys
    that begin in it need none; without keys these rows are ordered in one task."""
    f = {"sum": F.sum, "min": F.min}[how]
    d = df.repartitionByRange(*keys, order).withColumn("_range", F.spark_partition_id())
    d = cut(d, name)
    own = Window.partitionBy("_range", *keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    ends = d.groupBy("_range", *keys).agg(f(value).alias("_end"))
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(F.col("_range").alias("_at"), *[F.col(k).alias(f"_key_{k}") for k in keys], f("_end").over(before).alias("_before")).where("_before IS NOT NULL")
    mine = f(value).over(own)
    both = mine + F.coalesce("_before", F.lit(0)) if how == "sum" else F.least(mine, F.col("_before"))
    same = [F.col(k).eqNullSafe(F.col(f"_key_{k}")) for k in keys]
    return d.join(F.broadcast(ends), reduce(and_, same, F.col("_range") == F.col("_at")), "left").withColumn(out, both).drop("_range", "_at", "_before", *[f"_key_{k}" for k in keys])


def ranked(df: DataFrame, order: Column, value: str, out: str = "rank") -> DataFrame:
    """df with the average rank of each value over the whole table, without a
    window of all rows: values are counted first, and the counts run up."""
    counts = df.groupBy(value).agg(F.count("*").alias("_n"))
    run = running(counts, order, "sum", "_n", "_upto", "ranks").select(F.col(value).alias("_v"), (F.col("_upto") - (F.col("_n") - 1) / 2).alias(out))
    return df.join(run, df[value].eqNullSafe(F.col("_v"))).drop("_v")
