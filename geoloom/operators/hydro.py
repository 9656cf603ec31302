"""Flow over a grid as a graph: filling, direction, accumulation, connectivity.

Cells are rows (cell, y, x, ...). A cell drains into at most one neighbour, so
the flow is a forest; sums along it take pointer doubling, as many rounds as
the logarithm of the longest path. Each round is written to the shared folder:
plans stay short and a lost executor costs one round. Tables of cells are shuffled
and never broadcast, whatever their files' sizes make Spark think."""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoloom.functions.lineage import cut, discard
from geoloom.functions.sizes import running, shuffled

#: Directions 0 to 7 as (dy, dx): E, NE, N, NW, W, SW, S, SE; y grows southwards.
OFFSETS = ((0, 1), (-1, 1), (-1, 0), (-1, -1), (0, -1), (1, -1), (1, 0), (1, 1))
DISTANCE = tuple(math.hypot(a, b) for a, b in OFFSETS)


def cell_size(attribute: float | None, step: float, latitude: float, fallback: float = 30.0) -> float:
    """Metres: as given, else of a step in degrees, else of a step in metres."""
    if attribute:
        return float(attribute)
    if step < 0.01:
        return step * 111_320.0 * math.cos(math.radians(latitude))
    return float(step) if step > 1 else fallback


def neighbours(df: DataFrame, value: str) -> DataFrame:
    """(cell, y, x, value, n0..n7): the neighbours' values, NULL beyond the grid.
    Each cell sends its value to those around it: one shuffle with a map-side
    combine, no join."""
    shifts = [F.struct((F.col("y") - dy).alias("y"), (F.col("x") - dx).alias("x"), F.lit(k).alias("k"), F.lit(None).cast("bigint").alias("c"), F.col(value).alias("v")) for k, (dy, dx) in enumerate(OFFSETS)]
    own = F.struct(F.col("y").alias("y"), F.col("x").alias("x"), F.lit(-1).alias("k"), F.col("cell").cast("bigint").alias("c"), F.col(value).alias("v"))
    sent = df.select(F.inline(F.array(own, *shifts)))
    around = sent.groupBy("y", "x").agg(F.max("c").alias("cell"), F.max(F.when(F.col("k") == -1, F.col("v"))).alias(value), *[F.max(F.when(F.col("k") == k, F.col("v"))).alias(f"n{k}") for k in range(8)])
    return around.where("cell IS NOT NULL")


def flow_direction(df: DataFrame, value: str = "elevation") -> DataFrame:
    """(cell, y, x, direction): the steepest descent, the first of equal ones; -1 where none descends."""
    d = neighbours(df, value)
    drops = [(F.col(value) - F.col(f"n{k}")) / DISTANCE[k] for k in range(8)]
    best = F.greatest(*drops)
    k = F.coalesce(*[F.when(x == best, k) for k, x in enumerate(drops)])
    return d.select("cell", "y", "x", F.when(best > 0, k).otherwise(-1).cast("tinyint").alias("direction"))


def flow_edges(directions: DataFrame) -> DataFrame:
    """(cell, next, dist): next is NULL at sinks; dist is in cells."""
    k = F.col("direction")
    pick = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), F.greatest(k, F.lit(0)) + 1)
    at = directions.where("direction >= 0").select("cell", (F.col("y") + pick([a for a, _ in OFFSETS])).alias("y"), (F.col("x") + pick([b for _, b in OFFSETS])).alias("x"), pick(DISTANCE).alias("dist"))
    hit = at.join(shuffled(directions.select(F.col("cell").alias("next"), "y", "x")), ["y", "x"]).select("cell", "next", "dist")
    return directions.select("cell").join(shuffled(hit), "cell", "left")


def _follow(df: DataFrame, after: DataFrame) -> DataFrame:
    """df with what `after` has of the next cell. Rows without one, most of them
    in the end, go to partitions by their own cell, not all to that of NULL."""
    own = F.when(F.col("next").isNull(), F.pmod(F.hash("cell"), F.lit(997))).otherwise(F.lit(0))
    none = F.pmod(F.hash("next"), F.lit(1))
    return df.withColumn("_own", own).join(shuffled(after.withColumn("_own", none)), ["next", "_own"], "left").drop("_own")


def accumulate(edges: DataFrame, weights: dict[str, Column] | None = None) -> DataFrame:
    """(cell, <name>...): each weight summed over the cells upstream and the cell
    itself. edges is (cell, next, ...) with the columns that the weights use."""
    weights = weights or {"accumulation": F.lit(1)}
    names = list(weights)
    now = cut(edges.select("cell", "next", *[w.cast("double").alias(n) for n, w in weights.items()]), "flow")
    while now.where("next IS NOT NULL").limit(1).count():
        gain = now.where("next IS NOT NULL").groupBy(F.col("next").alias("cell")).agg(*[F.sum(n).alias(f"_{n}") for n in names])
        after = now.select(F.col("cell").alias("next"), F.col("next").alias("_next"))
        step = _follow(now.join(shuffled(gain), "cell", "left"), after)
        before, now = now, cut(step.select("cell", F.col("_next").alias("next"), *[(F.col(n) + F.coalesce(F.col(f"_{n}"), F.lit(0.0))).alias(n) for n in names]), "flow")
        discard(before)
    return now.select("cell", *names)


def downstream(edges: DataFrame, cost: Column, stop: Column) -> DataFrame:
    """(cell, cost, last): the cost along the path to the first stop cell or the
    sink, which costs nothing itself, and where the path ends."""
    ends = F.coalesce(stop, F.lit(False)) | F.col("next").isNull()
    now = cut(edges.select("cell", F.when(~ends, F.col("next")).alias("next"), F.when(ends, 0.0).otherwise(cost).alias("cost"), F.when(ends, F.col("cell")).otherwise(F.col("next")).alias("last")), "path")
    while now.where("next IS NOT NULL").limit(1).count():
        after = now.select(F.col("cell").alias("next"), F.col("next").alias("_next"), F.col("cost").alias("_cost"), F.col("last").alias("_last"))
        step = _follow(now, after)
        before, now = now, cut(step.select("cell", F.col("_next").alias("next"), (F.col("cost") + F.coalesce("_cost", F.lit(0.0))).alias("cost"), F.coalesce("_last", "last").alias("last")), "path")
        discard(before)
    return now.select("cell", "cost", "last")


def streams(accumulation: DataFrame, threshold: float = 500) -> DataFrame:
    return accumulation.where(F.col("accumulation") >= threshold)


def connectivity(edges: DataFrame, threshold: float, size: float = 1.0, least_slope: float = 0.005) -> DataFrame:
    """(cell, ic): log10 of the upslope component over the downslope one. edges
    has slope (degrees) and impedance (0 to 1); streams and sinks count half a
    cell downslope."""
    s = F.greatest(F.tan(F.radians("slope")), F.lit(least_slope))
    w = F.least(F.greatest("impedance", F.lit(0.01)), F.lit(1.0))
    e = cut(edges.withColumns({"s": s, "w": w}), "connect")
    up = accumulate(e, {"n": F.lit(1.0), "sw": F.col("w"), "ss": F.col("s")})
    e = e.join(shuffled(up), "cell")
    down = downstream(e, size * F.col("dist") / (F.col("w") * F.col("s")), F.col("n") >= threshold)
    d_up = (F.col("sw") / F.col("n")) * (F.col("ss") / F.col("n")) * F.sqrt(F.col("n") * size * size)
    d_down = F.when(F.col("cost") <= 0, size / 2).otherwise(F.col("cost"))
    return up.join(shuffled(down), "cell").select("cell", F.log10(d_up / d_down).alias("ic"))


def subwatersheds(edges: DataFrame, heights: DataFrame, least: int = 200) -> DataFrame:
    """(cell, basin): basins by their sinks, numbered by the sinks' heights (ties
    by cell); basins of fewer than `least` cells are left out. heights: (cell, height)."""
    ends = downstream(edges, F.lit(0.0), F.lit(False)).select("cell", F.col("last").alias("sink"))
    sinks = ends.groupBy("sink").agg(F.count("*").alias("n")).join(shuffled(heights.select(F.col("cell").alias("sink"), "height")), "sink")
    one = sinks.withColumn("_one", F.lit(1))
    numbered = running(one, F.struct("height", "sink"), "sum", "_one", "basin", "basins").withColumn("basin", F.col("basin").cast("int")).where(F.col("n") >= least)
    return ends.join(shuffled(numbered.select("sink", "basin")), "sink").select("cell", "basin")


def flood(z: np.ndarray, epsilon: float = 0.0) -> np.ndarray:
    """Priority flood of one grid, NaN being outside."""
    ny, nx = z.shape
    out, done = z.copy(), np.isnan(z)
    edge = np.zeros_like(done)
    edge[[0, -1], :] = edge[:, [0, -1]] = True
    hole = np.pad(np.isnan(z), 1)
    for dy, dx in OFFSETS:
        edge |= hole[1 + dy : 1 + dy + ny, 1 + dx : 1 + dx + nx]
    heap = [(z[i, j], i, j) for i, j in zip(*np.nonzero(edge & ~done))]
    heapq.heapify(heap)
    for _, i, j in heap:
        done[i, j] = True
    while heap:
        level, i, j = heapq.heappop(heap)
        for dy, dx in OFFSETS:
            a, b = i + dy, j + dx
            if 0 <= a < ny and 0 <= b < nx and not done[a, b]:
                done[a, b] = True
                out[a, b] = max(z[a, b], level + epsilon)
                heapq.heappush(heap, (out[a, b], a, b))
    return out


def fill_depressions(df: DataFrame, value: str = "elevation", grid: str | None = None, epsilon: float = 0.0) -> DataFrame:
    """(cell, y, x, filled), each grid in one task; for grids too large for one, fill_by_relaxation."""
    kinds = dict(df.dtypes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        y, x = pdf["y"].to_numpy() - pdf["y"].min(), pdf["x"].to_numpy() - pdf["x"].min()
        z = np.full((y.max() + 1, x.max() + 1), np.nan)
        z[y, x] = pdf[value].to_numpy(float)
        return pdf.drop(columns=[value]).assign(filled=flood(z, epsilon)[y, x])

    keys = [grid] if grid else []
    schema = ", ".join(f"{c} {kinds[c]}" for c in [*keys, "cell", "y", "x"]) + ", filled double"
    return df.select(*keys, "cell", "y", "x", value).groupBy(*keys).applyInPandas(run, schema)


def fill_by_relaxation(df: DataFrame, value: str = "elevation", rounds_a_check: int = 4) -> DataFrame:
    """The same result by rounds of neighbour minima, for a grid of any size:
    water starts unbounded inside and falls to the lowest way out."""
    z = F.col(value)
    n = neighbours(df.where(z.isNotNull()), value)
    border = n.select("cell", "y", "x", value, F.coalesce(*[F.when(F.col(f"n{k}").isNull(), True) for k in range(8)], F.lit(False)).alias("edge"))
    now = cut(border.withColumn("w", F.when(F.col("edge"), z).otherwise(float("inf"))), "fill")
    while True:
        step = now
        for _ in range(rounds_a_check):
            low = F.least(*[F.col(f"n{k}") for k in range(8)])
            around = neighbours(step, "w").select("cell", low.alias("low"))
            last, step = step, cut(step.join(shuffled(around), "cell").withColumn("w", F.when(F.col("edge"), z).otherwise(F.least("w", F.greatest(z, "low")))).drop("low"), "fill")
            if last is not now:
                discard(last)
        moved = step.select("cell", F.col("w").alias("v")).join(shuffled(now.select("cell", "w")), "cell").where("v <> w").limit(1).count()
        discard(now)
        now = step
        if not moved:
            return now.select("cell", "y", "x", F.col("w").alias("filled"))
