"""Moving windows and differences on a grid (y, x), as separable windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def box_sums(df: DataFrame, columns: Sequence[str], half: int, y: str = "y", x: str = "x", keys: Sequence[str] = ()) -> DataFrame:
    """df with <c>_s and <c>_c: sum and count of c in the square around a cell,
    cut at the grid's border. Two window passes, one along each axis."""
    down = Window.partitionBy(*keys, x).orderBy(y).rangeBetween(-half, half)
    along = Window.partitionBy(*keys, y).orderBy(x).rangeBetween(-half, half)
    for w in (down, along):
        first = w is down
        df = df.withColumns({f"{c}_{k}": (f(c) if first else F.sum(f"{c}_{k}")).over(w) for c in columns for k, f in (("s", F.sum), ("c", F.count))})
    return df


def box_mean(df: DataFrame, column: str, half: int, **kw) -> DataFrame:
    out = box_sums(df, [column], half, **kw)
    return out.withColumn(f"{column}_mean", F.try_divide(f"{column}_s", f"{column}_c")).drop(f"{column}_s", f"{column}_c")


def reflected(df: DataFrame, half: int, y: str = "y", x: str = "x") -> DataFrame:
    """df with `half` rows and columns mirrored beyond each border (the border
    cell itself comes first), so that box means need no cut at the border."""
    size = df.agg(F.max(y).alias("_ny"), F.max(x).alias("_nx"))
    df = df.crossJoin(F.broadcast(size))
    for axis, top in ((y, "_ny"), (x, "_nx")):
        v, n = F.col(axis), F.col(top)
        low = F.when(v < half, -1 - v)
        high = F.when(v > n - half, 2 * n + 1 - v)
        df = df.withColumn("_at", F.explode(F.array_compact(F.array(v, low, high)))).withColumn(axis, F.col("_at")).drop("_at")
    return df.drop("_ny", "_nx")


def gradient(df: DataFrame, value: str, y: str = "y", x: str = "x", step: float = 1.0) -> DataFrame:
    """df with dy and dx: central differences, one-sided at the borders."""

    def along(a: str, other: str) -> Column:
        w = Window.partitionBy(other).orderBy(a)
        before, after, here = F.lag(value).over(w), F.lead(value).over(w), F.col(value)
        return F.coalesce((after - before) / (2 * step), (after - here) / step, (here - before) / step, F.lit(0.0))

    return df.withColumns({"dy": along(y, x), "dx": along(x, y)})


def slope_degrees(df: DataFrame, value: str, step: float = 1.0) -> DataFrame:
    return gradient(df, value, step=step).withColumn("slope_deg", F.degrees(F.atan(F.hypot("dy", "dx"))))


def coupling(df: DataFrame, a: str, b: str, window: int = 5) -> DataFrame:
    """df with `r`, the local correlation of two layers; NULL where the windows
    hold too few valid cells or a layer doesn't vary."""
    d = df.withColumns({"_ab": F.col(a) * F.col(b), "_aa": F.col(a) * F.col(a), "_bb": F.col(b) * F.col(b)})
    d = box_sums(d, [a, b, "_ab", "_aa", "_bb"], window // 2)
    enough = max(3, window * window // 3)
    mean = lambda c: F.when(F.col(f"{c}_c") >= enough, F.try_divide(f"{c}_s", f"{c}_c"))
    var = lambda c, cc: F.greatest(mean(cc) - mean(c) * mean(c), F.lit(0.0))
    spread = F.sqrt(var(a, "_aa")) * F.sqrt(var(b, "_bb"))
    out = d.withColumn("r", F.when(spread > 1e-9, (mean("_ab") - mean(a) * mean(b)) / spread))
    return out.select(*df.columns, "r")
