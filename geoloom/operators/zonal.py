"""Aggregates over zones, classes and groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from geoloom.functions.columns import correlation, student_p


def zonal(df: DataFrame, zone: str, value: str, above: float, least: int = 1) -> DataFrame:
    """(zone, n_cells, mean, max, pct_of_zone, pct_of_grid) of zones with at
    least `least` cells: one shuffle; the grid's size is a one-row broadcast.
    pct_of_grid divides by all cells of the grid, as for a masked grid."""
    total = df.agg(F.count("*").alias("total"))
    hit = F.count_if(F.col(value) > above)
    out = df.groupBy(zone).agg(F.count("*").alias("n_cells"), F.avg(value).alias("mean"), F.max(value).alias("max"), hit.alias("hits")).where(F.col("n_cells") >= least)
    out = out.crossJoin(F.broadcast(total))
    return out.withColumns({"pct_of_zone": 100.0 * F.col("hits") / F.col("n_cells"), "pct_of_grid": 100.0 * F.col("hits") / F.col("total")}).drop("hits", "total")


def severity_summary(df: DataFrame, column: str, hectares: float = 0.09, classes: int = 4) -> DataFrame:
    """Cells, area and share of each class; classes without cells are there with 0."""
    spine = df.sparkSession.range(classes).select(F.col("id").cast("int").alias("class"))
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("class")).agg(F.count("*").alias("cells"))
    out = spine.join(counts, "class", "left").na.fill(0, ["cells"])
    total = F.sum("cells").over(Window.partitionBy())  # `classes` rows
    area = F.col("cells") * hectares
    return out.select("class", "cells", F.round(area, 1).alias("hectares"), F.round(area * 2.471, 1).alias("acres"), F.round(F.try_divide(100.0 * F.col("cells"), total), 1).alias("pct"))


def matched(df: DataFrame, stratum: str, treated: str) -> DataFrame:
    """The treated rows and the untreated ones of strata that have treated ones."""
    strata = df.where(F.col(treated)).select(stratum).distinct()
    return df.join(strata, stratum, "left_semi")


def balance(df: DataFrame, treated: str, layers: Sequence[str]) -> DataFrame:
    """(layer, treated_mean, control_mean): one pass, then unpivoted."""
    t = F.col(treated)
    one = df.agg(*[F.avg(F.when(t if side == "treated" else ~t, F.col(c))).alias(f"{c}|{side}") for c in layers for side in ("treated", "control")])
    pairs = [F.struct(F.lit(c).alias("layer"), F.col(f"`{c}|treated`").alias("treated_mean"), F.col(f"`{c}|control`").alias("control_mean")) for c in layers]
    return one.select(F.inline(F.array(*pairs)))


def difference_in_differences(df: DataFrame, before: str, after: str, treated: Column, control: Column | None = None, group: Sequence[str] = ()) -> DataFrame:
    """Means of both periods for treated and control cells and the estimate."""
    control = ~treated if control is None else control
    t, c = (lambda x, who: F.avg(F.when(who, F.col(x)))), control
    out = df.groupBy(*group).agg(
        t(before, treated).alias("treated_before"), t(after, treated).alias("treated_after"), t(before, c).alias("control_before"), t(after, c).alias("control_after"),
        F.count_if(treated).alias("n_treated"), F.count_if(c).alias("n_control"),
    )
    return out.withColumn("estimate", (F.col("treated_after") - F.col("treated_before")) - (F.col("control_after") - F.col("control_before")))


def difference_by_group(df: DataFrame, before: str, after: str, group: str, control: Column, least: int = 50) -> DataFrame:
    """The estimate of each group of at least `least` cells against one shared control."""
    base = df.where(control).agg(F.avg(F.col(after) - F.col(before)).alias("drift"))
    own = df.where(~control & F.col(group).isNotNull()).groupBy(group).agg(F.count("*").alias("n_cells"), F.avg(F.col(after) - F.col(before)).alias("change")).where(F.col("n_cells") >= least)
    return own.crossJoin(F.broadcast(base)).select(group, "n_cells", (F.col("change") - F.col("drift")).alias("estimate"))


def parallel_trends(df: DataFrame, value: str, treated: Column, year: str, event: int) -> DataFrame:
    """One row: the yearly drift of the gap between treated and control before the event."""
    gap = df.where(F.col(year) < event).groupBy(year).agg((F.avg(F.when(treated, F.col(value))) - F.avg(F.when(~treated, F.col(value)))).alias("gap"))
    return gap.agg(F.regr_slope("gap", year).alias("drift"), F.count("gap").alias("years"))


def cause_profile(df: DataFrame, cause: str, size: str, large: float = 100.0) -> DataFrame:
    """Count, median, mean and largest size by cause. Shares are of all rows,
    those without a cause too; such rows make no group."""
    total = df.agg(F.count("*").alias("total"), F.count_if(F.lower(cause).rlike("missing|undeterm|not specified")).alias("unknown"))
    by = df.where(F.col(cause).isNotNull()).groupBy(F.col(cause).alias("cause"))
    out = by.agg(F.count("*").alias("n"), F.median(size).alias("median"), F.avg(size).alias("mean"), F.max(size).alias("largest"), F.count_if(F.col(size) > large).alias("n_large"))
    out = out.crossJoin(F.broadcast(total))
    return out.select("cause", "n", "median", "mean", "largest", "n_large", (100.0 * F.col("n") / F.col("total")).alias("pct"), (100.0 * F.col("unknown") / F.col("total")).alias("pct_undetermined"))


def predictor_bins(df: DataFrame, predictor: str, severity: str, bins: int = 10, least: int = 50, high: int = 3) -> DataFrame:
    """(bin, predictor_lo, predictor_hi, n, mean_severity, pct_high) over quantile
    bins of the predictor; `spearman(out, "predictor_lo", "pct_high")` tests them."""
    df = df.where(F.col(predictor).isNotNull() & F.col(severity).isNotNull())
    edges = df.agg(F.percentile(predictor, F.array(*[F.lit(i / bins) for i in range(bins + 1)])).alias("edges"))
    edges = edges.select(F.array_distinct("edges").alias("edges")).where("size(edges) > 1")
    inner = F.slice("edges", F.lit(2), F.size("edges") - 2)
    # The edges are one row.
    k = df.crossJoin(F.broadcast(edges)).withColumn("bin", F.size(F.filter(inner, lambda e: e <= F.col(predictor))))
    out = k.groupBy("bin").agg(
        F.min(F.col("edges")[F.col("bin")]).alias("predictor_lo"), F.min(F.col("edges")[F.col("bin") + 1]).alias("predictor_hi"),
        F.count("*").alias("n"), F.avg(severity).alias("mean_severity"), (100.0 * F.avg((F.col(severity) == high).cast("int"))).alias("pct_high"),
    )
    return out.where(F.col("n") >= least)


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row (rho, n, p): rank correlation with average ranks, of a table small
    enough for one task (bins, zones), and its two-sided p by Student's t."""

    def ranked(c: str) -> Column:
        w = Window.orderBy(c)
        return F.rank().over(w) + (F.count("*").over(Window.partitionBy(c)) - 1) / 2

    r = df.select(ranked(a).alias("ra"), ranked(b).alias("rb"))
    one = r.agg(F.when(F.count("*") > 2, correlation("ra", "rb")).alias("rho"), F.count("*").alias("n"))
    t = F.col("rho") * F.sqrt((F.col("n") - 2) / (1 - F.col("rho") * F.col("rho")))
    return one.withColumn("p", F.when(F.abs("rho") > 1 - 1e-12, 0.0).otherwise(student_p(t, F.col("n") - 2)))


def recovery_by_class(df: DataFrame, cell: str, klass: str, year: str, value: str, before: str, least: int = 100, floor: float = 0.05) -> DataFrame:
    """(class, year, n, mean, before, ratio) of classes of at least `least` cells:
    the mean of a year over the mean before, which is over all the class's cells;
    NULL where that isn't above `floor`."""
    cells = df.groupBy(cell, klass).agg(F.max(before).alias("before"))
    base = cells.groupBy(klass).agg(F.count("*").alias("n"), F.avg("before").alias("before")).where(F.col("n") >= least)
    years = df.groupBy(klass, year).agg(F.avg(value).alias("mean"))
    ratio = F.when(F.col("before") > floor, F.try_divide("mean", "before"))
    return years.join(base, klass).select(klass, year, "n", "mean", "before", ratio.alias("ratio"))


def coarsened(df: DataFrame, factor: int, how: str = "avg", values: Sequence[str] = ("elevation",), y: str = "y", x: str = "x") -> DataFrame:
    """Blocks of factor x factor cells; rows and columns that fill none are trimmed."""
    size = df.agg((F.max(y) + 1).alias("ny"), (F.max(x) + 1).alias("nx"))
    d = df.crossJoin(F.broadcast(size)).where((F.col(y) < F.col("ny") - F.col("ny") % factor) & (F.col(x) < F.col("nx") - F.col("nx") % factor))
    f = getattr(F, how)
    return d.groupBy((F.col(y) / factor).cast("int").alias("by"), (F.col(x) / factor).cast("int").alias("bx")).agg(*[f(v).alias(v) for v in values], F.count("*").alias("cells"))


def share(predicate: Column) -> Column:
    """Share of rows that meet a predicate; NULL counts as not."""
    return F.avg(F.coalesce(predicate, F.lit(False)).cast("double"))


def bare_frequency(df: DataFrame, cell: str, value: str, below: float = 0.2) -> DataFrame:
    """How often a cell's valid observations are below a threshold; NULL without any."""
    return df.groupBy(cell).agg(F.try_divide(F.count_if(F.col(value) < below), F.count(value)).alias("frequency"))
