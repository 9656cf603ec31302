"""Aggregates and windows over time. Order is always explicit."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from geoloom.functions.columns import water_year
from geoloom.functions.sizes import running, small


def annual(df: DataFrame, keys: Sequence[str], day: str, value: str, complete: int = 350, months: Sequence[int] = (6, 7, 8)) -> DataFrame:
    """(keys, wy, total, mean, season_mean, n) of water years with more than
    `complete` observations; season_mean is of the given months."""
    out = df.groupBy(*keys, water_year(day).alias("wy")).agg(
        F.sum(value).alias("total"), F.avg(value).alias("mean"), F.avg(F.when(F.month(day).isin(*months), F.col(value))).alias("season_mean"), F.count(value).alias("n")
    )
    return out.where(F.col("n") > complete)


def resampled(df: DataFrame, day: str, value: str, unit: str = "MM") -> DataFrame:
    """(period, total, mean, n) of every period between the first and the last;
    periods without rows have total 0, n 0 and mean NULL."""
    step = {"MM": "INTERVAL 1 MONTH", "YEAR": "INTERVAL 1 YEAR", "DAY": "INTERVAL 1 DAY"}[unit]
    start = F.to_date(F.date_trunc({"MM": "month", "YEAR": "year", "DAY": "day"}[unit], F.col(day)))
    sums = df.groupBy(start.alias("period")).agg(F.sum(value).alias("total"), F.avg(value).alias("mean"), F.count(value).alias("n"))
    spine = df.agg(F.min(start).alias("lo"), F.max(start).alias("hi")).where("lo IS NOT NULL").select(F.explode(F.sequence("lo", "hi", F.expr(step))).alias("period"))
    return spine.join(sums, "period", "left").na.fill(0, ["total", "n"])


def days_over(df: DataFrame, day: str, value: str, share: float = 0.9, baseline: tuple[int, int] | None = None) -> DataFrame:
    """(year, days, threshold): observations strictly over the baseline years'
    quantile, by calendar year; years without any are there with 0."""
    base = df if baseline is None else df.where(F.year(day).between(*baseline))
    limit = base.agg(F.percentile(value, F.lit(share)).alias("threshold"))
    return df.crossJoin(F.broadcast(limit)).groupBy(F.year(day).alias("year")).agg(F.count_if(F.col(value) > F.col("threshold")).alias("days"), F.max("threshold").alias("threshold"))


def season_metrics(df: DataFrame, site: str, day: str, value: str, above: float = 0.1, least: int = 200) -> DataFrame:
    """Peak, day of the peak (the first), onset and end of the season, as days
    since 1 October, and its days, of water years of at least `least` valid observations."""
    d = df.where(F.col(value).isNotNull()).withColumn("wy", water_year(day)).withColumn("since", F.datediff(F.col(day), F.make_date(F.col("wy") - 1, F.lit(10), F.lit(1))))
    there = F.when(F.col(value) > above, F.col("since"))
    out = d.groupBy(site, "wy").agg(
        F.count("*").alias("n"), F.max(value).alias("peak"), F.max_by("since", F.struct(F.col(value), -F.col("since"))).alias("peak_day"), F.min(there).alias("onset"), F.max(there).alias("end"), F.count_if(F.col(value) > above).alias("season_days")
    )
    return out.where(F.col("n") >= least)


def rolling(df: DataFrame, keys: Sequence[str], order: str, value: str, rows: int, how: str = "sum") -> DataFrame:
    """df with `rolled` over the last `rows` rows; NULL until they are full."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(-(rows - 1), 0)
    return df.withColumn("rolled", F.when(F.count(value).over(w) == rows, getattr(F, how)(value).over(w)))


def low_flow(df: DataFrame, site: str, day: str, value: str, least: int = 330, rows: int = 7, share: float = 0.1) -> DataFrame:
    """(site, wy, n, low, low_day, days_below, mean): least mean of 7 rows and its first
    date, and days below the site's quantile of all its rows."""
    limit = df.where(F.col(value).isNotNull()).groupBy(site).agg(F.percentile(value, F.lit(share)).alias("limit"))
    d = df.where(F.col(value).isNotNull()).withColumn("wy", water_year(day)).join(limit, site)
    d = rolling(d, (site, "wy"), day, value, rows, "avg")
    d = d.withColumn("rolled", F.round("rolled", 9))
    out = d.groupBy(site, "wy").agg(
        F.count("*").alias("n"), F.min("rolled").alias("low"), F.min_by(day, F.when(F.col("rolled").isNotNull(), F.struct("rolled", day))).alias("low_day"), F.count_if(F.col(value) < F.col("limit")).alias("days_below"), F.avg(value).alias("mean")
    )
    return out.where(F.col("n") >= least)


def long_records(df: DataFrame, site: str, day: str, years: float = 25, gap: float = 0.1) -> DataFrame:
    """The rows of sites whose record spans enough years with few enough gaps."""
    span = F.datediff(F.max(day), F.min(day)) + 1
    good = df.groupBy(site).agg(span.alias("span"), F.count_distinct(day).alias("n")).where((F.col("span") / 365.25 >= years) & (1 - F.col("n") / F.col("span") <= gap))
    return df.join(good, site, "left_semi")


def progression(df: DataFrame, ts: str, value: str, lon: str, lat: str) -> DataFrame:
    """Daily count, mean position, mean, largest and total value, running sums
    and the shift of the mean position in km. The windows run over days only."""
    out = df.groupBy(F.to_date(ts).alias("day")).agg(
        F.count("*").alias("detections"), F.avg(lon).alias("lon"), F.avg(lat).alias("lat"), F.avg(value).alias("mean"), F.max(value).alias("largest"), F.sum(value).alias("total")
    )
    w = Window.orderBy("day")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    dx = (F.col("lon") - F.lag("lon").over(w)) * 111.0 * F.cos(F.radians("lat"))
    dy = (F.col("lat") - F.lag("lat").over(w)) * 111.0
    return out.withColumns({"running": F.sum("detections").over(run), "running_total": F.sum("total").over(run), "shift_km": F.sqrt(dx * dx + dy * dy)})


def rotation(df: DataFrame, year: str, area: str, total_area: float, period: int | None = None) -> DataFrame:
    """One row: burned area, years (given, or from the first to the last), fires'
    years, the rotation in years, infinite where nothing burned, and the share
    burned in percent, in all and a year."""
    years = F.lit(period) if period else F.max(year) - F.min(year) + 1
    out = df.agg(F.coalesce(F.sum(area), F.lit(0.0)).alias("burned"), years.alias("period"), F.count_if(F.col(area) > 0).alias("active_years"))
    out = out.withColumn("rotation", F.coalesce(F.try_divide(F.col("period"), F.col("burned") / total_area), F.lit(float("inf"))))
    return out.withColumn("pct_burned", 100.0 * F.col("burned") / total_area).withColumn("annual_pct", F.try_divide("pct_burned", "period"))


def by_year(df: DataFrame, year: str, area: str, span: tuple[int, int]) -> DataFrame:
    """(year, total): the sum of each year of a span; 0 where there is none."""
    spine = df.sparkSession.range(span[0], span[1] + 1).select(F.col("id").cast("int").alias("year"))
    return spine.join(df.groupBy(F.col(year).cast("int").alias("year")).agg(F.sum(area).alias("total")), "year", "left").na.fill(0.0, ["total"])


def labelled(df: DataFrame, day: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """The rows between partial dates, both included: '2010' is its whole year,
    '2010-06' its month."""
    if start:
        df = df.where(F.col(day) >= F.lit(f"{start}-01-01"[:10] if len(start) == 4 else f"{start}-01"[:10]).cast("date"))
    if end:
        first = F.lit(f"{end}-01-01"[:10] if len(end) == 4 else f"{end}-01"[:10]).cast("date")
        after = F.add_months(first, 12) if len(end) == 4 else F.add_months(first, 1) if len(end) == 7 else F.date_add(first, 1)
        df = df.where(F.col(day) < after)
    return df


def era_comparison(observed, reference) -> Column:
    """In words how an observed rotation compares with a reference."""
    ratio = F.try_divide(observed, reference)
    return F.when(ratio >= 3, "far longer").when(ratio >= 1.5, "longer").when(ratio >= 0.67, "similar").otherwise("shorter")


def climatology(df: DataFrame, day: str, value: str) -> DataFrame:
    """(month, day_of_month, mean, sd) over the years."""
    return df.groupBy(F.month(day).alias("month"), F.dayofmonth(day).alias("day_of_month")).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"))


def percentile_of_score(base: DataFrame, rows: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """rows with the share, in percent, of base values strictly below theirs
    (within the same keys). Both sides sort once: no pair of rows is formed;
    without keys, ranges of values are summed up instead of a window of all."""
    if not keys:
        return _percentile_of_all(base, rows, value)
    both = base.select(*keys, F.col(value), F.lit(0).alias("is_row")).unionByName(rows.withColumn("is_row", F.lit(1)), allowMissingColumns=True)
    part = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    known = F.lit(1) - F.col("is_row")
    up_to = F.sum(known).over(part.orderBy(value))
    equal = F.sum(known).over(Window.partitionBy(*keys, value))
    out = both.withColumn("percentile", F.try_divide(100.0 * (up_to - equal), F.sum(known).over(part)))
    return out.where("is_row = 1").drop("is_row")


def _percentile_of_all(base: DataFrame, rows: DataFrame, value: str) -> DataFrame:
    counts = rows.select(F.col(value), F.lit(0).alias("_n")).unionByName(base.select(F.col(value), F.lit(1).alias("_n"))).where(F.col(value).isNotNull()).groupBy(value).agg(F.sum("_n").alias("_n"))
    upto = running(counts, F.col(value), "sum", "_n", "_upto", "percentile").select(F.col(value).alias("_v"), (F.col("_upto") - F.col("_n")).alias("_below"))
    total = base.agg(F.count("*").alias("_total"))
    out = rows.join(upto, F.col(value) == F.col("_v"), "left").crossJoin(F.broadcast(total))  # one row
    below = F.when(F.col(value).isNotNull(), F.col("_below")).otherwise(0)
    return out.withColumn("percentile", F.try_divide(100.0 * below, F.col("_total"))).drop("_v", "_below", "_total")


def ensemble_delta(df: DataFrame, model: str, value: str, past: Column, future: Column, relative: bool = False) -> DataFrame:
    """One row: mean, median, range, spread and agreement in sign of the models' changes."""
    by = df.groupBy(model).agg(F.avg(F.when(past, F.col(value))).alias("p"), F.avg(F.when(future, F.col(value))).alias("f"))
    change = F.try_divide(F.col("f") - F.col("p"), F.col("p")) * 100 if relative else F.col("f") - F.col("p")
    c = by.select(change.alias("c")).where("c IS NOT NULL")
    return c.agg(F.avg("c").alias("mean"), F.median("c").alias("median"), F.min("c").alias("least"), F.max("c").alias("most"), F.stddev_pop("c").alias("spread"), F.count("*").alias("models"), (F.every(F.col("c") > 0) | F.every(F.col("c") < 0)).alias("agree"))


def emergence(df: DataFrame, keys: Sequence[str], year: str, value: str, baseline: tuple, n_sigma: float = 2.0, persist: int = 5, contiguous: bool = False) -> DataFrame:
    """(keys, emerged): the first of `persist` rows in a row that leave the
    baseline's mean by more than n_sigma sample deviations; NULL if none does,
    the baseline has fewer than 10 values or doesn't vary. Rows without a value
    are left out first, so that they end no run. With `contiguous`, a
    run also ends where years are missing."""
    known = df.where(F.col(value).isNotNull())
    base = known.where(F.col(year).between(*baseline)).groupBy(*keys).agg(F.avg(value).alias("mu"), F.stddev_samp(value).alias("sd"), F.count(value).alias("nb"))
    w, d = Window.partitionBy(*keys).orderBy(year), known.join(base, list(keys))
    out = F.coalesce((F.abs(F.col(value) - F.col("mu")) > n_sigma * F.col("sd")) & (F.col("nb") >= 10) & (F.col("sd") > 0), F.lit(False))
    d = d.withColumn("out", out).withColumn("nth", F.row_number().over(w))
    island = F.col("nth") - F.row_number().over(Window.partitionBy(*keys, "out").orderBy(year))
    d = d.withColumn("island", island)
    run = [*keys, "island"]
    if contiguous:
        d = d.withColumn("block", F.col(year) - F.col("nth"))
        run.append("block")
    first = d.where("out").groupBy(*run).agg(F.count("*").alias("n"), F.sort_array(F.collect_list(year)).alias("ys")).where(F.col("n") >= persist)
    first = first.groupBy(*keys).agg(F.min(F.element_at("ys", persist)).alias("last"))
    return df.select(*keys).distinct().join(first, list(keys), "left").select(*keys, (F.col("last") - (persist - 1)).alias("emerged"))


def nearest_in_time(df: DataFrame, keys: Sequence[str], day: str, dates: DataFrame, tolerance: int | None = None) -> DataFrame:
    """For each key and wanted date, the row nearest in time; the earlier one on
    ties. `dates` is (wanted), a short list: it is broadcast."""
    pairs = df.crossJoin(small(dates))
    away = F.abs(F.datediff(F.col(day), F.col("wanted")))
    if tolerance is not None:
        pairs = pairs.where(away <= tolerance)
    rest = [c for c in df.columns if c not in keys]
    best = pairs.groupBy(*keys, "wanted").agg(F.min_by(F.struct(*rest), F.struct(away, F.col(day))).alias("b"))
    return best.select(*keys, "wanted", "b.*")


def trend_slope(value: str, ts) -> Column:
    """Least-squares slope per year of 365.25 days."""
    return F.regr_slope(value, F.unix_micros(ts) / 3.15576e13)


def islands(df: DataFrame, keys: Sequence[str], order: str, flag: Column) -> DataFrame:
    """Runs of rows whose flag holds: (keys, start, end, n)."""
    d = df.withColumn("f", F.coalesce(flag, F.lit(False)))
    w = Window.partitionBy(*keys).orderBy(order)
    d = d.withColumn("g", F.row_number().over(w) - F.row_number().over(Window.partitionBy(*keys, "f").orderBy(order)))
    return d.where("f").groupBy(*keys, "g").agg(F.min(order).alias("start"), F.max(order).alias("end"), F.count("*").alias("n")).drop("g")
