"""Composite indices over a table of entities by indicators.

Indicators are melted to (id, indicator, value), so that one window per
indicator normalises any number of them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from geoloom.functions.sizes import ranked, small

METHODS = ("minmax", "zscore", "rank")


def average_rank(order: Column, part: Sequence[str], value: str) -> Column:
    """Rank where ties share the mean of their ranks."""
    w = Window.partitionBy(*part).orderBy(order)
    return F.rank().over(w) + (F.count("*").over(Window.partitionBy(*part, value)) - 1) / 2


def complete(df: DataFrame, indicators: Sequence[str]) -> list[str]:
    """The indicators without any NULL: one aggregate, read on the driver."""
    row = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in indicators]).first()
    return [c for c in indicators if row[c] == 0]


def melted(df: DataFrame, key: str, indicators: Sequence[str]) -> DataFrame:
    return df.select(key, *[F.col(c).cast("double").alias(c) for c in indicators]).unpivot([key], list(indicators), "indicator", "value")


def normalized(long: DataFrame, key: str, method: str = "minmax", invert: Sequence[str] = (), reference: DataFrame | None = None) -> DataFrame:
    """long with `score`: minmax (0.5 where flat), zscore by the population
    deviation (0 where flat), or rank over n; inverted as 1 - score. Flat is a
    spread under 1e-12. With `reference` (indicator, value), the spread of minmax
    and zscore is that of its rows, so that scores stay when entities are added."""
    if method not in METHODS:
        raise ValueError(f"method is one of {METHODS}")
    w = Window.partitionBy("indicator")
    v = F.col("value")
    stats = {"_lo": F.min("value"), "_hi": F.max("value"), "_mean": F.avg("value"), "_sd": F.stddev_pop("value")}
    if reference is not None and method != "rank":
        # A row for each indicator.
        long = long.join(F.broadcast(reference.groupBy("indicator").agg(*[f.alias(c) for c, f in stats.items()])), "indicator", "left")
        lo, hi, mean, sd = map(F.col, stats)
    else:
        lo, hi, mean, sd = (f.over(w) for f in stats.values())
    if method == "minmax":
        score = F.when(hi - lo >= 1e-12, F.try_divide(v - lo, hi - lo)).when(v.isNotNull(), 0.5)
    elif method == "zscore":
        score = F.when(sd >= 1e-12, F.try_divide(v - mean, sd)).when(v.isNotNull(), 0.0)
    else:
        score = F.when(v.isNotNull(), average_rank(F.asc_nulls_last("value"), ["indicator"], "value") / F.count("value").over(w))
    out = long.withColumn("score", score).drop(*stats)
    return out.withColumn("score", F.when(F.col("indicator").isin(list(invert)), 1 - F.col("score")).otherwise(F.col("score"))) if invert else out


def _weights(indicators: Sequence[str], weights: Mapping[str, float] | None) -> dict[str, float]:
    weights = dict(weights or dict.fromkeys(indicators, 1.0))
    if missing := sorted(set(indicators) - weights.keys()):
        raise ValueError(f"no weight for {missing}")
    total = sum(weights[c] for c in indicators)
    return {c: weights[c] / total for c in indicators}


def composite(df: DataFrame, key: str, indicators: Sequence[str], weights: Mapping[str, float] | None = None, method: str = "minmax", invert: Sequence[str] = (), digits: int | None = 12, reference: DataFrame | None = None) -> DataFrame:
    """(key, composite, rank): weighted sum of scores, NULL if one is NULL, and
    the average rank from the best down, cut to an integer. `reference` has the
    indicators as columns, as df has."""
    w = _weights(indicators, weights)
    long = normalized(melted(df, key, indicators), key, method, invert, None if reference is None else melted(reference, key, indicators))
    weight = F.coalesce(*[F.when(F.col("indicator") == c, F.lit(x)) for c, x in w.items()])
    out = long.groupBy(key).agg(F.when(F.count("score") == len(w), F.sum(F.col("score") * weight)).alias("composite"))
    if digits is not None:
        out = out.withColumn("composite", F.round("composite", digits))
    out = ranked(out, F.desc_nulls_last("composite"), "composite")
    return out.withColumn("rank", F.when(F.col("composite").isNotNull(), F.col("rank").cast("int")))


def dirichlet(spark, indicators: Sequence[str], draws: int = 5000, seed: int = 0, concentration: float = 1.0, around: Mapping[str, float] | None = None) -> DataFrame:
    """(draw, indicator, weight): weights drawn from the simplex, `draws` rows
    an indicator; the table doesn't grow with the data."""
    base = np.full(len(indicators), concentration) if around is None else np.array([around[c] for c in indicators]) * concentration
    w = np.random.default_rng(seed).dirichlet(base, draws)
    rows = [(i, c, float(w[i, j])) for i in range(draws) for j, c in enumerate(indicators)]
    return spark.createDataFrame(rows, "draw int, indicator string, weight double")


def weight_sensitivity(long: DataFrame, key: str, draws: DataFrame, digits: int | None = 3) -> DataFrame:
    """(key, rank, probability, mean_score, score_p05, score_p95) over draws of
    weights; `long` has scores. Ties take the order of the keys."""
    scored = long.join(small(draws), "indicator").groupBy("draw", key).agg(F.round(F.sum(F.col("score") * F.col("weight")), 12).alias("s"))
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("draw").orderBy(F.desc("s"), key)))
    n = draws.select("draw").distinct().count()
    spread = ranked.groupBy(key).agg(F.avg("s").alias("mean_score"), F.percentile("s", F.lit(0.05)).alias("score_p05"), F.percentile("s", F.lit(0.95)).alias("score_p95"))
    out = ranked.groupBy(key, "rank").agg((F.count("*") / n).alias("probability")).join(spread, key)
    if digits is not None:
        out = out.withColumns({c: F.round(c, digits) for c in ("probability", "mean_score", "score_p05", "score_p95")})
    return out


def rank_stability(sensitivity: DataFrame, key: str) -> DataFrame:
    """One row: mean of each entity's most probable rank's probability."""
    return sensitivity.groupBy(key).agg(F.max("probability").alias("p")).agg(F.avg("p").alias("stability"))


def leave_one_out(df: DataFrame, key: str, indicators: Sequence[str], weights: Mapping[str, float] | None = None, method: str = "minmax", invert: Sequence[str] = ()) -> DataFrame:
    """(dropped, key, composite, rank) with each indicator left out in turn, in
    one pass: scores repeat for the dropped ones instead of a loop of jobs."""
    w = _weights(indicators, weights)
    long = normalized(melted(df, key, indicators), key, method, invert)
    weight = F.coalesce(*[F.when(F.col("indicator") == c, F.lit(x)) for c, x in w.items()])
    runs = long.withColumn("weight", weight).withColumn("dropped", F.explode(F.array(*[F.lit(c) for c in indicators]))).where("dropped <> indicator")
    out = runs.groupBy("dropped", key).agg(F.round(F.try_divide(F.sum(F.col("score") * F.col("weight")), F.sum("weight")), 12).alias("composite"))
    return out.withColumn("rank", average_rank(F.desc("composite"), ["dropped"], "composite").cast("int"))


#: The components of adaptive capacity and what they ask.
CAPACITY = {
    "stewardship_authority": "who decides over the land", "cultural_burning": "whether burning as a practice goes on", "crew_capacity": "trained crews within reach",
    "equipment_access": "engines, water and tools", "knowledge_continuity": "knowledge handed on", "mutual_aid": "agreements with neighbours",
    "infrastructure": "roads, power, water", "funding_stability": "years of secured funding",
}


def adaptive_capacity(spark, scores: Mapping[str, float], sources: Mapping[str, str] | None = None, require_source: bool = True) -> DataFrame:
    """(component, score, source, description); unknown components and, unless
    told otherwise, scores without a source are refused."""
    sources = sources or {}
    if unknown := sorted(set(scores) - CAPACITY.keys()):
        raise ValueError(f"unknown components: {unknown}")
    if require_source and (bare := sorted(c for c in scores if not sources.get(c))):
        raise ValueError(f"no source for {bare}")
    return spark.createDataFrame([(c, float(s), sources.get(c), CAPACITY[c]) for c, s in scores.items()], "component string, score double, source string, description string")


def community_weighted(components: DataFrame, weights: Mapping[str, float] | None, weights_source: str | None) -> DataFrame:
    """components with weight and contribution; weights are the community's:
    without them, or without saying whose they are, there is no index."""
    if not weights or not weights_source:
        raise ValueError("an index needs weights and their source")
    names = [r[0] for r in components.select("component").collect()]
    w = _weights(names, weights)
    weight = F.coalesce(*[F.when(F.col("component") == c, F.lit(x)) for c, x in w.items()])
    return components.withColumns({"weight": F.bround(weight, 3), "contribution": F.bround(weight * F.col("score"), 4), "weights_source": F.lit(weights_source)})


def weight_spread(components: DataFrame, draws: DataFrame) -> DataFrame:
    """One row: mean, 5 % and 95 % point, least and most of the index over draws
    of weights (draw, indicator, weight): how far the weights alone move it."""
    by = components.join(small(draws), F.col("component") == F.col("indicator")).groupBy("draw").agg(F.sum(F.col("score") * F.col("weight")).alias("s"))
    p = lambda x: F.percentile("s", F.lit(x))
    return by.agg(F.avg("s").alias("mean"), p(0.05).alias("p05"), p(0.95).alias("p95"), F.min("s").alias("least"), F.max("s").alias("most"))


def hazards(key: str, trends: Mapping[str, DataFrame], value: str = "slope") -> DataFrame:
    """(key, one column a trend): the hazard table of one row a region from
    several trend tables; a region that one of them lacks has NULL there."""
    long = None
    for name, df in trends.items():
        part = df.select(key, F.lit(name).alias("hazard"), F.col(value).cast("double").alias("v"))
        long = part if long is None else long.unionByName(part)
    return long.groupBy(key).pivot("hazard", list(trends)).agg(F.first("v"))


def priority(high_share, recovery) -> Column:
    return F.col(high_share) * (1 - F.least(F.greatest(F.coalesce(F.col(recovery), F.lit(0.0)), F.lit(0.0)), F.lit(1.0)))


def caveats(conditions: Mapping[str, Column], default: str = "none") -> Column:
    """The texts whose conditions hold, joined."""
    text = F.concat_ws("; ", *[F.when(c, F.lit(t)) for t, c in conditions.items()])
    return F.when(text == "", default).otherwise(text)
