"""Cell algebra: spectral indices, classes, normalised composites.

Layers are columns of one row per cell. Statistics of a whole layer take one
aggregate, a single row that is broadcast to a second pass."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoloom.functions.columns import classed, clip, difference_ratio, lookup, unit

#: Edges of severity classes by metric: low, moderate, high begin here.
SEVERITY_EDGES = {"dnbr": (100, 270, 660), "rdnbr": (69, 316, 641)}
BURN_EDGES = (0.1, 0.27, 0.44, 0.66)
#: Fuel model codes by hazard.
FUEL_GROUPS = {0.0: (91, 92, 93, 98, 99), 0.25: (101, 102, 103, 161, 181, 182, 183), 0.5: (104, 121, 122, 141, 142, 162, 184, 185, 186), 0.75: (105, 106, 123, 143, 144, 145, 146, 163, 164, 187, 188, 189, 201), 1.0: (107, 108, 109, 124, 147, 148, 149, 165, 202, 203, 204)}


def ndvi(nir="nir", red="red") -> Column:
    return difference_ratio(nir, red, 1e-9)


def nbr(nir="nir", swir="swir", epsilon: float = 1e-9) -> Column:
    """Normalised burn ratio; epsilon 0 is the variant without guard."""
    return difference_ratio(nir, swir, epsilon)


def ndmi(nir="nir", swir="swir") -> Column:
    return difference_ratio(nir, swir)


def dnbr(pre, post, offset=0.0, scale: float = 1000.0) -> Column:
    """Change of burn ratio, times scale, less the offset of unburned cells."""
    return (F.col(pre) - F.col(post)) * scale - (offset if isinstance(offset, Column) else F.lit(offset))


def rdnbr(pre, post, offset=0.0) -> Column:
    """The change relative to the root of the ratio before."""
    return dnbr(pre, post, offset) / F.sqrt(F.greatest(F.abs(F.col(pre)), F.lit(0.001)))


def dnbr_offset(df: DataFrame, change: str, control: Column) -> DataFrame:
    """One row: the median change of the control cells."""
    return df.agg(F.median(F.when(control, F.col(change))).alias("offset"))


def severity_class(index, metric: str = "dnbr", edges: Sequence[float] | None = None) -> Column:
    return classed(index, edges or SEVERITY_EDGES[metric])


def burn_class(change) -> Column:
    return classed(change, BURN_EDGES)


def fuel_hazard(code) -> Column:
    """Hazard of a fuel model code; NULL for codes of no group."""
    return lookup(code, {c: v for v, codes in FUEL_GROUPS.items() for c in codes})


def fuel_proxy(vegetation, drought=None) -> Column:
    v = F.col(vegetation)
    return v if drought is None else v * (1 - 0.5 * F.col(drought))


def crown_fire_potential(cover="cc", base_height="cbh", density="cbd") -> Column:
    """Geometric mean of cover, lowness of the crown base and bulk density."""
    return F.cbrt(clip(F.col(cover) / 100) * clip(1 - (F.col(base_height) - 2) / 6) * clip(F.col(density) / 0.15))


def recovery_ratio(now, before, floor: float = 0.05) -> Column:
    return clip(F.when(F.col(before) > floor, F.try_divide(F.col(now), F.col(before))), 0, 1.5)


def wui_class(density, vegetation, dense: float = 6.17, vegetated: float = 0.5) -> Column:
    """2 intermix, 1 interface, 0 neither."""
    d, v = F.col(density), F.col(vegetation)
    return F.when(d.isNull() | v.isNull(), None).when((d >= dense) & (v >= vegetated), 2).when(d >= dense, 1).otherwise(0)


def with_bounds(df: DataFrame, columns: Sequence[str], lo: float | None = 0.02, hi: float | None = 0.98, exact: bool = True) -> DataFrame:
    """df with <c>_lo and <c>_hi of each column: its quantiles, or extremes for
    None. Exact quantiles count distinct values; exact=False bounds memory."""
    aggs = []
    for c in columns:
        for name, q, extreme in ((f"{c}_lo", lo, F.min), (f"{c}_hi", hi, F.max)):
            how = extreme(c) if q is None else (F.percentile(c, F.lit(q)) if exact else F.percentile_approx(c, q, 100_000))
            aggs.append(how.alias(name))
    return df.crossJoin(F.broadcast(df.agg(*aggs)))


def normalized(df: DataFrame, columns: Mapping[str, bool], lo: float | None = 0.02, hi: float | None = 0.98, exact: bool = True) -> DataFrame:
    """df with <c>_n of each column as 0 to 1; the mapped flag inverts."""
    out = with_bounds(df, list(columns), lo, hi, exact)
    out = out.withColumns({f"{c}_n": unit(c, f"{c}_lo", f"{c}_hi", flip) for c, flip in columns.items()})
    return out.drop(*[f"{c}_{e}" for c in columns for e in ("lo", "hi")])


def minmax(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """df with <c>_m = (c - min) / (max - min + 1e-9)."""
    out = with_bounds(df, columns, None, None)
    out = out.withColumns({f"{c}_m": (F.col(c) - F.col(f"{c}_lo")) / (F.col(f"{c}_hi") - F.col(f"{c}_lo") + 1e-9) for c in columns})
    return out.drop(*[f"{c}_{e}" for c in columns for e in ("lo", "hi")])


def erosion_susceptibility(slope_unit, burn, runoff) -> Column:
    return clip(0.4 * F.col(slope_unit) + 0.4 * F.col(burn) + 0.2 * F.col(runoff))


def soil_vulnerability(organic_unit, sand_unit, slope_unit) -> Column:
    return clip(0.4 * (1 - F.col(organic_unit)) + 0.3 * F.col(sand_unit) + 0.3 * F.col(slope_unit))


def resilience_index(erosion, soil, vegetation=None) -> Column:
    base = 0.5 * F.col(erosion) + 0.5 * F.col(soil)
    return 1 - clip(base if vegetation is None else base * (1 - 0.3 * F.col(vegetation)))


def degradation(bare, trend_inverted, organic_inverted) -> Column:
    return (F.col(bare) + F.col(trend_inverted) + F.col(organic_inverted)) / 3


def weighted_mean(parts: Mapping[str, float]) -> Column:
    """Weighted mean of the columns that aren't NULL; their weights add up to 1."""
    top = sum((F.coalesce(F.col(c) * w, F.lit(0.0)) for c, w in parts.items()), F.lit(0.0))
    held = sum((F.when(F.col(c).isNotNull(), w).otherwise(0.0) for c, w in parts.items()), F.lit(0.0))
    return F.try_divide(top, held)


def transfer_weight(parts: Sequence[str], least: float = 0.05, most: float = 1.0) -> Column:
    """Ease of transfer by the mean of the normalised parts that are there."""
    if not parts:
        raise ValueError("transfer_weight needs a burn or a vegetation layer")
    return clip(least + (most - least) * weighted_mean({p: 1.0 for p in parts}), least, most)


def landscape_function(parts: Mapping[str, float]) -> Column:
    return clip(weighted_mean(parts))


def prefire_condition(fuel, dryness, crown, slope, weights: Sequence[float] = (0.3, 0.3, 0.25, 0.15)) -> Column:
    total = sum(weights)
    return sum((F.col(c) * (w / total) for c, w in zip((fuel, dryness, crown, slope), weights)), F.lit(0.0))


def delivery_risk(connectivity_unit, erosion) -> Column:
    return clip(F.col(connectivity_unit) * F.col(erosion))


def post_fire_vulnerability(vulnerability, burn, recovery=None) -> Column:
    b = 0.5 * F.col(burn)
    return clip(F.col(vulnerability) + (b if recovery is None else b * (1 - clip(F.col(recovery)))))


def stratum(severity: Column, slope: Column) -> Column:
    return severity * 10 + slope
