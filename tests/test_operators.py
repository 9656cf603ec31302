"""Analytic fixtures and edge cases of the operators."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from geoloom.functions import columns as K
from geoloom.operators import composite as C
from geoloom.operators import cube, hydro as H, raster as R, spatial as S, temporal as T, trends as N, window2d as V, zonal as Z

CELL = "cell bigint, y int, x int, elevation double"


def dem(spark, z):
    ny, nx = z.shape
    rows = [(int(i * nx + j), i, j, None if math.isnan(z[i, j]) else float(z[i, j])) for i in range(ny) for j in range(nx)]
    return spark.createDataFrame(rows, CELL)


def valley(n=16):
    y, x = np.mgrid[:n, :n]
    z = 1000 - 2.0 * y + 1.5 * np.abs(x - n // 2)
    z[n // 2, n // 2] -= 25
    return z


def test_half_burned_scene(spark):
    rows = [(i, 0.35, 0.10, 0.20 if i < 50 else 0.35, 0.30 if i < 50 else 0.10) for i in range(100)]
    d = spark.createDataFrame(rows, "cell int, n1 double, s1 double, n2 double, s2 double").select("cell", R.nbr("n1", "s1", 0).alias("pre"), R.nbr("n2", "s2", 0).alias("post"))
    m = d.groupBy((F.col("cell") < 50).alias("burned")).agg(F.avg(R.dnbr("pre", "post")).alias("m"))
    got = {r.burned: r.m for r in m.collect()}
    assert got[True] > 500 and abs(got[False]) < 1


def test_classes_and_nulls(spark):
    d = spark.createDataFrame([(50.0,), (200.0,), (400.0,), (900.0,), (None,), (float("nan"),)], "v double").withColumn("v", K.clean("v"))
    assert [r[0] for r in d.select(R.severity_class("v")).collect()] == [0, 1, 2, 3, None, None]
    s = {r["class"]: r.pct for r in Z.severity_summary(d.select(R.severity_class("v").alias("k")), "k").collect()}
    assert sum(s.values()) == 100
    assert [r.cells for r in Z.severity_summary(d.limit(0).select(R.severity_class("v").alias("k")), "k").collect()] == [0] * 4


def test_fuel_and_crown(spark):
    d = spark.createDataFrame([(91,), (101,), (104,), (105,), (204,), (7,)], "c int")
    assert [r[0] for r in d.select(R.fuel_hazard("c")).collect()] == [0, 0.25, 0.5, 0.75, 1, None]
    c = spark.createDataFrame([(80.0, 2.0, 0.15), (80.0, 9.0, 0.15), (80.0, 2.0, 0.01)], "cc double, cbh double, cbd double")
    a, b, e = [r[0] for r in c.select(R.crown_fire_potential()).collect()]
    assert a > 0.9 and b < 0.1 and e < 0.5


def test_weights_renormalise(spark):
    d = spark.createDataFrame([(0.5, None), (0.5, 1.0)], "a double, b double")
    assert [round(r[0], 6) for r in d.select(R.weighted_mean({"a": 3.0, "b": 1.0})).collect()] == [0.5, 0.625]
    with pytest.raises(ValueError):
        R.transfer_weight([])


def test_flood_by_heap_and_by_relaxation(spark):
    z = valley(12)
    z[0:2, 3] = np.nan
    d = dem(spark, z)
    heap = {r.cell: r.filled for r in H.fill_depressions(d).collect()}
    relaxed = {r.cell: r.filled for r in H.fill_by_relaxation(d).collect()}
    assert relaxed.keys() == {k for k, v in heap.items() if v is not None and not math.isnan(v)}
    assert all(heap[k] == v for k, v in relaxed.items())
    assert all(heap[r.cell] >= r.elevation for r in d.where("elevation IS NOT NULL").collect())


def test_flow_mass_balance(spark):
    d = H.fill_depressions(dem(spark, valley()), epsilon=1e-6).withColumnRenamed("filled", "elevation")
    e = H.flow_edges(H.flow_direction(d)).join(d.select("cell", "x"), "cell")
    a = H.accumulate(e).join(e, "cell")
    assert a.where("next IS NULL").agg(F.sum("accumulation")).first()[0] == 256
    assert a.where("x = 8").agg(F.max("accumulation")).first()[0] > 5 * a.where("x IN (2, 13)").agg(F.avg("accumulation")).first()[0]
    down = H.downstream(a, F.col("dist"), F.col("accumulation") >= 20).join(a.select("cell", "accumulation"), "cell")
    assert down.where("accumulation >= 20 AND cost <> 0").count() == 0


def test_connectivity_is_higher_on_bare_ground(spark):
    d = H.fill_depressions(dem(spark, valley(10)), epsilon=1e-6).withColumnRenamed("filled", "elevation")
    e = H.flow_edges(H.flow_direction(d)).withColumn("slope", F.lit(11.3))
    bare, green = (H.connectivity(e.withColumn("impedance", F.lit(w)), 30).agg(F.avg("ic")).first()[0] for w in (0.9, 0.1))
    assert bare > green


def test_moving_window_against_brute_force(spark):
    rng = np.random.default_rng(5)
    z = rng.random((9, 7))
    z[2, 3] = np.nan
    got = {(r.y, r.x): r.elevation_mean for r in V.box_mean(dem(spark, z), "elevation", 2).collect()}
    for i in range(9):
        for j in range(7):
            assert got[i, j] == pytest.approx(np.nanmean(z[max(0, i - 2) : i + 3, max(0, j - 2) : j + 3]))


def test_reflected_border(spark):
    z = np.arange(12.0).reshape(3, 4)
    got = {(r.y, r.x): r.elevation for r in V.reflected(dem(spark, z), 1).collect()}
    want = np.pad(z, 1, mode="symmetric")
    assert len(got) == want.size and all(got[i - 1, j - 1] == want[i, j] for i in range(5) for j in range(6))


def test_trend_recovers_slope_despite_outliers(spark):
    rng = np.random.default_rng(0)
    y = 0.04 * np.arange(34) + rng.normal(0, 0.3, 34)
    y[5] += 12
    y[20] -= 9
    rows = [("a", 1991 + i, float(v)) for i, v in enumerate(y)] + [("short", 1991, 1.0)]
    d = spark.createDataFrame(rows, "k string, t int, v double")
    fit = {r.k: r for r in N.trend_table(d, ["k"], "t", "v", 10.0).collect()}
    assert abs(fit["a"].slope - 0.4) < 0.15 and fit["a"].lo <= fit["a"].slope <= fit["a"].hi and fit["short"].slope is None
    sql = {r.k: r for r in N.theil_sen(d, ["k"], "t", "v", 10.0).collect()}
    assert sql["a"].slope == pytest.approx(fit["a"].slope) and sql["short"].slope is None
    z = N.mann_kendall(d, ["k"], "t", "v").first().z
    assert N.two_sided(z) == pytest.approx(fit["a"].p_raw)


def test_autocorrelation_correction_cuts_false_positives():
    rng = np.random.default_rng(1)
    raw = fixed = 0
    for _ in range(150):
        e = rng.normal(size=50)
        for i in range(1, 50):
            e[i] += 0.7 * e[i - 1]
        raw += N.mk_test(e)["p"] < 0.05
        fixed += N.mk_test(e, True)["p"] < 0.05
    assert fixed < 0.75 * raw


def test_special_functions():
    assert N.digamma(1.0) == pytest.approx(-0.5772156649015329, abs=1e-10)
    assert N.gamma_cdf(2.0, 1.0) == pytest.approx(1 - math.exp(-2))
    # Whole shapes have a closed form: 1 - exp(-x) times the sum of x**i / i!.
    x = np.array([0.0, 0.3, 2.0, 4.0, 9.0, 30.0])
    for k in (1, 3, 6):
        assert N.gamma_cdf(x, float(k)) == pytest.approx([1 - math.exp(-v) * sum(v**i / math.factorial(i) for i in range(k)) for v in x], abs=1e-13)
    x = np.random.default_rng(2).gamma(2.0, 3.0, 20_000)
    k, s = N.gamma_fit(x)
    assert k == pytest.approx(2, abs=0.1) and s == pytest.approx(3, abs=0.2)


def test_drought_indices(spark):
    rng = np.random.default_rng(3)
    rows, i = [], 0
    for year in range(1981, 2021):
        for m in range(1, 13):
            p = float(rng.gamma(2, 20)) * (0.35 if year == 2016 else 1)
            rows.append(("a", f"{year}-{m:02d}-01", p, 25.0 * i / 480))
            i += 1
    d = spark.createDataFrame(rows, "s string, m string, p double, e double").withColumn("m", F.to_date("m"))
    z = N.spi(d, ["s"], "m", "p", 3)
    mean, sd = z.agg(F.avg("z"), F.stddev("z")).first()
    assert abs(mean) < 0.25 and 0.75 < sd < 1.3
    assert z.where("year(m) = 2016 AND month(m) > 3").agg(F.avg("z")).first()[0] < -0.8
    dry = N.spei(d, ["s"], "m", "p", "e", 3).where("year(m) > 2010").agg(F.avg("z")).first()[0]
    assert dry < z.where("year(m) > 2010").agg(F.avg("z")).first()[0] - 0.05  # the demand grows


def test_drought_probabilities_of_known_distributions():
    rng = np.random.default_rng(5)
    n = 40_000
    month, base = np.arange(n) % 12 + 1, np.ones(n, bool)
    p = rng.random(n)
    rain = np.where(p < 0.2, 0.0, -30 * np.log((1 - p) / 0.8))  # a fifth of zeros, else exponential
    got = N.spi_probability(rain, base, month)
    assert np.abs(got[p >= 0.2] - p[p >= 0.2]).max() < 0.03 and np.abs(got[p < 0.2] - 0.1).max() < 0.01
    balance = 5 + 10 * (p / (1 - p)) ** (1 / 4)  # log-logistic of shape 4
    assert np.abs(N.spei_probability(balance, base, month) - p).max() < 0.03
    few = N.spi_probability(rain[:100], base[:100], month[:100])
    assert np.isnan(few).all() and np.isnan(N.spei_probability(np.ones(300), base[:300], month[:300])).all()


def test_recovery_by_class_is_the_ratio_of_means(spark):
    # Two cells: 0.1 to 0.2 and 0.9 to 0.9; the ratio of the means is 1.1, the mean of the ratios 1.5.
    rows = [(1, 0, 2001, 0.2, 0.1), (2, 0, 2001, 0.9, 0.9), (2, 0, 2002, 0.8, 0.9), (3, 1, 2001, 0.5, 0.5), (4, 2, 2001, 0.5, 0.01), (5, 2, 2001, 0.5, None)]
    d = spark.createDataFrame(rows, "cell int, class int, year int, v double, b double")
    got = {(r["class"], r.year): (r.n, r.ratio) for r in Z.recovery_by_class(d, "cell", "class", "year", "v", "b", least=2).collect()}
    assert got == {(0, 2001): (2, pytest.approx(1.1)), (0, 2002): (2, pytest.approx(1.6)), (2, 2001): (2, None)}


def test_a_missing_year_ends_no_run(spark):
    rows = [("a", y, float(y % 2)) for y in range(1991, 2011)] + [("a", y, None if y == 2013 else 9.0) for y in range(2011, 2017)]
    d = spark.createDataFrame(rows, "s string, y int, v double")
    assert T.emergence(d, ["s"], "y", "v", (1991, 2010), 2.0, 5).first().emerged == 2012


def test_flat_within_noise_and_a_reference(spark):
    long = spark.createDataFrame([(1, "a", 0.1 + 0.2), (2, "a", 0.3), (1, "b", 1.0), (2, "b", 3.0)], "id int, indicator string, value double")
    got = {(r.id, r.indicator): r.score for r in C.normalized(long, "id", "zscore").collect()}
    assert got[1, "a"] == got[2, "a"] == 0 and got[2, "b"] == 1
    ref = spark.createDataFrame([("a", 0.0), ("a", 1.0), ("b", 0.0), ("b", 10.0)], "indicator string, value double")
    assert {(r.id, r.indicator): round(r.score, 9) for r in C.normalized(long, "id", "minmax", reference=ref).collect()} == {(1, "a"): 0.3, (2, "a"): 0.3, (1, "b"): 0.1, (2, "b"): 0.3}


def test_distance_in_kilometres_keeps_lonely_assets(spark):
    cells = spark.createDataFrame([(10.0, 60.0, 1.0), (10.01, 60.0, 5.0)], "x double, y double, h double")
    a = spark.createDataFrame([(1, 10.0, 60.0), (2, 12.0, 60.0)], "id int, px double, py double")
    got = {r.id: r.exposure for r in S.distance_weighted(a, "id", "px", "py", cells, "h", (2.0,), degrees=True).collect()}
    w = math.exp(-0.01 * 111 * math.cos(math.radians(60)) / 2)
    assert got == {1: pytest.approx((1 + 5 * w) / (1 + w)), 2: None}


def test_repeated_cells_are_not_broadcast(spark, tmp_path):
    rng = np.random.default_rng(3)
    spark.createDataFrame([(float(i % 40), float(i // 40), float(i % 7)) for i in range(4000)], "x double, y double, h double").write.parquet(f"{tmp_path}/c")
    places = [(i, float(x), float(y)) for i, (x, y) in enumerate(rng.uniform(-6, 30, (60, 2)))]
    cells, a = spark.read.parquet(f"{tmp_path}/c"), spark.createDataFrame([*places, (60, None, 1.0), (61, 900.0, 1.0)], "id int, px double, py double")
    d = S.distance_weighted(a, "id", "px", "py", cells, "h", (0.8, 1.5))
    plan = d._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin [bx") == 2 and "BroadcastHashJoin [bx" not in plan
    got = {(r.id, r.decay): r.exposure for r in d.collect()}
    assert len(got) == 124 and all(got[i, k] is None for i in (60, 61) for k in (0.8, 1.5))
    at = [(float(i % 40), float(i // 40), float(i % 7)) for i in range(4000)]
    for i, x, y in places:
        for k in (0.8, 1.5):
            near = [(h, math.exp(-math.hypot(x - cx, y - cy) / k)) for cx, cy, h in at if math.hypot(x - cx, y - cy) <= 3 * k]
            assert got[i, k] == (pytest.approx(sum(h * w for h, w in near) / sum(w for _, w in near)) if near else None)


def test_whole_table_ranks_and_q_values(spark):
    from geoloom.functions import sizes

    rng = np.random.default_rng(6)
    v = rng.integers(0, 300, 2000) / 1000
    d = spark.createDataFrame([(i, float(x)) for i, x in enumerate(v)] + [(2000, None)], "id int, p double").repartition(5)
    got = {r.id: r.rank for r in sizes.ranked(d, F.asc_nulls_last("p"), "p").collect()}
    want = N.ranks(v)
    assert all(got[i] == want[i] for i in range(2000)) and got[2000] == 2001
    q = {r.id: r.q for r in N.fdr(d).collect()}
    order = np.argsort(v, kind="stable")
    raw = np.minimum.accumulate((v[order] * 2000 / np.arange(1, 2001))[::-1])[::-1]
    assert q[2000] is None and all(q[int(i)] == pytest.approx(min(x, 1)) for i, x in zip(order, raw))
    pct = {r.id: r.percentile for r in T.percentile_of_score(d.select("p"), d, "p").collect()}
    assert all(pct[i] == pytest.approx(100 * (v < v[i]).sum() / 2001) for i in range(0, 2000, 50))


def test_polygons_join_alike_by_broadcast_and_by_tiles(spark, monkeypatch):
    rng = np.random.default_rng(7)
    shapes = S.polygons(spark, {f"p{i}": [(x, y), (x + 3, y), (x + 1, y + 2)] for i, (x, y) in enumerate(rng.random((30, 2)) * 20)})
    points = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(rng.random((300, 2)) * 22)], "id int, px double, py double")
    one = {(r.id, r.name) for r in S.points_in_polygons(points, "px", "py", shapes, "left").collect()}
    monkeypatch.setattr(S, "is_small", lambda df: False)
    assert {(r.id, r.name) for r in S.points_in_polygons(points, "px", "py", shapes, "left").collect()} == one and len(one) > 300


def test_staged_tables_are_deleted(spark):
    import os

    from geoloom.functions import lineage

    folder = lineage.shared_dir(spark).removeprefix("file://") + "/geoloom"
    before = set(os.listdir(folder)) if os.path.exists(folder) else set()
    edges = spark.createDataFrame([(i, i + 1 if i < 40 else None) for i in range(41)], "cell int, next int")
    assert H.accumulate(edges).where("cell = 40").first().accumulation == 41
    assert len(set(os.listdir(folder)) - before) == 1  # what the result reads


def test_recovery_curve():
    t = np.arange(10.0)
    y = 0.72 - (0.72 - 0.18) * np.exp(-0.35 * t)
    fit = N.recovery_curve(t, y)
    assert fit["a"] == pytest.approx(0.72, abs=1e-3) and fit["rate"] == pytest.approx(0.35, abs=1e-3) and fit["r2"] > 0.999
    assert not N.recovery_curve(t[:2], y[:2])["converged"]
    assert all(fit[c] < 1e-3 for c in ("a_se", "rate_se", "start_se"))
    noise = np.random.default_rng(3).normal(0, 0.02, (200, 10))
    fits = [N.recovery_curve(t, y + e) for e in noise]
    for c in ("a", "rate", "start"):
        spread = np.std([f[c] for f in fits])
        assert np.median([f[f"{c}_se"] for f in fits]) == pytest.approx(spread, rel=0.35)
    assert N.recovery_curve(t, np.full(10, 0.4))["rate_se"] is None or N.recovery_curve(t, np.full(10, 0.4))["r2"] is None


def test_emergence(spark):
    rng = np.random.default_rng(4)
    rows = [("a", y, float(rng.normal(0, 0.5) + max(0, y - 2010) * 0.1)) for y in range(1991, 2091)] + [("flat", y, 1.0) for y in range(1991, 2030)]
    d = spark.createDataFrame(rows, "s string, y int, v double")
    got = {r.s: r.emerged for r in T.emergence(d, ["s"], "y", "v", (1991, 2010)).collect()}
    assert 2015 < got["a"] < 2060 and got["flat"] is None


def test_rotation(spark):
    for area, want in ((50_000 / 30, 60.0), (100_000 / 30, 30.0), (0.0, math.inf)):
        d = spark.createDataFrame([(1991 + i, float(area)) for i in range(30)], "y int, a double")
        assert T.rotation(d, "y", "a", 100_000.0).first().rotation == pytest.approx(want)


def test_polygons_albers_and_lines(spark):
    square = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)]
    shapes = S.polygons(spark, {"sq": square})
    pts = spark.createDataFrame([(1.0, 1.0), (5.0, 1.0), (None, 1.0)], "px double, py double")
    left = S.points_in_polygons(pts, "px", "py", shapes, "left").collect()
    assert sorted(str(r.name) for r in left) == ["None", "None", "sq"]
    assert S.points_in_polygons(pts, "px", "py", shapes, tile=1.5).count() == 1
    assert [r[0] for r in pts.select(K.in_ring("px", "py", square)).collect()][:2] == [True, False]
    assert shapes.select(K.ring_area(F.col("ring")), K.line_length(F.col("ring"))).first()[:] == (16.0, 12.0)
    e, n = K.albers("px", "py")
    x = spark.createDataFrame([(-96.0, 23.0)], "px double, py double").select(e, n).first()
    assert abs(x[0]) < 1e-6 and abs(x[1]) < 1e-6
    with pytest.raises(ValueError):
        S.avoided(pts, "px", "py", shapes.withColumn("owner", F.lit("x")))


def test_composite_rules(spark):
    d = spark.createDataFrame([("a", 1.0, 5.0), ("b", 2.0, 5.0), ("c", 3.0, None)], "k string, u double, w double")
    assert C.complete(d, ["u", "w"]) == ["u"]
    out = {r.k: (r.composite, r.rank) for r in C.composite(d, "k", ["u", "w"]).collect()}
    assert out["c"] == (None, None) and out["b"][1] == 1
    inv = C.normalized(C.melted(spark.createDataFrame([(1, 1.0), (2, 2.0), (3, 3.0)], "k int, v double"), "k", ["v"]), "k", "minmax", ["v"])
    assert sorted(r.score for r in inv.collect()) == [0, 0.5, 1]
    with pytest.raises(ValueError):
        C.composite(d, "k", ["u", "w"], {"u": 1.0})


def test_dominant_entity_keeps_its_rank(spark):
    d = spark.createDataFrame([("a", 3.0, 3.0, 3.0), ("b", 2.0, 1.0, 1.0), ("c", 1.0, 2.0, 2.0)], "k string, u double, v double, w double")
    names = ["u", "v", "w"]
    sens = C.weight_sensitivity(C.normalized(C.melted(d, "k", names), "k"), "k", C.dirichlet(spark, names, 500))
    assert sens.where("k = 'a' AND rank = 1").first().probability > 0.95
    assert 0.6 < C.rank_stability(sens, "k").first().stability <= 1


def test_q_values_by_key_have_no_window_of_a_whole_key(spark):
    rng = np.random.default_rng(8)
    rows = [(i, None if i % 50 == 7 else float(x), [None, "a", "b"][i % 3]) for i, x in enumerate(rng.integers(0, 400, 3000) / 1000)]
    d = N.fdr(spark.createDataFrame([*rows, (3000, 0.4, "lone"), (3001, None, "none")], "id int, p double, k string").repartition(5), keys=["k"])
    plan = d._jdf.queryExecution().optimizedPlan().toString()
    assert "unboundedfollowing" not in plan and "currentrow$(), unbounded" not in plan.lower()
    got = {r.id: r.q for r in d.collect()}
    assert len(got) == 3002 and got[3000] == 0.4 and got[3001] is None
    for k in (None, "a", "b"):
        mine = sorted((p, i) for i, p, of in rows if of == k and p is not None)
        low = 1.0
        for n in range(len(mine), 0, -1):
            low = min(low, mine[n - 1][0] * len(mine) / n)
            assert got[mine[n - 1][1]] == pytest.approx(low)
    assert all(got[i] is None for i, p, _ in rows if p is None)


def test_bare_frequency_follows_the_rows_of_the_file(spark, tmp_path):
    """Sums of discounts that make 5 % but for the last digit, over several row groups."""
    import pandas as pd

    from geoloom.plans import registry

    rng = np.random.default_rng(11)
    n = 60_000
    d = pd.DataFrame({"l_partkey": rng.integers(0, 900, n), "l_discount": rng.choice([0.01, 0.03, 0.05, 0.07, 0.09], n), "l_extendedprice": 1.0, "l_tax": 0.0, "l_shipdate": pd.to_datetime(rng.integers(1992, 1999, n).astype(str))})
    d.to_parquet(tmp_path / "lineitem.parquet", row_group_size=2_000, coerce_timestamps="us")
    sums = d.groupby([d.l_partkey, d.l_shipdate.dt.year]).l_discount.agg(lambda v: np.cumsum(v.to_numpy())[-1] / len(v) * 100 < 5)
    want = sums.groupby(level=0).mean().round(6)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20k")
    try:
        got = {r.cell: r.frequency for r in registry.QUERIES["bare_frequency"](spark, str(tmp_path)).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == pytest.approx(want.to_dict(), abs=2e-6)


def test_tables_of_cells_are_not_broadcast(spark, tmp_path, monkeypatch):
    dem(spark, valley(12)).write.parquet(f"{tmp_path}/c")
    cells = spark.read.parquet(f"{tmp_path}/c")
    plans, cut = [], H.cut
    monkeypatch.setattr(H, "cut", lambda df, name: plans.append(df._jdf.queryExecution().executedPlan().toString()) or cut(df, name))
    e = H.flow_edges(H.flow_direction(cells))
    up = H.accumulate(e)
    down = H.downstream(e, F.col("dist"), F.lit(False))
    assert len(plans) > 6 and not any("Broadcast" in p for p in plans)
    assert any("_own" in p and "SortMergeJoin [next" in p for p in plans)
    edges = {r.cell: (r.next, r.dist) for r in e.collect()}
    n, far = dict.fromkeys(edges, 0), {}
    for c in edges:
        at, cost = c, 0.0
        n[at] += 1
        while edges[at][0] is not None:
            at, cost = edges[at][0], cost + edges[at][1]
            n[at] += 1
        far[c] = (pytest.approx(cost), at)
    assert {r.cell: r.accumulation for r in up.collect()} == n
    assert {r.cell: (r.cost, r.last) for r in down.collect()} == far


def test_capacity_refusals(spark):
    with pytest.raises(ValueError):
        C.adaptive_capacity(spark, {"nothing": 1.0})
    with pytest.raises(ValueError):
        C.adaptive_capacity(spark, {"crew_capacity": 0.5})
    comp = C.adaptive_capacity(spark, {"crew_capacity": 0.5, "mutual_aid": 1.0}, {"crew_capacity": "s", "mutual_aid": "t"})
    with pytest.raises(ValueError):
        C.community_weighted(comp, None, None)
    assert C.community_weighted(comp, {"crew_capacity": 3, "mutual_aid": 1}, "council").agg(F.sum("weight"), F.sum("contribution")).first()[:] == (1.0, 0.625)


def test_false_discovery(spark):
    d = spark.createDataFrame([(0.01,), (0.02,), (0.03,), (0.5,), (None,)], "p double")
    assert sorted(r.q for r in N.fdr(d).collect() if r.q is not None) == pytest.approx([0.04, 0.04, 0.04, 0.5])


def test_stack_and_empty(spark):
    d = dem(spark, valley(4))
    assert cube.stacked({"2020-01-01": d, "2020-02-01": d}).select("time").distinct().count() == 2
    none = d.limit(0)
    assert H.flow_direction(none).count() == 0 and V.slope_degrees(none, "elevation").count() == 0
    assert R.normalized(none, {"elevation": False}).count() == 0
    assert H.accumulate(H.flow_edges(H.flow_direction(none))).count() == 0
