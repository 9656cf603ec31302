"""Sources, sinks, governance and streams."""

import json
from datetime import date

import pytest
from pyspark.sql import functions as F

from geoloom import governance as G
from geoloom.sources import files, gated, parse, sinks, synthetic
from geoloom.streaming import feeds

BOX = (-105.85, 40.55, -105.75, 40.61)


def test_synthetic_layers(spark):
    scene = synthetic.optical_scene(spark, BOX, "2020-07-01")
    bounds = scene.agg(*[F.min(c).alias(c) for c in ("red", "nir", "swir16")], F.count("*").alias("n")).first()
    assert bounds.n == 50 * 30 and all(bounds[c] >= 0 for c in ("red", "nir", "swir16"))
    again = synthetic.optical_scene(spark, BOX, "2020-07-01")
    assert scene.select(F.sum("nir")).first()[0] == pytest.approx(again.select(F.sum("nir")).first()[0])
    t = synthetic.terrain(spark, BOX).agg(F.count("elevation_m"), F.min("slope_deg")).first()
    assert t[0] == 1500 and t[1] >= 0
    s = synthetic.burn_severity(spark, BOX).agg(F.min("burn_severity"), F.max("burn_severity")).first()
    assert 0 <= s[0] <= s[1] <= 1
    assert synthetic.soil(spark, BOX).agg(F.max("organic_matter_pct")).first()[0] <= 8
    d = synthetic.detections(spark, BOX, "2020-08-01", "2020-08-31")
    assert d.count() == 40 and d.agg(F.max("acq_date")).first()[0] == date(2020, 8, 31)
    assert synthetic.soil_moisture(spark, BOX, "2020-01-01", "2020-01-05").select("time").distinct().count() == 5
    assert synthetic.regions(spark).count() == 3


def test_cells_round_trip_and_pushdown(spark, tmp_path):
    g = synthetic.grid(spark, BOX).withColumn("time", F.lit("2020-01-01").cast("date")).withColumn("v", F.when(F.col("x") == 0, float("nan")).otherwise(1.0))
    sinks.write_cube(g, str(tmp_path / "c"))
    back = files.cells(spark, str(tmp_path / "c"), (-105.85, 40.55, -105.80, 40.56))
    assert 0 < back.count() < g.count() and back.where("v IS NULL").count() > 0 and back.where("isnan(v)").count() == 0
    plan = back._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(lon)" in plan or "GreaterThanOrEqual(lon" in plan


def test_overlapping_csv_windows_count_once(spark, tmp_path):
    head = "latitude,longitude,acq_date,frp,confidence\n"
    (tmp_path / "a.csv").write_text(head + "40.6,-105.8,2020-08-01,5.5,80\n40.6,-105.8,2020-08-02,x,n\n")
    (tmp_path / "b.csv").write_text(head + "40.6,-105.8,2020-08-01,5.5,80\n10.0,-105.8,2020-08-01,5.5,80\n")
    out = files.detections(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")], "2020-08-01", "2020-08-31", BOX).collect()
    assert len(out) == 2 and sorted(str(r.frp) for r in out) == ["5.5", "None"]


def test_features_of_both_dialects(spark, tmp_path):
    ring = [[0, 0], [1, 0], [1, 1], [0, 0]]
    (tmp_path / "g.json").write_text(json.dumps({"features": [{"properties": {"name": "a", "acres": "1500"}, "geometry": {"type": "Polygon", "coordinates": [ring]}}, {"attributes": {"name": "b", "acres": "x"}, "geometry": {"rings": [ring]}}]}))
    f = files.features(spark, str(tmp_path / "g.json"), {"name": "string", "acres": "string"})
    assert {r.name: len(r.ring) for r in f.collect()} == {"a": 4, "b": 4}
    assert [r.name for r in files.perimeters(f, (0, 0, 2, 2)).collect()] == ["a"]
    sinks.write_geojson(f, str(tmp_path / "out"))
    assert "Feature" in spark.read.text(str(tmp_path / "out")).first()[0]


def test_nested_series(spark):
    raw = spark.createDataFrame([(json.dumps([{"stationTriplet": "1:CO:SNTL", "data": [{"values": [{"date": "2020-01-01", "value": 3.5}, {"date": "2020-01-02", "value": "n/a"}]}]}]),)], "raw string")
    assert [r.value for r in parse.station_series(raw).collect()] == [3.5, None]
    flow = {"value": {"timeSeries": [{"sourceInfo": {"siteName": "R", "siteCode": [{"value": "07"}], "geoLocation": {"geogLocation": {"latitude": 1.0, "longitude": 2.0}}}, "values": [{"value": [{"value": "4", "dateTime": "2020-01-01T00:00"}, {"value": "-999", "dateTime": "2020-01-02T00:00"}]}]}]}}
    out = parse.gauge_series(spark.createDataFrame([(json.dumps(flow),)], "raw string")).collect()
    assert [(r.site_no, r.value) for r in out] == [("07", 4.0), ("07", None)]
    b = spark.createDataFrame([(json.dumps({"elements": [{"id": 1, "lat": 1.0, "lon": 2.0, "tags": {"building": "house"}}, {"id": 2, "center": {"lat": 3.0, "lon": 4.0}}]}),)], "raw string")
    assert [(r.lon, r.building) for r in files.buildings(b).collect()] == [(2.0, "house"), (4.0, "yes")]
    r = parse.resolved(spark.createDataFrame([(1, 2)], "LONGITUDE int, z int"), {"lon": ("lon", "longitude"), "lat": ("lat",)}).first()
    assert (r.lon, r.lat) == (1, None)


def test_small_sources(spark, tmp_path):
    cat = spark.createDataFrame([("a", "2020-07-01", 10.0, 0.0, 0.0, 1.0, 1.0), ("b", "2020-07-09", 5.0, 0.0, 0.0, 1.0, 1.0), ("c", "2020-07-08", 50.0, 0.0, 0.0, 1.0, 1.0)], "id string, date string, cloud_pct double, west double, south double, east double, north double").withColumn("date", F.to_date("date"))
    assert files.scene(cat, "2020-07-07", (0.2, 0.2, 0.4, 0.4)).first().id == "b"
    assert files.scene(cat, "2021-07-07", (0.2, 0.2, 0.4, 0.4)).count() == 0
    assert files.blocks(2003, 2011) == [(2000, 2004), (2005, 2009), (2010, 2014)]
    d = spark.createDataFrame([(90, 25, 12), (-9999, 25, 12), (0, 25, 12)], "cbh int, ch int, cbd int")
    assert [r.cbh for r in files.canopy(d).collect()] == [9.0, None, None]
    w = spark.createDataFrame([(date(2020, 1, 1), 0.5, 0.5, 280.15)], "day date, lon double, lat double, air_temperature_max double")
    w.write.parquet(str(tmp_path / "w"))
    assert files.weather(spark, str(tmp_path / "w"), ["tmmx"], (0, 0, 1, 1), "2020-01-01", "2020-12-31").first()[3] == pytest.approx(7.0)
    m = spark.createDataFrame([("m1", "rcp45", 2000, date(2001, 1, 1), 254.5, 40.5, 1.0), ("m2", "rcp45", 1995, date(1996, 1, 1), 254.5, 40.5, 1.0)], "model string, scenario string, block int, time date, lon double, lat double, pr double")
    m.write.partitionBy("model", "scenario", "block").parquet(str(tmp_path / "m"))
    assert [r.lon for r in files.projections(spark, str(tmp_path / "m"), "pr", ["m1", "m2", "m3"], "rcp45", (-106, 40, -105, 41), 2000, 2004).collect()] == [-105.5]
    assert files.intakes(spark).count() == 3


def deal(**kw):
    base = dict(nation="N", counterparty="U", purpose="p", executed=date(2024, 1, 1), expires=date(2024, 12, 31), release_authority="c", tiers=(G.Tier.PARTNER, G.Tier.COMMUNITY), scope=("fires",))
    return G.Agreement(**base | kw)


def test_gates(spark):
    day = date(2024, 6, 1)
    record = G.Record("wells", G.Access.COMMUNITY)
    with pytest.raises(G.AccessDenied):
        G.gated(record, G.Access.PUBLIC, spark.range(1))
    assert G.gated(record, G.Access.COMMUNITY, spark.range(1)).count() == 1
    k = G.Gatekeeper("N", deal())
    k.check(G.Tier.PUBLIC, "anything", on=day)
    k.check(G.Tier.COMMUNITY, "fires", on=day)
    for tier, name, on in ((G.Tier.RESTRICTED, "fires", day), (G.Tier.COMMUNITY, "wells", day), (G.Tier.COMMUNITY, "fires", date(2025, 1, 1))):
        with pytest.raises(G.AccessDenied):
            k.check(tier, name, on=on)
    assert len(k.log) == 5 and k.audit(spark).where("result LIKE 'denied%'").count() == 3
    assert k.most(day) == G.Tier.COMMUNITY and G.Gatekeeper("N").most(day) == G.Tier.PUBLIC
    with pytest.raises(G.AccessDenied):
        k.check_publication(True, None)
    k.check_publication(True, "minutes")
    for bad in ({"tiers": ()}, {"purpose": " "}, {"expires": date(2023, 1, 1)}):
        with pytest.raises(ValueError):
            deal(**bad)
    assert deal().days_left(day) == 213 and "council" not in deal().summary()


def test_denied_load_reads_nothing(spark):
    k, calls = G.Gatekeeper("N"), []
    with pytest.raises(G.AccessDenied):
        k.load(spark, "/nowhere", "sites", G.Tier.COMMUNITY, read=lambda *a: calls.append(a))
    assert not calls and len(k.log) == 1


def test_gated_sources(spark, tmp_path):
    ring = "array<struct<x:double,y:double>>"
    square = [(-105.8, 40.56), (-105.79, 40.56), (-105.79, 40.57)]
    far = [(x + 9, y) for x, y in square]
    fires = [("1990", "600.5", square), ("1990", "90", square), ("unknown", "900", square), ("1970", "900", square), (None, None, square), ("1991", "700", far)]
    path = str(tmp_path / "fires")
    spark.createDataFrame(fires, f"Ig_Year string, BurnBndAc string, ring {ring}").write.parquet(path)
    k = G.Gatekeeper("N")
    got = gated.fire_history(k, spark, path, BOX).collect()
    assert [(r.fire_year, r.acres) for r in got] == [(1990, 600.5)]
    bare = gated.fire_history(k, spark, path, BOX, read=lambda s, p: s.read.parquet(p).select("ring"))
    assert bare.count() == 5
    points = spark.createDataFrame([(1, 2000, 40.56, -105.8), (2, 1980, 40.56, -105.8), (3, 2000, 41.0, -105.8), (4, None, 40.56, -105.8)], "FOD_ID int, FIRE_YEAR int, LATITUDE double, LONGITUDE double")
    out = gated.fire_records(k, spark, "-", BOX, read=lambda s, p: points)
    assert [r.fod_id for r in out.collect()] == [1]
    shape = {"type": "Polygon", "coordinates": [[list(p) for p in [*square, square[0]]]]}
    (tmp_path / "land.json").write_text(json.dumps({"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {"KIND": "trust"}, "geometry": shape}]}))
    assert [r.kind for r in gated.land_status(k, spark, str(tmp_path / "land.json"), {"KIND": "string"}, BOX).collect()] == ["trust"]
    assert [e[2] for e in k.log] == ["fire_history", "fire_history", "ignitions", "land_status"]


def test_soil_properties(spark):
    units = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "mukey int, muname string")
    parts = spark.createDataFrame([(1, 10), (1, 11), (2, 12), (None, 13)], "mukey int, cokey int")
    layers = spark.createDataFrame([(10, 0, 3.0), (10, 20, 1.0), (11, 5, 2.0), (12, 0, 4.0), (13, 0, 9.0)], "cokey int, hzdept_r int, om_r double")
    asked = spark.createDataFrame([(1,), (1,), (None,)], "mukey int")
    assert [r.om_r for r in files.soil_properties(units, parts, layers, asked).collect()] == [3.0]
    assert files.soil_properties(units, parts, layers).count() == 2


def test_guard(spark):
    fine = spark.createDataFrame([("house",), ("barn",)], "kind string")
    assert G.suspicious(fine) == [] and G.guard(fine) is fine
    with pytest.raises(G.AccessDenied):
        G.guard(spark.createDataFrame([("a Burial ground",)], "kind string"))
    assert G.suspicious(spark.createDataFrame([(1,)], "sacred_site int")) == ["sacred_site"]
    assert G.suspicious(fine.limit(0)) == []


def test_release_tiers_and_texts(spark):
    g = synthetic.grid(spark, BOX).withColumn("v", F.lit(2.0))
    assert G.at_tier(g, G.Tier.PUBLIC, ["v"]).first().v == 2.0
    assert G.at_tier(g, G.Tier.PARTNER, ["v"]).count() == 12 * 7
    with pytest.raises(G.AccessDenied):
        G.at_tier(g, G.Tier.COMMUNITY, ["v"])
    p = G.Provenance("t", ("a",), ("b",), {"k": 1}, "council")
    assert len(p.fingerprint()) == 16 and p.fingerprint() == G.Provenance("t", ("a",), ("b",), {"k": 1}, "council").fingerprint() and "council" in p.markdown()
    assert G.care_unmatched({"What?": True}) == ["What?"] and "N" in G.acknowledgment("N", "council") and G.masking_note()
    assert G.tier_rules(spark).count() == 4


def test_streams(spark, tmp_path):
    src = spark.createDataFrame([(1, "2020-01-01 10:00:00", 2.0), (1, "2020-01-01 10:00:00", 2.0), (2, "2020-01-02 10:00:00", 3.0), (3, "2020-01-09 10:00:00", 1.0)], "id int, ts string, v double").withColumn("ts", F.to_timestamp("ts"))
    src.write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(src.schema).parquet(str(tmp_path / "in"))
    feeds.append(feeds.unique_detections(stream(), "ts", ["id", "ts"]), str(tmp_path / "u"), str(tmp_path / "cu"))
    assert spark.read.parquet(str(tmp_path / "u")).count() == 3
    feeds.append(feeds.progression(stream(), "ts", "v"), str(tmp_path / "p"), str(tmp_path / "cp"))
    out = {str(r.start)[:10]: r.detections for r in spark.read.parquet(str(tmp_path / "p")).collect()}
    assert out["2020-01-01"] == 2 and out["2020-01-02"] == 1


def test_publish(spark, tmp_path):
    k = G.Gatekeeper("N")
    with pytest.raises(G.AccessDenied):
        sinks.publish(spark.range(2), str(tmp_path / "r"), k, False, "x")
    sinks.publish(spark.range(2), str(tmp_path / "r"), k, True, "minutes", G.Provenance("t", ("a",)))
    assert spark.read.option("header", True).csv(str(tmp_path / "r")).count() == 2


def test_notes(spark):
    d = spark.createDataFrame([(0.7, 0.85), (None, 0.5)], "v double, c double")
    out = [r[0] for r in d.select(G.two_framings("v", "c")).collect()]
    assert "0.70" in out[0] and "0.85" in out[0] and out[1] is None
    assert "trademark" in G.ocap_note()


def test_features_with_holes_parts_lines_and_points(spark, tmp_path):
    from geoloom.functions.columns import in_polygon

    square = lambda a, b: [[a, a], [b, a], [b, b], [a, b], [a, a]]
    shapes = [
        ("hole", {"type": "Polygon", "coordinates": [square(0, 10), square(4, 6)]}),
        ("parts", {"type": "MultiPolygon", "coordinates": [[square(0, 2)], [square(5, 9), square(6, 8)]]}),
        ("line", {"type": "LineString", "coordinates": [[1, 1], [2, 3]]}),
        ("point", {"type": "Point", "coordinates": [7, 8]}),
        ("none", None),
    ]
    path = str(tmp_path / "f.json")
    with open(path, "w") as f:
        json.dump({"features": [{"properties": {"name": n, "huc8": n}, "geometry": g} for n, g in shapes]}, f)
    d = files.features(spark, path, {"name": "string"})
    rings = {r.name: r.ring for r in d.collect()}
    assert [tuple(p) for p in rings["line"]] == [(1, 1), (2, 3)] and [tuple(p) for p in rings["point"]] == [(7, 8)] and rings["none"] is None
    at = lambda x, y: {r.name for r in d.where("name IN ('hole', 'parts')").where(in_polygon(F.lit(x), F.lit(y), F.col("ring"))).collect()}
    assert at(1.0, 1.5) == {"hole", "parts"} and at(5.1, 5.3) == {"parts"} and at(7.1, 7.2) == {"hole"} and at(8.5, 7.0) == {"hole", "parts"} and at(3.0, 3.1) == {"hole"} and at(11.0, 1.0) == set()
    assert [r.name for r in files.features(spark, path, {"name": "string"}, "name <> 'hole'", (6.5, 7.5, 7.5, 8.5)).orderBy("name").collect()] == ["parts", "point"]
    assert {r.code for r in files.watersheds(spark, path, "subbasin").collect()} == {n for n, _ in shapes}
    with pytest.raises(ValueError):
        files.watersheds(spark, path, 7)
