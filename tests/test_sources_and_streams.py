import json
import time

import pytest
from pyspark.sql import functions as F

from fieldspark.functions import text
from fieldspark.operators.asof import nearest_in_time
from fieldspark.operators.rings import stitched
from fieldspark.plans.measurement import motion_events
from fieldspark.sources import sinks, telemetry
from fieldspark.sources.views import view
from fieldspark.streaming import monitor


def test_json_files(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"timestamp_ms": 1000, "pci": 3, "channel_level_db": [-70, -80, -90]}, {"timestamp_ms": 2000}]))
    (tmp_path / "b.json").write_text(json.dumps({"timestamp_ms": 3000, "channel_level_db": [-60]}))
    (tmp_path / "c.json").write_text("{ not json")
    rows = sorted(telemetry.read_telemetry(spark, f"{tmp_path}/*.json").collect(), key=lambda r: r["timestamp_ms"])
    assert [r["timestamp_ms"] for r in rows] == [1000, 2000, 3000]
    assert [r["channel_level_db"] for r in rows] == [[-70.0, -80.0], [-999.0, -999.0], [-60.0, -999.0]]
    assert rows[1]["pci"] == 0


def test_gps_file(spark, tmp_path):
    (tmp_path / "g.csv").write_text("time,location.lat,location.lon,altitude,velocity.x,velocity.y,velocity.z,horizontal_accuracy,vertical_accuracy\n2024-01-01T00:00:02Z,38.1,-121.2,5,3,4,0,2,3\n")
    row = telemetry.read_gps(spark, str(tmp_path / "g.csv")).first()
    assert (row["latitude"], row["speed_mps"], row["timestamp_ms"]) == (38.1, 5.0, 1704067202000)


def test_geojson(spark, tmp_path):
    square = [[0, 0], [0, 1], [1, 1], [1, 0]]
    poly = {"type": "Feature", "id": "7", "properties": {"building": "house", "x": ""}, "geometry": {"type": "Polygon", "coordinates": [square]}}
    multi = {"type": "Feature", "properties": {"osm_id": "9"}, "geometry": {"type": "MultiPolygon", "coordinates": [[square], [square[:2]]]}}
    (tmp_path / "a.json").write_text(json.dumps({"type": "FeatureCollection", "features": [poly, multi]}))
    (tmp_path / "b.json").write_text("\x1e" + json.dumps(poly) + "\n\x1e" + json.dumps(multi))
    rows = telemetry.read_geojson(spark, f"{tmp_path}/*.json").collect()
    assert sorted(r["source_id"] for r in rows) == ["7", "7", "9", "9"]
    assert all(len(r["ring"]) == 5 for r in rows) and {tuple(r["tags"]) for r in rows} == {("building",), ()}


def test_text_functions(spark):
    tags = [({"height": "12.5 m"}, 12.5), ({"height": "x", "building:levels": "4"}, 12.0), ({"building": "House"}, 6.0), ({"height": "0.2"}, None)]
    df = spark.createDataFrame(tags, "t map<string,string>, want double").select(text.building_height_m(F.col("t")).alias("h"), "want")
    assert all(r["h"] == r["want"] for r in df.collect())
    out = spark.createDataFrame([('"a"=>"1","b"=>"2","a"=>"3"',), ("",)], "x string").select(text.other_tags(F.col("x")).alias("m")).collect()
    assert [r["m"] for r in out] == [{"a": "3", "b": "2"}, {}]
    said = [('noise {"scene_type": "street", "hazards": ["ice"]} end',), ("Scene type: park with trees\nmore",), ("nothing",), ("A Street view",)]
    got = [r["s"] for r in spark.createDataFrame(said, "x string").select(text.scene(F.col("x")).alias("s")).collect()]
    assert [s["scene_type"] for s in got] == ["street", "park with trees", "unknown", "Street"] and got[0]["hazards"] == ["ice"]


def test_nearest_in_time_equals_brute_force(spark):
    left = [(i, (i * 7919) % 5000) for i in range(60)]
    right = [(i, (i * 104729) % 5000 // 10 * 10) for i in range(80)]
    a, b = spark.createDataFrame(left, "l long, lt long"), spark.createDataFrame(right, "r long, rt long")
    got = {r["l"]: r["r"] for r in nearest_in_time(a, b, 50, "lt", "rt", "l", "r").collect()}
    want = {}
    for i, t in left:
        near = [(abs(t - u), u, j) for j, u in right if abs(t - u) <= 50]
        if near:
            want[i] = min(near)[2]
    assert got == want


def run(stream, tmp_path, name, mode="append"):
    q = stream.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)


def test_streams_equal_batches(spark, data, tmp_path):
    batch = view(spark, data, "fx_telemetry").withColumn("device", F.lit(1).cast("long"))
    batch.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = monitor.telemetry_stream(spark, str(tmp_path / "in"), batch.schema)
    got = {r["event_id"] for r in run(monitor.crossings(stream), tmp_path, "crossings").collect()}
    assert got == {r["event_id"] for r in motion_events(batch).collect()}
    rows = run(monitor.baselines(stream), tmp_path, "baselines").collect()
    assert len(rows) == batch.count() and any(r["reset"] for r in rows)
    assert run(monitor.tumbling_positions(stream, "1 hour"), tmp_path, "hours", "complete").agg(F.sum("n")).first()[0] == len(rows)
    assert run(monitor.health(stream), tmp_path, "health", "complete").count() > 0
    assert run(monitor.alerts(stream), tmp_path, "alerts").count() > 0


def test_nearest_match_and_late_rows_of_streams(spark, tmp_path):
    at = lambda ms: f"timestamp_millis({ms})"
    base = 1_704_067_200_000
    gps = spark.createDataFrame([(i, base + i * 1000) for i in range(30)], "gps_id long, ms long").selectExpr("gps_id", at("ms") + " AS event_time", "ms")
    tel = spark.createDataFrame([(i, base + i * 1700 + (i * 37) % 900, 1) for i in range(20)], "event_id long, ms long, pci int").selectExpr("event_id", at("ms") + " AS event_time", "pci", "ms")
    end = base + 10_000_000
    for k, (df, extra) in enumerate(((gps, f"SELECT 999L AS gps_id, {at(end)} AS event_time, {end}L AS ms"), (tel, f"SELECT 999L AS event_id, {at(end + 1500)} AS event_time, 1 AS pci, {end + 1500}L AS ms"))):
        for n, part in enumerate((df, spark.sql(extra), spark.sql(extra.replace("999L", "998L").replace(str(end), str(base)).replace(str(end + 1500), str(base))))):
            part.coalesce(1).write.parquet(f"{tmp_path}/{k}/{n}")
    read = lambda k, df: spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/{k}")
    stream = monitor.matched_stream(read(0, gps), read(1, tel))
    q = stream.writeStream.format("memory").queryName("nearest").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {r["gps_id"]: r["event_id"] for r in spark.table("nearest").collect() if r["gps_id"] < 900}
    want = {r["gps_id"]: r["event_id"] for r in nearest_in_time(gps.withColumnRenamed("ms", "g"), tel.withColumnRenamed("ms", "t"), 2000, "g", "t", "gps_id", "event_id").collect()}
    assert got == want and len(want) > 20
    assert monitor.late_rows(q) >= 0


def test_late_rows_are_counted_over_more_reports_than_a_query_holds(spark, tmp_path):
    late, n = monitor.LateRows(), 115
    (tmp_path / "in").mkdir()
    for i in range(n):
        (tmp_path / "in" / f"{i:04}.json").write_text('{"t": "2024-01-01T%s:00:00Z"}' % ("12" if i == 0 else "01"))
    spark.streams.addListener(late)
    try:
        rows = spark.readStream.schema("t timestamp").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
        counts = rows.withWatermark("t", "1 minute").groupBy(F.window("t", "1 minute")).count().coalesce(1)
        q = counts.writeStream.outputMode("update").format("memory").queryName("late").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        taken = spark.table("late").groupBy("window").agg(F.max("count").alias("n")).agg(F.sum("n")).first()[0]
        for _ in range(100):
            if late.of(q) >= n - taken:
                break
            time.sleep(0.1)
        assert late.of(q) == n - taken > 100 and monitor.late_rows(q) < late.of(q)
    finally:
        spark.streams.removeListener(late)


def test_a_product_is_switched_as_a_whole(spark, tmp_path, monkeypatch):
    folder = f"{tmp_path}/p"
    frame = lambda p, v: (spark.createDataFrame([(p, 1.0, v)], "product_id string, latitude_deg double, snr_db double"), spark.createDataFrame([(p, "x")], "product_id string, note string"))
    read = lambda p=None: {r["product_id"]: r["snr_db"] for r in telemetry.read_product(spark, folder, ["snr_db"], p).collect()}
    sinks.write_product(*frame("a", 4.0), folder)
    sinks.write_product(*frame("b", 5.0), folder)
    assert read() == {"a": 4.0, "b": 5.0}
    with monkeypatch.context() as m:
        m.setattr(sinks, "manifest", lambda df: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            sinks.write_product(*frame("a", 6.0), folder)
    with monkeypatch.context() as m:
        m.setattr(sinks, "switch", lambda *a: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            sinks.write_product(*frame("a", 7.0), folder)
    assert read() == {"a": 4.0, "b": 5.0} and read("a") == {"a": 4.0}
    sinks.write_product(*frame("a", 8.0), folder)
    assert read() == {"a": 8.0, "b": 5.0}
    with pytest.raises(ValueError, match="no such product"):
        telemetry.read_product(spark, folder, ["snr_db"], "c")


def test_other_readers(spark, tmp_path):
    (tmp_path / "g.csv").write_text("latitude,longitude,time,velocity.x,velocity.y,velocity.z\n38.1,-121.2,2024-01-01T00:00:02Z,3,4,0\n")
    row = telemetry.read_gps(spark, str(tmp_path / "g.csv")).first()
    assert (row["latitude"], row["longitude"], row["speed_mps"], row["timestamp_ms"], row["altitude"]) == (38.1, -121.2, 5.0, 1704067202000, None)
    (tmp_path / "s.csv").write_text("pci,longitude,latitude,arfcn,azimuth_deg,beamwidth_deg,height_ft,beamwidth_v_deg,beamwidth_h_deg,antenna_gain_dbi,tx_power_dbm,channel_bw_mhz\n7,-121,38,633334,10,65,100,8,65,17,43,100\n")
    row = telemetry.read_sites(spark, str(tmp_path / "s.csv")).first()
    assert (row["pci"], round(row["height_m"], 2), round(row["freq_mhz"], 2)) == (7, 30.48, 3500.01)
    ring = [{"lat": 0, "lon": 0}, {"lat": 0, "lon": 1}, {"lat": 1, "lon": 1}]
    (tmp_path / "e.json").write_text(json.dumps({"elements": [{"type": "way", "id": 1, "tags": {"building": "yes", "landuse": "farm"}, "geometry": ring}, {"type": "way", "id": 2, "tags": {"natural": "wood"}, "geometry": ring}, {"type": "way", "id": 3, "tags": {"building": "yes"}, "geometry": ring[:2]}]}))
    assert sorted((r["id"], r["kind"]) for r in telemetry.read_elements(spark, str(tmp_path / "e.json")).collect()) == [(1, "building"), (1, "landuse"), (2, "landuse")]
    (tmp_path / "p.json").write_text(json.dumps({"tx_lat": 1.0, "version": "v", "profiles": [{"bearing_deg": 0, "segments": [{"r0_m": 1, "r1_m": 2, "kind": "tree", "osm_id": 4}], "terrain_heights": []}, {"bearing_deg": 5, "segments": None}]}))
    segments, heights = telemetry.read_profiles(spark, str(tmp_path / "p.json"))
    assert sorted((r["bearing_deg"], r["osm_id"] or 0) for r in segments.collect()) == [(0.0, 4), (5.0, 0)] and heights.count() == 2
    merged = spark.createDataFrame([({"osm_id": "1", "name": "A", "empty": "", "other_tags": '"name"=>"B","height"=>"7"'},)], "p map<string,string>").select(telemetry.merged(F.col("p")).alias("m")).first()["m"]
    assert merged == {"name": "A", "height": "7"}


def test_other_writers(spark, tmp_path):
    from fieldspark.sources import sinks

    df = spark.createDataFrame([("a", 1.0, 2.0), ("a", 3.0, 4.0)], "product_id string, latitude_deg double, snr_db double")
    meta = spark.createDataFrame([("a", "x")], "product_id string, note string")
    sinks.write_product(sinks.as_product(df, "a"), meta, f"{tmp_path}/p")
    assert telemetry.read_product(spark, f"{tmp_path}/p", ["snr_db"], "a").columns == ["product_id", "snr_db"]
    m = sinks.manifest(df).first()
    assert m["n"] == 2 and [x["name"] for x in m["layers"]] == ["latitude_deg", "snr_db"]
    assert [r["name"] for r in sinks.lacking(spark.createDataFrame([("a",)], "name string"), ["a", "b"]).collect()] == ["b"]
    square = [[0.0, 0.0], [0.0, 1.0], [1.0, 1.0], [0.0, 0.0]]
    rows = [("1", "building", {"height": "9"}, square)] * 2 + [("2", "landuse", {}, square), ("3", "road", {}, square), ("4", "building", {}, square[:2])]
    held, counts = sinks.build_region(spark.createDataFrame(rows, "source_id string, kind string, tags map<string,string>, ring array<array<double>>"))
    assert sorted((r["source_id"], r["height_m"], r["max_lat"]) for r in held.filter("kind = 'building'").collect()) == [("1", 9.0, 1.0)]
    assert {r["kind"]: r["n"] for r in counts.collect()} == {"building": 2, "landuse": 1, "skipped": 2}
    lines = spark.createDataFrame([(1, 0, [(0.0, 0.0), (1.0, 0.0)]), (1, 1, [(1.0, 1.0), (1.0, 0.0)]), (1, 2, [(1.0, 1.0), (0.0, 0.0)]), (2, 0, [(0.0, 0.0), (5.0, 5.0)])], "relation_id long, segment_no int, points array<struct<x:double,y:double>>")
    rings = stitched(lines).collect()
    assert [(r["relation_id"], len(r["ring"])) for r in rings] == [(1, 4)] and rings[0]["ring"][0] == rings[0]["ring"][-1]
    profiles = spark.createDataFrame([("k", 1)], "profile_key string, bin int")
    sinks.write_profiles(profiles, f"{tmp_path}/q")
    sinks.write_profiles(spark.createDataFrame([("k", 2), ("j", 3)], "profile_key string, bin int"), f"{tmp_path}/q")
    assert sorted((r["profile_key"], r["bin"]) for r in spark.read.parquet(f"{tmp_path}/q").collect()) == [("j", 3), ("k", 2)]
    t = spark.createDataFrame([(1, 2.0, 3.0)], "timestamp_ms long, velocity_mps double, cfo_est double")
    sinks.write_analysis(t, t, t, t, f"{tmp_path}/r")
    sinks.write_velocities(t, f"{tmp_path}/v")
    assert spark.read.option("header", True).csv(f"{tmp_path}/v").columns == ["timestamp_ms", "velocity_mps", "cfo_est"] and spark.read.json(f"{tmp_path}/r/statistics").count() == 1
