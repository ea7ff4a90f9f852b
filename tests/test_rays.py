import math

from pyspark.sql import functions as F

from fieldspark.functions import geo as G
from fieldspark.plans import jobs, rays

EDGE = "e struct<p:struct<x:double,y:double>,q:struct<x:double,y:double>>"


def test_meeting(spark):
    # From (0, 0) to (10, 0): across, at an end, short of it, along it, behind it, beside it, a point on it, a null end.
    cases = [((5, -1), (5, 1), 0.5), ((10, 0), (10, 3), 1.0), ((11, -1), (11, 1), None), ((4, 0), (20, 0), 0.4), ((-9, 0), (-1, 0), None), ((-9, 0), (3, 0), 0.0), ((2, 1), (8, 1), None), ((7, 0), (7, 0), 0.7), ((None, 0), (7, 0), None)]
    pt = lambda p: tuple(None if x is None else float(x) for x in p)
    df = spark.createDataFrame([(i, (pt(a), pt(b))) for i, (a, b, _) in enumerate(cases)], f"i int, {EDGE}")
    got = {r["i"]: r["t"] for r in df.select("i", G.meeting(F.col("e"), *map(F.lit, (0.0, 0.0, 10.0, 0.0))).alias("t")).collect()}
    for i, (_, _, want) in enumerate(cases):
        assert got[i] == want or math.isclose(got[i], want), (i, got[i], want)
    still = df.select(G.meeting(F.col("e"), *map(F.lit, (5.0, 0.0, 5.0, 0.0))).alias("t"))
    assert all(r["t"] is None for r in still.collect())


def test_adaptive_step(spark):
    got = spark.createDataFrame([(0.0,), (100.0,), (2500.0,), (20000.0,), (None,)], "r double").select(rays.adaptive_step_deg(F.col("r"), 5.0).alias("s")).collect()
    want = [5.0, 5.0, math.degrees(20 / 2500), 0.25]
    assert all(math.isclose(a["s"], b) for a, b in zip(got, want, strict=False))
    sites = spark.createDataFrame([(1, 0.0, 0.0, 250.0)], "site_id long, latitude double, longitude double, reach_m double")
    x = rays.adaptive_lattice(sites, 50)
    assert x.count() == 5 * math.ceil(360 / 5.0) and x.agg(F.max("bearing_deg")).first()[0] == 355.0


def test_along_rays_keeps_the_nearest_of_an_id_and_all_without(spark):
    profiles = [(1, 2, 30.0, 7, 1), (1, 2, 10.0, 7, 2), (1, 2, 40.0, None, 3), (1, 2, 41.0, None, 4), (1, 2, 99.0, 8, 5), (1, 0, 1.0, 9, 6)]
    p = spark.createDataFrame(profiles, "site_id long, bearing_bin int, start_m double, map_id long, obstacle_id long")
    r = spark.createDataFrame([("a", 1, 11.9, 50.0), ("b", 1, 358.0, 50.0), ("c", 1, 12.0, 5.0), ("d", 1, None, 50.0)], "ray string, site_id long, bearing_deg double, r_end_m double")
    got = sorted((x["ray"], x["obstacle_id"]) for x in rays.along_rays(r, p, 5.0, ["ray"]).collect())
    assert got == [("a", 2), ("a", 3), ("a", 4), ("b", 6)]
    assert rays.along_rays(r.limit(0), p, 5.0, ["ray"]).count() == 0


def test_segments_keep_what_is_known(spark):
    ring = [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0), (0.0, 0.0)]
    wide = [(-50.0, -50.0), (60.0, -50.0), (60.0, 60.0), (-50.0, 60.0), (-50.0, -50.0)]
    shape = "ring array<struct<x:double,y:double>>, sx double, sy double"
    b = spark.createDataFrame([(5, {"building": "Warehouse"}, ring, 5.0, 5.0), (6, {"building": "house"}, ring, 5.0, 5.0), (9, {}, ring, 5.0, 5.0)], f"building_id long, tags map<string,string>, {shape}")
    w = spark.createDataFrame([(wide, 5.0, 5.0)], shape)
    rows = [(1, 5.1, 5.2, "unknown", "unknown", None), (2, 5.1, 5.2, "unknown", "glass", 3), (3, 5.1, 5.2, "trees", "wood", None), (4, 30.1, 30.2, "unknown", "unknown", None), (5, 500.0, 0.0, "unknown", "unknown", None)]
    s = spark.createDataFrame(rows, "segment_id long, px double, py double, kind string, material string, map_id long")
    got = {r["segment_id"]: (r["kind"], r["material"], r["map_id"]) for r in rays.filled_segments(s, b, w, 20.0, 90.0).collect()}
    assert got == {1: ("large_structure", "metal", 5), 2: ("large_structure", "glass", 3), 3: ("trees", "wood", None), 4: ("trees", "wood", None), 5: ("unknown", "unknown", None)}


def test_points_take_finite_neighbours_only(spark):
    near = [(i, 38.0 + 0.0001 * i, -121.5, None if i == 1 else 10.0 * i, [float("nan"), -60.0, -70.0, -80.0][i], 100.0, i > 0) for i in range(4)]
    stored = spark.createDataFrame(near, "target_id long, latitude double, longitude double, z_ground_m double, incident_power_dbm double, return_loss_db double, valid boolean")
    points = spark.createDataFrame([(1, 38.0, -121.5)], "selected_id long, latitude double, longitude double")
    got = rays.at_points(points, stored).first()
    d = [max(0.25, math.radians(0.0001 * i) * G.EARTH_M) for i in range(4)]
    w = [1 / x**2 for x in d]
    assert math.isclose(got["z_ground_m"], sum(w[i] * 10 * i for i in (0, 2, 3)) / sum(w[i] for i in (0, 2, 3)), abs_tol=1e-6)
    assert math.isclose(got["incident_power_dbm"], -sum(w[i] * (50 + 10 * i) for i in (1, 2, 3)) / sum(w[1:]), rel_tol=1e-6)
    assert got["nearest_id"] == 0 and not got["near_valid"] and got["failure"] & rays.NO_ENVIRONMENT and not got["screening"]


def test_a_job_writes_its_parts(spark, data, tmp_path):
    jobs.write_job(spark, data, "motion", str(tmp_path))
    assert {p.name for p in tmp_path.iterdir()} == set(jobs.JOBS["motion"])
